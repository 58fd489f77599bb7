"""Spark-first analytics over performance logs."""
