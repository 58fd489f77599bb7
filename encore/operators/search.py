"""Boolean text search as column predicates."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TERMS, MAX_CHARS = 12, 80


def parse_query(query: str) -> list[list[str]]:
    """A query as OR of ANDs: phrases in double or single quotes; OR, | or 或 between groups.

    AND, +, 与 and 和 say what is so anyway. Of each group the first ``MAX_TERMS`` terms count.
    """
    groups: list[list[str]] = [[]]
    for parts in re.findall(r""""([^"]+)"|'([^']+)'|(\S+)""", unicodedata.normalize("NFKC", query)):
        token = next((p for p in parts if p), "").strip()
        if token.upper() in ("OR", "|", "或"):
            groups.append([])
        elif token and token.upper() not in ("AND", "+", "与", "和"):
            groups[-1].append(token.lower()[:MAX_CHARS])
    return [g[:MAX_TERMS] for g in groups if g]


def validate(query: str) -> None:
    """Rejects queries of which every term is a single letter or digit."""
    terms = [t for g in parse_query(query) for t in g]
    if terms and all(len(t) < 2 and t.isascii() and t.isalnum() for t in terms):
        raise ValueError("search terms need two characters at least")


def matches(haystack: Column, query: str) -> Column:
    """Whether the lower-case haystack satisfies the query; true for an empty one."""
    out = None
    for group in parse_query(query):
        every = None
        for term in group:
            has = haystack.contains(term)
            every = has if every is None else every & has
        out = every if out is None else out | every
    return F.lit(True) if out is None else out


def haystack(*fields: Column) -> Column:
    return F.lower(F.concat_ws(" ", *fields))
