"""Readers of HTML columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def title(html: Column) -> Column:
    return F.regexp_extract(html, "<title>([^<]*)</title>", 1)


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def text(html: Column) -> Column:
    """Text without scripts, styles and tags, basic entities decoded, white space collapsed."""
    x = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    x = F.regexp_replace(x, "<[^>]*>", " ")
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(x, r"[ \t\n\r]+", " "))


def balanced(source: str, start: int, opening: str = "([{", closing: str = ")]}") -> str | None:
    """The first bracketed text from ``start`` on, strings respected; nothing is run."""
    depth, begin, quote, i = 0, -1, "", start
    while i < len(source):
        c = source[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c in opening:
            begin = i if depth == 0 else begin
            depth += 1
        elif c in closing and depth:
            depth -= 1
            if depth == 0:
                return source[begin : i + 1]
        i += 1
    return None


def embedded_objects(pages: DataFrame, key: str, html: str, marker: str) -> DataFrame:
    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            at = p[html].map(lambda x: -1 if x is None else x.find(marker))
            yield pd.DataFrame({key: p[key], "object": [balanced(x, a + len(marker)) if a >= 0 else None for x, a in zip(p[html], at, strict=True)]})

    return pages.select(key, html).mapInPandas(find, f"{key} bigint, object string")
