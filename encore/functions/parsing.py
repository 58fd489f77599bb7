"""Parsers of names, dates and timestamp lists."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

DELIMITER = r"^(.*\S) +[/|-] +(\S.*)$"


def title_of(x: Column) -> Column:
    return F.when(x.rlike(DELIMITER), F.regexp_extract(x, DELIMITER, 1)).otherwise(x)


def artist_of(x: Column) -> Column:
    return F.when(x.rlike(DELIMITER), F.regexp_extract(x, DELIMITER, 2)).otherwise(F.lit(""))


def parts_of(text: str, separators: str = "/,&+;") -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "([{（「") - (c in ")]}）」" and depth > 0)
        if depth == 0 and c in separators:
            out.append(text[start:i])
            start = i + 1
    return [p for p in (x.strip() for x in (*out, text[start:])) if p]


@F.pandas_udf(ArrayType(StringType()))
def split_parts(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else parts_of(x))


def written_date(x: Column) -> Column:
    pattern = "([0-9]{4})年([0-9]{1,2})月([0-9]{1,2})日"
    number = lambda i: F.nullif(F.regexp_extract(x, pattern, i), F.lit("")).cast("int")
    return F.make_date(number(1), number(2), number(3))


def relative_micros(x: Column, now: str) -> Column:
    """Microseconds of "n days ago", "n hours ago" and 昨日; null for other phrases."""
    day, hour = 86_400_000_000, 3_600_000_000
    n = F.nullif(F.regexp_extract(x, "^([0-9]+) (?:days?|hours?) ago$", 1), F.lit("")).cast("bigint")
    back = F.when(x == "昨日", F.lit(day)).when(x.contains("day"), n * day).when(x.contains("hour"), n * hour)
    return F.unix_micros(F.lit(now).cast("timestamp")) - back


def fnv1a(text: str | Column) -> Column:
    """The 32-bit FNV-1a hash of the UTF-8 bytes."""
    codes = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-8")), F.lit(".."), F.lit(0)), lambda b: F.conv(b, 16, 10).cast("bigint"))
    return F.aggregate(codes, F.lit(0x811C9DC5).cast("bigint"), lambda h, b: (h.bitwiseXOR(b) * 0x01000193).bitwiseAND(0xFFFFFFFF))


TIME = re.compile(r"(?<![0-9:])(?:([0-9]{1,2}):)?([0-9]{1,2}):([0-5][0-9])(?![0-9:])")
MARK = re.compile(r"^[\s\-–~|.:)]*(?:#?[0-9]{1,3}[.)]\s*)?")
PARSED = ArrayType(StructType().add("seconds", LongType()).add("title", StringType()).add("artist", StringType()).add("raw", StringType()))


def timeline(text: str) -> list[dict]:
    """Rows of a timestamp list: a time, then a title and perhaps an artist. A line of
    several times has a row for each; a time alone takes the next line as its title."""
    out: list[dict] = []
    pending: int | None = None
    for line in text.splitlines():
        found = list(TIME.finditer(line))
        if not found:
            if pending is not None and line.strip():
                out.append(_row(pending, line, line))
            pending = None
            continue
        pending = None
        for m, following in zip(found, [*found[1:], None], strict=True):
            seconds = int(m[1] or 0) * 3600 + int(m[2]) * 60 + int(m[3])
            rest = line[m.end() : following.start() if following else None].strip()
            if rest:
                out.append(_row(seconds, rest, line))
            else:
                pending = seconds
    return out


def _row(seconds: int, rest: str, raw: str) -> dict:
    rest = MARK.sub("", rest.strip(), count=1).strip()
    title, _, artist = rest.partition(" / ")
    return {"seconds": seconds, "title": title.strip(), "artist": artist.strip(), "raw": raw}


@F.pandas_udf(PARSED)
def parsed_timeline(text: pd.Series) -> pd.Series:
    return text.map(lambda x: timeline(x or ""))
