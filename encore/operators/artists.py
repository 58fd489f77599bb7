"""Merges of the names of one artist, each allowed only where there is exactly one target.

Records are rows of (title, artist, n). Candidates meet on keys that only alike names
share, never by comparing all names with all.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.functions import kana, text
from encore.operators.core import connected_components

TYPO_CHARS = 6
TYPO_TARGET = 3
PARTIAL_RATIO = 3.2
PARTIAL_CHARS = 4
KANA_CHARS = 4
# Where names end, what joins several, and words that are no name.
BORDERS = " \u3000._・･-ー–—"
SEPARATORS = "/／&＆+＋、,，"
GENERIC = ("artist", "official", "channel", "vocal", "cover", "music")
ANNOTATION = r"(?i)\b(?:cv|starring|feat(?:uring)?|ft|vocal|members?)\b|歌唱|声優|声优|聲優|组合|組合|成員|成员"
CJK = r"[\p{IsHiragana}\p{IsKatakana}\p{IsHan}]"


def unique_target(pairs: DataFrame) -> DataFrame:
    """title, artist and target of artists with one target; others have no sure one."""
    found = pairs.groupBy("title", "artist").agg(F.countDistinct("target").alias("_n"), F.min("target").alias("target"))
    return found.where("_n = 1").drop("_n")


def plain(records: DataFrame) -> DataFrame:
    """Records whose name says nothing about roles; the others are never merged by likeness."""
    return records.where(~F.col("artist").rlike(ANNOTATION))


def less_one_letter(name: Column) -> Column:
    """The name and all names that lack one of its letters. Names within one edit share one of them."""
    drop = lambda i: F.concat(F.substr(name, F.lit(1), i - 1), F.substr(name, i + 1))
    return F.array_distinct(F.concat(F.array(name), F.transform(F.sequence(F.lit(1), F.length(name)), drop)))


def typo_targets(records: DataFrame) -> DataFrame:
    """Names seen once that are one edit from a name of the same title seen three times or more."""
    long = plain(records).where(F.length("artist") >= TYPO_CHARS)
    once = long.where("n = 1").select("title", "artist", F.explode(less_one_letter(F.col("artist"))).alias("key"))
    often = long.where(F.col("n") >= TYPO_TARGET).select("title", F.col("artist").alias("target"), F.explode(less_one_letter(F.col("artist"))).alias("key"))
    pairs = once.join(often, ["title", "key"]).where(F.levenshtein("artist", "target", 1) == 1)
    return unique_target(pairs.select("title", "artist", "target"))


def partial_pairs(records: DataFrame) -> DataFrame:
    """title, a and b where name b begins or ends with name a, at a border or, for CJK names, anywhere.

    Short names meet the parts of longer ones by equality. Names of several artists are no longer name.
    """
    named = plain(records).select("title", "artist").distinct().withColumns({"text": F.lower(text.clean(F.col("artist"))), "key": text.entity_key(F.col("artist"))})
    size = F.length("text")
    sides = lambda i, j: F.array(F.substr("text", F.lit(1), i), F.substr("text", j))
    borders = F.filter(F.sequence(F.lit(1), size), lambda i: F.substr("text", i, F.lit(1)).isin(*BORDERS))
    by_border = F.flatten(F.transform(borders, lambda i: sides(i - 1, i + 1)))
    anywhere = F.flatten(F.transform(F.sequence(F.lit(PARTIAL_CHARS), size - 1), lambda i: sides(i, size - i + 1)))
    by_script = F.when(size > PARTIAL_CHARS, F.filter(anywhere, lambda x: x.rlike(CJK))).otherwise(F.array().cast("array<string>"))
    whole = named.where((size > 1) & ~F.col("text").rlike(f"[{SEPARATORS}]")).select("title", F.col("artist").alias("b"), F.col("key").alias("_key"), F.explode(F.array_distinct(F.concat(by_border, by_script))).alias("text"))
    safe = (F.length("key") >= PARTIAL_CHARS) & ~F.col("key").isin(*GENERIC)
    fits = (F.col("_key") != F.col("key")) & (F.length("_key") <= F.length("key") * PARTIAL_RATIO) & (F.col("_key").startswith(F.col("key")) | F.col("_key").endswith(F.col("key")))
    return named.where(safe).join(whole, ["title", "text"]).where(fits).select("title", F.col("artist").alias("a"), "b").distinct()


def kana_pairs(records: DataFrame) -> DataFrame:
    """title, a and b where the Latin spelling of kana name a is a word of b, or begins or ends it."""
    records = plain(records)
    spelled = records.where(F.col("artist").rlike(r"[\x{3041}-\x{30F6}]{2}")).select("title", F.col("artist").alias("a"), kana.romanized("artist").alias("key")).where(F.length("key") >= KANA_CHARS)
    word = F.explode(F.filter(F.split(F.lower("artist"), "[^a-z0-9]+"), lambda w: F.length(w) >= KANA_CHARS))
    latin = records.select("title", F.col("artist").alias("b"), word.alias("word"))
    n = F.length("word")
    ends = F.transform(F.sequence(F.lit(KANA_CHARS), n), lambda i: F.array(F.substr("word", F.lit(1), i), F.substr("word", n - i + 1, i)))
    latin = latin.select("title", "b", F.explode(F.array_distinct(F.flatten(ends))).alias("key"))
    return spelled.join(latin, ["title", "key"]).where("a <> b").select("title", "a", "b").distinct()


def winners(n: dict[str, int], near: dict[str, set[str]]) -> dict[str, str]:
    """Whose record each name's goes to in the end, for names with their counts and the names they match.

    Again and again the first record by count and name that matches just one other merges
    with it, into the first of the two, which then matches what either did.
    """
    n, near = dict(n), {k: set(v) for k, v in near.items()}
    ready = [(-n[k], k) for k, v in near.items() if len(v) == 1]
    heapq.heapify(ready)
    into: dict[str, str] = {}
    while ready:
        count, name = heapq.heappop(ready)
        if name in into or -count != n[name] or len(near[name]) != 1:
            continue
        winner, loser = sorted((name, *near[name]), key=lambda k: (-n[k], k))
        into[loser] = winner
        n[winner] += n[loser]
        near[winner].discard(loser)
        for other in near.pop(loser) - {winner}:
            near[other].discard(loser)
            near[other].add(winner)
            near[winner].add(other)
        for k in (winner, *near[winner]):
            if len(near[k]) == 1:
                heapq.heappush(ready, (-n[k], k))
    for name in into:
        while into[name] in into:
            into[name] = into[into[name]]
    return into


def dominant_targets(records: DataFrame, pairs: DataFrame, materialize: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """title, artist and target of merges until no record matches just one other.

    Records of (title, artist, n), pairs of (title, a, b). A task holds one set of names that are linked by pairs.
    """
    node = lambda c: F.concat_ws("\x1f", "title", c)
    pairs = materialize(pairs)
    parts = connected_components(pairs.select(node("a").alias("a"), node("b").alias("b")), materialize)
    both = pairs.unionByName(pairs.select("title", F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("title", F.col("a").alias("artist")).agg(F.collect_set("b").alias("near"))
    linked = records.join(near, ["title", "artist"]).withColumn("node", node("artist")).join(parts, "node")

    def resolve(group: pd.DataFrame) -> pd.DataFrame:
        into = winners(dict(zip(group["artist"], group["n"].tolist(), strict=True)), dict(zip(group["artist"], map(set, group["near"]), strict=True)))
        return pd.DataFrame({"title": [group["title"].iloc[0]] * len(into), "artist": list(into), "target": list(into.values())}, dtype=object)

    return linked.groupBy("component").applyInPandas(resolve, "title string, artist string, target string")


def merged(records: DataFrame, targets: DataFrame) -> DataFrame:
    """``records`` with the counts of merged names under their targets."""
    out = records.join(targets, ["title", "artist"], "left")
    return out.groupBy("title", F.coalesce("target", "artist").alias("artist")).agg(F.sum("n").alias("n"))
