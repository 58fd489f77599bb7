"""The ranking query: scope, search, minimum, page."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from encore.operators import search

MAX_PAGE = 200
VIEWS = ("song", "artist", "video")


def rankings(occurrences: DataFrame, view: str = "song", where: Column | None = None, niche_only: bool = False, hide_unknown: bool = False, min_count: int = 0, metric: str = "n", page: int = 1, page_size: int = 50) -> DataFrame:
    """key, n, videos and rank of one page of a view.

    Rows are cut to the page by a bounded top-k before they are numbered.
    """
    if view not in VIEWS or metric not in ("n", "videos"):
        raise ValueError("no such view or metric")
    if not 1 <= page_size <= MAX_PAGE or page < 1:
        raise ValueError(f"pages start at 1 and have 1 to {MAX_PAGE} rows")
    agg = aggregated(occurrences, view, where, niche_only, hide_unknown, min_count, metric)
    order = [F.desc(metric), F.desc("videos" if metric == "n" else "n"), F.asc("key")]
    top = agg.orderBy(*order).limit(page * page_size)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint")).where(F.col("rank") > (page - 1) * page_size)


def aggregated(occurrences: DataFrame, view: str, where: Column | None = None, niche_only: bool = False, hide_unknown: bool = False, min_count: int = 0, metric: str = "n") -> DataFrame:
    """key, n and videos of all that a ranking ranks."""
    rows = occurrences
    for condition in (where, F.col("niche") if niche_only else None, ~F.col("unknown") if hide_unknown else None):
        rows = rows if condition is None else rows.where(condition)
    return rows.groupBy(F.col(view).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("video").alias("videos")).where(F.col(metric) >= min_count)


#: The fields that a search of each scope reads.
SCOPES = {"all": ("title", "artist_name"), "song": ("title", "artist_name"), "title": ("title",), "artist": ("artist_name",), "source": ("channel", "video_title"), "channel": ("channel",), "video": ("video_title",)}
COMPACT = ("key", "n", "videos", "rank")


@dataclass
class Ranked:
    """A page of a ranking, and the totals of all that it is a page of."""

    records: DataFrame
    totals: DataFrame
    asked: dict

    def payload(self) -> dict:
        totals = self.totals.first().asDict()
        size = self.asked["page_size"]
        return self.asked | totals | {"page_count": -(-totals["total"] // size), "records": [r.asDict() for r in self.records.collect()]}


def search_rankings(
    occurrences: DataFrame, view: str = "song", q: str = "", scope: str = "all", fields: Sequence[str] | None = None, range_: str = "all", now: str = "1998-12-01", metric: str = "n", min_count: int = 1,
    niche_only: bool = False, hide_unknown: bool = False, page: int = 1, page_size: int = 50, compact: bool = False,
) -> Ranked:
    """The ranking of a view over what a search finds.

    occurrences: song, artist, video, played, niche, unknown, and the texts of ``SCOPES``.
    fields replaces the fields of the scope. The 7-day range ends at ``now``. A search of all
    that finds no song is tried on sources, then channels, then videos.
    """
    if scope not in SCOPES or range_ not in ("all", "7d") or view not in VIEWS or min_count < 1:
        raise ValueError("no such scope, range, view or minimum")
    fields = tuple(fields or SCOPES[scope])
    if unknown := set(fields) - {f for s in SCOPES.values() for f in s}:
        raise ValueError(f"no such fields: {sorted(unknown)}")
    search.validate(q)
    rows = occurrences
    if range_ == "7d":
        end = F.lit(now).cast("timestamp_ntz")
        rows = rows.where((F.col("played") <= end) & (F.col("played") > end - F.expr("INTERVAL 7 DAYS")))
    tries = [fields] if not q or scope != "all" or view != "song" else [fields, SCOPES["source"], SCOPES["channel"], SCOPES["video"]]
    for tried in tries:
        found = rows.where(search.matches(search.haystack(*map(F.col, tried)), q)) if q else rows
        if tried is tries[-1] or found.limit(1).count():
            break
    options = {"niche_only": niche_only, "hide_unknown": hide_unknown, "min_count": min_count, "metric": metric}
    records = rankings(found, view, page=page, page_size=page_size, **options)
    if not compact:
        records = records.withColumn("share", F.round(F.col("n") / F.col("videos"), 4))
    totals = aggregated(found, view, **options).agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"), F.coalesce(F.sum("videos"), F.lit(0)).alias("videos"))
    return Ranked(records, totals, {"view": view, "q": q, "fields": list(tried), "range": range_, "metric": metric, "page": page, "page_size": page_size, "compact": compact})
