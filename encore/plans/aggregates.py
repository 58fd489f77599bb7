"""Plans of aggregations (section E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from encore.functions import text as tx
from encore.operators import core
from encore.plans.common import OCC, count, occurrences
from encore.plans.registry import Registry, table

reg = Registry()
q = reg.register

RANKS = "ROW_NUMBER() OVER (ORDER BY occurrences DESC, videos DESC, first_seen, {keys})::BIGINT AS rank"


def rank_sql(keys: str) -> str:
    return f"SELECT *, {RANKS.format(keys=keys)} FROM (SELECT {keys}, COUNT(*) AS occurrences, COUNT(DISTINCT video) AS videos, MIN(published) AS first_seen FROM (SELECT o.*, o_orderdate AS published, o_custkey AS channel FROM {OCC} o JOIN orders ON video = o_orderkey JOIN part ON song = p_partkey WHERE NOT niche) GROUP BY {keys})"


def published(spark: SparkSession, d: str) -> DataFrame:
    """Visible occurrences with the date and channel of their video."""
    v = table(spark, d, "orders").select(F.col("o_orderkey").alias("video"), F.col("o_orderdate").alias("published"), F.col("o_custkey").alias("channel"))
    return occurrences(spark, d).where("NOT niche").join(v, "video")


@q(
    "song_ranking",
    "SELECT *, ROW_NUMBER() OVER (ORDER BY occurrences DESC, videos DESC, first_seen, p_name, p_brand)::BIGINT AS rank FROM (SELECT p_name, p_brand, COUNT(*) AS occurrences, COUNT(DISTINCT l_orderkey) AS videos, MIN(o_orderdate) AS first_seen FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' GROUP BY 1, 2)",
)
def song_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: songs by occurrences, videos, first occurrence and name."""
    named = table(spark, d, "part").select(F.col("p_partkey").alias("song"), "p_name", "p_brand")
    return core.ranking(published(spark, d).join(named, "song"), ["p_name", "p_brand"], "video", "published")


@q("rank_songs", rank_sql("song"))
def rank_songs(spark: SparkSession, d: str) -> DataFrame:
    """E01, F01."""
    return core.ranking(published(spark, d), ["song"], "video", "published")


@q("rank_artists", rank_sql("artist"))
def rank_artists(spark: SparkSession, d: str) -> DataFrame:
    return core.ranking(published(spark, d), ["artist"], "video", "published")


@q("rank_channels", rank_sql("channel"))
def rank_channels(spark: SparkSession, d: str) -> DataFrame:
    return core.ranking(published(spark, d), ["channel"], "video", "published")


@q("conditional_range_metrics", f"SELECT song, COUNT(*) AS n_all, COUNT(*) FILTER (WHERE played >= TIMESTAMP '1998-01-01') AS n_1998, COUNT(DISTINCT CASE WHEN played >= TIMESTAMP '1998-01-01' THEN video END) AS videos_1998, COUNT(*) FILTER (WHERE played >= TIMESTAMP '1998-07-01') AS n_half FROM {OCC} GROUP BY song")
def conditional_range_metrics(spark: SparkSession, d: str) -> DataFrame:
    """All ranges in one pass."""
    since = lambda t: F.col("played") >= F.lit(t).cast("timestamp_ntz")
    return occurrences(spark, d).groupBy("song").agg(count().alias("n_all"), F.count_if(since("1998-01-01")).alias("n_1998"), F.countDistinct(F.when(since("1998-01-01"), F.col("video"))).alias("videos_1998"), F.count_if(since("1998-07-01")).alias("n_half"))


@q("song_work_groups", "SELECT work, COUNT(DISTINCT p_brand) AS artists, COUNT(*) AS n FROM (SELECT regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS work, p_brand FROM part) GROUP BY work")
def song_work_groups(spark: SparkSession, d: str) -> DataFrame:
    """By work, then by artist within it."""
    p = table(spark, d, "part").groupBy(tx.work_key(F.col("p_name")).alias("work"), "p_brand").agg(count().alias("n"))
    return p.groupBy("work").agg(count().alias("artists"), F.sum("n").alias("n"))


@q("artist_agg_missing", f"SELECT artist, COUNT(*) AS n, (SELECT COUNT(*) FROM {OCC} WHERE unknown) AS missing FROM {OCC} WHERE NOT unknown GROUP BY artist")
def artist_agg_missing(spark: SparkSession, d: str) -> DataFrame:
    """Unknown artists are counted apart."""
    g = occurrences(spark, d).groupBy(F.when(~F.col("unknown"), F.col("artist")).alias("artist"), "unknown").agg(count().alias("n"))
    whole = Window.partitionBy()
    return g.withColumn("missing", F.sum(F.when(F.col("unknown"), F.col("n")).otherwise(0)).over(whole)).where("NOT unknown").select("artist", "n", "missing")


def _nested_collect(o: DataFrame) -> DataFrame:
    n = o.groupBy("artist", "song").agg(count().alias("n"))
    lists = n.groupBy("artist").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "song"))).alias("s"))
    return lists.select("artist", F.concat_ws(",", F.transform("s", lambda x: F.concat_ws(":", x["song"], -x["n"]))).alias("songs"))


@q("nested_collect", f"SELECT artist, string_agg(song || ':' || n, ',' ORDER BY n DESC, song) AS songs FROM (SELECT artist, song, COUNT(*) AS n FROM {OCC} GROUP BY ALL) GROUP BY artist")
def nested_collect(spark: SparkSession, d: str) -> DataFrame:
    """Songs of an artist, most frequent first."""
    return _nested_collect(occurrences(spark, d))


@q("channel_rollup", "SELECT o_custkey, COUNT(*) AS videos, MAX_BY(o_orderpriority, (o_orderdate, o_orderkey)) AS latest, MIN_BY(NULLIF(o_orderpriority, '5-LOW'), o_orderkey) FILTER (WHERE o_orderpriority <> '5-LOW') AS first FROM orders GROUP BY 1")
def channel_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The latest value, and the first that is not blank."""
    known = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(count().alias("videos"), F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("latest"), F.min_by(known, F.when(known.isNotNull(), F.col("o_orderkey"))).alias("first"))


@q("video_rollup", f"SELECT video, COUNT(*) AS n, COUNT(DISTINCT song) AS songs FROM {OCC} GROUP BY video")
def video_rollup(spark: SparkSession, d: str) -> DataFrame:
    """E07."""
    return occurrences(spark, d).groupBy("video").agg(count().alias("n"), F.countDistinct("song").alias("songs"))


@q("count_distinct_fallback", f"SELECT artist, COUNT(DISTINCT COALESCE(NULLIF(CASE WHEN video % 5 = 0 THEN '' ELSE video::VARCHAR END, ''), 'position:' || position)) AS videos FROM {OCC} GROUP BY artist")
def count_distinct_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a video count by position."""
    video = F.when(F.col("video") % 5 == 0, F.lit("")).otherwise(F.col("video").cast("string"))
    key = F.coalesce(F.nullif(video, F.lit("")), F.concat(F.lit("position:"), F.col("position")))
    return occurrences(spark, d).groupBy("artist").agg(F.countDistinct(key).alias("videos"))


def _search_totals(o: DataFrame) -> DataFrame:
    g = o.groupBy("song").agg(count().alias("n"), F.countDistinct("video").alias("videos"))
    return g.agg(count().alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("occurrences"), F.coalesce(F.sum("videos"), F.lit(0)).alias("videos"))


@q("search_totals", f"SELECT COUNT(*) AS rows, COALESCE(SUM(n), 0)::BIGINT AS occurrences, COALESCE(SUM(videos), 0)::BIGINT AS videos FROM (SELECT song, COUNT(*) AS n, COUNT(DISTINCT video) AS videos FROM {OCC} GROUP BY song)")
def search_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals over all hits, before the page is cut."""
    return _search_totals(occurrences(spark, d))


@q("histogram_by_group", "SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS histogram FROM (SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def histogram_by_group(spark: SparkSession, d: str) -> DataFrame:
    """Name to count maps, shown in name order."""
    n = table(spark, d, "events").groupBy("user_id", "event_type").agg(count().alias("n"))
    maps = n.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    return maps.select("user_id", F.concat_ws(",", F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"]))).alias("histogram"))


MODE_SQL = f"SELECT song, artist, n FROM (SELECT song, artist, COUNT(*) AS n, ROW_NUMBER() OVER (PARTITION BY song ORDER BY COUNT(*) DESC, artist) AS rn FROM {OCC} GROUP BY song, artist) WHERE rn = 1"


@q("mode_with_tiebreak", MODE_SQL)
def mode_with_tiebreak(spark: SparkSession, d: str) -> DataFrame:
    """E11."""
    return core.mode(occurrences(spark, d), ["song"], "artist").select("song", "artist", "n")


@q("majority_lookup", f"WITH a AS ({MODE_SQL}) SELECT p_name, artist, n FROM (SELECT p_name, artist, SUM(n)::BIGINT AS n, ROW_NUMBER() OVER (PARTITION BY p_name ORDER BY SUM(n) DESC, artist) AS rn FROM a JOIN part ON song = p_partkey GROUP BY p_name, artist) WHERE rn = 1")
def majority_lookup(spark: SparkSession, d: str) -> DataFrame:
    """The dominant artist per song, then per title."""
    a = core.mode(occurrences(spark, d), ["song"], "artist").join(table(spark, d, "part"), F.col("song") == F.col("p_partkey"))
    return core.best_per_key(a.groupBy("p_name", "artist").agg(F.sum("n").alias("n")), ["p_name"], F.desc("n"), F.asc("artist"))


def _singleton_stats(o: DataFrame) -> DataFrame:
    g = o.groupBy("song").agg(count().alias("rows"), F.countDistinct("artist").alias("sources"))
    return g.withColumn("singleton", F.col("sources") == 1)


@q("singleton_stats", f"SELECT song, COUNT(*) AS rows, COUNT(DISTINCT artist) AS sources, COUNT(DISTINCT artist) = 1 AS singleton FROM {OCC} GROUP BY song")
def singleton_stats(spark: SparkSession, d: str) -> DataFrame:
    """E13."""
    return _singleton_stats(occurrences(spark, d))


@q("global_counts", f"SELECT COUNT(DISTINCT video) AS videos, COUNT(DISTINCT song) AS songs, COUNT(*) AS occurrences, COUNT(*) FILTER (WHERE unknown) AS unknown FROM {OCC}")
def global_counts(spark: SparkSession, d: str) -> DataFrame:
    """E14."""
    return occurrences(spark, d).agg(F.countDistinct("video").alias("videos"), F.countDistinct("song").alias("songs"), count().alias("occurrences"), F.count_if("unknown").alias("unknown"))


@q("reused_source_detect", "SELECT h, COUNT(*) AS n, COUNT(DISTINCT source) AS channels FROM (SELECT sha256(text) AS h, source FROM documents WHERE length(text) >= 35) GROUP BY h HAVING COUNT(*) >= 2 AND COUNT(DISTINCT source) >= 2")
def reused_source_detect(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions that several channels share."""
    rows = table(spark, d, "documents").where(F.length("text") >= 35).select(F.sha2("text", 256).alias("h"), "source")
    return rows.groupBy("h").agg(count().alias("n"), F.countDistinct("source").alias("channels")).where("n >= 2 AND channels >= 2")


LINES_SQL = "SELECT doc_id, source, UNNEST(string_split(text, chr(10))) AS line FROM documents"


@q("mixed_structure_detect", f"SELECT doc_id, COUNT(*) AS total, COUNT(*) FILTER (WHERE contains(line, '!!')) AS loud, COUNT(*) FILTER (WHERE NOT contains(line, '!!')) AS plain FROM ({LINES_SQL}) GROUP BY doc_id HAVING COUNT(*) >= 4 AND COUNT(*) FILTER (WHERE contains(line, '!!')) >= 2 AND COUNT(*) FILTER (WHERE NOT contains(line, '!!')) >= 2")
def mixed_structure_detect(spark: SparkSession, d: str) -> DataFrame:
    """Texts that mix two structures."""
    loud = F.col("line").contains("!!")
    g = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).groupBy("doc_id")
    return g.agg(count().alias("total"), F.count_if(loud).alias("loud"), F.count_if(~loud).alias("plain")).where("total >= 4 AND loud >= 2 AND plain >= 2")


@q("audit_grouping_sets", "SELECT event_type, day, COUNT(*) AS n, GROUPING(event_type)::BIGINT AS all_types, GROUPING(day)::BIGINT AS all_days FROM (SELECT event_type, strftime(ts, '%Y-%m-%d') AS day FROM events) GROUP BY GROUPING SETS ((event_type), (day), (event_type, day), ())")
def audit_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Counts by reason, by day, by both and in all."""
    e = table(spark, d, "events").select("event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"))
    t, y = F.col("event_type"), F.col("day")
    sets = e.groupingSets([[t], [y], [t, y], []], t, y)
    return sets.agg(count().alias("n"), F.grouping("event_type").cast("bigint").alias("all_types"), F.grouping("day").cast("bigint").alias("all_days"))


@q("source_ratios", f"SELECT artist, COUNT(*) AS n, ROUND(COUNT(*) FILTER (WHERE unknown) / NULLIF(COUNT(*), 0)::DOUBLE, 6) AS unknown_ratio, ROUND(COUNT(*) FILTER (WHERE niche) / NULLIF(COUNT(*) FILTER (WHERE NOT unknown), 0)::DOUBLE, 6) AS niche_ratio FROM {OCC} GROUP BY artist")
def source_ratios(spark: SparkSession, d: str) -> DataFrame:
    """E18."""
    unknown = F.count_if("unknown")
    return occurrences(spark, d).groupBy("artist").agg(count().alias("n"), F.round(F.try_divide(unknown, count()), 6).alias("unknown_ratio"), F.round(F.try_divide(F.count_if("niche"), F.count_if(~F.col("unknown"))), 6).alias("niche_ratio"))


def _bool_aggs(o: DataFrame) -> DataFrame:
    return o.groupBy("song").agg(F.bool_and("niche").alias("niche"), F.bool_or("unknown").alias("unknown"))


@q("bool_aggs", f"SELECT song, bool_and(niche) AS niche, bool_or(unknown) AS unknown FROM {OCC} GROUP BY song")
def bool_aggs(spark: SparkSession, d: str) -> DataFrame:
    """E19."""
    return _bool_aggs(occurrences(spark, d))


@q("nearest_rank_percentiles", "SELECT event_type, p::DOUBLE AS p, value FROM (SELECT event_type, value, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, COUNT(*) OVER (PARTITION BY event_type) AS n FROM events), (VALUES (0.5), (0.9)) v(p) WHERE rn = floor(n * p) + 1")
def nearest_rank_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """E20."""
    return core.nearest_rank(table(spark, d, "events"), ["event_type"], "value", "event_id", (0.5, 0.9))


@q("distribution_stats", "SELECT event_type, MIN(value) AS low, MAX(value) AS high, ROUND(AVG(value), 3) AS mean FROM events GROUP BY 1")
def distribution_stats(spark: SparkSession, d: str) -> DataFrame:
    """E20."""
    return table(spark, d, "events").groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 3).alias("mean"))


@q("count_of_counts", f"SELECT n, COUNT(*) AS songs FROM (SELECT song, COUNT(*) AS n FROM {OCC} GROUP BY song) GROUP BY n")
def count_of_counts(spark: SparkSession, d: str) -> DataFrame:
    """E21."""
    return occurrences(spark, d).groupBy("song").agg(count().alias("n")).groupBy("n").agg(count().alias("songs"))


@q("partial_final_equiv", f"SELECT artist, COUNT(*) AS n, SUM(seconds)::BIGINT AS seconds FROM {OCC} GROUP BY artist")
def partial_final_equiv(spark: SparkSession, d: str) -> DataFrame:
    """Sums of parts are sums of the whole."""
    parts = occurrences(spark, d).groupBy("artist", (F.col("video") % 8).alias("part")).agg(count().alias("n"), F.sum("seconds").alias("seconds"))
    return parts.groupBy("artist").agg(F.sum("n").alias("n"), F.sum("seconds").alias("seconds"))


@q("weighted_avg", "SELECT l_suppkey, ROUND(SUM(l_discount * l_quantity) / SUM(l_quantity), 6) AS discount FROM lineitem GROUP BY 1")
def weighted_avg(spark: SparkSession, d: str) -> DataFrame:
    """E23."""
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_discount") * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("discount"))


@q("count_by", "SELECT o_orderstatus AS reason, COUNT(*) AS n, SUM(o_custkey)::BIGINT AS total FROM orders GROUP BY 1")
def count_by(spark: SparkSession, d: str) -> DataFrame:
    """E24."""
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("reason")).agg(count().alias("n"), F.sum("o_custkey").alias("total"))


@q("inventory_stats", "SELECT p_brand, p_type, COUNT(*) AS n, COUNT(DISTINCT p_name) AS titles, array_to_string(list_sort(list(DISTINCT p_name))[1:3], ',') AS samples FROM part GROUP BY ALL")
def inventory_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics with capped samples."""
    keys = ["p_brand", "p_type"]
    p = table(spark, d, "part")
    g = p.groupBy(*keys).agg(count().alias("n"), F.countDistinct("p_name").alias("titles"))
    return g.join(core.first_values(p, keys, "p_name", 3), keys).select(*keys, "n", "titles", F.concat_ws(",", "values").alias("samples"))


RISK_SQL = "LEAST(40, 10 * len(regexp_extract_all(text, '!!'))) + LEAST(30, 5 * len(regexp_extract_all(text, '###'))) + CASE WHEN contains(text, 'password=') THEN 50 ELSE 0 END"


@q("risk_score", f"SELECT doc_id, score, CASE WHEN score >= 50 THEN 'high' WHEN score >= 20 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT doc_id, ({RISK_SQL})::BIGINT AS score FROM documents)")
def risk_score(spark: SparkSession, d: str) -> DataFrame:
    """Weighted reasons, each with a cap."""
    hits = lambda p: F.regexp_count("text", F.lit(p))
    score = F.least(F.lit(40), hits("!!") * 10) + F.least(F.lit(30), hits("###") * 5) + F.when(F.col("text").contains("password="), 50).otherwise(0)
    rows = table(spark, d, "documents").select("doc_id", score.cast("bigint").alias("score"))
    return rows.withColumn("risk", F.when(F.col("score") >= 50, "high").when(F.col("score") >= 20, "medium").otherwise("low"))


@q("series_counts", f"SELECT year(played) AS y, niche, unknown, position, COUNT(*) AS n FROM {OCC} GROUP BY ALL")
def series_counts(spark: SparkSession, d: str) -> DataFrame:
    """E27."""
    return occurrences(spark, d).groupBy(F.year("played").cast("bigint").alias("y"), "niche", "unknown", "position").agg(count().alias("n"))


@q("rollup_counts", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def rollup_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(count().alias("n"))


@q("cube_counts", "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(count().alias("n"))


@q("ambiguous_keys", "SELECT p_name, COUNT(DISTINCT p_type) AS types FROM part GROUP BY 1 HAVING COUNT(DISTINCT p_type) <> 1")
def ambiguous_keys(spark: SparkSession, d: str) -> DataFrame:
    """E28."""
    return table(spark, d, "part").groupBy("p_name").agg(F.countDistinct("p_type").alias("types")).where("types <> 1")


@q("owner_election", f"SELECT song, MIN_BY(artist, (position, artist)) AS owner, MIN(position) AS priority, COUNT(DISTINCT artist) AS owners FROM {OCC} GROUP BY song")
def owner_election(spark: SparkSession, d: str) -> DataFrame:
    """The lowest priority, then the lowest key."""
    return occurrences(spark, d).groupBy("song").agg(F.min_by("artist", F.struct("position", "artist")).alias("owner"), F.min("position").alias("priority"), F.countDistinct("artist").alias("owners"))


@q("shared_hash_band", "SELECT h, channels FROM (SELECT sha256(text) AS h, COUNT(DISTINCT source) AS channels FROM documents GROUP BY 1) WHERE channels BETWEEN 2 AND 4 ORDER BY channels DESC, h LIMIT 80")
def shared_hash_band(spark: SparkSession, d: str) -> DataFrame:
    """A report of the first 80."""
    g = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.countDistinct("source").alias("channels"))
    return g.where("channels BETWEEN 2 AND 4").orderBy(F.desc("channels"), "h").limit(80)


@q("daily_profile", "SELECT COALESCE(a.day, b.day) AS day, COALESCE(a.n, 0) AS n, COALESCE(b.quarantined, 0) AS quarantined FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, COUNT(*) AS n FROM events WHERE event_type <> 'error' AND day(ts) % 5 <> 0 GROUP BY 1) a FULL JOIN (SELECT strftime(ts, '%Y-%m-%d') AS day, COUNT(*) AS quarantined FROM events WHERE event_type = 'error' GROUP BY 1) b ON a.day = b.day")
def daily_profile(spark: SparkSession, d: str) -> DataFrame:
    """Days with quarantined rows alone are shown, too."""
    e = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    a = e.where((F.col("event_type") != "error") & (F.dayofmonth("ts") % 5 != 0)).groupBy("day").agg(count().alias("n"))
    b = e.where("event_type = 'error'").groupBy("day").agg(count().alias("quarantined"))
    return a.join(b, "day", "full").select("day", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("quarantined", F.lit(0)).alias("quarantined"))
