"""Plans of windows, sorting, limits and pagination (sections F and G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from encore.functions import text as tx
from encore.operators import core
from encore.operators.cluster import greedy_clusters
from encore.plans.common import OCC, count, now, occurrences
from encore.plans.registry import Registry, table

reg = Registry()
q = reg.register


def songs(spark: SparkSession, d: str) -> DataFrame:
    return occurrences(spark, d).groupBy("song").agg(count().alias("n"))


SONGS = f"(SELECT song, COUNT(*) AS n FROM {OCC} GROUP BY song)"


@q("rank_row_number", f"SELECT song, n, ROW_NUMBER() OVER (ORDER BY n DESC, song)::BIGINT AS rank FROM {SONGS}")
def rank_row_number(spark: SparkSession, d: str) -> DataFrame:
    """F01."""
    return core.ordinal(songs(spark, d), [F.desc("n"), F.asc("song")])


@q("rank_competition", f"SELECT song, n, RANK() OVER (ORDER BY n DESC)::BIGINT AS rank FROM {SONGS}")
def rank_competition(spark: SparkSession, d: str) -> DataFrame:
    """equal counts share a rank; ranks come from the few distinct counts."""
    s = songs(spark, d)
    per = s.groupBy("n").agg(count().alias("c"))
    before = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = per.select("n", (F.coalesce(F.sum("c").over(before), F.lit(0)) + 1).alias("rank"))
    return s.join(ranks, "n").select("song", "n", "rank")


def _window_over_agg(o: DataFrame) -> DataFrame:
    g = o.groupBy("artist", "song").agg(F.min("position").alias("p"))
    return g.select("artist", "song", F.row_number().over(Window.partitionBy("artist").orderBy("p", "song")).cast("bigint").alias("rn"))


@q("window_over_agg", f"SELECT artist, song, ROW_NUMBER() OVER (PARTITION BY artist ORDER BY MIN(position), song)::BIGINT AS rn FROM {OCC} GROUP BY artist, song")
def window_over_agg(spark: SparkSession, d: str) -> DataFrame:
    """F03."""
    return _window_over_agg(occurrences(spark, d))


@q("latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    """One aggregate instead of a sort of each group."""
    best = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", -F.col("event_id")))
    return table(spark, d, "events").groupBy("user_id").agg(best.alias("b")).select("user_id", "b.event_id", "b.event_type")


@q("topk_distinct_preview", f"SELECT song, video, rn FROM (SELECT song, video, ROW_NUMBER() OVER (PARTITION BY song ORDER BY MAX(played) DESC, video)::BIGINT AS rn FROM {OCC} GROUP BY song, video) WHERE rn <= 3")
def topk_distinct_preview(spark: SparkSession, d: str) -> DataFrame:
    """the three newest distinct videos."""
    g = occurrences(spark, d).groupBy("song", "video").agg(F.max("played").alias("t"))
    return core.top_per_key(g, ["song"], 3, F.desc("t"), F.asc("video")).select("song", "video", "rn")


@q("lag_gap", "SELECT event_id, (epoch_us(ts) - epoch_us(LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) // 60000000 AS minutes FROM events WHERE event_type = 'purchase'")
def lag_gap(spark: SparkSession, d: str) -> DataFrame:
    """minutes since the success before."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, d, "events").where("event_type = 'purchase'").withColumn("us", us)
    return e.select("event_id", F.floor((F.col("us") - F.lag("us").over(Window.partitionBy("user_id").orderBy("us", "event_id"))) / 60_000_000).cast("bigint").alias("minutes"))


@q("lead_merge", "SELECT conv_id, turn, length(text || ' ' || COALESCE(nxt, ''))::BIGINT AS n FROM (SELECT conv_id, turn, text, LEAD(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE turn % 2 = 0")
def lead_merge(spark: SparkSession, d: str) -> DataFrame:
    """a line and the next are one."""
    c = table(spark, d, "conversations").withColumn("nxt", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return c.where("turn % 2 = 0").select("conv_id", "turn", F.length(F.concat("text", F.lit(" "), F.coalesce("nxt", F.lit("")))).cast("bigint").alias("n"))


SESSION_SQL = "SELECT user_id, session, COUNT(*) AS n, MIN(event_id) AS first FROM (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) <= 1800000000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL"


@q("gap_sessionize", SESSION_SQL)
def gap_sessionize(spark: SparkSession, d: str) -> DataFrame:
    """sessions end at gaps of more than thirty minutes."""
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    e = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.withColumn("new", F.when(F.col("us") - F.lag("us").over(order) <= 1_800_000_000, 0).otherwise(1))
    e = e.withColumn("session", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return e.groupBy("user_id", "session").agg(count().alias("n"), F.min("event_id").alias("first"))


def clusters_sql(width: int) -> str:
    return f"""WITH RECURSIVE r AS (SELECT video, song, seconds, ROW_NUMBER() OVER (PARTITION BY video, song ORDER BY seconds) AS rn FROM {OCC}),
        c AS (SELECT video, song, seconds, rn, seconds AS leader FROM r WHERE rn = 1
          UNION ALL SELECT r.video, r.song, r.seconds, r.rn, CASE WHEN r.seconds - c.leader > {width} THEN r.seconds ELSE c.leader END FROM c JOIN r ON r.video = c.video AND r.song = c.song AND r.rn = c.rn + 1)
        SELECT video, song, seconds, leader FROM c"""


@q("greedy_cluster", clusters_sql(30))
def greedy_cluster(spark: SparkSession, d: str) -> DataFrame:
    """F08, exact: each row joins the first cluster whose leader is within 30 seconds."""
    o = occurrences(spark, d).select("video", "song", "seconds", "position")
    return greedy_clusters(o, ["video", "song"], "seconds", 30)


@q("bucket_quota", "SELECT event_id, day FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY day DESC, event_id) AS all_rn FROM (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, ROW_NUMBER() OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn <= 5) WHERE all_rn <= 60")
def bucket_quota(spark: SparkSession, d: str) -> DataFrame:
    """five of each day, sixty in all."""
    e = table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return core.top_per_key(e, ["day"], 5, F.desc("ts"), F.asc("event_id")).orderBy(F.desc("day"), "event_id").limit(60).select("event_id", "day")


@q(
    "reserve_selection",
    "WITH c AS (SELECT event_id, CASE WHEN event_id % 1000 = 7 THEN 0 WHEN ts >= TIMESTAMP '2024-01-30' THEN 1 ELSE 2 END AS pool, ts FROM events), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY pool ORDER BY CASE WHEN pool = 2 THEN epoch_us(ts) ELSE -epoch_us(ts) END, event_id) AS rn FROM c) SELECT event_id, pool::BIGINT AS pool FROM r WHERE pool = 0 OR (pool = 1 AND rn <= 50) OR (pool = 2 AND rn <= 10)",
)
def reserve_selection(spark: SparkSession, d: str) -> DataFrame:
    """explicit ids, then recent ones, and a sixth of the quota for the backlog."""
    limit = 60
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    pool = F.when(F.col("event_id") % 1000 == 7, 0).when(F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz"), 1).otherwise(2)
    c = table(spark, d, "events").select("event_id", pool.cast("bigint").alias("pool"), us.alias("us"))
    recent = c.where("pool = 1").orderBy(F.desc("us"), "event_id").limit(limit - limit // 6)
    backlog = c.where("pool = 2").orderBy("us", "event_id").limit(limit // 6)
    return c.where("pool = 0").unionByName(recent).unionByName(backlog).select("event_id", "pool")


@q("round_robin", "SELECT event_id, event_type FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) ORDER BY rn, event_type LIMIT 40")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    """one of each pool in turn."""
    return core.top_per_key(table(spark, d, "events"), ["event_type"], 40, F.asc("event_id")).orderBy("rn", "event_type").limit(40).select("event_id", "event_type")


@q("first_last_seen", "SELECT user_id, epoch_us(MIN(ts)) AS first_seen, epoch_us(MAX(ts)) AS last_seen FROM events GROUP BY 1")
def first_last_seen(spark: SparkSession, d: str) -> DataFrame:
    """F12."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").groupBy("user_id").agg(F.min(us).alias("first_seen"), F.max(us).alias("last_seen"))


@q("running_total", f"SELECT artist, month, n, SUM(n) OVER (PARTITION BY artist ORDER BY month ROWS UNBOUNDED PRECEDING)::BIGINT AS total, NTILE(4) OVER (PARTITION BY artist ORDER BY month)::BIGINT AS quarter FROM (SELECT artist, strftime(played, '%Y-%m') AS month, COUNT(*) AS n FROM {OCC} GROUP BY ALL)")
def running_total(spark: SparkSession, d: str) -> DataFrame:
    """frames and tiles."""
    g = occurrences(spark, d).groupBy("artist", F.date_format("played", "yyyy-MM").alias("month")).agg(count().alias("n"))
    order = Window.partitionBy("artist").orderBy("month")
    return g.withColumn("total", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("quarter", F.ntile(4).over(order).cast("bigint"))


@q("page_offset", f"SELECT song, n FROM {SONGS} ORDER BY n DESC, song LIMIT 50 OFFSET 100")
def page_offset(spark: SparkSession, d: str) -> DataFrame:
    """G01."""
    return songs(spark, d).orderBy(F.desc("n"), "song").offset(100).limit(50)


@q("clamped_page", f"WITH r AS (SELECT song, n, ROW_NUMBER() OVER (ORDER BY n DESC, song)::BIGINT AS rank, COUNT(*) OVER () AS total FROM {SONGS}) SELECT song, rank FROM r WHERE rank > (GREATEST(1, CEIL(total / 50.0)) - 1) * 50")
def clamped_page(spark: SparkSession, d: str) -> DataFrame:
    """A page past the end is the last, however many there are."""
    return page(songs(spark, d), 2**62, 50).select("song", "rank")


def page(ranked: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number``, or the nearest there is. Its rows are cut by top-k from the nearer end."""
    total = ranked.count()
    number = min(max(1, number), max(1, -(-total // size)))
    first, last = (number - 1) * size, min(number * size, total)
    down, up = [F.desc("n"), F.asc_nulls_last("song")], [F.asc("n"), F.desc_nulls_first("song")]
    at = lambda order: F.row_number().over(Window.orderBy(*order)).cast("bigint")
    if last <= total - first:
        rows = ranked.orderBy(*down).limit(last).withColumn("rank", at(down))
    else:
        rows = ranked.orderBy(*up).limit(total - first).withColumn("rank", F.lit(total + 1) - at(up))
    return rows.where(F.col("rank").between(first + 1, last))


def _group_paging(o: DataFrame) -> DataFrame:
    v = o.groupBy("video").agg(F.min("position").alias("p")).orderBy("p", "video").offset(20).limit(20).select("video")
    return o.join(v, "video", "left_semi").select("video", "song", "position")


@q("group_paging", f"WITH v AS (SELECT video FROM {OCC} GROUP BY video ORDER BY MIN(position), video LIMIT 20 OFFSET 20) SELECT video, song, position FROM {OCC} WHERE video IN (SELECT video FROM v)")
def group_paging(spark: SparkSession, d: str) -> DataFrame:
    """Pages of videos, each with all its rows."""
    return _group_paging(occurrences(spark, d))


@q("page_slice", f"SELECT song, rank FROM (SELECT song, ROW_NUMBER() OVER (ORDER BY n DESC, song)::BIGINT AS rank FROM {SONGS}) WHERE rank BETWEEN 151 AND 250")
def page_slice(spark: SparkSession, d: str) -> DataFrame:
    """A page over the border of two chunks of 200."""
    return songs(spark, d).orderBy(F.desc("n"), "song").limit(250).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "song")).cast("bigint")).where("rank > 150").select("song", "rank")


@q("az_index", "SELECT p_partkey, ROW_NUMBER() OVER (ORDER BY regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g'), p_partkey)::BIGINT AS ordinal FROM part")
def az_index(spark: SparkSession, d: str) -> DataFrame:
    """A to Z, by letters and digits alone."""
    keyed = table(spark, d, "part").select("p_partkey", tx.letters_digits(F.col("p_name")).alias("key"))
    return core.ordinal(keyed, [F.asc("key"), F.asc("p_partkey")], "ordinal").drop("key")


@q("az_buckets", "SELECT CASE WHEN regexp_matches(upper(text), '^[A-Z]') THEN upper(left(text, 1)) WHEN regexp_matches(text, '^[0-9]') THEN '0-9' ELSE 'other' END AS bucket, COUNT(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def az_buckets(spark: SparkSession, d: str) -> DataFrame:
    """G06."""
    first = F.upper(F.substring("text", 1, 1))
    bucket = F.when(first.rlike("^[A-Z]$"), first).when(first.rlike("^[0-9]$"), "0-9").when(first.rlike(r"^[\x{3040}-\x{30FF}]$"), "kana").when(first.rlike(r"^[\x{4E00}-\x{9FFF}]$"), "han").otherwise("other")
    return table(spark, d, "documents").where("text IS NOT NULL").groupBy(bucket.alias("bucket")).agg(count().alias("n"))


@q("relevance_sort", f"SELECT p_partkey, tier, ROW_NUMBER() OVER (ORDER BY tier, n DESC, p_partkey)::BIGINT AS ordinal FROM (SELECT p_partkey, CASE WHEN p_name = 'small ring' THEN 0 WHEN starts_with(p_name, 'small') THEN 1 ELSE 2 END::BIGINT AS tier, COALESCE(n, 0) AS n FROM part LEFT JOIN {SONGS} ON song = p_partkey WHERE contains(p_name, 'small') OR contains(p_name, 'ring'))")
def relevance_sort(spark: SparkSession, d: str) -> DataFrame:
    """Tiers, then popularity."""
    name = F.col("p_name")
    p = table(spark, d, "part").where(name.contains("small") | name.contains("ring")).withColumn("tier", F.when(name == "small ring", 0).when(name.startswith("small"), 1).otherwise(2).cast("bigint"))
    j = p.join(songs(spark, d), F.col("song") == F.col("p_partkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return core.ordinal(j.select("p_partkey", "tier", "n"), [F.asc("tier"), F.desc("n"), F.asc("p_partkey")], "ordinal").drop("n")


def _case_ordering(o: DataFrame) -> DataFrame:
    g = o.groupBy("song").agg(count().alias("n"), F.count_if(F.col("position") == 1).alias("matched")).withColumn("kind", F.col("song") % 2)
    order = [F.col("kind"), F.when(F.col("kind") == 0, -F.col("n")).otherwise(0), F.when(F.col("kind") == 1, -F.col("matched")).otherwise(0), F.col("song")]
    return core.ordinal(g, order, "ordinal").select("song", "kind", "ordinal")


@q("case_ordering", f"SELECT song, kind, ROW_NUMBER() OVER (ORDER BY kind, CASE WHEN kind = 0 THEN -n ELSE 0 END, CASE WHEN kind = 1 THEN -matched ELSE 0 END, song)::BIGINT AS ordinal FROM (SELECT song, COUNT(*) AS n, COUNT(*) FILTER (WHERE position = 1) AS matched, (song % 2)::BIGINT AS kind FROM {OCC} GROUP BY song)")
def case_ordering(spark: SparkSession, d: str) -> DataFrame:
    """Entities by all occurrences, sources by matched ones."""
    return _case_ordering(occurrences(spark, d))


@q("topk", f"SELECT song, n FROM {SONGS} ORDER BY n DESC, song LIMIT 12")
def topk(spark: SparkSession, d: str) -> DataFrame:
    """Each task keeps twelve rows."""
    return songs(spark, d).orderBy(F.desc("n"), "song").limit(12)


@q("exists_probe", f"SELECT COUNT(*) > 0 AS found FROM (SELECT 1 FROM {OCC} WHERE unknown AND niche LIMIT 1)")
def exists_probe(spark: SparkSession, d: str) -> DataFrame:
    """G10."""
    return occurrences(spark, d).where("unknown AND niche").limit(1).agg((count() > 0).alias("found"))


@q("fallback_cascade", "WITH t AS (SELECT 0 AS priority, p_partkey AS id, 'song' AS via FROM part WHERE p_name = 'no such song' UNION ALL SELECT 1, s_suppkey, 'source' FROM supplier WHERE s_name LIKE '%999999999' UNION ALL SELECT 2, c_custkey, 'channel' FROM customer WHERE c_name LIKE '%00007' UNION ALL SELECT 3, o_orderkey, 'video' FROM orders WHERE o_custkey = 7) SELECT id, via FROM t WHERE priority = (SELECT MIN(priority) FROM t)")
def fallback_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Songs, then songs of matched sources, of channels, of videos: the first of the four that has hits."""
    tries = [table(spark, d, "part").where("p_name = 'no such song'").select(F.col("p_partkey").alias("id"), F.lit("song").alias("via")), table(spark, d, "supplier").where(F.col("s_name").endswith("999999999")).select(F.col("s_suppkey").alias("id"), F.lit("source").alias("via")), table(spark, d, "customer").where(F.col("c_name").endswith("00007")).select(F.col("c_custkey").alias("id"), F.lit("channel").alias("via")), table(spark, d, "orders").where("o_custkey = 7").select(F.col("o_orderkey").alias("id"), F.lit("video").alias("via"))]
    every = tries[0].withColumn("priority", F.lit(0))
    for i, t in enumerate(tries[1:], 1):
        every = every.unionByName(t.withColumn("priority", F.lit(i)))
    return every.join(every.agg(F.min("priority").alias("priority")), "priority").select("id", "via")


@q("group_newest_first", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS videos FROM (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate END AS o_orderdate FROM orders) GROUP BY 1")
def group_newest_first(spark: SparkSession, d: str) -> DataFrame:
    """Newest first, without a date last."""
    date = F.when(F.col("o_orderkey") % 9 != 0, F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    row = F.struct(F.coalesce(-date, F.lit(2**62)).alias("d"), F.col("o_orderkey").alias("k"))
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(row)).alias("v")).select("o_custkey", F.concat_ws(",", F.transform("v", lambda x: x["k"].cast("string"))).alias("videos"))


@q("freshness", "SELECT MAX(event_id) AS last, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(MAX(ts))) // 3600000000 AS hours, (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(MAX(ts))) // 3600000000 > 36 AS stale FROM events")
def freshness(spark: SparkSession, d: str) -> DataFrame:
    """The age of the latest row against a threshold."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    hours = F.floor((us(now()) - F.max(us(F.col("ts")))) / 3_600_000_000).cast("bigint")
    return table(spark, d, "events").agg(F.max("event_id").alias("last"), hours.alias("hours")).withColumn("stale", F.col("hours") > 36)
