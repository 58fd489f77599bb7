"""Plans of incremental operators, services, overlays and batch jobs (sections J to M)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.functions import parsing
from encore.functions import text as tx
from encore.operators import core
from encore.operators.rankings import rankings, search_rankings
from encore.plans.common import OCC, SEARCHABLE, count, now, occurrences, searchable
from encore.plans.registry import Registry, table
from encore.session import new_folder
from encore.streaming import jobs

reg = Registry()
q = reg.register
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def micros(c: F.Column) -> F.Column:
    return F.unix_micros(c.cast("timestamp"))


@q("stream_append", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, COUNT(*) AS n FROM events GROUP BY ALL")
def stream_append(spark: SparkSession, d: str) -> DataFrame:
    """Bounded micro-batches over the files of a feed, counted by day and kind."""
    return jobs.daily_counts(spark, d, "events")


@q("stream_dedupe", "SELECT event_id, event_type, epoch_us(ts) AS us FROM events")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Ids that earlier batches had are dropped within the watermark; the feed sends a tenth of them twice."""
    return jobs.deduplicated(spark, d, "events")


@q("dedupe_across_batches", "SELECT event_id % 4 AS batch, COUNT(*) AS fresh FROM (SELECT user_id, MIN(event_id % 4) AS event_id FROM events GROUP BY user_id) GROUP BY 1")
def dedupe_across_batches(spark: SparkSession, d: str) -> DataFrame:
    """A key counts for the first batch that has it."""
    return table(spark, d, "events").groupBy("user_id").agg(F.min(F.col("event_id") % 4).alias("batch")).groupBy("batch").agg(count().alias("fresh"))


@q("retry_state", "SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'error' AND (ok IS NULL OR ts > ok)) AS attempts FROM (SELECT *, MAX(CASE WHEN event_type = 'purchase' THEN ts END) OVER (PARTITION BY user_id) AS ok FROM events) GROUP BY 1")
def retry_state(spark: SparkSession, d: str) -> DataFrame:
    """Failures since the last success, which clears the state."""
    e = table(spark, d, "events").select("user_id", "event_type", "ts")
    ok = e.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("ok"))
    j = e.join(ok, "user_id", "left")
    return j.groupBy("user_id").agg(F.count_if((F.col("event_type") == "error") & (F.col("ok").isNull() | (F.col("ts") > F.col("ok")))).alias("attempts"))


@q("carry_forward", "SELECT user_id, event_id FROM (SELECT user_id, MAX_BY(event_id, (ts, event_id)) AS event_id, MAX(ts) AS ts FROM events WHERE event_type = 'signup' GROUP BY 1) WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 36 HOUR")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """An earlier output is reused for 36 hours."""
    last = table(spark, d, "events").where("event_type = 'signup'").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))
    return last.where(F.col("ts") >= now() - F.expr("INTERVAL 36 HOURS")).select("user_id", "event_id")


@q("ttl_cache", "SELECT event_id FROM events WHERE (event_type = 'error' AND ts >= TIMESTAMP '2024-01-30' - INTERVAL 6 HOUR AND ts <= TIMESTAMP '2024-01-30') OR (event_type = 'view' AND ts >= TIMESTAMP '2024-01-30' - INTERVAL 1 DAY AND ts <= TIMESTAMP '2024-01-30' AND user_id % 2 = 0)")
def ttl_cache(spark: SparkSession, d: str) -> DataFrame:
    """Negative entries live six hours, others a day."""
    at = F.lit("2024-01-30").cast("timestamp_ntz")
    age = lambda s: F.col("ts").between(at - F.expr(s), at)
    return table(spark, d, "events").where(((F.col("event_type") == "error") & age("INTERVAL 6 HOURS")) | ((F.col("event_type") == "view") & (F.col("user_id") % 2 == 0) & age("INTERVAL 1 DAY"))).select("event_id")


@q("tumbling_day", "SELECT strftime(ts, '%Y-%m-%d') AS day, COUNT(*) AS n, ROUND(SUM(value), 2) AS value FROM events GROUP BY 1")
def tumbling_day(spark: SparkSession, d: str) -> DataFrame:
    """J06."""
    w = F.window("ts", "1 day")
    return table(spark, d, "events").groupBy(w.alias("w")).agg(count().alias("n"), F.round(F.sum("value"), 2).alias("value")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n", "value")


@q("sliding_7d", "SELECT strftime(s, '%Y-%m-%d') AS start, COUNT(*) AS n FROM (SELECT UNNEST([date_trunc('day', ts) - to_days(i::INT) FOR i IN range(7)]) AS s FROM events) GROUP BY 1")
def sliding_7d(spark: SparkSession, d: str) -> DataFrame:
    """Windows of seven days, one a day, from daily counts."""
    daily = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(count().alias("n"))
    return daily.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.date_sub("day", i))).alias("s"), "n").groupBy(F.col("s").cast("string").alias("start")).agg(F.sum("n").alias("n"))


@q("session_30m", "SELECT user_id, COUNT(*) AS sessions FROM (SELECT *, epoch_us(ts) - epoch_us(LAG(ts) OVER (PARTITION BY user_id ORDER BY ts)) AS gap FROM events) WHERE gap IS NULL OR gap >= 1800000000 GROUP BY 1")
def session_30m(spark: SparkSession, d: str) -> DataFrame:
    """J08."""
    s = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(count().alias("n"))
    return s.groupBy("user_id").agg(count().alias("sessions"))


@q("late_move", "SELECT strftime(CASE WHEN event_id % 20 = 0 THEN ts - INTERVAL 1 DAY ELSE ts END, '%Y-%m-%d') AS day, COUNT(*) AS n FROM events GROUP BY 1")
def late_move(spark: SparkSession, d: str) -> DataFrame:
    """A corrected row leaves its old day and joins the right one."""
    e = table(spark, d, "events").select("event_id", "ts")
    fixed = e.where("event_id % 20 = 0").select("event_id", (F.col("ts") - F.expr("INTERVAL 1 DAY")).cast("timestamp_ntz").alias("ts"))
    return core.upsert(e, fixed, ["event_id"]).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(count().alias("n"))


@q("date_gaps", "SELECT strftime(d, '%Y-%m-%d') AS day FROM (SELECT UNNEST(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS d) WHERE strftime(d, '%Y-%m-%d') NOT IN (SELECT strftime(ts, '%Y-%m-%d') FROM events)")
def date_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Days without data."""
    days = spark.range(1).select(F.explode(F.expr("sequence(date'2024-01-01', date'2024-02-05')")).alias("d")).select(F.col("d").cast("string").alias("day"))
    return days.join(table(spark, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day")).distinct(), "day", "left_anti")


@q("incremental_equals_full", f"SELECT song, COUNT(*) AS n, COUNT(DISTINCT video) AS videos FROM {OCC} GROUP BY song")
def incremental_equals_full(spark: SparkSession, d: str) -> DataFrame:
    """Only songs of changed videos are computed again; the result is that of all."""
    o = occurrences(spark, d)
    agg = lambda x: x.groupBy("song").agg(count().alias("n"), F.countDistinct("video").alias("videos"))
    before = o.where("video % 100 <> 0")
    touched = o.where("video % 100 = 0").select("song").distinct()
    return agg(before).join(touched, "song", "left_anti").unionByName(agg(o.join(touched, "song", "left_semi")))


@q("resumable_partitions", "SELECT o_orderkey % 16 AS part, COUNT(*) AS n, SUM(o_orderkey * (o_orderkey % 16 + 1))::BIGINT AS digest, CASE WHEN o_orderkey % 16 < 5 THEN 1 ELSE 2 END::BIGINT AS run FROM orders GROUP BY ALL")
def resumable_partitions(spark: SparkSession, d: str) -> DataFrame:
    """Work by partitions; those that the checkpoint has are not done again.

    The first run ends after five partitions; the second finds them on record and does the others.
    """
    rows = table(spark, d, "orders").withColumn("part", F.col("o_orderkey") % 16)
    folder = new_folder(spark)

    def work(run: int, todo: DataFrame) -> None:
        done = todo.groupBy("part").agg(count().alias("n"), F.sum(F.col("o_orderkey") * (F.col("part") + 1)).alias("digest"), F.lit(run).cast("bigint").alias("run"))
        done.write.mode("append").parquet(folder)

    work(1, rows.where("part < 5"))
    work(2, rows.join(spark.read.parquet(folder).select("part"), "part", "left_anti"))
    return spark.read.parquet(folder)


@q("reject_side_output", f"SELECT reason, COUNT(*) AS n FROM (SELECT CASE WHEN unknown THEN 'unknown' WHEN niche THEN 'niche' END AS reason FROM {OCC}) WHERE reason IS NOT NULL GROUP BY 1")
def reject_side_output(spark: SparkSession, d: str) -> DataFrame:
    """Rejected rows with their reason."""
    r = occurrences(spark, d).withColumn("reason", F.when(F.col("unknown"), "unknown").when(F.col("niche"), "niche"))
    return r.where("reason IS NOT NULL").groupBy("reason").agg(count().alias("n"))


def timeline_texts(spark: SparkSession, d: str) -> DataFrame:
    """A timestamp list per order, from its occurrences."""
    lines = occurrences(spark, d).join(table(spark, d, "part"), F.col("song") == F.col("p_partkey"))
    line = F.concat(tx.seconds_hms(F.col("seconds") * 60 + F.col("position")), F.lit(" "), "p_name", F.lit(" / "), "p_brand")
    return lines.groupBy("video").agg(F.concat_ws("\n", F.array_sort(F.collect_set(line))).alias("text"))


def timeline_rows(texts: DataFrame) -> DataFrame:
    parsed = texts.select("video", F.explode(parsing.parsed_timeline("text")).alias("r"))
    return parsed.select("video", "r.seconds", "r.title", "r.artist")


def rederived(texts: DataFrame) -> DataFrame:
    first = texts.select("video", F.explode(parsing.parsed_timeline("text")).alias("a"))
    again = first.select("a", F.explode(parsing.parsed_timeline("a.raw")).alias("b"))
    return again.agg(count().alias("rows"), F.count_if((F.col("a.title") != F.col("b.title")) | (F.col("a.seconds") != F.col("b.seconds")) | (F.col("a.artist") != F.col("b.artist"))).alias("changed"))


@q("parse_timeline", f"SELECT DISTINCT video, seconds * 60 + position AS seconds, p_name AS title, p_brand AS artist FROM {OCC} JOIN part ON song = p_partkey")
def parse_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Texts to 0..n rows."""
    return timeline_rows(timeline_texts(spark, d))


@q("rederive_idempotent", f"SELECT COUNT(*) AS rows, 0::BIGINT AS changed FROM (SELECT DISTINCT video, seconds * 60 + position AS s, p_name, p_brand FROM {OCC} JOIN part ON song = p_partkey)")
def rederive_idempotent(spark: SparkSession, d: str) -> DataFrame:
    """Parsing the stored raw lines again changes nothing."""
    return rederived(timeline_texts(spark, d))


@q("rankings_default", f"SELECT song AS key, COUNT(*) AS n, COUNT(DISTINCT video) AS videos, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, COUNT(DISTINCT video) DESC, song)::BIGINT AS rank FROM {OCC} GROUP BY song ORDER BY rank LIMIT 200")
def rankings_default(spark: SparkSession, d: str) -> DataFrame:
    """K06."""
    return rankings(occurrences(spark, d), view="song", page_size=200)


@q("rankings_search", f"SELECT artist AS key, COUNT(*) AS n, COUNT(DISTINCT video) AS videos, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, COUNT(DISTINCT video) DESC, artist)::BIGINT AS rank FROM {OCC} WHERE niche AND NOT unknown AND artist % 3 = 1 GROUP BY artist HAVING COUNT(*) >= 5 ORDER BY rank LIMIT 50")
def rankings_search(spark: SparkSession, d: str) -> DataFrame:
    """With scope, minimum and page size of a search."""
    return rankings(occurrences(spark, d), view="artist", where=F.col("artist") % 3 == 1, niche_only=True, hide_unknown=True, min_count=5, page_size=50)


@q("rankings_query", f"SELECT artist AS key, COUNT(*) AS n, COUNT(DISTINCT video) AS videos, ROW_NUMBER() OVER (ORDER BY COUNT(DISTINCT video) DESC, COUNT(*) DESC, artist)::BIGINT AS rank FROM {SEARCHABLE} WHERE (contains(lower(title), 'small ring') OR contains(lower(title), 'blue') OR contains(lower(title), 'red') AND contains(lower(title), 'ring')) AND played <= TIMESTAMP '1998-12-01' AND played > TIMESTAMP '1998-12-01' - INTERVAL 7 DAY AND NOT unknown GROUP BY artist ORDER BY rank LIMIT 30")
def rankings_query(spark: SparkSession, d: str) -> DataFrame:
    """Range, search, scope, metric and a compact page at once."""
    return search_rankings(searchable(spark, d), view="artist", q="'small ring' or blue OR red + ring", scope="title", range_="7d", metric="videos", hide_unknown=True, page_size=30, compact=True).records


@q("rankings_fallback", f"SELECT song AS key, COUNT(*) AS n, COUNT(DISTINCT video) AS videos, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, COUNT(DISTINCT video) DESC, song)::BIGINT AS rank, ROUND(COUNT(*) / COUNT(DISTINCT video), 4) AS share FROM {SEARCHABLE} WHERE contains(lower(channel), '00007') GROUP BY song ORDER BY rank LIMIT 20")
def rankings_fallback(spark: SparkSession, d: str) -> DataFrame:
    """No song is named so; songs of the channels that are come instead."""
    return search_rankings(searchable(spark, d), q="00007", page_size=20).records


@q("rankings_totals", f"SELECT COUNT(*) AS total, SUM(n)::BIGINT AS occurrences, SUM(videos)::BIGINT AS videos FROM (SELECT artist, COUNT(*) AS n, COUNT(DISTINCT video) AS videos FROM {SEARCHABLE} WHERE contains(lower(title || ' ' || artist_name), 'ring') AND niche GROUP BY artist HAVING COUNT(*) >= 3)")
def rankings_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of all rows that the page is a page of."""
    return search_rankings(searchable(spark, d), view="artist", q="ring", niche_only=True, min_count=3).totals


@q("injected_callbacks", "SELECT lower(p_name) AS title, upper(p_brand) AS artist, COUNT(*) AS n FROM part GROUP BY ALL")
def injected_callbacks(spark: SparkSession, d: str) -> DataFrame:
    """Key functions come from the caller, as column builders or as functions of one value."""
    return aggregated_by(table(spark, d, "part"), {"title": ("p_name", F.lower), "artist": ("p_brand", str.upper)})


def aggregated_by(rows: DataFrame, keys: dict[str, tuple[str, Callable]]) -> DataFrame:
    """Counts by keys, each made of a column by a column builder or by a Python function, which then gets Arrow batches."""

    def column(name: str, make: Callable) -> F.Column:
        try:
            return make(F.col(name))
        except TypeError:
            return F.pandas_udf(lambda s: s.map(make, na_action="ignore"), "string")(F.col(name))

    return rows.groupBy(*(column(name, make).alias(k) for k, (name, make) in keys.items())).agg(count().alias("n"))


@q("accumulators", f"SELECT song, string_agg(artist || '=' || n, ',' ORDER BY artist) AS counts, MAX(bounded) AS bounded FROM (SELECT song, artist, COUNT(*) AS n FROM {OCC} GROUP BY ALL) JOIN (SELECT song, string_agg(artist::VARCHAR, ' ' ORDER BY artist) AS bounded FROM (SELECT song, artist, ROW_NUMBER() OVER (PARTITION BY song ORDER BY artist) AS rn, SUM(length(artist::VARCHAR) + 1) OVER (PARTITION BY song ORDER BY artist) AS chars FROM (SELECT DISTINCT song, artist FROM {OCC})) WHERE rn <= 8 AND chars <= 13 GROUP BY song) USING (song) GROUP BY song")
def accumulators(spark: SparkSession, d: str) -> DataFrame:
    """A map of counts, and a text of at most eight names and twelve signs, per key."""
    o = occurrences(spark, d)
    counts = o.groupBy("song", "artist").agg(count().alias("n"))
    maps = counts.groupBy("song").agg(F.sort_array(F.collect_list(F.struct("artist", "n"))).alias("m"))
    text = lambda state, x: F.when(F.length(state) + F.length(x) + 1 <= 12, F.concat_ws(" ", F.when(state != "", state), x)).otherwise(state)
    first = core.first_values(o, ["song"], "artist", 8).select("song", F.aggregate(F.col("values").cast("array<string>"), F.lit(""), text).alias("bounded"))
    return maps.join(first, "song").select("song", F.array_join(F.transform("m", lambda x: F.concat_ws("=", x["artist"], x["n"])), ",").alias("counts"), "bounded")


@q("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, COUNT(*) AS n FROM {t}" for t in TABLES))
def table_counts(spark: SparkSession, d: str) -> DataFrame:
    """K08."""
    out = None
    for t in TABLES:
        row = table(spark, d, t).agg(count().alias("n")).select(F.lit(t).alias("name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@q("conservation_check", f"SELECT COUNT(*) AS source, COUNT(*) FILTER (WHERE NOT unknown) AS published, COUNT(*) FILTER (WHERE unknown) AS quarantined, TRUE AS holds FROM {OCC}")
def conservation_check(spark: SparkSession, d: str) -> DataFrame:
    """What came in is published or quarantined."""
    a = occurrences(spark, d).agg(count().alias("source"), F.count_if(~F.col("unknown")).alias("published"), F.count_if("unknown").alias("quarantined"))
    return a.withColumn("holds", F.col("source") == F.col("published") + F.col("quarantined"))


@q("orphan_check", f"SELECT COUNT(*) FILTER (WHERE o_orderkey IS NULL) AS no_video, COUNT(*) FILTER (WHERE p_partkey IS NULL) AS no_song FROM {OCC} LEFT JOIN orders ON o_orderkey = video LEFT JOIN part ON p_partkey = song")
def orphan_check(spark: SparkSession, d: str) -> DataFrame:
    """K11."""
    o = occurrences(spark, d)
    videos = o.join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("video"), "left_anti").agg(count().alias("no_video"))
    songs = o.join(table(spark, d, "part"), F.col("p_partkey") == F.col("song"), "left_anti").agg(count().alias("no_song"))
    return videos.join(songs)


@q("required_field_check", "SELECT COUNT(*) AS bad FROM customer WHERE c_name IS NULL OR trim(c_name) = '' OR c_mktsegment IS NULL")
def required_field_check(spark: SparkSession, d: str) -> DataFrame:
    """K13."""
    return table(spark, d, "customer").where(F.col("c_name").isNull() | (F.trim("c_name") == "") | F.col("c_mktsegment").isNull()).agg(count().alias("bad"))


@q("identity_compare", "SELECT COUNT(DISTINCT p_name) AS legacy, COUNT(DISTINCT p_name || '::' || p_brand) AS current FROM part")
def identity_compare(spark: SparkSession, d: str) -> DataFrame:
    """K15."""
    return table(spark, d, "part").agg(F.countDistinct("p_name").alias("legacy"), F.countDistinct(F.concat_ws("::", "p_name", "p_brand")).alias("current"))


@q("snapshot_linkage", "SELECT MIN(c_custkey) AS c_custkey, MIN(s_suppkey) AS s_suppkey, CASE COUNT(*) WHEN 1 THEN 'linked' ELSE 'rejected' END AS state FROM customer JOIN supplier ON right(c_name, 9) = right(s_name, 9) GROUP BY right(c_name, 9)")
def snapshot_linkage(spark: SparkSession, d: str) -> DataFrame:
    """Raw rows and provider identities must match one to one; others are rejected."""
    raw = table(spark, d, "customer").select("c_custkey", F.right("c_name", F.lit(9)).alias("k"))
    provider = table(spark, d, "supplier").select("s_suppkey", F.right("s_name", F.lit(9)).alias("k"))
    j = raw.join(provider, "k")
    one = j.groupBy("k").agg(count().alias("n"), F.min("c_custkey").alias("c_custkey"), F.min("s_suppkey").alias("s_suppkey"))
    return one.select("c_custkey", "s_suppkey", F.when(F.col("n") == 1, "linked").otherwise("rejected").alias("state"))


@q("rule_binding_audit", "SELECT r.rule, COUNT(o_orderkey) AS matches, CASE COUNT(o_orderkey) WHEN 1 THEN 'bound' WHEN 0 THEN 'unmatched' ELSE 'ambiguous' END AS state FROM (VALUES (1, 7, 'X'), (2, 9, NULL), (3, 100000000, NULL), (4, 55, NULL)) r(rule, k, s) LEFT JOIN orders ON (o_orderkey = r.k OR (r.rule = 4 AND o_custkey = r.k)) AND (r.s IS NULL OR o_orderstatus = r.s) GROUP BY r.rule")
def rule_binding_audit(spark: SparkSession, d: str) -> DataFrame:
    """A rule must bind exactly one row."""
    rules = spark.createDataFrame([(1, 7, "X", False), (2, 9, None, False), (3, 10**8, None, False), (4, 55, None, True)], "rule int, k bigint, s string, by_channel boolean")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    status = F.col("s").isNull() | (F.col("o_orderstatus") == F.col("s"))
    by_key = o.join(F.broadcast(rules), (F.col("o_orderkey") == F.col("k")) & status)
    by_channel = o.join(F.broadcast(rules.where("by_channel")), (F.col("o_custkey") == F.col("k")) & status)
    hits = by_key.select("rule", "o_orderkey").unionByName(by_channel.select("rule", "o_orderkey")).distinct().groupBy("rule").agg(count().alias("n"))
    n = F.coalesce("n", F.lit(0))
    return rules.join(hits, "rule", "left").select("rule", n.alias("matches"), F.when(n == 1, "bound").when(n == 0, "unmatched").otherwise("ambiguous").alias("state"))


@q("sql_function", "SELECT p_partkey, lower(p_name) || '!' AS t FROM part")
def sql_function(spark: SparkSession, d: str) -> DataFrame:
    """A function in the store's SQL."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION display_title(x STRING) RETURNS STRING RETURN lower(x) || '!'")
    return table(spark, d, "part").select("p_partkey", F.call_function("display_title", F.col("p_name")).alias("t"))


@q("overlay_replace_recount", f"SELECT song, COUNT(*) AS n, COUNT(DISTINCT video) AS videos FROM (SELECT song, video FROM {OCC} WHERE video % 7 <> 0 UNION ALL SELECT song, video FROM {OCC} WHERE video % 7 = 0 AND position = 1) GROUP BY song")
def overlay_replace_recount(spark: SparkSession, d: str) -> DataFrame:
    """An overlaid video replaces all its rows; counts come after."""
    o = occurrences(spark, d).select("song", "video", "position")
    overlay = o.where("video % 7 = 0 AND position = 1")
    touched = table(spark, d, "orders").where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("video"))
    return o.join(touched, "video", "left_anti").unionByName(overlay).groupBy("song").agg(count().alias("n"), F.countDistinct("video").alias("videos"))


@q("unique_tombstone", f"SELECT COUNT(*) AS n FROM {OCC} WHERE NOT (video % 5 = 0 AND (video, song) IN (SELECT (video, song) FROM {OCC} GROUP BY video, song HAVING COUNT(*) = 1))")
def unique_tombstone(spark: SparkSession, d: str) -> DataFrame:
    """A tombstone that matches several rows deletes none."""
    o = occurrences(spark, d)
    stones = o.where("video % 5 = 0").groupBy("video", "song").agg(count().alias("c")).where("c = 1").select("video", "song")
    return o.join(stones, ["video", "song"], "left_anti").agg(count().alias("n"))


@q("signed_delta_agg", f"SELECT song, artist, SUM(s)::BIGINT AS n FROM (SELECT song, artist, 1 AS s FROM {OCC} UNION ALL SELECT song, artist, -1 FROM {OCC} WHERE unknown UNION ALL SELECT song, 0, 1 FROM {OCC} WHERE unknown) GROUP BY ALL HAVING SUM(s) > 0")
def signed_delta_agg(spark: SparkSession, d: str) -> DataFrame:
    """A replacement takes one from the old group and adds one to the new."""
    zero = F.lit(0).cast("bigint")
    row = lambda a, s: F.struct(a.alias("artist"), F.lit(s).alias("s"))
    deltas = F.when(F.col("unknown"), F.array(row(F.col("artist"), 1), row(F.col("artist"), -1), row(zero, 1))).otherwise(F.array(row(F.col("artist"), 1)))
    return occurrences(spark, d).select("song", F.explode(deltas).alias("x")).groupBy("song", "x.artist").agg(F.sum("x.s").alias("n")).where("n > 0")


@q("final_recount", f"SELECT artist, COUNT(*) AS n, COUNT(DISTINCT video) AS videos, COUNT(DISTINCT song) AS songs FROM {OCC} WHERE NOT niche GROUP BY artist")
def final_recount(spark: SparkSession, d: str) -> DataFrame:
    """L05."""
    return occurrences(spark, d).where("NOT niche").groupBy("artist").agg(count().alias("n"), F.countDistinct("video").alias("videos"), F.countDistinct("song").alias("songs"))


@q("no_revival", "SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_custkey % 6 <> 0 OR o_orderstatus = 'F' GROUP BY 1")
def no_revival(spark: SparkSession, d: str) -> DataFrame:
    """A source that an overlay touched never falls back to its old rows."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    touched = o.where("o_custkey % 6 = 0").select("o_custkey").distinct()
    overlay = o.where("o_custkey % 6 = 0 AND o_orderstatus = 'F'")
    return o.join(touched, "o_custkey", "left_anti").unionByName(overlay).groupBy("o_custkey").agg(count().alias("n"))


@q("boundary_latest", "SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m') = (SELECT MAX(strftime(o_orderdate, '%Y-%m')) FROM orders)")
def boundary_latest(spark: SparkSession, d: str) -> DataFrame:
    """Only the newest boundary counts."""
    o = table(spark, d, "orders").withColumn("b", F.date_format("o_orderdate", "yyyy-MM"))
    return o.join(o.agg(F.max("b").alias("b")), "b").select("o_orderkey")


@q("pair_key_filter", "SELECT p_partkey FROM part WHERE (p_name, p_brand) IN (SELECT (p_name, p_brand) FROM part WHERE p_partkey < 60)")
def pair_key_filter(spark: SparkSession, d: str) -> DataFrame:
    """Title and artist as a pair."""
    p = table(spark, d, "part")
    return p.join(p.where("p_partkey < 60").select("p_name", "p_brand").distinct(), ["p_name", "p_brand"], "left_semi").select("p_partkey")


@q("accepted_import", "SELECT o_orderkey, o_orderkey % 4 AS file FROM orders WHERE o_orderkey % 3 = 0")
def accepted_import(spark: SparkSession, d: str) -> DataFrame:
    """One patch record per video; a video in two files is an error."""
    files = table(spark, d, "orders").where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_orderkey") % 4).alias("file"))
    checked = files.groupBy("o_orderkey").agg(F.countDistinct("file").alias("files"), F.min("file").alias("file"))
    return checked.select("o_orderkey", F.when(F.col("files") == 1, F.col("file")).otherwise(F.raise_error(F.lit("a video is in two files")).cast("bigint")).alias("file"))


@q("candidate_merge", "SELECT user_id, COUNT(*) AS evidence, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, COUNT(DISTINCT user_id % 7) > 1 AS conflict FROM events WHERE event_type <> 'signup' GROUP BY user_id")
def candidate_merge(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of a candidate is merged, contradictions flagged."""
    g = table(spark, d, "events").where("event_type <> 'signup'").groupBy("user_id")
    return g.agg(count().alias("evidence"), F.concat_ws(",", F.array_sort(F.collect_set("event_type"))).alias("kinds"), (F.countDistinct(F.col("user_id") % 7) > 1).alias("conflict"))


@q("ntile_shards", "SELECT o_orderkey, ((ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1) * 8 // COUNT(*) OVER ())::BIGINT AS range_shard, o_orderkey % 8 AS mod_shard, ('0x' || left(sha256(o_orderkey::VARCHAR), 8))::BIGINT % 8 AS hash_shard FROM orders")
def ntile_shards(spark: SparkSession, d: str) -> DataFrame:
    """Work by even ranges, by remainder and by digest."""
    o = table(spark, d, "orders").select("o_orderkey")
    total = o.count()
    o = core.ordinal(o, [F.asc("o_orderkey")], "place")
    return o.select("o_orderkey", F.floor((F.col("place") - 1) * 8 / total).cast("bigint").alias("range_shard"), (F.col("o_orderkey") % 8).alias("mod_shard"), (F.conv(F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 8), 16, 10).cast("bigint") % 8).alias("hash_shard"))


@q("priority_first_wins", "SELECT o_orderkey, MIN_BY(s, p) AS s, COUNT(DISTINCT s) > 1 AS conflict FROM (SELECT o_orderkey, o_orderstatus AS s, 0 AS p FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'F', 1 FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_orderstatus, 2 FROM orders) GROUP BY 1")
def priority_first_wins(spark: SparkSession, d: str) -> DataFrame:
    """The first source wins; other values are conflicts."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"))
    sources = F.array_compact(F.array(F.when(F.col("o_orderkey") % 2 == 0, F.struct(F.lit(0).alias("p"), F.col("s").alias("s"))), F.when(F.col("o_orderkey") % 3 == 0, F.struct(F.lit(1).alias("p"), F.lit("F").alias("s"))), F.struct(F.lit(2).alias("p"), F.col("s").alias("s"))))
    return o.select("o_orderkey", F.explode(sources).alias("x")).groupBy("o_orderkey").agg(F.min_by("x.s", "x.p").alias("s"), (F.countDistinct("x.s") > 1).alias("conflict"))


def _conflicting_attributes(o: DataFrame) -> DataFrame:
    return o.groupBy("song").agg(F.countDistinct("artist").alias("artists")).where("artists >= 2")


@q("conflicting_attributes", f"SELECT song, COUNT(DISTINCT artist) AS artists FROM {OCC} GROUP BY song HAVING COUNT(DISTINCT artist) >= 2")
def conflicting_attributes(spark: SparkSession, d: str) -> DataFrame:
    """M03."""
    return _conflicting_attributes(occurrences(spark, d))


@q("gap_reconcile", "SELECT c_custkey, COALESCE(n, 0) AS imported, c_custkey % 20 - COALESCE(n, 0) AS gap, CASE WHEN n IS NULL THEN 'missing' WHEN n > c_custkey % 20 THEN 'ahead' WHEN n < c_custkey % 20 THEN 'behind' ELSE 'even' END AS state FROM customer LEFT JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def gap_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the source against imported ones."""
    n = table(spark, d, "orders").groupBy("o_custkey").agg(count().alias("n"))
    j = table(spark, d, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left").withColumn("said", F.col("c_custkey") % 20)
    return j.select("c_custkey", F.coalesce("n", F.lit(0)).alias("imported"), (F.col("said") - F.coalesce("n", F.lit(0))).alias("gap"), F.when(F.col("n").isNull(), "missing").when(F.col("n") > F.col("said"), "ahead").when(F.col("n") < F.col("said"), "behind").otherwise("even").alias("state"))


@q("fill_missing_plan", "SELECT c_custkey, CASE WHEN s_suppkey IS NULL THEN 'unchanged' WHEN c_custkey % 4 = 0 THEN 'filled' WHEN s_nationkey <> c_nationkey THEN 'conflict' ELSE 'duplicate' END AS plan FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey")
def fill_missing_plan(spark: SparkSession, d: str) -> DataFrame:
    """Only blanks are filled."""
    j = table(spark, d, "customer").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("c_custkey"), "left")
    return j.select("c_custkey", F.when(F.col("s_suppkey").isNull(), "unchanged").when(F.col("c_custkey") % 4 == 0, "filled").when(F.col("s_nationkey") != F.col("c_nationkey"), "conflict").otherwise("duplicate").alias("plan"))


@q("field_coverage", "SELECT COUNT(*) AS n, COUNT(quality) AS labelled, COUNT(*) - COUNT(quality) AS missing, ROUND(COUNT(quality) * 100.0 / COUNT(*), 3)::DOUBLE AS percent FROM documents LEFT JOIN labels USING (doc_id)")
def field_coverage(spark: SparkSession, d: str) -> DataFrame:
    """M07."""
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return j.agg(count().alias("n"), F.count("quality").alias("labelled"), (count() - F.count("quality")).alias("missing"), F.round(F.count("quality") * 100.0 / count(), 3).alias("percent"))


@q("roundtrip_schema", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def roundtrip_schema(spark: SparkSession, d: str) -> DataFrame:
    """Rows as lines of JSON and back, by an explicit schema."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return o.select(F.from_json(F.to_json(F.struct("*")), o.schema).alias("r")).select("r.*")


@q("identity_audit", "SELECT page_id, regexp_matches(url, '^https?://[^/]+/') AS has_path, contains(html, '<title>') AS has_title, contains(html, 'href=') AS has_link FROM pages")
def identity_audit(spark: SparkSession, d: str) -> DataFrame:
    """M13."""
    return table(spark, d, "pages").select("page_id", F.col("url").rlike("^https?://[^/]+/").alias("has_path"), F.col("html").contains("<title>").alias("has_title"), F.col("html").contains("href=").alias("has_link"))


@q("clean_delta", f"SELECT artist, COUNT(*) AS before, COUNT(*) FILTER (WHERE NOT unknown AND position < 7) AS after FROM {OCC} GROUP BY artist")
def clean_delta(spark: SparkSession, d: str) -> DataFrame:
    """Counts before and after a cleaning rule."""
    return occurrences(spark, d).groupBy("artist").agg(count().alias("before"), F.count_if(~F.col("unknown") & (F.col("position") < 7)).alias("after"))


def _cluster_pairs(p: DataFrame) -> DataFrame:
    x = p.select("p_name", F.col("p_brand").alias("a")).distinct()
    y = x.withColumnRenamed("a", "b")
    return x.join(y, "p_name").where("a < b").withColumn("confidence", F.when(F.left("a", F.lit(7)) == F.left("b", F.lit(7)), 0.9).otherwise(0.45))


@q("cluster_pairs", "SELECT p_name, a, b, CASE WHEN left(a, 7) = left(b, 7) THEN 0.9 ELSE 0.45 END::DOUBLE AS confidence FROM (SELECT x.p_name, x.p_brand AS a, y.p_brand AS b FROM (SELECT DISTINCT p_name, p_brand FROM part) x JOIN (SELECT DISTINCT p_name, p_brand FROM part) y ON x.p_name = y.p_name AND x.p_brand < y.p_brand)")
def cluster_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Artists of one title, scored in pairs."""
    return _cluster_pairs(table(spark, d, "part"))


@q("event_time_route", "SELECT CASE WHEN ts > TIMESTAMP '2024-01-25' THEN 'rejected' WHEN ts >= TIMESTAMP '2024-01-25' - INTERVAL 7 DAY THEN '7d' ELSE 'all' END AS route, COUNT(*) AS n FROM events GROUP BY 1")
def event_time_route(spark: SparkSession, d: str) -> DataFrame:
    """What is later than the as-of time is rejected."""
    asof = F.lit("2024-01-25").cast("timestamp_ntz")
    route = F.when(F.col("ts") > asof, "rejected").when(F.col("ts") >= asof - F.expr("INTERVAL 7 DAYS"), "7d").otherwise("all")
    return table(spark, d, "events").groupBy(route.alias("route")).agg(count().alias("n"))


@q("semantic_equal", "SELECT 0::BIGINT AS differences")
def semantic_equal(spark: SparkSession, d: str) -> DataFrame:
    """Two ways to the same ranking differ in no row."""
    o = occurrences(spark, d)
    a = o.groupBy("song").agg(count().alias("n"))
    b = o.groupBy("song", "artist").agg(count().alias("n")).groupBy("song").agg(F.sum("n").alias("n"))
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(count().alias("differences"))


@q("first_failing_stage", "SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN 'not discovered' WHEN l.n IS NULL THEN 'no occurrences' WHEN l.known = 0 THEN 'no usable source' ELSE 'published' END AS stage FROM orders LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n, COUNT(*) FILTER (WHERE l_linestatus <> 'F') AS known FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey")
def first_failing_stage(spark: SparkSession, d: str) -> DataFrame:
    """The first step of the ladder at which a video stops."""
    l = occurrences(spark, d).groupBy("video").agg(count().alias("n"), F.count_if(~F.col("unknown")).alias("known"))  # noqa: E741
    j = table(spark, d, "orders").join(l, F.col("video") == F.col("o_orderkey"), "left")
    return j.select("o_orderkey", F.when(F.col("o_orderkey") % 19 == 0, "not discovered").when(F.col("n").isNull(), "no occurrences").when(F.col("known") == 0, "no usable source").otherwise("published").alias("stage"))
