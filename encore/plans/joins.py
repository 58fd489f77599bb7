"""Plans of joins (section D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from encore.functions import text as tx
from encore.operators import core
from encore.plans.common import OCC, count, occurrences
from encore.plans.registry import Registry, table
from encore.session import materialized

reg = Registry()
q = reg.register


@q("join_inner", "SELECT o_orderpriority, COUNT(*) AS n, COUNT(DISTINCT o_orderkey) AS videos FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def join_inner(spark: SparkSession, d: str) -> DataFrame:
    """D01."""
    j = occurrences(spark, d).join(table(spark, d, "orders"), F.col("video") == F.col("o_orderkey"))
    return j.groupBy("o_orderpriority").agg(count().alias("n"), F.countDistinct("o_orderkey").alias("videos"))


@q("join_normalized_key", "SELECT s_name, COUNT(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON lower(trim(s_name)) = 'supplier#' || lpad(l_suppkey::VARCHAR, 9, '0') WHERE p_size > 25 GROUP BY 1")
def join_normalized_key(spark: SparkSession, d: str) -> DataFrame:
    """Artists by their normalised name."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "part").where("p_size > 25").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey")).withColumn("name", F.concat(F.lit("supplier#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")))
    s = table(spark, d, "supplier").select("s_name", F.lower(F.trim("s_name")).alias("name"))
    return rows.join(s, "name").groupBy("s_name").agg(count().alias("n"))


@q("join_three_way", "SELECT c_mktsegment, o_orderpriority, COUNT(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def join_three_way(spark: SparkSession, d: str) -> DataFrame:
    """Counts per order first, so that only one row per order meets the customers."""
    per = table(spark, d, "lineitem").groupBy("l_orderkey").agg(count().alias("n"))
    j = per.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_mktsegment", "o_orderpriority").agg(F.sum("n").alias("n"))


@q("join_left", "SELECT c_custkey, COUNT(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def join_left(spark: SparkSession, d: str) -> DataFrame:
    """D04."""
    n = table(spark, d, "orders").groupBy("o_custkey").agg(count().alias("n"))
    return table(spark, d, "customer").join(n, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@q("join_semi", f"SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM {OCC} o WHERE song = p_partkey AND niche AND position = 7)")
def join_semi(spark: SparkSession, d: str) -> DataFrame:
    """D05."""
    o = occurrences(spark, d).where("niche AND position = 7").select("song")
    return table(spark, d, "part").join(o, F.col("song") == F.col("p_partkey"), "left_semi").select("p_partkey", "p_name")


@q("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark: SparkSession, d: str) -> DataFrame:
    """D06."""
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@q("correlated_counts", f"SELECT p_partkey, (SELECT COUNT(*) FROM {OCC} WHERE song = p_partkey AND NOT unknown) AS n, (SELECT COUNT(DISTINCT video) FROM {OCC} WHERE song = p_partkey AND NOT unknown) AS videos FROM part")
def correlated_counts(spark: SparkSession, d: str) -> DataFrame:
    """Recounts under a scope, as one aggregate and one join."""
    g = occurrences(spark, d).where("NOT unknown").groupBy("song").agg(count().alias("n"), F.countDistinct("video").alias("videos"))
    return table(spark, d, "part").join(g, F.col("song") == F.col("p_partkey"), "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("videos", F.lit(0)).alias("videos"))


@q(
    "join_or_identity",
    "SELECT DISTINCT c_custkey, s_suppkey FROM customer, supplier WHERE c_custkey = s_suppkey * 3 OR right(c_name, 9) = right(s_name, 9) OR (c_nationkey = s_nationkey AND c_mktsegment = 'BUILDING' AND c_acctbal > 9500)",
)
def join_or_identity(spark: SparkSession, d: str) -> DataFrame:
    """Any of three identities, as the union of three equi-joins."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    conditions = (F.col("c_custkey") == F.col("s_suppkey") * 3, F.right("c_name", F.lit(9)) == F.right("s_name", F.lit(9)), F.col("c_nationkey") == F.col("s_nationkey"))
    sides = (c, c, c.where("c_mktsegment = 'BUILDING' AND c_acctbal > 9500"))
    parts = [x.join(s, on).select("c_custkey", "s_suppkey") for x, on in zip(sides, conditions, strict=True)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


@q("two_phase_page", f"WITH page AS (SELECT song FROM {OCC} GROUP BY song ORDER BY COUNT(*) DESC, song LIMIT 20 OFFSET 20) SELECT song, video, COUNT(*) AS n FROM {OCC} WHERE song IN (SELECT song FROM page) GROUP BY ALL")
def two_phase_page(spark: SparkSession, d: str) -> DataFrame:
    """The keys of a page are fed back into the second query."""
    o = occurrences(spark, d)
    page = o.groupBy("song").agg(count().alias("n")).orderBy(F.desc("n"), "song").offset(20).limit(20).select("song")
    return o.join(page, "song", "left_semi").groupBy("song", "video").agg(count().alias("n"))


@q("fts_join", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widget')")
def fts_join(spark: SparkSession, d: str) -> DataFrame:
    """Postings of all grams of the needle, then a check of the text."""
    p, needle = table(spark, d, "part"), "widget"
    grams = sorted({needle[i : i + 3] for i in range(len(needle) - 2)})
    postings = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length("p_name") - 2, F.lit(1))), lambda i: F.substring(F.lower("p_name"), i, F.lit(3)))))
    hits = p.select("p_partkey", postings.alias("gram")).where(F.col("gram").isin(grams)).groupBy("p_partkey").agg(count().alias("n")).where(F.col("n") == len(grams))
    return p.join(hits, "p_partkey", "left_semi").where(F.lower("p_name").contains(needle)).select("p_partkey", "p_name")


@q("coalesce_lookup", "SELECT o_orderkey, COALESCE(a.c_name, b.c_name) AS name FROM orders LEFT JOIN customer a ON a.c_custkey = o_custkey AND a.c_custkey % 2 = 0 LEFT JOIN customer b ON b.c_custkey = o_orderkey % 100")
def coalesce_lookup(spark: SparkSession, d: str) -> DataFrame:
    """By the canonical id, else by the external one."""
    c = table(spark, d, "customer")
    a = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("a"), F.col("c_name").alias("name_a"))
    b = c.select(F.col("c_custkey").alias("b"), F.col("c_name").alias("name_b"))
    return table(spark, d, "orders").join(a, F.col("a") == F.col("o_custkey"), "left").join(b, F.col("b") == F.col("o_orderkey") % 100, "left").select("o_orderkey", F.coalesce("name_a", "name_b").alias("name"))


@q(
    "outer_merge",
    "SELECT COALESCE(a.o_orderkey, b.o_orderkey) AS o_orderkey, COALESCE(a.o_orderstatus, b.o_orderstatus) AS status, concat_ws('|', CASE WHEN a.o_orderkey IS NOT NULL THEN 'fetched' END, CASE WHEN b.o_orderkey IS NOT NULL THEN 'carried' END) AS tags FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 2 = 0) b ON a.o_orderkey = b.o_orderkey",
)
def outer_merge(spark: SparkSession, d: str) -> DataFrame:
    """Fetched rows win, carried ones fill blanks; arrays are united."""
    o = table(spark, d, "orders")
    a = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("ka"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("sa"), F.array(F.lit("fetched")).alias("ta"))
    b = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("kb"), F.col("o_orderstatus").alias("sb"), F.array(F.lit("carried")).alias("tb"))
    none = F.array().cast("array<string>")
    return a.join(b, F.col("ka") == F.col("kb"), "full").select(F.coalesce("ka", "kb").alias("o_orderkey"), F.coalesce("sa", "sb").alias("status"), F.concat_ws("|", F.array_union(F.coalesce("ta", none), F.coalesce("tb", none))).alias("tags"))


@q(
    "rank_diff",
    f"WITH r AS (SELECT year(played) AS y, artist, COUNT(*) AS n, RANK() OVER (PARTITION BY year(played) ORDER BY COUNT(*) DESC) AS rank FROM {OCC} WHERE year(played) IN (1997, 1998) GROUP BY 1, 2) SELECT a.artist, a.rank, b.rank AS before, b.rank - a.rank AS delta FROM (SELECT * FROM r WHERE y = 1998) a LEFT JOIN (SELECT * FROM r WHERE y = 1997) b USING (artist)",
)
def rank_diff(spark: SparkSession, d: str) -> DataFrame:
    """Ranks of two versions, side by side."""
    n = occurrences(spark, d).withColumn("y", F.year("played")).where("y IN (1997, 1998)").groupBy("y", "artist").agg(count().alias("n"))
    # Ranks come from the few distinct counts.
    before = Window.partitionBy("y").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = n.groupBy("y", "n").agg(count().alias("c")).select("y", "n", (F.coalesce(F.sum("c").over(before), F.lit(0)) + 1).alias("rank"))
    r = n.join(ranks, ["y", "n"])
    a, b = r.where("y = 1998").select("artist", "rank"), r.where("y = 1997").select("artist", F.col("rank").alias("before"))
    return a.join(b, "artist", "left").withColumn("delta", F.col("before") - F.col("rank"))


@q("alias_canonicalize", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN 'Brand#2' ELSE p_brand END || '::' || lower(p_name) AS key FROM part")
def alias_canonicalize(spark: SparkSession, d: str) -> DataFrame:
    """Aliases map to exactly one canonical name; a contradicting alias is an error."""
    aliases = spark.createDataFrame([("Brand#1", "Brand#2")], "alias string, canonical string")
    checked = aliases.groupBy("alias").agg(F.min("canonical").alias("canonical"), F.countDistinct("canonical").alias("n"))
    sure = checked.select("alias", F.when(F.col("n") == 1, F.col("canonical")).otherwise(F.raise_error(F.lit("contradicting alias"))).alias("canonical"))
    p = table(spark, d, "part").join(F.broadcast(sure), F.col("p_brand") == F.col("alias"), "left")
    return p.select("p_partkey", F.concat(F.coalesce("canonical", "p_brand"), F.lit("::"), F.lower("p_name")).alias("key"))


@q(
    "membership_flag",
    "WITH w AS (SELECT DISTINCT doc_id, UNNEST(regexp_extract_all(lower(text), '[a-z]{9,}')) AS w FROM documents), b AS (SELECT DISTINCT UNNEST(regexp_extract_all(lower(text), '[a-z]{9,}')) AS w FROM benchmark), k AS (SELECT DISTINCT doc_id FROM w JOIN b USING (w)) SELECT d.doc_id, k.doc_id IS NULL AS niche FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN k ON d.doc_id = k.doc_id",
)
def membership_flag(spark: SparkSession, d: str) -> DataFrame:
    """A flag for every document; niche if no candidate key is in the library, or it has none."""
    keys = lambda df, *cols: df.select(*cols, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0)))).alias("w"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    known = keys(docs, "doc_id").join(keys(table(spark, d, "benchmark")).distinct(), "w", "left_semi").select("doc_id").distinct().withColumn("known", F.lit(True))
    return docs.select("doc_id").distinct().join(known, "doc_id", "left").select("doc_id", F.col("known").isNull().alias("niche"))


RULES = [(1, 0, None, 0, "drop"), (2, None, "R", 3, "replace"), (3, None, None, 7, "force_keep")]
RULES_SQL = "(VALUES (1, 0, NULL, 0, 'drop'), (2, NULL, 'R', 3, 'replace'), (3, NULL, NULL, 7, 'force_keep')) r(ordinal, pos, flag, modulo, action)"


@q(
    "override_join",
    f"SELECT o_orderkey, action FROM (SELECT o.o_orderkey, action, ROW_NUMBER() OVER (PARTITION BY o.o_orderkey ORDER BY ordinal) AS rn FROM orders o JOIN {RULES_SQL} ON o.o_orderkey % 10 = r.modulo AND (r.pos IS NULL OR o.o_custkey % 5 = r.pos) AND (r.flag IS NULL OR o.o_orderstatus = 'F')) WHERE rn = 1",
)
def override_join(spark: SparkSession, d: str) -> DataFrame:
    """A selector compares only what it names; the first rule wins."""
    rules = spark.createDataFrame(RULES, "ordinal int, pos bigint, flag string, modulo bigint, action string")
    o = table(spark, d, "orders").withColumn("m", F.col("o_orderkey") % 10)
    on = (F.col("m") == F.col("modulo")) & (F.col("pos").isNull() | (F.col("o_custkey") % 5 == F.col("pos"))) & (F.col("flag").isNull() | (F.col("o_orderstatus") == "F"))
    return core.best_per_key(o.join(F.broadcast(rules), on).select("o_orderkey", "action", "ordinal"), ["o_orderkey"], F.asc("ordinal")).select("o_orderkey", "action")


def _shared_item_pairs(o: DataFrame) -> DataFrame:
    a = o.select("artist", "song").distinct()
    b = a.select(F.col("artist").alias("b"), "song")
    return a.withColumnRenamed("artist", "a").join(b, "song").where("a < b").groupBy("a", "b").agg(F.countDistinct("song").alias("songs"))


@q("shared_item_pairs", f"SELECT a.artist AS a, b.artist AS b, COUNT(DISTINCT a.song) AS songs FROM (SELECT DISTINCT artist, song FROM {OCC}) a JOIN (SELECT DISTINCT artist, song FROM {OCC}) b ON a.song = b.song AND a.artist < b.artist GROUP BY ALL")
def shared_item_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of artists that share a song."""
    return _shared_item_pairs(occurrences(spark, d))


@q(
    "interval_self_join",
    "SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600000000",
)
def interval_self_join(spark: SparkSession, d: str) -> DataFrame:
    """Within ten minutes, by bins of that length and their neighbours."""
    width = 600_000_000
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    a = e.withColumn("bin", F.floor(F.col("us") / width))
    b = a.select(F.col("event_id").alias("event_b"), "user_id", "event_type", F.col("us").alias("us_b"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin"))
    j = a.join(b, ["user_id", "event_type", "bin"]).where((F.col("event_id") < F.col("event_b")) & (F.abs(F.col("us") - F.col("us_b")) <= width))
    return j.select(F.col("event_id").alias("a"), F.col("event_b").alias("b"))


@q("concat_key_join", "SELECT a.p_partkey AS a, COUNT(*) AS n FROM part a JOIN (SELECT DISTINCT p_name, p_brand FROM part) b ON lower(a.p_name || a.p_brand) = lower(b.p_name) || lower(b.p_brand) GROUP BY 1")
def concat_key_join(spark: SparkSession, d: str) -> DataFrame:
    """D19."""
    p = table(spark, d, "part")
    a = p.select(F.col("p_partkey").alias("a"), F.lower(F.concat("p_name", "p_brand")).alias("k"))
    b = p.select("p_name", "p_brand").distinct().select(F.concat(F.lower("p_name"), F.lower("p_brand")).alias("k"))
    return a.join(b, "k").groupBy("a").agg(count().alias("n"))


EDGES_SQL = "SELECT c_custkey AS a, (c_custkey // 7) * 7 AS b FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_custkey - 700 FROM customer WHERE c_custkey % 700 < 30 AND c_custkey >= 700"


@q(
    "connected_components",
    f"WITH RECURSIVE e AS (SELECT a, b FROM ({EDGES_SQL}) WHERE a <> b), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS m FROM s UNION SELECT s.b, r.m FROM r JOIN s ON r.node = s.a) SELECT node, MIN(m) AS component FROM r GROUP BY node",
)
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """Records that share an identity collapse."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    e = c.where("c_custkey % 3 <> 0").select(k.alias("a"), (F.floor(k / 7) * 7).cast("bigint").alias("b")).unionByName(c.where("c_custkey % 700 < 30 AND c_custkey >= 700").select(k.alias("a"), (k - 700).alias("b")))
    return core.connected_components(e, materialized)


@q("containment_check", f"SELECT COUNT(*) AS missing FROM (SELECT DISTINCT song FROM {OCC} WHERE played >= TIMESTAMP '1998-06-01') a WHERE song NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 97 <> 0)")
def containment_check(spark: SparkSession, d: str) -> DataFrame:
    """What the short range has, the long one must have."""
    late = occurrences(spark, d).where(F.col("played") >= F.lit("1998-06-01").cast("timestamp_ntz")).select("song").distinct()
    return late.join(table(spark, d, "part").where("p_partkey % 97 <> 0"), F.col("song") == F.col("p_partkey"), "left_anti").agg(count().alias("missing"))


@q("asof_lineage", "SELECT e.event_id, r.o_orderkey AS revision FROM events e ASOF LEFT JOIN orders r ON e.event_id >= r.o_orderkey")
def asof_lineage(spark: SparkSession, d: str) -> DataFrame:
    """The last revision at or before a point, all events in all revisions.

    Both sides are dealt to ranges of points. An event takes the last revision of its range, or
    else the last of the ranges before, of which there is one row a range.
    """
    e = table(spark, d, "events").select("event_id", F.col("event_id").alias("at"), F.lit(None).cast("bigint").alias("rev"))
    r = table(spark, d, "orders").select(F.lit(None).cast("bigint").alias("event_id"), F.col("o_orderkey").alias("at"), F.col("o_orderkey").alias("rev"))
    both = materialized(e.unionByName(r).repartitionByRange("at").withColumn("range", F.spark_partition_id()))
    until = Window.partitionBy("range").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = both.groupBy(F.col("range").alias("_range")).agg(F.max("rev").alias("_end")).select("_range", F.max("_end").over(before).alias("_start"))
    found = both.withColumn("_last", F.max("rev").over(until)).where("rev IS NULL")
    return found.join(ends, F.col("range") == F.col("_range")).select("event_id", F.coalesce("_last", "_start").alias("revision"))


@q(
    "fill_from_mode",
    f"WITH m AS (SELECT song, artist FROM (SELECT song, artist, ROW_NUMBER() OVER (PARTITION BY song ORDER BY COUNT(*) DESC, artist) AS rn FROM {OCC} WHERE NOT unknown GROUP BY song, artist) WHERE rn = 1) SELECT COALESCE(m.artist, -1) AS artist, COUNT(*) AS n FROM {OCC} o LEFT JOIN m USING (song) WHERE o.unknown GROUP BY 1",
)
def fill_from_mode(spark: SparkSession, d: str) -> DataFrame:
    """Unknown artists get the dominant one of the same song."""
    o = occurrences(spark, d)
    m = core.mode(o.where("NOT unknown"), ["song"], "artist").select("song", F.col("artist").alias("known"))
    return o.where("unknown").join(m, "song", "left").groupBy(F.coalesce("known", F.lit(-1)).alias("artist")).agg(count().alias("n"))


@q("affected_keys", f"SELECT DISTINCT song FROM {OCC} WHERE video IN (SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01')")
def affected_keys(spark: SparkSession, d: str) -> DataFrame:
    """D24."""
    changed = table(spark, d, "orders").where(F.col("o_orderdate") >= F.lit("1998-07-01").cast("timestamp_ntz")).select(F.col("o_orderkey").alias("video"))
    return occurrences(spark, d).join(changed, "video", "left_semi").select("song").distinct()


@q("join_key_digests", "SELECT r_name, left(sha256(r_regionkey::VARCHAR || chr(31) || r_name), 16) AS id FROM region")
def join_key_digests(spark: SparkSession, d: str) -> DataFrame:
    """Ids of joined parts, 16 hex digits."""
    return table(spark, d, "region").select("r_name", tx.stable_key(F.col("r_regionkey"), F.col("r_name")).alias("id"))
