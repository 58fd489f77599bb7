"""Plans of scans, sources, sinks and materialised outputs (sections A and B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from encore.functions import text as tx
from encore.operators import core
from encore.operators.revisions import Conflict, Store
from encore.plans.common import OCC, count, now, occurrences
from encore.plans.registry import Registry, table
from encore.session import materialized, new_folder
from encore.sources import html, pages
from encore.sources.shards import packed

reg = Registry()
q = reg.register


@q(
    "scan_last_write_wins",
    """SELECT o_orderkey, MAX_BY(o_totalprice, seq) AS o_totalprice, MAX(seq)::BIGINT AS seq FROM (
         SELECT o_orderkey, o_totalprice, 0 AS seq FROM orders
         UNION ALL SELECT o_orderkey, o_totalprice + 1, 1 FROM orders WHERE o_orderkey % 3 = 0
         UNION ALL SELECT o_orderkey, o_totalprice + 2, 2 FROM orders WHERE o_orderkey % 9 = 0) GROUP BY o_orderkey""",
)
def scan_last_write_wins(spark: SparkSession, d: str) -> DataFrame:
    """Later files replace earlier rows of an id."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    files = [o.withColumn("seq", F.lit(0)), *(o.where(F.col("o_orderkey") % m == 0).select("o_orderkey", (F.col("o_totalprice") + s).alias("o_totalprice"), F.lit(s).alias("seq")) for m, s in ((3, 1), (9, 2)))]
    rows = files[0].unionByName(files[1]).unionByName(files[2])
    return rows.groupBy("o_orderkey").agg(F.max_by("o_totalprice", "seq").alias("o_totalprice"), F.max("seq").cast("bigint").alias("seq"))


@q("source_gate", "SELECT COUNT(*) AS items, COUNT(DISTINCT event_id) AS ids, COUNT(*) > 0 AND COUNT(*) = COUNT(DISTINCT event_id) AS complete FROM events")
def source_gate(spark: SparkSession, d: str) -> DataFrame:
    """A source is taken only if it is complete and not empty."""
    return table(spark, d, "events").agg(count().alias("items"), F.countDistinct("event_id").alias("ids")).withColumn("complete", (F.col("items") > 0) & (F.col("items") == F.col("ids")))


@q(
    "latest_snapshot_per_day",
    """SELECT event_id, ts::DATE::VARCHAR AS day FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY ts::DATE ORDER BY ts DESC, event_id) AS rn FROM events
         WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY AND ts <= TIMESTAMP '2024-01-31 06:00:00' AND event_id % 10 <> 0) WHERE rn = 1 ORDER BY day DESC LIMIT 14""",
)
def latest_snapshot_per_day(spark: SparkSession, d: str) -> DataFrame:
    """The latest not yet imported snapshot of each day, newest first, at most 14."""
    e = table(spark, d, "events")
    imported = e.where("event_id % 10 = 0").select("event_id")
    window = e.where((F.col("ts") >= now() - F.expr("INTERVAL 20 DAYS")) & (F.col("ts") <= now() + F.expr("INTERVAL 6 HOURS")))
    fresh = window.join(imported, "event_id", "left_anti").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return core.best_per_key(fresh, ["day"], F.desc("ts"), F.asc("event_id")).select("event_id", "day").orderBy(F.desc("day")).limit(14)


@q("explode_nested", "SELECT vec_id, idx::BIGINT AS idx, ROUND(x::DOUBLE, 4) + 0 AS x FROM (SELECT vec_id, UNNEST(embedding) AS x, GENERATE_SUBSCRIPTS(embedding, 1) - 1 AS idx FROM embeddings)")
def explode_nested(spark: SparkSession, d: str) -> DataFrame:
    """One row per element of a nested array."""
    return table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("idx", "x")).select("vec_id", F.col("idx").cast("bigint").alias("idx"), (F.round(F.col("x").cast("double"), 4) + 0).alias("x"))


@q("explode_map", "SELECT user_id, event_type AS keyword, COUNT(*) AS n FROM events GROUP BY ALL")
def explode_map(spark: SparkSession, d: str) -> DataFrame:
    """Entries of a map of lists, the key being the keyword, then the items of each."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.collect_list("event_id").alias("items"))
    nested = e.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "items"))).alias("keywords"))
    entries = nested.select("user_id", F.explode("keywords").alias("keyword", "items"))
    return entries.select("user_id", "keyword", F.explode("items").alias("item")).groupBy("user_id", "keyword").agg(count().alias("n"))


@q("json_extract_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, COALESCE(json_extract_string(props, '$.missing'), 'none') AS missing FROM events")
def json_extract_path(spark: SparkSession, d: str) -> DataFrame:
    """Typed paths of semi-structured rows, with defaults."""
    e = table(spark, d, "events").withColumn("v", F.try_parse_json("props"))
    return e.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"), F.coalesce(F.try_variant_get("v", "$.missing", "string"), F.lit("none")).alias("missing"))


@q("embedded_json")
def embedded_json(spark: SparkSession, d: str) -> DataFrame:
    """The first balanced object after a marker in a page, found without running code."""
    return html.embedded_objects(table(spark, d, "pages"), "page_id", "html", "<script>")


@q("html_title", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_title(spark: SparkSession, d: str) -> DataFrame:
    """A07."""
    return table(spark, d, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@q("html_links", "SELECT page_id, UNNEST(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    """One row per link."""
    return table(spark, d, "pages").select("page_id", F.explode(html.links(F.col("html"))).alias("href"))


@q(
    "html_strip_tags",
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g'), ' ') AS text FROM pages""",
)
def html_strip_tags(spark: SparkSession, d: str) -> DataFrame:
    """The text of a page."""
    return table(spark, d, "pages").select("page_id", html.text(F.col("html")).alias("text"))


@q("cursor_pages", "SELECT COUNT(*) AS pages, COUNT(*) FILTER (WHERE b.page_id IS NULL) AS ends, CASE COUNT(*) FILTER (WHERE b.page_id IS NULL) WHEN 1 THEN 'complete' WHEN 0 THEN 'cursor-loop' ELSE 'partial' END AS coverage FROM pages a LEFT JOIN pages b ON b.page_id = a.page_id + 1")
def cursor_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages followed by their cursors (here: the next id), and the class of coverage."""
    p = table(spark, d, "pages").select("page_id")
    following = p.select(F.col("page_id").alias("next"))
    linked = p.join(following, F.col("next") == F.col("page_id") + 1, "left")
    expected = F.lit(1)
    return linked.agg(count().alias("pages"), F.count_if(F.col("next").isNull()).alias("ends")).withColumn("coverage", F.when(F.col("ends") == expected, "complete").when(F.col("ends") == 0, "cursor-loop").otherwise("partial"))


@q("bundle_count_check", "SELECT l_returnflag AS shard, COUNT(*) AS n, SUM(COUNT(*)) OVER ()::BIGINT AS total, SUM(COUNT(*)) OVER () = (SELECT COUNT(*) FROM lineitem) AS complete FROM lineitem GROUP BY 1")
def bundle_count_check(spark: SparkSession, d: str) -> DataFrame:
    """The shards of a bundle must hold as many rows as its manifest says."""
    shards = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("shard")).agg(count().alias("n"))
    manifest = table(spark, d, "lineitem").agg(count().alias("expected"))
    return shards.withColumn("total", F.sum("n").over(Window.partitionBy())).join(F.broadcast(manifest)).select("shard", "n", "total", (F.col("total") == F.col("expected")).alias("complete"))


@q("jsonl_route_by_type", "SELECT event_type AS kind, CASE WHEN event_type IN ('view', 'click') THEN 'interaction' WHEN event_type = 'error' THEN 'failure' ELSE 'conversion' END AS target, COUNT(*) AS n, SUM(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY ALL")
def jsonl_route_by_type(spark: SparkSession, d: str) -> DataFrame:
    """A10: lines of several kinds, routed by kind."""
    lines = table(spark, d, "events").select(F.to_json(F.struct(F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("k"))).alias("line"))
    parsed = lines.select(F.from_json("line", "kind string, k string").alias("r")).select("r.kind", F.col("r.k").cast("bigint").alias("k"))
    target = F.when(F.col("kind").isin("view", "click"), "interaction").when(F.col("kind") == "error", "failure").otherwise("conversion")
    return parsed.groupBy("kind", target.alias("target")).agg(count().alias("n"), F.sum("k").alias("k"))


@q("scan_parquet", "SELECT r_regionkey, r_name FROM region")
def scan_parquet(spark: SparkSession, d: str) -> DataFrame:
    """A read-only table scan."""
    return table(spark, d, "region").select("r_regionkey", "r_name")


@q("snapshot_scan", "SELECT o_orderstatus, COUNT(*) AS n, strftime(MAX(o_orderdate), '%Y-%m-%d') AS last FROM orders GROUP BY 1")
def snapshot_scan(spark: SparkSession, d: str) -> DataFrame:
    """All reads go to the files that the first look at the table found; what is added later is not seen."""
    o = table(spark, d, "orders")
    pinned = spark.read.schema(o.schema).parquet(*o.inputFiles())
    n = pinned.groupBy("o_orderstatus").agg(count().alias("n"))
    last = pinned.groupBy("o_orderstatus").agg(F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last"))
    return n.join(last, "o_orderstatus")


@q("broadcast_dim_join", "SELECT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def broadcast_dim_join(spark: SparkSession, d: str) -> DataFrame:
    """Reviewed lookup tables go to every executor where their size allows it, which Spark checks."""
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("r_name", "n_name")


@q("content_hash", "SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS bytes FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    """Digests and lengths of whole texts."""
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"))


@q(
    "import_reconcile",
    "SELECT COUNT(*) AS candidates, COUNT(l_orderkey) AS inspected, COUNT(*) - COUNT(l_orderkey) AS missing, SUM(n)::BIGINT AS occurrences FROM (SELECT o_orderkey FROM orders) LEFT JOIN (SELECT l_orderkey, COUNT(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey",
)
def import_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Candidates, inspected ids and occurrences must reconcile."""
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(count().alias("n"))
    o = table(spark, d, "orders").select("o_orderkey").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.agg(count().alias("candidates"), F.count("l_orderkey").alias("inspected"), (count() - F.count("l_orderkey")).alias("missing"), F.sum("n").alias("occurrences"))


@q("paged_ranking", "SELECT p_brand, p_name, n, rank, ((rank - 1) // 50 + 1)::BIGINT AS page FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY n DESC, p_brand, p_name) AS rank FROM (SELECT p_brand, p_name, COUNT(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2))")
def paged_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Pages of 50 rows in ranking order."""
    n = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "p_name").agg(count().alias("n"))
    return core.ordinal(n, [F.desc("n"), F.asc("p_brand"), F.asc("p_name")]).withColumn("page", F.ceil(F.col("rank") / 50).cast("bigint"))


@q(
    "shard_pack",
    """WITH RECURSIVE r AS (SELECT source, doc_id, n_chars, ROW_NUMBER() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
       p AS (SELECT source, doc_id, rn, n_chars AS held, 0 AS part FROM r WHERE rn = 1
         UNION ALL SELECT r.source, r.doc_id, r.rn, CASE WHEN p.held + r.n_chars > 200000 THEN r.n_chars ELSE p.held + r.n_chars END, p.part + CASE WHEN p.held + r.n_chars > 200000 THEN 1 ELSE 0 END
         FROM p JOIN r ON r.source = p.source AND r.rn = p.rn + 1)
       SELECT source, doc_id, part::BIGINT AS part FROM p""",
)
def shard_pack(spark: SparkSession, d: str) -> DataFrame:
    """Rows are appended to a part until its size would pass the limit; a larger row is an error."""
    return packed(table(spark, d, "documents"), "source", "doc_id", "n_chars", 200_000)


@q("page_digest", "SELECT page, COUNT(*) AS n, left(sha256(string_agg(h, chr(10) ORDER BY doc_id)), 12) AS digest FROM (SELECT doc_id, doc_id // 100 AS page, sha256(text) AS h FROM documents) GROUP BY page")
def page_digest(spark: SparkSession, d: str) -> DataFrame:
    """Pages named by the digest of their content."""
    rows = table(spark, d, "documents").select("doc_id", F.floor(F.col("doc_id") / 100).cast("bigint").alias("page"), F.sha2("text", 256).alias("h"))
    lists = rows.groupBy("page").agg(count().alias("n"), F.sort_array(F.collect_list(F.struct("doc_id", "h"))).alias("rows"))
    return lists.select("page", "n", F.substring(F.sha2(F.concat_ws("\n", F.transform("rows", lambda r: r["h"])), 256), 1, 12).alias("digest"))


@q(
    "changed_rows",
    """SELECT COALESCE(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN b.o_orderkey IS NULL THEN 'pruned' WHEN a.o_orderkey IS NULL THEN 'new' ELSE 'changed' END AS change
       FROM orders a FULL JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 11 <> 0) b ON a.o_orderkey = b.o_orderkey
       WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus <> b.s""",
)
def changed_rows(spark: SparkSession, d: str) -> DataFrame:
    """What a build has to write and what it has to prune."""
    a = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    b = a.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")).alias("s"))
    both = a.join(b, F.col("o_orderkey") == F.col("k"), "full")
    change = F.when(F.col("k").isNull(), "pruned").when(F.col("o_orderkey").isNull(), "new").when(F.col("o_orderstatus") != F.col("s"), "changed")
    return both.select(F.coalesce("o_orderkey", "k").alias("o_orderkey"), change.alias("change")).where("change IS NOT NULL")


@q("runtime_tables", f"SELECT 'occurrences' AS \"table\", COUNT(*) AS n FROM {OCC} UNION ALL SELECT 'songs', COUNT(DISTINCT song) FROM {OCC} UNION ALL SELECT 'videos', COUNT(DISTINCT video) FROM {OCC} UNION ALL SELECT 'artists', COUNT(DISTINCT artist) FROM {OCC}")
def runtime_tables(spark: SparkSession, d: str) -> DataFrame:
    """The tables of a release, built beside it, put in place by one rename, and read from there."""
    occ = occurrences(spark, d)
    parts = {"occurrences": occ, "songs": occ.select("song").distinct(), "videos": occ.select("video").distinct(), "artists": occ.select("artist").distinct()}
    folder = new_folder(spark)
    for name, df in parts.items():
        df.write.parquet(f"{folder}.tmp/{name}")
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(path(f"{folder}.tmp"), path(folder)):
        raise OSError("the release could not be put in place")
    counts = [spark.read.parquet(f"{folder}/{name}").agg(count().alias("n")).select(F.lit(name).alias("table"), "n") for name in parts]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@q("trigram_index", "SELECT gram, COUNT(*) AS postings, COUNT(DISTINCT p_name) AS titles FROM (SELECT DISTINCT p_partkey, p_name, UNNEST([substr(lower(p_name), i::INT, 3) FOR i IN range(1, GREATEST(length(p_name) - 1, 1))]) AS gram FROM part) GROUP BY gram")
def trigram_index(spark: SparkSession, d: str) -> DataFrame:
    """Posting lists of three-letter grams."""
    n = F.length("p_name")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(F.lower("p_name"), i, F.lit(3))))
    return table(spark, d, "part").where(n >= 3).select("p_partkey", "p_name", F.explode(grams).alias("gram")).groupBy("gram").agg(count().alias("postings"), F.countDistinct("p_name").alias("titles"))


@q("month_partition_counts", "SELECT year(o_orderdate) AS year, month(o_orderdate) AS month, COUNT(*) AS n FROM orders GROUP BY ALL")
def month_partition_counts(spark: SparkSession, d: str) -> DataFrame:
    """The rows of each YYYY/MM partition."""
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("bigint").alias("year"), F.month("o_orderdate").cast("bigint").alias("month")).agg(count().alias("n"))


@q("chunk_completeness", "SELECT chunk, COUNT(*) AS n, MIN(rank) AS first, MAX(rank) AS last, COUNT(*) = 200 OR chunk = MAX(chunk) OVER () AS whole FROM (SELECT rank, ((rank - 1) // 200)::BIGINT AS chunk FROM (SELECT ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, l_partkey) AS rank FROM lineitem GROUP BY l_partkey)) GROUP BY chunk")
def chunk_completeness(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 200 ranks; only the last may be short."""
    n = table(spark, d, "lineitem").groupBy("l_partkey").agg(count().alias("n"))
    ranked = core.ordinal(n, [F.desc("n"), F.asc("l_partkey")]).select("rank").withColumn("chunk", F.floor((F.col("rank") - 1) / 200).cast("bigint"))
    chunks = ranked.groupBy("chunk").agg(count().alias("n"), F.min("rank").alias("first"), F.max("rank").alias("last"))
    return chunks.withColumn("whole", (F.col("n") == 200) | (F.col("chunk") == F.max("chunk").over(Window.partitionBy())))


@q("source_video_order", f"SELECT song, video, ROW_NUMBER() OVER (PARTITION BY song ORDER BY MIN(position), video)::BIGINT AS ordinal, COUNT(*) AS n FROM {OCC} GROUP BY song, video")
def source_video_order(spark: SparkSession, d: str) -> DataFrame:
    """Videos of a source in the order of their first position."""
    g = occurrences(spark, d).groupBy("song", "video").agg(F.min("position").alias("p"), count().alias("n"))
    return g.select("song", "video", F.row_number().over(Window.partitionBy("song").orderBy("p", "video")).cast("bigint").alias("ordinal"), "n")


@q(
    "revision_resolve",
    """WITH v AS (SELECT o_orderkey AS k, o_totalprice AS p, 1 AS depth, FALSE AS gone FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0
         UNION ALL SELECT o_orderkey, NULL, 1, TRUE FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT o_orderkey, o_totalprice + 1, 2, FALSE FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_totalprice + 2, 3, FALSE FROM orders)
       SELECT k, p, depth::BIGINT AS depth FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY depth) AS rn FROM v) WHERE rn = 1 AND NOT gone""",
)
def revision_resolve(spark: SparkSession, d: str) -> DataFrame:
    """The nearest revision of a lineage that has a key; tombstones hide it."""
    o = table(spark, d, "orders")
    row = lambda df, p, depth, gone: df.select(F.col("o_orderkey").alias("k"), p.cast("double").alias("p"), F.lit(depth).cast("bigint").alias("depth"), F.lit(gone).alias("gone"))
    price = F.col("o_totalprice")
    lineage = row(o.where("o_orderkey % 5 = 0 AND o_orderkey % 10 <> 0"), price, 1, False).unionByName(row(o.where("o_orderkey % 10 = 0"), F.lit(None), 1, True)).unionByName(row(o.where("o_orderkey % 3 = 0"), price + 1, 2, False)).unionByName(row(o, price + 2, 3, False))
    return core.best_per_key(lineage, ["k"], F.asc("depth")).where("NOT gone").select("k", "p", "depth")


@q("review_report", f"SELECT video, '- ' || video || ': ' || string_agg(song::VARCHAR, ', ' ORDER BY song) AS line, SUM(n)::BIGINT AS n FROM (SELECT video, song, COUNT(*) AS n FROM {OCC} WHERE unknown GROUP BY ALL) GROUP BY video")
def review_report(spark: SparkSession, d: str) -> DataFrame:
    """Dirty candidates by video, as lines of a report with all their songs."""
    songs = occurrences(spark, d).where("unknown").groupBy("video", "song").agg(count().alias("n"))
    bad = songs.groupBy("video").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("song")).alias("songs"))
    return bad.select("video", F.concat(F.lit("- "), F.col("video").cast("string"), F.lit(": "), F.concat_ws(", ", F.col("songs").cast("array<string>"))).alias("line"), "n")


PAGES_SQL = f"SELECT song, n, (ROW_NUMBER() OVER (ORDER BY n DESC, song) - 1) // 50 + 1 AS page FROM (SELECT song, COUNT(*) AS n FROM {OCC} WHERE {{}} GROUP BY song)"


def _pages(o: DataFrame) -> DataFrame:
    n = o.groupBy("song").agg(count().alias("n"))
    return core.ordinal(n, [F.desc("n"), F.asc("song")]).select("song", "n", F.ceil(F.col("rank") / 50).cast("bigint").alias("page"))


@q("published_pages", PAGES_SQL.format("TRUE"))
def published_pages(spark: SparkSession, d: str) -> DataFrame:
    """Ranking pages as files named by digests, with a manifest; read back and verified."""
    folder = new_folder(spark)
    manifest, _ = pages.published(folder, _pages(occurrences(spark, d)), "song")
    return pages.verified(folder, manifest, "song bigint, n bigint", "song").select("song", "n", "page")


@q(
    "changed_pages",
    f"""WITH a AS (SELECT page, string_agg(song || ':' || n, ',' ORDER BY song) AS h FROM ({PAGES_SQL.format("TRUE")}) GROUP BY page), b AS (SELECT page, string_agg(song || ':' || n, ',' ORDER BY song) AS h FROM ({PAGES_SQL.format("song % 100 < 98 OR song > 150")}) GROUP BY page)
        SELECT COALESCE(a.page, b.page) AS page, CASE WHEN b.page IS NULL THEN 'pruned' WHEN a.h = b.h THEN 'kept' ELSE 'written' END AS change, COALESCE(b.h, '') AS content FROM a FULL JOIN b ON a.page = b.page""",
)
def changed_pages(spark: SparkSession, d: str) -> DataFrame:
    """Of a second version only changed pages are written, pages that it lacks are deleted; and what is then read."""
    o, folder = materialized(occurrences(spark, d)), new_folder(spark)
    first, _ = pages.published(folder, _pages(o), "song")
    second, done = pages.published(folder, _pages(o.where("song % 100 < 98 OR song > 150")), "song", first)
    rows = pages.verified(folder, second, "song bigint, n bigint", "song")
    line = F.struct("song", F.concat_ws(":", "song", "n").alias("line"))
    content = rows.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda r: r["line"]), ",").alias("content"))
    return done.join(content, "page", "left").select("page", "change", F.coalesce("content", F.lit("")).alias("content"))


@q(
    "revision_activation",
    """WITH v AS (SELECT o_orderkey AS k, o_totalprice AS p, 1 AS depth, FALSE AS gone FROM orders UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_totalprice + 1 END, 0, o_orderkey % 10 = 0 FROM orders WHERE o_orderkey % 5 = 0)
       SELECT k, p, depth::BIGINT AS depth, 3::BIGINT AS activations, 2::BIGINT AS refused FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY depth) AS rn FROM v) WHERE rn = 1 AND NOT gone""",
)
def revision_activation(spark: SparkSession, d: str) -> DataFrame:
    """Revisions hold what differs from their parent; activations compare and set.

    Refused: a revision of another digest, and one whose parent is no longer active. The last
    activation is a rollback of a third revision to the second.
    """
    k, price = F.col("o_orderkey").alias("k"), F.col("o_totalprice")
    o, store = table(spark, d, "orders"), Store(spark, new_folder(spark))
    row = lambda df, p, gone: df.select(k, p.cast("double").alias("p"), gone.alias("gone"))
    stone = F.col("o_orderkey") % 10 == 0
    base = store.write("r1", None, row(o, price, F.lit(False)))
    child = store.write("r2", "r1", row(o.where("o_orderkey % 5 = 0"), F.when(~stone, price + 1), stone))
    other = store.write("r3", "r1", row(o.where("o_orderkey % 7 = 0"), price + 2, F.lit(False)))
    store.activate("r1", None, base)
    refused = 0
    for revision, parent, digest in (("r2", "r1", base), ("r3", "r1", other), ("r2", "r1", child), ("r2", "r3", child)):
        try:
            store.activate(revision, parent, digest)
        except Conflict:
            refused += 1
    return store.resolved("k", "gone").select("k", "p", "depth", F.lit(len(store.activations())).cast("bigint").alias("activations"), F.lit(refused).cast("bigint").alias("refused"))


@q("month_stable_keys", "SELECT o_orderkey, left(sha256(o_orderkey::VARCHAR || chr(31) || o_orderstatus), 24) AS id FROM orders")
def month_stable_keys(spark: SparkSession, d: str) -> DataFrame:
    """Content ids of 24 hex digits."""
    return table(spark, d, "orders").select("o_orderkey", tx.stable_key(F.col("o_orderkey"), F.col("o_orderstatus"), length=24).alias("id"))
