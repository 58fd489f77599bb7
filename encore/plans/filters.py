"""Plans of projections, filters and predicates (section C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.functions import text as tx
from encore.operators import core, search
from encore.plans.common import OCC, count, now, occurrences
from encore.plans.registry import Registry, table

reg = Registry()
q = reg.register

NOW_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
RANGES = {"today": 1, "3d": 3, "7d": 7, "30d": 30}


def calendar_bounds(days: int) -> tuple[F.Column, F.Column]:
    """UTC bounds of the last ``days`` calendar days in Shanghai: midnight there is 16:00 UTC."""
    eight = F.expr("INTERVAL 8 HOURS")
    midnight = F.date_trunc("day", (now() + eight).cast("timestamp_ntz"))
    end = midnight + F.expr("INTERVAL 1 DAY") - eight
    return end - F.expr(f"INTERVAL {days} DAYS"), end


@q("calendar_range_filter", " UNION ALL ".join(f"SELECT '{r}' AS range, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users FROM events WHERE ts >= TIMESTAMP '2024-01-31 16:00:00' - INTERVAL {n} DAY AND ts < TIMESTAMP '2024-01-31 16:00:00'" for r, n in RANGES.items()))
def calendar_range_filter(spark: SparkSession, d: str) -> DataFrame:
    """Each calendar range in one pass over the events of the longest."""
    e = table(spark, d, "events").where(F.col("ts") >= calendar_bounds(30)[0])
    hits = F.array_compact(F.array(*(F.when((F.col("ts") >= calendar_bounds(n)[0]) & (F.col("ts") < calendar_bounds(n)[1]), F.lit(r)) for r, n in RANGES.items())))
    found = e.select("user_id", F.explode(hits).alias("range")).groupBy("range").agg(count().alias("n"), F.countDistinct("user_id").alias("users"))
    names = spark.createDataFrame([(r,) for r in RANGES], "range string")
    return names.join(found, "range", "left").select("range", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("users", F.lit(0)).alias("users"))


@q("future_guard", f"SELECT event_type, COUNT(*) AS n FROM events WHERE ts IS NOT NULL AND ts <= {NOW_SQL} + INTERVAL 6 HOUR GROUP BY 1")
def future_guard(spark: SparkSession, d: str) -> DataFrame:
    """The unbounded range takes what is not more than six hours ahead."""
    return table(spark, d, "events").where(F.col("ts") <= now() + F.expr("INTERVAL 6 HOURS")).groupBy("event_type").agg(count().alias("n"))


@q("trailing_7d", f"SELECT event_type, COUNT(*) AS n FROM events WHERE ts BETWEEN {NOW_SQL} - INTERVAL 7 DAY AND {NOW_SQL} GROUP BY 1")
def trailing_7d(spark: SparkSession, d: str) -> DataFrame:
    """C03."""
    return table(spark, d, "events").where(F.col("ts").between(now() - F.expr("INTERVAL 7 DAYS"), now())).groupBy("event_type").agg(count().alias("n"))


@q("null_ts_policy", "SELECT COUNT(*) AS in_all, COUNT(*) FILTER (WHERE t >= TIMESTAMP '1998-01-01') AS in_window FROM (SELECT CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS t FROM orders)")
def null_ts_policy(spark: SparkSession, d: str) -> DataFrame:
    """Null times belong to the unbounded range and to no window."""
    t = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate"))
    return table(spark, d, "orders").select(t.alias("t")).agg(count().alias("in_all"), F.count_if(F.col("t") >= F.lit("1998-01-01").cast("timestamp_ntz")).alias("in_window"))


ALIASES = {"72h": "7d", "1m": "all", "view": "visit", "click": "visit"}


@q("alias_map", "SELECT CASE event_type WHEN 'view' THEN 'visit' WHEN 'click' THEN 'visit' ELSE event_type END AS kind, COUNT(*) AS n FROM events GROUP BY 1")
def alias_map(spark: SparkSession, d: str) -> DataFrame:
    """Alias names for ranges and kinds."""
    names = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return table(spark, d, "events").groupBy(F.coalesce(names[F.col("event_type")], F.col("event_type")).alias("kind")).agg(count().alias("n"))


@q("dnf_search", "SELECT p_partkey, p_name, p_brand FROM part WHERE (contains(lower(p_name || ' ' || p_brand), 'small') AND contains(lower(p_name || ' ' || p_brand), 'brand#2')) OR contains(lower(p_name || ' ' || p_brand), 'red widget')")
def dnf_search(spark: SparkSession, d: str) -> DataFrame:
    """C06."""
    return table(spark, d, "part").where(search.matches(search.haystack(F.col("p_name"), F.col("p_brand")), 'small AND brand#2 OR "red widget"')).select("p_partkey", "p_name", "p_brand")


@q("and_token_search", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'than') AND contains(lower(text), 'the ') AND lang = 'en'")
def and_token_search(spark: SparkSession, d: str) -> DataFrame:
    """C07."""
    low = F.lower("text")
    return table(spark, d, "documents").where((F.col("lang") == "en") & low.contains("than") & low.contains("the ")).select("doc_id", "lang")


@q("like_escape", "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE '%d#1%' ESCAPE '!'")
def like_escape(spark: SparkSession, d: str) -> DataFrame:
    """No sign of the needle is a wildcard."""
    return table(spark, d, "part").where(F.col("p_brand").contains("d#1")).select("p_partkey", "p_brand")


def scoped(df: DataFrame, fields: list[str], needle: str) -> DataFrame:
    """The search looks at the fields of its scope alone."""
    return df.where(search.matches(search.haystack(*map(F.col, fields)), needle))


@q("search_scope_title", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def search_scope_title(spark: SparkSession, d: str) -> DataFrame:
    return scoped(table(spark, d, "part"), ["p_name"], "ring").select("p_partkey", "p_name")


@q("search_scope_artist", "SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), '00001')")
def search_scope_artist(spark: SparkSession, d: str) -> DataFrame:
    return scoped(table(spark, d, "supplier"), ["s_name"], "00001").select("s_suppkey", "s_name")


@q("having_min_count", f"SELECT song, COUNT(*) AS n FROM {OCC} GROUP BY song HAVING COUNT(*) >= 35")
def having_min_count(spark: SparkSession, d: str) -> DataFrame:
    """C11."""
    return occurrences(spark, d).groupBy("song").agg(count().alias("n")).where("n >= 35")


@q("scope_filters", f"SELECT COUNT(*) AS n, COUNT(DISTINCT song) AS songs FROM {OCC} WHERE niche AND NOT unknown")
def scope_filters(spark: SparkSession, d: str) -> DataFrame:
    """C12."""
    return occurrences(spark, d).where("niche AND NOT unknown").agg(count().alias("n"), F.countDistinct("song").alias("songs"))


def scopes() -> F.Column:
    return F.explode(F.array_compact(F.array(F.lit("all"), F.when(~F.col("unknown"), F.lit("visible")), F.when(F.col("niche"), F.lit("niche")), F.when(F.col("niche") & ~F.col("unknown"), F.lit("visibleNiche"))))).alias("scope")


@q("four_scopes", f"SELECT scope, artist, COUNT(*) AS n FROM (SELECT artist, UNNEST(list_filter(['all', CASE WHEN NOT unknown THEN 'visible' END, CASE WHEN niche THEN 'niche' END, CASE WHEN niche AND NOT unknown THEN 'visibleNiche' END], lambda x: x IS NOT NULL)) AS scope FROM {OCC}) GROUP BY ALL")
def four_scopes(spark: SparkSession, d: str) -> DataFrame:
    """All scopes from one pass."""
    return occurrences(spark, d).select("artist", scopes()).groupBy("scope", "artist").agg(count().alias("n"))


@q(
    "blocklist_anti",
    "SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'id' WHEN c_name LIKE '%7' AND c_nationkey < 3 THEN 'name' END AS field FROM customer WHERE c_custkey % 50 = 0 OR (c_name LIKE '%7' AND c_nationkey < 3)",
)
def blocklist_anti(spark: SparkSession, d: str) -> DataFrame:
    """C14: the first field by which a channel is on the block list: id, then name."""
    c = table(spark, d, "customer")
    ids = c.where("c_custkey % 50 = 0").select(F.col("c_custkey").alias("block_id"))
    names = c.where("c_name LIKE '%7' AND c_nationkey < 3").select(F.col("c_name").alias("block_name")).distinct()
    hit = c.join(ids, F.col("c_custkey") == F.col("block_id"), "left").join(names, F.col("c_name") == F.col("block_name"), "left")
    field = F.when(F.col("block_id").isNotNull(), "id").when(F.col("block_name").isNotNull(), "name")
    return hit.select("c_custkey", field.alias("field")).where("field IS NOT NULL")


@q("array_exists", "SELECT user_id FROM events GROUP BY user_id HAVING bool_or(contains(event_type, 'purch'))")
def array_exists(spark: SparkSession, d: str) -> DataFrame:
    """Any keyword of a video contains the needle."""
    tags = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("tags"))
    return tags.where(F.exists("tags", lambda t: F.contains(t, F.lit("purch")))).select("user_id")


@q(
    "trend_class",
    "SELECT k, now, before, CASE WHEN before = 0 THEN 'new' WHEN now > before THEN 'up' WHEN now < before THEN 'down' ELSE 'none' END AS trend FROM (SELECT o_custkey AS k, COUNT(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS now, COUNT(*) FILTER (WHERE o_orderdate < TIMESTAMP '1998-01-01') AS before FROM orders GROUP BY 1)",
)
def trend_class(spark: SparkSession, d: str) -> DataFrame:
    """C16, I36."""
    late = F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")
    g = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count_if(late).alias("now"), F.count_if(~late).alias("before"))
    return g.withColumn("trend", F.when(F.col("before") == 0, "new").when(F.col("now") > F.col("before"), "up").when(F.col("now") < F.col("before"), "down").otherwise("none"))


@q("compact_preview", f"SELECT song, array_to_string(list_sort(list(DISTINCT video))[1:3], ',') AS preview FROM {OCC} GROUP BY song")
def compact_preview(spark: SparkSession, d: str) -> DataFrame:
    """C17: previews of three."""
    return core.first_values(occurrences(spark, d), ["song"], "video", 3).select("song", F.concat_ws(",", F.col("values").cast("array<string>")).alias("preview"))


@q("regex_filter", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '^[A-Za-z]+#0*[1-9]0$')")
def regex_filter(spark: SparkSession, d: str) -> DataFrame:
    """C18."""
    return table(spark, d, "customer").where(F.col("c_name").rlike("^[A-Za-z]+#0*[1-9]0$")).select("c_custkey")


#: Ordered rules of non-song text: a reason and its pattern.
RULES = (("shouting", "[A-Z]{4,}!! [A-Z]{4,}!!"), ("table", r"\w \| \w+ \| "), ("decorated", r"(\$\$\$|###|&&&|%%%)"), ("contact", "@mail[0-9]"), ("secret", "(password=|token = |AKIA)"), ("licence", "MIT License"))
RULES_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{r}'" for r, p in RULES) + " END"


def first_reason(x: F.Column) -> F.Column:
    out = F
    for reason, pattern in RULES:
        out = out.when(x.rlike(pattern), reason)
    return out


@q("rule_cascade", f"SELECT doc_id, {RULES_SQL} AS reason FROM documents")
def rule_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The first rule that holds gives the reason."""
    return table(spark, d, "documents").select("doc_id", first_reason(F.col("text")).alias("reason"))


@q("marker_rules", "SELECT p_partkey, p_name IN ('red widget', 'small ring') OR regexp_matches(p_name, '^large ') AS marked FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')")
def marker_rules(spark: SparkSession, d: str) -> DataFrame:
    """C20: exact titles and patterns, for unknown artists alone."""
    unknown = F.col("p_brand").isin("Brand#1", "Brand#2", "Brand#3")
    return table(spark, d, "part").where(unknown).select("p_partkey", (F.col("p_name").isin("red widget", "small ring") | F.col("p_name").rlike("^large ")).alias("marked"))


@q("quarantine_reason", f"SELECT reason, COUNT(*) AS n FROM (SELECT COALESCE(CASE WHEN n_chars < 50 THEN 'too_short' END, {RULES_SQL}) AS reason FROM documents) WHERE reason IS NOT NULL GROUP BY 1")
def quarantine_reason(spark: SparkSession, d: str) -> DataFrame:
    """C21."""
    reason = F.coalesce(F.when(F.col("n_chars") < 50, "too_short"), first_reason(F.col("text")))
    return table(spark, d, "documents").select(reason.alias("reason")).where("reason IS NOT NULL").groupBy("reason").agg(count().alias("n"))


@q("multi_label_reasons", "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{r}' END" for r, p in RULES) + ") AS reasons FROM documents")
def multi_label_reasons(spark: SparkSession, d: str) -> DataFrame:
    """All reasons of a row."""
    return table(spark, d, "documents").select("doc_id", F.concat_ws(",", *(F.when(F.col("text").rlike(p), F.lit(r)) for r, p in RULES)).alias("reasons"))


@q("import_audit", "SELECT d.doc_id, CASE WHEN quality = 0 AND toxic = 1 THEN 'drop' WHEN quality = 0 OR toxic = 1 THEN 'suspicious' ELSE 'accept' END AS decision, CASE WHEN quality = 0 THEN 'quality' WHEN toxic = 1 THEN 'toxic' END AS reason FROM documents d JOIN labels l USING (doc_id)")
def import_audit(spark: SparkSession, d: str) -> DataFrame:
    """C23."""
    rows = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id")
    bad, toxic = F.col("quality") == 0, F.col("toxic") == 1
    return rows.select("doc_id", F.when(bad & toxic, "drop").when(bad | toxic, "suspicious").otherwise("accept").alias("decision"), F.when(bad, "quality").when(toxic, "toxic").alias("reason"))


@q("numeric_token_match", "SELECT c_custkey FROM customer WHERE regexp_matches(c_name, '(^|[^0-9])0*17([^0-9]|$)')")
def numeric_token_match(spark: SparkSession, d: str) -> DataFrame:
    """17 as a whole number, leading zeros aside."""
    return table(spark, d, "customer").where(F.col("c_name").rlike("(?<![0-9])0*17(?![0-9])")).select("c_custkey")


@q("sentinel_null", "SELECT doc_id, CASE WHEN lower(trim(lang)) IN ('', 'unknown', 'n/a', '-', 'none', 'various', 'de') THEN NULL ELSE lang END AS lang FROM documents")
def sentinel_null(spark: SparkSession, d: str) -> DataFrame:
    """Stand-ins of an unknown value become null."""
    return table(spark, d, "documents").select("doc_id", F.when(tx.is_unknown(F.col("lang")) | (F.col("lang") == "de"), None).otherwise(F.col("lang")).alias("lang"))
