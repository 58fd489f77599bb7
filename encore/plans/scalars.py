"""Plans of scalar functions (section I)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.functions import kana
from encore.functions import parsing
from encore.functions import text as tx
from encore.plans.common import count
from encore.plans.registry import Registry, table

reg = Registry()
q = reg.register


def of_part(key: str, oracle: str, name: str, value: Callable[[Column, Column], Column], note: str) -> None:
    """A plan of one expression of p_name and p_brand over the part table."""

    def plan(spark: SparkSession, d: str) -> DataFrame:
        return table(spark, d, "part").select("p_partkey", value(F.col("p_name"), F.col("p_brand")).alias(name))

    plan.__doc__ = note
    q(key, f"SELECT p_partkey, {oracle} AS {name} FROM part")(plan)


def decorated(name: Column) -> Column:
    return F.concat(F.lit("1. M2 "), name, F.lit(" (Live)"))


of_part("normalize_key", r"lower(regexp_replace(p_name || ' ' || p_brand, '[\s\p{P}\p{S}]+', '', 'g'))", "key", lambda name, brand: tx.entity_key(F.concat(name, F.lit(" "), brand)), "I01.")
of_part("letters_digits_key", r"lower(regexp_replace(p_brand, '[^\p{L}\p{N}]+', '', 'g'))", "key", lambda name, brand: tx.letters_digits(brand), "I02.")
of_part("work_title_key", "regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g')", "key", lambda name, brand: tx.work_key(decorated(name)), "I05: list marks and the variant go.")
of_part("variant_split", "'live'", "variant", lambda name, brand: tx.variant_of(decorated(name)), "I06.")
of_part("strip_list_marker", "p_name", "title", lambda name, brand: tx.without_list_marker(F.concat(F.lit("#01) 2. "), name)), "I07.")
of_part("translate_chars", "p_name || ' 12:34'", "title", lambda name, brand: tx.half_width(F.concat(name, F.lit(" １２：３４"))), "I08.")
of_part("split_title_artist", "p_name || '|' || p_brand", "parts", lambda name, brand: F.concat_ws("|", parsing.title_of(F.concat(name, F.lit(" / "), brand)), parsing.artist_of(F.concat(name, F.lit(" / "), brand))), "I09.")
of_part("strip_years", "p_name", "title", lambda name, brand: tx.without_years(F.concat(name, F.lit(" (1999) 2004"))), "I11.")
of_part("strip_emoji", "p_name", "title", lambda name, brand: tx.without_emoji(F.concat(F.lit("\U0001f3b5"), name, F.lit(" :_note:"))), "I12.")
of_part("stable_key", "left(sha256(p_name || chr(31) || p_brand), 16)", "id", lambda name, brand: tx.stable_key(name, brand), "I20.")
of_part("search_score", "CASE WHEN lower(p_name) = 'small ring' THEN 1000 WHEN starts_with(lower(p_name), 'small ring') THEN 850 WHEN contains(' ' || lower(p_name) || ' ', ' small ring ') THEN 700 WHEN contains(lower(p_name), 'small ring') THEN 550 ELSE -1 END::BIGINT", "score", lambda name, brand: tx.search_score(name, "small ring"), "I23.")
of_part("quality_score", "((CASE WHEN length(p_name) BETWEEN 5 AND 30 THEN 2 ELSE 0 END) + (CASE WHEN contains(p_name, ' ') THEN 1 ELSE 0 END) - (CASE WHEN regexp_matches(p_name, '^[a-d]') THEN 1 ELSE 0 END))::BIGINT", "score", lambda name, brand: (F.when(F.length(name).between(5, 30), 2).otherwise(0) + F.when(name.contains(" "), 1).otherwise(0) - F.when(name.rlike("^[a-d]"), 1).otherwise(0)).cast("bigint"), "I26.")
of_part("search_text", "lower(p_name || ' ' || p_brand || ' ' || p_type)", "text", lambda name, brand: F.lower(F.concat_ws(" ", name, brand, F.col("p_type"))), "I34.")
of_part("bucket_id", "(ascii(p_name) % 64)::BIGINT", "bucket", lambda name, brand: (F.ascii(name) % 64).cast("bigint"), "I35.")
of_part("math_funcs", "concat_ws(',', floor(p_retailprice / 7)::BIGINT, ceil(p_retailprice / 7)::BIGINT, least(greatest(p_size, 10), 40)::BIGINT, COALESCE((p_size // NULLIF(p_size % 3, 0))::BIGINT, -1))", "all", lambda name, brand: F.concat_ws(",", F.floor(F.col("p_retailprice") / 7).cast("bigint"), F.ceil(F.col("p_retailprice") / 7).cast("bigint"), F.least(F.greatest("p_size", F.lit(10)), F.lit(40)).cast("bigint"), F.coalesce(F.floor(F.try_divide(F.col("p_size"), F.col("p_size") % 3)).cast("bigint"), F.lit(-1))), "I32.")


@q("clean_text", r"SELECT doc_id, trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'), ' ') AS text FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    """I03."""
    return table(spark, d, "documents").select("doc_id", tx.clean(F.col("text")).alias("text"))


@q("strip_accents", "SELECT doc_id, translate(text, '" + tx.ACCENTED + "', '" + tx._base(tx.ACCENTED) + "') AS text FROM documents")
def strip_accents(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts of all languages."""
    return table(spark, d, "documents").select("doc_id", tx.without_accents(F.col("text")).alias("text"))


@q("split_parts", "SELECT p_partkey, p_name || ' (a, b)|' || p_brand || '|x' AS parts FROM part")
def split_parts(spark: SparkSession, d: str) -> DataFrame:
    """Names split at separators outside brackets."""
    raw = F.concat("p_name", F.lit(" (a, b) & "), "p_brand", F.lit(" + x"))
    return table(spark, d, "part").select("p_partkey", parsing.split_parts(raw).alias("parts")).select("p_partkey", F.concat_ws("|", "parts").alias("parts"))


@q("hms_to_seconds", "SELECT event_id, (event_id % 36000)::BIGINT AS seconds FROM events")
def hms_to_seconds(spark: SparkSession, d: str) -> DataFrame:
    """I13."""
    return table(spark, d, "events").select("event_id", tx.hms_seconds(tx.seconds_hms(F.col("event_id") % 36000)).alias("seconds"))


@q("seconds_to_hms", "SELECT event_id, (s // 3600) || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS hms FROM (SELECT event_id, event_id % 36000 AS s FROM events)")
def seconds_to_hms(spark: SparkSession, d: str) -> DataFrame:
    """I14."""
    return table(spark, d, "events").select("event_id", tx.seconds_hms(F.col("event_id") % 36000).alias("hms"))


@q("explode_lines", "SELECT doc_id, (idx - 1)::BIGINT AS line, length(x)::BIGINT AS n FROM (SELECT doc_id, UNNEST(string_split(text, chr(10))) AS x, GENERATE_SUBSCRIPTS(string_split(text, chr(10)), 1) AS idx FROM documents)")
def explode_lines(spark: SparkSession, d: str) -> DataFrame:
    """One row per line, with its ordinal."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "x")).select("doc_id", F.col("line").cast("bigint").alias("line"), F.length("x").cast("bigint").alias("n"))


@q("relative_time", "SELECT event_id, epoch_us(TIMESTAMP '2024-01-31' - CASE WHEN event_id % 3 = 0 THEN to_days((event_id % 30)::INT) WHEN event_id % 3 = 1 THEN to_hours(event_id % 30) ELSE to_days(1) END) AS us FROM events")
def relative_time(spark: SparkSession, d: str) -> DataFrame:
    """I16: "n days ago", "n hours ago" and yesterday, against a fixed now."""
    k, m = F.col("event_id") % 30, F.col("event_id") % 3
    phrase = F.when(m == 0, F.concat(k.cast("string"), F.lit(" days ago"))).when(m == 1, F.concat(k.cast("string"), F.lit(" hours ago"))).otherwise("昨日")
    return table(spark, d, "events").select("event_id", parsing.relative_micros(phrase, "2024-01-31 00:00:00").alias("us"))


@q("parse_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def parse_date(spark: SparkSession, d: str) -> DataFrame:
    """YYYY年M月D日."""
    raw = F.concat(F.year("o_orderdate"), F.lit("年"), F.month("o_orderdate"), F.lit("月"), F.dayofmonth("o_orderdate"), F.lit("日"))
    return table(spark, d, "orders").select("o_orderkey", parsing.written_date(raw).cast("string").alias("day"))


@q("epoch_coerce", "SELECT event_id, epoch_us(ts) // 1000000 * 1000 AS ms FROM events")
def epoch_coerce(spark: SparkSession, d: str) -> DataFrame:
    """Seconds or milliseconds, as milliseconds."""
    s = F.unix_seconds(F.col("ts").cast("timestamp"))
    raw = F.when(F.col("event_id") % 2 == 0, s).otherwise(s * 1000)
    return table(spark, d, "events").select("event_id", F.when(raw < 10**12, raw * 1000).otherwise(raw).alias("ms"))


@q("iso_day", "SELECT strftime(ts, '%Y-%m-%d') AS day, COUNT(*) AS n FROM events GROUP BY 1")
def iso_day(spark: SparkSession, d: str) -> DataFrame:
    """I19."""
    return table(spark, d, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(count().alias("n"))


@q("fnv1a", "SELECT p_partkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295)::BIGINT AS h FROM part")
def fnv1a(spark: SparkSession, d: str) -> DataFrame:
    """The 32-bit FNV-1a hash, for jitter."""
    return table(spark, d, "part").select("p_partkey", parsing.fnv1a("p_name").alias("h"))


@q("retry_ladder", "SELECT event_id, GREATEST(1, [60, 300, 1800, 7200, 43200][(event_id % 5 + 1)::INT] * (80 + event_id % 41) // 100)::BIGINT AS wait FROM events")
def retry_ladder(spark: SparkSession, d: str) -> DataFrame:
    """A ladder of waits, a fifth more or less."""
    base = F.element_at(F.array(*map(F.lit, (60, 300, 1800, 7200, 43200))), (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", F.greatest(F.lit(1).cast("bigint"), F.floor(base * (80 + F.col("event_id") % 41) / 100).cast("bigint")).alias("wait"))


@q("kana_romaji", "SELECT * FROM (VALUES ('きょうと', 'kyouto'), ('がっこう', 'gakkou'), ('ラーメン', 'raamen')) v(name, latin)")
def kana_romaji(spark: SparkSession, d: str) -> DataFrame:
    """I24."""
    names = spark.createDataFrame([("きょうと",), ("がっこう",), ("ラーメン",)], "name string")
    return names.select("name", kana.romanized("name").alias("latin"))


@q("url_parts", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages")
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    """I27, M13."""
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/:?#]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1).alias("path"))


@q("build_link", "SELECT event_id, 'watch?v=' || user_id || '&t=' || (event_id % 600) || 's' AS link FROM events")
def build_link(spark: SparkSession, d: str) -> DataFrame:
    """I28."""
    return table(spark, d, "events").select("event_id", F.concat(F.lit("watch?v="), F.col("user_id").cast("string"), F.lit("&t="), (F.col("event_id") % 600).cast("string"), F.lit("s")).alias("link"))


@q("array_funcs", "SELECT vec_id, len(embedding)::BIGINT AS n, ROUND(list_max(embedding)::DOUBLE, 5) AS top, list_contains(embedding, embedding[1]) AS has FROM embeddings")
def array_funcs(spark: SparkSession, d: str) -> DataFrame:
    """I31."""
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.size(e).cast("bigint").alias("n"), F.round(F.array_max(e).cast("double"), 5).alias("top"), F.array_contains(e, e[0]).alias("has"))


@q("array_forall_exists", "SELECT vec_id, len(list_filter(embedding, lambda x: x > -1)) = len(embedding) AS every, len(list_filter(embedding, lambda x: x > 0.2)) > 0 AS some FROM embeddings")
def array_forall_exists(spark: SparkSession, d: str) -> DataFrame:
    """Quantifiers over nested arrays."""
    return table(spark, d, "embeddings").select("vec_id", F.forall("embedding", lambda x: x > -1).alias("every"), F.exists("embedding", lambda x: x > F.lit(0.2).cast("double")).alias("some"))


@q("script_class", "SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{3040}-\\x{30FF}]') THEN 'kana' WHEN regexp_matches(text, '[\\x{4E00}-\\x{9FFF}]') THEN 'han' WHEN regexp_matches(text, '[\\x{00C0}-\\x{024F}]') THEN 'latin_accented' WHEN regexp_matches(text, '[A-Za-z]') THEN 'latin' ELSE 'other' END AS script FROM documents")
def script_class(spark: SparkSession, d: str) -> DataFrame:
    """I37."""
    return table(spark, d, "documents").select("doc_id", tx.script_class(F.col("text")).alias("script"))

