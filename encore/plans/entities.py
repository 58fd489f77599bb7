"""Plans of set operations, deduplication, entity resolution and curation (section H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from encore.functions import text as tx
from encore.operators import artists, core
from encore.operators.cluster import greedy_clusters
from encore.plans.common import OCC, count, occurrences
from encore.plans.registry import Registry, table
from encore.plans.windows import clusters_sql
from encore.session import materialized

reg = Registry()
q = reg.register


@q("union_dedupe", "SELECT o_orderkey, MIN_BY(s, seq) AS s FROM (SELECT o_orderkey, o_orderstatus AS s, 0 AS seq FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'B', 1 FROM orders WHERE o_orderkey % 3 = 0) GROUP BY 1")
def union_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """H01."""
    o = table(spark, d, "orders")
    return core.first_wins([o.where("o_orderkey % 2 = 0").select("o_orderkey", F.col("o_orderstatus").alias("s")), o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("B").alias("s"))], ["o_orderkey"])


@q("union_all_series", f"SELECT 'songs' AS series, song AS key, COUNT(*) AS n FROM {OCC} GROUP BY song UNION ALL SELECT 'artists', artist, COUNT(*) FROM {OCC} GROUP BY artist")
def union_all_series(spark: SparkSession, d: str) -> DataFrame:
    """Series from one scan of the facts."""
    keys = F.explode(F.array(F.struct(F.lit("songs").alias("series"), F.col("song").alias("key")), F.struct(F.lit("artists").alias("series"), F.col("artist").alias("key")))).alias("k")
    return occurrences(spark, d).select(keys).groupBy("k.series", "k.key").agg(count().alias("n"))


@q("set_except", "SELECT 'removed' AS side, o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 EXCEPT SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0) UNION ALL SELECT 'added', o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 EXCEPT SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0)")
def set_except(spark: SparkSession, d: str) -> DataFrame:
    """H03."""
    o = table(spark, d, "orders").select("o_orderkey")
    a, b = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0")
    return a.exceptAll(b).select(F.lit("removed").alias("side"), "o_orderkey").unionByName(b.exceptAll(a).select(F.lit("added").alias("side"), "o_orderkey"))


@q("set_intersect", f"SELECT song FROM {OCC} WHERE niche AND seconds = 50 INTERSECT SELECT song FROM {OCC} WHERE NOT niche AND seconds = 1")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    """H04."""
    o = occurrences(spark, d)
    return o.where("niche AND seconds = 50").select("song").intersect(o.where("NOT niche AND seconds = 1").select("song"))


@q("subset_check", f"SELECT video, COUNT(*) FILTER (WHERE NOT b) AS missing, COUNT(*) FILTER (WHERE NOT a) AS added FROM (SELECT video, song, bool_or(position <= 5) AS a, bool_or(position >= 3) AS b FROM {OCC} GROUP BY video, song) GROUP BY video")
def subset_check(spark: SparkSession, d: str) -> DataFrame:
    """Keys that two versions of a video do not share."""
    keys = occurrences(spark, d).groupBy("video", "song").agg(F.bool_or(F.col("position") <= 5).alias("a"), F.bool_or(F.col("position") >= 3).alias("b"))
    return keys.groupBy("video").agg(F.count_if(~F.col("b")).alias("missing"), F.count_if(~F.col("a")).alias("added"))


@q("array_union", "SELECT user_id, array_to_string(list_sort(list_distinct(list_concat(list(event_type) FILTER (WHERE event_id % 2 = 0), list(event_type) FILTER (WHERE event_id % 2 = 1)))), ',') AS kinds FROM events GROUP BY 1")
def array_union(spark: SparkSession, d: str) -> DataFrame:
    """H06."""
    even = F.col("event_id") % 2 == 0
    g = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.when(even, F.col("event_type"))).alias("a"), F.collect_set(F.when(~even, F.col("event_type"))).alias("b"))
    return g.select("user_id", F.concat_ws(",", F.array_sort(F.array_union("a", "b"))).alias("kinds"))


@q("upsert", "SELECT o_orderkey, o_orderstatus AS s FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT o_orderkey, 'N' FROM orders WHERE o_orderkey % 4 = 0")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    """H07."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"))
    return core.upsert(o, o.where("o_orderkey % 4 = 0").select("o_orderkey", F.lit("N").alias("s")), ["o_orderkey"])


@q("guarded_upsert", f"SELECT video, CASE WHEN new < old THEN old ELSE new END AS songs, CASE WHEN new < old THEN 'kept' ELSE 'taken' END AS audit FROM (SELECT video, COUNT(DISTINCT song) AS old, COUNT(DISTINCT CASE WHEN position <= 6 THEN song END) AS new FROM {OCC} GROUP BY video)")
def guarded_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A version that lost songs does not replace the old one."""
    g = occurrences(spark, d).groupBy("video").agg(F.countDistinct("song").alias("old"), F.countDistinct(F.when(F.col("position") <= 6, F.col("song"))).alias("new"))
    lost = F.col("new") < F.col("old")
    return g.select("video", F.when(lost, F.col("old")).otherwise(F.col("new")).alias("songs"), F.when(lost, "kept").otherwise("taken").alias("audit"))


@q("tombstone_hide", "SELECT user_id FROM (SELECT user_id, MAX_BY(event_type, (ts, event_id)) AS last FROM events GROUP BY 1) WHERE last <> 'error'")
def tombstone_hide(spark: SparkSession, d: str) -> DataFrame:
    """A key whose newest row is a tombstone is hidden."""
    last = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last"))
    return last.where("last <> 'error'").select("user_id")


@q("exact_dedupe", f"SELECT COUNT(*) AS n FROM (SELECT DISTINCT video, song, seconds, artist FROM {OCC})")
def exact_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """H10."""
    return occurrences(spark, d).dropDuplicates(["video", "song", "seconds", "artist"]).agg(count().alias("n"))


@q("near_dedupe_3s", f"SELECT DISTINCT video, song, leader FROM ({clusters_sql(3)})")
def near_dedupe_3s(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one song within three seconds of the first are one."""
    return greedy_clusters(occurrences(spark, d).select("video", "song", "seconds"), ["video", "song"], "seconds", 3).select("video", "song", "leader").distinct()


@q("same_second_dedupe", f"SELECT video, seconds, song, artist, MIN(position) AS position FROM {OCC} GROUP BY video, seconds, song, artist")
def same_second_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one second, song and artist are one, the first."""
    return occurrences(spark, d).groupBy("video", "seconds", "song", "artist").agg(F.min("position").alias("position"))


@q("mixed_script_drop", "SELECT doc_id FROM documents d WHERE NOT (lang = 'en' AND source IN (SELECT source FROM documents GROUP BY source HAVING COUNT(*) FILTER (WHERE lang = 'fr') >= 2 AND COUNT(*) FILTER (WHERE lang = 'en') >= 2))")
def mixed_script_drop(spark: SparkSession, d: str) -> DataFrame:
    """Translated aliases go where both scripts occur twice."""
    x = table(spark, d, "documents").select("doc_id", "lang", "source")
    mixed = x.groupBy("source").agg(F.count_if(F.col("lang") == "fr").alias("fr"), F.count_if(F.col("lang") == "en").alias("en")).where("fr >= 2 AND en >= 2").select("source", F.lit(True).alias("mixed"))
    return x.join(mixed, "source", "left").where(~(F.coalesce("mixed", F.lit(False)) & (F.col("lang") == "en"))).select("doc_id")


@q("base_key_merge", "SELECT split_part(p_name, ' ', 1) AS base, COUNT(*) AS n, COUNT(DISTINCT p_name) AS variants FROM part GROUP BY 1")
def base_key_merge(spark: SparkSession, d: str) -> DataFrame:
    """Names merge into their base."""
    return table(spark, d, "part").groupBy(F.substring_index("p_name", " ", 1).alias("base")).agg(count().alias("n"), F.countDistinct("p_name").alias("variants"))


ALIASES = [("ECONOMY", "BUDGET"), ("PROMO", "BUDGET"), ("STANDARD", "REGULAR")]


@q("curated_alias", "SELECT CASE p_type WHEN 'ECONOMY' THEN 'BUDGET' WHEN 'PROMO' THEN 'BUDGET' WHEN 'STANDARD' THEN 'REGULAR' ELSE p_type END AS kind, COUNT(*) AS n FROM part GROUP BY 1")
def curated_alias(spark: SparkSession, d: str) -> DataFrame:
    """H15."""
    aliases = spark.createDataFrame(ALIASES, "p_type string, canonical string")
    return table(spark, d, "part").join(F.broadcast(aliases), "p_type", "left").groupBy(F.coalesce("canonical", "p_type").alias("kind")).agg(count().alias("n"))


#: Names and counts of a title, what becomes of them, by the remainder of the part's key; T is the part's name.
KANA_FORMS = (
    ((("さくら", 3), ("SAKURA T", 2)), (("さくら", 5),)),
    ((("しょうじょ", 1), ("shoujotai", 4)), (("shoujotai", 5),)),
    ((("きょうと", 2), ("kyouto", 1), ("kyouto T", 1)), (("きょうと", 4),)),
    ((("いえ", 1), ("ie T", 1)), (("いえ", 1), ("ie T", 1))),
    ((("さくら", 1), ("Hana", 1)), (("さくら", 1), ("Hana", 1))),
    ((("ほしの", 2), ("ホシノ", 2), ("hoshino", 2), ("T hoshino", 2)), (("ほしの", 2), ("ホシノ", 2), ("hoshino", 2), ("T hoshino", 2))),
)
PARTIAL_FORMS = (
    ((("T", 3), ("T band", 1)), (("T", 4),)),
    ((("T", 1), ("T band", 1), ("T two", 1)), (("T", 3),)),
    ((("T", 1), ("T & band", 5)), (("T", 1), ("T & band", 5))),
    ((("さくら音楽", 1), ("さくら音楽隊", 2)), (("さくら音楽隊", 3),)),
    ((("さくら", 1), ("さくら隊", 2)), (("さくら", 1), ("さくら隊", 2))),
    ((("cover", 1), ("cover band", 2)), (("cover", 1), ("cover band", 2))),
    ((("ring", 1), ("ring of a very long name", 2)), (("ring", 1), ("ring of a very long name", 2))),
    ((("T", 2), ("xT", 1)), (("T", 2), ("xT", 1))),
    ((("T", 2), ("T feat. U", 1)), (("T", 2), ("T feat. U", 1))),
    ((("T", 1), ("U T", 4), ("T-live", 9)), (("T-live", 14),)),
)


def forms_sql(forms: tuple, side: int) -> str:
    rows = ", ".join(f"({i}, '{a}', {n})" for i, form in enumerate(forms) for a, n in form[side])
    return f"SELECT p_partkey::VARCHAR AS title, replace(a, 'T', p_name) AS artist, n::BIGINT AS n FROM part JOIN (VALUES {rows}) v(i, a, n) ON p_partkey % {len(forms)} = i"


def names_of_forms(spark: SparkSession, d: str, forms: tuple) -> DataFrame:
    """Records of a title for every part, in the form of its key."""
    lists = F.array(*(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(n).cast("bigint").alias("n")) for a, n in form[0])) for form in forms))
    x = table(spark, d, "part").select("p_partkey", "p_name", F.explode(F.get(lists, (F.col("p_partkey") % len(forms)).cast("int"))).alias("x"))
    return x.select(F.col("p_partkey").cast("string").alias("title"), F.replace("x.a", F.lit("T"), "p_name").alias("artist"), F.col("x.n").alias("n"))


@q("romaji_merge", forms_sql(KANA_FORMS, 1))
def romaji_merge(spark: SparkSession, d: str) -> DataFrame:
    """Kana and Latin names of a title that sound alike merge while one has a single match."""
    records = names_of_forms(spark, d, KANA_FORMS)
    return artists.merged(records, artists.dominant_targets(records, artists.kana_pairs(records), materialized))


RECORDS_SQL = "(SELECT p_name AS title, p_brand AS artist, COUNT(*) AS n FROM part GROUP BY ALL)"


def records(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_name").alias("title"), F.col("p_brand").alias("artist")).agg(count().alias("n"))


@q(
    "typo_merge",
    f"""WITH r AS {RECORDS_SQL}, p AS (SELECT a.title, a.artist, b.artist AS target FROM r a JOIN r b ON a.title = b.title AND a.n = 1 AND b.n >= 3 AND length(a.artist) >= 6 AND length(b.artist) >= 6 AND levenshtein(a.artist, b.artist) = 1),
        t AS (SELECT title, artist, MIN(target) AS target FROM p GROUP BY ALL HAVING COUNT(*) = 1)
        SELECT r.title, COALESCE(target, r.artist) AS artist, SUM(n)::BIGINT AS n FROM r LEFT JOIN t ON t.title = r.title AND t.artist = r.artist GROUP BY ALL""",
)
def typo_merge(spark: SparkSession, d: str) -> DataFrame:
    """A name seen once joins the one name of its title, seen three times or more, that is one edit away."""
    r = records(spark, d)
    return artists.merged(r, artists.typo_targets(r))


@q("levenshtein_scalar", "SELECT p_partkey, levenshtein(p_name, 'small ring')::BIGINT AS d, levenshtein(p_name, 'small ring') <= 1 AS within_one FROM part")
def levenshtein_scalar(spark: SparkSession, d: str) -> DataFrame:
    """Edits, and whether there is one at most (which stops early)."""
    name, other = F.col("p_name"), F.lit("small ring")
    return table(spark, d, "part").select("p_partkey", F.levenshtein(name, other).cast("bigint").alias("d"), (F.levenshtein(name, other, 1) >= 0).alias("within_one"))


@q("partial_name_merge", forms_sql(PARTIAL_FORMS, 1))
def partial_name_merge(spark: SparkSession, d: str) -> DataFrame:
    """Names that begin or end longer ones of their title merge while one has a single match."""
    records = names_of_forms(spark, d, PARTIAL_FORMS)
    return artists.merged(records, artists.dominant_targets(records, artists.partial_pairs(records), materialized))


def _fold_unknown(o: DataFrame) -> DataFrame:
    m = core.mode(o.where("NOT unknown"), ["song"], "artist").select("song", F.col("artist").alias("owner"))
    artist = F.coalesce(F.when(F.col("unknown"), F.col("owner")).otherwise(F.col("artist")), F.lit(-1))
    counted = o.groupBy("song", "artist", "unknown").agg(count().alias("n"))
    return counted.join(m, "song", "left").groupBy("song", artist.alias("artist")).agg(F.sum("n").alias("n"))


@q("fold_unknown", f"WITH m AS (SELECT song, MIN_BY(artist, (-n, artist)) AS owner FROM (SELECT song, artist, COUNT(*) AS n FROM {OCC} WHERE NOT unknown GROUP BY ALL) GROUP BY song) SELECT o.song, COALESCE(CASE WHEN unknown THEN owner ELSE artist END, -1) AS artist, COUNT(*) AS n FROM {OCC} o LEFT JOIN m USING (song) GROUP BY ALL")
def fold_unknown(spark: SparkSession, d: str) -> DataFrame:
    """H19."""
    return _fold_unknown(occurrences(spark, d))


@q("final_merge", "SELECT lower(p_name) AS work, lower(p_brand) AS artist, COUNT(*) AS n, MIN(p_partkey) AS first FROM part GROUP BY ALL")
def final_merge(spark: SparkSession, d: str) -> DataFrame:
    """H20."""
    return table(spark, d, "part").groupBy(F.lower("p_name").alias("work"), F.lower("p_brand").alias("artist")).agg(count().alias("n"), F.min("p_partkey").alias("first"))


@q("canonical_pick", "SELECT p_brand, MIN_BY(p_name, (-n, length(p_name), p_name)) AS name FROM (SELECT p_brand, p_name, COUNT(*) AS n FROM part GROUP BY ALL) GROUP BY p_brand")
def canonical_pick(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent, then the shortest, then the first."""
    n = table(spark, d, "part").groupBy("p_brand", "p_name").agg(count().alias("n"))
    return n.groupBy("p_brand").agg(F.min_by("p_name", F.struct(-F.col("n"), F.length("p_name"), "p_name")).alias("name"))


@q("apply_overrides", "SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'replaced' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 11 <> 0 OR o_orderkey % 7 = 0")
def apply_overrides(spark: SparkSession, d: str) -> DataFrame:
    """force_keep is stronger than drop, drop than replace."""
    k = F.col("o_orderkey")
    dropped = (k % 11 == 0) & ~(k % 7 == 0)
    return table(spark, d, "orders").where(~dropped).select("o_orderkey", F.when(k % 13 == 0, "replaced").otherwise(F.col("o_orderstatus")).alias("s"))


@q("curate_pipeline", f"SELECT video, song, MIN(seconds) AS seconds FROM {OCC} WHERE video % 17 <> 0 AND NOT (unknown AND niche) GROUP BY video, song")
def curate_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Drop videos, drop classified rows, fold repeats."""
    o = occurrences(spark, d).where("video % 17 <> 0").where("NOT (unknown AND niche)")
    return o.groupBy("video", "song").agg(F.min("seconds").alias("seconds"))


@q("classify_entry", "SELECT d.doc_id, CASE WHEN quality = 0 AND n_chars < 500 THEN 'confirmed_noise' WHEN quality = 0 THEN 'likely_noise' WHEN toxic = 1 THEN 'needs_review' ELSE 'likely_song' END AS class FROM documents d JOIN labels USING (doc_id)")
def classify_entry(spark: SparkSession, d: str) -> DataFrame:
    """H28."""
    j = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    noise = F.col("quality") == 0
    return j.select("doc_id", F.when(noise & (F.col("n_chars") < 500), "confirmed_noise").when(noise, "likely_noise").when(F.col("toxic") == 1, "needs_review").otherwise("likely_song").alias("class"))


@q("patch_merge", "SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'kept' WHEN a.f = b.f THEN 'ignored' WHEN b.k % 5 = 0 THEN 'conflict' ELSE 'updated' END AS outcome, COUNT(*) AS n FROM (SELECT o_orderkey AS k, o_orderstatus AS f FROM orders WHERE o_orderkey % 3 <> 0) a FULL JOIN (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 0 THEN 'Z' ELSE o_orderstatus END AS f FROM orders WHERE o_orderkey % 2 = 0) b ON a.k = b.k GROUP BY 1")
def patch_merge(spark: SparkSession, d: str) -> DataFrame:
    """H29."""
    o = table(spark, d, "orders")
    a = o.where("o_orderkey % 3 <> 0").select(F.col("o_orderkey").alias("a"), F.col("o_orderstatus").alias("fa"))
    b = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("b"), F.when(F.col("o_orderkey") % 4 == 0, "Z").otherwise(F.col("o_orderstatus")).alias("fb"))
    outcome = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "kept").when(F.col("fa") == F.col("fb"), "ignored").when(F.col("b") % 5 == 0, "conflict").otherwise("updated")
    return a.join(b, F.col("a") == F.col("b"), "full").groupBy(outcome.alias("outcome")).agg(count().alias("n"))


@q("best_source", "SELECT source, MIN_BY(doc_id, (-(n_chars + CASE WHEN contains(text, '!!') THEN -100000 ELSE 0 END), doc_id)) AS doc_id FROM documents GROUP BY source")
def best_source(spark: SparkSession, d: str) -> DataFrame:
    """The best score; high risk loses against all others."""
    score = F.col("n_chars") + F.when(F.col("text").contains("!!"), -100000).otherwise(0)
    return table(spark, d, "documents").groupBy("source").agg(F.min_by("doc_id", F.struct(-score, "doc_id")).alias("doc_id"))


@q(
    "ordered_source_merge",
    f"""WITH RECURSIVE l AS (SELECT artist, (seconds // 12) * 2 + song % 2 AS list, COUNT(*) AS n, MIN(seconds) AS low, MAX(seconds) AS high FROM {OCC} GROUP BY ALL),
        o AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY artist ORDER BY low, list) AS rn FROM l WHERE n >= 10),
        f AS (SELECT artist, list, rn, high > low AS taken, CASE WHEN high > low THEN high ELSE -1 END AS last FROM o WHERE rn = 1
          UNION ALL SELECT o.artist, o.list, o.rn, o.low > f.last AND o.high > o.low, CASE WHEN o.low > f.last AND o.high > o.low THEN o.high ELSE f.last END FROM f JOIN o ON o.artist = f.artist AND o.rn = f.rn + 1),
        m AS (SELECT x.artist, COUNT(*) AS total, COUNT(DISTINCT (x.seconds, x.song)) AS rows FROM {OCC} x JOIN f ON f.artist = x.artist AND f.taken AND f.list = (x.seconds // 12) * 2 + x.song % 2 GROUP BY ALL),
        w AS (SELECT artist, COUNT(*) FILTER (WHERE n >= 10) AS long, MAX(n) AS largest FROM l GROUP BY artist)
        SELECT w.artist, CASE WHEN long >= 2 AND total >= 20 THEN rows ELSE 0 END AS rows, COALESCE(long >= 2 AND total >= 20 AND rows > largest, FALSE) AS merged FROM w LEFT JOIN m ON m.artist = w.artist""",
)
def ordered_source_merge(spark: SparkSession, d: str) -> DataFrame:
    """Lists of ten rows or more that follow one another become one, if two or more do and hold
    twenty rows; repeats go, and the whole is taken where it is longer than the longest list.

    A list counts against later ones only if it was taken itself: a fold over the lists of a video.
    """
    list_ = F.floor(F.col("seconds") / 12) * 2 + F.col("song") % 2
    o = occurrences(spark, d).select("artist", "song", "seconds", list_.alias("list"))
    lists = o.groupBy("artist", "list").agg(count().alias("n"), F.min("seconds").alias("low"), F.max("seconds").alias("high"))
    row = F.when(F.col("n") >= 10, F.struct("low", "list", "high"))
    g = lists.groupBy("artist").agg(F.sort_array(F.collect_list(row)).alias("lists"), F.max("n").alias("largest"))
    start = F.struct(F.lit(-1).cast("bigint").alias("last"), F.array().cast("array<bigint>").alias("taken"))

    def take(state: F.Column, x: F.Column) -> F.Column:
        fits = (x["low"] > state["last"]) & (x["high"] > x["low"])
        return F.when(fits, F.struct(x["high"].alias("last"), F.concat(state["taken"], F.array(x["list"])).alias("taken"))).otherwise(state)

    g = g.select("artist", "largest", F.size("lists").alias("long"), F.aggregate("lists", start, take)["taken"].alias("taken"))
    of = o.join(g.select("artist", F.explode("taken").alias("list")), ["artist", "list"])
    per = of.groupBy("artist", "seconds", "song").agg(count().alias("n")).groupBy("artist").agg(F.sum("n").alias("total"), count().alias("rows"))
    enough = (F.col("long") >= 2) & (F.coalesce("total", F.lit(0)) >= 20)
    return g.join(per, "artist", "left").select("artist", F.when(enough, F.col("rows")).otherwise(F.lit(0)).alias("rows"), (enough & (F.coalesce("rows", F.lit(0)) > F.col("largest"))).alias("merged"))


@q("hydrate_dim", "SELECT o_orderkey, COALESCE(c.c_name, s.s_name) AS name, c.c_custkey IS NOT NULL OR s.s_suppkey IS NOT NULL AS collected FROM orders LEFT JOIN customer c ON c.c_custkey = o_custkey AND c.c_custkey % 3 <> 0 LEFT JOIN supplier s ON s.s_suppkey = o_custkey")
def hydrate_dim(spark: SparkSession, d: str) -> DataFrame:
    """H32."""
    c = table(spark, d, "customer").where("c_custkey % 3 <> 0").select("c_custkey", "c_name")
    j = table(spark, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"), "left").join(table(spark, d, "supplier").select("s_suppkey", "s_name"), F.col("s_suppkey") == F.col("o_custkey"), "left")
    return j.select("o_orderkey", F.coalesce("c_name", "s_name").alias("name"), (F.col("c_custkey").isNotNull() | F.col("s_suppkey").isNotNull()).alias("collected"))


@q("richer_row", f"SELECT video, song, MAX((NOT unknown)::INT * 2 + (NOT niche)::INT)::BIGINT AS completeness FROM {OCC} GROUP BY ALL")
def richer_row(spark: SparkSession, d: str) -> DataFrame:
    """The most complete row of an id."""
    score = (~F.col("unknown")).cast("int") * 2 + (~F.col("niche")).cast("int")
    return occurrences(spark, d).groupBy("video", "song").agg(F.max(score).cast("bigint").alias("completeness"))


@q("semantic_keys", "SELECT p_partkey, regexp_replace(lower(p_name || p_brand), '[^a-z0-9]+', '', 'g') AS key FROM part")
def semantic_keys(spark: SparkSession, d: str) -> DataFrame:
    """I02."""
    return table(spark, d, "part").select("p_partkey", tx.letters_digits(F.concat("p_name", "p_brand")).alias("key"))
