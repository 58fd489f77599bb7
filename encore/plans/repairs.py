"""Plans of repairs of credits, splits and official titles.

Each derives lines from ``part`` in all forms that a rule must change or keep, a form for
every remainder of the key, and the SQL states what has to come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.operators import credits, nonsong
from encore.plans.registry import Registry, table

reg = Registry()
q = reg.register

#: Title, artist and raw line as parsed, and title and artist as wanted; T and A are the part's.
CREDITS = (
    ("T/A 2019/03", "7", "T/A 2019/03/7", "T", "A"),
    ("T/A 2019/03", "45", "T/A 2019/03/45", "T/A 2019/03", "45"),
    ("T/A", "2019", "T/A/2019", "T", "A"),
    ("T/live/A", "2019", "T/live/A/2019", "T/live", "A"),
    ("T", "A／アニメ「X」OP／W (2020)", "1:02:03 T／A／アニメ「X」OP／W (2020)", "T", "A"),
    ("T", "A／live／W", "1:02:03 T／A／live／W", "T", "A／live／W"),
    ("T", "unknown", "1:02 T / A / アニメ OP / 2019", "T", "A"),
    ("T", "A", "1:02 T / A / アニメ OP / 2019", "T", "A"),
    ("T", "2018", "1:02 T / A / アニメ OP / 2019", "T", "2018"),
    ("T", "unknown", "03. T / A【W】(2019.03.07)", "T", "A"),
    ("T", "A (2019/03/07)", "T / A (2019/03/07)", "T", "A"),
    ("T", "A (2019)", "T / A (2019)", "T", "A"),
    ("T", "A (2019)", "T by A (2019)", "T", "A (2019)"),
    ("T", "A [live", "T / A [live]", "T", "A [live]"),
    ("T", "A [live", "T / A [live", "T", "A [live"),
    ("T", "/ A", "T / / A", "T", "A"),
    ("T", "A ★ Original Song", "T / A ★ Original Song", "T", "A"),
    ("T", "練習中", "T(練習中)", "T", ""),
    ("T", "練習中", "T / 練習中", "T", "練習中"),
    ("T", "DISH//", "T / DISH//", "T", "DISH//"),
    ("T", "A", "T / A", "T", "A"),
)
SPLITS = ("T / A", "T / live / A", "intro / T / A", "【a / b】T ｜ A", "T 2024 / 05 A", "T/A", "T", "T / !!", "T / 5", "x / y", " / A")
OFFICIAL_SQL = "(SELECT DISTINCT p_name AS title FROM part WHERE p_size < 20)"


def filled_sql(form: str) -> str:
    return "replace(replace('" + form.replace("T", "\x01").replace("A", "\x02").replace("\x01", "<t>").replace("\x02", "<a>") + "', '<t>', p_name), '<a>', p_brand)"


def forms_sql(forms: list[str]) -> str:
    return f"CASE p_partkey % {len(forms)} " + " ".join(f"WHEN {i} THEN {filled_sql(x)}" for i, x in enumerate(forms)) + " END"


def forms(values: list[str]) -> F.Column:
    """The form of the row's key with the part's name and brand in the places of T and A."""
    form = F.get(F.array(*(F.lit(v.replace("A", "\x02").replace("T", "\x01")) for v in values)), (F.col("p_partkey") % len(values)).cast("int"))
    return F.replace(F.replace(form, F.lit("\x01"), F.col("p_name")), F.lit("\x02"), F.col("p_brand"))


@q("credit_repair", f"SELECT p_partkey, {forms_sql([x[3] for x in CREDITS])} AS title, {forms_sql([x[4] for x in CREDITS])} AS artist FROM part")
def credit_repair(spark: SparkSession, d: str) -> DataFrame:
    """Dates, columns, release data and notes in titles and artists, with lines that must stay."""
    parsed = table(spark, d, "part").select("p_partkey", *(forms([x[i] for x in CREDITS]).alias(c) for i, c in enumerate(("title", "artist", "raw"))))
    return credits.repaired(parsed).drop("raw")


@q(
    "best_split",
    f"""WITH l AS (SELECT p_partkey, {forms_sql(list(SPLITS))} AS raw FROM part), k AS (SELECT DISTINCT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS kt, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS ka FROM part),
        c AS (SELECT p_partkey, raw, i, trim(left(raw, i - 1)) AS title, trim(substr(raw, i + 1)) AS artist FROM l, (SELECT UNNEST(range(1, 80)) AS i) WHERE substr(raw, i, 1) IN ('/', '｜') AND length(regexp_replace(left(raw, i), '[^【]', '', 'g')) = length(regexp_replace(left(raw, i), '[^】]', '', 'g'))),
        s AS (SELECT p_partkey, title, artist, i, 2 + (length(title) >= 2)::INT + (length(artist) >= 2)::INT + (substr(raw, i - 1, 1) = ' ' AND substr(raw, i + 1, 1) = ' ')::INT - 12 * (artist IN ('!!', '5'))::INT
            + CASE WHEN (regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), regexp_replace(lower(artist), '[^a-z0-9]', '', 'g')) IN (SELECT (kt, ka) FROM k) THEN 12 WHEN regexp_replace(lower(title), '[^a-z0-9]', '', 'g') IN (SELECT kt FROM k) THEN 5 ELSE 0 END AS score
            FROM c WHERE title <> '' AND artist <> '' AND NOT (title LIKE '% 2024' AND artist LIKE '05 %')),
        b AS (SELECT p_partkey, MAX_BY((title, artist), (score, -i)) AS x FROM s WHERE score >= 1 GROUP BY 1)
        SELECT p_partkey, x[1] AS title, x[2] AS artist FROM part LEFT JOIN b USING (p_partkey)""",
)
def best_split(spark: SparkSession, d: str) -> DataFrame:
    """Of all cuts of a line, the one that scores best against known songs."""
    p = table(spark, d, "part")
    known = p.select(F.col("p_name").alias("title"), F.col("p_brand").alias("artist")).distinct()
    return credits.best_splits(p.select("p_partkey", forms(list(SPLITS)).alias("raw")), known, "p_partkey")


GATED = (("T", "Brand#5"), ("T", "brand five"), ("T / Brand#5", "unknown"), ("T", "unknown"), ("T / Brand#5", "A"), ("T live", "Brand#5"))
GATED_SQL = f"(SELECT p_partkey, p_name, {forms_sql([t for t, _ in GATED])} AS title, {forms_sql([a for _, a in GATED])} AS artist, p_partkey % 6 AS form FROM part)"


def official(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_size < 20").select(F.col("p_name").alias("title")).distinct()


@q(
    "catalog_gate",
    f"""SELECT p_partkey, CASE WHEN other THEN 'other' WHEN o.title IS NULL OR form = 5 THEN 'archived' ELSE 'published' END AS state,
        CASE WHEN other OR o.title IS NULL OR form = 5 THEN r.title ELSE o.title END AS title, CASE WHEN other OR o.title IS NULL OR form = 5 THEN r.artist ELSE 'Brand#5' END AS artist
        FROM (SELECT *, form = 3 OR form = 4 AND artist <> 'Brand#5' AS other FROM {GATED_SQL}) r LEFT JOIN {OFFICIAL_SQL} o ON o.title = r.p_name""",
)
def catalog_gate(spark: SparkSession, d: str) -> DataFrame:
    """An artist's titles must be of the official catalogue; unknown artists count where the title names it."""
    rows = table(spark, d, "part").select("p_partkey", forms([t for t, _ in GATED]).alias("title"), forms([a for _, a in GATED]).alias("artist"))
    return credits.gated(rows, official(spark, d), "Brand#5", ["brand five"])


CANONICAL = (("T", "Yoru"), ("Yoru", "T"), ("my T (Yoru)", "unknown"), ("T", "Yoru band"), ("T", "A"), ("xyz Yoru", "A"), ("xyz", "Yoru"))
CANONICAL_SQL = f"(SELECT p_partkey, p_name, {forms_sql([t for t, _ in CANONICAL])} AS title, {forms_sql([a for _, a in CANONICAL])} AS artist, p_partkey % 7 AS form FROM part)"


@q(
    "catalog_canonicalize",
    f"""SELECT p_partkey, CASE WHEN form < 4 AND o.title IS NOT NULL THEN o.title ELSE r.title END AS title, CASE WHEN form < 4 AND o.title IS NOT NULL OR form IN (0, 3, 6) THEN 'Yoru' ELSE artist END AS artist,
        CASE WHEN form IN (0, 3) THEN o.title IS NOT NULL ELSE form <> 6 END AS publish FROM {CANONICAL_SQL} r LEFT JOIN {OFFICIAL_SQL} o ON o.title = r.p_name""",
)
def catalog_canonicalize(spark: SparkSession, d: str) -> DataFrame:
    """Swapped fields and titles inside others become the official title; others aren't published."""
    rows = table(spark, d, "part").select("p_partkey", forms([t for t, _ in CANONICAL]).alias("title"), forms([a for _, a in CANONICAL]).alias("artist"))
    return credits.canonical(rows, official(spark, d), "Yoru", "p_partkey")


#: Title, artist and raw line, and the reasons of the entry and of its line; T and A are the part's.
ENTRIES = (
    ("T", "A", "1:02 T / A", None, None),
    (":_abc: :x1:", "", "1:02 :_abc: :x1:", "emoji_only", "raw_emoji_only"),
    ("全12曲", "", "1:02 全12曲", "song_total", "raw_song_total"),
    ("17(土) T", "A", "17(土) T / A", "weekday_schedule", "raw_weekday_schedule"),
    ("次回は10", "", "次回は10", "next_schedule", "raw_next_schedule"),
    ("T", "10/17", "1:02 T / A", "date_as_artist", None),
    ("18:30開演", "", "", "clock_marker", None),
    ("9/12", "unknown", "1:02 9/12", "date_alone", "raw_date_alone"),
    ("9/12", "A", "1:02 9/12 / A", None, None),
    ("T:17:30開場", "A", "", "timetable", None),
    ("T【10/17 8:30まで】", "A", "", "deadline", None),
    ("9/17 ~ 9", "A", "", "date_range", None),
    ("現地はスタンディング禁止", "A", "", "seating", None),
    ("スタンディング", "A", "", None, None),
    ("待機中", "A", "", "standby", None),
    ("T発売中", "A", "", "sale", None),
    ("販売期間:2026/10", "A", "", "sale_period", None),
    ("雑談", "A", "1:02 雑談 / A", "marker", "raw_marker"),
    ("雑談", "A", "1:02 T / A", "marker", None),
    ("自己紹介", "", "", "introduction", None),
    ("自己紹介", "A", "1:02 自己紹介 / A", None, None),
    ("T", "A", "1:02 チャンネル登録 / A", "stream_event", "raw_stream_event"),
    ("T", "", "1:02 T おすすめ", "remark", "raw_remark"),
    ("T", "A", "1:02 T おすすめ / A", None, None),
    ("こんばんは〜", "", "1:02 こんばんは〜", "greeting", "raw_greeting"),
    ("こんばんは〜", "A", "1:02 こんばんは〜 / A", None, None),
    ("T", "休憩", "1:02 T / A", "activity_as_artist", None),
    ("T", "", "10月3日 T 予約期間 9/12", None, "explicit_schedule_or_promotion"),
    ("T", "A", "T 予約期間 x / A", None, None),
    ("T", "", "1:02 【第3章】", None, "bracketed_numeric_marker"),
    ("12", "", "1:02 T / A", None, "bare_numeric_chapter_marker"),
    ("T", "A", "1:02", None, "raw_empty"),
    (None, None, None, None, None),
)


def either_sql(i: int) -> str:
    return f"CASE p_partkey % {len(ENTRIES)} " + " ".join(f"WHEN {k} THEN '{x[i]}'" for k, x in enumerate(ENTRIES) if x[i] is not None) + " END"


@q("entry_rules", f"SELECT p_partkey, {either_sql(3)} AS entry, {either_sql(4)} AS line FROM part")
def entry_rules(spark: SparkSession, d: str) -> DataFrame:
    """The first rule over title, artist and raw line; lines parsed again before they count as noise."""
    parsed = table(spark, d, "part").select("p_partkey", *(F.when(F.col("p_partkey") % len(ENTRIES) < len(ENTRIES) - 1, forms([x[i] or "" for x in ENTRIES])).alias(c) for i, c in enumerate(("title", "artist", "raw"))))
    return nonsong.with_reasons(parsed).select("p_partkey", "entry", "line")
