"""Repairs of a title and an artist as they were parsed from a raw line.

``repaired`` applies four steps in order, each a list of rules of which the first that holds
acts. ``best_splits`` scores all places where a line may be cut. ``gated`` and ``canonical``
compare with the official titles of one artist. All are column expressions and equi-joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from encore.functions import text as tx

# Words of an unknown artist, and of a work that a song belongs to.
UNKNOWN = r"(?i)^(?:未記載|不明|未知歌手|unknown)?$"
COLUMN_WORK = r"(?i)(?:OP|ED|挿入歌|主題歌|ゲーム|アニメ|「[^」]+」)"
WORK = r"(?i)(?:Anime|アニメ|ゲーム|OP|ED|insert song|挿入歌|主題歌|theme song|即興ソング|キャラクターソング|CM|commercial|テーマソング)"
# What may follow an artist.
TAILS = (
    r"\s+様\s*$",
    r"【[^】]{1,160}】\s*(?=[（(]\s*(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}\s*[）)])",
    r"\s*[（(]\s*(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}\s*[）)].*$",
    r"\s*※\s*(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}.*$",
    r"\s*\((?:作詞|作曲):.*$",
    r"\s*[（(]\s*(?:19|20)[0-9]{2}\s*$",
    r"\s*\[\s*(?:19|20)[0-9]{2}年?\s*$",
    r"(?i)\s*\(cover\s+.+$",
    r"\s+[/／]\s*$",
)
# Where a line may be cut, and brackets that protect from it.
DELIMITERS = "/／|｜￤∣丨"
OPENING, CLOSING = "【「『《〈([{（［", "】」』》〉)]}）］"
LEAST_SCORE = 1

Parsed = tuple[Column, Column]


def taken(x: Column, pattern: str, group: int) -> Column:
    return F.trim(F.regexp_extract(x, pattern, group))


def first_of(rules: list[tuple[Column, Column, Column]], title: Column, artist: Column) -> Parsed:
    """Title and artist by the first rule whose condition holds, else as they were."""
    t, a = F, F
    for condition, new_title, new_artist in rules:
        t, a = t.when(condition, new_title), a.when(condition, new_artist)
    return t.otherwise(title), a.otherwise(artist)


def undated(title: Column, artist: Column, raw: Column) -> Parsed:
    """A date whose last part was taken for the artist: "T/A 2019/03" and "7"; "T/A" and "2019"."""
    ends = raw.endswith(F.concat(title, F.lit("/"), artist))
    dated, yearly = r"^(.+)[/／]([^/／]{2,}?)\s+(?:19|20)[0-9]{2}[/／](?:0?[1-9]|1[0-2])$", r"^([^/／]+)[/／]([^/／]{2,})$"
    day, year = artist.rlike("^(?:0?[1-9]|[12][0-9]|3[01])$"), artist.rlike("^20[0-9]{2}$")
    return first_of([(ends & hit & title.rlike(p), taken(title, p, 1), taken(title, p, 2)) for hit, p in ((day, dated), (year, yearly))], title, artist)


def by_columns(title: Column, artist: Column, raw: Column) -> Parsed:
    """Lines of fixed columns: title, artist, work and year."""
    body = F.trim(F.regexp_replace(raw, r"^\s*[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\s+", ""))
    fields = F.filter(F.transform(F.split(body, "／"), lambda f: F.trim(f)), lambda f: f != "")
    field = [F.get(fields, i) for i in range(4)]
    follows = (title == field[0]) | title.startswith(F.concat(field[0], F.lit("／"))) | (artist == F.array_join(F.slice(fields, 2, 3), "／")) | (artist == field[3]) | artist.endswith(F.concat(F.lit("／"), field[3]))
    four = (F.size(fields) == 4) & field[3].rlike(r"^.+\s*[（(](?:19|20)[0-9]{2}[）)]$") & field[2].rlike(COLUMN_WORK) & follows
    plain = tx.half_width(body)
    year = F.regexp_extract(artist, r"^((?:19|20)[0-9]{2}(?:[–—-](?:19|20)?[0-9]{2})?)(?:\s*※.*)?$", 1)
    unknown = artist.rlike(UNKNOWN)
    of_work = r"^(.+?)\s*/\s*(.+?)\s*/\s*(.+)\s*/\s*((?:19|20)[0-9]{2}(?:[–—-](?:19|20)?[0-9]{2})?)(?:\s*※.*)?$"
    simple = r"^(.+?)\s*/\s*([^/]{2,})\s*/\s*((?:19|20)[0-9]{2})\s*$"
    work_date = r"^(?:[0-9]+[.]\s*)?(.+?)\s*/\s*([^/【]{2,})【[^】]+】[（(](?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}[）)]\s*$"
    same = lambda p, i: (unknown | (year != "")) & plain.rlike(p) & ((year == "") | (F.regexp_extract(plain, p, i) == year))
    return first_of(
        [
            (four, field[0], field[1]),
            (same(of_work, 4) & F.regexp_extract(plain, of_work, 3).rlike(WORK), taken(plain, of_work, 1), taken(plain, of_work, 2)),
            (same(simple, 3), taken(plain, simple, 1), taken(plain, simple, 2)),
            (unknown & plain.rlike(work_date), taken(plain, work_date, 1), taken(plain, work_date, 2)),
        ],
        title,
        artist,
    )


def without_release(title: Column, artist: Column, raw: Column) -> Parsed:
    """An artist without date, work and note behind it; a bracket that the parser lost comes back.

    A year in brackets goes only where the raw line has the whole credit behind a slash.
    """
    cleaned = artist
    for tail in TAILS:
        cleaned = F.regexp_replace(cleaned, tail, "")
    cleaned = F.trim(cleaned)
    year = r"^(.+?)\s*[（(]\s*(?:19|20)[0-9]{2}\s*[）)]$"
    at = F.position(cleaned, raw)
    before = F.substr(raw, F.greatest(at - 4, F.lit(1)), F.least(F.lit(4), F.greatest(at - 1, F.lit(0))))
    lost = lambda left, right: (cleaned == artist) & (F.regexp_count(artist, F.lit(rf"\{left}")) == F.regexp_count(artist, F.lit(rf"\{right}")) + 1) & raw.contains(F.concat(artist, F.lit(right)))
    return first_of(
        [
            (cleaned == "", title, artist),
            (cleaned.rlike(year) & (at > 0) & before.rlike(r"[/／]\s*$"), title, taken(cleaned, year, 1)),
            (lost("[", "]"), title, F.concat(artist, F.lit("]"))),
            (lost("(", ")"), title, F.concat(artist, F.lit(")"))),
            (F.lit(True), title, cleaned),
        ],
        title,
        artist,
    )


def without_marks(title: Column, artist: Column, raw: Column) -> Parsed:
    """Notes in place of an artist, "Original Song" behind it, and a delimiter before it."""
    note = artist.rlike("^(?:歌えません|練習中)$") & raw.contains(title) & raw.rlike(r"[（(]\s*(?:歌えません|練習中)\s*[）)]\s*$")
    original, leading = r"(?i)^(.+?)\s*[✨⭐★☆]*\s*Original\s+Song\s*[✨⭐★☆]*$", r"^[/／|｜][\s　]+(.+)$"
    return first_of([(note, title, F.lit("")), *((artist.rlike(p), title, taken(artist, p, 1)) for p in (original, leading))], title, artist)


def repaired(rows: DataFrame) -> DataFrame:
    """``rows`` with the columns title and artist repaired by raw. Rows without raw keep theirs."""
    for step in (undated, by_columns, without_release, without_marks):
        title, artist = step(F.col("title"), F.col("artist"), F.col("raw"))
        rows = rows.withColumns({"title": title, "artist": artist})
    return rows


def cuts(raw: Column) -> Column:
    """Places of delimiters outside brackets, but for slashes of a year and a month."""

    def step(s: Column, c: Column) -> Column:
        depth = F.when(c.isin(*OPENING), s["depth"] + 1).when(c.isin(*CLOSING), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        at = F.when(c.isin(*DELIMITERS) & (s["depth"] == 0), F.concat(s["at"], F.array(s["i"]))).otherwise(s["at"])
        return F.struct((s["i"] + 1).alias("i"), depth.alias("depth"), at.alias("at"))

    start = F.struct(F.lit(1).alias("i"), F.lit(0).alias("depth"), F.array().cast("array<int>").alias("at"))
    found = F.aggregate(F.split(raw, ""), start, step)["at"]
    monthly = lambda i: F.substr(raw, F.lit(1), i - 1).rlike(r"\b(?:19|20)[0-9]{2}\s*$") & F.substr(raw, i + 1).rlike(r"^\s*(?:0?[1-9]|1[0-2])\b")
    return F.filter(found, lambda i: ~monthly(i) & (F.trim(F.substr(raw, F.lit(1), i - 1)) != "") & (F.trim(F.substr(raw, i + 1)) != ""))


def best_splits(lines: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """key, title and artist of the best cut of every line's raw; null without a fair one.

    known: title and artist of known songs. Ties go to the first cut.
    """
    at = F.col("at")
    x = lines.select(key, "raw", F.explode_outer(cuts(F.col("raw"))).alias("at"))
    x = x.withColumns({"title": F.trim(F.substr("raw", F.lit(1), at - 1)), "artist": F.trim(F.substr("raw", at + 1))})
    x = x.withColumns({"_title": tx.entity_key(F.col("title")), "_artist": tx.entity_key(F.col("artist"))})
    songs = known.select(tx.entity_key(F.col("title")).alias("_title"), tx.entity_key(F.col("artist")).alias("_artist")).distinct()
    x = x.join(songs.withColumn("_song", F.lit(True)), ["_title", "_artist"], "left").join(songs.select("_title").distinct().withColumn("_known", F.lit(True)), "_title", "left")
    spaced = F.substr("raw", at - 1, F.lit(1)).rlike(r"\s") & F.substr("raw", at + 1, F.lit(1)).rlike(r"\s")
    fragment = F.col("title").rlike(r"\b[0-9]{4}$") & F.col("artist").rlike(r"^[0-9]{1,2}\b")
    bad = ~F.col("artist").rlike(r"[\p{L}\p{N}]") | F.col("artist").rlike(r"^(?:0?[1-9]|1[0-2])$")
    points = ((F.length("title") >= 2, 1), (F.length("artist") >= 2, 1), (spaced, 1), (F.col("_known"), 5), (F.col("_song"), 7), (bad, -12), (fragment, -16))
    score = F.lit(2)
    for condition, n in points:
        score += F.when(condition, n).otherwise(0)
    x = x.withColumn("score", F.when(at.isNotNull(), score))
    best = F.max_by(F.struct("title", "artist", "score"), F.when(F.col("score") >= LEAST_SCORE, F.struct("score", -at)))
    return x.groupBy(key).agg(best.alias("_best")).select(key, F.col("_best.title").alias("title"), F.col("_best.artist").alias("artist"))


def gated(rows: DataFrame, official: DataFrame, name: str, aliases: list[str]) -> DataFrame:
    """``rows`` with a state, and the official title and artist of those that are published.

    Rows are the artist's by an alias, or by an alias in the title where the artist is unknown;
    they must be of an official title, or are archived. Others stay as they are.
    """
    keys = [tx.entity_key(F.lit(a)) for a in (name, *aliases)]
    embedded = "(?i)(?:" + "|".join(rf"\Q{a}\E" for a in sorted((name, *aliases), key=len, reverse=True)) + ")"
    own, in_title = tx.entity_key(F.col("artist")).isin(*keys), F.col("artist").rlike(UNKNOWN) & F.col("title").rlike(embedded)
    mine = F.coalesce(own | in_title, F.lit(False))
    titles = official.select(tx.entity_key(F.col("title")).alias("_key"), "title").groupBy("_key").agg(F.min("title").alias("_official"))
    x = rows.withColumn("_key", F.when(mine, tx.entity_key(F.regexp_replace("title", embedded, "")))).join(titles, "_key", "left")
    found = F.col("_official").isNotNull()
    state = F.when(F.col("_key").isNull(), "other").when(found, "published").otherwise("archived")
    return x.withColumns({"state": state, "title": F.coalesce("_official", "title"), "artist": F.when(found, name).otherwise(F.col("artist"))}).drop("_key", "_official")


def canonical(rows: DataFrame, official: DataFrame, name: str, key: str) -> DataFrame:
    """``rows`` of one artist with the longest official title that their title holds.

    Where the title holds the artist's name, the artist column is searched, too: the two may be
    swapped. Rows that name the artist but no official title get the artist's name alone, those
    that name it in the title alone stay. ``publish`` is false for titles that aren't official.
    """
    of = lambda c: tx.entity_key(F.col(c)).contains(tx.entity_key(F.lit(name)))
    words = lambda c: F.filter(F.split(F.lower(c), r"[ \t\p{P}\p{S}]+"), lambda w: w != "")
    runs = lambda w: F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(i, F.size(w)), lambda j: F.array_join(F.slice(w, i, j - i + 1), ""))))
    held = lambda c: F.when(F.size(words(c)) > 0, runs(words(c))).otherwise(F.array().cast("array<string>"))
    part = lambda c, first: F.transform(F.array_distinct(held(c)), lambda k: F.struct(F.lit(first).alias("first"), k.alias("_key")))
    nothing = F.array().cast("array<struct<first:int,_key:string>>")
    x = rows.withColumns({"_in_title": of("title"), "_in_artist": of("artist")})
    asked = x.where("_in_title OR _in_artist").select(key, F.explode(F.concat(part("title", 1), F.when(F.col("_in_title"), part("artist", 0)).otherwise(nothing))).alias("_part")).select(key, "_part.*")
    titles = official.select(tx.entity_key(F.col("title")).alias("_key"), "title").groupBy("_key").agg(F.min("title").alias("_official"))
    found = asked.join(titles, "_key").groupBy(key).agg(F.max_by("_official", F.struct("first", F.length("_key"), "_key")).alias("_official"))
    x = x.join(found, key, "left")
    mine = F.col("_official").isNotNull() | F.col("_in_artist")
    return x.withColumns({"title": F.coalesce("_official", "title"), "artist": F.when(mine, name).otherwise(F.col("artist")), "publish": ~F.coalesce(mine, F.lit(False)) | F.col("_official").isNotNull()}).drop("_official", "_in_title", "_in_artist")
