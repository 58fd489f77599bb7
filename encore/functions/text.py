"""Text keys and cleaners as column expressions.

All stay inside the JVM. NFKC has no built-in there; ``nfkc`` is the one Arrow UDF, applied
at ingest only, so that everything after it can assume normal text.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters with marks and their base letters, for the languages of the sources.
ACCENTED = "àâäáãåçèéêëìíîïñòóôöõùúûüýÿÀÂÄÁÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜÝ"
FULL_WIDTH = "０１２３４５６７８９：．＃／"
HALF_WIDTH = "0123456789:.#/"
# Names that stand for an unknown artist.
UNKNOWN = ("", "unknown", "n/a", "-", "none", "various", "未知", "不明")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def _base(letters: str) -> str:
    return "".join(unicodedata.normalize("NFD", c)[0] for c in letters)


def clean(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"[ \t\n\r]+", " "))


def entity_key(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"[ \t\n\r\p{P}\p{S}]+", ""))


def letters_digits(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]+", ""))


def without_accents(x: Column) -> Column:
    return F.translate(x, ACCENTED, _base(ACCENTED))


def half_width(x: Column) -> Column:
    return F.translate(x, FULL_WIDTH, HALF_WIDTH)


LIST_MARKER = r"^ *(?:#?[0-9]{1,3}[.):]|M[0-9]{1,2}[ .:]|[•*-]) *"


def without_list_marker(x: Column, passes: int = 4) -> Column:
    for _ in range(passes):
        x = F.regexp_replace(x, LIST_MARKER, "")
    return x


def without_emoji(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r":_?[A-Za-z0-9_]+:|[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]", ""))


def without_years(x: Column) -> Column:
    for _ in range(2):
        x = F.regexp_replace(x, r" *\(?(?:19|20)[0-9]{2}\)? *$", "")
    return F.regexp_replace(x, r" +(?:san|sama|chan|kun)$", "")


VARIANT = r"^(.*?) *(?:\((acoustic|live|remix|short ver|instrumental)\)|- (acoustic|live|remix|short ver|instrumental))$"


def variant_of(x: Column) -> Column:
    """The allowed variant label at the end of a title, or blank."""
    low = F.lower(x)
    return F.concat(F.regexp_extract(low, VARIANT, 2), F.regexp_extract(low, VARIANT, 3))


def base_title(x: Column) -> Column:
    low = F.lower(x)
    return F.when(low.rlike(VARIANT), F.regexp_extract(low, VARIANT, 1)).otherwise(low)


def work_key(x: Column) -> Column:
    return letters_digits(base_title(without_list_marker(x)))


def hms_seconds(x: Column) -> Column:
    """h:mm:ss or m:ss as seconds; null if it is neither."""
    parts = r"^(?:([0-9]{1,2}):)?([0-9]{1,2}):([0-5][0-9])$"
    number = lambda i: F.coalesce(F.nullif(F.regexp_extract(x, parts, i), F.lit("")).cast("bigint"), F.lit(0))
    return F.when(x.rlike(parts), number(1) * 3600 + number(2) * 60 + number(3))


def seconds_hms(x: Column) -> Column:
    hours, minutes = F.floor(x / 3600), F.floor(x % 3600 / 60)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(hours.cast("string"), F.lit(":"), two(minutes), F.lit(":"), two((x % 60).cast("bigint")))


def stable_key(*parts: Column, length: int = 16) -> Column:
    """A prefix of the SHA-256 of the parts, joined by a unit separator."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *(p.cast("string") for p in parts)), 256), 1, length)


def is_unknown(x: Column) -> Column:
    return F.coalesce(F.lower(F.trim(x)), F.lit("")).isin(*UNKNOWN)


def script_class(x: Column) -> Column:
    kana, han = x.rlike(r"[\x{3040}-\x{30FF}]"), x.rlike(r"[\x{4E00}-\x{9FFF}]")
    accent, latin = x.rlike(r"[\x{00C0}-\x{024F}]"), x.rlike("[A-Za-z]")
    return F.when(kana, "kana").when(han, "han").when(accent, "latin_accented").when(latin, "latin").otherwise("other")


def search_score(title: Column, needle: str) -> Column:
    """Tiers of a title against a lower-case needle: exact, prefix, word, inside, none."""
    low = F.lower(title)
    return (
        F.when(low == needle, 1000).when(low.startswith(needle), 850).when(F.concat(F.lit(" "), low, F.lit(" ")).contains(f" {needle} "), 700).when(low.contains(needle), 550).otherwise(-1).cast("bigint")
    )
