"""Latin spellings of kana, from rows of consonants and columns of vowels."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The kana table, row by row.
ROWS = {"": "あいうえお", "k": "かきくけこ", "g": "がぎぐげご", "s": "さしすせそ", "z": "ざじずぜぞ", "t": "たちつてと", "d": "だぢづでど", "n": "なにぬねの", "h": "はひふへほ", "b": "ばびぶべぼ", "p": "ぱぴぷぺぽ", "m": "まみむめも", "r": "らりるれろ"}
OTHERS = {"や": "ya", "ゆ": "yu", "よ": "yo", "わ": "wa", "を": "wo", "ん": "n", "し": "shi", "じ": "ji", "ち": "chi", "つ": "tsu", "ふ": "fu", "ぢ": "ji", "づ": "zu", "ゔ": "vu"}
SMALL_Y = {"ゃ": "ya", "ゅ": "yu", "ょ": "yo"}
SMALL_VOWELS = {"ぁ": "a", "ぃ": "i", "ぅ": "u", "ぇ": "e", "ぉ": "o"}

TABLE = {k: c + v for c, row in ROWS.items() for k, v in zip(row, "aiueo", strict=True)} | OTHERS


def romanize(text: str) -> str:
    """Lower-case Latin letters and digits of a name; small kana, doubled consonants and long
    vowels as they are heard."""
    out: list[str] = []
    double = False
    for c in unicodedata.normalize("NFKC", text).lower():
        c = chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c
        if c == "っ":
            double = True
            continue
        if c in SMALL_Y and out and out[-1].endswith("i"):
            stem = out[-1][:-1]
            out[-1] = stem + SMALL_Y[c][1:] if stem in ("sh", "ch", "j") else stem + SMALL_Y[c]
        elif c in SMALL_VOWELS and out and out[-1] in ("fu", "vu", "che", "te", "de", "u"):
            out[-1] = out[-1][:-1] + SMALL_VOWELS[c]
        elif c == "ー" and out:
            out.append(out[-1][-1])
        elif c in TABLE:
            out.append(TABLE[c][0] * double + TABLE[c])
        elif c.isalnum():
            out.append(c)
        double = False
    return "".join(out)


@F.pandas_udf(StringType())
def romanized(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else romanize(x))
