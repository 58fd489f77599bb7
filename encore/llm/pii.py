r"""Operator 9: personal data in texts, in DataFrame operations only.

Regular expressions propose spans, validators (number range, Luhn, digit count, mod 97)
confirm them (or, for keys and passwords, the mix of
signs), and words near a span raise its score. Spans of the four base kinds that
their validator confirms always stay; a span of a further kind stays if its score reaches
``THRESHOLD``. The expressions use possessive repeats and may start a match only where a
longest match can start, so their time is linear in the text; what they match is the same
as that of the plain forms, which the tests run beside them.

Offsets: ``split`` gives the text between matches, ``regexp_extract_all`` the matches;
running sums of their lengths in code points are the offsets. The sums are formed within
chunks of ``CHUNK`` matches and then over chunks, so that a text of very many matches does
not copy a long list once per match.

Defined results: a null text is empty and has no spans; repeated rows give repeated rows; a
null id stays null; an empty table gives no rows. ``find`` keeps all columns of its input
but those of the name of a kind, which are replaced; ``redacted`` keeps all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from encore.llm.common import free_name, table

CHUNK = 128
CONTEXT_CHARS = 48
CONTEXT_BONUS = 0.35
THRESHOLD = 0.5


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: The score of a confirmed span with no context word near it.
    score: float
    #: Words that raise the score, as a Java expression over lower-case text.
    context: str
    base: bool = True


# The patterns of the kinds and the words that raise their scores.
EMAIL = Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", 0.9, r"\b(?:e-?mail|mail|contact|write)\b")
IP = Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, r"\b(?:ip|address|host|server|login)\b")
CARD = Kind("card", r"[0-9](?:[\x20-]?[0-9])++", 0.8, r"\b(?:card|visa|credit|debit|payment|carte|tarjeta|karte)\b")
PHONE = Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0.7, r"\b(?:phone|call|tel|mobile|fax)\b")
IBAN = Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", 0.8, r"\b(?:iban|account|bank|konto|cuenta|compte)\b", base=False)
SSN = Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.3, r"\b(?:ssn|social|security|insurance)\b", base=False)
SECRET = Kind("secret", r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+", 0.3, r"(?:token|secret|api.?key|access.?key|passwo?r?d|pwd|credential|bearer|auth)", base=False)
KINDS = (EMAIL, IP, CARD, PHONE, IBAN, SSN, SECRET)

SPAN = "struct<start:bigint,end:bigint,value:string>"


PAIR = "struct<gap:bigint,value:string>"


def pairs_of(text: Column, pattern: str, found: Column) -> Column:
    """array<gap, value>: each match, and the code points between it and the one before."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")))
    return F.when(F.size(found) > 0, pairs).otherwise(F.array().cast(f"array<{PAIR}>"))


def spans_of(pairs: Column) -> Column:
    """array<start, end, value> in code points.

    ``pairs`` must be a column, not an expression: it is used within a lambda.
    """
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / CHUNK).cast("int")), lambda i: F.slice(pairs, i * CHUNK + 1, CHUNK))
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + F.length(pair["value"])
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value")))).alias("spans"))

    summed = F.transform(chunks, lambda chunk: F.aggregate(chunk, nothing, add))
    lists = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("lists"))

    def shift(state: Column, chunk: Column) -> Column:
        moved = F.transform(chunk["spans"], lambda s: F.struct((s["start"] + state["at"]).alias("start"), (s["end"] + state["at"]).alias("end"), s["value"].alias("value")))
        return F.struct((state["at"] + chunk["at"]).alias("at"), F.concat(state["lists"], F.array(moved)).alias("lists"))

    spans = F.flatten(F.aggregate(summed, lists, shift)["lists"])
    return F.when(F.size(pairs) > 0, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def mod97(value: Column) -> Column:
    """The remainder of an IBAN, rearranged and with letters as 10 to 35, by 97."""
    plain = F.regexp_replace(value, "\x20", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    signs = F.filter(F.split(turned, ""), lambda c: c != "")

    def add(state: Column, sign: Column) -> Column:
        code = F.ascii(sign)
        return F.when(code >= 65, (state * 100 + code - 55) % 97).otherwise((state * 10 + code - 48) % 97)

    return F.aggregate(signs, F.lit(0), add)


def confirmed(kind: Kind, value: Column) -> Column:
    if kind is IP:
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))
    if kind is CARD:
        number = digits(value)
        return F.length(number).between(13, 19) & F.call_function("luhn_check", number)
    if kind is PHONE:
        return F.length(digits(value)).between(9, 15)
    if kind is IBAN:
        return mod97(value) == 1
    if kind is SECRET:  # a drawn key, not a long word, a number or a path
        number = F.length(digits(value))
        return number.between(4, F.length(value) - 4) & (F.size(F.array_distinct(F.split(value, ""))) > 8)
    return F.lit(True)


def confirmed_only(kind: Kind, spans: str) -> Column:
    return F.filter(spans, lambda s: confirmed(kind, s["value"]))


def named(kind: Kind) -> Column:
    return F.transform(kind.name, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind.name).alias("kind")))


def scored(kind: Kind, text: Column, spans: Column) -> Column:
    """array<start, end, value, score>, without what is below the threshold (base kinds: all)."""

    def score(s: Column) -> Column:
        first = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0).cast("long"))
        around = F.concat_ws(" ", F.substr(text, (first + 1).cast("int"), (s["start"] - first).cast("int")), F.substr(text, (s["end"] + 1).cast("int"), F.lit(CONTEXT_CHARS)))
        bonus = F.when(F.lower(around).rlike(kind.context), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))
        value = F.least(F.lit(1.0), F.lit(kind.score) + bonus)
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), value.alias("score"))

    out = F.transform(spans, score)
    return out if kind.base else F.filter(out, lambda s: s["score"] >= THRESHOLD)


def find(docs: DataFrame, text: str = "text", kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``docs`` with one column of spans per kind: array<start, end, value, score>."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    taken = [*docs.columns, *(k.name for k in kinds)]
    at, digit = free_name(taken, "_at"), free_name(taken, "_digit")
    step = {k: free_name(taken, f"_{k.name}") for k in kinds}
    out = docs.withColumns({at: F.contains(body, F.lit("@")), digit: body.rlike("[0-9]")})
    none = F.array().cast("array<string>")
    guard = {k: F.col(at) if k is EMAIL else F.col(digit) for k in kinds}
    # Each step uses a column of the step before more than once, so that they stay apart
    # in the plan and no expression over the text is computed again and again.
    out = out.withColumns({step[k]: F.when(guard[k], F.regexp_extract_all(body, F.lit(k.pattern), F.lit(0))).otherwise(none) for k in kinds})
    out = out.withColumns({step[k]: pairs_of(body, k.pattern, F.col(step[k])) for k in kinds})
    out = out.withColumns({step[k]: spans_of(F.col(step[k])) for k in kinds})
    out = out.withColumns({step[k]: confirmed_only(k, step[k]) for k in kinds})
    out = out.withColumns({k.name: scored(k, body, F.col(step[k])) for k in kinds})
    return out.drop(at, digit, *step.values())


def listed(kinds: tuple[Kind, ...], with_score: bool = False) -> Column:
    """kind:start:end of all spans, by kind and start, joined with commas."""

    def each(k: Kind) -> Column:
        return F.transform(k.name, lambda s: F.concat_ws(":", F.lit(k.name), s["start"], s["end"], *([F.format_number(s["score"], 2)] if with_score else [])))

    return F.concat_ws(",", F.concat(*(each(k) for k in kinds)))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets.

    Rows travel as a struct of their own, so that no column of theirs meets an added one.
    """
    found = find(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text).alias("text")))
    found = found.withColumn("every", F.array_sort(F.concat(*(named(k) for k in KINDS))))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def cut(state: Column, s: Column) -> Column:
        gap = F.substr(F.col("text"), (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0).cast("long")).cast("int"))
        fresh = s["start"] >= state["at"]
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(fresh, F.concat(state["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(state["out"]).alias("out"))

    done = F.aggregate("every", begin, cut, lambda s: F.concat(s["out"], F.substr(F.col("text"), (s["at"] + 1).cast("int"))))
    clean = F.when(F.size("every") > 0, done).otherwise(F.col("text"))
    return found.withColumn("clean", clean).select(*(F.col("clean").alias(text) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = tuple(k for k in KINDS if k.base)
    found = found.withColumns({f"n_{k.name}": F.size(k.name).cast("long") for k in base})
    return found.select(
        "doc_id", *(f"n_{k.name}" for k in base), F.sha2(listed(base), 256).alias("base_sha256"), listed(KINDS).alias("spans"), listed(KINDS, with_score=True).alias("scores")
    )
