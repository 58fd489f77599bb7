"""Mixing, personal data, chat and WARC: against SQL, brute force and round trips."""

import gzip
import hashlib
import io
import random
import re

import pytest

from encore.llm import chat, mixing, pii, registry, warc
from tests.oracle import connect, rows

FOLDER = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, source string, size string, extra int"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    got = registry.queries()[name](spark, FOLDER).toPandas()
    want = connect(FOLDER).execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "s", 1), (1, "a b", "x", "s", 1), (2, None, "x", "s", 1), (3, "", None, "s", 1), (None, "c d e", "y", "s", 1)], DOC)
    got = mixing.mixed(docs).collect()
    assert len(got) == 5 and {r.size for r in got} == {2, 0, 3}
    assert all(r.taken <= 2 * r.size for r in got)
    assert {r.target for r in got if r.source is None} == {0.0}
    assert len({r.copies for r in got if r.doc_id == 1}) == 1
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.emitted(docs).columns == docs.columns


def water_filled(sizes, weights=mixing.WEIGHTS, budget=mixing.BUDGET, most=mixing.MAX_REPEAT):
    """By rounds: share what is left by weight, cut at the limits, share again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, open_ = budget * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if sizes[s] * most <= level * weight[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: sizes[s] * most for s in full}
        left -= sum(sizes[s] * most for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 1000}, {"a": 5, "b": 5, "c": 5, "d": 5, None: 5}, {"x": 7}, {"a": 0, "b": 3}, {"a": 1, "b": 2, "c": 900, "d": 40, "e": 3000, "f": 1, None: 77}])
def test_mixing_targets(spark, sizes):
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = water_filled(sizes)
    assert got == {s: pytest.approx(want[s]) for s in sizes}
    assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mixing_without_broadcast(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 7), f"s{i % 5}", "", 0) for i in range(200)], DOC)
    small = sorted((r.doc_id, r.taken) for r in mixing.mixed(docs).collect())
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert sorted((r.doc_id, r.taken) for r in mixing.mixed(docs).collect()) == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_mixing_keeps_clashing_columns(spark):
    names = "size source_size target rate copies taken _source _salt row key".split()
    docs = spark.createDataFrame([(i, "one two", "x", *(f"{n}{i}" for n in names)) for i in range(6)], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    got = mixing.emitted(docs)
    assert got.schema == docs.schema and got.count() > 6
    assert all(r[n] == f"{n}{r.doc_id}" for r in got.collect() for n in names)


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    only = lambda m: re.sub("[^0-9]", "", m[0])
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(only(m)) <= 19 and luhn(only(m))]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(only(m)) <= 15]
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_pii_brute_force(spark, tmp_path):
    random.seed(5)
    signs = "ab@.-+01 2345()%_é😀\n"
    texts = ["".join(random.choice(signs) for _ in range(random.randint(0, 200))) for _ in range(400)]
    texts += ["", None, "a@b.c_d@e.f", "0255.1.1.1 256.1.1.1 1.2.3.4.5.6.7.8", " 1.2.3.4" * 300, "4041894974608795", "+1 (988) 555-2485", "1" * 5000]
    table = [(i, t) for i, t in enumerate(texts)] + [(None, "x@y.z"), (0, texts[0])]
    spark.createDataFrame(table, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id): r for r in pii.op9_pii(spark, str(tmp_path)).collect()}
    for i, t in table:
        want = base_spans(t or "")
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert got[i].spans == want or got[i].spans.startswith(want)


def test_pii_validators_and_context(spark):
    text = "pay to DE89 3704 0044 0532 0130 00, not DE88 3704 0044 0532 0130 00; number 123-45-6789"
    df = spark.createDataFrame([(1, text), (2, "ssn 123-45-6789"), (3, "000-45-6789 ssn")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find(df).collect()}
    assert [text[s.start : s.end] for s in got[1].iban] == ["DE89 3704 0044 0532 0130 00"]
    assert not got[1].ssn and len(got[2].ssn) == 1 and not got[3].ssn
    assert pii.redacted(df).where("doc_id = 2").first().text == "ssn [ssn]"
    assert pii.find(df.limit(0)).count() == 0


def test_pii_secrets(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    texts = [f'token = "{key}"', f"revision {key} of the code", "a password of internationalisation_and_localisation", "auth 11111111111111111111111111", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.secret] for r in pii.find(df).collect()}
    assert got == {0: [key], 1: [], 2: [], 3: [], 4: [], 5: []}


def test_pii_keeps_clashing_columns(spark):
    names = "_text _at _digit _email email _every row".split()
    df = spark.createDataFrame([(1, "write to a@b.org", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = pii.redacted(df)
    assert got.columns == df.columns and got.first().asDict() == df.first().asDict() | {"text": "write to [email]"}
    assert pii.find(df).first()._at == "_at"


def test_warc_round_trip(spark):
    big = "x" * 1500
    pages = spark.createDataFrame([(1, "http://a/", big), (2, None, big), (3, "http://c/", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (9, "u", "é" * 800), (9, "u", "é" * 800)], "page_id long, url string, html string")
    archives = warc.write_archives(pages, archive_bytes=200)
    got = {(r.record_id, r.record_type, r.payload_bytes, r.refers_to) for r in warc.read_archives(archives).collect()}
    assert got == {(1, "revisit", 1500, 2), (2, "response", 1500, None), (3, "response", 5, None), (4, "response", 5, None), (5, "response", 0, None), (None, "revisit", 1500, 2), (9, "response", 1600, None)}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    path = archives.first().path.removeprefix("file://")
    assert gzip.open(path).read().startswith(b"WARC/1.1\r\n")


def test_warc_damage():
    one = warc.member([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:page:1>")], b"abc" * 50_000)
    assert next(warc.records(io.BytesIO(one + one))).length == 150_000
    assert sum(1 for _ in warc.records(io.BytesIO(one * 3))) == 3
    for bad in (one[:-20], one + one[:30], b"junk" + one, one[:40] + bytes([one[40] ^ 0xFF]) + one[41:]):
        with pytest.raises(warc.WarcError):
            list(warc.records(io.BytesIO(bad)))
    lying = warc.member([("WARC-Type", "response"), ("WARC-Block-Digest", "sha1:" + warc.base32("0" * 40))], b"x")
    with pytest.raises(warc.WarcError):
        list(warc.records(io.BytesIO(lying)))


@pytest.mark.parametrize("text", ["", "plain", "\\", "<", "</turn>", "\\<", "a\n</turn>\n<turn user>\n", "\\\\<<"])
def test_chat_escapes(text):
    formatted, starts, ends = chat.format_turns([("us>e\nr<", text), ("assistant", text)])
    assert chat.parse_turns(formatted) == [("us>e\nr<", text), ("assistant", text)]
    assert chat.unescape(formatted[starts[0] : ends[0]]) == text


def test_chat_long_text():
    text = "<\\" * 200_000 + "x" * 3_000_000
    formatted, _, _ = chat.format_turns([("user", text)])
    assert chat.parse_turns(formatted) == [("user", text)]
    for bad in (formatted[:-1], formatted + "x", "<turn user>\nx</turn>\n"):
        with pytest.raises(ValueError):
            chat.parse_turns(bad)


def test_chat_trees(spark):
    rows_ = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "a", 0.5), ("t", 3, 1, "assistant", "b", 2.0), ("t", 4, 3, "user", None, None), ("t", 5, 2, "user", "x", 0.1), (None, 1, 99, "user", "alone", 0.0)]
    df = spark.createDataFrame(rows_, "tree string, node long, parent long, role string, text string, score double")
    got = {(r.tree, r.rank): chat.parse_turns(r.formatted) for r in chat.format_trees(df, branches=2).collect()}
    assert got == {("t", 1): [("user", "q"), ("assistant", "b"), ("user", "")], ("t", 2): [("user", "q"), ("assistant", "a"), ("user", "x")], (None, 1): [("user", "alone")]}
    assert chat.format_trees(df.limit(0)).count() == 0


def test_chat_long_and_repeated(spark):
    rows_ = [(1, i // 2, "user", f"m{i // 2}", "extra") for i in range(90)]
    df = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_trees(chat.chain(df))
    assert [t for _, t in chat.parse_turns(formatted.first().formatted)] == [f"m{i // 2}" for i in range(90)]


def test_chat_cycle(spark, monkeypatch):
    monkeypatch.setattr(chat, "MAX_DOUBLINGS", 3)
    df = spark.createDataFrame([(1, 1, 2, "u", "a", 0.0), (1, 2, 1, "u", "b", 0.0)], "tree long, node long, parent long, role string, text string, score double")
    with pytest.raises(ValueError):
        chat.paths(df)


def test_no_python_in_native_plans(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for df in (pii.find(docs), mixing.mixed(docs)):
        assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
