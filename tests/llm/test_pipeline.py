"""The corpus pipeline against its stages one by one."""

import random

import corpus_pipeline
from encore.llm import decontaminate, neardup, quality

FOLDER = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.written(stage(spark, rows, FOLDER))
        assert rows.columns == docs.columns, name
        kept.append(rows)
    good = quality.accepted(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert {r.doc_id for r in kept[0].select("doc_id").collect()} == {r.doc_id for r in good.select("doc_id").collect()}
    assert {r.doc_id for r in kept[1].select("doc_id").collect()} == {r.class_id for r in neardup.classes(kept[0]).collect()}
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    bad = {r.doc_id for r in decontaminate.matches(kept[1], bench).collect()}
    assert bad and {r.doc_id for r in kept[2].select("doc_id").collect()} == {r.doc_id for r in kept[1].select("doc_id").collect()} - bad
    tokens = corpus_pipeline.run(spark, FOLDER).collect()
    mixed = sorted(r.doc_id for r in kept[3].select("doc_id").collect())
    assert sorted(r.doc_id for r in tokens) == mixed and len(mixed) > len(set(mixed))
    ends = sorted((r.start, r.n_tokens) for r in tokens)
    assert ends[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))


def test_stages_with_edges(spark, tmp_path):
    """Nulls, empty texts, repeated rows, an empty table and columns of clashing names, stage by stage."""
    names = "score size _id _copy item_id target".split()
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    words = [f"w{i}" for i in range(400)]
    text = lambda i: " ".join(random.Random(i).choices(words, k=40))
    docs = [(i, text(i), "en", f"s{i % 3}", 9) for i in range(30)] + [(None, text(99), "en", None, 9), (40, None, None, None, None), (41, "", "en", "s0", 0), (5, text(5), "en", "s2", 9), (50, text(7), "en", "s1", 9)]
    docs = spark.createDataFrame([(*r, *(f"{n}{r[0]}" for n in names)) for r in docs], schema)
    spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(30)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, text(3)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        rows = got.collect()
        assert got.columns == docs.columns and dict(got.dtypes) == dict(docs.dtypes), name
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        ids = sorted(r.doc_id for r in rows if r.doc_id is not None)
        if name == "MinHash near-dedup":  # empty and null are copies, as are 7 and 50, and both rows of 5
            assert ids == [*range(30), 40] and len(rows) == 32
        if name == "benchmark decontamination":
            assert ids == sorted([*range(3), *range(4, 30), 5, 40, 41, 50])
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert len(tokens) == 35 and min(r.n_tokens for r in tokens) == 1
