"""Decontamination, near-duplicates and search against brute force; the classifier against another solver and labels held out."""

import collections
import math
import random
import types
import time
import zlib

import numpy as np
import pytest

from encore.llm import decontaminate, neardup, quality, search
from encore.llm.shingles import combined, shingles, words

FOLDER = "/root/testdata/sf0.001"
VOCABULARY = [f"w{i}" for i in range(300)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(VOCABULARY, k=n))


def test_words_and_shingles(monkeypatch):
    h, o = words(["Hello wörld, foo", "", "a b", "foo HELLO"])
    assert o.tolist() == [0, 3, 3, 5, 7] and h[0] == h[6] and h[2] == h[5]
    g, owner = shingles(["a b c d e f", "a b", "", "!!", "a b c d e"])
    assert owner.tolist() == [0, 0, 1, 2, 3, 4] and g[0] == g[5] and len(set(g.tolist())) == 5
    long = prose(5000, 1)
    whole = words([long])[0]
    monkeypatch.setattr("encore.llm.shingles.SEGMENT", 100)
    assert (words([long])[0] == whole).all() and len(whole) == 5000


# Decontamination


def test_tiles_find_reordered_passages():
    item = np.arange(1, 31, dtype=np.uint64)
    text = np.concatenate((np.arange(100, 110), item[20:], [7777], item[:10], [8888], item[10:20])).astype(np.uint64)
    found = decontaminate.tiles(text, item, 5)
    assert sorted(n for n, _, _ in found) == [10, 10, 10]
    assert sum(n for n, _, _ in decontaminate.tiles(text, item, 11)) == 0


def test_tiles_do_not_overlap():
    item, text = np.array([1, 2, 3] * 6, np.uint64), np.array([1, 2, 3] * 9 + [5] + [1, 2, 3] * 2, np.uint64)
    found = decontaminate.tiles(text, item, 3)
    for at in (1, 2):
        taken = [p for f in found for p in range(f[at], f[at] + f[0])]
        assert len(taken) == len(set(taken))
    assert sum(n for n, _, _ in found) == 18


def test_decontaminate(spark):
    items = [(1, prose(30, 50)), (2, prose(40, 51)), (3, "two words"), (4, None), (5, ""), (6, prose(30, 50))]
    a, b = items[0][1].split(), items[1][1].split()
    docs = [
        (1, prose(200, 1), 0), (2, prose(50, 2) + " " + items[0][1].upper().replace(" ", ", ") + " " + prose(50, 3), 0), (3, " ".join(b[20:] + ["xx"] + b[:20]), 0), (4, " ".join(a[:8]), 0),
        (5, None, 0), (6, "", 0), (7, "here two words there", 0), (None, items[0][1], 0), (2, prose(50, 2), 0),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for chars in (10**6, 100):  # one block, and several
        got = sorted((r.doc_id or -1, r.item_id) for r in decontaminate.matches(df, bench, block_chars=chars).collect())
        assert got == [(-1, 1), (-1, 6), (2, 1), (2, 6), (3, 2), (7, 3)]
        kept = decontaminate.cleaned(df, bench, block_chars=chars)
        assert kept.columns == df.columns and sorted((r.doc_id, r.text) for r in kept.collect() if r.doc_id in (2, 4, 5)) == [(2, prose(50, 2)), (4, " ".join(a[:8])), (5, None)]
        assert kept.count() == 5
    assert decontaminate.matches(df, bench.limit(0)).count() == 0 and decontaminate.matches(df.limit(0), bench).count() == 0


def brute_tiles(text, item, least):
    """Greedy string tiling by comparing every place with every other."""
    free, open_, out = [True] * len(text), [True] * len(item), []
    while least > 0:
        top, best = min(least, len(item)), []
        for j in range(len(item)):
            for i in range(len(text)):
                n = 0
                while i + n < len(text) and j + n < len(item) and free[i + n] and open_[j + n] and text[i + n] == item[j + n]:
                    n += 1
                if n > top:
                    top, best = n, [(j, i)]
                elif n == top and n:
                    best.append((j, i))
        if not best:
            break
        for j, i in sorted(best):
            if all(free[i : i + top]) and all(open_[j : j + top]):
                free[i : i + top] = open_[j : j + top] = [False] * top
                out.append((top, i, j))
    return out


def test_tiles_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        of = rng.choice([1, 2, 3, 5, 20])
        text, item = ([rng.randint(1, of) for _ in range(rng.randint(0, most))] for most in (40, 25))
        least = rng.choice([1, 2, 3, 5])
        assert decontaminate.tiles(np.array(text, np.uint64), np.array(item, np.uint64), least) == brute_tiles(text, item, least)


def test_matches_brute_force():
    """Seeds and the bound before tiling lose no pair."""
    rng = random.Random(2)
    items = [" ".join(rng.choices("abcd", k=rng.randint(0, 30))) for _ in range(25)]
    texts = [" ".join(rng.choices("abcde", k=rng.randint(0, 60))) for _ in range(25)] + [" ".join(items[i].split()[7:] + items[i].split()[:7]) for i in range(20)]
    seeds = decontaminate.Seeds(list(range(len(items))), *words(items), 5)
    for coverage in (0.3, 0.5, 0.9):
        want = set()
        for i, t in enumerate(texts):
            for j, x in enumerate(items):
                a, b = t.split(), x.split()
                size = sum(n for n, _, _ in brute_tiles(a, b, 5))
                if b and size >= coverage * len(b):
                    want.add((i, j, size))
        assert {(i, j, c) for i, j, _, c, _ in seeds.matches(texts, coverage)} == want


def test_matches_of_repeated_words():
    seeds = decontaminate.Seeds([1], *words(["same " * 2000]), 5)
    began = time.perf_counter()
    assert list(seeds.matches(["same " * 10_000], 0.5)) == [(0, 0, 1, 2000, 2000)]
    assert time.perf_counter() - began < 5


def test_decontaminate_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, prose(30, 50), "a", 1), (2, prose(60, 8), "b", 2)], "doc_id long, text string, item_id string, covered int")
    bench = spark.createDataFrame([(7, prose(30, 50), 0)], "item_id int, text string, doc_id int")
    assert [tuple(r) for r in decontaminate.cleaned(docs, bench).collect()] == [(2, prose(60, 8), "b", 2)]
    assert [(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()] == [(1, 7)]


# Near-duplicates


@pytest.mark.parametrize(("n", "changes"), [(300, 8), (200, 25), (40, 2), (5, 0)])
def test_signatures_estimate_similarity(n, changes):
    random.seed(n)
    agreed, real = [], []
    for i in range(6):
        a = prose(n, i).split() + prose(n // 3, i).split()
        b = list(a)
        for _ in range(changes):
            b[random.randrange(len(b))] = "changed"
        cell, owner = neardup.cells([" ".join(a), " ".join(b)])
        signature = neardup.dart_minhash(cell, owner, 2, 800)
        agreed.append((signature[0] == signature[1]).mean())
        real.append(neardup.weighted_similarity(np.unique(cell[owner == 0]), np.unique(cell[owner == 1])))
    assert abs(np.mean(agreed) - np.mean(real)) < 0.03


def test_multiplicities_count():
    cell, owner = neardup.cells(["a b c d e " * 4, "a b c d e"])
    assert len(np.unique(cell[owner == 0])) == 16 and len(np.unique(cell[owner == 1])) == 1


def brute_classes(rows):
    cell, owner = neardup.cells([t or "" for _, t in rows])
    sets = [set(c.tolist()) for c in np.split(cell, np.searchsorted(owner, np.arange(1, len(rows))))]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                up[top(i)] = top(j)
    low = collections.defaultdict(list)
    for i, (k, _) in enumerate(rows):
        low[top(i)].append(k)
    return {k: min(low[top(i)]) for i, (k, _) in enumerate(rows)}


def test_near_duplicates_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng.randint(1, 120), i)) for i in range(40)]
    base = prose(150, 99).split()
    for i in range(40, 90):  # a large group of near copies, alike to different degrees
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(150)] = f"x{rng.random()}"
        rows.append((i, " ".join(copy)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, None), (203, ""), (204, "!!"), (205, "!!"), (206, "a b"), (207, "A, b!"), (208, prose(3000, 5)), (209, prose(3000, 5) + " end")]
    df = spark.createDataFrame([(k, t, 1, "b") for k, t in rows], "doc_id long, text string, class_id int, bands string")
    got = {r.doc_id: r.class_id for r in neardup.classes(df).collect()}
    assert got == brute_classes(rows)
    kept = neardup.deduplicated(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))


def test_near_duplicates_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 2)
    texts = {i: prose(60, i // 3) + f" tail{i}" for i in range(12)}
    sets = neardup.cell_sets(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    buckets = spark.createDataFrame([(1, i) for i in texts], "bucket long, doc_id long")
    none = spark.createDataFrame([], "node long, class long")
    links = [(r.a, r.b) for r in neardup.block_links(buckets, none, sets, 0.8).collect()]
    assert all(a // 3 == b // 3 for a, b in links)
    joined = neardup.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r["class"] for r in joined} == {i: i // 3 * 3 for i in texts}


def test_near_duplicates_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, "x")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.class_id or -1) for r in neardup.classes(df).collect()) == [(-1, -1), (-1, -1), (1, 1), (1, 1)]
    assert neardup.deduplicated(df).count() == 3
    assert neardup.classes(df.limit(0)).count() == 0


def test_near_duplicates_id_of_two_texts(spark):
    a, b = prose(80, 1), prose(80, 2)
    # id 5 has a copy of 1 and the smallest copy of a text that 7 repeats and 9 nearly is.
    rows = [(1, a), (5, a), (5, b), (7, b), (9, b + " end"), (11, prose(80, 3)), (None, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(df).where("doc_id IS NOT NULL").collect()}
    assert got == {1: 1, 5: 1, 7: 1, 9: 1, 11: 11}
    kept = sorted((r.doc_id or -1, r.text) for r in neardup.deduplicated(df).collect())
    assert kept == sorted([(1, a), (5, b), (11, rows[5][1]), (-1, b)])


def test_near_duplicates_of_test_documents(spark):
    """Classes of the test table against all pairs that share a shingle, compared in full."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    cell, owner = neardup.cells([t or "" for _, t in rows])
    sets = [set(c.tolist()) for c in np.split(cell, np.searchsorted(owner, np.arange(1, len(rows))))]
    holders = collections.defaultdict(list)
    for i, cells_ in enumerate(sets):
        for c in cells_:
            holders[c].append(i)
    pairs = {(a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :]}
    near = [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert len(near) > 50
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in near:
        up[top(a)] = top(b)
    low = collections.defaultdict(list)
    for i, (k, _) in enumerate(rows):
        low[top(i)].append(k)
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == {k: min(low[top(i)]) for i, (k, _) in enumerate(rows)}


def test_deduplicated_keeps_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 1), (2, "a b c", "y", 2), (3, "other", "z", 3)], "doc_id long, text string, _id string, _content int")
    assert sorted(tuple(r) for r in neardup.deduplicated(docs).collect()) == [(1, "a b c", "x", 1), (3, "other", "z", 3)]


# Quality


def test_quality_keeps_clashing_columns(spark):
    good, bad = [(i, prose(50, i), 1) for i in range(40)], [(i, "$$$ ".join(prose(50, i).split()), 0) for i in range(40, 80)]
    labels = spark.createDataFrame([(k, y) for k, _, y in good + bad], "doc_id long, quality int")
    docs = spark.createDataFrame([(k, t, f"s{k}", k, f"p{k}") for k, t, _ in good + bad], "doc_id long, text string, score string, _score long, predicted string")
    kept = quality.accepted(docs, labels)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    rows = kept.collect()
    assert 30 < len(rows) < 50 and all((r.score, r._score, r.predicted) == (f"s{r.doc_id}", r.doc_id, f"p{r.doc_id}") for r in rows)


def test_log_count_ratios_brute_force():
    rng = np.random.default_rng(3)
    rows, y = [np.unique(rng.integers(1, 50, 12)).astype(np.int32) for _ in range(40)], rng.integers(0, 2, 40)
    got = quality.log_count_ratios(rows, y)
    held = {c: [quality.SMOOTHING + sum(f in r for r, k in zip(rows, y) if k == c) for f in range(50)] for c in (0, 1)}
    sums = {c: sum(held[c]) + quality.SMOOTHING * ((1 << quality.BITS) - 50) for c in (0, 1)}
    for f in range(1, 50):
        assert got[f] == pytest.approx(math.log(held[1][f] / sums[1]) - math.log(held[0][f] / sums[0]))


def test_dual_coordinate_descent_reaches_the_optimum():
    """Against projected gradient descent on the dual, on rows that can't be separated."""
    rng = np.random.default_rng(4)
    n, size = 60, 12
    x, y, cost = rng.normal(size=(n, size)), rng.choice([-1.0, 1.0], n), rng.uniform(0.1, 1.0, n)
    kernel = (x @ x.T) * np.outer(y, y)
    alpha, step = np.zeros(n), 1 / np.linalg.eigvalsh(kernel).max()
    for _ in range(20_000):
        alpha = np.clip(alpha - step * (kernel @ alpha - 1), 0, cost)
    primal = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    got = quality.dual_coordinate_descent([np.arange(size, dtype=np.int32)] * n, list(x), y, cost, 3000)
    assert primal(got[:size]) == pytest.approx(primal(x.T @ (alpha * y)), rel=1e-3)


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in quality.op6_quality(spark, folder).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [k for k, r in got.items() if r.held_out and k in labels]
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert np.mean([got[k].predicted == labels[k] for k in held]) > 0.93
    clean = [k for k in held if labels[k] == 1]
    assert np.mean([got[k].predicted for k in clean]) > 0.98


def test_quality_edges(spark):
    good, bad = [(i, prose(50, i), 1) for i in range(60)], [(i, "$$$ ".join(prose(50, i).split()), 0) for i in range(60, 120)]
    labels = spark.createDataFrame([(k, y) for k, _, y in good + bad] + [(1, 0), (None, 1), (500, None)], "doc_id long, quality int")
    docs = spark.createDataFrame([(k, t, 9.0, 1) for k, t, _ in good + bad] + [(None, None, 0.0, 1), (1000, "", 0.0, 1)], "doc_id long, text string, score double, y int")
    got = quality.scored(docs, quality.train(docs, labels))
    assert sorted(got.columns) == ["doc_id", "predicted", "score", "text", "y"]
    rows = got.collect()
    assert len(rows) == 122 and all(r.predicted == 0 for r in rows if r.text and "$$$" in r.text)
    assert quality.accepted(docs, labels).columns == docs.columns
    for few in (labels.limit(0), labels.where("quality = 1")):
        assert quality.scored(docs, quality.train(docs, few)).count() == 122
    assert quality.scored(docs.limit(0), quality.train(docs, labels)).count() == 0


def test_dual_coordinate_descent_separates():
    rows = [np.array([0, 1], np.int32), np.array([0, 2], np.int32)] * 5
    values = [np.array([0.1, 1.0])] * 10
    y = np.array([1.0, -1.0] * 5)
    w = quality.dual_coordinate_descent(rows, values, y, np.full(10, 10.0), 200)
    assert w[1] > 0.9 and w[2] < -0.9


# Search


def test_search_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "SHARDS", 1)
    monkeypatch.setattr(search, "QUERIES", 3)
    rng = random.Random(8)
    table = [(i, prose(rng.randint(0, 80), i % 50)) for i in range(120)] + [(300, None), (301, "!"), (None, "w1 w2"), (40, "w1"), (302, prose(70, 3))]
    df = spark.createDataFrame([(k, t, 1.0) for k, t in table], "doc_id long, text string, score double").repartition(3)
    got = collections.defaultdict(list)
    for r in search.top_k(df, df.where("doc_id % 20 = 0"), k=5).collect():
        got[r.query_id].append((r.rank, r.doc_id, r.score))
    hashes, offsets = words([t or "" for _, t in table])
    counts = [collections.Counter(hashes[s:e].tolist()) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
    lengths = np.diff(offsets)
    n, mean, df_ = len(table), lengths.mean(), collections.Counter(w for c in counts for w in c)
    asked = collections.defaultdict(set)
    for (k, _), c in zip(table, counts, strict=True):
        if k is not None and k % 20 == 0:
            asked[k] |= set(c)
    for q, terms in asked.items():
        want = []
        for (k, _), c, size in zip(table, counts, lengths, strict=True):
            score = sum(math.log1p((n - df_[t] + 0.5) / (df_[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * size / mean)) for t in terms if t in c)
            if score > 0 and k is not None:
                want.append((-round(score, 6), k))
        assert [(k, -s) for s, k in sorted(want)[:5]] == [(k, pytest.approx(s, abs=2e-6)) for _, k, s in sorted(got[q])], q


@pytest.mark.parametrize("dense", [0.0, 0.01, 9.0])
def test_search_shard_blocks(tmp_path, monkeypatch, dense):
    """Many blocks and shards, warm thresholds, ties among copies: equal to a full sort."""
    monkeypatch.setattr(search, "BLOCK", 16)
    monkeypatch.setattr(search, "DENSE", dense)
    rng = np.random.default_rng(4)
    vocabulary = np.sort(rng.integers(0, 2**64, 300, dtype=np.uint64))
    texts = [vocabulary[np.minimum(rng.zipf(1.4, rng.integers(0, 60)), 300) - 1] for _ in range(300)]
    texts[100:140] = [texts[7]] * 40
    mean = float(np.mean([len(t) for t in texts]))
    shards = []
    for i, low in enumerate((0, 110, 230)):
        builder = search.ShardBuilder()
        for k in range(low, (110, 230, 300)[i]):
            builder.add([None if k % 50 == 49 else k - 20], texts[k], np.array([0, len(texts[k])]))
        np.savez(tmp_path / f"{i}.npz", **{k: v for k, v in builder.arrays().items() if k != "df"})
        shards.append(search.Shard(f"file://{tmp_path}/{i}.npz", mean))
    asked = [7, *range(0, 300, 11)]
    pairs = sorted((int(t), q) for q, k in enumerate(asked) for t in np.unique(texts[k]))
    query, every = np.array([q for _, q in pairs]), np.array([t for t, _ in pairs], np.uint64)
    df = collections.Counter(int(t) for x in texts for t in np.unique(x))
    weight = np.array([math.log1p((300 - df[int(t)] + 0.5) / (df[int(t)] + 0.5)) for t in every])
    term, which = np.unique(every, return_inverse=True)
    best, found = np.zeros((len(asked), 5)), np.full((len(asked), 5), np.iinfo(np.int64).max)
    for shard in shards:
        search.search_shard(shard, query, term, which, weight, best, found, 5)
    counts = [collections.Counter(x.tolist()) for x in texts]
    for q in range(len(asked)):
        mine = {int(t): w for t, w, x in zip(every, weight, query, strict=True) if x == q}
        want = []
        for k, c in enumerate(counts):
            score = round(sum(w * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(texts[k]) / mean)) for t, w in mine.items() if t in c), 6)
            if score > 0 and k % 50 != 49:
                want.append((-score, k - 20))
        want = sorted(want)[:5]
        assert found[q][best[q] > 0].tolist() == [k for _, k in want]
        assert best[q][best[q] > 0] == pytest.approx([-s for s, _ in want], abs=2e-6)


def test_search_sums_in_bounded_space(monkeypatch):
    """Postings of pairs of a term and a query add up in a buffer of a few of them as in one."""
    monkeypatch.setattr(search, "_space", [np.empty(13, np.int64), np.empty(13)])
    rng = np.random.default_rng(2)
    sizes = np.sort(rng.integers(1, 8, 20))
    starts = np.concatenate(([0], np.cumsum(sizes))) + 5
    shard = types.SimpleNamespace(place=rng.integers(0, 9, starts[-1]))
    value, at, rows = rng.random(starts[-1]), np.sort(rng.integers(0, 20, 60)), rng.integers(0, 4, 60)
    want = np.zeros((4, 9))
    for t, q in zip(at, rows, strict=True):
        np.add.at(want[q], shard.place[starts[t] : starts[t + 1]], value[starts[t] : starts[t + 1]])
    assert search.sparse_scores(shard, starts, value, at, rows, 4, 9) == pytest.approx(want)
    assert not search.sparse_scores(shard, starts, value, at[:0], rows[:0], 4, 9).any()


@pytest.mark.parametrize("dense", [0.0, 0.01, 9.0])
def test_search_many_candidates(tmp_path, monkeypatch, dense):
    """Blocks of many documents above the threshold, copies and rows of null id among the best; several groups."""
    monkeypatch.setattr(search, "BLOCK", 64)
    monkeypatch.setattr(search, "DENSE", dense)
    monkeypatch.setattr(search, "PAIRS", 7)
    rng = np.random.default_rng(6)
    vocabulary = np.sort(rng.integers(0, 2**64, 80, dtype=np.uint64))
    texts = [vocabulary[np.minimum(rng.zipf(1.3, rng.integers(1, 50)), 80) - 1] for _ in range(200)]
    texts[50:90] = [texts[3]] * 40
    mean = float(np.mean([len(t) for t in texts]))
    builder = search.ShardBuilder()
    for k, t in enumerate(texts):
        builder.add([None if k % 9 == 4 else 500 - k], t, np.array([0, len(t)]))
    np.savez(tmp_path / "0.npz", **{k: v for k, v in builder.arrays().items() if k != "df"})
    shard = search.Shard(f"file://{tmp_path}/0.npz", mean)
    df = collections.Counter(int(t) for x in texts for t in np.unique(x))
    counts = [collections.Counter(x.tolist()) for x in texts]
    for asked in ([3, 10, 11], list(range(0, 200, 7))):
        pairs = sorted((int(t), q) for q, k in enumerate(asked) for t in np.unique(texts[k]))
        term, which = np.unique(np.array([t for t, _ in pairs], np.uint64), return_inverse=True)
        weight = np.array([math.log1p((200 - df[t] + 0.5) / (df[t] + 0.5)) for t, _ in pairs])
        best, found = np.zeros((len(asked), 3)), np.full((len(asked), 3), np.iinfo(np.int64).max)
        search.search_shard(shard, np.array([q for _, q in pairs]), term, which, weight, best, found, 3)
        for q, own in enumerate(asked):
            want = []
            for k, c in enumerate(counts):
                score = round(sum(math.log1p((200 - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(texts[k]) / mean)) for t in counts[own] if t in c), 6)
                if score > 0 and k % 9 != 4:
                    want.append((-score, 500 - k))
            assert found[q].tolist() == [k for _, k in sorted(want)[:3]]
            assert best[q] == pytest.approx([-s for s, _ in sorted(want)[:3]], abs=2e-6)


@pytest.mark.parametrize("together", [1, 2])
def test_search_bundles_of_groups(spark, monkeypatch, together):
    """A task reads its shards once for several groups; the result is that of one group."""
    rng = random.Random(9)
    table = [(i, prose(rng.randint(1, 60), i % 50)) for i in range(100)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(4).localCheckpoint()
    want = {tuple(r) for r in search.top_k(df, df.where("doc_id % 5 = 0"), k=3).collect()}
    monkeypatch.setattr(search, "SHARDS", 2)
    monkeypatch.setattr(search, "QUERIES", 4)
    monkeypatch.setattr(search, "TOGETHER", together)
    got = search.top_k(df, df.where("doc_id % 5 = 0"), k=3).collect()
    assert len(got) == len(want) == 60 and {tuple(r) for r in got} == want


def test_search_empty(spark):
    df = spark.createDataFrame([(1, "!")], "doc_id long, text string")
    assert search.top_k(df, df).count() == 0 and search.top_k(df.limit(0), df).count() == 0


def test_search_negative_and_null_ids(spark):
    df = spark.createDataFrame([(-1, "red cup"), (-7, "red ring"), (None, "red cup"), (0, "cup")], "doc_id long, text string")
    found = search.top_k(df, df.where("doc_id = -1"), k=5).orderBy("rank").collect()
    assert [r.doc_id for r in found][0] == -1 and {r.doc_id for r in found} == {-1, -7, 0}


def test_combined_depends_on_order():
    a = np.array([1, 2, 3], np.uint64)
    assert combined(a, 2)[0] != combined(a[::-1].copy(), 2)[0] and len(combined(a, 4)) == 0
