"""Token counts and token files: against the libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from encore.llm import bpe_count, token_files
from encore.llm.mph import PerfectHash

SIGNS = "ab  ▁\n\t<s>0x41é\U0001f600中.,!'\"el the ing\x00　 "
EXTRA = ["", " ", "  ", "a", " a", "a ", "a" * 3000, "the" * 2000, "<|endoftext|>", " x <|endoftext|>  y", "</s> <unk><0x41>", "don't stop, won't.\nNow", "a\n\nb", "x\n y"]


def texts(n=1500):
    random.seed(2)
    return ["".join(random.choice(SIGNS) for _ in range(random.randint(0, 60))) for _ in range(n)] + EXTRA


def test_counts_match_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), bpe_count.Counter(path)
    for t in texts():
        assert own.count(t) == len(library.encode(t)), repr(t)


def test_count_merges_whole_stretch():
    ranks = {"ab": 1.0, "abc": 2.0, "bc": 0.5, "cc": 3.0}
    assert bpe_count.merges_of(ranks, "abcc") == 2  # bc, then abc
    assert bpe_count.merges_of(ranks, "") == 0 and bpe_count.merges_of(ranks, "a") == 0


def test_count_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe_count, "CACHE_ENTRIES", 20)
    own = bpe_count.Counter(public_tokenizers.path("piece_bpe_32k.model"))
    before = [own.count(t) for t in texts(200)]
    assert len(own.words) <= 20 and len(own.parts) <= 20
    assert before == [own.count(t) for t in texts(200)]


def test_counts_table(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "é a", 5), (1, "x", 5), (1, "x", 5)], "doc_id long, text string, n_tokens int")
    got = sorted(map(str, bpe_count.count_tokens(df, public_tokenizers.path("piece_bpe_32k.model"), limit=1).collect()))
    assert len(got) == 4 and any("n_bytes=0, n_tokens=0, over_limit=False" in r for r in got)
    assert bpe_count.count_tokens(df.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_encoder_matches_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library, own = Tokenizer.from_file(path), token_files.Encoder(path)
    every = texts()
    for t, e, ids in zip(every, library.encode_batch(every, add_special_tokens=False), own.encode(every), strict=True):
        assert ids == np.array(e.ids, "<u2").tobytes(), repr(t)


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(1).integers(0, 2**63, n).astype(np.uint64)
    h = PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(n))
    again, size = PerfectHash.load(memoryview(h.dump() + b"tail"))
    assert size == len(h.dump()) and (again.slots(keys) == h.slots(keys)).all()
    with pytest.raises(ValueError):
        PerfectHash.build(np.array([7, 7], np.uint64))


def test_shard_lookup():
    keys = [None, None, -5, 3, 3, 3, 10**12]
    shard = token_files.Shard(token_files.index_bytes(keys, [1, 2, 3, 0, 2, 1, 4], 2), np.arange(13, dtype="<u2").tobytes())
    assert shard.ids(-5).tolist() == [3, 4, 5] and shard.ids(3, 1).tolist() == [6, 7] and shard.ids(None, 1).tolist() == [1, 2] and len(shard.ids(3)) == 0
    assert shard.ids(4) is None and shard.ids(3, 3) is None and shard.ids(0) is None


def test_files_round_trip(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    table = [(5, "five words in a text"), (1, None), (3, "same"), (3, "same"), (2, ""), (9, "end. " * 300)]
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_table(spark.createDataFrame(table, "doc_id long, text string").withColumnRenamed("none", "start"), path).collect())
    at, want = 0, []
    for k, t in sorted(table, key=lambda r: (r[0], r[1] or "")):
        ids = [*Tokenizer.from_file(path).encode(t or "", add_special_tokens=False).ids, 0]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert token_files.token_table(spark.createDataFrame([], "doc_id long, text string"), path).count() == 0


def test_small_shards(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    shards = token_files.with_starts(token_files.write_shards(docs, path, parts=3)).collect()
    assert sum(s.docs for s in shards) == 50
    ordered = sorted(shards, key=lambda s: (s.part, s.seq))
    assert [s.start for s in ordered] == [sum(x.tokens for x in ordered[:i]) for i in range(len(ordered))]
