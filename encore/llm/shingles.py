"""Words and word shingles of many texts at once, as 64-bit hashes, in numpy.

A word is a longest run of ASCII letters, digits and non-ASCII characters of the lower-case
text. Its hash comes from prefix sums of byte times power, so it takes a few operations a
byte, without a Python step a word.
"""

from __future__ import annotations

import numpy as np

from encore.llm.mph import mix

BASE = 0x100000001B3
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes that are hashed at a time.
SEGMENT = 1 << 19


def _word_bytes() -> np.ndarray:
    out = np.zeros(256, bool)
    out[128:] = True
    for a, b in (("0", "9"), ("a", "z"), ("A", "Z")):
        out[ord(a) : ord(b) + 1] = True
    return out


WORD_BYTES = _word_bytes()
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a base, modulo 2^64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        factors = np.full(max(n, SEGMENT + 4096), base, np.uint64)
        factors[0] = 1
        with np.errstate(over="ignore"):
            known = np.cumprod(factors, dtype=np.uint64)
        if n <= SEGMENT + 4096:
            _powers[base] = known
    return known[:n]


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's begin (with the end: one more than texts)."""
    parts = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(parts) + b" ", np.uint8)
    lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
    firsts = np.concatenate(([0], np.cumsum(lengths)))
    is_word = WORD_BYTES[data]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], is_word, [False])).view(np.int8)))
    starts, ends = edges[::2], edges[1::2]
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(starts):
            low = starts[at]
            to = max(at + 1, int(np.searchsorted(ends, low + SEGMENT, "right")))
            high = ends[to - 1]
            n = int(high - low)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * powers(BASE, n), out=sums[1:])
            s, e = starts[at:to] - low, ends[at:to] - low
            hashes[at:to] = (sums[e] - sums[s]) * powers(INVERSE, n + 1)[s] + (e - s).astype(np.uint64)
            at = to
    return mix(hashes), np.searchsorted(starts, firsts)


def combined(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive words (over the borders of texts, too)."""
    size = max(0, len(hashes) - n + 1)
    out = np.full(size, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + size]
    return mix(out, 7)


def within(offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The places where n words of one text begin, and the text of each."""
    counts = np.maximum(np.diff(offsets) - n + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(offsets[:-1], counts), owner


def shingles(texts: list[str], n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, and the text of each, in ascending order of texts.

    A text of fewer words has one shingle of all of them; one of no words, one of its signs.
    """
    hashes, offsets = words(texts)
    places, owner = within(offsets, n)
    grams = combined(hashes, n)[places]
    short = np.flatnonzero(np.diff(offsets) < n)
    if len(short):
        extra = []
        for i in short.tolist():
            own = hashes[offsets[i] : offsets[i + 1]]
            if not len(own):
                own, _ = words([texts[i].encode("utf-8", "surrogatepass").hex() or "0"])
            extra.append(combined(own, len(own))[0])
        grams, owner = np.concatenate((grams, np.array(extra, np.uint64))), np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
    return grams, owner
