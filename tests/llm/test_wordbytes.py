import random

import numpy as np
import pyarrow as pa
import pytest

from edge import alnum, ascii_lower, spaced
from txnflow.llm import shingles, wordbytes as wb

rng = random.Random(1)
TEXTS = [None, "", "  ", "a", "A b", "é\x0bÀ x y", "\x1ca b9-3", " z", "w" * 700] + \
    ["".join(rng.choice("aB9 \n-éÀ\x00") for _ in range(rng.randint(0, 30))) for _ in range(400)]


@pytest.mark.parametrize("kind,words_of", [(wb.SPACED, spaced), (wb.ALNUM, alnum), (wb.FOLDED, lambda t: spaced(ascii_lower(t or "")))])
@pytest.mark.parametrize("array", [pa.array(TEXTS), pa.array(["q r", *TEXTS])[1:], pa.array(TEXTS, pa.large_string())])
def test_words_and_hashes(kind, words_of, array):
    words, seen = wb.scan(array, kind), {}
    tight, hashes = words.tight(), words.hashes()
    assert (tight.hashes() == hashes).all()
    for i, text in enumerate(TEXTS):
        span = range(words.first[i], words.first[i + 1])
        want = [w.encode() for w in words_of(text)]
        assert [words.data[words.start[k]:words.end[k]].tobytes() for k in span] == want
        if want:
            assert tight.slice(span[0], span[-1] + 1) == b" ".join(want)
        for k, w in zip(span, want):
            assert seen.setdefault(w, hashes[k]) == hashes[k]
    assert len(set(seen.values())) == len(seen)


def test_pieces_keep_all_rows_and_lone_long_texts():
    batch = pa.record_batch([pa.array(["a" * n for n in (5, 0, 90, 3, 3, 3)])], ["text"])
    found = [p.column(0).to_pylist() for p in wb.pieces([batch], "text", 10)]
    assert sum(found, []) == batch.column(0).to_pylist() and ["a" * 90] in found


@pytest.mark.parametrize("width", range(1, 25))
def test_sliding_min(width):
    a = np.array([rng.randint(0, 99) for _ in range(50)])
    assert list(wb.sliding_min(a, width)) == [min(a[i:i + width]) for i in range(51 - width)]


def _superminhash(elements, m):
    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    least = [float("inf")] * m
    for e in elements:
        order = list(range(m))
        for j in range(m):
            x = mix(e + (j + 1) * 0x9E3779B97F4A7C15 & mask)
            k = j + ((mix(x) >> 32) * (m - j) >> 32)
            order[j], order[k] = order[k], order[j]
            least[order[j]] = min(least[order[j]], j + (x >> 11) * 2.0 ** -53)
    return least


def test_superminhash_equals_the_sequential_form():
    gen = np.random.default_rng(1)
    sets = [np.unique(gen.integers(0, 2 ** 63, n).astype(np.uint64)) for n in (0, 1, 2, 5, 30, 200, 3)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    for m in (1, 7, 40):
        got = shingles.superminhash(np.concatenate(sets), bounds, m)
        for row, s in zip(got, sets):
            assert list(row) == _superminhash([int(x) for x in s], m)


def test_shingles_of_short_texts():
    words = wb.scan(pa.array(["a b", "a", "A B", "", "a b c", "b a", None]), wb.FOLDED)
    elements, bounds = shingles.shingle_sets(words, 3)
    sets = [frozenset(elements[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    assert [len(s) for s in sets] == [1, 1, 1, 0, 1, 1, 0]
    assert sets[0] == sets[2] and len({*sets}) == 5
