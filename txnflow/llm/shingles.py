"""Sets of word shingles and their SuperMinHash signatures, for all texts of a batch at once."""

from __future__ import annotations

import numpy as np

from txnflow.llm.wordbytes import Words, grams, mix, stream

U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, one text after the other, and where each text's begin.

    A text of fewer than ``size`` words, but not none, has its whole sequence as its one shingle.
    Shingles are 64-bit hashes of their words.
    """
    hashes, counts = words.hashes(), words.counts()
    every = grams(hashes, size)
    tags = mix(stream(31, size))
    short = {n: grams(hashes, n) for n in range(1, size) if (counts == n).any()}
    sets = []
    for lo, n in zip(words.first[:-1].tolist(), counts.tolist()):
        if n >= size:
            sets.append(np.unique(every[lo:lo + n - size + 1]))
        else:
            sets.append(short[n][lo:lo + 1] ^ tags[n] if n else hashes[:0])
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    return (np.concatenate(sets) if sets else hashes[:0]), bounds


def superminhash(elements: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures, one row of ``m`` for each set; an empty set has only infinities.

    Every element owns a random permutation of the ``m`` places and a random number in [0, 1) for each step: at
    step j it offers j + random at its j-th place, and a place keeps its smallest offer.  Step j of all elements
    is done at once.  A set stops as soon as all its places are below j + 1, for no later offer can be
    smaller: large sets end after two or three steps, small ones have few elements.
    """
    sets = len(bounds) - 1
    least = np.full(sets * m, np.inf)
    owner = np.repeat(np.arange(sets), np.diff(bounds))
    seeds = elements
    swaps: list[np.ndarray] = []            # the place that step t exchanged with place t, for each element
    steps = np.arange(1, m + 1, dtype=np.uint64) * _STEP
    order: np.ndarray | None = None         # once few elements are left: their whole permutations
    for j in range(m):
        if not len(seeds):
            break
        x = mix(seeds + steps[j])
        offer = j + (x >> U64(11)).astype(np.float64) * 2.0 ** -53
        k = j + ((mix(x) >> U64(32)) * U64(m - j) >> U64(32)).astype(np.int64)
        if order is None:
            place = k
            for t in range(j - 1, -1, -1):
                place = np.where(place == swaps[t], t, place)
            swaps.append(k)
        else:
            row = np.arange(len(seeds))
            place = order[row, k].astype(np.int64)
            order[row, k] = order[:, j]
        np.minimum.at(least, owner * m + place, offer)
        going = (least.reshape(sets, m).max(axis=1) >= j + 1)[owner]
        if not going.all():
            seeds, owner = seeds[going], owner[going]
            swaps = [s[going] for s in swaps]
            order = order[going] if order is not None else None
        if order is None and len(seeds) * m <= 1 << 22:
            order = np.tile(np.arange(m, dtype=np.int32), (len(seeds), 1))
            row = np.arange(len(seeds))
            for t, s in enumerate(swaps):
                moved = order[row, s].copy()
                order[row, s] = order[:, t]
                order[:, t] = moved
            swaps = []
    return least.reshape(sets, m)


def band_keys(signatures: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of equally many places; sets share a key if they agree on the whole band."""
    sets, m = signatures.shape
    bits = signatures.view(np.uint64).reshape(sets, bands, m // bands)
    factors = stream(41, m // bands) | U64(1)
    return mix((bits * factors).sum(axis=2, dtype=np.uint64) + stream(43, bands))


def set_digests(elements: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, whatever the order of its elements."""
    ends = np.concatenate([[U64(0)], np.cumsum(mix(elements), dtype=np.uint64)])
    more = np.concatenate([[U64(0)], np.cumsum(mix(elements ^ _STEP), dtype=np.uint64)])
    return ends[bounds[1:]] - ends[bounds[:-1]], more[bounds[1:]] - more[bounds[:-1]]
