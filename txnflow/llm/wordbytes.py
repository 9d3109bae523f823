"""Words of a whole Arrow text column at once.

The texts of a batch lie one after the other in a single byte buffer, so words,
their hashes and windows over them are found with array operations instead of a
Python loop over words.  A word never crosses the end of its text; a null text has
no words.  Two kinds of word are offered, both defined on UTF-8 bytes:

``SPACED``   ``[^\\x20\\x09-\\x0D]+``, unchanged;
``FOLDED``   the same with A-Z lower-cased;
``ALNUM``    ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SPACE = 0x20
_ALL = np.arange(256, dtype=np.uint8)
_SPACES = (_ALL == SPACE) | ((_ALL >= 0x09) & (_ALL <= 0x0D))
_LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 0x20, _ALL).astype(np.uint8)
_LETTERS = ((_LOWER >= 0x30) & (_LOWER <= 0x39)) | ((_LOWER >= 0x61) & (_LOWER <= 0x7A)) | (_LOWER >= 0x80)
SPACED = np.where(_SPACES, SPACE, _ALL).astype(np.uint8)
FOLDED = np.where(_SPACES, SPACE, _LOWER).astype(np.uint8)
ALNUM = np.where(_LETTERS, _LOWER, SPACE).astype(np.uint8)

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit integers."""
    step = U64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + U64(seed) * U64(1 << 32)) * step)


_LENGTH = U64(0x9E3779B97F4A7C15)
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
LONG_WORD = 256


@dataclass
class Words:
    data: np.ndarray       # uint8: all texts with separators made spaces
    start: np.ndarray      # int64: offset of each word in data
    end: np.ndarray
    first: np.ndarray      # int64, one more than texts: words [first[i], first[i+1]) are text i's

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The index of the text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: eight bytes at a time, so words of up to eight bytes of a length never collide."""
        lens = self.end - self.start
        if not len(lens):
            return np.empty(0, np.uint64)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded, strides=(1,))
        out = mix((eight[self.start] & _MASK[np.minimum(lens, 8)]) + lens.astype(np.uint64) * _LENGTH)
        at, more = 8, np.flatnonzero((lens > 8) & (lens <= LONG_WORD))
        while len(more):
            block = eight[self.start[more] + at] & _MASK[np.minimum(lens[more] - at, 8)]
            out[more] = mix(out[more] * _LENGTH + block)
            at += 8
            more = more[lens[more] > at]
        for i in np.flatnonzero(lens > LONG_WORD):
            out[i] = xxhash.xxh3_64_intdigest(self.data[self.start[i]:self.end[i]].tobytes())
        return out

    def tight(self) -> "Words":
        """The same words with exactly one space after each."""
        lens = self.end - self.start
        end = np.cumsum(lens + 1)
        out = np.full(int(end[-1]) if len(end) else 0, SPACE, np.uint8)
        letters = np.ones(len(out), bool)
        letters[end - 1] = False
        out[letters] = self.data[self.data != SPACE]
        return Words(out, end - 1 - lens, end - 1, self.first)

    def slice(self, lo: int, hi: int) -> bytes:
        """Words lo..hi-1 with what stands between them."""
        return self.data[self.start[lo]:self.end[hi - 1]].tobytes()


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each text begins (one offset more than texts)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def scan(texts: pa.Array, kind: np.ndarray) -> Words:
    raw, at = flat(texts)
    data = kind[raw]
    inside = data != SPACE
    before = np.empty(len(data), bool)
    before[:1] = False
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < len(data)]] = False
    after = np.empty(len(data), bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    return Words(data, start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(start, at))


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of a piece have about ``most`` bytes; a longer text is a piece of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = flat(batch.column(batch.schema.get_field_index(column)))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours; shorter than ``values`` by ``width - 1``."""
    if len(values) < width:
        return values[:0]
    span, least = 1, values
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[:len(least) - rest], least[rest:]) if rest else least


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive word hashes; shorter than ``hashes`` by ``n - 1``."""
    if len(hashes) < n:
        return hashes[:0]
    size = len(hashes) - n + 1
    total = np.zeros(size, np.uint64)
    for i, factor in enumerate(stream(23, n) | U64(1)):
        total += hashes[i:i + size] * factor
    return mix(total)
