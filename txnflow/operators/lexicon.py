"""Segmentation with a lexicon of any size, kept as a table.

Every place of a text and every word length of the lexicon make one substring.  Its hash is looked up in a filter of the
lexicon's words, of at most 2^``MOST_FILTER_BITS`` bits, and what passes is joined with the lexicon; so neither a pattern nor a
dictionary of all words is ever built, and substrings that are no words do not travel.  Distinct texts are laid into
pieces of about ``PIECE_CHARS`` characters: a piece sends each of its substrings once, with all its places.

* ``segment_longest``: at each place the longest word that starts there, else a run of ASCII letters and digits, else one
  character (the precise mode);
* ``segment_full``: every word wherever it stands, overlapping ones included, and the runs and characters that
  no word covers (the full mode).

Texts are told apart by their own value: equal texts are segmented once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.session import cut_lineage, ship_package

MOST_LENGTHS = 256             # different word lengths: that many substrings a place
PIECE_CHARS = 1 << 20
MOST_FILTER_BITS = 28          # log2 of the filter's places: 32 MB
WORD_BITS, PROBES = 16, 4      # of the filter for each word
SLOTS = 64                     # parts of the filter made by a task each
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_REST = re.compile(r"[A-Za-z0-9]+|.", re.DOTALL)


def lexicon_words(lines: DataFrame, column: str = "value") -> DataFrame:
    """(word): the distinct lines without the white space around them; empty lines are none."""
    word = F.trim(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))
    return lines.select(word.alias("word")).where("word <> ''").distinct()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Chars:
    """The characters of texts laid end to end, and hashes of any of their substrings."""

    def __init__(self, texts: list[str]):
        self.text = "".join(texts)
        self.ends = np.cumsum([len(t) for t in texts])
        self.codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "<u4")
        size = len(self.codes)
        powers = np.cumprod(np.r_[np.uint64(1), np.full(size, _FACTOR)])
        self.sums = np.cumsum(np.r_[np.uint64(0), _mix(self.codes.astype(np.uint64) + _FACTOR) * powers[:size]])
        self.back = np.cumprod(np.r_[np.uint64(1), np.full(size, _INVERSE)])

    def hashes(self, first: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return _mix((self.sums[first + length] - self.sums[first]) * self.back[first] + np.asarray(length).astype(np.uint64))


def _probe(hashes: np.ndarray, i: int, bits: int) -> np.ndarray:
    """The ``i``-th of a hash's places in a filter of 2^bits."""
    return (hashes + np.uint64(i) * ((hashes >> np.uint64(32)) | np.uint64(1))) & np.uint64((1 << bits) - 1)


def _filter(words: DataFrame, bits: int) -> Broadcast:
    """The filter of the words' hashes, packed."""
    part = bits - SLOTS.bit_length() + 1

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            if texts:
                lengths = np.array([len(t) for t in texts])
                chars = _Chars(texts)
                hashes = chars.hashes(chars.ends - lengths, lengths)
                at = np.unique(np.concatenate([_probe(hashes, i, bits) for i in range(PROBES)]))
                slot = (at >> np.uint64(part)).astype(np.int32)
                cut = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
                packed = [x.tobytes() for x in np.split(at.astype("<u4"), cut[1:])]
                yield pa.record_batch([pa.array(slot[cut]), pa.array(packed, pa.binary())], ["slot", "places"])

    def joined(rows: pa.Table) -> pa.Table:
        full = np.zeros(1 << part, bool)
        full[np.frombuffer(b"".join(rows["places"].to_pylist()), "<u4") & np.uint32((1 << part) - 1)] = True
        return pa.table({"slot": rows["slot"].slice(0, 1).cast(pa.int32()), "bits": pa.array([np.packbits(full, bitorder="little").tobytes()], pa.binary())})

    found = words.mapInArrow(places, "slot int, places binary").groupBy("slot").applyInArrow(joined, "slot int, bits binary").toArrow()
    out = np.zeros((SLOTS, (1 << part) // 8), np.uint8)
    for slot, packed in zip(found["slot"].to_pylist(), found["bits"].to_pylist()):
        out[slot] = np.frombuffer(packed, np.uint8)
    return words.sparkSession.sparkContext.broadcast(out.tobytes())


def _pieces(texts: DataFrame) -> DataFrame:
    """(piece, texts): the distinct texts in pieces of about ``PIECE_CHARS``; a longer text is a piece of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if held and size + len(text) > PIECE_CHARS:
                    yield pa.record_batch([pa.array([number]), pa.array([held], pa.list_(pa.string()))], ["piece", "texts"])
                    number, held, size = number + 1, [], 0
                held.append(text)
                size += len(text)
        if held:
            yield pa.record_batch([pa.array([number]), pa.array([held], pa.list_(pa.string()))], ["piece", "texts"])

    partitions = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(texts.where("text IS NOT NULL").distinct().repartition(partitions, "text").mapInArrow(run, "piece long, texts array<string>"))


def _places(lengths: list[int], sent: Broadcast, bits: int):
    """Pieces to (_word, piece, places): the distinct substrings that pass the filter, with their packed places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            for piece, texts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                chars = _Chars(texts)
                end = np.repeat(chars.ends, np.diff(chars.ends, prepend=0))
                for n in lengths:
                    first = np.flatnonzero(np.arange(len(end)) + n <= end)
                    hashes = chars.hashes(first, n)
                    for i in range(PROBES):
                        at = _probe(hashes, i, bits)
                        ok = (full[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
                        first, hashes = first[ok], hashes[ok]
                    if not len(first):
                        continue
                    _, leader, group = np.unique(hashes, return_index=True, return_inverse=True)
                    same = first[leader][group]
                    if any((chars.codes[first + i] != chars.codes[same + i]).any() for i in range(n)):      # two substrings with one hash
                        _, leader, group = np.unique([chars.text[a:a + n] for a in first.tolist()], return_index=True, return_inverse=True)
                    words = [chars.text[a:a + n] for a in first[leader].tolist()]
                    by = np.argsort(group, kind="stable")
                    offsets = np.r_[0, np.cumsum(np.bincount(group))].astype(np.int32) * 4
                    packed = pa.BinaryArray.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()),
                                                                                  pa.py_buffer(first[by].astype("<i4").tobytes())])
                    yield pa.record_batch([pa.array(words, pa.string()), pa.array(np.full(len(words), piece)), packed], ["_word", "piece", "places"])
    return run


def _by_piece(made: Callable, schema: pa.Schema):
    """A piece and its words: what ``made`` makes of a text and its (start, length), by start, then length."""
    def run(pieces: pa.Table, found: pa.Table) -> pa.Table:
        texts = pieces["texts"][0].as_py()
        ends = np.cumsum([len(t) for t in texts])
        places = np.frombuffer(b"".join(found["places"].to_pylist()), "<i4")
        lengths = np.repeat(found["n"].to_numpy(), [len(p) // 4 for p in found["places"].to_pylist()]).astype(np.int64)
        by = np.lexsort((lengths, places))
        places, lengths = places[by], lengths[by]
        cuts = np.searchsorted(places, np.r_[0, ends])
        return pa.Table.from_pylist([row for i, t in enumerate(texts)
                                     for row in made(t, (places[cuts[i]:cuts[i + 1]] - (ends[i] - len(t))).tolist(), lengths[cuts[i]:cuts[i + 1]].tolist())], schema)
    return run


def _with_words(texts: DataFrame, lexicon: DataFrame, text: str, word: str, made: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    ship_package(texts.sparkSession)
    words = cut_lineage(lexicon.select(F.col(word).alias("_word")).where("_word <> ''").distinct())
    lengths = [r[0] for r in words.select(F.length("_word")).distinct().limit(MOST_LENGTHS + 1).collect()]
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"words of more than {MOST_LENGTHS} different lengths")
    bits = min(MOST_FILTER_BITS, max(16, (WORD_BITS * words.count() - 1).bit_length()))
    pieces = _pieces(texts.select(F.col(text).alias("text")))
    places = pieces.mapInArrow(_places(sorted(lengths), _filter(words, bits), bits), "_word string, piece long, places binary")
    found = places.join(words, "_word", "left_semi").select("piece", F.length("_word").alias("n"), "places")
    return pieces.groupBy("piece").cogroup(found.groupBy("piece")).applyInArrow(_by_piece(made, schema), ddl)


def lexicon_matches(texts: DataFrame, lexicon: DataFrame, text: str = "text", word: str = "word") -> DataFrame:
    """(text, start, length): every place of every distinct text where a word of the lexicon stands; places count from 0."""
    schema = pa.schema([("text", pa.string()), ("start", pa.int32()), ("length", pa.int32())])
    return _with_words(texts, lexicon, text, word, lambda t, starts, lengths: [{"text": t, "start": a, "length": n} for a, n in zip(starts, lengths)],
                       schema, "text string, start int, length int")


def _walk(text: str, longest: dict[int, int]) -> list[tuple[int, int]]:
    out, at = [], 0
    while at < len(text):
        end = at + longest[at] if at in longest else _REST.match(text, at).end()
        out.append((at, end))
        at = end
    return out


def _cover(text: str, words: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out, covered = list(words), 0
    for start, length in sorted(words):
        if start > covered:
            out += [(m.start(), m.end() - m.start()) for m in _REST.finditer(text, covered, start)]
        covered = max(covered, start + length)
    out += [(m.start(), m.end() - m.start()) for m in _REST.finditer(text, covered)]
    return [(start, start + length) for start, length in sorted(out)]


def _segment(texts: DataFrame, lexicon: DataFrame, text: str, full: bool) -> DataFrame:
    def made(t: str, starts: list[int], lengths: list[int]) -> list[dict]:
        words = zip(starts, lengths)
        spans = _cover(t, list(words)) if full else _walk(t, dict(words))      # the longest of a place comes last
        return [{"text": t, "tokens": [t[a:b] for a, b in spans]}]

    schema = pa.schema([("text", pa.string()), ("tokens", pa.list_(pa.string()))])
    return _with_words(texts, lexicon, text, "word", made, schema, "text string, tokens array<string>")


def segment_longest(texts: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """(text, tokens) of every distinct text but null; an empty text has no tokens.  Tokens joined give the text again."""
    return _segment(texts, lexicon, text, False)


def segment_full(texts: DataFrame, lexicon: DataFrame, text: str = "text") -> DataFrame:
    """(text, tokens): words by place, shorter ones first, and what no word covers."""
    return _segment(texts, lexicon, text, True)
