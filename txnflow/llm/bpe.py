"""Byte-pair encoding and decoding with a vocabulary file of the ``tokenizers`` library.

The file says how a text becomes words (normalisers, a splitting pattern, bytes as letters) and which pairs of
symbols merge, in which order.  Each distinct word is merged once: its symbols form a doubly linked list, the ranks of
neighbouring pairs a priority queue.  The lowest rank is taken, entries that a merge has made stale are skipped, and
the new neighbours are queued.  Decoding concatenates vocabulary strings.

Supported are files of this shape: normalisers NFC, NFD, NFKC, NFKD, Lowercase and Replace by a pattern; a Split
whose matches are the words, then ByteLevel without a pattern of its own; a BPE model without dropout, byte fallback or
word prefix; any decoder but none is refused.  Other files raise an error instead of giving other ids.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from txnflow.llm.wordbytes import pieces

PIECE_BYTES = 4 << 20
CACHED_WORDS = 200_000           # about 70 MB of a Python worker


@functools.cache
def byte_letters() -> str:
    """The letter of each byte: printable ones stand for themselves, the others for U+0100 and on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


def _normaliser(spec: dict) -> Callable[[str], str]:
    kind = spec["type"]
    if kind in ("NFC", "NFD", "NFKC", "NFKD"):
        return functools.partial(unicodedata.normalize, kind)
    if kind == "Lowercase":
        return _lower
    if kind == "Replace":
        what = spec["pattern"]
        pattern = what["Regex"] if "Regex" in what else regex.escape(what["String"])
        return functools.partial(regex.compile(pattern).sub, lambda m, to=spec["content"]: to)
    raise ValueError(f"normaliser {kind} is not supported")


def _lower(text: str) -> str:
    """Lower case of each character by itself; str.lower would choose a final sigma by its neighbours."""
    return text.lower() if "Σ" not in text else "σ".join(x.lower() for x in text.split("Σ"))


class _Words(dict):
    """What is known of a word; long words are not kept, and a full cache starts anew."""

    def __init__(self, bpe: "WordBPE"):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, word: str) -> tuple[bytes, int, str]:
        ids, strings = self.bpe.merge(word), self.bpe.strings
        found = (b" ".join([b"%d" % i for i in ids]), len(ids), " ".join([strings[i] for i in ids]))
        if len(self) >= CACHED_WORDS:
            self.clear()
        if len(word) <= 64:
            self[word] = found
        return found


class WordBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        normal = spec["normalizer"] or {"type": "Sequence", "normalizers": []}
        split, letters = steps
        if (model["type"] != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges")
                or model.get("continuing_subword_prefix") or len(steps) != 2 or split["type"] != "Split"
                or {split["behavior"], split["invert"]} != {"Removed", True} or letters["type"] != "ByteLevel"
                or letters.get("use_regex", True) or letters.get("add_prefix_space") or spec["decoder"] is not None):
            raise ValueError(f"{path}: not a vocabulary file of the supported shape")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = self.vocab
        #: (left id, right id) -> (rank, id of the merged symbol)
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(merges)}
        self.normalisers = [_normaliser(x) for x in (normal["normalizers"] if normal["type"] == "Sequence" else [normal])]
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: added tokens with options are not supported")
        self.breaks = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") \
            if self.special else None
        #: ids of each byte inside a word and at its end; a byte without an id is left out
        self.inner = [ids.get(c) for c in byte_letters()]
        self.final = [ids.get(c + self.suffix) for c in byte_letters()]
        self.complete = None not in self.inner + self.final
        self.strings = {i: s for s, i in (self.vocab | self.special).items()}
        self.known = _Words(self).__getitem__

    def merge(self, word: str) -> list[int]:
        """Ids of one word; a letter outside the vocabulary gives none, as the model has no unknown token."""
        data, inner = word.encode("utf-8"), self.inner
        ids = [inner[b] for b in data]
        ids[-1] = self.final[data[-1]]
        if not self.complete:
            ids = [i for i in ids if i is not None]
        n, merges = len(ids), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            if found := merges.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(queue)
        while queue:
            _, i, left, right, merged = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:        # stale: one of the two has merged since
                continue
            ids[i], ids[j] = merged, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := merges.get((merged, ids[k])):
                    heapq.heappush(queue, (found[0], i, merged, ids[k], found[1]))
            h = before[i]
            if h >= 0 and (found := merges.get((ids[h], merged))):
                heapq.heappush(queue, (found[0], h, ids[h], merged, found[1]))
        return [x for x in ids if x >= 0]

    def pieces(self, text: str) -> list[tuple[bytes, int, str]]:
        """Of each word: its ids in decimal, their number, and the strings of the ids joined by a space."""
        parts = [text] if self.breaks is None else self.breaks.split(text)
        found = []
        for n, part in enumerate(parts):
            if n % 2:
                found.append((b"%d" % self.special[part], 1, part))
                continue
            for step in self.normalisers:
                part = step(part)
            found += map(self.known, self.words(part))
        return found if self.complete else [x for x in found if x[1]]

    def encode(self, text: str) -> list[int]:
        return [int(x) for piece in self.pieces(text) for x in piece[0].split()]

    def decode(self, ids: list[int]) -> str:
        """The strings of the ids, one space between two, as the library does for a file without a decoder."""
        return " ".join(self.strings[i] for i in ids if i in self.strings)


@functools.cache
def load(path: str) -> WordBPE:
    return WordBPE(path)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _tokenised(path: str, text_col: str, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for piece in pieces(batches, text_col, PIECE_BYTES):
            number, ids, text = [], [], []
            for t in _column(piece, text_col).to_pylist():
                found = bpe.pieces(t or "")
                decimals, counts, strings = zip(*found) if found else ((), (), ())
                number.append(sum(counts))
                joined, decoded = b" ".join(decimals), " ".join(strings)
                ids.append([int(x) for x in joined.split()] if full else hashlib.sha256(joined).hexdigest())
                text.append(decoded if full else hashlib.sha256(decoded.encode()).hexdigest())
            kind = pa.list_(pa.int32()) if full else pa.string()
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(number, pa.int64()), pa.array(ids, kind), pa.array(text, pa.string())],
                                             [*piece.schema.names, *(FULL if full else DIGESTS)])
    return run


FULL = ("n_tokens", "token_ids", "decoded")
DIGESTS = ("n_tokens", "ids_sha256", "decoded_sha256")


def _with(docs: DataFrame, path: str, text_col: str, names: tuple, kinds: tuple) -> DataFrame:
    own = docs.select([c for c in docs.columns if c not in names or c == text_col])
    schema = T.StructType([*own.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))])
    return own.mapInArrow(_tokenised(path, text_col, names is FULL), schema)


def encode_documents(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """``docs`` with n_tokens, token_ids and decoded (the ids decoded again, special tokens included).

    A null text counts as empty and has no ids.  Special strings inside a text are special tokens, as is the library's
    default.  Nothing is added, cut or padded.  Rows are independent: all return, in any number and order.  A
    column that has the name of a new one gives way.
    """
    return _with(docs, path, text_col, FULL, (T.LongType(), T.ArrayType(T.IntegerType()), T.StringType()))


def encode_digests(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """As :func:`encode_documents`, with SHA-256 digests of the ids (decimal, one space between) and the decoded text."""
    return _with(docs, path, text_col, DIGESTS, (T.LongType(), T.StringType(), T.StringType()))
