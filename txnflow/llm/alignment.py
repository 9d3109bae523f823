"""Alignment of two tokenisations of the same bytes.

Both tokenizers cut a document's bytes, so a token is a byte range and a tokenisation a sorted list of range ends.

1. The shorter list of ends drives a galloping search in the longer: from where the last end was found the step doubles
   until it passes the next one, and a binary search in that bracket gives its rank.  Many stretches of
   the lists advance at once, each from its own place.
2. Ends that stand in both lists cut the tokens into groups.  The ranks of two consecutive ends say which tokens of the
   longer list a token of the shorter overlaps: these are its links.
3. How often two ids are linked is counted over the whole corpus: each piece of a few MB of text numbers its
   distinct id pairs, and only these, with their counts, are grouped.  The totals come back to the piece, where
   its documents keep their links as numbers of pairs.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnflow.llm.bpe import byte_letters
from txnflow.llm.tables import written
from txnflow.llm.wordbytes import pieces

PIECE_BYTES = 4 << 20
STRETCH = 64                      # ends that one galloping cursor passes
LONG_BLANK = 20_000               # white space that tiktoken's pattern can't pass
#: The pattern of byte-level BPE files that split text by the library's own rule.
BYTE_LEVEL = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_BLANK = re.compile(r"\s{%d}" % LONG_BLANK)


class Tokens:
    """A tokenizer whose tokens are byte strings; special strings inside texts are plain text."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda texts: model.encode(texts, num_threads=1, add_bos=False, add_eos=False)
            self.prefix = ""                                  # the model itself begins a text with a space
            names = [(model.id_to_piece(i), model.is_byte(i)) for i in range(model.get_piece_size())]
            self.bytes = [bytes([int(p[3:5], 16)]) if raw else p.replace("▁", " ").encode() for p, raw in names]
        else:
            self.prefix = " "
            self.encode, self.bytes = _byte_level(path)
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)


def _byte_level(path: str):
    """The encoder of a byte-level BPE file, and the bytes of its ids.

    Files whose merges are in the order of the ids they make, which tiktoken needs, are run by tiktoken: it gives the
    library's ids in a fifth of the time.  Its pattern fails on very long white space; such texts, and other
    files, are run by the library itself.
    """
    @functools.cache
    def library():
        from tokenizers import Tokenizer
        made = Tokenizer.from_file(path)
        made.encode_special_tokens = True
        made.no_truncation()
        made.no_padding()
        return made

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split, vocab = spec["model"], spec["pre_tokenizer"], spec["model"]["vocab"]
    if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"]:
        raise ValueError(f"{path}: not a byte-level BPE file")
    values = {c: b for b, c in enumerate(byte_letters())}
    special = {t["content"] for t in spec["added_tokens"]}
    table = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        if token not in special:
            table[i] = bytes(values[c] for c in token)
    slow = lambda texts: [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    if made != sorted(made) or not split["use_regex"] or model.get("dropout") or model.get("ignore_merges"):
        return slow, table
    import tiktoken
    fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL, mergeable_ranks={b: i for i, b in enumerate(table) if b}, special_tokens={})
    return lambda texts: [slow([t])[0] if len(t) >= LONG_BLANK and _BLANK.search(t) else fast.encode_ordinary(t) for t in texts], table


@functools.cache
def load(path: str) -> Tokens:
    return Tokens(path)


def gallop(needles: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The rank in ``ends`` of the first value not below each needle; both ascend, and no needle exceeds the last end."""
    n, last = len(needles), len(ends) - 1
    lanes = -(-n // STRETCH)
    padded = np.concatenate([needles, np.full(lanes * STRETCH - n, needles[-1] if n else 0)]).reshape(lanes, STRETCH)
    ranks = np.empty((lanes, STRETCH), np.int64)
    at = np.searchsorted(ends, padded[:, 0])
    for k in range(STRETCH):
        x = padded[:, k]
        lo, hi, step = at.copy(), at.copy(), 1
        while len(short := np.flatnonzero(ends[hi] < x)):          # doubling steps
            lo[short] = hi[short] + 1
            hi[short] = np.minimum(hi[short] + step, last)
            step *= 2
        while len(wide := np.flatnonzero(lo < hi)):                  # halving the bracket
            middle = (lo[wide] + hi[wide]) // 2
            below = ends[middle] < x[wide]
            lo[wide] = np.where(below, middle + 1, lo[wide])
            hi[wide] = np.where(below, hi[wide], middle)
        ranks[:, k] = at = hi
    return ranks.ravel()[:n]


def _spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... (many[i] values) for each i."""
    ends = np.cumsum(many)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + many, many)


def _driven(short: np.ndarray, long: np.ndarray):
    """For each end of the shorter list: is it common, and the first and last token of the longer that its token overlaps.

    The ends of several documents, none of them empty, go on from one to the next.
    """
    last = gallop(short, long)
    common = long[last] == short
    first = np.concatenate([[0], last[:-1] + common[:-1]])           # the end of a document is always common
    return common, first, last


@functools.cache
def _names(size: int) -> np.ndarray:
    """Decimal ids, followed by each of the marks."""
    return np.array([[f"{i}{mark}" for i in range(size)] for mark in ",|;"], object)


class Piece:
    """The aligned documents of one piece: flat token ids of both sides, groups and links."""

    def __init__(self, texts: list[str], a: Tokens, b: Tokens):
        ids, raw = [], [(" " + t).encode() if t else b"" for t in texts]
        for side in (a, b):
            got = side.encode([side.prefix + t for t in texts])
            ids.append([x if data and b"".join(map(side.bytes.__getitem__, x)) == data else [] for x, data in zip(got, raw)])
        for n, (x, y) in enumerate(zip(*ids)):
            if not x or not y:
                ids[0][n] = ids[1][n] = []
        self.a, self.b = (np.concatenate([np.asarray(x, np.int64) for x in side] or [np.empty(0, np.int64)]) for side in ids)
        self.at_a, self.at_b = (np.concatenate([[0], np.cumsum([len(x) for x in side])]).astype(np.int64) for side in ids)
        self.vocabulary = len(a.bytes), len(b.bytes)
        self._align(np.cumsum(a.lengths[self.a]), np.cumsum(b.lengths[self.b]))

    def _align(self, ends_a: np.ndarray, ends_b: np.ndarray) -> None:
        docs = len(self.at_a) - 1
        many_a, many_b = np.diff(self.at_a), np.diff(self.at_b)
        by_a = many_a <= many_b                             # the shorter list drives
        self.closes_a, self.closes_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        links = []
        for drives, short, long, at_s, at_l, flip in ((by_a, ends_a, ends_b, self.at_a, self.at_b, False),
                                                      (~by_a, ends_b, ends_a, self.at_b, self.at_a, True)):
            doc = np.flatnonzero(drives & (many_a > 0))
            if not len(doc):
                continue
            n_s, n_l = (at_s[doc + 1] - at_s[doc]), (at_l[doc + 1] - at_l[doc])
            own_s, own_l = _spread(at_s[doc], n_s), _spread(at_l[doc], n_l)
            common, first, last = _driven(short[own_s], long[own_l])
            many = last - first + 1
            here, there = np.repeat(own_s, many), own_l[_spread(first, many)]
            links.append((there, here) if flip else (here, there))
            ours, theirs = (self.closes_b, self.closes_a) if flip else (self.closes_a, self.closes_b)
            ours[own_s[common]] = True
            theirs[own_l[last[common]]] = True
        self.link_a, self.link_b = (np.concatenate(x) for x in zip(*links)) if links else (np.empty(0, np.int64),) * 2
        self.link_doc = np.repeat(np.arange(docs), many_a)[self.link_a]
        sums = lambda flags, at: np.concatenate([[0], np.cumsum(flags)])[at[1:]] - np.concatenate([[0], np.cumsum(flags)])[at[:-1]]
        self.counts = (many_a, many_b, sums(self.closes_a, self.at_a), np.bincount(self.link_doc, minlength=docs))

    def groups(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` for each document: decimal ids, groups in order; '' without tokens."""
        group_a = np.cumsum(self.closes_a) - self.closes_a
        group_b = np.cumsum(self.closes_b) - self.closes_b
        before_a = np.searchsorted(group_b, group_a)                  # tokens of the other side that come first
        before_b = np.searchsorted(group_a, group_b, "right")
        out = np.empty(len(self.a) + len(self.b), object)
        names = _names(max(self.vocabulary))
        out[np.arange(len(self.a)) + before_a] = names[self.closes_a * 1, self.a]
        out[np.arange(len(self.b)) + before_b] = names[self.closes_b * 2, self.b]
        at = (self.at_a + self.at_b).tolist()
        flat = out.tolist()
        return ["".join(flat[lo:hi])[:-1] for lo, hi in zip(at[:-1], at[1:])]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Distinct id pairs of all links (a * 2^32 + b), how often each is linked, and each document's links.

        A document's links are the numbers of its distinct pairs, as differences, and how often it has each.
        """
        keys, number, total = np.unique((self.a[self.link_a] << 32) | self.b[self.link_b], return_inverse=True, return_counts=True)
        own, times = np.unique(self.link_doc * max(len(keys), 1) + number, return_counts=True)
        doc, number = np.divmod(own, max(len(keys), 1))
        at = np.searchsorted(doc, np.arange(len(self.at_a)))
        pack = zstandard.ZstdCompressor(level=1).compress
        packed = [pack(np.concatenate([np.diff(number[lo:hi], prepend=0), times[lo:hi]]).astype("<u4").tobytes()) if hi > lo else b""
                  for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())]
        return keys, total, packed


def _aligned(a_path: str, b_path: str, text_col: str, finish):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = load(a_path), load(b_path)
        task = TaskContext.get().partitionId() << 32
        for number, piece in enumerate(pieces(batches, text_col, PIECE_BYTES)):
            at, n = piece.schema.get_field_index(text_col), piece.num_rows
            found = Piece([t or "" for t in piece.column(at).to_pylist()], a, b)
            keys, total, links = found.pairs()
            first = pa.array(np.concatenate([[0], np.full(n, len(keys))]).astype(np.int32))      # all in the first row's lists
            own = [c for i, c in enumerate(piece.columns) if i != at]
            yield pa.RecordBatch.from_arrays(
                [*own, *[pa.array(c, pa.int64()) for c in found.counts], pa.array(finish(found.groups()), pa.string()),
                 pa.array(np.full(n, task + number)), pa.array(links, pa.binary()),
                 pa.ListArray.from_arrays(first, pa.array(keys)), pa.ListArray.from_arrays(first, pa.array(total, pa.int64()))],
                [*[c for i, c in enumerate(piece.schema.names) if i != at], *COUNTS, "groups", "__piece", "__links", "__pairs", "__totals"])
    return run


def _scored(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of a piece with n_best and count_sum, from the corpus counts of the piece's pairs."""
    by = np.argsort(pairs["pos"].to_numpy())
    count, best = pairs["count"].to_numpy()[by], pairs["best"].to_numpy()[by]
    unpack = zstandard.ZstdDecompressor().decompress
    n_best, count_sum = [], []
    for links in docs["__links"].to_pylist():
        numbers, times = np.frombuffer(unpack(links) if links else b"", "<u4").astype(np.int64).reshape(2, -1)
        numbers = np.cumsum(numbers)
        n_best.append(int(times[best[numbers]].sum()))
        count_sum.append(int((times * count[numbers]).sum()))
    docs = docs.drop_columns(["__piece", "__links"])
    return docs.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))


def _same(groups: list[str]) -> list[str]:
    return groups


def _digests(groups: list[str]) -> list[str]:
    import hashlib
    return [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text", digests: bool = False) -> DataFrame:
    """``docs`` without its text, with n_a, n_b, n_groups, n_links, groups, n_best and count_sum.

    ``a_path`` is a byte-level BPE file of the tokenizers library, which encodes a space and the text; ``b_path`` a
    sentencepiece model that begins a text with a space by itself.  (Either may stand on either side.)  Special strings
    inside texts are plain text.  ``groups`` lists the ids of both sides between common ends, as ``a1,a2|b1;a3|b2,b3``, or
    with ``digests`` its SHA-256 ('' stays '').  A link is a pair of tokens whose byte ranges overlap; its count is
    the number of links of all documents between the same two ids; n_best counts the links whose count is the highest
    of their b id, ties included; count_sum adds the counts of a document's links.

    A text that is null or empty, or whose tokens of either side are not the bytes of a space and the text, has no
    tokens: zeros, and groups ''.  Rows are independent of ids: repeated ones count each; all return, in any number
    and order; no rows give none.  A column of ``docs`` that has the name of a new one gives way.
    """
    new = (*COUNTS, "groups", "n_best", "count_sum")
    docs = docs.select([c for c in docs.columns if c == text_col or c not in new])
    own = [f for f in docs.schema.fields if f.name != text_col]
    fields = [*own, *[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("groups", T.StringType())]
    kept = [T.StructField("__piece", T.LongType()), T.StructField("__links", T.BinaryType())]
    lists = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("__pairs", "__totals")]
    rows = written(docs.mapInArrow(_aligned(a_path, b_path, text_col, _digests if digests else _same), T.StructType([*fields, *kept, *lists])),
                   "aligned")
    # A pair stands once a piece, however many links it has there.
    pairs = rows.where(F.size("__pairs") > 0).select("__piece", F.posexplode(F.arrays_zip("__pairs", "__totals")).alias("pos", "at")) \
        .select("__piece", "pos", F.col("at.__pairs").alias("pair"), F.col("at.__totals").alias("n"))
    counts = written(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "pair_counts")
    b_id = F.col("pair").bitwiseAND((1 << 32) - 1)
    highest = counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("highest"))         # at most one row a vocabulary entry
    counts = counts.withColumn("b", b_id).join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    looked = pairs.select("__piece", "pos", "pair").join(counts, "pair") \
        .select(F.col("__piece").alias("piece"), "pos", "count", "best")
    scored = T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in ("n_best", "count_sum")]])
    return rows.drop("__pairs", "__totals").groupBy("__piece").cogroup(looked.groupBy("piece")).applyInArrow(_scored, scored)
