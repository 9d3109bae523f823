"""A quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Words are runs of letters and digits, or of other characters that are not white space, so that punctuation
glued to words is a word of its own.  Unigrams and bigrams are hashed to 2^18 places, and a bigram of a word and itself
is counted at one place more, shared by all words.  A document's vector holds log(1 + count), scaled to length one; a score is the sparse dot product with the weights.

The fit uses a bounded sample of labelled documents, about ``SAMPLE`` chosen by a hash of their id, whatever the size of
the tables.  Their vectors are made by all tasks; one task then does the sequential updates.  Scoring reads every
document once and shuffles nothing; the weights, 2^18 numbers, are sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnflow.llm import wordbytes

BITS = 18
SAMPLE = 8000                  # labelled documents that the fit uses, about
PIECE_BYTES = 2 << 20
EPOCHS = 6
ALPHA, BETA, L1, L2 = 5.0, 1.0, 0.05, 0.01    # of the updates
ONE = np.uint64(1)             # place 0 is the constant
TWICE = 2                      # the place of all bigrams of a word and itself

_ALL = np.arange(256, dtype=np.uint8)
_LETTER = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x41) & (_ALL <= 0x5A)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
_CLASS = np.where(_LETTER, 2, np.where((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)), 0, 1)).astype(np.uint8)


def runs(texts: pa.Array) -> wordbytes.Words:
    """Runs of letters and digits, and runs of other visible characters, as words."""
    data, at = wordbytes.flat(texts)
    kind = _CLASS[data]
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[at] = True
    edge = np.flatnonzero(new)
    edge = edge[edge <= len(data)]
    start, end = edge[:-1], edge[1:]
    shown = kind[start] != 0 if len(start) else np.empty(0, bool)
    start, end = start[shown], end[shown]
    return wordbytes.Words(data, start, end, np.searchsorted(start, at))


def vectors(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and values of each text's vector; place 0 is the constant 1, kept out of the scaling."""
    words = runs(texts)
    one = words.hashes()
    two = wordbytes.grams(one, 2)
    mask = np.uint64((1 << BITS) - 1)
    one = wordbytes.mix(one + np.uint64(1)) & mask
    twice = np.append(one[1:] == one[:-1], False)
    two = two & mask
    out = []
    for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        last = max(lo, hi - 1)
        again = np.full(int(twice[lo:last].sum()), TWICE, np.uint64)
        places, n = np.unique(np.concatenate([np.maximum(one[lo:hi], ONE), np.maximum(two[lo:last], ONE), again]), return_counts=True)
        value = np.log1p(n)
        value /= max(1e-12, np.sqrt(value @ value))
        places = places.astype(np.int64)
        out.append((np.concatenate([[0], places]), np.concatenate([[1.0], value])))
    return out


def ftrl(examples: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Weights after ``EPOCHS`` passes of FTRL-proximal updates over (places, values, label)."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, x, y in examples:
            w = weights(at)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    return weights(np.arange(1 << BITS))


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(turn, label, text) to (turn, label, places, values)."""
    for piece in wordbytes.pieces(batches, "text", PIECE_BYTES):
        found = vectors(piece.column(2))
        yield pa.record_batch([piece.column(0), piece.column(1), pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())),
                               pa.array([f[1].astype(np.float32) for f in found], pa.list_(pa.float32()))], ["turn", "label", "places", "values"])


def _fit(table: pa.Table) -> pa.Table:
    table = table.sort_by([("turn", "ascending"), ("label", "ascending")])
    places, values = (table[c].combine_chunks() for c in ("places", "values"))
    at, x, bounds = places.flatten().to_numpy(), values.flatten().to_numpy().astype(np.float64), places.offsets.to_numpy()
    bounds = bounds - bounds[0]
    examples = [(at[lo:hi], x[lo:hi], float(y)) for lo, hi, y in zip(bounds[:-1], bounds[1:], table["label"].to_numpy())]
    return pa.table([pa.array([ftrl(examples).astype(np.float32).tobytes()], pa.binary())], names=["weights"])


def learn(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> np.ndarray:
    """Weights from the rows of ``labels`` (id, label 0 or 1) where ``learnable`` holds; zeros if there are none.

    Null ids, texts and labels teach nothing.  A repeated label counts each time.
    """
    turn = F.xxhash64(id_col)
    usable = labels.where(F.coalesce(learnable, F.lit(False)) & F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()) \
        .select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("label"), turn.alias("turn"))
    share = SAMPLE / max(SAMPLE, usable.count())
    sample = usable.where(F.pmod("turn", F.lit(1 << 30)) < int(share * (1 << 30)))
    found = (docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("text")).where("text is not null")
             .join(F.broadcast(sample), "__id")                    # about SAMPLE rows
             .select("turn", "label", "text").mapInArrow(_examples, "turn long, label int, places array<int>, values array<float>"))
    rows = found.withColumn("model", F.lit(0)).groupBy("model").applyInArrow(_fit, "weights binary").collect()
    return np.frombuffer(rows[0]["weights"], np.float32) if rows else np.zeros(1 << BITS, np.float32)


def _score(text_col: str, weights: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value.astype(np.float64)
        for piece in wordbytes.pieces(batches, text_col, PIECE_BYTES):
            found = vectors(piece.column(piece.schema.get_field_index(text_col)))
            total = np.array([w[at] @ x for at, x in found])
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))],
                                             [*piece.schema.names, "score"])
    return run


def score_quality(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1, higher: label 1 is likelier).  Null and empty texts get the score of no words.

    Rows are independent; all return.  A column that is called score gives way.
    """
    own = docs.select([c for c in docs.columns if c != "score" or c == text_col])
    schema = T.StructType([*own.schema.fields, T.StructField("score", T.DoubleType())])
    return own.mapInArrow(_score(text_col, docs.sparkSession.sparkContext.broadcast(weights)), schema)
