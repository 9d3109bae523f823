"""Language identification by rank-order profiles.

A profile ranks byte n-grams (one to three bytes of lower-cased letters, words set off by blanks) by how often they
occur.  A document's own most frequent n-grams are compared with each language's: the out-of-place distance adds,
over the document's n-grams, how far their ranks differ; an n-gram that the language's profile lacks is
as far as the profile is long.  The nearest language is predicted.

Profiles count the n-grams of all learning documents: each task sums its own per language before the shuffle.  What
reaches the driver, and goes back to the tasks, are ``PROFILE`` n-grams a language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from txnflow.llm import wordbytes

PROFILE = 400
PIECE_BYTES = 2 << 20
SALTS = 16
UNDETERMINED = "und"
_ALL = np.arange(256, dtype=np.uint8)
#: ASCII letters in lower case and all bytes of other characters; the rest separates words.
LETTERS = np.where(((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80), _ALL, wordbytes.SPACE).astype(np.uint8)


def ngrams(texts: pa.Array) -> list[np.ndarray]:
    """The codes of all n-grams of each text; an n-gram may begin or end with a blank, not hold one inside."""
    words = wordbytes.scan(pc.utf8_lower(texts), LETTERS).tight()
    stream = np.concatenate([[wordbytes.SPACE], words.data]).astype(np.uint32)       # a blank before each word
    letter = stream != wordbytes.SPACE
    two = stream[:-1] | stream[1:] << np.uint32(8)
    three = two[:-1] | stream[2:] << np.uint32(16)
    is_two, is_three = letter[:-1] | letter[1:], letter[1:-1]
    ends = np.concatenate([[0], words.end + 1])[words.first].tolist()                # in data; one less than in stream
    out = []
    for lo, hi in zip(ends[:-1], ends[1:]):
        one = stream[lo + 1:hi + 1]
        out.append(np.concatenate([one[letter[lo + 1:hi + 1]], two[lo:hi][is_two[lo:hi]], three[lo:hi - 1][is_three[lo:hi - 1]]])
                   if hi > lo else stream[:0])
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, n), summed over the task."""
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for piece in wordbytes.pieces(batches, "text", PIECE_BYTES):
        by_lang: dict[str, list[np.ndarray]] = {}
        for lang, codes in zip(piece.column(0).to_pylist(), ngrams(piece.column(1))):
            by_lang.setdefault(lang, []).append(codes)
        for lang, parts in by_lang.items():
            codes, n = np.unique(np.concatenate(parts), return_counts=True)
            if lang in held:
                old, old_n = held[lang]
                every, at = np.unique(np.concatenate([old, codes]), return_inverse=True)
                codes, n = every, np.bincount(at, np.concatenate([old_n, n])).astype(np.int64)
            held[lang] = codes, n
    for lang, (codes, n) in held.items():
        yield pa.record_batch([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n, pa.int64())],
                              ["lang", "gram", "n"])


def learn_profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """Each language's most frequent n-grams, most frequent first, ties by code.  Rows without language are not used."""
    counts = (docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
              .mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
              .withColumn("salt", F.col("gram") % SALTS))
    order = Window.partitionBy("lang", "salt").orderBy(F.desc("n"), "gram")
    best: dict[str, list[tuple[int, int]]] = {}
    for r in counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE).collect():
        best.setdefault(r["lang"], []).append((-r["n"], r["gram"]))
    return {lang: [gram for _, gram in sorted(found)[:PROFILE]] for lang, found in sorted(best.items())}


def _top(codes: np.ndarray) -> np.ndarray:
    grams, n = np.unique(codes, return_counts=True)
    order = n.astype(np.int64) << 24 | (0xFFFFFF - grams.astype(np.int64))           # more often first, then the smaller code
    if len(order) > PROFILE:
        order = np.partition(order, len(order) - PROFILE)[-PROFILE:]
    return 0xFFFFFF - (np.sort(order)[::-1] & 0xFFFFFF)


def _predict(text_col: str, profiles: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = list(profiles.value)
        known = np.unique(np.concatenate([np.array(p, np.int64) for p in profiles.value.values()])) if langs else np.empty(0, np.int64)
        ranks = np.full((len(langs), len(known) + 1), -1, np.int64)                  # the last column: n-grams in no profile
        for i, lang in enumerate(langs):
            ranks[i, np.searchsorted(known, profiles.value[lang])] = np.arange(len(profiles.value[lang]))
        for piece in wordbytes.pieces(batches, text_col, PIECE_BYTES):
            text = piece.column(piece.schema.get_field_index(text_col))
            lettered = piece.column(piece.num_columns - 1).to_pylist()
            found, score = [], []
            for codes, some in zip(ngrams(text), lettered):
                if not some or not langs:
                    found.append(UNDETERMINED)
                    score.append(0.0)
                    continue
                top = _top(codes)
                at = np.minimum(np.searchsorted(known, top), len(known) - 1)
                at = np.where(known[at] == top, at, len(known))
                mine = ranks[:, at]
                distance = np.where(mine < 0, PROFILE, np.abs(mine - np.arange(len(top)))).sum(axis=1)
                best = int(distance.argmin())
                found.append(langs[best])
                score.append(1.0 - float(distance[best]) / (PROFILE * len(top)))
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], pa.array(found, pa.string()), pa.array(score, pa.float64())],
                                             [*piece.schema.names[:-1], "lang_pred", "score"])
    return run


def identify_languages(docs: DataFrame, profiles: dict[str, list[int]], text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1: one less the mean out-of-place distance, as a share of the largest).

    A null text, one without any letter, and every text if there are no profiles, is ``und`` with score 0.  Equal
    distances: the language that sorts first.  All rows return; a column that has the name of a new one gives way.
    """
    sent = docs.sparkSession.sparkContext.broadcast(profiles)
    own = docs.select([c for c in docs.columns if c not in ("lang_pred", "score") or c == text_col])
    schema = T.StructType([*own.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return own.withColumn("__lettered", lettered).mapInArrow(_predict(text_col, sent), schema)
