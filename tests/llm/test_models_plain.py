"""The out-of-place distance and the FTRL updates against plain forms of their definitions."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from edge import spaced, text_of
from pyspark.sql import functions as F

from txnflow.llm import language_id, quality


# language identification ------------------------------------------------------------------------------------------------

def grams_of(text):
    """Counts of byte n-grams by code."""
    letters = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in (text or "").lower().encode())
    words = letters.split()
    stream = b" " + b"".join(w + b" " for w in words)
    found = Counter()
    for n in (1, 2, 3):
        for i in range(len(stream) - n + 1):
            g = stream[i:i + n]
            if b" " not in g[1:-1] and g.strip():
                found[sum(b << 8 * k for k, b in enumerate(g))] += 1
    return found


def ranked(counts):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:language_id.PROFILE]]


def predicted(text, profiles):
    top = ranked(grams_of(text))
    best = None
    for lang in sorted(profiles):
        rank = {g: i for i, g in enumerate(profiles[lang])}
        distance = sum(abs(i - rank[g]) if g in rank else language_id.PROFILE for i, g in enumerate(top))
        if best is None or distance < best[0]:
            best = distance, lang
    return best[1], 1 - best[0] / (language_id.PROFILE * len(top))


def test_languages(spark, edge_rows):
    rng = random.Random(3)
    alphabets = {"aa": "abcdef", "bb": "defghi", "cc": "éüñabg", "dd": "xyz"}
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n))
    learned = [(lang, make(letters, 200)) for lang, letters in alphabets.items() for _ in range(3)]
    profiles = language_id.learn_profiles(spark.createDataFrame(learned, "lang string, text string").repartition(3))
    want = {}
    for lang in alphabets:
        counts = Counter()
        for name, text in learned:
            counts += grams_of(text) if name == lang else Counter()
        want[lang] = ranked(counts)
    assert profiles == want
    texts = [make(letters, n) for letters in alphabets.values() for n in (1, 3, 60)] + ["Abc Éü! xyz 12", "aa", "x"] + [t for _, t in edge_rows]
    texts = [t for t in texts if t and any(c.isalpha() for c in t)]
    rows = language_id.identify_languages(spark.createDataFrame([(t,) for t in texts], "text string"), profiles).collect()
    assert len(rows) == len(texts)
    for r in rows:
        lang, score = predicted(r.text, profiles)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-12)


# quality ----------------------------------------------------------------------------------------------------------------

def plain_ftrl(examples):
    """FTRL-proximal one coordinate at a time."""
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for at, values, y in examples:
            w = {i: weight(i) for i in at}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in zip(at, values))))
            for i, v in zip(at, values):
                g = (p - y) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z if weight(i)}


def test_quality_weights_and_scores(spark):
    rng = random.Random(5)
    rows = [(i, text_of(rng, rng.randint(0, 30)) + (" !!! $$" if i % 3 else " fine words")) for i in range(60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, quality int")
    weights = quality.learn(docs, labels, F.col("doc_id") % 4 != 0)
    turns = dict(labels.select("doc_id", F.xxhash64("doc_id")).collect())
    taught = sorted((turns[i], int(i % 3 == 0), i, t) for i, t in rows if i % 4 and t is not None)
    found = quality.vectors(pa.array([t for *_, t in taught]))
    want = plain_ftrl([(at.tolist(), x.astype(np.float32).astype(float).tolist(), y) for (at, x), (_, y, _, _) in zip(found, taught)])
    got = {int(i): float(weights[i]) for i in np.flatnonzero(weights)}
    assert set(got) == set(want) and len(want) > 50
    assert all(got[i] == pytest.approx(want[i], rel=1e-5, abs=1e-7) for i in want)
    scores = {r.doc_id: r.score for r in quality.score_quality(docs, weights).collect()}
    for (i, text), (at, x) in zip(rows, quality.vectors(pa.array([t for _, t in rows], pa.string()))):
        total = sum(got.get(int(a), 0.0) * v for a, v in zip(at, x))
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-6)


def test_quality_vectors():
    """Counts of words and of pairs of neighbours, one place for the constant, and length one."""
    text = "alpha beta alpha beta beta !!"
    (at, x), = quality.vectors(pa.array([text]))
    words = [w for w in spaced(text)]
    counts = Counter(words) + Counter(zip(words, words[1:])) + Counter({"again": 1})          # beta beta
    want = sorted(math.log1p(n) for n in counts.values())
    norm = math.sqrt(sum(v * v for v in want))
    assert at[0] == 0 and x[0] == 1.0 and np.allclose(np.sort(x[1:]), [v / norm for v in want])
