"""Segmentation with a lexicon table: both modes against plain scans, and against the pattern form."""

import random
import re

import pytest

from txnflow.functions import text as text_functions
from txnflow.operators import lexicon
from txnflow.sources import io

WORDS = ["ab", "abc", "b", "bca", "台北", "台北車站", "車站", "x y", "9a", "\U0001f600é"]


def plain_longest(text, words):
    out, at = [], 0
    while at < len(text):
        found = [w for w in words if text.startswith(w, at)]
        token = max(found, key=len) if found else re.compile(r"[A-Za-z0-9]+|.", re.S).match(text, at)[0]
        out.append(token)
        at += len(token)
    return out


def plain_full(text, words):
    spans = {(a, a + len(w)) for w in words for a in range(len(text)) if text.startswith(w, a)}
    inside = {p for a, b in spans for p in range(a, b)}
    at = 0
    while at < len(text):
        if at in inside:
            at += 1
            continue
        end = at
        while end < len(text) and end not in inside:
            end += 1
        spans |= {m.span() for m in re.compile(r"[A-Za-z0-9]+|.", re.S).finditer(text, at, end)}
        at = end
    return [text[a:b] for a, b in sorted(spans)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(6)
    parts = WORDS + ["a", "c", "z9", " ", "\n", "台", "北", "-", "\U0001f600", ".*", "(", "\\"]
    return ["", None, "abcabca", "台北車站x y", "zzzabzz"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(150)]


def test_both_modes(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts + texts[:20]], "text string").repartition(3)
    words = spark.createDataFrame([(w,) for w in WORDS + WORDS[:3] + ["", None]], "word string")
    longest = {r.text: r.tokens for r in lexicon.segment_longest(df, words).collect()}
    full = {r.text: r.tokens for r in lexicon.segment_full(df, words).collect()}
    distinct = {t for t in texts if t is not None}
    assert longest == {t: plain_longest(t, WORDS) for t in distinct} and all("".join(v) == t for t, v in longest.items())
    assert full == {t: plain_full(t, WORDS) for t in distinct}
    pattern = df.select("text", text_functions.segment(df["text"], WORDS).alias("tokens")).where("text is not null").collect()
    assert all(longest[r.text] == r.tokens for r in pattern)


def test_without_words(spark, texts):
    df = spark.createDataFrame([("ab1 c",), ("",)], "text string")
    none = spark.createDataFrame([], "word string")
    for mode in (lexicon.segment_longest, lexicon.segment_full):
        assert {r.text: r.tokens for r in mode(df, none).collect()} == {"ab1 c": ["ab1", " ", "c"], "": []}
        assert mode(df.limit(0), none).collect() == []


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "words.txt").write_text("  台北車站 \n\nx y\nx y\n\t\n", encoding="utf-8")
    assert {r.word for r in io.read_lexicon_table(spark, f"{tmp_path}/words.txt").collect()} == {"台北車站", "x y"}
    assert io.read_lexicon(spark, f"{tmp_path}/words.txt") == ["x y", "台北車站"]
    with pytest.raises(ValueError):
        io.read_lexicon(spark, f"{tmp_path}/words.txt", most=1)


def test_too_many_lengths(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "MOST_LENGTHS", 2)
    words = spark.createDataFrame([("a" * n,) for n in range(1, 5)], "word string")
    with pytest.raises(ValueError):
        lexicon.segment_longest(spark.createDataFrame([("aaa",)], "text string"), words)


def test_no_word_list_reaches_the_plan(spark):
    """The plan's size does not depend on the number of words."""
    df = spark.createDataFrame([("abc",)], "text string")
    sizes = []
    for n in (10, 5000):
        words = spark.range(n).selectExpr("concat('w', lpad(id, 6, '0')) AS word")
        sizes.append(len(lexicon.lexicon_matches(df, words)._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(sizes[0] - sizes[1]) < 20


def test_substrings_that_are_no_words_do_not_travel(spark):
    """A piece sends each of its words once, with all places, and hardly any other substring; one hash for all changes nothing."""
    import numpy as np
    import pyarrow as pa
    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(400)) for _ in range(50)]
    words = sorted({t[a:a + n] for t in texts[:10] for a, n in ((3, 4), (50, 6), (200, 9))})
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    pieces = lexicon._pieces(df)
    table = spark.createDataFrame([(w,) for w in words], "_word string")
    sent = lexicon._filter(table, 16)
    lengths = sorted({len(w) for w in words})
    found = pieces.mapInArrow(lexicon._places(lengths, sent, 16), "_word string, piece long, places binary").collect()
    assert {r._word for r in found} >= set(words) and len(found) <= 2 * len(words) * pieces.count()
    full = type("All", (), {"value": b"\xff" * (1 << 13)})()
    batch = pa.record_batch([pa.array([0]), pa.array([texts[:3]], pa.list_(pa.string()))], ["piece", "texts"])
    rows = lambda: sorted((w, np.frombuffer(p, "<i4").tolist()) for b in lexicon._places(lengths, full, 16)([batch])
                          for w, p in zip(b["_word"].to_pylist(), b["places"].to_pylist()))
    want, real = rows(), lexicon._Chars.hashes
    lexicon._Chars.hashes = lambda self, first, length: real(self, first, length) * np.uint64(0)
    try:
        assert rows() == want
    finally:
        lexicon._Chars.hashes = real
