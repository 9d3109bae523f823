"""Filter interactions against plain counting over all orders."""

import itertools
import math
import random
from collections import Counter

import pytest
from edge import spaced, text_of

from txnflow.llm import filter_audit
from txnflow.llm.q12_filter_audit import LETTERS, failing

MASKS = "part string, mask int, n long, good long, toxic long"


def plain(rows, letters):
    """rows (part, set of failing letters, good, toxic) to the audit's rows."""
    out = []
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        total = Counter()
        found = []
        for order in itertools.permutations(letters):
            left = mine
            for step, letter in enumerate(order, 1):
                removed = [r for r in left if letter in r[1]]
                left = [r for r in left if letter not in r[1]]
                total[letter] += len(removed)
                found.append(("".join(order), step, len(left), len(removed), sum(letter in r[1] for r in mine) - len(removed),
                              sum(r[1] == {letter} for r in mine), sum(r[2] for r in removed), sum(r[3] for r in removed)))
        out += [(part, *f, total[f[0][f[1] - 1]]) for f in found]
    return out


@pytest.mark.parametrize("letters", ["A", "AB", "XQZ", "ABCDE"])
def test_masks(spark, letters):
    rng = random.Random(len(letters))
    rows = [(rng.choice(["", "p", "q"]), {c for c in letters if rng.random() < 0.4}, int(rng.random() < 0.3), int(rng.random() < 0.2)) for _ in range(200)]
    rows += [("none", set(), 0, 0)] * 3
    table = [(p, sum(1 << letters.index(c) for c in m), 1, g, t) for p, m, g, t in rows]
    got = filter_audit.audit_masks(spark.createDataFrame(table, MASKS).repartition(3), letters)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert Counter(map(tuple, got.collect())) == Counter(plain(rows, letters))


def test_intervals_cover_each_order_once():
    for k in (1, 2, 3, 5):
        for mask in range(1 << k):
            hit = Counter(r for m, _, lo, hi in filter_audit.removal_intervals(k) if m == mask for r in range(lo, hi))
            assert hit == Counter({r: 1 for r in range(math.factorial(k))} if mask else {})
        orders = [filter_audit.order_of(r, "ABCDE"[:k]) for r in range(math.factorial(k))]
        assert orders == sorted(map("".join, itertools.permutations("ABCDE"[:k])))


def failed(rows):
    """Failing letters of each (id, text) row by the contract's words."""
    out = []
    for i, text in rows:
        t, w = text or "", spaced(text)
        smaller = [j for j, u in rows if (u or "") == t and j is not None and (i is None or j < i)]
        conditions = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t),
                      "D": any(c in "#$%&*|" for c in t), "E": bool(smaller)}
        out.append({c for c, v in conditions.items() if v})
    return out


def test_documents(spark, edge_rows, no_docs):
    rng = random.Random(1)
    rows = edge_rows + [(200 + n, rng.choice(["50% off", "A B C", "x" * 10, "| a", text_of(rng, 250), "W" * 4 + " w" * 300])) for n in range(60)] + \
        [(260, "50% off"), (260, "50% off"), (None, "50% off"), (199, "A B C")]
    sources = [rng.choice(["s1", "s2", "", None]) for _ in rows]
    flags = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in sorted({i for i, _ in rows if i is not None}) if i % 2] + [(7, 1, 0), (None, 1, 1), (12345, 1, 1)]
    docs = spark.createDataFrame([(i, t, s, 1, "k") for (i, t), s in zip(rows, sources)],
                                 "doc_id long, text string, source string, mask int, good string").repartition(4)
    labels = spark.createDataFrame(flags, "doc_id long, quality int, toxic int")
    got = filter_audit.audit_masks(filter_audit.count_masks(docs, labels, failing()), LETTERS)
    good = {i for i, q, _ in flags if i is not None and q == 1}
    toxic = {i for i, _, x in flags if i is not None and x == 1}
    want = plain([(s or "", m, int(i in good), int(i in toxic)) for (i, _), s, m in zip(rows, sources, failed(rows))], LETTERS)
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert len(want) == 3 * 600 and sum("E" in m for m in failed(rows)) > 20
    none = no_docs.withColumnRenamed("n_words", "source")
    assert filter_audit.audit_masks(filter_audit.count_masks(none, labels, failing()), LETTERS).collect() == []
    unlabelled = filter_audit.audit_masks(filter_audit.count_masks(docs, labels.limit(0), failing()), LETTERS)
    assert {(r.good_lost, r.toxic_lost) for r in unlabelled.collect()} == {(0, 0)}


def test_letters_are_checked(spark):
    for letters in ("", "AA", "ABCDEFG"):
        with pytest.raises(ValueError):
            filter_audit.audit_masks(spark.createDataFrame([], MASKS), letters)
