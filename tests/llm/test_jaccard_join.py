"""Signature-tree Jaccard join against brute force."""

import random

import numpy as np
import pytest
from edge import ascii_lower, spaced
from test_documents_ops import near_groups, same_rows

from txnflow.llm import jaccard_join


def groups(rows, size, percent=80):
    """(id, set size, component); texts without words are on their own."""
    out = []
    for (i, n, component, _) in near_groups(rows, size, percent):
        out.append((i, n, component if n else i))
    return out


@pytest.mark.parametrize("size,percent", [(5, 80), (2, 80), (1, 50), (2, 100)])
def test_jaccard_groups(edge_docs, edge_rows, size, percent):
    got = jaccard_join.jaccard_groups(edge_docs, shingle=size, percent=percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    same_rows(got.collect(), groups(edge_rows, size, percent))


def chains(rng):
    rows = []
    for _ in range(4):
        words = [rng.choice("abcdefghijkl") + str(rng.randint(0, 99)) for _ in range(60)]
        for _ in range(45):
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = "w" + str(rng.randint(0, 10 ** 6))
            if rng.random() < 0.2:
                words.insert(rng.randrange(len(words)), "more")
            rows.append((rng.randint(0, 10 ** 9), " ".join(words)))
            if rng.random() < 0.2:
                rows.append((rng.randint(0, 10 ** 9), " ".join(words).upper()))
    return rows


@pytest.mark.parametrize("block", [400, 64_000])
def test_large_groups(spark, monkeypatch, block):
    """Chains of near copies whose ends are similar only to some members, in many small blocks or in one."""
    rows = chains(random.Random(5))
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = groups(rows, 2)
    same_rows(jaccard_join.jaccard_groups(docs, shingle=2).collect(), want)
    assert 4 < len({w[2] for w in want}) < len(rows) // 2
    monkeypatch.setattr(jaccard_join, "PIECE_BYTES", 2000)
    monkeypatch.setattr(jaccard_join, "RANGE_SHINGLES", 500)
    same_rows(jaccard_join.jaccard_groups(docs, shingle=2).collect(), want)


def test_shared_passages_do_not_link(spark):
    """A passage in every document amid other words; some documents are made of passages alone."""
    rng = random.Random(8)
    own = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    passages = [own(30) for _ in range(6)]
    rows = [(i, " ".join(own(20) + passages[i % 6] + own(20))) for i in range(120)]
    rows += [(1000 + i, " ".join(sum(rng.sample(passages, 3), []) + own(i % 5))) for i in range(80)]
    want = groups(rows, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    same_rows(jaccard_join.jaccard_groups(docs).collect(), want)
    assert len({w[2] for w in want}) < len(rows)


def test_jaccard_groups_of_nothing(no_docs):
    assert jaccard_join.jaccard_groups(no_docs).collect() == []


def test_dual_traversal_loses_no_similar_pair():
    """All pairs at the threshold come through, also with few bits; most others do not."""
    gen = np.random.default_rng(4)
    sets = []
    for _ in range(40):
        base = gen.integers(0, 1 << 62, gen.integers(5, 60), dtype=np.uint64)
        for _ in range(gen.integers(1, 6)):
            some = base[gen.random(len(base)) < 0.95]
            sets.append(np.unique(some if len(some) else base))
    elements, bounds = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    similar = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 80 * (len(sets[i]) + len(sets[j]) - k)}
    for bits in (64, 256, 1024):
        tree = jaccard_join.SignatureTree(elements, bounds, np.arange(len(sets)), bits)
        found = [(int(tree.records[a]), int(tree.records[b])) for i, j in jaccard_join.dual_traversal(tree, tree, 80) for a, b in zip(i, j)]
        assert len(found) == len(set(found)) and {(max(p), min(p)) for p in found} >= similar
        half = len(sets) // 2
        x, y = (jaccard_join.SignatureTree(elements, bounds, r, bits) for r in (np.arange(half), np.arange(half, len(sets))))
        across = {(int(y.records[b]), int(x.records[a])) for i, j in jaccard_join.dual_traversal(x, y, 80) for a, b in zip(i, j)}
        assert across >= {p for p in similar if p[0] >= half > p[1]}
    assert len(found) < 3 * len(similar) and len(similar) > 40
