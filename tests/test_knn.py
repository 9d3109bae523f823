"""Exact nearest neighbours of split classes against brute force, and what they cost."""

import numpy as np
import pytest

from txnflow.operators import knn

SCHEMA = "id long, label int, features array<double>"


def brute(rows, k):
    out = set()
    for label in {r[1] for r in rows}:
        same = [r for r in rows if r[1] == label]
        x, ids = np.array([r[2] for r in same]), np.array([r[0] for r in same])
        for i in range(len(same)):
            d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
            by = [j for j in np.lexsort((ids, d)) if j != i][:k]
            out |= {(int(ids[i]), label, n + 1, int(ids[j]), round(float(d[j]), 9)) for n, j in enumerate(by)}
    return out


def clustered(rng, n, dim, centres, spread):
    return rng.normal(size=(centres, dim))[rng.integers(0, centres, n)] * 5 + rng.normal(size=(n, dim)) * spread


@pytest.mark.parametrize("dim,spread,block,k", [(2, 0.3, 25, 5), (8, 0.05, 40, 3), (16, 3.0, 30, 5), (3, 0.2, 3, 4), (1, 1.0, 16, 1)])
def test_split_classes_match_brute_force(spark, dim, spread, block, k):
    rng = np.random.default_rng(dim)
    x = clustered(rng, 330, dim, 6, spread)
    x[100:160] = x[100]                                           # more equal rows than a block holds
    x[200:203] = x[0]
    rows = [(int(i), int(i >= 300), x[n].tolist()) for n, i in enumerate(rng.permutation(330))]
    rows += [(1000, 5, [1.0] * dim), (1001, 6, [1.0] * dim), (1002, 6, [2.0] * dim)]
    df = spark.createDataFrame([*rows, (2000, 0, None), (2001, None, [0.0] * dim)], SCHEMA).repartition(4)
    got = {(r.id, r.label, r.nbr_rank, r.nbr_id, round(r.distance, 9)) for r in knn.knn_within_class(df, k, block).collect()}
    assert got == brute(rows, k)


def test_string_ids_and_few_classes(spark):
    rng = np.random.default_rng(3)
    rows = [(f"k{i:03d}", i % 2, rng.normal(size=3).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "id string, label int, features array<double>")
    only = spark.createDataFrame([(1,)], "label int")
    got = knn.knn_within_class(df, 2, 10, classes=only).collect()
    assert len(got) == 45 * 2 and all(int(r.id[1:]) % 2 == int(r.nbr_id[1:]) % 2 == r.label == 1 for r in got)
    whole = {tuple(r) for r in knn.knn_within_class(df, 2, classes=only).collect()}
    assert {(r.id, r.nbr_rank, r.nbr_id) for r in got} == {(a, n, b) for a, _, n, b, _ in whole}
    assert knn.knn_within_class(df.limit(0), 2).collect() == []


def test_copies_fall_with_pruning(spark):
    """20,000 rows in clusters: the second round sends far fewer vectors than a comparison of all pairs of blocks would."""
    rng = np.random.default_rng(1)
    x = clustered(rng, 20_000, 8, 60, 0.1)
    df = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(4)
    block, blocks = 1000, 20
    plan = knn.plan_search(df, {0: len(x)}, 5, block)
    copies = plan.copies()
    print(f"copies {copies}, all pairs of blocks {2 * len(x) * blocks}")
    assert copies < 2 * len(x) * blocks / 10
    some = df.where("id % 500 = 0").collect()
    got = {}
    for r in knn.knn_within_class(df, 5, block).where("id % 500 = 0").collect():
        got.setdefault(r.id, {})[r.nbr_rank] = r.nbr_id
    for q in some:
        d = np.sqrt(((x - np.array(q.features)) ** 2).sum(axis=1))
        d[q.id] = np.inf
        assert [got[q.id][n + 1] for n in range(5)] == np.lexsort((np.arange(len(x)), d))[:5].tolist()


def test_too_many_classes(spark, monkeypatch):
    monkeypatch.setattr(knn, "MOST_CLASSES", 3)
    with pytest.raises(ValueError):
        knn.class_sizes(spark.createDataFrame([(i,) for i in range(5)], "label int"))


def test_temporary_arrays_of_a_search_are_small():
    """A block compared with itself holds little besides its vectors, whatever the number of rows."""
    import tracemalloc
    rng = np.random.default_rng(3)
    x, ids = rng.normal(size=(16_384, 8)), np.arange(16_384)
    tracemalloc.start()
    q, r, d = knn.nearest(ids[:600], x[:600], ids, x, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(q) == 3000 and peak < 100 << 20


def test_cells_are_found_without_copies_of_the_vectors():
    """A batch of wide vectors, as the padded sequences are, gets its cells in little room besides its own."""
    import tracemalloc
    import pyarrow as pa
    rng = np.random.default_rng(5)
    n, dim = 10_000, 400
    x, labels = rng.normal(size=(n, dim)), rng.integers(1, 3, n)
    none = np.empty(0)
    cells = {c: knn._Cells(x[labels == c][:8], none, none, none, none, none) for c in (1, 2)}
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), pa.array(x.ravel()))
    batch = pa.record_batch([pa.array(np.arange(n)), pa.array(labels), vectors], ["id", "label", "features"])
    held = pa.total_allocated_bytes()
    tracemalloc.start()
    (out,) = knn._assign(cells)(iter([batch, batch.slice(0, 0)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes and pa.total_allocated_bytes() - held < 1 << 20 and out.column(2).equals(vectors)
    for c in (1, 2):
        to = np.sqrt(((x[labels == c][:, None, :] - cells[c].pivots[None]) ** 2).sum(axis=2))
        assert (out["cell"].to_numpy()[labels == c] == to.argmin(axis=1)).all()
        assert np.allclose(out["dist"].to_numpy()[labels == c], to.min(axis=1), rtol=1e-12)
    uneven = pa.record_batch([pa.array([1, 2]), pa.array([1, 1]), pa.array([[1.0], [1.0, 2.0, 3.0]])], ["id", "label", "features"])
    with pytest.raises(ValueError):
        list(knn._assign(cells)([uneven]))


def test_blocks_hold_a_fixed_volume():
    """Rows of 42 steps of 22 features: a class of 8,001, which one task held as a whole, is cut; larger ones get more blocks."""
    for total in (8001, 48_006, 1_000_000):
        assert knn.block_rows(42 * 22, total, 5, 16_384) * 42 * 22 * 8 <= 16 << 20
    assert knn.block_rows(8, 20_000, 5, 1000) == 1000 and knn.block_rows(10 ** 9, 100, 5, 1000) == 6
    assert knn.block_rows(924, knn.MOST_BLOCKS * 5000, 5, 16_384) == 5000
