"""Sequences in blocks: order, bounds and padding, with a hot actor, nulls and ties."""

import random

import pytest
from pyspark.sql import functions as F

from txnflow.operators import step_blocks as sb
from txnflow.sources import io

SCHEMA = "actor_id string, label int, action_epoch long, event string, f double, g int"


def plain(rows, T):
    """{(actor, label): last T steps}, by sorting each actor's rows."""
    out = {}
    for a, y, t, e, f, g in rows:
        out.setdefault((a, y), []).append(((t is not None, t or 0, e is not None, e or ""), (f, float(g) if g is not None else None)))
    return {k: [v for _, v in sorted(items, key=lambda i: i[0])][-T:] for k, items in out.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    hot = [("hot", 1, 1000 + i // 3, f"e{i:05d}", float(i), i % 7) for i in range(3000)]      # all within one hour
    few = [(f"a{i}", i % 3, rng.randrange(10 ** 6), f"e{j}", rng.random(), j) for i in range(20) for j in range(i)]
    edge = [(None, 0, 5, "x", 1.0, 1), (None, 0, None, "y", None, None), ("two", 0, 1, "p", 1.0, 1), ("two", 1, 2, "q", 2.0, 2),
            ("two", 0, 3, "r", 3.0, 3), ("none", None, 7, "z", 4.0, 4)]
    out = hot + few + edge
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("T,size", [(3000, 100), (50, 16), (1, 4), (7, 1000)])
def test_blocks_hold_the_sequence(spark, rows, T, size):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    blocks = sb.step_blocks(df, ["f", "g"], T, size)
    found = blocks.collect()
    assert max(len(r.steps) for r in found) <= size and len({(r.actor_id, r.label, r.block) for r in found}) == len(found)
    got = {}
    for r in sorted(found, key=lambda r: r.block):
        assert r.block * size <= r.first_step and r.first_step + len(r.steps) <= min((r.block + 1) * size, T)
        got.setdefault((r.actor_id, r.label), []).extend((v[0], v[1]) for v in r.steps)
    assert got == plain(rows, T)
    steps = sb.unpack_blocks(blocks, ["actor_id", "label"], size).where("actor_id = 'hot'").orderBy("step").collect()
    assert [r.step for r in steps] == list(range(T - len(steps), T)) and [r.value[0] for r in steps] == [v[0] for v in plain(rows, T)["hot", 1]]


@pytest.mark.parametrize("T,size", [(3000, 512), (20, 16), (16, 16), (3, 100)])
def test_padded_blocks(spark, rows, T, size):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = sb.padded_blocks(df, ["f", "g"], T, size).collect()
    want = plain(rows, T)
    assert len(found) == len(want) * -(-T // size)
    for (a, y), steps in want.items():
        mine = sorted((r for r in found if (r.actor_id, r.label) == (a, y)), key=lambda r: r.block)
        dense = [tuple(v) for r in mine for v in r.steps]
        assert dense == [(0.0, 0.0)] * (T - len(steps)) + steps
        assert [len(r.steps) for r in mine[:-1]] == [size] * (len(mine) - 1)


def test_a_hot_actor_is_never_one_group(spark, rows):
    """No group of the blocks' plan is as long as the hot actor: the largest holds a block."""
    df = spark.createDataFrame([r for r in rows if r[0] == "hot"], SCHEMA)
    widest = sb.step_blocks(df, ["f"], 3000, 64).agg(F.max(F.size("steps")), F.count("*")).first()
    assert tuple(widest) == (64, 47)


def test_blocks_of_nothing(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert sb.step_blocks(df.limit(0), ["f"], 5).collect() == [] == sb.padded_blocks(df.limit(0), ["f"], 5).collect()
    assert sb.step_blocks(df, ["f"], 0).collect() == [] == sb.padded_blocks(df, ["f"], 0).collect()


def test_blocks_keep_their_order_in_files(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA)
    blocks = sb.step_blocks(df, ["f", "g"], 40, 16)
    io.write_json(blocks, f"{tmp_path}/json")
    back = io.read_json(spark, f"{tmp_path}/json", io.BLOCK_SCHEMA)
    key = lambda r: repr((r.actor_id, r.label, r.block))
    assert sorted(back.collect(), key=key) == sorted(blocks.collect(), key=key)


def test_flatten_block(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0]]), (2, [[5.0, 6.0]])], "id int, steps array<array<double>>")
    flat = df.select("id", "steps", sb.flatten_block().alias("v"))
    assert [r.v for r in flat.orderBy("id").collect()] == [[1.0, 2.0, 3.0, 4.0], [5.0, 6.0]]
    assert all(r.steps == r.y for r in flat.select("steps", sb.unflatten_block("v", 2).alias("y")).collect())
