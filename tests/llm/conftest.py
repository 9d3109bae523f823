import random

import pytest
from edge import EXTRA, text_of


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text): nulls, blanks, a long text, copies, near copies, repeated rows and repeated ids."""
    rng = random.Random(7)
    base = [text_of(rng, n) for n in (3, 8, 30, 60, 200)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (None, base[2]), (None, None), (4, base[3]), (5, base[3]), (5, base[3]),
            (6, base[3] + " tail one"), (7, base[4]), (8, base[4].replace("the", "thy", 2)), (9, base[0]), (10, base[0]),
            (11, "one"), (12, "ONE"), (13, base[1] + base[2] + base[1]), (14, base[4] + base[3]), (15, "word " * 400),
            (16, text_of(rng, 30_000)), (17, "x" * 5000), (18, "x" * 5000), (-3, base[2]), (19, "..., !!! 12"), (20, "\x00\x1c\x85 \x0b")]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The edge rows with further columns whose names operators use themselves."""
    data = [(i, t, "w", "s", None, 1, n) for n, (i, t) in enumerate(edge_rows)]
    return spark.createDataFrame(data, EXTRA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EXTRA)
