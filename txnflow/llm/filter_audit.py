"""How a set of filters interacts: what each removes in every order of application.

A document fails a subset of the k filters, its mask.  In an order of the filters it is removed at the first step whose
filter is in the mask.  Orders are numbered by Lehmer rank, that is lexicographically, so all orders that begin with
the same s filters are one interval of ranks, (k - s)! long.  A mask is removed at step s by the orders whose first s - 1
filters are outside the mask and whose s-th is inside: a few intervals, whatever the number of documents.  Each
mask's count is added where an interval begins and subtracted where it ends; prefix sums over the k! ranks
give the removals of every order and step.

Documents are only counted, by part and mask.  What follows has k * k! rows a part.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import factorial
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnflow.llm.tables import written

MEASURES = ("n", "good", "toxic")
MOST_FILTERS = 6                 # 720 orders


def removal_intervals(k: int) -> list[tuple[int, int, int, int]]:
    """Rows (mask, step, lo, hi): orders of Lehmer rank lo..hi-1 remove a document of this mask at this step."""
    rows = []

    def extend(rank: int, step: int, left: list[int]) -> None:
        length = factorial(k - step)
        for digit, letter in enumerate(left):
            lo, others = rank + digit * length, left[:digit] + left[digit + 1:]
            for size in range(len(others) + 1):
                for more in combinations(others, size):
                    rows.append((sum(1 << x for x in (letter, *more)), step, lo, lo + length))
            if others:
                extend(lo, step + 1, others)

    extend(0, 1, list(range(k)))
    return rows


def order_of(rank: int, letters: str) -> str:
    """The order with this Lehmer rank."""
    left, out = list(letters), []
    for n in range(len(left) - 1, -1, -1):
        digit, rank = divmod(rank, factorial(n))
        out.append(left.pop(digit))
    return "".join(out)


def audit_masks(masks: DataFrame, letters: str) -> DataFrame:
    """``masks``: (part string, mask int, n, good, toxic), rows of a part and mask are added up.  Bit i is letter i.

    Returns for each part, filter_order and step (from 1): kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley, all long: documents left after the step, removed at it, failing its filter but removed
    earlier, failing its filter alone, good and toxic ones among the removed, and what its filter removes over all
    orders.  Parts whose counts cancel to none still appear.  No rows give no rows.
    """
    k = len(letters)
    if not 0 < k <= MOST_FILTERS or len(set(letters)) != k:
        raise ValueError(f"1 to {MOST_FILTERS} different letters are needed, not {letters!r}")
    spark, orders = masks.sparkSession, factorial(k)
    # Two constant tables of at most 3,000 rows.
    spans = spark.createDataFrame(removal_intervals(k), "mask int, step int, lo int, hi int")
    named = spark.createDataFrame([(r, order_of(r, letters)) for r in range(orders)], "rank int, filter_order string")

    masks = masks.groupBy("part", "mask").agg(*[F.sum(m).alias(m) for m in MEASURES])
    failing = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(0)) for i in range(k)]
    alone = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(0)) for i in range(k)]
    parts = masks.groupBy("part").agg(F.sum("n").alias("total"), F.array(*failing).alias("failing"), F.array(*alone).alias("alone"))

    changes = masks.join(F.broadcast(spans), "mask").select(
        "part", "step", F.explode(F.array(F.struct(F.col("lo").alias("rank"), *MEASURES),
                                          F.struct(F.col("hi").alias("rank"), *[(-F.col(m)).alias(m) for m in MEASURES]))).alias("at")) \
        .select("part", "step", "at.*").where(F.col("rank") < orders)
    grid = parts.select("part", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"), *[F.lit(0).cast("long").alias(m) for m in MEASURES]) \
        .select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(orders - 1))).alias("rank"), *MEASURES)
    ranks = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    removed = changes.union(grid).groupBy("part", "step", "rank").agg(*[F.sum(m).alias(m) for m in MEASURES]) \
        .select("part", "step", "rank", *[F.sum(m).over(ranks).alias(m) for m in MEASURES])

    steps = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    place = F.instr(F.lit(letters), F.col("letter"))
    return (removed.join(F.broadcast(named), "rank").join(parts, "part").withColumn("letter", letter)
            .withColumn("gone", F.sum("n").over(steps))
            .withColumn("shapley", F.sum("n").over(Window.partitionBy("part", "letter")))
            .select("part", "filter_order", "step", (F.col("total") - F.col("gone")).alias("kept"), F.col("n").alias("removed"),
                    (F.element_at("failing", place) - F.col("n")).alias("redundant"), F.element_at("alone", place).alias("unique_fails"),
                    F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley"))


def _spread(table: DataFrame, id_col: str, by: Column) -> DataFrame:
    """A second join key, so that rows without an id, which match nothing, don't meet in one task."""
    return table.withColumn("__spread", F.when(F.col(id_col).isNull(), by).otherwise(0))


def count_masks(docs: DataFrame, labels: DataFrame, failing: list[Column], id_col: str = "doc_id", text_col: str = "text",
                part_col: str = "source") -> DataFrame:
    """``docs`` counted by part and mask: (part, mask, n, good, toxic).

    ``failing``: a condition on the column ``text`` (null: empty) for each filter; a null condition does not fail.  One filter
    more follows: the text equals that of a smaller id, whichever filters that one fails.  A null id comes after all
    others; rows that share the smallest id of a text all count as its first.  A null part is the empty string.
    A document is good (toxic) if any row of ``labels`` with its id has quality (toxic) 1; a null id has no labels.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    mask = reduce(add, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failing)])
    copy = 1 << len(failing)
    flags = labels.groupBy(F.col(id_col).alias("oid")).agg(*[
        F.max(F.when(F.col(c) == 1, 1).otherwise(0)).cast("long").alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    rows = docs.select(F.col(id_col).alias("oid"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("text")) \
        .select("oid", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask.cast("int").alias("mask"))
    rows = _spread(rows, "oid", 1 + F.pmod(F.hash("digest", "part"), 1 << 16)) \
        .join(_spread(flags.where("oid IS NOT NULL"), "oid", F.lit(0)), ["oid", "__spread"], "left")
    # Rows of a text and id are few; a text, however often it is copied, is never gathered.
    rows = written(rows.groupBy("digest", "oid", "part", "mask").agg(
        F.count("*").alias("n"), *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in ("good", "toxic")]), "masks")
    least = rows.groupBy("digest").agg(F.min("oid").alias("least"))
    first = rows.alias("r").join(least.alias("l"), (F.col("r.digest") == F.col("l.digest")) & F.col("r.oid").eqNullSafe(F.col("l.least"))) \
        .groupBy("part", "mask").agg(*[F.sum(m).alias(m) for m in MEASURES])
    first = written(first, "firsts")
    copies = rows.select("part", (F.col("mask") + copy).alias("mask"), *MEASURES) \
        .union(first.select("part", (F.col("mask") + copy).alias("mask"), *[(-F.col(m)).alias(m) for m in MEASURES]))
    return copies.union(first.select("part", "mask", *MEASURES)).groupBy("part", "mask").agg(*[F.sum(m).alias(m) for m in MEASURES])
