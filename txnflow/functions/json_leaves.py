"""JSON leaf extraction from the ``attrs`` column.

One ``from_json`` with a declared nested schema parses each row once (nine
``json_tuple`` lateral views would parse it nine times).  The parsed struct is a
column of its own, ``with_parsed``; taking leaves straight from ``from_json``
would let the optimiser split it into one pruned parse per object.  Leaves are declared
as strings, as ``json_tuple`` returns them; numeric leaves are cast afterwards
with ``try_cast`` so a malformed amount becomes null instead of failing.
Invalid JSON, a missing object or a missing leaf all give null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# (object, leaf) pairs carried by the journey-event ``attrs`` column.
JOURNEY_LEAVES = (
    ("action", "twd_amt"),
    ("action", "txn_currency_code"),
    ("action", "txn_type_desc"),
    ("channel", "atm_location"),
    ("object", "target_acct_nbr"),
    ("object", "target_bank_code"),
)
NUMERIC_LEAVES = {"twd_amt": "double"}


def leaves_schema(leaves=JOURNEY_LEAVES) -> T.StructType:
    objects: dict[str, list[str]] = {}
    for obj, leaf in leaves:
        objects.setdefault(obj, []).append(leaf)
    return T.StructType([
        T.StructField(obj, T.StructType([T.StructField(leaf, T.StringType()) for leaf in names]))
        for obj, names in objects.items()
    ])


PARSED = "_parsed"


def with_parsed(df: DataFrame, column: str = "attrs", leaves=JOURNEY_LEAVES) -> DataFrame:
    """``df`` with the parsed JSON column that ``json_leaves`` reads."""
    return df.withColumn(PARSED, F.from_json(F.col(column), leaves_schema(leaves)))


def json_leaves(leaves=JOURNEY_LEAVES, numeric: dict[str, str] | None = None) -> list[Column]:
    """Columns for every leaf of ``with_parsed``, named by the leaf."""
    numeric = NUMERIC_LEAVES if numeric is None else numeric
    parsed = F.col(PARSED)
    out = []
    for obj, leaf in leaves:
        value = parsed.getField(obj).getField(leaf)
        if leaf in numeric:
            value = value.try_cast(numeric[leaf])
        out.append(value.alias(leaf))
    return out
