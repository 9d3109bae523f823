"""Ordered first-match rule tables compiled to one ``CASE WHEN``.

The whole table becomes a single codegen'd expression: no UDF, no join, one
pass over the rows.  Regexes use ``rlike`` (find semantics, as a
``contains`` test with a pattern).
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnflow.domain import Clause, Rule


def _clause(text: Column, amount: Column | None, clause: Clause) -> Column:
    cond = F.lit(True)
    for pattern in clause.contains:
        cond = cond & text.rlike(pattern)
    for pattern in clause.not_contains:
        cond = cond & ~text.rlike(pattern)
    if clause.equals is not None:
        cond = cond & (text == clause.equals)
    if clause.amount == ">0":
        cond = cond & (amount > 0)
    elif clause.amount == "=0":
        cond = cond & (amount == 0)
    elif clause.amount is not None:
        raise ValueError(f"unsupported amount test {clause.amount!r}")
    return F.coalesce(cond, F.lit(False))


def classify(text: Column, rules: Iterable[Rule], default: str, amount: Column | None = None) -> Column:
    """First matching rule's label, else ``default`` (``np.select`` semantics)."""
    expr = None
    for r in rules:
        cond = None
        for clause in r.clauses:
            c = _clause(text, amount, clause)
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, r.label) if expr is None else expr.when(cond, r.label)
    return F.lit(default) if expr is None else expr.otherwise(default)
