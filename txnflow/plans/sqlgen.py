"""SQL text for domain-driven expressions (rule tables, token documents).

Generated from the same :class:`~txnflow.domain.Domain` the Spark operators
use, so both engines apply one rule table.
"""

from __future__ import annotations

from txnflow.domain import Domain
from txnflow.functions.text import segment_pattern


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def classify(text: str, rules, default: str, amount: str | None = None) -> str:
    whens = []
    for r in rules:
        ors = []
        for c in r.clauses:
            parts = [f"regexp_matches({text}, {lit(p)})" for p in c.contains]
            parts += [f"NOT regexp_matches({text}, {lit(p)})" for p in c.not_contains]
            if c.equals is not None:
                parts.append(f"{text} = {lit(c.equals)}")
            if c.amount == ">0":
                parts.append(f"{amount} > 0")
            elif c.amount == "=0":
                parts.append(f"{amount} = 0")
            ors.append("coalesce(" + " AND ".join(parts or ["TRUE"]) + ", FALSE)")
        whens.append(f"WHEN {' OR '.join(ors)} THEN {lit(r.label)}")
    return "CASE " + " ".join(whens) + f" ELSE {lit(default)} END"


def location_document(col: str, d: Domain) -> str:
    stop = "[" + ", ".join(lit(w) for w in d.stop_words) + "]"
    tokens = f"regexp_extract_all(replace({col}, {lit(d.location_dash)}, ' '), {lit(segment_pattern(d.lexicon))}, 1)"
    kept = f"list_filter({tokens}, lambda x: NOT list_contains({stop}, x))"
    stripped = f"list_transform({kept}, lambda x: replace(x, {lit(d.token_strip)}, ''))"
    return f"array_to_string({stripped}, ' ')"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in values) + ")"
