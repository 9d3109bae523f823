"""Per-transaction flags and one-hot levels.

Comparisons follow pandas' null semantics where the original job relied on
them: ``a != b`` is true when either side is missing, ``a == b`` is false.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnflow.domain import Domain


def _ne(a: Column, b: Column) -> Column:
    return F.coalesce(a != b, F.lit(True))


def _eq(a: Column, b: Column) -> Column:
    return F.coalesce(a == b, F.lit(False))


def is_cross_bank(bank_code: Column, home_code: str) -> Column:
    """1 when the counterparty bank differs from the home bank."""
    return F.when(_ne(bank_code, F.lit(home_code)), 1).otherwise(0)


def is_self_transfer(actor: Column, target_customer: Column, acct: Column, target_acct: Column) -> Column:
    """1 when the counterparty is the same customer on another account."""
    return F.when(_eq(actor, target_customer) & _ne(acct, target_acct), 1).otherwise(0)


def is_exchange_deal(currency: Column, home_currencies: Iterable[str]) -> Column:
    """1 unless the currency is a home currency (or the unknown marker)."""
    return F.when(F.coalesce(currency.isin(*home_currencies), F.lit(False)), 0).otherwise(1)


def cash_flow(sponsor: Column, amount: Column, action_text: Column, category: Column,
              domain: Domain) -> Column:
    """-1 outflow, 1 inflow, 0 enquiry (zero-amount enquiry rule wins)."""
    self_initiated = _eq(sponsor, F.lit("self"))
    outflow = (self_initiated & F.coalesce(amount > 0, F.lit(False))
               & F.coalesce(action_text.rlike(domain.cash_out_pattern), F.lit(False))
               & ~F.coalesce(action_text.rlike(domain.cash_out_exclude), F.lit(False)))
    enquiry = (self_initiated & F.coalesce(amount == 0, F.lit(False))
               & F.coalesce(category.rlike(domain.enquiry_category_pattern), F.lit(False)))
    return F.when(enquiry, 0).when(outflow, -1).otherwise(1)


def signed_amount(flow: Column, amount: Column) -> Column:
    """Outflows negative."""
    return F.when(flow == -1, -amount).otherwise(amount)


def non_round_amount(amount: Column, unit: int = 1000) -> Column:
    """1 when the amount is not a multiple of ``unit``."""
    return F.when(_ne(amount % unit, F.lit(0)), 1).otherwise(0)


def small_amount(amount: Column, limit: float = 1000) -> Column:
    """1 when the amount is below ``limit``."""
    return F.when(amount < limit, 1).otherwise(0)


def one_hot(column: Column, levels: Iterable, prefix: str) -> list[Column]:
    """One 0/1 column per declared level (declared, not data-driven)."""
    return [F.when(_eq(column, F.lit(level)), 1).otherwise(0).alias(f"{prefix}_{level}") for level in levels]
