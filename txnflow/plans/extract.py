"""Entry 1 queries: journey extraction and the account joins."""

from __future__ import annotations

from txnflow.operators.journey import extract_journey, join_accounts
from txnflow.plans.registry import register
from txnflow.plans.sql import BASE, with_ctes
from txnflow.sources import testdata as td


def journey(spark, sf_dir):
    return extract_journey(td.journey_event(spark, sf_dir, td.OBSERVATION_PERIOD), td.OBSERVATION_PERIOD, td.JOURNEY_EVENTS)


def joined(spark, sf_dir):
    return join_accounts(journey(spark, sf_dir), td.accounts(spark, sf_dir), td.LABEL_PERIOD)


register("journey_extract", sql=with_ctes(BASE[:2], "SELECT * FROM journey"), bench=True)(journey)
register("journey_join", sql=with_ctes(BASE, "SELECT * FROM joined"), bench=True)(joined)
