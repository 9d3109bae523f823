"""Import every plan module so all queries are registered."""

from txnflow.plans import (evaluation, extract, features, model, preference, profile, roundtrip,  # noqa: F401
                           sampling, sequences, text)
from txnflow.plans.registry import QUERIES  # noqa: F401
