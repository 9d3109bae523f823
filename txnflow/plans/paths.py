"""New folders for what queries write and read again."""

from __future__ import annotations

import uuid

from txnflow.session import ensure_checkpoint_dir
from txnflow.sources import io

OBSERVED, LABELLED = "202402-202404", "202402"


def new_path(spark, kind: str) -> str:
    """A new folder in the shared checkpoint folder, named as the job names its datasets."""
    name = io.dataset_name(kind, OBSERVED, LABELLED, desc=uuid.uuid4().hex)
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/txnflow-{name}"
