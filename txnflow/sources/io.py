"""Declared schemas, table reads, CSV / JSON / Parquet sinks, dataset naming.

Every read declares its schema (no inference pass over the data; bank and
account codes stay strings, so leading zeros survive).  Writes are
distributed -- one file per task, never a driver-side ``toPandas``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from txnflow.operators.lexicon import lexicon_words

S, L, D, I = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


JOURNEY_EVENT_SCHEMA = _schema(("actor_id", S), ("event", S), ("yyyymm", S), ("action_sponsor", S),
                               ("action_time", L), ("action_type", S), ("object_id", S), ("attrs", S))
ACCOUNT_SCHEMA = _schema(("customer_id", S), ("acct_nbr", S), ("customer_class_code", S), ("yyyymm", S),
                         ("start_ym", S), ("label", I))
JOINED_SCHEMA = _schema(("actor_id", S), ("event", S), ("behavior_yyyymm", S), ("action_sponsor", S),
                        ("action_time", L), ("action_type", S), ("object_id", S), ("twd_amt", D),
                        ("txn_currency_code", S), ("txn_type_desc", S), ("atm_location", S),
                        ("target_acct_nbr", S), ("target_bank_code", S), ("customer_id", S), ("acct_nbr", S),
                        ("customer_class_code", S), ("yyyymm", S), ("start_ym", S), ("label", I),
                        ("target_customer_id", S))
CONSUMPTION_SCHEMA = _schema(("customer_id", S), ("week", I), ("dayofweek", I), ("consumption_category_desc", S),
                             ("loc_type_town", S), ("merchant_name", S), ("merchant_flag", S), ("txn_amt", D))
ACTOR_LABEL_SCHEMA = _schema(("actor_id", S), ("label", I))
BLOCK_SCHEMA = _schema(("actor_id", S), ("label", I), ("block", L), ("first_step", L), ("steps", T.ArrayType(T.ArrayType(D))))
SEQUENCE_SCHEMA = _schema(("actor_id", S), ("label", I), ("steps", T.ArrayType(T.ArrayType(D))))


def read_table(spark: SparkSession, name_or_path: str, fmt: str | None = None,
               schema: T.StructType | None = None) -> DataFrame:
    """A catalog table by name, or files by path (parquet unless ``fmt``)."""
    if fmt is None and "/" not in name_or_path:
        return spark.table(name_or_path)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.format(fmt or "parquet").load(name_or_path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header and a declared schema."""
    return spark.read.schema(schema).option("header", True).csv(path)


def sort_for_output(df: DataFrame, keys: tuple[str, ...] = ("actor_id", "action_time"),
                    partitions: int | None = None) -> DataFrame:
    """O1: rows ordered by ``keys`` across the written files (file i < file i+1).

    Range partitioning on all the keys (bounds from a sample) splits a hot
    actor across partitions by time instead of sending it to one task; each
    partition is then sorted locally.
    """
    n = partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header, written by every task in parallel."""
    df.write.mode(mode).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per line (per block of steps for sequence tables)."""
    df.write.mode(mode).json(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a declared schema."""
    return spark.read.schema(schema).json(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """Tensors and tables as Parquet (``array<array<double>>`` for T x F)."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """S10."""
    return spark.read.parquet(path)


def read_lexicon_table(spark: SparkSession, path: str) -> DataFrame:
    """A user lexicon, one word a line, as a table (word); for ``operators.lexicon``."""
    return lexicon_words(spark.read.text(path))


def read_lexicon(spark: SparkSession, path: str, most: int = 10_000) -> list[str]:
    """A short lexicon as a list, for the rule-table domain, which makes one pattern of it.

    More than ``most`` words are an error: those belong in :func:`read_lexicon_table`.
    """
    words = sorted(r[0] for r in read_lexicon_table(spark, path).limit(most + 1).collect())
    if len(words) > most:
        raise ValueError(f"{path} has more than {most} words")
    return words


def dataset_name(kind: str, observ: str, label: str, try_date: str | None = None,
                 version: str | None = None, desc: str | None = None) -> str:
    """Versioned dataset name from observation range, label range, run date, version, description."""
    parts = [kind, f"observ_{observ}", f"labeled_{label}"]
    parts += [p for p in (try_date, version, desc) if p]
    return "__".join(parts[:1] + ["_".join(parts[1:])]) if len(parts) > 1 else kind
