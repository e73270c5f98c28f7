"""The two inputs of the pipeline, with explicit schemas at the edge.

``contracts`` (fact, one row per recurring contract line) and ``clients``
(dimension, ``client_id`` not assumed unique).  Scans project only the
columns the pipeline reads, so Catalyst prunes the rest at the Parquet reader.
A date that is stored as a timestamp is cast, and its stored form kept beside it
(``dates.stored``), for bounds that the reader can use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrition.functions.dates import stored

CONTRACTS_SCHEMA = T.StructType(
    [
        T.StructField("client_id", T.StringType()),
        T.StructField("product", T.StringType()),
        T.StructField("start_date", T.DateType()),
        T.StructField("end_date", T.DateType()),
        T.StructField("cancel_date", T.DateType()),
        T.StructField("amount", T.DecimalType(29, 9)),
    ]
)

CLIENTS_SCHEMA = T.StructType(
    [
        T.StructField("client_id", T.StringType()),
        T.StructField("client_name", T.StringType()),
        T.StructField("cancel_date", T.DateType()),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project and cast to ``schema`` (dates with a strict ``CAST AS DATE``).

    A decimal column with more places than the schema's keeps them all: no
    amount is rounded before it is summed.
    """
    return df.select(*_columns(df, schema))


def _columns(df: DataFrame, schema: T.StructType) -> list[Column]:
    return [F.col(f.name).cast(_wide(df.schema[f.name].dataType, f.dataType)).alias(f.name) for f in schema.fields]


def scanned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``conform`` with the stored form of dates that are timestamps in further columns."""
    times = [f.name for f in schema.fields if f.dataType == T.DateType() and isinstance(df.schema[f.name].dataType, (T.TimestampType, T.TimestampNTZType))]
    return df.select(*_columns(df, schema), *[F.col(name).alias(stored(name)) for name in times])


def _wide(source: T.DataType, target: T.DataType) -> T.DataType:
    both = isinstance(source, T.DecimalType) and isinstance(target, T.DecimalType)
    if both and source.scale > target.scale:
        return T.DecimalType(min(38, max(source.precision, 20 + source.scale)), source.scale)
    return target


def scan_contracts(spark: SparkSession, source: str, fmt: str = "parquet") -> DataFrame:
    """Contracts from a path (``fmt`` reader) or, with ``fmt='table'``, a catalog table."""
    df = spark.table(source) if fmt == "table" else spark.read.format(fmt).load(source)
    return scanned(df, CONTRACTS_SCHEMA)


def scan_clients(spark: SparkSession, source: str, fmt: str = "parquet") -> DataFrame:
    df = spark.table(source) if fmt == "table" else spark.read.format(fmt).load(source)
    return scanned(df, CLIENTS_SCHEMA)
