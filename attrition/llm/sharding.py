"""Sharding in the order of a Hilbert curve.

Metadata columns are quantised to ``2 ** bits`` steps each, at their own
quantiles over all rows: numbers by Spark's quantile sketch, other values in the
order of their text by exact counts of the rows before each.  A cell of that
grid has a place on a Hilbert curve, which visits neighbouring cells one after another.
Rows in curve order are cut into runs, one a shard, so a shard (and each file
of it) covers a small range of every dimension and the minima and maxima in its
footers prune reads on any of them.

The row numbers come from a range partitioned sort of small rows (place, digest,
id, size) and the number of rows of each partition; no task holds more than its
range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrition.llm.common import plus, staged

SHARDS, BITS = 16, 5
#: Rows whose order is decided within one task at most (partitions are cut for that).
RANGE_ROWS = 250_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (rows x dimensions, values below ``2 ** bits``).

    Skilling's transform, on all rows at once.
    """
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    top = 1 << (bits - 1)
    bit = top
    while bit > 1:
        low = bit - 1
        for i in range(dims):
            on = (x[:, i] & bit) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(on, low, swap)
            x[:, i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    bit = top
    while bit > 1:
        turn ^= np.where(x[:, -1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= turn[:, None]
    out = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[:, i] >> b & 1)
    return out


def text_cuts(df: DataFrame, column: str, steps: int) -> list[str]:
    """The texts of ``column`` that begin a step, ascending: ``steps`` at most, with about as many rows from one to the next.

    Rows are counted by value first; the values are sorted in ranges, and each
    finds the rows before it from its own range and the ranges' totals.  A value
    with many rows is one step, and the next value begins another.
    """
    counts = df.select(F.col(f"`{column}`").cast("string").alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    spread = staged(counts, "values").repartitionByRange("value").sortWithinPartitions("value")

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = 0
        for batch in batches:
            ends = at + batch["n"].cumsum()
            yield batch.assign(at=ends - batch["n"])
            at = int(ends.iloc[-1]) if len(ends) else at

    schema = plus(counts.schema, range="int", at="long")
    spread = staged(spread.withColumn("range", F.spark_partition_id()).mapInPandas(summed, schema), "values")
    totals = sorted((r["range"], r["rows"]) for r in spread.groupBy("range").agg(F.sum("n").alias("rows")).collect())
    starts, total = [], 0
    for part, n in totals:
        starts.append((part, total))
        total += n
    start = df.sparkSession.createDataFrame(starts, "range int, start long")
    placed = spread.join(F.broadcast(start), "range")  # a row for each range
    step = F.expr(f"(start + at) * {steps} DIV {max(1, total)}")
    begins = placed.groupBy(step.alias("step")).agg(F.min("value").alias("value")).collect()  # a row for each step
    return [r["value"] for r in sorted(begins, key=lambda r: r["step"])]


def _steps(df: DataFrame, dims: Sequence[str], bits: int) -> list[Column]:
    """The grid step of each dimension; a null is on step 0."""
    kinds = {c: isinstance(df.schema[c].dataType, T.NumericType) for c in dims}
    numbers = [c for c in dims if kinds[c]]
    shares = [i / 2**bits for i in range(1, 2**bits)]
    found = df.approxQuantile(numbers, shares, 0.002) if numbers else []
    cuts = dict(zip(numbers, found, strict=True))
    out = []
    for c in dims:
        if not kinds[c]:
            at = F.array(*[F.lit(x) for x in text_cuts(df, c, 2**bits)]).cast("array<string>")
            step = F.greatest(F.size(F.filter(at, _up_to(c))) - 1, F.lit(0))
        elif cuts[c]:
            at = F.array(*[F.lit(float(x)) for x in sorted(set(cuts[c]))])
            step = F.size(F.filter(at, _below(c)))
        else:
            step = F.lit(0)
        out.append(F.when(F.col(c).isNull(), 0).otherwise(step).cast("int"))
    return out


def _below(c: str):
    return lambda x: x < F.col(c)


def _up_to(c: str):
    return lambda x: x <= F.col(c).cast("string")


def curve_order(df: DataFrame, dims: Sequence[str], bits: int = BITS, name: str = "_place") -> DataFrame:
    """``df`` with its place on the curve over the columns ``dims``."""

    @F.pandas_udf("long")
    def place(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in parts:
            yield pd.Series(hilbert_index(np.stack([c.to_numpy() for c in columns], axis=1), bits))

    return df.withColumn(name, place(*_steps(df, dims, bits)))


def row_numbers(df: DataFrame, order: Sequence[str], name: str = "_row") -> DataFrame:
    """``df`` with gapless row numbers from 0 in the order of ``order``, without a single-task sort."""
    rows = df.count()
    parts = max(1, -(-rows // RANGE_ROWS))
    wide = df.sparkSession.sparkContext.defaultParallelism
    parts = max(parts, min(wide, -(-rows // 1000)))
    # A random last key lets many equal rows lie in several ranges; it is
    # written, so a second reading meets the same order.
    salted = staged(df.withColumn("_salt", F.rand(11)), "salted")
    spread = salted.repartitionByRange(max(1, parts), *order, "_salt").sortWithinPartitions(*order, "_salt")

    def numbered(batches):
        at = 0
        for batch in batches:
            batch["_at"] = np.arange(at, at + len(batch), dtype=np.int64)
            at += len(batch)
            yield batch

    schema = plus(salted.schema, _range="int", _at="long")
    spread = staged(spread.withColumn("_range", F.spark_partition_id()).mapInPandas(numbered, schema), "ranges")
    counts = sorted((r["_range"], r["n"]) for r in spread.groupBy("_range").agg(F.count("*").alias("n")).collect())
    before, starts = 0, []
    for part, n in counts:
        starts.append((part, before))
        before += n
    start = df.sparkSession.createDataFrame(starts, "_range int, _start long")
    joined = spread.join(F.broadcast(start), "_range")  # a row for each range
    return joined.withColumn(name, F.col("_start") + F.col("_at")).drop("_range", "_at", "_start", "_salt")


def hilbert_shards(df: DataFrame, dims: Sequence[str], ties: Sequence[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in the shard).

    Rows go by their place on the curve over ``dims``, then by ``ties``; the
    shards' row counts differ by one at most.  Nulls are allowed everywhere.
    An empty table gives an empty result.
    """
    rows = row_numbers(curve_order(df, dims, bits), ["_place", *ties])
    total = max(1, rows.count())
    shard = F.expr(f"CAST(_row * {shards} DIV {total} AS INT)")
    first = F.expr(f"(shard * CAST({total} AS LONG) + {shards - 1}) DIV {shards}")
    return rows.withColumn("shard", shard).withColumn("slot", F.col("_row") - first).drop("_place", "_row")


def document_shards(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard and slot of every row of ``docs(doc_id, text, lang, source, ...)``.

    Dimensions: size, source and lang.  ``size`` is the text's UTF-8 bytes
    (null: none) plus 1; ``text_crc32`` its CRC-32 (null: of no bytes).
    """
    text = F.coalesce("text", F.lit(""))
    meta = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        "source",
        "lang",
    )
    meta = staged(meta, "meta")
    return hilbert_shards(meta, ["size", "source", "lang"], ["size", "text_crc32", "doc_id"], shards)


def write_shards(docs: DataFrame, path: str, dims: Sequence[str], shards: int = SHARDS, bits: int = BITS) -> None:
    """Writes ``docs`` to ``path``, a folder for each shard, in curve order."""
    placed = hilbert_shards(docs, dims, [c for c in dims], shards, bits)
    placed.repartitionByRange(shards * 4, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy(
        "shard"
    ).parquet(path)
