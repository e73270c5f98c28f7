"""Helpers the operators share: staged tables, word hashes, shingle sets."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, BinaryType, ByteType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from attrition.session import work_dir

#: Bytes of a text that are hashed at once.
BLOCK = 1 << 19

_RANDOM = np.random.default_rng(20_240_101)
_MULTIPLIERS = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[int, np.ndarray] = {}
_TYPES = {"int": IntegerType(), "long": LongType(), "double": DoubleType(), "string": StringType(), "binary": BinaryType(), "array<tinyint>": ArrayType(ByteType())}


#: Paths staged inside each open ``scratch``, the innermost last.
_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end: what is used later is staged outside, or written by then."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside delete their shuffle files when they end."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def staged(df: DataFrame, label: str, stays: bool = False) -> DataFrame:
    """``df`` written once to the shared work folder and read from there.

    Cuts the lineage: a lost executor costs a file read, not a recomputation.
    The shuffle files it took go as soon as it is written, not when the driver
    next collects garbage.
    One that ``stays`` outlives the ``scratch`` it is staged in, and belongs to
    the one around that, if any.
    """
    path = f"{work_dir(df.sparkSession)}/llm/{label}-{uuid.uuid4().hex}"
    owners = _open[:-1] if stays else _open
    if owners:
        owners[-1].append(path)
    with _shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space, A-Z lower-cased; a null text has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` for i below ``n``, modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        held = np.full(max(n, BLOCK + 1), base, np.uint64)
        held[0] = 1
        _POWERS[base] = np.multiply.accumulate(held)
    return _POWERS[base][:n]


def _block_hashes(b: np.ndarray) -> np.ndarray:
    blank = np.ones(len(b) + 2, bool)
    blank[1:-1] = _SPACE[b]
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTES[b] * _powers(_BASE, len(b)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(b) + 1)[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of each of ``words(text)``, in order.

    The hash of a word is a polynomial of its bytes, so all words of a block
    come from one running sum; blocks end at white space, so memory is
    bounded unless one word is longer than a block.
    """
    if not text:
        return np.empty(0, np.uint64)
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    out, at = [], 0
    while at < len(b):
        end = at + BLOCK
        if end < len(b):
            cut = np.flatnonzero(_SPACE[b[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:
                cut = np.flatnonzero(_SPACE[b[end:]])
                end = end + int(cut[0]) + 1 if len(cut) else len(b)
        out.append(_block_hashes(b[at:end]))
        at = end
    return out[0] if len(out) == 1 else np.concatenate(out)


def shingle_hashes(hashes: np.ndarray, k: int, short: bool = True) -> np.ndarray:
    """Hash of each run of ``k`` words, in order.

    With fewer words than ``k`` the whole sequence counts as one shingle
    (``short``), or there is none.
    """
    n = len(hashes)
    if n < k:
        if not (short and n):
            return np.empty(0, np.uint64)
        return mix(np.array([np.sum(hashes * _MULTIPLIERS[:n]) + np.uint64(n)], np.uint64))
    total = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        total += hashes[i : n - k + 1 + i] * _MULTIPLIERS[i]
    return mix(total)


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's signed long."""
    return x.view(np.int64)


def plus(schema: StructType, **kinds: str) -> StructType:
    """``schema`` with further columns of the given types."""
    return StructType([*schema.fields, *(StructField(n, _TYPES[k]) for n, k in kinds.items())])
