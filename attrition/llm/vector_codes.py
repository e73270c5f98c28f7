"""Vector codes: one small codebook for each part of a vector, entries found by Orchard's search.

A vector's components become integers, ``floor(SCALE * x)``, and the vector is
cut into ``parts`` equal consecutive parts.  The codebook of a part position
starts as that part of the vectors with the smallest ids; each round assigns
every part to its nearest entry and moves an entry to the floored mean of its
parts.  A vector's code is the index of the nearest entry of each part.

Nearest entries are found by Orchard's search: each entry keeps the others
sorted by their distance from it.  A query at entry c, with distance d, walks
c's list; an entry that is nearer becomes the new c, and its list is walked from
the front; entries seen before are marked and skipped; and the walk is over when
an entry lies more than 2 d from c, since by the triangle inequality nothing
beyond can be as near as c.  Of equally near entries the one with the lowest
index wins.  All queries of a batch walk side by side.

Spark deals out the vectors; a round sends ``parts x entries`` sums and counts a
task, and the codebooks, ``entries`` vectors in all, are what the driver holds
and the tasks are sent.

A vector that is null, or holds a null or non-finite component, is dropped.  A
vector shorter than the longest, or than a whole number of parts, counts as
having zeros behind.  Scaled components stay within bounds that keep squared
distances exact in 64 bits (2**20 before scaling, divided by the root of a part's
components).  Of rows
with one id, the smaller vector comes first; null ids come last.  With fewer
vectors than entries the codebooks are as short as that; an empty table gives an
empty result.  Further columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import plus

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors whose parts walk side by side.
BATCH = 4_096


class Codebook:
    """The entries of one part position, with each entry's neighbours by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries  # entries x width
        n = len(entries)
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        apart[np.arange(n), np.arange(n)] = -1  # an entry comes first in its own list
        self.lists = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        self.apart = np.take_along_axis(apart, self.lists, 1)
        self.sums = entries.sum(1)
        self.by_sum = np.argsort(self.sums, kind="stable")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row of ``x``."""
        n, k = len(x), len(self.entries)
        # Any start is right; an entry with about the same sum is often near.
        guess = np.searchsorted(self.sums[self.by_sum], x.sum(1)).clip(0, k - 1)
        at = self.by_sum[guess]
        best = ((x - self.entries[at]) ** 2).sum(1)
        seen = np.zeros((n, k), bool)
        seen[np.arange(n), at] = True
        step = np.zeros(n, np.int64)
        walking = np.arange(n) if k > 1 else np.empty(0, np.int64)
        while len(walking):
            here, place = at[walking], step[walking]
            # Distances are squared: beyond 2 d means more than 4 d².
            inside = self.apart[here, place] <= 4 * best[walking]
            walking, here, place = walking[inside], here[inside], place[inside]
            other = self.lists[here, place]
            step[walking] = place + 1
            fresh = ~seen[walking, other]
            rows, other = walking[fresh], other[fresh]
            seen[rows, other] = True
            far = ((x[rows] - self.entries[other]) ** 2).sum(1)
            better = (far < best[rows]) | ((far == best[rows]) & (other < at[rows]))
            rows = rows[better]
            at[rows], best[rows], step[rows] = other[better], far[better], 0
            walking = walking[step[walking] < k - 1]
        return at, best


@dataclass(frozen=True)
class Codebooks:
    """The entries of all part positions: ``parts x entries x width`` integers."""

    entries: np.ndarray

    @property
    def width(self) -> int:
        return self.entries.shape[2]

    def digest(self) -> str:
        """SHA-256 of all components in decimal by part, entry and place, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (vectors x parts) and summed squared distances of integer vectors."""
        parts = self.entries.shape[0]
        books = [Codebook(e) for e in self.entries]
        codes = np.zeros((len(x), parts), np.int64)
        errors = np.zeros(len(x), np.int64)
        for low in range(0, len(x), BATCH):
            rows = slice(low, low + BATCH)
            cut = x[rows].reshape(-1, parts, self.width)
            for p, book in enumerate(books):
                codes[rows, p], far = book.nearest(cut[:, p])
                errors[rows] += far
        return codes, errors

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The integer vectors that codes stand for."""
        parts = np.arange(self.entries.shape[0])
        return self.entries[parts[None, :], codes].reshape(len(codes), -1)


def _bound(width: int) -> int:
    """Components within it leave sixteen times a squared distance below 2**63."""
    return int(2**28 / max(1, width) ** 0.5)


def _rows(column: pa.Array, width: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a vector, and these as integers, ``parts * width`` to a row."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
    ends = np.cumsum(lengths)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = (bad[ends] == bad[ends - lengths]) & column.is_valid().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), parts * width), np.int64)
    place = np.arange(len(flat)) - np.repeat(ends - lengths, lengths)
    most = float(_bound(width))
    with np.errstate(invalid="ignore", over="ignore"):
        out[np.repeat(np.arange(len(lengths)), lengths), place] = np.nan_to_num(np.floor(flat * SCALE)).clip(-most, most)
    return good, out[good]


def _whole(column: str):
    """Whether a vector counts."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.col(column).isNotNull() & ~F.exists(column, bad)


def train(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks after ``rounds`` passes over all vectors; none without vectors."""
    vectors = vectors.select(F.col(id_column).alias("id"), F.col(column).alias("vector"))
    kept = vectors.filter(_whole("vector"))
    longest = kept.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return None
    width = max(1, -(-longest // parts))
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    _, start = _rows(pa.array([r.vector for r in first], pa.list_(pa.float64())), width, parts)
    books = Codebooks(start.reshape(len(start), parts, width).transpose(1, 0, 2).copy())
    for _ in range(rounds):
        books = _moved(kept.select("vector"), books)
    return books


def _moved(vectors: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry at the floored mean of the parts assigned to it; unused ones stay."""
    parts, n, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, n, width), np.int64), np.zeros((parts, n), np.int64)
        for batch in batches:
            _, x = _rows(batch.column("vector"), width, parts)
            codes, _ = books.encode(x)
            cut = x.reshape(-1, parts, width)
            for p in range(parts):
                np.add.at(sums[p], codes[:, p], cut[:, p])
                counts[p] += np.bincount(codes[:, p], minlength=n)
        part, entry = np.nonzero(counts)
        total = pa.ListArray.from_arrays(np.arange(len(part) + 1, dtype=np.int32) * width, pa.array(sums[part, entry].ravel()))
        columns = [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(counts[part, entry]), total]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "total"])

    sent = vectors.mapInArrow(run, "part int, entry int, n long, total array<long>")
    places = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(width)]
    moved = books.entries.copy()
    # At most parts x entries rows, whatever the number of vectors.
    for row in sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), *places).collect():
        moved[row.part, row.entry] = [int(row[f"t{i}"]) // row.n for i in range(width)]
    return Codebooks(moved)


def encode(vectors: DataFrame, books: Codebooks | None, column: str = "embedding") -> DataFrame:
    """The rows whose vector counts, with ``code`` (a byte for each part, in hex) and ``error`` (long) added.

    Columns of those names are replaced.
    """
    others = [c for c in vectors.columns if c not in ("code", "error")]
    vectors = vectors.select(*others).filter(_whole(column))
    schema = plus(vectors.schema, code="string", error="long")
    if books is None:
        return vectors.sparkSession.createDataFrame([], schema)
    parts, n, width = books.entries.shape
    if n > 256:
        raise ValueError("a code has a byte for each part: 256 entries at most")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = _rows(batch.column(column), width, parts)
            codes, errors = books.encode(x)
            text = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(text, pa.string()), pa.array(errors)], names=schema.names)

    return vectors.mapInArrow(run, schema)
