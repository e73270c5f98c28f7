"""Periodic runs of words, found in tiles scaled to the period.

A run of period q is a stretch of consecutive words in which words q apart are
equal, q is the smallest such number, and no neighbouring word extends it.

Periods come in octaves, ``2**k`` to ``2**(k+1) - 1``.  A document is exploded
into tiles, eight times ``2**k`` words for octave k (``TILE`` at least, so small
octaves share tiles, and a document that one tile holds is one row), which
overlap by twice the octave's longest period or more.  Every window of two
periods therefore lies whole in some tile, so a tile is solved by itself.

In a tile the boundaries are the multiples of ``2**k``.  For boundary b and
period q the two boundary Z values, the longest common prefix of the words from
b and from b + q and the longest common suffix of those before, give the longest
stretch of period q around ``[b, b + q)``; a run of two periods holds such a
boundary.  All pairs of a tile (one for each of its words and octave) are
looked at together: equal fingerprints of short blocks sift them, and the rest
get their Z values by bisection over prefix fingerprints.  Stretches that have
a shorter period go, and what stays is compared word by word.

Fragments are then shuffled by document and period, and those that overlap by
a period or more are the same run: two different runs of one period share
fewer words than that.  Spark does the tiling, the shuffles and the stitching;
tiles of documents longer than ``TILE`` are dealt out over the tasks, so one
long document is solved by many.

Null and blank texts have no words and no runs.  Rows of ``docs`` that repeat
give a row each.  Null ids are ordinary ids here.  Further columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attrition.llm.common import plus

#: Shortest length of a run, in words; a run also has two periods at least.
SHORTEST = 12
#: Words of a tile, at least (a power of two).
TILE = 1 << 13

_KEY = ["doc_id", "text_hash"]
_PRIMES = (2_147_483_629, 2_147_483_587)
_BASES = (1_234_567_891, 987_654_323)
_SIFT = 0x9E3779B97F4A7C15
_SIFT_INVERSE = pow(_SIFT, -1, 2**64)
_powers: dict[tuple[int, int], np.ndarray] = {}

#: How the words of a row are read.
Reader = Callable[[object, str | None], list[bytes]]


def split_words(doc_id, text: str | None) -> list[bytes]:
    """Runs of characters other than ASCII white space; a null text has none."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


# -- tiles -------------------------------------------------------------------


def tiles_of(n: int, tile: int = TILE) -> Iterator[tuple[int, int, int, int]]:
    """``first, length, low, high`` for a text of ``n`` words: where a tile is and the octaves it is solved for.

    Octaves go up to the last that holds a period of at most half the text.
    Tiles start at multiples of their octaves' boundaries.
    """
    top = (n // 2).bit_length() - 1
    low = 0
    while low <= top:
        length, high = max(tile, 8 << low), low
        while high < top and (max(tile, 8 << (high + 1)) == length or n <= length):
            high += 1
        first = 0
        while True:
            yield first, min(length, n - first), low, high
            if first + length >= n:
                break
            first += length // 2
        low = high + 1


def _ids(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal where the words are."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def tiles(docs: DataFrame, read: Reader = split_words, tile: int = TILE) -> DataFrame:
    """A row for each tile: the document's id and text hash, ``first``, ``low``, ``high``, ``words`` (32-bit numbers)."""
    docs = _keyed(docs)
    schema = plus(type(docs.schema)([docs.schema[c] for c in _KEY]), first="long", low="int", high="int", words="binary")
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(c) for c in _KEY]
            rows: list[tuple] = []
            held = 0

            def ready(rows: list[tuple]) -> pa.RecordBatch:
                columns = list(zip(*rows, strict=True)) or [()] * 5
                own = [k.take(pa.array(columns[0], pa.int64())) for k in keys]
                arrays = [pa.array(list(c), t) for c, t in zip(columns[1:], kinds, strict=True)]
                return pa.RecordBatch.from_arrays([*own, *arrays], names=schema.names)

            for i, text in enumerate(batch.column("text")):
                ids = _ids(read(keys[0][i].as_py(), text.as_py()))
                for first, length, low, high in tiles_of(len(ids), tile):
                    if length >= SHORTEST:
                        rows.append((i, first, low, high, ids[first : first + length].tobytes()))
                        held += length
                    if held >= 1 << 20:
                        yield ready(rows)
                        rows, held = [], 0
            yield ready(rows)

    return docs.mapInArrow(run, schema)


def _keyed(docs: DataFrame) -> DataFrame:
    """Id, hash of the text and text: rows that agree in the first two are taken for the same text."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


# -- one tile ----------------------------------------------------------------


def _wrapped(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for i up to ``n``."""
    key = (base, 0)
    if key not in _powers or len(_powers[key]) <= n:
        held = np.full(max(n + 1, 2 * TILE), base, np.uint64)
        held[0] = 1
        _powers[key] = np.multiply.accumulate(held)
    return _powers[key][: n + 1]


def _modular(which: int, n: int) -> np.ndarray:
    """Powers of the ``which``-th base modulo its prime, for i up to ``n``."""
    key = (which, 1)
    if key not in _powers or len(_powers[key]) <= n:
        size, prime = max(n + 1, 2 * TILE), _PRIMES[which]
        held = np.ones(1, np.int64)
        while len(held) < size:  # doubling: the upper half is the lower times base ** length
            held = np.concatenate([held, held * pow(_BASES[which], len(held), prime) % prime])
        _powers[key] = held
    return _powers[key][: n + 1]


class _Equal:
    """Whether stretches ``q`` apart are equal, by prefix fingerprints modulo two primes."""

    def __init__(self, x: np.ndarray):
        values = x.astype(np.int64) + 1
        self.sums = []
        for which, prime in enumerate(_PRIMES):
            sums = np.zeros(len(x) + 1, np.int64)
            np.cumsum(values * _modular(which, len(x))[:-1] % prime, out=sums[1:])
            self.sums.append(sums % prime)

    def __call__(self, at: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the ``length`` words from ``at`` equal those from ``at + q``."""
        out = np.ones(len(at), bool)
        for which, (sums, prime) in enumerate(zip(self.sums, _PRIMES, strict=True)):
            one = (sums[at + length] - sums[at]) % prime * _modular(which, len(sums))[q] % prime
            out &= one == (sums[at + q + length] - sums[at + q]) % prime
        return out


def _bisected(most: np.ndarray, holds) -> np.ndarray:
    """The largest length up to ``most`` for which ``holds``, which is true up to it and false beyond."""
    low, high = np.zeros_like(most), most.copy()
    while (open_ := low < high).any():
        mid = (low + high + 1) // 2
        good = holds(mid)
        low = np.where(open_ & good, mid, low)
        high = np.where(open_ & ~good, mid - 1, high)
    return low


def _sifted(x: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries and periods of octaves ``low`` to ``high`` around which half of what a run needs is equal.

    A run has the prefix and suffix values f and g with ``f + g >= need``, so one
    of them is half of it or more; ``h`` is the least such half in the octave.
    Position x stands for the pair of period q = x - b with the boundary b.
    """
    n = len(x)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _wrapped(_SIFT, n)[:-1], out=sums[1:])
    inverse = _wrapped(_SIFT_INVERSE, n)
    at, period = [], []
    for k in range(low, high + 1):
        p = 1 << k
        h = min(-(-max(SHORTEST - q, q) // 2) for q in {p, 2 * p - 1, min(max(p, SHORTEST // 2), 2 * p - 1)})
        if n < p + h:
            break
        block = (sums[h:] - sums[:-h]) * inverse[: n + 1 - h]
        there = np.arange(p, n + 1)
        b = (there // p - 1) * p
        forward = np.flatnonzero(np.repeat(block[: n + 1 - h : p], p)[: max(0, len(block) - p)] == block[p:])
        start = -(-h // p) * p  # pairs whose boundary has h words before it
        ahead = there[start:] - h
        backward = np.flatnonzero(block[ahead] == block[b[start:] - h]) + start
        found = np.union1d(forward, backward)
        at.append(b[found])
        period.append(there[found] - b[found])
    empty = np.empty(0, np.int64)
    return (np.concatenate(at), np.concatenate(period)) if at else (empty, empty)


def _smallest(equal: _Equal, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether ``q`` is the smallest period of each stretch (of two periods or more): no q / r for a prime r is one."""
    out, rest, r = np.ones(len(q), bool), q.copy(), 2
    while True:
        if r * r > rest.max(initial=1):
            r_each = rest  # what is left of each is 1 or a prime
            last = np.flatnonzero((rest > 1) & out)
            shorter = q[last] // r_each[last]
            out[last] &= ~equal(start[last], shorter, end[last] - start[last] - shorter)
            return out
        hit = np.flatnonzero((rest % r == 0) & out)
        if len(hit):
            shorter = q[hit] // r
            out[hit] &= ~equal(start[hit], shorter, end[hit] - start[hit] - shorter)
        while (more := rest % r == 0).any():
            rest[more] //= r
        r += 1


def solve(x: np.ndarray, low: int, high: int) -> list[tuple[int, int, int]]:
    """``start, end, period`` of each run of octaves ``low`` to ``high`` in the words ``x``, cut off where they end."""
    b, q = _sifted(x, low, high)
    if not len(b):
        return []
    equal = _Equal(x)
    f = _bisected(len(x) - b - q, lambda m: equal(b, q, m))
    g = _bisected(b, lambda m: equal(b - m, q, m))
    good = f + g >= np.maximum(SHORTEST - q, q)
    found = np.unique(np.stack([b - g, b + q + f, q], 1)[good], axis=0)
    found = found[_smallest(equal, found[:, 0].copy(), found[:, 1].copy(), found[:, 2].copy())]
    out = []
    for start, end, period in found.tolist():
        same = x[start : end - period] == x[start + period : end]
        if same.all():
            out.append((start, end, period))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]])))
        for a, z in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if z - a >= max(SHORTEST - period, period):
                out.append((start + a, start + z + period, period))
    return out


# -- fragments and runs --------------------------------------------------------


def fragments(found: DataFrame) -> DataFrame:
    """``start, end, period`` of the runs in each tile, in words of the document."""
    schema = plus(type(found.schema)([found.schema[c] for c in _KEY]), start="long", end="long", period="long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("first", "low", "high")]
            for i, (first, low, high) in enumerate(zip(*columns, strict=True)):
                words = np.frombuffer(batch.column("words")[i].as_buffer(), np.int32)
                rows += [(i, first + s, first + e, q) for s, e, q in solve(words, low, high)]
            place, *spans = list(zip(*rows, strict=True)) or [()] * 4
            own = [batch.column(c).take(pa.array(place, pa.int64())) for c in _KEY]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(s, pa.int64()) for s in spans)], names=schema.names)

    return found.mapInArrow(run, schema)


def stitched(parts: DataFrame) -> DataFrame:
    """Runs from fragments: those of one document and period that overlap by a period or more are one.

    Equal fragments (of rows that repeat) are dropped before the shuffle.
    """
    parts = parts.groupBy(*_KEY, "period", "start").agg(F.max("end").alias("end"))
    same = W.partitionBy(*_KEY, "period").orderBy("start")
    before = F.max("end").over(same.rowsBetween(W.unboundedPreceding, -1))
    opens = F.when(F.col("start") + F.col("period") <= before, 0).otherwise(1)
    islands = parts.withColumn("opens", opens).withColumn("island", F.sum("opens").over(same.rowsBetween(W.unboundedPreceding, 0)))
    runs = islands.groupBy(*_KEY, "period", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.select(*_KEY, "start", (F.col("end") - F.col("start")).alias("length"), "period")


def runs(docs: DataFrame, read: Reader = split_words, tile: int = TILE) -> DataFrame:
    """``doc_id, text_hash, start, length, period`` of every run.

    Texts that may be longer than a tile (a word and its space take two
    characters) have their tiles dealt out by a shuffle; the others' single tile
    is solved where it was made.
    """
    long = F.coalesce(F.length("text"), F.lit(0)) >= 2 * tile
    short = fragments(tiles(docs.filter(~long), read, tile))
    dealt = tiles(docs.filter(long), read, tile).repartition(*_KEY, "low", "first")
    return stitched(short.unionByName(fragments(dealt)))


def collapsed(docs: DataFrame, read: Reader = split_words, tile: int = TILE) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` for each row of ``docs``.

    ``runs`` holds ``start, length, period`` of every run by start, then period.
    ``collapsed`` is the text without what runs repeat: a word goes if any run
    holds it after that run's first ``period`` words; the kept ones are joined
    by single spaces.
    """
    docs = _keyed(docs)
    own = runs(docs, read, tile).groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    own = own.select(F.col("doc_id").alias("run_doc"), F.col("text_hash").alias("run_hash"), "runs")
    met = F.col("doc_id").eqNullSafe(F.col("run_doc")) & (F.col("text_hash") == F.col("run_hash"))
    held = docs.join(own, met, "left").select(
        "doc_id",
        "text",
        *[F.coalesce(F.col(f"runs.{c}"), F.array().cast("array<bigint>")).alias(f"{c}s") for c in ("start", "length", "period")],
    )
    out = plus(type(held.schema)([held.schema["doc_id"]]), n_words="long", collapsed="string")
    for c in ("starts", "lengths", "periods"):
        out.add(held.schema[c])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [batch.column(c).to_pylist() for c in ("starts", "lengths", "periods")]
            counts, texts = [], []
            for i, text in enumerate(batch.column("text")):
                words = read(batch.column("doc_id")[i].as_py(), text.as_py())
                counts.append(len(words))
                kept = np.ones(len(words), bool)
                for start, length, period in zip(*(s[i] for s in spans), strict=True):
                    kept[start + period : start + length] = False
                if not kept.all():
                    words = [words[j] for j in np.flatnonzero(kept)]
                texts.append(b" ".join(words))
            arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*arrays, *(batch.column(c) for c in ("starts", "lengths", "periods"))], names=out.names)

    flat = held.mapInArrow(run, out)
    zipped = F.arrays_zip(F.col("starts").alias("start"), F.col("lengths").alias("length"), F.col("periods").alias("period"))
    return flat.select("doc_id", "n_words", zipped.alias("runs"), "collapsed")
