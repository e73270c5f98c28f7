"""Embedding near-duplicates by spherical-cap filters.

A filter is a direction; a vector passes it when their cosine is above a limit.
Directions are the sums of one code vector from each of ``PARTS`` codes, each
code living on its own slice of the (randomly rotated) space.  Because the
product is a sum over slices, all filters a vector passes are listed from its
inner products with the few code vectors, without trying every filter.  The
codes grow with the square root of the number of vectors, so the vectors a
filter catches do not.  Close vectors pass many filters in common; one that
passes none is given its best.

Vectors are compared with those of the same length, and each length has codes
for its own number of vectors.  Short ones get zeros behind, up to ``DIMS``
components, so that their filters are as varied.  Of one-component vectors only
the sign counts.

Equal vectors are collapsed first and count by their number.  Filters are
dealt into cells of consecutive numbers, by exact counts, so that a cell's
vectors fit one task; a vector goes to each cell once, however many of its
filters it passes there.  A filter that has too many vectors alone is a cell in
blocks, and every pair of blocks meets.  Cells are compared in rounds: what one
round sends is bounded by the size of the vectors themselves, and is deleted
before the next.  A pair counts at the smallest filter both have passed, so
once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attrition.llm.common import mix, scratch, staged
from attrition.llm.components import components

COSINE = 0.9
#: Filters that a vector passes on average, at least, slices of the space, and vectors of a cell that meet at once, up to twice as many.
PASSED, PARTS, BLOCK = 20, 2, 1 << 16
#: Vectors of a cell, at least, if there are so many, and cells of a round, about, as long as they are smaller than a block.
LEAST, CELLS = 1 << 14, 16
#: Bytes of a block's vectors, in double precision, if it has over 512.
BLOCK_BYTES = 1 << 25
#: What a round sends, in sizes of the vectors, or bytes if that is less; bytes of a row besides its vector and list.
ROUND, ROUND_BYTES, ROW_BYTES = 2, 1 << 27, 64
#: Numbers held at once where filters are listed and small filters compared, pairs held at once, and rows whose lists are unpacked at once.
AT_ONCE, PAIRS, UNPACKED = 1 << 22, 1 << 20, 1 << 13
#: Share of pairs just at the limit that have to share a filter, and random pairs to measure it on.
RECALL, PROBES = 0.95, 512
#: Components that filters have, at least.
DIMS = 16
#: Entries of filter lists that are compared at once.
ENTRIES = 4_000_000
#: Vectors from which a filter's are compared by products of their lists too if there are more close pairs a vector, and from which by themselves.
DENSE, CROWDED, LARGE = 24, 4, 128
#: Vectors and filters that a product takes at once, and filters of the first.
TILE, WIDE, FIRST = 1024, 4096, 64
#: Cosines in single precision are looked at again if this near the limit.
CLOSE = 1e-4
_SEED = 20_240_101


def code_size(vectors: int) -> int:
    """Code vectors of each slice."""
    return max(8, int(np.ceil(np.sqrt(4.0 * vectors))))


def codes(dims: int, vectors: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rotation and the unit code vectors of each slice."""
    chance = np.random.default_rng(_SEED)
    dims = max(dims, DIMS)
    rotation, _ = np.linalg.qr(chance.normal(size=(dims, dims)))
    size = code_size(vectors)
    out = []
    for part in np.array_split(np.arange(dims), PARTS):
        code = chance.normal(size=(size, len(part)))
        out.append(code / np.linalg.norm(code, axis=1, keepdims=True))
    return rotation, out


def _probes(dims: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Random unit vectors, and for each one at that cosine."""
    chance = np.random.default_rng(_SEED + 1)
    a, b = chance.normal(size=(2, PROBES, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    if dims == 1:
        return a, a
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * b


def _value(unit: np.ndarray, rotation: np.ndarray, parts: list[np.ndarray], share: float) -> float:
    """The filter value that ``unit`` exceeds for that share of all filters, by bisection."""
    first, second = parts
    turned = unit @ rotation[: unit.shape[1]]
    a, b = turned[:, : first.shape[1]] @ first.T, np.sort(turned[:, first.shape[1] :] @ second.T, axis=1)
    wanted = share * len(unit) * len(first) * len(second)
    low, high = -2.0, 2.0
    for _ in range(30):
        middle = (low + high) / 2
        above = sum(int((len(y) - np.searchsorted(y, middle - x)).sum()) for x, y in zip(a, b, strict=True))
        low, high = (middle, high) if above > wanted else (low, middle)
    return low


def limit(dims: int, vectors: int, cosine: float = COSINE) -> tuple[float, float]:
    """Filters passed on average, and the filter value for it, so that vectors at the cosine meet.

    The more vectors, the smaller the caps and the fewer of its filters a vector
    shares with one at the limit.  So the number passed grows from ``PASSED``
    until ``RECALL`` of random pairs just at the limit share a filter.
    """
    rotation, parts = codes(dims, vectors)
    a, b = _probes(dims, cosine)
    filters, wanted = len(parts[0]) * len(parts[1]), float(PASSED)
    while True:
        share = min(0.5, wanted / filters)
        least = _value(a[:128], rotation, parts, share)
        both = zip(passed(a, rotation, parts, least), passed(b, rotation, parts, least), strict=True)
        met = np.mean([len(np.intersect1d(x, y, assume_unique=True)) > 0 for x, y in both])
        if met >= RECALL or share == 0.5:
            return wanted, least
        wanted *= 1.25


def _listed(unit: np.ndarray, rotation: np.ndarray, parts: list[np.ndarray], least: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each row of ``unit`` the filters it passes, or its best: codes ``x`` of the first slice, ascending, and for each
    how many of ``y`` go with it, codes of the second, best first."""
    first, second = parts
    step = max(1, min(1024, AT_ONCE // len(first)))
    for at in range(0, len(unit), step):
        turned = unit[at : at + step] @ rotation[: unit.shape[1]]
        a, b = turned[:, : first.shape[1]] @ first.T, turned[:, first.shape[1] :] @ second.T
        best_a, best_b = a.max(1, keepdims=True), b.max(1, keepdims=True)
        row_x, xs = np.nonzero(a - least >= -best_b)
        row_y, ys = np.nonzero(-b <= best_a - least)
        down = np.lexsort((-b[row_y, ys], row_y))
        ys, low = ys[down], -b[row_y, ys][down]
        need = a[row_x, xs] - least
        begin_x, begin_y = (np.searchsorted(r, np.arange(len(turned) + 1)) for r in (row_x, row_y))
        for i in range(len(turned)):
            of_x, of_y = slice(*begin_x[i : i + 2]), slice(*begin_y[i : i + 2])
            held = np.searchsorted(low[of_y], need[of_x], side="right")  # y >= least - x
            if len(held):
                yield xs[of_x], held, ys[of_y]
            else:
                yield np.array([np.argmax(a[i])]), np.array([1]), np.array([np.argmax(b[i])])


def passed(unit: np.ndarray, rotation: np.ndarray, parts: list[np.ndarray], least: float) -> list[np.ndarray]:
    """The numbers of all filters that each row of ``unit`` passes, ascending; of one that passes none, its best."""
    size = len(parts[1])
    return [np.sort(np.concatenate([x * size + y[:n] for x, n in zip(xs, held, strict=True)])) for xs, held, y in _listed(unit, rotation, parts, least)]


def _usable(column: str) -> Column:
    fine = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(column).isNotNull() & fine & F.exists(column, lambda x: x != 0)


def _unit(rows: list) -> np.ndarray:
    x = np.array(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _short(vectors: int) -> np.dtype:
    """The type of the numbers in a list of filters."""
    return np.dtype("<u2" if code_size(vectors) < 1 << 16 else "<u4")


def _column(column: pa.Array | pa.ChunkedArray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """A column of byte strings as one array of numbers, and where each string begins and the last ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // kind.itemsize
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[: ends[-1] * kind.itemsize].view(kind), ends


def _runs(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``begin``, ``begin + 1``, ... for each of them, ``n`` numbers each."""
    return np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())


class _Packed:
    """Packed lists of filters, as ``_listed`` gives them."""

    def __init__(self, column: pa.Array | pa.ChunkedArray, vectors: int):
        self.flat, ends = _column(column, _short(vectors))
        self.size, self.begin = code_size(vectors), ends[:-1]
        self.n = self.flat[self.begin].astype(np.int64)

    def firsts(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and place of the codes of the first slice that have filters from ``low`` to below ``high``, and the codes; rows ascend."""
        row, at = np.repeat(np.arange(len(self.n)), self.n), _runs(self.begin + 1, self.n)
        x = self.flat[at]
        some = np.flatnonzero((x >= low // self.size) & (x <= (high - 1) // self.size))
        return row[some], at[some], x[some].astype(np.int64)

    def entries(self, low: int = 0, high: int = 1 << 62) -> tuple[np.ndarray, np.ndarray]:
        """Row and number of the filters from ``low`` to below ``high``; rows ascend."""
        row, at, x = self.firsts(low, high)
        held = self.flat[at + self.n[row]].astype(np.int64)
        y = self.flat[_runs(self.begin[row] + 1 + 2 * self.n[row], held)]
        row, filters = np.repeat(row, held), np.repeat(x * self.size, held) + y
        fine = (filters >= low) & (filters < high)
        return row[fine], filters[fine]


def _entries(column: pa.Array | pa.ChunkedArray, vectors: int, low: int = 0, high: int = 1 << 62) -> tuple[np.ndarray, np.ndarray]:
    return _Packed(column, vectors).entries(low, high)


def _lists(column: pa.Array | pa.ChunkedArray, vectors: int) -> list[np.ndarray]:
    """All filters of each row, ascending."""
    out, kind = [], np.int32 if code_size(vectors) ** 2 < 1 << 31 else np.int64
    for at in range(0, len(column), UNPACKED):
        some = column[at : at + UNPACKED]
        row, filters = _entries(some, vectors)
        order = np.lexsort((filters, row))
        out += np.split(filters[order].astype(kind), np.searchsorted(row, np.arange(1, len(some))))
    return out


def _catch(vectors: dict[int, int], limits: dict[int, tuple[float, float]], kind: np.dtype):
    """Vectors and the filters each passes, packed; for each length, its number of distinct vectors and its ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(maxsize=4)
        def model(dims: int):
            return *codes(dims, vectors[dims]), limits[dims][1]

        for batch in batches:
            lengths = batch.column("dims").to_numpy()
            for dims in np.unique(lengths).tolist():
                own, short = np.flatnonzero(lengths == dims), _short(vectors[dims])
                for at in range(0, len(own), 1024):
                    some = batch.take(pa.array(own[at : at + 1024]))
                    v = some.column("v").flatten().to_numpy().astype(kind).reshape(-1, dims)
                    lists = [np.concatenate([[len(x)], x, held, y]).astype(short).tobytes() for x, held, y in _listed(_unit(v), *model(dims))]
                    columns = [*some.select(["id", "copies", "dims", "digest"]).columns, pa.array([x.tobytes() for x in v], pa.binary()), pa.array(lists, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "copies", "dims", "digest", "v", "filters"])

    return run


class Cells(NamedTuple):
    """Cells of the filters of one length: the distinct vectors of that length, the first filter of each cell, its blocks and its first unit.

    A unit is a block with all pairs of blocks of which it is the lower one.
    """

    vectors: int
    starts: np.ndarray
    blocks: np.ndarray
    units: np.ndarray

    def holds(self, unit: int) -> bool:
        return bool(self.units[0] <= unit < self.units[-1] + self.blocks[-1])

    def filters(self, unit: int) -> tuple[int, int]:
        """The first filter of the unit's cell and the first after it."""
        cell = int(np.searchsorted(self.units, unit, side="right")) - 1
        return int(self.starts[cell]), int(self.starts[cell + 1]) if cell + 1 < len(self.starts) else code_size(self.vectors) ** 2


def _count(starts: dict[int, tuple[int, np.ndarray]]):
    """Vectors of each cell; as cell -1 the bytes of their lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, size = {d: np.zeros(len(x), np.int64) for d, (_, x) in starts.items()}, dict.fromkeys(starts, 0)
        for batch in batches:
            lengths = batch.column("dims").to_numpy()
            for dims in np.unique(lengths).tolist():
                vectors, begins = starts[dims]
                lists = batch.column("filters").take(pa.array(np.flatnonzero(lengths == dims)))
                size[dims] += lists.nbytes
                n[dims] += np.bincount(_met_cells(lists, vectors, begins)[1], minlength=len(begins))
        for dims, of in n.items():
            if size[dims]:
                cells = np.flatnonzero(of)
                columns = [np.full(len(cells) + 1, dims, np.int32), np.append(cells, -1), np.append(of[cells], size[dims])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["dims", "cell", "n"])

    return run


def _met_cells(lists: pa.Array, vectors: int, starts: np.ndarray, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and cell of each cell from ``first`` to before ``last`` that a row passes a filter of."""
    high = int(starts[last]) if last is not None and last < len(starts) else 1 << 62
    packed = _Packed(lists, vectors)
    if (starts % packed.size).any():
        row, filters = packed.entries(int(starts[first]), high)
    else:
        row, _, x = packed.firsts(int(starts[first]), high)
        filters = x * packed.size
    both = np.unique(row * len(starts) + np.searchsorted(starts, filters, side="right") - 1)
    return both // len(starts), both % len(starts)


def _block(dims: int) -> int:
    """Vectors of that length that meet at once."""
    return min(BLOCK, max(512, BLOCK_BYTES // (8 * dims)))


def _divided(n: np.ndarray, starts: np.ndarray, end: int, block: int) -> np.ndarray | None:
    """Starts of cells where those with too many vectors are divided, if there are any."""
    width = np.diff(np.append(starts, end))
    if not ((n > 2 * block) & (width > 1)).any():
        return None
    parts = np.where(n > 2 * block, np.minimum(width, 2 * -(-n // block)), 1)
    return np.repeat(starts, parts) + np.repeat(width, parts) * _runs(np.zeros_like(parts), parts) // np.repeat(parts, parts)


def _joined(n: np.ndarray, most: int) -> np.ndarray:
    """Which cells begin one when neighbours are put together, up to ``most`` vectors."""
    held, out = 0, []
    for i, x in enumerate(n.tolist()):
        held += x
        if not out or held > most:
            out.append(i)
            held = x
    return np.array(out)


def _cells(caught: DataFrame, vectors: dict[int, int], kind: np.dtype, most: float) -> tuple[dict[int, Cells], np.ndarray]:
    """The cells of each length, and the bytes that each unit sends; ``most`` is what a round sends."""
    starts = {d: np.arange(code_size(n), dtype=np.int64) * code_size(n) for d, n in vectors.items()}
    while True:
        rows = caught.select("dims", "filters").mapInArrow(_count({d: (vectors[d], x) for d, x in starts.items()}), "dims int, cell long, n long")
        n, size = {d: np.zeros(len(x), np.int64) for d, x in starts.items()}, {}
        for dims, cell, held in rows.groupBy("dims", "cell").agg(F.sum("n")).collect():  # a row for each cell
            if cell < 0:
                size[dims] = held
            else:
                n[dims][cell] = held
        divided = {d: _divided(n[d], x, code_size(vectors[d]) ** 2, _block(d)) for d, x in starts.items()}
        if all(x is None for x in divided.values()):
            break
        starts = {d: starts[d] if x is None else x for d, x in divided.items()}
    cells, sent, units = {}, [], 0
    for dims, begins in starts.items():
        row, block = kind.itemsize * dims + size[dims] / vectors[dims] + ROW_BYTES, _block(dims)
        first = _joined(n[dims], min(block, max(LEAST, int(most / row) // CELLS)))
        held = np.add.reduceat(n[dims], first)
        blocks = np.where(held > 2 * block, -(-held // block), 1)
        cells[dims] = Cells(vectors[dims], begins[first], blocks, units + np.cumsum(blocks) - blocks)
        units += int(blocks.sum())
        each, lower = np.repeat(held / blocks, blocks), _runs(np.zeros_like(blocks), blocks)
        sent.append(each * (2 * (np.repeat(blocks, blocks) - lower) - 1) * row)
    return cells, np.concatenate(sent)


def _send(cells: dict[int, Cells], first: int, last: int):
    """Vectors for the units from ``first`` to before ``last``, once for each pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("dims").to_numpy()
            for dims in np.unique(lengths).tolist():
                own, (vectors, starts, blocks, units) = batch.take(pa.array(np.flatnonzero(lengths == dims))), cells[dims]
                some = np.searchsorted(units, (first, last), side="right") - 1
                if last <= units[0] or first >= units[-1] + blocks[-1]:
                    continue
                row, cell = _met_cells(own.column("filters"), vectors, starts, max(0, int(some[0])), int(some[1]) + 1)
                n = blocks[cell]
                block = (mix(own.column("id").to_numpy().view(np.uint64))[row] % n.astype(np.uint64)).astype(np.int64)
                row, cell, block, other = np.repeat(row, n), np.repeat(cell, n), np.repeat(block, n), _runs(np.zeros_like(n), n)
                unit = units[cell] + np.minimum(block, other)
                fine = (unit >= first) & (unit < last)
                row, block, other, unit = (x[fine] for x in (row, block, other, unit))
                side = np.where(block == other, 2, np.where(block < other, 0, 1))
                columns = [pa.array(x) for x in (unit, np.maximum(block, other), side.astype(np.int32))]
                names = ["id", "copies", "v", "filters"]
                yield pa.RecordBatch.from_arrays([*columns, *own.select(names).take(pa.array(row)).columns], ["unit", "other", "side", *names])

    return run


def _roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``size`` nodes the smallest it is linked to by the links a-b, over any number of steps."""
    root = np.arange(size)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _first_shared(lists: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest number that ``lists[i]`` and ``lists[j]`` share, for each pair; every pair shares one."""
    sizes = np.array([len(x) for x in lists], np.int64)
    flat = np.concatenate(lists).astype(np.int64)
    starts = np.cumsum(sizes) - sizes

    def entries(at: np.ndarray) -> np.ndarray:
        n = sizes[at]
        begin = np.repeat(np.cumsum(n) - n, n)
        filters = flat[np.repeat(starts[at], n) + np.arange(n.sum()) - begin]
        return np.repeat(np.arange(len(at)), n) << 42 | filters

    out = np.empty(len(i), np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes[i] + sizes[j]) // ENTRIES, prepend=0))
    for part in np.split(np.arange(len(i)), cuts):
        both = np.intersect1d(entries(i[part]), entries(j[part]), assume_unique=True)
        _, first = np.unique(both >> 42, return_index=True)
        out[part] = both[first] & ((1 << 42) - 1)
    return out


class _Shared:
    """Numbers that lists share, those of most lists first."""

    def __init__(self, lists: list[np.ndarray]):
        row = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
        _, column, held = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        rank = np.empty(len(held), np.int32)
        rank[np.argsort(-held, kind="stable")] = np.arange(len(held))
        self.size = int((held > 1).sum())
        shared = held[column] > 1
        row, self.column = row[shared], rank[column[shared]]
        self.begin = np.searchsorted(row, np.arange(len(lists) + 1))

    def _incidence(self, rows: np.ndarray, low: int, high: int) -> np.ndarray:
        n = self.begin[rows + 1] - self.begin[rows]
        row, column = np.repeat(np.arange(len(rows)), n), self.column[_runs(self.begin[rows], n)]
        some = (column >= low) & (column < high)
        out = np.zeros((len(rows), high - low), np.float32)
        out[row[some], column[some] - low] = 1
        return out

    def without(self, wanted: np.ndarray, a: int, b: int) -> np.ndarray:
        """``wanted`` pairs, of lists from ``a`` and from ``b`` on, but those that share a number, by products of their incidence."""
        wanted, cuts = wanted.copy(), [0, *range(min(FIRST, self.size), self.size, WIDE), self.size]
        for low, high in zip(cuts, cuts[1:], strict=False):
            i, j = np.flatnonzero(wanted.any(1)), np.flatnonzero(wanted.any(0))
            if not len(i):
                break
            if low < high:
                apart = self._incidence(a + i, low, high) @ self._incidence(b + j, low, high).T == 0
                if apart.size == wanted.size:
                    wanted &= apart
                else:
                    wanted[np.ix_(i, j)] &= apart
        return wanted


def _pairs_of_crowd(
    v: np.ndarray, single: np.ndarray, own: list[np.ndarray], below: list[np.ndarray], side: np.ndarray, cosine: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs at the limit or closer that share a number of ``own``, and none of ``below``."""
    own, below, blocks = _Shared(own), _Shared(below), (side != 2).any()
    for a in range(0, len(v), TILE):
        for b in range(a, len(v), TILE):
            near = single[a : a + TILE] @ single[b : b + TILE].T
            wanted = near >= cosine - CLOSE
            if blocks:
                wanted &= _meet_sides(side[a : a + TILE, None], side[None, b : b + TILE])
            if a == b:
                wanted = np.triu(wanted, 1)
            wanted = below.without(wanted, a, b)
            if wanted.any():
                wanted &= ~own.without(wanted, a, b)
            i, j = np.nonzero(wanted)
            sure = near[i, j] >= cosine + CLOSE
            sure[~sure] = _near(v, a + i[~sure], b + j[~sure], cosine)
            yield a + i[sure], b + j[sure]


def _near(v: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
    """Whether the pairs of these rows are at the limit or closer."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 14):
        some = slice(at, at + (1 << 14))
        out[some] = np.einsum("ij,ij->i", _unit(v[i[some]]), _unit(v[j[some]])) >= cosine
    return out


def _meet_sides(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether a pair of these sides is compared: both of one block (2), or of the two (0 and 1)."""
    both = one * 3 + other
    return (both == 8) | (both == 1) | (both == 3)


def _close_of_small(single: np.ndarray, row: np.ndarray, begins: np.ndarray, sizes: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in ``row`` of the pairs, about at the limit or closer, of each of the runs of ``sizes`` that begin there; and where runs begin whose pairs are too many to list."""
    order = np.argsort(sizes, kind="stable")
    begins, sizes = begins[order], sizes[order]
    at = 0
    while at < len(sizes):
        few = max(1, AT_ONCE // (int(sizes[at]) * max(int(sizes[at]), single.shape[1])))
        end = min(at + few, int(np.searchsorted(sizes, max(sizes[at] + 1, sizes[at] * 1.2), side="right")))
        n = int(sizes[end - 1])
        real = np.arange(n) < sizes[at:end, None]
        some = single[row[np.where(real, begins[at:end, None] + np.arange(n), 0)]]
        near = some @ some.transpose(0, 2, 1) >= cosine - CLOSE
        near &= np.triu(np.ones((n, n), bool), 1) & real[:, None, :]
        run, i, j = np.nonzero(near)
        crowded = (sizes[at:end] >= DENSE) & (np.bincount(run, minlength=end - at) > CROWDED * sizes[at:end])
        fine = ~crowded[run]
        yield begins[at:end][run[fine]] + i[fine], begins[at:end][run[fine]] + j[fine], begins[at:end][crowded]
        at = end


def _close_of_one(single: np.ndarray, side: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Places of the pairs of one filter about at the limit or closer; none if they are too many to list."""
    out, n, blocks = [], 0, (side != 2).any()
    for a in range(0, len(single), TILE):
        for b in range(a, len(single), TILE):
            near = single[a : a + TILE] @ single[b : b + TILE].T >= cosine - CLOSE
            if a == b and np.count_nonzero(near) <= len(near):  # each with itself
                continue
            if blocks:
                near &= _meet_sides(side[a : a + TILE, None], side[None, b : b + TILE])
            i, j = np.nonzero(np.triu(near, 1) if a == b else near)
            n += len(i)
            if n > CROWDED * len(single):
                return None
            out.append((a + i, b + j))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 2


def _crowds(row: np.ndarray, crowded: list[slice], rows: int) -> list[tuple[np.ndarray, list[slice]]]:
    """Crowded filters with those they share vectors with, if so they take fewer pairs, as rows and the filters' places; else one by one."""
    if not crowded:
        return []
    members = np.concatenate([row[x] for x in crowded])
    first = np.repeat([row[x.start] for x in crowded], [x.stop - x.start for x in crowded])
    root = _roots(rows, members, first)
    out = []
    of = root[[row[x.start] for x in crowded]]
    for one in np.unique(of).tolist():
        places = [x for x, y in zip(crowded, of.tolist(), strict=True) if y == one]
        together = np.unique(np.concatenate([row[x] for x in places]))
        if len(together) ** 2 <= sum((x.stop - x.start) ** 2 for x in places):
            out.append((together, places))
        else:
            out += [(row[x], [x]) for x in places]
    return out


class _Links:
    """Links of each vector and its component, from pairs of rows; pairs are held until there are ``PAIRS``."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray):
        self.names, self.place = np.unique(ids, return_inverse=True)
        self.copies, self.n, self.root = copies, np.zeros(len(self.names)), np.arange(len(self.names))
        self.held, self.size = [], 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        self.held.append((i, j))
        self.size += len(i)
        if self.size >= PAIRS:
            self._settle()

    def _settle(self) -> None:
        if self.held:
            i, j = (np.concatenate(x) for x in zip(*self.held, strict=True))
            a, b, size = self.place[i], self.place[j], len(self.names)
            self.n += np.bincount(a, self.copies[j], size) + np.bincount(b, self.copies[i], size)
            self.root = _roots(size, np.append(a, np.arange(size)), np.append(b, self.root))
        self.held, self.size = [], 0

    def ended(self) -> pd.DataFrame:
        """Each vector's links, and one link to its component's first vector."""
        self._settle()
        met = self.n > 0
        return pd.DataFrame({"id": self.names[met], "n": self.n[met].astype(np.int64), "root": self.names[self.root[met]]})


def _linked(
    ids: np.ndarray, copies: np.ndarray, v: np.ndarray, lists: Callable[[np.ndarray], list[np.ndarray]], row: np.ndarray, filters: np.ndarray, side: np.ndarray, cosine: float
) -> pd.DataFrame:
    """Links among vectors that pass the same of the ``filters``, each given with its vector's row: each vector's links, and one link to its component's first vector."""
    order = np.argsort(filters, kind="stable")
    row, filters = row[order], filters[order]
    single = np.concatenate([_unit(v[at : at + 4096]).astype(np.float32) for at in range(0, len(v), 4096)])
    _, begins, sizes = np.unique(filters, return_index=True, return_counts=True)
    close, crowded = [(np.empty(0, np.int64), np.empty(0, np.int64))], []
    small = (sizes > 1) & (sizes < LARGE)
    for i, j, many in _close_of_small(single, row, begins[small], sizes[small], cosine):
        close.append((i, j))
        crowded += many.tolist()
    for begin, size in zip(begins[sizes >= LARGE].tolist(), sizes[sizes >= LARGE].tolist(), strict=True):
        own = row[begin : begin + size]
        if (some := _close_of_one(single[own], side[own], cosine)) is None:
            crowded.append(begin)
        else:
            close.append((begin + some[0], begin + some[1]))
    crowded.sort()
    crowded = [slice(x, y) for x, y in zip(crowded, (begins + sizes)[np.searchsorted(begins, crowded)].tolist(), strict=True)]
    # The first filter here of each close pair, if that is the first of all.
    at, to = (np.concatenate(x) for x in zip(*close, strict=True))
    number, i, j = filters[at], np.minimum(row[at], row[to]), np.maximum(row[at], row[to])
    down = np.argsort(number, kind="stable")
    keys, first = np.unique((i * len(v) + j)[down], return_index=True)
    number, i, j = number[down][first], keys // len(v), keys % len(v)
    fine = _meet_sides(side[i], side[j]) & _near(v, i, j, cosine)
    crowds = _crowds(row, crowded, len(v))
    of = np.full(len(v), -1)
    for k, (rows, places) in enumerate(crowds):
        if len(places) > 1:
            of[rows] = k
    fine &= (of[i] < 0) | (of[i] != of[j])
    number, i, j = number[fine], i[fine], j[fine]
    links = _Links(ids, copies)
    known = np.unique(np.concatenate([i, j, *(rows for rows, _ in crowds)]))
    held_of = lists(known) if len(known) else []
    if len(i):
        first = _first_shared(held_of, np.searchsorted(known, i), np.searchsorted(known, j)) == number
        links.add(i[first], j[first])
    for rows, places in crowds:
        held = [held_of[x] for x in np.searchsorted(known, rows).tolist()]
        low, high = (filters[0], filters[-1]) if len(places) > 1 else (filters[places[0].start],) * 2
        own = [x[np.searchsorted(x, low) : np.searchsorted(x, high, side="right")] for x in held]
        below = [x[: np.searchsorted(x, low)] for x in held]
        for a, b in _pairs_of_crowd(v[rows], single[rows], own, below, side[rows], cosine):
            links.add(rows[a], rows[b])
    return links.ended()


def _compare(cosine: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """``_linked`` of a frame with a row for each vector and filter."""
        lists = rows["filters"].tolist()
        columns = (rows[x].to_numpy() for x in ("id", "copies", "filter", "side"))
        ids, copies, filters, side = columns
        return _linked(ids, copies, np.array(rows["v"].tolist(), np.float64), lambda at: [lists[i] for i in at], np.arange(len(rows)), filters, side, cosine)

    return run


def _meet(cells: dict[int, Cells], kind: np.dtype, cosine: float):
    def run(rows: pa.Table) -> pa.Table:
        """``_linked`` of the vectors of a cell, or of two of its blocks."""
        unit, lists = rows.column("unit")[0].as_py(), rows.column("filters").combine_chunks()
        dims, own = next(x for x in cells.items() if x[1].holds(unit))
        v, _ = _column(rows.column("v"), kind)
        row, filters = _entries(lists, own.vectors, *own.filters(unit))
        ids, copies, side = (rows.column(x).to_numpy() for x in ("id", "copies", "side"))
        found = _linked(ids, copies, v.reshape(-1, dims), lambda at: _lists(lists.take(pa.array(at)), own.vectors), row, filters, side, cosine)
        return pa.Table.from_pandas(found, preserve_index=False)

    return run


def _found(caught: DataFrame, vectors: dict[int, int], kind: np.dtype, cosine: float) -> DataFrame:
    """Links of the vectors of all cells, ``id, n, root``, round by round."""
    most = max(ROUND_BYTES, ROUND * sum(kind.itemsize * d * n for d, n in vectors.items()))
    cells, sent = _cells(caught, vectors, kind, most)
    cuts, held = [0], 0.0
    for unit, size in enumerate(sent.tolist()):
        held += size
        if held > most and unit > cuts[-1]:
            cuts.append(unit)
            held = size
    schema = "unit long, other long, side int, id long, copies long, v binary, filters binary"
    out = []
    for first, last in zip(cuts, [*cuts[1:], len(sent)], strict=True):
        met = caught.mapInArrow(_send(cells, first, last), schema)
        out.append(staged(met.groupBy("unit", "other").applyInArrow(_meet(cells, kind, cosine), "id long, n long, root long"), "found"))
    return reduce(DataFrame.unionByName, out)


def _digest(column: str) -> Column:
    return F.xxhash64(column)


def near_duplicates(rows: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``rows(vec_id, embedding, ...)``.

    Vectors that are null, empty, zero, or with a null or non-finite component
    link with nothing, and a null vec_id takes no part.  Vectors of different
    lengths do not link.  Rows that repeat are vectors of their own.  Further
    columns are ignored.  An empty table gives an empty result.
    """
    v = F.col("embedding")
    signs = F.transform(v, lambda x: F.signum(x).cast(rows.schema["embedding"].dataType.elementType))
    rows = rows.select("vec_id", F.when(F.size(v) == 1, signs).otherwise(v).alias("v"))
    fine = _usable("v") & F.col("vec_id").isNotNull()
    rows = rows.withColumn("_good", F.coalesce(fine, F.lit(False)))
    alone = rows.filter("NOT _good").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")
    )
    good, spark = rows.filter("_good").select("vec_id", "v", _digest("v").alias("digest")), rows.sparkSession
    with scratch(spark):
        with scratch(spark):
            classes = good.groupBy("v").agg(F.min("vec_id").cast("long").alias("id"), F.count("*").alias("copies"), F.first("digest").alias("digest"))
            classes = staged(classes.withColumn("dims", F.size("v")), "classes")
            # A row for each length that occurs.
            vectors = {r["dims"]: r["n"] for r in classes.groupBy("dims").agg(F.count("*").alias("n")).collect()}
            if not vectors:
                return alone
            limits = {d: limit(d, n, cosine) for d, n in vectors.items()}
            kind = np.dtype("<f4" if isinstance(rows.schema["v"].dataType.elementType, T.FloatType) else "<f8")
            schema = "id long, copies long, dims int, digest long, v binary, filters binary"
            caught = staged(classes.mapInArrow(_catch(vectors, limits, kind), schema), "caught", stays=True)
            # Rows find their class by its digest; by the vector itself only if two classes have the same.
            key = "v" if classes.groupBy("digest").count().filter("count > 1").limit(1).count() else "digest"
            names = caught if key == "digest" else staged(classes, "names", stays=True)
        found = _found(caught, vectors, kind, cosine)
        links = found.groupBy("id").agg(F.sum("n").alias("_links"))
        roots = components(found, "id", "root")
        tied = (
            names.select("id", "copies", key)
            .join(links, "id", "left")
            .join(roots.withColumnRenamed("node", "id"), "id", "left")
            .select(key, (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
        )
        tied = staged(tied, "tied", stays=True)
    linked = good.select("vec_id", key).join(tied, key)
    linked = linked.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    return linked.unionByName(alone)
