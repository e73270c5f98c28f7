"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents are long, so a document is looked at through
windows.  Items are partitioned by size: class ``c`` holds those of at most
``SMALLEST * 2 ** c`` shingles, and its windows are twice that long, at steps of
a quarter.  An item of which a window holds ``PERCENT`` per cent has at least a
fifth of the window's shingles in common with it, so of ``HASHES`` independent
minima one at least is equal but for a chance below 1 in 5,000 (at full
containment, below 1 in 100,000).  Block minima of one class are made of those
of the class before.  An item of at most ``FEW`` distinct shingles fills too
little of its window for that, so its shingles are looked up themselves.
Whatever is proposed is verified: the share of the item's distinct shingles
that the whole document holds.

Items are read in blocks of about ``BLOCK_BYTES``, one pass over the documents
for each; a block's index is all that tasks are sent, and where there are
several, each block's result is written before the next is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import plus, shingle_hashes, staged, word_hashes

PERCENT, WORDS = 80, 5
HASHES, SMALLEST = 40, 8
#: Distinct shingles of an item up to which it is found by each of them.
FEW = 4
#: UTF-8 bytes of the items searched for in one pass (each row counts 64 more), and shingles whose minima are held at once.
BLOCK_BYTES, HELD = 8 << 20, 100_000
_FACTORS = np.random.default_rng(5).integers(1, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SALTS = np.random.default_rng(6).integers(1, 2**32, HASHES, dtype=np.uint32)


def _values(shingles: np.ndarray) -> np.ndarray:
    """One row of hash values for each function."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    return (x[None, :] ^ _SALTS[:, None]) * _FACTORS[:, None]


class Index:
    """The minima of a block of items, by size class."""

    def __init__(self, items: list[tuple], k: int = WORDS):
        self.sets, self.ids = [], []
        few: list[tuple[int, int]] = []
        by_class: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, text in items:
            found = shingle_hashes(word_hashes(text), k, short=False)
            if len(found):
                own = np.unique(found)
                if len(own) <= FEW:
                    few += [(s, len(self.sets)) for s in own.tolist()]
                else:
                    size = 0
                    while SMALLEST << size < len(found):
                        size += 1
                    by_class.setdefault(size, []).append((len(self.sets), _values(found).min(1)))
                self.sets.append(own)
                self.ids.append(item_id)
        few.sort()
        self.few = np.array([s for s, _ in few], np.uint64), np.array([i for _, i in few], np.int64)
        self.classes = {}
        for size, rows in sorted(by_class.items()):
            minima = np.stack([m for _, m in rows])
            keys = minima.astype(np.uint64) | (np.arange(HASHES, dtype=np.uint64) << np.uint64(32))[None, :]
            order = np.argsort(keys, axis=None, kind="stable")
            item = np.repeat(np.array([i for i, _ in rows]), HASHES)[order]
            bits = min(26, max(16, int(keys.size * 64).bit_length()))
            table = np.zeros(1 << bits, bool)
            table[(minima & np.uint32((1 << bits) - 1)).ravel()] = True
            self.classes[size] = (keys.ravel()[order], item, table)
        self.longest = 2 * SMALLEST << max(by_class, default=0)

    def proposals(self, shingles: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """First places, items and length of the windows that share a minimum with an item."""
        step = SMALLEST // 4
        padded = np.concatenate([shingles, np.repeat(shingles[-1:], -len(shingles) % step)])
        minima = _values(padded).reshape(HASHES, -1, step).min(2)
        for size in range(max(self.classes) + 1):
            if size:
                step *= 2
                if minima.shape[1] % 2:
                    minima = np.concatenate([minima, minima[:, -1:]], axis=1)
                minima = np.minimum(minima[:, ::2], minima[:, 1::2])
            if size not in self.classes:
                continue
            keys, item, table = self.classes[size]
            wide = minima
            for shift in (1, 2, 4):
                shift = min(shift, wide.shape[1])
                last = np.repeat(wide[:, -1:], shift, axis=1)
                wide = np.minimum(wide, np.concatenate([wide[:, shift:], last], axis=1))
            row, at = np.nonzero(table[wide & np.uint32(len(table) - 1)])
            found = wide[row, at].astype(np.uint64) | (row.astype(np.uint64) << np.uint64(32))
            low, high = np.searchsorted(keys, found), np.searchsorted(keys, found, side="right")
            times = high - low
            begin = np.repeat(low - (np.cumsum(times) - times), times)
            yield np.repeat(at * step, times), item[begin + np.arange(times.sum())], 8 * step

    def matches(self, shingle_lists: list[np.ndarray], percent: int = PERCENT) -> list[list[tuple[int, int]]]:
        """For each list the items it contains, with the number of shared shingles."""
        out: list[list[tuple[int, int]]] = [[] for _ in shingle_lists]
        if not self.sets:
            return out
        proposed: set[tuple[int, int]] = set()
        group: list[tuple[int, np.ndarray]] = []
        held = 0
        for doc, found in enumerate(shingle_lists):
            proposed.update((doc, item) for item in self._with_few(found))
            if not self.classes:
                continue
            for at in range(0, len(found), HELD):  # parts overlap by the longest window
                part = found[max(0, at - self.longest) : at + HELD]
                group.append((doc, part))
                held += len(part)
                if held >= HELD:
                    proposed |= self._proposed(group)
                    group, held = [], 0
        proposed |= self._proposed(group)
        last, own = -1, np.empty(0, np.uint64)
        for doc, item in sorted(proposed):
            if doc != last:
                last, own = doc, np.unique(shingle_lists[doc])
            wanted = self.sets[item]
            at = np.searchsorted(own, wanted).clip(0, len(own) - 1)
            shared = int((own[at] == wanted).sum())
            if 100 * shared >= percent * len(wanted):
                out[doc].append((item, shared))
        return out

    def _with_few(self, found: np.ndarray) -> list[int]:
        """Items of few shingles of which ``found`` holds one."""
        keys, item = self.few
        if not len(keys):
            return []
        low, high = np.searchsorted(keys, found), np.searchsorted(keys, found, side="right")
        met = np.flatnonzero(high > low)
        return [int(i) for at in met for i in item[low[at] : high[at]]]

    def _proposed(self, group: list[tuple[int, np.ndarray]]) -> set[tuple[int, int]]:
        if not group:
            return set()
        ends = np.cumsum([len(p) for _, p in group])
        docs = np.array([d for d, _ in group])
        pairs: set[tuple[int, int]] = set()
        for at, item, length in self.proposals(np.concatenate([p for _, p in group])):
            first = np.searchsorted(ends, at, side="right").clip(0, len(ends) - 1)
            last = np.searchsorted(ends, at + length - 1, side="right").clip(0, len(ends) - 1)
            for a, b, i in set(zip(first.tolist(), last.tolist(), item.tolist(), strict=True)):
                pairs.update((int(d), i) for d in docs[a : b + 1])
        return pairs


def _blocks(items: DataFrame) -> Iterator[tuple[list[tuple], bool]]:
    """The items block by block, each with whether it is the only one."""
    items = items.select("item_id", "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(64)
    parts = max(1, -(-(items.agg(F.sum(size)).first()[0] or 0) // BLOCK_BYTES))
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for part in range(parts):
        yield [(r[0], r[1]) for r in items.filter(place == part).distinct().collect()], parts == 1


def contained(docs: DataFrame, items: DataFrame, percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """``doc_id, item_id, n_shared, n_item``: test items of which a document holds ``percent`` per cent.

    Counts are of distinct shingles of ``k`` words (white space between, A-Z
    lower-cased) over the whole document.  Null or blank texts, and those with
    fewer words than ``k``, have no shingles and match nothing.  Rows of
    ``docs`` that repeat match each; equal items count once.  Further columns
    are ignored.  An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    item_type = items.select("item_id").schema.fields[0]
    schema = plus(type(docs.schema)([docs.schema["doc_id"], item_type]), n_shared="long", n_item="long")
    out = docs.sparkSession.createDataFrame([], schema)
    for block, alone in _blocks(items):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = Index(held.value, k)
            for batch in batches:
                doc_ids = batch.column("doc_id").to_pylist()
                texts = batch.column("text").to_pylist()
                found = index.matches([shingle_hashes(word_hashes(t), k, short=False) for t in texts], percent)
                rows = [(d, index.ids[i], n, len(index.sets[i])) for d, hits in zip(doc_ids, found, strict=True) for i, n in hits]
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                kinds = [batch.schema.field("doc_id").type, _arrow(item_type), pa.int64(), pa.int64()]
                arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "item_id", "n_shared", "n_item"])

        found = docs.mapInArrow(run, schema)
        if alone:
            return found
        out = out.unionByName(staged(found, "contained"))
    return out


def _arrow(field) -> pa.DataType:
    return {"long": pa.int64(), "integer": pa.int32()}.get(field.dataType.typeName(), pa.string())


def drop_contaminated(docs: DataFrame, items: DataFrame, percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """The rows of ``docs`` that contain no test item, with all their columns."""
    for block, alone in _blocks(items):
        held = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = Index(held.value, k)
            for batch in batches:
                texts = batch.column("text").to_pylist()
                found = index.matches([shingle_hashes(word_hashes(t), k, short=False) for t in texts], percent)
                yield batch.filter(pa.array([not hits for hits in found], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        docs = docs if alone else staged(docs, "uncontaminated")
    return docs
