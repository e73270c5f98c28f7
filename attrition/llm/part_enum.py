"""N-gram Jaccard join by PartEnum signatures.

A document's set holds its distinct shingles of ``k`` words.  Two sets link
when ``100 * intersection >= percent * union``.

*Size bands.*  Linked sizes differ by at most ``percent``; bands grow by the
square of that ratio, so linked sets lie in one band or in neighbouring ones.
A set signs for its own band, and for the next one when a partner can be there.

*Signatures.*  Linked sets of a band with largest size ``u`` differ in at most
``d = floor(2u(100 - percent) / (100 + percent))`` shingles.  The shingle
domain is cut into ``n1`` parts; so many that some part differs in at most one
shingle.  Each part is cut into three, and a signature is the content of two of
them: one difference spoils at most two of a part's three signatures, so linked
sets share one.  Empty contents would match at random.  A set of ``n`` shingles
differs from any partner in the band in at most
``floor((n + min(u, 100n / percent))(100 - percent) / (100 + percent))`` of them, mostly fewer than
``d``, so a number of its parts that may hold empty contents can be done without:
it skips them unless it has more such parts.  ``spare`` extra parts add to that
number.  A signature is sent as 48 bits; chance matches fail as other pairs do.

*Search.*  Equal sets carry one key and are collapsed in the map tasks.  A
signature that only one set has needs no look; the others form buckets.  Round
by round, growing numbers of bucket members (the first; the next fourteen; eight
times as many; ...) are compared with those after them that are not yet in their
component, unless their sizes or their parities (of the shingles in 256 bins)
show that too many shingles differ; a bucket whose sets are all connected is done, and so is one
whose members have all been compared: only open buckets are read in a later round.  So a bucket of
near copies costs about one comparison a set, and no possible link is left out.
Pairs that are left are held against parities in as many bins as a set has
shingles (a bit for each, where a text takes some fifty), folded to the smaller
set's: a bin whose parity differs holds a shingle that differs, so this too drops
no link, and hardly a pair of unlike sets passes.  What passes is verified on the
full shingle sets.

Tables staged on the way are deleted once the result is written.

Shingles and sets are known by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import mix, plus, scratch, shingle_hashes, signed, staged, word_hashes
from attrition.llm.components import components

#: Least share of the union, in per cent, and words a shingle.
PERCENT, WORDS = 85, 4
SUBPARTS = 3
#: Bits of a signature that are kept.
SIGNATURE = np.uint64(2**48 - 1)
#: Columns with the parities of a set's shingle counts in 64 bins each.
PARITIES = ("p0", "p1", "p2", "p3")
#: Bits of a bitmap that tasks are sent, at most: 16 MB.
BITMAP = 2**27
_PLACE = np.uint64(0x9FB21C651E98DF25)


def size_bands(percent: int, largest: int = 2**40) -> np.ndarray:
    """Largest size of each band, ascending."""
    ends, low = [], 1
    while low <= largest:
        ends.append(low * 10_000 // percent**2)
        low = ends[-1] + 1
    return np.array(ends)


def set_key(shingles: np.ndarray) -> int:
    return int(signed(mix(np.array([np.sum(shingles) + np.uint64(len(shingles))], np.uint64)))[0])


def part_signatures(shingles: np.ndarray, sums: np.ndarray, label: int, last: int, percent: int) -> np.ndarray:
    """Signatures of a sorted set for the band ``label`` whose largest size is ``last``.

    ``sums`` are the running sums of the set, from 0.
    """
    differ = 2 * last * (100 - percent) // (100 + percent)
    salt = np.uint64(label * 0xD1342543DE82EF95 % 2**64)
    if differ == 0:
        return mix(sums[-1:] + salt)
    needed = differ // 2 + 1
    n1 = needed + needed // 20
    size = len(shingles)
    own = (size + min(last, size * 100 // percent)) * (100 - percent) // (100 + percent)
    # Parts that differ in two shingles or more from a partner are own // 2 at most; one other part has to be left.
    dispensable = n1 - own // 2 - 1
    place = np.arange(n1 * SUBPARTS, dtype=np.uint64)
    at = np.append(np.searchsorted(shingles, place * np.uint64(2**64 // len(place))), len(shingles))
    counts = np.diff(at).reshape(n1, SUBPARTS)
    content = np.diff(sums[at]).reshape(n1, SUBPARTS)
    held = counts.sum(1, keepdims=True) - counts
    others = content.sum(1, keepdims=True, dtype=np.uint64) - content
    signatures = mix(others.ravel() + (place + salt) * _PLACE)
    empty = held == 0
    if not empty.any() or empty.any(1).sum() > dispensable:
        return signatures
    return signatures[~empty.ravel()]


def signatures(shingles: np.ndarray, ends: np.ndarray, percent: int) -> np.ndarray:
    band = int(np.searchsorted(ends, len(shingles)))
    sums = np.zeros(len(shingles) + 1, np.uint64)
    np.cumsum(shingles, out=sums[1:])
    out = [part_signatures(shingles, sums, band, int(ends[band]), percent)]
    if len(shingles) * 100 // percent > ends[band]:
        out.append(part_signatures(shingles, sums, band + 1, int(ends[band + 1]), percent))
    return np.concatenate(out) & SIGNATURE


def spread(shingles: np.ndarray) -> bytes:
    """The parities of a set's shingles by their low bits, in a power of two of bins: as many as it has, 256 at least."""
    bins = max(256, 1 << (len(shingles) - 1).bit_length()) if len(shingles) else 256
    odd = np.bincount((shingles & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def apart(one: bytes, other: bytes) -> int:
    """Bins in which the parities differ, at the smaller number of bins: no more than the shingles that differ."""
    a, b = sorted((np.frombuffer(x, np.uint8) for x in (one, other)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def _nodes(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, spreads, maps = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = np.unique(shingle_hashes(word_hashes(text), k))
                keys.append(set_key(s) if len(s) else None)
                sizes.append(len(s))
                odd = np.bincount((s & np.uint64(64 * len(PARITIES) - 1)).astype(np.int64), minlength=64 * len(PARITIES)) & 1
                spreads.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                maps.append(spread(s))
            parities = np.concatenate([*spreads, np.empty(0, np.int64)]).reshape(-1, len(PARITIES))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64())]
                + [pa.array(parities[:, i]) for i in range(len(PARITIES))]
                + [pa.array(maps, pa.binary())],
                names=["doc_id", "key", "n", *PARITIES, "spread"],
            )

    return run


def _signed_sets(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, seen = size_bands(percent), set()
        for batch in batches:
            keys, lists = [], []
            for text in batch.column("text").to_pylist():
                s = np.unique(shingle_hashes(word_hashes(text), k))
                if len(s) and (key := set_key(s)) not in seen:
                    if len(seen) >= 1_000_000:  # copies further apart collapse in the shuffle
                        seen.clear()
                    seen.add(key)
                    keys.append(key)
                    lists.append(signed(signatures(s, ends, percent)))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)]).astype(np.int32)
            flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                names=["key", "sigs"],
            )

    return run


def _with_key(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(word_hashes(t), k)) for t in batch.column("text").to_pylist()]
            keys = pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, "_key"])

    return run


def _checked_texts(k: int):
    """Rows whose text has the shingle set of ``key`` (a doc_id may repeat with other texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                s = np.unique(shingle_hashes(word_hashes(text), k))
                keep.append(len(s) > 0 and set_key(s) == key)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def _possible(percent: int):
    """Pairs whose parities allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
            maps = zip(batch.column("spread_a").to_pylist(), batch.column("spread_b").to_pylist(), strict=True)
            differ = np.fromiter((apart(a, b) for a, b in maps), np.int64, len(sizes))
            keep = differ * (100 + percent) <= sizes * (100 - percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, held = [], None, None
            columns = (batch.column(c).to_pylist() for c in ("a", "text_a", "text_b"))
            for a, text_a, text_b in zip(*columns, strict=True):
                if a != last:
                    last, held = a, np.unique(shingle_hashes(word_hashes(text_a), k))
                other = np.unique(shingle_hashes(word_hashes(text_b), k))
                both = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(held) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of sig and key: those whose sig has several keys, ranked by key.

    Only the last row seen is held, so a common signature needs no memory.
    """
    last, waits = (None, 0, 0), False  # sig, key and rank of the last row; it is the first of its sig
    for batch in batches:
        sig, key = (batch.column(c).to_numpy() for c in ("sig", "key"))
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
        if len(sig):
            fresh[0] = (sig[0], key[0]) != last[:2]
        sig, key = sig[fresh], key[fresh]
        if not len(sig):
            continue
        joined = sig[0] == last[0]
        if joined and waits:
            sig, key = np.concatenate([[last[0]], sig]), np.concatenate([[last[1]], key])
        begins = np.ones(len(sig), bool)
        begins[1:] = sig[1:] != sig[:-1]
        at = np.arange(len(sig))
        rank = at - np.maximum.accumulate(np.where(begins, at, 0)) + 1
        if joined and not waits:
            until = int(np.argmax(begins[1:])) + 1 if begins[1:].any() else len(sig)
            rank[:until] += last[2]
        keep = rank > 1
        keep[:-1] |= ~begins[1:]
        last, waits = (sig[-1], key[-1], int(rank[-1])), rank[-1] == 1
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (sig, key, rank)], names=["sig", "key", "rank"])


def _buckets(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``(sig, key, rank)`` of the signatures that several sets have."""
    return (
        docs.select("text")
        .mapInArrow(_signed_sets(k, percent), "key long, sigs array<long>")
        .select(F.explode("sigs").alias("sig"), "key")
        .repartition("sig")
        .sortWithinPartitions("sig", "key")
        .mapInArrow(_shared, "sig long, key long, rank long")
    )


def _sieved(rows: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not in ``wanted``, which is staged; the rest is for a join to drop.

    Tasks are sent a bitmap of hashes (2 MB for a million values, ``BITMAP`` bits at most), so what is
    not wanted is not shuffled.
    """
    bits = min(BITMAP, max(2**15, 1 << (16 * wanted.count()).bit_length()))
    at = F.pmod(F.xxhash64(column), F.lit(bits))
    marks = wanted.groupBy(F.bitmap_bucket_number(at).alias("_block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.expr("shiftright(_byte, _place) & 1") == 1
    met = rows.join(F.broadcast(marks), F.bitmap_bucket_number(at) == F.col("_block"))
    return met.withColumns({"_byte": byte, "_place": (place % 8).cast("int")}).filter(marked).select(*rows.columns)


def _candidate_texts(docs: DataFrame, sets: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    wanted = staged(buckets.select("key").distinct().join(sets, "key").select("key", F.col("rep").alias("doc_id")), "cand")
    found = _sieved(docs, wanted, "doc_id").join(wanted, "doc_id").select("key", "text")
    return found.mapInArrow(_checked_texts(k), "key long, text string").dropDuplicates(["key"])


def _may_link(percent: int) -> Column:
    """Sizes and parities allow a link: each parity that differs takes a shingle that differs."""
    sizes = F.least("n", "n_a") * 100 >= F.greatest("n", "n_a") * percent
    apart = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"{p}_a"))) for p in PARITIES), F.lit(0))
    return sizes & (apart * (100 + percent) <= (F.col("n") + F.col("n_a")) * (100 - percent))


def _sifted(pairs: DataFrame, spreads: DataFrame, percent: int) -> DataFrame:
    a, b = (spreads.select(*[F.col(c).alias(x if c == "key" else f"{c}_{x}") for c in spreads.columns]) for x in "ab")
    both = pairs.join(b, "b").join(a, "a").select("a", "b", "n_a", "n_b", "spread_a", "spread_b")
    return both.mapInArrow(_possible(percent), "a long, b long")


def _verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key")))
    texts = _sieved(texts, ends, "key")
    a = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(b, "b").join(a, "a").select("a", "text_a", "b", "text_b")
    return both.mapInArrow(_verified(k, percent), "a long, b long")


def jaccard_components(docs: DataFrame, percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text, ...)``.

    ``component_id`` is the smallest doc_id reachable by links, itself
    included.  A null or blank text has no shingles and links with nothing; a
    null doc_id takes part in no link and its component is null.  Rows that
    repeat come out as often as they went in.  Further columns are ignored.
    An empty table gives an empty result.
    """
    return _classes(docs, percent, k).drop("key")


def _classes(docs: DataFrame, percent: int, k: int) -> DataFrame:
    """``doc_id, n_shingles, component_id, key``, written; what was staged for it is gone."""
    with scratch(docs.sparkSession):
        found = _found_classes(docs.select("doc_id", "text"), percent, k)
        return staged(found, "classes", stays=True)


def _found_classes(docs: DataFrame, percent: int, k: int) -> DataFrame:
    columns = plus(docs.select("doc_id").schema, key="long", n="long", **dict.fromkeys(PARITIES, "long"), spread="binary")
    nodes = staged(docs.mapInArrow(_nodes(k), columns), "sets")
    usable = nodes.filter("key IS NOT NULL AND doc_id IS NOT NULL")
    sets = usable.groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), *[F.max(p).alias(p) for p in PARITIES])
    known = docs.filter("doc_id IS NOT NULL")
    buckets = staged(_buckets(known, k, percent).join(sets.drop("rep"), "key"), "buckets")
    texts = staged(_candidate_texts(known, sets, buckets, k), "texts")
    own = usable.join(buckets.select("key").distinct(), "key", "left_semi")
    spreads = staged(own.groupBy("key").agg(F.max("n").alias("n"), F.max("spread").alias("spread")), "spreads")

    links, tested, first = None, None, 1
    open_rows = buckets.withColumn("root", F.col("key"))
    while (top := open_rows.agg(F.max("rank")).first()[0]) is not None and first < top:
        until = 2 if first == 1 else 8 * first
        lead = open_rows.filter(F.col("rank").between(first, until - 1)).select(
            "sig", *[F.col(c).alias(f"{c}_a") for c in ("key", "rank", "root", "n", *PARITIES)]
        )
        pairs = (
            lead.join(open_rows, "sig")
            .filter("rank > rank_a AND root <> root_a")
            .filter(_may_link(percent))
            .select(F.col("key_a").alias("a"), F.col("key").alias("b"))
            .distinct()
        )
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = staged(pairs, "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        near = staged(_sifted(pairs, spreads, percent), "near")
        found = staged(_verify(near, texts, k, percent), "found")
        first = until
        if found.isEmpty():
            continue
        roots = staged(components(found if links is None else links.unionByName(found)), "roots")
        links = roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
        # Classes only grow, so a bucket that is done stays done; so does one without members after those compared.
        rows = open_rows.drop("root").join(roots.withColumnRenamed("node", "key"), "key", "left").select(
            "sig", "key", "rank", "n", *PARITIES, F.coalesce("root", "key").alias("root")
        )
        ends = [F.min("root").alias("x"), F.max("root").alias("y"), F.max("rank").alias("last")]
        undone = rows.groupBy("sig").agg(*ends).filter((F.col("x") != F.col("y")) & (F.col("last") > first))
        open_rows = staged(rows.join(undone.select("sig"), "sig", "left_semi"), "open")

    if links is None:
        named = sets.select("key", F.col("rep").alias("component_id"))
    else:
        tied = sets.join(roots.withColumnRenamed("node", "key"), "key", "left").select(
            "key", "rep", F.coalesce("root", "key").alias("root")
        )
        least = tied.groupBy("root").agg(F.min("rep").alias("component_id"))
        named = tied.join(least, "root").select("key", "component_id")
    linked = usable.join(named, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id", "key")
    alone = nodes.filter("key IS NULL OR doc_id IS NULL").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), "key"
    )
    return linked.unionByName(alone)


def keep_representatives(docs: DataFrame, percent: int = PERCENT, k: int = WORDS) -> DataFrame:
    """One document of each component: the one with the smallest doc_id, with all its columns.

    Documents without shingles, or with a null doc_id, link with nothing and
    stay.  Of rows with the same doc_id and text one stays.
    """
    classes = _classes(docs, percent, k)
    away = F.max(F.col("doc_id") != F.col("component_id"))
    marks = classes.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(away.alias("_away"), F.count("*").alias("_rows"))
    marked = docs.join(marks.filter("_away OR _rows > 1"), "doc_id", "left").select(*docs.columns, "_away", "_rows")
    plain = marked.filter("_rows IS NULL").select(*docs.columns)
    # Several rows of one doc_id: each is judged by its own text's set.
    several = marked.filter("_rows > 1").select(*docs.columns).dropDuplicates(["doc_id", "text"])
    keyed = several.mapInArrow(_with_key(k), plus(several.schema, _key="long"))
    gone = classes.filter("doc_id <> component_id").select("doc_id", F.col("key").alias("_key")).distinct()
    return plain.unionByName(keyed.join(gone, ["doc_id", "_key"], "left_anti").select(*docs.columns))
