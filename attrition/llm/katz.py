"""Katz back-off scores of texts.

A text is its words, then one end token; the word before the first is the end
token too.  The model knows every word and every run of up to ``ORDER`` words
of the training texts, with its count.  (``katz_scores`` can be asked to keep
only the most frequent words apart; all others then share one class, and
P(word | before) = P(class | classes before) P(word | class).)

*Counts.*  Good-Turing discounts d_r (Katz's, for counts up to ``K``) take mass
from seen words and runs.  At the lowest level it goes to unseen words.  A run
that was met has d c / c(before); any other backs off to the run without its
first word, times the context's weight a(before), which is exactly the mass left
over the lower level's mass of the words not met there.  So each context's
probabilities, an unseen word's among them, add up to one.

*Order of work.*  Words get numbers by falling count, so a word's count follows
from its number and a list of the different counts (fewer than the square root
of twice the tokens).  Texts are kept as packed numbers, some megabytes of text
to a row.  Every token is sent, with the ``ORDER - 1`` words before it, to the
bucket of the word just before it: all runs that end in these two words, and all
contexts of these runs, meet there and nowhere else.  So a bucket counts,
discounts and scores by itself, and no table of runs is kept or joined.  The
tokens are sent twice, once for the numbers of runs with each small count, which
the discounts need, and once to be scored; sums by text come back.

*Frequent words.*  The tokens after a word that makes up more than a given share
of all are dealt to several buckets by the word before it.  Longer contexts stay
whole.  Counts of the pairs that begin with such a word are added up over its
buckets and sent back to them, and its weight as a context (there are at most
1 / share such words) is sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import mix, scratch, signed, staged, word_hashes

ORDER, K = 3, 5
#: Keys of the end token and of the class that words beyond a given vocabulary share.
END, OTHER = np.uint64(0), np.uint64(1)
_CONTEXT, _TAIL = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
#: Tokens a bucket holds and how many of them are looked at at once, about; bytes of text a task looks at at once.
BUCKET_TOKENS, PORTION, AT_ONCE = 1_000_000, 250_000, 4 << 20
_LOW = np.uint64(32)


def discounts(of_counts: dict[int, int], k: int = K) -> np.ndarray:
    """d_0 to d_k (d_0 unused) from the number of types with each count.

    Counts of counts too few for Katz's formula give (r - 0.5) / r.
    """
    n = [0] + [of_counts.get(r, 0) for r in range(1, k + 2)]
    out = np.array([1.0] + [(r - 0.5) / r for r in range(1, k + 1)])
    if all(n[1:]):
        common = (k + 1) * n[k + 1] / n[1]
        found = np.array([1.0] + [((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) if common < 1 else 0 for r in range(1, k + 1)])
        if (found[1:] > 0).all() and (found[1:] < 1).all():
            return found
    return out


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    c = np.asarray(counts, float)
    return c * np.where(c < len(d), d[np.minimum(c, len(d) - 1).astype(int)], 1.0)


def training(doc_id: str = "doc_id"):
    """Rows that train; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 10 != 0


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Word hashes of the batch's texts, in runs of bounded size, each with the first text's place."""
    first, held, group = 0, 0, []
    for i, text in enumerate(batch.column("text").to_pylist()):
        group.append(word_hashes(text))
        held += len(text or "")
        if held >= AT_ONCE:
            yield first, group
            first, held, group = i + 1, 0, []
    if group:
        yield first, group


def _chain(group: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all tokens, texts in a row; the text of each and its place there."""
    lengths = np.array([len(g) + 1 for g in group])
    flat = np.full(lengths.sum(), END, np.uint64)
    ends = np.cumsum(lengths) - 1
    inside = np.ones(len(flat), bool)
    inside[ends] = False
    flat[inside] = np.concatenate(group)
    return flat, np.repeat(np.arange(len(group)), lengths), np.arange(len(flat)) - np.repeat(ends - lengths + 1, lengths)


def _classes(flat: np.ndarray, kept: np.ndarray | None) -> np.ndarray:
    """The tokens' classes; ``kept`` are the sorted keys of classes of their own, if not all are."""
    return flat if kept is None else np.where(np.isin(flat, kept), flat, OTHER)


def _run_key(context: np.ndarray, tail: np.ndarray, k: int) -> np.ndarray:
    return mix(context * _CONTEXT + tail * _TAIL + np.uint64(k))


def _runs(flat: np.ndarray, place: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length from 2: the last tokens' places in ``flat``, and keys of the runs, their contexts and tails."""
    keys = np.concatenate([[END], flat])
    for k in range(2, order + 1):
        context, tail = keys[:-1], keys[1:]
        keys = _run_key(context, tail, k)
        at = np.flatnonzero(place[k - 2 :] >= k - 2)
        yield k, at + k - 2, keys[at], context[at], tail[at]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> np.uint64(33)).astype(np.int64) % buckets


def _split(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by bucket, the buckets that are met, and where each begins in it (and the end)."""
    small = len(bucket) and bucket.max() < 1 << 16
    order = np.argsort(bucket.astype(np.uint16) if small else bucket, kind="stable")  # the short ones by radix
    begins = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    return order, bucket[order[begins]], np.append(begins, len(order))


def _lists(values: np.ndarray, begins: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(begins.astype(np.int32)), pa.array(values, kind))


def _counted(kept, k: int, buckets: int):
    """Runs of ``k`` words by bucket, packed, each once for a group of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, group in _parts(batch):
                flat, _, place = _chain(group)
                for length, _, keys, context, tail in _runs(_classes(flat, kept and kept.value), place, k):
                    if length == k:
                        keys, first, counts = np.unique(keys, return_index=True, return_counts=True)
                        order, met, begins = _split(_bucket(keys, buckets))
                        lists = (signed(context[first][order]), signed(tail[first][order]), counts[order])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(met, pa.int32()), *(_lists(x, begins, pa.int64()) for x in lists)],
                            names=["bucket", "context", "tail", "c"],
                        )

    return run


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of equal length, numbers below 2 ** 32: first all lowest bytes, then the next ones."""
    planes = np.array(columns, "<u4").view(np.uint8).reshape(len(columns), -1, 4).transpose(2, 0, 1)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, columns, -1)
    return np.ascontiguousarray(planes.transpose(1, 2, 0)).view("<u4")[:, :, 0]


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of texts: tokens as places in the sorted keys of the group, and how often each key trains."""
    number = TaskContext.get().partitionId() << 33
    for batch in batches:
        for first, group in _parts(batch):
            flat, text, _ = _chain(group)
            rows = batch.slice(first, len(group))
            train = rows.column("train").to_numpy(zero_copy_only=False).astype(bool)
            keys, codes = np.unique(flat, return_inverse=True)
            counts = np.bincount(codes[train[text]], minlength=len(keys))
            one = lambda x, t: pa.array([x], pa.list_(t))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(group)], pa.int32()), rows.column("doc_id")),
                    one(train, pa.bool_()),
                    one(np.bincount(text), pa.int32()),
                    pa.array([_packed([codes])], pa.binary()),
                    one(signed(keys), pa.int64()),
                    one(counts, pa.int64()),
                ],
                names=["group", "doc_id", "train", "lengths", "codes", "keys", "c"],
            )
            number += 1


def _asked(buckets: int):
    """Keys of a group of texts, still in order, and their counts by bucket: each has a range of the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                keys, counts = (row.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("keys", "c"))
                bucket = (((keys.view(np.uint64) >> _LOW) * np.uint64(buckets)) >> _LOW).astype(np.int64)
                begins = np.flatnonzero(np.diff(bucket, prepend=-1))
                lists = [_lists(x, np.append(begins, len(keys)), pa.int64()) for x in (keys, counts)]
                group = pa.array(np.full(len(begins), row.column("group")[0].as_py()), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(bucket[begins], pa.int32()), group, *lists], names=["bucket", "group", "keys", "c"])

    return run


def _words_counted(rows: pd.DataFrame) -> pd.DataFrame:
    """A bucket's words that train, with their counts."""
    keys, counts = (np.concatenate(rows[x].tolist()) for x in ("keys", "c"))
    keys, places = np.unique(keys, return_inverse=True)
    counts = np.bincount(places, counts, len(keys)).astype(np.int64)
    return pd.DataFrame({"bucket": rows["bucket"].iloc[0], "key": keys, "c": counts})[counts > 0]


def _words_numbered(unknown: int):
    """The numbers of the keys that groups ask a bucket for, in their order."""

    def run(asked: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("key")
        held, ids = np.append(table["key"].to_numpy(np.int64), 0), np.append(table["id"].to_numpy(np.int64), unknown)
        packed = []
        for keys in asked["keys"]:
            at = np.searchsorted(held[:-1], keys)
            number = np.where((held[at] == keys) & (at < len(table)), ids[at], unknown)
            packed.append(_packed([np.where(keys == int(END), 0, number)]))
        return pd.DataFrame({"group": asked["group"], "bucket": asked["bucket"], "ids": packed})

    return run


def _of(ids: np.ndarray, starts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Values of words by their numbers; each holds from a start to the next one."""
    return values[np.searchsorted(starts, ids, "right") - 1]


def _numbered(words):
    """Groups of texts with the words' numbers as tokens, and what a text's single words add up to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, c, log_p, log_base = words.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                values = lambda name: row.column(name).flatten().to_numpy(zero_copy_only=False)  # noqa: B023, E731
                number = np.concatenate([_unpacked(x.as_py(), 1)[0] for x in row.column("numbers").flatten()])
                flat = number[_unpacked(row.column("codes")[0].as_py(), 1)[0]]
                lengths = values("lengths")
                text = np.repeat(np.arange(len(lengths)), lengths)
                add = lambda v: pa.array([np.bincount(text, _of(flat, starts, v), len(lengths))], pa.list_(pa.float64()))  # noqa: B023, E731
                known = pa.array([np.bincount(text, _of(flat, starts, c) > 0, len(lengths)).astype(np.int64)], pa.list_(pa.int64()))
                ids = pa.array([_packed([flat])], pa.binary())
                kept = [row.column(x) for x in ("group", "doc_id", "train", "lengths")]
                yield pa.RecordBatch.from_arrays([*kept, known, add(log_base), add(log_p), ids], names=["group", "doc_id", "train", "lengths", "known", "base", "score", "ids"])

    return run


def _dealt(tail: np.ndarray, before: list[np.ndarray], spread_out) -> np.ndarray:
    """Hashes that tokens are dealt by: of the word before, with a part by the one before that (or their own) if it is frequent."""
    hot, parts = spread_out.value
    first, part = before[0].astype(np.uint64), np.zeros(len(tail), np.uint64)
    some = np.flatnonzero(np.isin(before[0], hot))
    further = before[1][some].astype(np.uint64) if len(before) > 1 else np.zeros(len(some), np.uint64)
    further = np.where(further > 0, further, ~tail[some].astype(np.uint64))
    part[some] = mix(further * _TAIL) % parts[np.searchsorted(hot, before[0][some])]
    return mix(first * _CONTEXT + part * _TAIL)


def _portions(tail: np.ndarray, before: list[np.ndarray], spread_out) -> Iterator[np.ndarray]:
    """Places of a bucket's tokens, some at a time; those dealt alike stay together."""
    n = np.uint64(max(1, len(tail) // PORTION))
    order, _, begins = _split((((_dealt(tail, before, spread_out) & np.uint64(2**32 - 1)) * n) >> _LOW).astype(np.int64))
    return (order[a:b] for a, b in zip(begins, begins[1:], strict=False))


def _sent(spread_out, vocabulary: int | None, unknown: int, order: int, buckets: int):
    """Every token of a group of texts with the ``order - 1`` words before it, packed by bucket.

    Words before are one more than their numbers, or 0 where the text has no
    more.  The last column is twice the text's place, plus 1 if it trains, as
    the difference to the token before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                lengths, train = (row.column(x).flatten().to_numpy(zero_copy_only=False) for x in ("lengths", "train"))
                flat = _unpacked(row.column("ids")[0].as_py(), 1)[0]
                if vocabulary is not None:
                    flat = np.where((flat > vocabulary) | (flat == unknown), np.uint32(vocabulary + 1), flat)
                place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                text = np.repeat(2 * np.arange(len(lengths)) + train, lengths)
                before = []
                for j in range(1, order):
                    h = np.zeros(len(flat), np.uint32)
                    h[j:] = flat[:-j] + 1
                    h[place < j] = 0
                    h[place == j - 1] = 1
                    before.append(h)
                to = _bucket(_dealt(flat, before, spread_out), buckets)
                order_by, met, begins = _split(to)
                columns = [x[order_by] for x in (flat, *before, text)]
                packed = []
                for a, b in zip(begins, begins[1:], strict=False):
                    *runs, texts = (x[a:b] for x in columns)
                    packed.append(_packed([*runs, np.diff(texts, prepend=0)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(met, pa.int32()), pa.array(np.full(len(met), row.column("group")[0].as_py()), pa.int64()), pa.array(packed, pa.binary())],
                    names=["bucket", "group", "tokens"],
                )

    return run


def _pairs(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << _LOW) | low.astype(np.uint64)


def _told_apart(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the different keys, for each key, and one place of each."""
    order = np.argsort(keys)
    new = np.diff(keys[order], prepend=keys[order[:1]] + np.uint64(1)) != 0
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def _levels(tail: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length from 2: tokens that end such a run, numbers of their contexts and runs, and one token of each run."""
    context = np.zeros(len(tail), np.int64)
    at = np.arange(len(tail))
    for k, h in enumerate(before, 2):
        some = h[at] > 0
        at = at[some]
        context, _ = _told_apart(_pairs(context[some], h[at]))
        runs, first = _told_apart(_pairs(context, tail[at]))
        yield k, at, context, runs, first


def _received(rows: pd.DataFrame, order: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """What ``_sent`` packed: the tokens, the words before them, texts, whether they train, and the message of each."""
    parts = [_unpacked(x, order + 1) for x in rows["tokens"]]
    text = np.concatenate([np.cumsum(x[-1], dtype=np.int32) for x in parts])
    message = np.repeat(np.arange(len(parts), dtype=np.int32), [x.shape[1] for x in parts])
    tail, *before = np.concatenate([x[:-1] for x in parts], axis=1)
    return tail, before, text >> 1, text & 1 > 0, message


def _met_counts(spread_out, words, order: int):
    """A bucket's numbers ``c`` of runs that were met ``r`` times, by length ``k``; as k = 0 its counts of pairs that other buckets have too."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        every_tail, every_before, _, every_train, _ = _received(rows, order)
        out = []
        for at in _portions(every_tail, every_before, spread_out):
            tail, before, train = every_tail[at], [h[at] for h in every_before], every_train[at]
            shared = np.isin(before[0], spread_out.value[0])
            pairs, places = np.unique(_pairs(before[0][shared], tail[shared]), return_inverse=True)
            w = (pairs & np.uint64(2**32 - 1)).astype(np.int64)
            c = np.bincount(places, train[shared], len(pairs)).astype(np.int64)
            out.append(pd.DataFrame({"k": 0, "r": 0, "v": (pairs >> _LOW).astype(np.int64), "w": w, "c": c, "p": _of(w, *words.value)}))
            keys = np.zeros(len(tail), np.uint64)
            for k, h in enumerate(before, 2):
                keys = mix(keys * _CONTEXT + h.astype(np.uint64))
                own = train & (h > 0) if k > 2 else train & ~shared
                met = np.sort(mix(keys[own] * _CONTEXT + tail[own].astype(np.uint64) * _TAIL))
                c = np.diff(np.append(np.flatnonzero(np.diff(met, prepend=~met[:1]) != 0), len(met)))
                r, n = np.unique(c[c <= K + 1], return_counts=True)
                out.append(pd.DataFrame({"k": k, "r": r, "v": 0, "w": 0, "c": n, "p": 0.0}))
        return pd.concat(out).groupby(["k", "r", "v", "w"], as_index=False).agg({"c": "sum", "p": "first"}).assign(bucket=rows["bucket"].iloc[0])

    return run


def _weighed(total: np.ndarray, kept: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What contexts' counts are divided by, and log10 of their weights.

    ``total`` and ``kept`` add up a context's counts, before and after
    discounts, and ``met`` the lower level's mass of what was met there.
    """
    whole, free = np.where(kept < total * (1 - 1e-9), total, total + 1.0), 1 - met
    some = free > 1e-12  # else every class was met: what is left goes back to them
    return np.where(some, whole, kept), np.where(some, np.log10((1 - kept / whole) / np.maximum(free, 1e-12)), -300.0)


def _added(tail: np.ndarray, before: list[np.ndarray], train: np.ndarray, shared_pairs: pd.DataFrame, hot_contexts, words, d: dict[int, np.ndarray]) -> np.ndarray:
    """What the words before add to each token's log10 P; all tokens with its word before, or with its part, have to be there."""
    hot, hot_whole, hot_weight = hot_contexts
    p = _of(tail, *words)
    alone = np.log10(p)
    log_p = alone.copy()
    for k, at, context, runs, first in _levels(tail, before):
        c, of = np.bincount(runs, train[at]), context[first]
        shared = np.zeros(len(first), bool)
        if k == 2:
            v, w = before[0][at[first]], tail[at[first]]
            shared = np.isin(v, hot)
            if shared.any():
                held = _pairs(shared_pairs["v"].to_numpy(), shared_pairs["w"].to_numpy())
                sort = np.argsort(held)
                c[shared] = shared_pairs["c"].to_numpy()[sort][np.searchsorted(held[sort], _pairs(v[shared], w[shared]))]
        cut = discounted(c, d[k])
        whole, weight = _weighed(*(np.bincount(of, x) for x in (c, cut, np.where(c > 0, p[at[first]], 0.0))))
        if shared.any():
            place = np.searchsorted(hot, v[shared])
            whole[of[shared]], weight[of[shared]] = hot_whole[place], hot_weight[place]
        met = c[runs] > 0
        own = np.where(met, cut[runs], 1.0) / whole[context]
        log_p[at] = np.where(met, np.log10(own), weight[context] + log_p[at])
        p[at] = np.where(met, own, 10.0 ** log_p[at])
    return log_p - alone


def _scored(spread_out, hot_contexts, words, d: dict[int, np.ndarray], order: int):
    """What a bucket's tokens add to their words' log10 P, by group and text."""

    def run(rows: pd.DataFrame, shared_pairs: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"group": [], "texts": [], "extra": []})
        tail, before, text, train, message = _received(rows, order)
        added = np.empty(len(tail))
        for at in _portions(tail, before, spread_out):
            added[at] = _added(tail[at], [h[at] for h in before], train[at], shared_pairs, hot_contexts.value, words.value, d)
        begins = np.flatnonzero((np.diff(message, prepend=-1) != 0) | (np.diff(text, prepend=-1) != 0))
        sums, texts = np.add.reduceat(added, begins), text[begins]
        cuts = np.flatnonzero(np.diff(message[begins])) + 1
        return pd.DataFrame({"group": rows["group"], "texts": np.split(texts, cuts), "extra": np.split(sums, cuts)})

    return run


def _summed(parts: pd.DataFrame) -> pd.DataFrame:
    """What the buckets say of one group of texts, added up by text."""
    texts, extra = (np.concatenate(parts[c].tolist()) for c in ("texts", "extra"))
    return pd.DataFrame({"group": parts["group"].iloc[:1], "extra": [np.bincount(texts, extra)]})


def katz_scores(
    docs: DataFrame, vocabulary: int | None = None, hot_share: float | None = None, buckets: int | None = None, order: int = 2
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs(doc_id, text, ...)``.

    ``order`` is the length of the longest runs.  With a ``vocabulary``, only so
    many words are classes of their own.  The tokens after a word with more than
    ``hot_share`` of all (a quarter of a bucket by itself) are dealt to several
    buckets.  Null and blank texts are the end token alone.  Rows that repeat
    train and are scored each.  Further columns are ignored.  An empty table
    gives an empty result; without training rows every probability is that of
    the unseen word, 1.
    """
    spark, id_type = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    send = spark.sparkContext.broadcast
    group = f"group long, doc_id array<{id_type}>, train array<boolean>, lengths array<int>"
    is_end = F.col("key") == int(END)
    with scratch(spark):
        coded = docs.select("doc_id", "text", training().alias("train")).mapInArrow(_coded, f"{group}, codes binary, keys array<long>, c array<long>")
        coded = staged(coded, "coded")
        asked = max(16, (coded.agg(F.sum(F.size("keys"))).first()[0] or 0) // BUCKET_TOKENS)
        asked = coded.select("group", "keys", "c").mapInArrow(_asked(asked), "bucket int, group long, keys array<long>, c array<long>")
        found = asked.groupBy("bucket").applyInPandas(_words_counted, "bucket int, key long, c long")
        found = found.orderBy(~is_end, F.desc("c"), "key").select("bucket", "key", "c", F.monotonically_increasing_id().alias("place"))
        found = staged(found, "words")
        spread = {(r["end"], r["c"]): r["n"] for r in found.groupBy(is_end.alias("end"), "c").agg(F.count("*").alias("n")).collect()}
        v, n = sum(spread.values()), sum(c * m for (_, c), m in spread.items())
        of_counts: dict[int, int] = {}
        for (_, c), m in spread.items():
            of_counts[c] = of_counts.get(c, 0) + m
        d1 = discounts(of_counts)
        # A step for the end token, one for each different count, one for words that do not train.
        unknown = max(v, 1)
        steps = [*sorted(spread, key=lambda x: (not x[0], -x[1])), (False, 0)] if n else [(True, 0), (False, 0)]
        starts = np.cumsum([0, *(spread.get(x, 1) for x in steps[:-1])])
        c = np.array([x[1] for x in steps], np.int64)
        cut = discounted(c, d1)
        kept = float((cut * np.diff(np.append(starts, unknown))).sum())
        scale = max(n if 0 < kept < n else n + 1, 1)  # some mass is left in any case
        p = np.where(c > 0, cut / scale, 1 - kept / scale if n else 1.0)
        numbers = send((starts, c, np.log10(p), np.log10((c + 0.1) / (n + 0.1 * (v + 1)))))

        part, sizes = F.shiftrightunsigned("place", 33), {}
        for r in found.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect():
            sizes[r["part"]] = r["n"]
        before = spark.createDataFrame([(i, sum(m for j, m in sizes.items() if j < i)) for i in sizes], "part long, before long")
        found = found.withColumn("part", part).join(F.broadcast(before), "part")
        found = found.select("bucket", "key", (F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1)).alias("id"))
        asked = asked.drop("c").groupBy("bucket").cogroup(found.groupBy("bucket"))
        asked = asked.applyInPandas(_words_numbered(unknown), "group long, bucket int, ids binary")
        asked = asked.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("bucket", "ids"))).alias("asked"))
        texts = coded.drop("keys", "c").join(asked.select("group", F.col("asked.ids").alias("numbers")), "group")
        texts = texts.mapInArrow(_numbered(numbers), f"{group}, known array<long>, base array<double>, score array<double>, ids binary")
        texts = staged(texts, "texts", stays=True)

    scores = texts.select("group", "doc_id", "lengths", "known", "base", "score")
    if order > 1:
        scores = scores.join(_extras(texts, starts, c, p, n, vocabulary, unknown, hot_share, buckets, order), "group", "left")
    else:
        scores = scores.withColumn("extra", F.lit(None).cast("array<double>"))
    scores = scores.withColumn("extra", F.coalesce("extra", F.array().cast("array<double>")))
    return scores.select(F.inline(F.arrays_zip("doc_id", "lengths", "known", "base", "score", "extra"))).select(
        "doc_id",
        (~training()).alias("held_out"),
        F.col("lengths").cast("long").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(int(n)).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"),
        (F.col("score") + F.coalesce("extra", F.lit(0.0))).alias("score"),
    )


def _extras(texts: DataFrame, starts, c, p, n: int, vocabulary: int | None, unknown: int, hot_share: float | None, buckets: int | None, order: int) -> DataFrame:
    """``group, extra``: what the words before change in each text's sum of its words' log10 P."""
    spark = texts.sparkSession
    send = spark.sparkContext.broadcast
    counts = np.diff(np.append(starts, unknown + 1))
    if vocabulary is not None:
        own = (starts <= vocabulary) & (c > 0)
        taken = np.minimum(counts[own], vocabulary + 1 - starts[own])
        rest = n - (c[own] * taken).sum(), 1 - (p[own] * taken).sum()
        starts, counts = np.append(starts[own], vocabulary + 1), np.append(taken, 1)
        c, p = np.append(c[own], rest[0]), np.append(p[own], rest[1])
    buckets = buckets or max(16, n // BUCKET_TOKENS)
    hot_share = hot_share or 1 / (4 * buckets)
    steps = np.flatnonzero(c > hot_share * n)
    hot = np.concatenate([np.empty(0, np.int64), *(np.arange(starts[i], starts[i] + counts[i]) for i in steps)]) + 1
    parts = np.ceil(np.repeat(c[steps], counts[steps]) / (hot_share * max(n, 1))).astype(np.uint64)
    words, spread_out = send((starts, p)), send((hot, parts))
    sent = texts.select("group", "train", "lengths", "ids").mapInArrow(
        _sent(spread_out, vocabulary, unknown, order, buckets), "bucket int, group long, tokens binary"
    )
    spread: dict[int, dict[int, int]] = {k: {} for k in range(2, order + 1)}
    contexts = send((hot, *np.zeros((2, len(hot)))))
    pair = "bucket int, v long, w long, c long"
    with scratch(spark):
        met = sent.groupBy("bucket").applyInPandas(_met_counts(spread_out, words, order), "k int, r long, v long, w long, c long, p double, bucket int")
        met = staged(met, "counts")
        of_runs = [met.filter("k > 0").groupBy("k", "r").agg(F.sum("c").alias("n"))]
        shared = spark.createDataFrame([], pair)
        if len(hot):
            own = met.filter("k = 0").select("bucket", "v", "w", "c", "p")
            totals = staged(own.groupBy("v", "w").agg(F.sum("c").alias("c"), F.first("p").alias("p")), "totals")
            of_runs.append(totals.filter(F.col("c").between(1, K + 1)).groupBy(F.lit(2).alias("k"), F.col("c").alias("r")).agg(F.count("*").alias("n")))
            shared = staged(own.select("bucket", "v", "w").join(totals, ["v", "w"]).select("bucket", "v", "w", "c"), "shared", stays=True)
        for some in of_runs:
            for r in some.collect():
                spread[r["k"]][r["r"]] = spread[r["k"]].get(r["r"], 0) + r["n"]
        d = {k: discounts(x) for k, x in spread.items()}
        if len(hot):
            sums = totals.filter("c > 0").groupBy("v").agg(*[F.sum(x).alias(y) for x, y in ((F.col("c"), "total"), (_discount_sql("c", d[2]), "kept"), (F.col("p"), "met"))])
            rows = sums.orderBy("v").collect()
            sums = (np.array([r[x] for r in rows], float) for x in ("total", "kept", "met"))
            contexts = send((np.array([r["v"] for r in rows], np.int64), *_weighed(*sums)))
    extras = sent.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInPandas(
        _scored(spread_out, contexts, words, d, order), "group long, texts array<int>, extra array<double>"
    )
    return extras.groupBy("group").applyInPandas(_summed, "group long, extra array<double>")


def _discount_sql(c: str, d: np.ndarray):
    out = F.col(c).cast("double")
    for r in range(1, len(d)):
        out = F.when(F.col(c) == r, float(r * d[r])).otherwise(out)
    return out
