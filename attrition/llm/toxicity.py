"""Toxicity by compression distance.

Two zstandard dictionaries are trained: one on ordinary text, one on toxic
text, the latter behind the ordinary one's content.  A window of text is
compressed with either; what it saves under the toxic one is its gain.  The
ordinary content is common to both, so plain prose gains nothing.

The toxic dictionary is trained on the spans of toxic texts that set them
apart: byte n-grams that occur after many different words in toxic texts and
hardly in ordinary ones.  Counting distinct contexts, not occurrences, keeps
copied passages from passing for toxic wording.

A document's gains (largest, mean, share of windows with a gain, ...) enter a
logistic curve that is calibrated on labelled documents neither dictionary has
seen, weighted to the labels' own class shares, so a score is a probability.

Training reads at most ``SAMPLE`` labelled texts a class, the first by a hash
of the doc_id, of at most ``SAMPLE_CHARS`` characters each, and trains the
ordinary dictionary on at most ``PIECES`` of their windows, drawn at random;
scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import plus

#: Labelled texts a class that training may read (toxic, ordinary), and their length.
SAMPLE, SAMPLE_CHARS = (2_000, 5_000), 20_000
#: Windows that the ordinary dictionary is trained on, at most.
PIECES = 60_000
THRESHOLD = 0.3
WINDOW, GRAM, CONTEXT = 192, 5, 12
ORDINARY_BYTES, TOXIC_BYTES = 65_536, 2_048
#: A toxic n-gram is this many times as frequent as in ordinary text, with this much evidence (twice a log likelihood).
ODDS, EVIDENCE = 20, 100
#: log2 of the parts in which contexts are counted.
DEAL = 4
_FACTORS = np.random.default_rng(7).integers(1, 2**63, 32, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def normalised(text: str | None) -> bytes:
    """Lower-cased text with single spaces, framed by spaces; blank or null: one space."""
    found = b" ".join((text or "").lower().encode("utf-8", "surrogatepass").split())
    return b" " + found + b" " if found else b" "


def windows(data: bytes, size: int = WINDOW) -> list[bytes]:
    """Pieces of at most ``size`` bytes that end before a space where there is one."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + size)
        if end < len(data) and (cut := data.rfind(b" ", at + 1, end)) > at:
            end = cut
        out.append(data[at:end])
        at = end
    return out


def _compressor(content: bytes) -> zstd.ZstdCompressor:
    params = zstd.ZstdCompressionParameters(
        window_log=18, chain_log=17, hash_log=17, search_log=4, min_match=4, target_length=16,
        strategy=zstd.STRATEGY_LAZY2, write_checksum=False, write_content_size=False, write_dict_id=False,
    )
    held = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstd.ZstdCompressor(compression_params=params, dict_data=held)


def _trained(size: int, samples: list[bytes], **how) -> bytes:
    """A zstandard dictionary; the last ``size`` bytes where there is too little to train on."""
    try:
        return zstd.train_dictionary(size, samples, **how).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-size:]


def _hashes(data: bytes, k: int) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    out = np.zeros(max(0, len(b) - k + 1), np.uint64)
    for i in range(k if len(out) else 0):
        out += b[i : len(out) + i] * _FACTORS[i]
    return out


def _held(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in ``ordered``."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.searchsorted(ordered, values).clip(0, len(ordered) - 1)] == values


def _contexts(texts: list[bytes], only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram (of ``only``), and after how many different contexts it stands."""
    # Dealt out by the n-gram's top bits, so that only a part is sorted at a time.
    parts: list[list[np.ndarray]] = [[np.empty((0, 2), np.uint64)] for _ in range(1 << DEAL)]
    held: list[np.ndarray] = []

    def deal() -> None:
        rows = np.concatenate(held)
        held.clear()
        own = rows[:, 0] >> np.uint64(64 - DEAL)
        for i, part in enumerate(parts):
            part.append(rows[own == i])

    for text in texts:
        padded = b" " * CONTEXT + text
        before = _hashes(padded, CONTEXT)
        after = _hashes(padded, GRAM)[CONTEXT:]
        before = before[: len(after)]
        if only is not None:
            met = _held(only, after)
            after, before = after[met], before[met]
        held.append(np.stack([after, after * np.uint64(0x9E3779B97F4A7C15) + before], axis=1))
        if sum(map(len, held)) >= 1 << 20:
            deal()
    if held:
        deal()
    grams, counts = [], []
    while parts:
        found = np.concatenate(parts.pop(0))
        _, first = np.unique(found[:, 1], return_index=True)
        for out, x in zip((grams, counts), np.unique(found[first, 0], return_counts=True), strict=True):
            out.append(x)
    return np.concatenate(grams), np.concatenate(counts)


def _toxic_grams(toxic: list[bytes], ordinary: list[bytes]) -> np.ndarray:
    """Hashes of the n-grams that set the toxic texts apart."""
    grams, counts = _contexts(toxic)
    grams, counts = grams[counts >= 4], counts[counts >= 4]
    others, other_counts = _contexts(ordinary, grams)
    met = np.zeros(len(grams))
    met[np.searchsorted(grams, others)] = other_counts
    odds = (counts / sum(map(len, toxic))) / ((met + 0.5) / max(1, sum(map(len, ordinary))))
    evidence = 2 * counts * np.log(np.maximum(odds, 1e-9))
    return grams[(odds >= ODDS) & (evidence >= EVIDENCE)]


def _toxic_dictionary(toxic: list[bytes], ordinary: list[bytes]) -> bytes:
    """The words of toxic texts that hold such n-grams, in the most different places; the most frequent last.

    A match's cost grows with its distance, so what is met most stands nearest.
    """
    chosen = _toxic_grams(toxic, ordinary)
    places: dict[bytes, set[bytes]] = {}
    for text in toxic:
        hit = np.flatnonzero(_held(chosen, _hashes(text, GRAM)))
        for at in dict.fromkeys(text.rfind(b" ", 0, int(h) + 2) for h in hit):
            end = text.find(b" ", at + 1)
            places.setdefault(text[at:end], set()).add(text[max(0, at - CONTEXT) : at])
    order = sorted(places, key=lambda w: (-len(places[w]), w))
    content, size = [], 0
    for word in order:
        if size + len(word) <= TOXIC_BYTES:
            content.append(word)
            size += len(word)
    return b"".join(reversed(content))


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    centre: np.ndarray | None
    spread: np.ndarray | None
    weights: np.ndarray | None
    prior: float

    def scorer(self):
        """A function from texts to scores; a model without both classes gives its prior."""
        if self.weights is None:
            return lambda texts: np.full(len(texts), self.prior)
        plain, toxic = _compressor(self.ordinary), _compressor(self.toxic + self.ordinary)
        return lambda texts: _logistic(self._terms(_features(texts, plain, toxic)) @ self.weights)

    def _terms(self, features: np.ndarray) -> np.ndarray:
        x = np.clip((features - self.centre) / self.spread, -8, 8)
        return np.concatenate([x, x**2, np.ones((len(x), 1))], axis=1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _features(texts: list[str | None], plain, toxic) -> np.ndarray:
    out = []
    for text in texts:
        data, gains = normalised(text), []
        pieces = windows(data)
        for at in range(0, len(pieces), 4096):
            some = pieces[at : at + 4096]
            a, b = plain.multi_compress_to_buffer(some), toxic.multi_compress_to_buffer(some)
            gains += [len(a[i]) - len(b[i]) for i in range(len(some))]
        g = np.sort(np.array(gains, float))[::-1]
        some = (g >= 3).sum()
        out.append((g[0], g[:3].mean(), g.mean(), np.log1p(some), some / len(g), np.log1p(len(data))))
    return np.array(out, float).reshape(-1, 6)


def fit(labelled: list[tuple[str | None, int]], share: float) -> Model:
    """The model of ``(text, 0 or 1)`` pairs; ``share`` is the share of label 1 among all labelled rows.

    Every third pair of a class calibrates, the others train the dictionaries.
    """
    texts = {y: [t for t, label in labelled if label == y] for y in (0, 1)}
    if len(texts[0]) < 6 or len(texts[1]) < 6:
        return Model(b"", b"", None, None, None, share)
    learn = {y: [normalised(t) for i, t in enumerate(x) if i % 3] for y, x in texts.items()}
    kept = {y: [t for i, t in enumerate(x) if not i % 3] for y, x in texts.items()}
    pieces = [w for t in learn[0] for w in windows(t)]
    np.random.default_rng(0).shuffle(pieces)
    ordinary = _trained(ORDINARY_BYTES, pieces[:PIECES])
    model = Model(ordinary, _toxic_dictionary(learn[1], learn[0]), None, None, None, share)
    x = _features(kept[0] + kept[1], _compressor(model.ordinary), _compressor(model.toxic + model.ordinary))
    y = np.repeat([0.0, 1.0], [len(kept[0]), len(kept[1])])
    model.centre, model.spread = x.mean(0), x.std(0) + 1e-6
    g = model._terms(x)
    per = np.where(y == 1, share / len(kept[1]), (1 - share) / len(kept[0])) * len(y)
    w = np.zeros(g.shape[1])
    for _ in range(60):
        p = _logistic(g @ w)
        curve = (g.T * (per * p * (1 - p))) @ g + np.eye(len(w))
        w += np.linalg.solve(curve, g.T @ (per * (y - p)) - w)
    model.weights = w
    return model


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never read; a null doc_id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on ``labels(doc_id, toxic)`` of ``docs(doc_id, text)`` that are not held out.

    Null labels are ignored; of several labels of a document the largest counts.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("_y"))
    known = known.filter(~held_out()).select("doc_id", "_y", F.xxhash64("doc_id").alias("_order"))
    count = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    chosen = [known.filter(F.col("_y") == y).orderBy("_order", "doc_id").limit(SAMPLE[1 - y]) for y in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most the two bounds' rows
    texts = docs.select("doc_id", "text").filter(F.length("text") <= SAMPLE_CHARS).join(ids, "doc_id")
    texts = texts.dropDuplicates(["doc_id"]).select("text", "_y", "_order", "doc_id")
    rows = sorted(texts.collect(), key=lambda r: (r["_order"], r["doc_id"]))
    share = (count.get(1, 0) + 0.5) / (sum(count.values()) + 1)
    return fit([(r["text"], r["_y"]) for r in rows], share)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column ``_score`` (0 to 1) from each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            found = pa.array(score(batch.column("text").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "_score"])

    return docs.mapInArrow(run, plus(docs.schema, _score="double"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text, ...)``.

    ``predicted`` is 1 from a score of ``THRESHOLD``.  Null and blank texts are
    scored as a text without gains.  With under six labelled texts of a class
    every score is the share of label 1.  Further columns are ignored, rows
    that repeat are scored alike, and an empty table gives an empty result.
    """
    rows = scored(docs.select("doc_id", "text"), train(docs, labels))
    return rows.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    return scored(docs, model).filter(F.col("_score") < THRESHOLD).drop("_score")
