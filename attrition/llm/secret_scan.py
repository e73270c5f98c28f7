"""Secret scan: rules, and a character convolutional network over further candidates.

Rules find assignments, access keys and long hex strings.  Every other run of
16 or more key characters that holds letters and digits is a candidate, and the
network reads it with the text around it.  The network (numpy) has one
convolution over one-hot characters, a maximum over places and a logistic
output.  It is trained on labelled findings: candidates that a rule found
(secrets) and candidates that none did; each is read twice, once with the context
blanked, so that it does not only learn the rules' key words.

All different findings of the corpus are used: those with a hash divisible by
``HELD`` set thresholds, all others train.  Training goes in rounds over parts of
the findings, by a hash: a task runs through a part in batches, and the parts'
networks are averaged before the next round.  One part has ``PART`` findings at
least, so few findings are one part; more than ``PARTS`` parts are not made, parts
then grow (a task holds one batch of them at a time).

Thresholds are set on the findings that training has not seen, one for each shape of
candidate: the highest that keeps ``RECALL`` of the secrets as they stand, and
as much of them with the context blanked.  They are exact: all held-out scores are
sorted.  What that costs is measured and reported, on all held-out candidates
without a rule: the share of those that pass.  (Secrets without a key word are
among them, so that share is an upper bound of the false ones.)
"""

from __future__ import annotations

import hashlib
import logging
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attrition.llm.common import plus, staged

_LOG = logging.getLogger(__name__)

# The rules' patterns and least lengths, in the order of their kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs of [0-9a-f]+ that are long enough
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "cnn")

SHAPES = ("hex", "upper", "mixed")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
#: One finding in so many sets thresholds; findings a part of a round, at least, and parts, at most.
HELD, PART, PARTS = 3, 4_096, 64
#: Findings a training step.
BATCH = 64
RECALL = 0.95
BEFORE, INSIDE, AFTER = 24, 48, 8
FILTERS, REACH, ROUNDS = 24, 5, 12
_CLASSES = 68
_CODES = np.full(128, 67, np.uint8)
for _i, _c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789=:\"' "):
    _CODES[ord(_c)] = _i + 1 if _i < 66 else 66


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the rules' findings, in order."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of key characters with a letter and a digit."""
    return [
        m.span()
        for m in CANDIDATE.finditer(text)
        if any("0" <= c <= "9" for c in m[0]) and any(c.isalpha() for c in m[0])
    ]


def shape(candidate: str) -> str:
    if re.fullmatch("[0-9a-f]+", candidate):
        return "hex"
    return "upper" if re.fullmatch("[A-Z0-9]+", candidate) else "mixed"


def view(text: str, start: int, end: int) -> str:
    """What the network reads: the context before, the candidate (its ends, when long) and the context after."""
    inside = text[start:end]
    if len(inside) > INSIDE:
        inside = inside[: INSIDE // 2] + inside[-(INSIDE // 2) :]
    return text[max(0, start - BEFORE) : start].rjust(BEFORE) + inside.ljust(INSIDE) + text[end : end + AFTER].ljust(AFTER)


def _coded(views: list[str]) -> np.ndarray:
    size = BEFORE + INSIDE + AFTER
    out = np.zeros((len(views), size), np.uint8)
    for i, v in enumerate(views):
        points = np.frombuffer(v.encode("utf-32-le", "surrogatepass"), "<u4")
        out[i] = np.where(points < 128, _CODES[np.minimum(points, 127)], 67)
    return out


@dataclass
class Network:
    kernel: np.ndarray  # place in the filter x character class x filter
    bias: np.ndarray
    weights: np.ndarray
    offset: float
    thresholds: dict[str, float] = field(default_factory=dict)
    #: By shape: the share of held-out secrets that pass (the lesser, with or without context), and of held-out others with their number.
    recalls: dict[str, float] = field(default_factory=dict)
    false_rates: dict[str, tuple[float, int]] = field(default_factory=dict)

    def _forward(self, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        places = coded.shape[1] - REACH + 1
        # A one-hot input makes the convolution a sum of kernel rows.
        maps = sum(self.kernel[j][coded[:, j : j + places]] for j in range(REACH)) + self.bias
        best = maps.argmax(1)
        top = np.maximum(np.take_along_axis(maps, best[:, None, :], 1)[:, 0], 0)
        return 1 / (1 + np.exp(-np.clip(top @ self.weights + self.offset, -30, 30))), top, best

    def _scores(self, coded: np.ndarray) -> np.ndarray:
        return np.concatenate([np.empty(0), *(self._forward(coded[i : i + 512])[0] for i in range(0, len(coded), 512))])

    def score(self, views: list[str]) -> np.ndarray:
        return self._scores(_coded(views))

    def set_thresholds(self, held: list[tuple[str, str, int]], others: list[tuple[str, str]] = ()) -> None:
        """Thresholds by the recall on ``held`` findings, and the rates they come with."""
        secrets = [(v, s) for v, s, y in held if y == 1]
        others = [(v, s) for v, s, y in held if y == 0] + list(others)
        coded = _coded([v for v, _ in secrets])
        scores = np.stack([self._scores(coded), self._scores(_blanked(coded))])
        shapes = np.array([s for _, s in secrets])
        wrong, wrong_shapes = self.score([v for v, _ in others]), np.array([s for _, s in others])
        for name in SHAPES:
            mine = shapes == name if (shapes == name).sum() >= 10 else np.ones(len(shapes), bool)
            passes = np.quantile(scores[:, mine], 1 - RECALL, axis=1, method="lower").min() if mine.any() else 1.0
            self.thresholds[name] = float(passes)
            self.recalls[name] = float((scores[:, mine] >= passes).mean(1).min()) if mine.any() else 0.0
            false = wrong[wrong_shapes == name] >= passes
            self.false_rates[name] = (float(false.mean()) if len(false) else 0.0, len(false))


def _blanked(coded: np.ndarray) -> np.ndarray:
    """The same candidates without context."""
    blank = coded.copy()
    blank[:, :BEFORE] = 66
    blank[:, BEFORE + INSIDE :] = 66
    return blank


@dataclass
class Descent:
    """A network on its way, and Adam's two running means of its gradients."""

    net: Network
    first: list[np.ndarray]
    second: list[np.ndarray]
    steps: int = 0

    @classmethod
    def start(cls) -> Descent:
        chance = np.random.default_rng(0)
        net = Network(chance.normal(0, 0.3, (REACH, _CLASSES, FILTERS)), np.zeros(FILTERS), chance.normal(0, 0.3, FILTERS), 0.0)
        zeros = lambda: [np.zeros_like(p) for p in (net.kernel, net.bias, net.weights, np.zeros(1))]
        return cls(net, zeros(), zeros())

    def step(self, coded: np.ndarray, labels: np.ndarray, share: float) -> None:
        """One step on findings with and without their context; ``share`` is that of the secrets among all findings."""
        net, x, y = self.net, np.concatenate([coded, _blanked(coded)]), np.tile(labels, 2)
        p, top, best = net._forward(x)
        error = (p - y) * np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(y)
        back = np.where(top > 0, error[:, None] * net.weights[None, :], 0)
        kernel = np.zeros_like(net.kernel)
        filters = np.broadcast_to(np.arange(FILTERS), best.shape)
        for j in range(REACH):
            np.add.at(kernel[j], (np.take_along_axis(x, best + j, 1), filters), back)
        self.steps += 1
        params = [net.kernel, net.bias, net.weights, np.array([net.offset])]
        for i, g in enumerate((kernel, back.sum(0), top.T @ error, np.array([error.sum()]))):
            self.first[i] = 0.9 * self.first[i] + 0.1 * g
            self.second[i] = 0.999 * self.second[i] + 0.001 * g * g
            params[i] = params[i] - 0.01 * (self.first[i] / (1 - 0.9**self.steps)) / (np.sqrt(self.second[i] / (1 - 0.999**self.steps)) + 1e-8)
        net.kernel, net.bias, net.weights, net.offset = *params[:3], float(params[3][0])

    def packed(self) -> np.ndarray:
        net = self.net
        return np.concatenate([x.ravel() for x in (net.kernel, net.bias, net.weights, np.array([net.offset]), *self.first, *self.second)])

    @classmethod
    def unpacked(cls, values: np.ndarray, steps: int) -> Descent:
        out = cls.start()
        shapes = [x.shape for x in out.first] * 3
        parts = np.split(values, np.cumsum([int(np.prod(x)) for x in shapes])[:-1])
        parts = [p.reshape(x) for p, x in zip(parts, shapes, strict=True)]
        return cls(Network(*parts[:3], float(parts[3][0])), parts[4:8], parts[8:], steps)


def fit(findings: list[tuple[str, str, int]], others: list[tuple[str, str]] = ()) -> Network | None:
    """What ``train`` does, for ``(view, shape, 0 or 1)`` findings at hand; None without ten of both classes.

    Every third finding sets thresholds, the others train.  The false rates are
    measured on the third's candidates without a rule and on the ``others``.
    """
    labels = np.array([y for _, _, y in findings], float)
    if min((labels == 1).sum(), (labels == 0).sum()) < 10:
        return None
    chance = np.random.default_rng(0)
    order = chance.permutation(len(findings))
    kept, learn = order[::HELD], np.setdiff1d(order, order[::HELD])
    coded, y = _coded([findings[i][0] for i in learn]), labels[learn]
    if not 0 < y.mean() < 1:
        return None
    descent = Descent.start()
    for _ in range(ROUNDS):
        for part in np.array_split(chance.permutation(len(y)), -(-len(y) // BATCH)):
            descent.step(coded[part], y[part], y.mean())
    descent.net.set_thresholds([findings[i] for i in kept], others)
    return descent.net


def _findings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for text in batch.column("text").to_pylist():
            found = candidates(text or "")
            if found:
                spans = rule_spans(text)
                for a, b in found:
                    hit = any(s < b and a < e for s, _, e in spans)
                    rows.append((view(text, a, b), shape(text[a:b]), int(hit)))
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        kinds = (pa.string(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=["view", "shape", "secret"]
        )


def _round(values: np.ndarray, steps: int, share: float):
    """Steps through rows in order of ``part``, each part's from the same network; a row a part comes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, descent, views, labels, rows = None, None, [], [], 0

        def learn() -> None:
            nonlocal views, labels
            if views:
                descent.step(_coded(views), np.array(labels, float), share)
                views, labels = [], []

        def done() -> pa.RecordBatch:
            columns = [pa.array([part], pa.int32()), pa.array([rows]), pa.array([descent.steps]), pa.array([descent.packed()], pa.list_(pa.float64()))]
            return pa.RecordBatch.from_arrays(columns, names=["part", "rows", "steps", "values"])

        for batch in batches:
            for of, view, y in zip(*(batch.column(c).to_pylist() for c in ("part", "view", "secret")), strict=True):
                if of != part:
                    if part is not None:
                        learn()
                        yield done()
                    part, descent, rows = of, Descent.unpacked(values, steps), 0
                views.append(view)
                labels.append(y)
                rows += 1
                if len(views) == BATCH:
                    learn()
        if part is not None:
            learn()
            yield done()

    return run


def _scored(net: Network):
    """``shape, secret`` of each finding, and its score ``plain`` and with the context blanked (``bare``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = _coded(batch.column("view").to_pylist())
            scores = [pa.array(net._scores(x)) for x in (coded, _blanked(coded))]
            yield pa.RecordBatch.from_arrays([batch.column("shape"), batch.column("secret"), *scores], names=["shape", "secret", "plain", "bare"])

    return run


def _set_thresholds(net: Network, held: DataFrame) -> None:
    """``Network.set_thresholds`` from all rows of ``held(view, shape, secret)``."""
    scores = staged(held.select("view", "shape", "secret").mapInArrow(_scored(net), "shape string, secret int, plain double, bare double"), "scores")
    secrets = scores.filter("secret = 1")
    sizes = {r["shape"]: r["count"] for r in secrets.groupBy("shape").count().collect()}
    total = sum(sizes.values())
    group = {name: name if sizes.get(name, 0) >= 10 else "" for name in SHAPES}  # few of a shape: all of them
    wanted, first = {}, 0
    for of in sorted(set(group.values())):
        for kind in ("bare", "plain"):
            rows = sizes[of] if of else total
            if rows:
                wanted[first + int((rows - 1) * (1 - RECALL))] = of
            first += rows
    each = F.array(*[F.struct(F.lit(of).alias("of"), F.lit(k).alias("kind"), F.col(k).alias("score")) for of in ("", "own") for k in ("bare", "plain")])
    listed = secrets.select("shape", F.explode(each).alias("x")).select(F.when(F.col("x.of") == "own", F.col("shape")).otherwise("").alias("of"), "x.kind", "x.score")
    ranked = listed.filter(F.col("of").isin(*set(group.values()))).orderBy("of", "kind", "score").rdd.zipWithIndex()
    at = {}
    for row, _ in ranked.filter(lambda r: r[1] in wanted).collect():  # two of a group
        at[row["of"]] = min(row["score"], at.get(row["of"], 1.0))
    net.thresholds = {name: float(at.get(of, 1.0)) for name, of in group.items()}
    counts = []
    for name, of in group.items():
        mine, passes = (F.col("secret") == 1) & (F.col("shape") == of if of else F.lit(True)), net.thresholds[name]
        other = (F.col("secret") == 0) & (F.col("shape") == name)
        for i, test in enumerate((mine & (F.col("plain") >= passes), mine & (F.col("bare") >= passes), mine, other & (F.col("plain") >= passes), other)):
            counts.append(F.count_if(test).alias(f"{name}{i}"))
    row = scores.agg(*counts).first()
    for name in SHAPES:
        plain, bare, mine, false, other = (row[f"{name}{i}"] for i in range(5))
        net.recalls[name] = min(plain, bare) / mine if mine else 0.0
        net.false_rates[name] = (false / other if other else 0.0, other)


def train(docs: DataFrame) -> Network | None:
    """The network of all different findings in ``docs``; None without ten of both classes.

    Recall and false rates on the held-out ones are logged.
    """
    found = docs.select("text").mapInArrow(_findings, "view string, shape string, secret int").distinct()
    found = staged(found.withColumn("held", F.pmod(F.xxhash64("view"), F.lit(HELD)) == 0), "findings")  # read in every round
    number = {(r["secret"], r["held"]): r["count"] for r in found.groupBy("secret", "held").count().collect()}
    plain, secret = (number.get((y, False), 0) for y in (0, 1))
    if min(plain + number.get((0, True), 0), secret + number.get((1, True), 0)) < 10 or not plain or not secret:
        return None
    share, parts = secret / (plain + secret), min(PARTS, max(1, (plain + secret) // PART))
    learn = found.filter(~F.col("held")).select("view", "secret", F.pmod(F.xxhash64(F.lit(1), "view"), F.lit(parts)).cast("int").alias("part"))
    descent = Descent.start()
    for i in range(ROUNDS):
        dealt = learn.repartition(parts, "part").sortWithinPartitions("part", F.xxhash64(F.lit(2 + i), "view"), "view", "secret")
        done = dealt.mapInArrow(_round(descent.packed(), descent.steps, share), "part int, rows long, steps long, values array<double>")
        ends = sorted(done.collect(), key=lambda r: r["part"])  # PARTS networks at most
        values = np.average([r["values"] for r in ends], axis=0, weights=[r["rows"] for r in ends])
        descent = Descent.unpacked(values, max(r["steps"] for r in ends))
    net = descent.net
    _set_thresholds(net, found.filter("held"))
    _LOG.info("secret scan: thresholds %s, recall %s, false rate and its number %s", net.thresholds, net.recalls, net.false_rates)
    return net


def added_spans(text: str, spans: list[tuple[int, int, int]], net: Network | None) -> list[tuple[int, int, int]]:
    """Candidates apart from the rules' spans that the network takes for secrets."""
    if net is None:
        return []
    free = [(a, b) for a, b in candidates(text) if not any(s < b and a < e for s, _, e in spans)]
    scores = net.score([view(text, a, b) for a, b in free])
    return [(a, 3, b) for (a, b), p in zip(free, scores, strict=True) if p >= net.thresholds[shape(text[a:b])]]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row of ``docs(doc_id, text, ...)``.

    Spans are in code points, end exclusive, by start, then kind.  A null text
    is empty and has none.  Rows that repeat are scanned each; further columns
    are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for text in batch.column("text").to_pylist():
                base = rule_spans(text or "")
                for kind in range(3):
                    out[kind].append(sum(k == kind for _, k, _ in base))
                out[3].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                out[4].append(_joined(sorted(base + added_spans(text or "", base, net))))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    docs = docs.select("doc_id", "text")
    schema = plus(docs.select("doc_id").schema, n_assign="long", n_access="long", n_hex="long", base_sha256="string", spans="string")
    return docs.mapInArrow(run, schema)
