"""Period runs, vector codes and chat formatting against plain versions on small inputs."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from llm_data import documents, odd_rows, prose

from attrition.llm import chat_format, period_runs, queries, vector_codes

# period runs


def plain_runs(w, shortest=12):
    """Every period at every place."""
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(shortest, 2 * q) and not any(q % p == 0 and w[i : j + q - p] == w[i + p : j + q] for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_collapsed(w):
    gone = {i for s, n, q in plain_runs(w) for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic(chance, n):
    kind = chance.randrange(5)
    if kind == 0:
        return [chance.choice("ab") for _ in range(n)]
    if kind == 1:
        return ["a"] * n
    if kind == 2:  # Thue-Morse: its fingerprints modulo a power of two collide
        w = ["a"]
        while len(w) < n:
            w += ["b" if x == "a" else "a" for x in w]
        return w[:n]
    w: list[str] = []
    while len(w) < n:
        block = [chance.choice("abc") + ("" if kind == 3 else str(chance.randrange(9))) for _ in range(chance.randrange(1, 25))]
        w += (block * chance.randrange(1, 9))[: chance.randrange(1, 80)]
    return w[:n]


@pytest.mark.parametrize("tile", [32, 64, 8192])
def test_solved_tiles_hold_every_run(tile):
    """Each run is the union of its fragments, which overlap by a period; nothing else is found."""
    chance = random.Random(tile)
    for _ in range(150):
        w = periodic(chance, chance.randrange(0, 170))
        ids = period_runs._ids([x.encode() for x in w])
        found = {(f + s, f + e, q) for f, n, low, high in period_runs.tiles_of(len(w), tile) for s, e, q in period_runs.solve(ids[f : f + n], low, high)}
        want = plain_runs(w)
        covered = {run: set() for run in want}
        for s, e, q in found:
            (own,) = [r for r in want if r[2] == q and r[0] <= s and e <= r[0] + r[1]]
            covered[own].update(range(s, e))
        assert all(len(covered[r]) == r[1] for r in want)


def test_tiles_hold_every_window_of_two_periods():
    for n in [0, 1, 11, 12, 40, 100, 1000, 5000]:
        found = list(period_runs.tiles_of(n, 64))
        for q in range(1, n // 2 + 1):
            k = q.bit_length() - 1
            own = [(f, f + length) for f, length, low, high in found if low <= k <= high]
            assert all(f % (1 << k) == 0 for f, _ in own)
            size = max(2 * q, 12)
            for at in {0, n // 3, n // 2, n - size}:
                assert at < 0 or at + size > n or any(f <= at and at + size <= e for f, e in own)


def test_long_periods_are_found():
    block = prose(1, 3000).split()
    w = prose(2, 777).split() + block * 3 + prose(3, 500).split()
    ids = period_runs._ids([x.encode() for x in w])
    found = [period_runs.solve(ids[f : f + n], low, high) for f, n, low, high in period_runs.tiles_of(len(w))]
    assert (777, 9777, 3000) in [x for part in found for x in part] and period_runs.solve(ids[:11], 0, 2) == []


@pytest.mark.parametrize("tile", [32, 8192])
def test_collapsed_documents(spark, tile):
    """Small tiles send documents of a few dozen words through the shuffle."""
    chance = random.Random(7)
    texts = [" \t".join(periodic(chance, chance.randrange(0, 300))) for _ in range(60)] + [" ".join(["é"] * 4000), "Ab ab " * 40]
    docs = documents(spark, texts, odd_rows(1000)).withColumnRenamed("n", "runs").withColumnRenamed("key", "period")
    out = period_runs.collapsed(docs, tile=tile).collect()
    assert len(out) == docs.count()
    got = sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in out)
    want = []
    for d in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        # a long text of random words has no run; the plain version takes too long there
        runs = plain_runs(w) if len(w) < 10_000 else []
        want.append((str(d.doc_id), len(w), runs, plain_collapsed(w) if len(w) < 10_000 else " ".join(w)))
    assert got == sorted(want) and sum(bool(x[2]) for x in want) > 20
    assert period_runs.collapsed(docs.limit(0)).count() == 0


def test_planted_periods():
    w = [b"w%d" % i for i in range(100)]
    text = b" ".join(w).decode()
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    assert 5 < len(ids) < 50
    for i in ids:
        g = zlib.crc32(str(i).encode()) // 10
        a = g % 100
        p = 1 + (100 - a) // (3 + g % 8)
        assert queries.with_planted_period(i, text) == [w[j] if j < a else w[a + (j - a) % p] for j in range(100)]
        assert queries.with_planted_period(i, None) == queries.with_planted_period(i, " ") == []
    assert queries.with_planted_period(None, text) == w
    assert queries.with_planted_period(next(i for i in range(99) if i not in ids), text) == w


# vector codes


def plain_nearest(x, entries):
    far = ((x[:, None, :] - entries[None, :, :]) ** 2).sum(2)
    return far.argmin(1), far.min(1)


@pytest.mark.parametrize(("n", "width", "spread"), [(1, 4, 5), (2, 1, 3), (64, 4, 3), (64, 4, 300), (64, 16, 40), (200, 2, 9)])
def test_orchard_search_is_exact(n, width, spread):
    """Small spreads give many ties and repeated entries."""
    chance = np.random.default_rng(n * width + spread)
    entries = chance.integers(-spread, spread, (n, width))
    x = chance.integers(-2 * spread, 2 * spread, (3000, width))
    at, far = vector_codes.Codebook(entries).nearest(x)
    want, least = plain_nearest(x, entries)
    assert (at == want).all() and (far == least).all()


def plain_codes(vectors, parts, entries, rounds):
    ids = sorted(vectors)
    x = np.array([[int(np.floor(256 * c)) for c in vectors[i]] for i in ids])
    width = x.shape[1] // parts
    cut = x.reshape(len(x), parts, width)
    books = [cut[:entries, p].copy() for p in range(parts)]
    for at in range(rounds + 1):
        codes, errors = [], np.zeros(len(x), int)
        for p in range(parts):
            code, far = plain_nearest(cut[:, p], books[p])
            codes.append(code)
            errors += far
            for e in range(len(books[p])):
                if at < rounds and (code == e).any():
                    books[p][e] = cut[code == e, p].sum(0) // (code == e).sum()
    text = ["".join(f"{codes[p][r]:02x}" for p in range(parts)) for r in range(len(x))]
    return {i: (t, int(e)) for i, t, e in zip(ids, text, errors, strict=True)}, books


def test_codes_equal_plain_ones(spark):
    chance = np.random.default_rng(3)
    centres = chance.normal(0, 1, (9, 32))
    vectors = {int(i): [float(np.float32(c)) for c in centres[i % 9] + chance.normal(0, 0.2, 32)] for i in chance.permutation(150)}
    bad = [(900, None), (901, [None] * 32), (902, [float("nan")] * 32), (903, [float("inf")] + [0.0] * 31)]
    rows = [(i, v, "a") for i, v in vectors.items()] + [(-i, v, "b") for i, v in bad]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, code string").repartition(5)
    books = vector_codes.train(df, parts=8, entries=16)
    want, entries = plain_codes(vectors, 8, 16, 2)
    assert (books.entries == np.array(entries)).all()
    coded = vector_codes.encode(df, books)
    assert {r.vec_id: (r.code, r.error) for r in coded.collect()} == want and coded.columns == ["vec_id", "embedding", "code", "error"]
    codes, errors = books.encode(np.array([[int(np.floor(256 * c)) for c in v] for v in vectors.values()]))
    again = books.decode(codes)
    assert (((again - np.array([[int(np.floor(256 * c)) for c in v] for v in vectors.values()])) ** 2).sum(1) == errors).all()


def test_odd_vectors(spark):
    """Shorter vectors have zeros behind, repeated and null ids stay, huge components are held, few vectors make few entries."""
    rows = [(1, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.0]), (None, [1.0]), (2, []), (3, [1e300, -1e300, 1.0]), (4, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    books = vector_codes.train(df, parts=2, entries=64)
    assert books.entries.shape == (2, 5, 2)
    out = vector_codes.encode(df, books).collect()
    assert sorted(str(r.vec_id) for r in out) == ["1", "1", "2", "3", "None"] and all(r.error == 0 for r in out)
    assert vector_codes.train(df.limit(0)) is None and vector_codes.encode(df, None).count() == 0
    assert vector_codes.train(df.filter("vec_id = 2")).entries.shape == (16, 1, 1)


# chat formatting


def random_text(chance):
    return "".join(chance.choice(["a", "é", "\U0001f600", "\n", " ", "\\", "<", "[", "</s>", "[INST] ", "[/INST]", "[ROLE] ", "<s>"]) for _ in range(chance.randrange(12)))


def test_texts_cannot_hold_marks():
    chance, template = random.Random(1), chat_format.TEMPLATE
    marks = [p for f in (*template.forms.values(), template.other) for p in f.parts if isinstance(p, str)]
    for _ in range(3000):
        text, after = random_text(chance), random_text(chance)
        safe = template.escaped(text)
        assert template.unescaped(safe) == text and not any(m in safe for m in [*marks, template.opening])
        role = chance.choice(["system", "user", "assistant", "tool", "", "[INST] "])
        formatted = "".join(t for t, _ in template.turn(role, text))
        assert template.read(formatted + "".join(t for t, _ in template.turn("user", after)), 0) == (role, text, len(formatted))
        assert template.read(formatted[:-1], 0) is None


@pytest.mark.parametrize("parts", [("say", 0), (0, "<x>"), ("<x>", 0, 1, "<y>"), ("<x", 0, "a<y>"), ("<x\\>", 0, "<y>")])
def test_templates_are_checked(parts):
    with pytest.raises(ValueError):
        chat_format.Template({"user": chat_format.Form(parts)}, chat_format.TEMPLATE.other, {}, ())


def test_conversations_read_back(spark):
    chance = random.Random(2)
    rows = []
    for conv in range(60):
        roles = chance.choice([["user", "assistant"] * 3, ["system", "user", "assistant"], ["assistant", "user"], ["user", "user", "assistant"], ["tool", None], ["user"]])
        rows += [(conv, turn * 2, role, random_text(chance), 1) for turn, role in enumerate(roles)]
    rows += [(70, 0, "user", None, 1), (70, 1, "assistant", None, 1), (70, 1, "assistant", None, 1), (71, None, None, None, 1), (None, 1, "user", "x", 1)]
    rows += [(72, t, ("user", "assistant")[t % 2], prose(t, 30), 1) for t in range(600)] + [(73, 0, "user", "[" * 300_000, 1), (73, 1, "assistant", "\\" * 300_000, 1)]
    chance.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place int")
    parts = chat_format.segments(df)
    got = {r.conv_id: r for r in chat_format.read_back(parts).collect()}
    by: dict = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    assert set(got) == set(by)
    for conv, own in by.items():
        own.sort(key=lambda r: [(x is not None, x if x is not None else "") for x in r[1:4]])
        said = [(r[2] or "", r[3] or "") for r in own]
        learned = "".join(t for role, t in said if role == "assistant")
        names = "".join({"user": "u", "assistant": "a", "system": "s"}.get(role, "?") for role, _ in said)
        r = got[conv]
        assert r.n_turns == len(said) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r.valid == bool(re.fullmatch("s?(ua)+", names)) and r.formatted_chars > sum(len(t) for _, t in said)
    stored = spark.createDataFrame(parts.collect(), parts.schema).repartition(7)
    again = {r.conv_id: r for r in chat_format.read_back(stored, ordered=False).collect()}
    assert again == got
    flags = {(r.conv_id, r.place): r.accepted for r in parts.collect()}
    assert flags[72, 0] and flags[72, 599] and not flags[70, 2] and not flags[71, 0]
    assert chat_format.read_back(chat_format.segments(df.limit(0))).count() == 0
