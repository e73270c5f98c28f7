"""URL rules, Jaccard join, embeddings, components and the pipeline on small inputs."""

from __future__ import annotations

import os
import random
import threading
import time
from collections import Counter
from contextlib import suppress
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from llm_data import documents, odd_rows, prose
from pyspark.sql import functions as F
from test_llm_text import ascii_words

import corpus_pipeline
from attrition.llm import cap_filters, components, part_enum, queries, url_filter
from attrition.llm.common import shingle_hashes, staged, word_hashes


def closure(nodes, links):
    root = {x: x for x in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}


# components


def test_components_of_random_links(spark):
    chance = random.Random(5)
    links = [(chance.randrange(300), chance.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)]
    links += [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert got == closure({x for p in real for x in p}, real)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Jaccard join


def test_linked_sets_share_a_signature():
    chance = np.random.default_rng(6)
    ends = part_enum.size_bands(85)
    for size in [1, 2, 5, 6, 7, 8, 11, 14, 20, 40, 90, 300, 1500]:
        for _ in range(30):
            a = np.unique(chance.integers(0, 2**64, size, dtype=np.uint64))
            most = int((len(a) * 2) * 15 / 185)
            drop = int(chance.integers(0, most + 1))
            b = np.unique(np.concatenate([a[drop:], chance.integers(0, 2**64, most - drop, dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= 85 * (len(a) + len(b) - both):
                assert np.intersect1d(part_enum.signatures(a, ends, 85), part_enum.signatures(b, ends, 85)).size


@pytest.mark.parametrize("percent", [80, 85])
def test_unlike_sets_share_no_empty_contents(percent):
    """Sets at the lower end of a band, or that sign for the next one too, leave empty contents out, and still meet what links."""
    chance = np.random.default_rng(9)
    ends = part_enum.size_bands(percent)
    for end in ends[(ends > 100) & (ends < 1200)]:
        for size in (end * percent // 100 + 1, end * percent**2 // 10_000 + 2, end):
            sets = [np.unique(chance.integers(0, 2**64, size, dtype=np.uint64)) for _ in range(40)]
            met, held = np.unique(np.concatenate([part_enum.signatures(s, ends, percent) for s in sets]), return_counts=True)
            assert held[held > 1].sum() <= 0.002 * len(met), (size, held[held > 1].sum(), len(met))
            for a in sets:
                for drop in (0, size * (100 - percent) // 100):  # as many as may go, or as may come
                    fresh = chance.integers(0, 2**64, 0 if drop else size * (100 - percent) // percent, dtype=np.uint64)
                    b = np.unique(np.concatenate([chance.permutation(a)[drop:], fresh]))
                    assert 100 * min(len(a), len(b)) >= percent * max(len(a), len(b))
                    assert np.intersect1d(part_enum.signatures(a, ends, percent), part_enum.signatures(b, ends, percent)).size


def test_sieve_keeps_all_that_is_wanted(spark):
    rows = spark.range(20_000).select(F.col("id").alias("key"), F.lit("x").alias("text"))
    wanted = spark.range(0, 20_000, 100).withColumnRenamed("id", "key")
    left = part_enum._sieved(rows, wanted, "key")
    assert left.columns == rows.columns
    assert left.join(wanted, "key").count() == 200 and left.count() < 2_000
    assert part_enum._sieved(rows, wanted.limit(0), "key").count() == 0
    odd = spark.createDataFrame([("", "a"), ("b", "b"), (None, "c"), ("b", "d")], "key string, text string")
    left = part_enum._sieved(odd, odd.filter("key = 'b'").select("key"), "key").join(spark.createDataFrame([("b",)], "key string"), "key")
    assert sorted(r.text for r in left.collect()) == ["b", "d"]


def test_shuffle_files_go_once_a_table_is_staged(spark):
    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {f for f in files if f.rsplit("/", 1)[-1].startswith("shuffle_") and f.endswith(".data")}

    before = held()
    assert staged(spark.range(5000).repartition(7, "id").groupBy((F.col("id") % 9).alias("x")).count(), "few").count() == 9
    last = time.monotonic() + 10
    # What the count itself shuffled may stay; it is one row a task.
    left = lambda: [f for f in held() - before if os.path.exists(f) and os.path.getsize(f) > 2000]
    while left() and time.monotonic() < last:
        time.sleep(0.1)
    assert not left()


def test_parities_never_exceed_what_differs():
    chance = np.random.default_rng(8)
    for _ in range(400):
        a = np.unique(chance.integers(0, 2**64, int(chance.integers(1, 1500)), dtype=np.uint64))
        cut = int(chance.integers(0, len(a) + 1))
        b = np.unique(np.concatenate([a[cut:], chance.integers(0, 2**64, int(chance.integers(1, 900)), dtype=np.uint64)]))
        differ = len(np.setxor1d(a, b))
        assert part_enum.apart(part_enum.spread(a), part_enum.spread(b)) <= differ
        assert part_enum.apart(part_enum.spread(a), part_enum.spread(a)) == 0
    a, b = (chance.integers(0, 2**64, 3000, dtype=np.uint64) for _ in range(2))
    assert part_enum.apart(part_enum.spread(a), part_enum.spread(b)) > 6000 * 15 / 185  # unlike sets do not pass


def test_nothing_staged_is_left_but_the_result(spark):
    from attrition.session import work_dir

    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark)}/llm")
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = lambda: {str(f.getPath().getName()) for f in system.listStatus(folder)} if system.exists(folder) else set()
    before = held()
    out = part_enum.jaccard_components(documents(spark, [prose(1, 40), prose(1, 40), prose(2, 50), prose(1, 39)]))
    (left,) = held() - before
    assert left.startswith("classes-") and [r.component_id for r in out.orderBy("doc_id").collect()] == [0, 0, 2, 0]


def test_jaccard_components_equal_brute_force(spark):
    chance = random.Random(7)
    texts = []
    for i in range(25):
        base = prose(i, chance.choice([1, 3, 4, 6, 9, 30, 120])).split()
        for _ in range(6):
            copy = list(base)
            for _ in range(chance.randrange(0, 3)):
                copy[chance.randrange(len(copy))] = f"new{chance.randrange(9)}"
            texts.append(" ".join(copy))
    docs = documents(spark, texts, odd_rows(1000))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = []
    for _, text in rows:
        w = ascii_words(text)
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    ids = [i for i, _ in rows]
    links = [
        (ids[a], ids[b])
        for a in range(len(ids))
        for b in range(a)
        if ids[a] is not None and ids[b] is not None and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    want = closure({i for i in ids if i is not None}, links)
    got = part_enum.jaccard_components(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles) for r in got) == sorted((str(i), len(s)) for i, s in zip(ids, sets, strict=True))
    assert all(r.component_id == (want[r.doc_id] if r.doc_id is not None else None) for r in got)
    kept = part_enum.keep_representatives(docs)
    assert kept.columns == docs.columns
    stay = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 1000)
    assert stay == sorted(i for i in set(want) if i < 1000 and want[i] == i)
    assert kept.filter("doc_id = 1006").count() == 2 and kept.filter("doc_id = 1005").count() == 1
    assert part_enum.jaccard_components(docs.limit(0)).count() == 0


def test_compared_buckets_are_not_read_again(spark, monkeypatch):
    """Buckets of two unlike sets are compared in the first round and gone in the next; a larger one stays."""
    half = lambda i, n: " ".join(f"w{i}a{j}" for j in range(n))
    texts = [f"{half(i, 120)} {half(100 + 2 * i + j, 40)}" for i in range(12) for j in range(2)]  # pairs that are too far apart
    texts += [half(900, 60), half(900, 60) + " more"]
    put, held = part_enum.staged, []

    def staged(df, label, stays=False):
        out = put(df, label, stays)
        if label in ("buckets", "open"):
            held.append((label, out.groupBy("sig").count().filter("count = 2").count(), out.count()))
        return out

    monkeypatch.setattr(part_enum, "staged", staged)
    got = {r.doc_id: r.component_id for r in part_enum.jaccard_components(documents(spark, texts)).collect()}
    assert got == {i: i for i in range(25)} | {25: 24}
    assert held[0][0] == "buckets" and held[0][1] > 20
    assert held[1:] and all(rows == 0 for label, _, rows in held if label == "open")


def test_shingles_of_short_texts():
    assert len(shingle_hashes(word_hashes("a b"), 4)) == 1
    assert len(shingle_hashes(word_hashes("a b"), 4, short=False)) == 0
    assert shingle_hashes(word_hashes("a b c d"), 4)[0] != shingle_hashes(word_hashes("d c b a"), 4)[0]


# embeddings


def test_embedding_links_against_brute_force(spark):
    chance = np.random.default_rng(8)
    centres = chance.normal(size=(60, 32))
    vectors = [c + chance.normal(size=32) * s for c in centres for s in (0, 0.05, 0.2, 0.3)]
    vectors += [vectors[0] * 3, vectors[5], vectors[5]]
    rows = [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(vectors)]
    n = len(rows)
    bad = [None, [], [0.0] * 32, [1.0] * 31 + [None], [1.0] * 31 + [float("nan")], [1.0] * 31 + [float("inf")], [1.0] * 5]
    rows += [(n + i, v, None) for i, v in enumerate(bad)] + [(None, rows[0][1], 1)]
    got = {r.vec_id: r for r in cap_filters.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    x = np.array([r[1] for r in rows[:n]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.9
    true = near.sum() - n
    found = sum(got[i].n_links for i in range(n))
    assert 0.9 * true <= found <= true
    assert all(got[n + i].n_links == 0 and got[n + i].component_id == n + i and got[n + i].kept for i in range(len(bad)))
    assert got[0].n_links >= 1 and got[None].n_links == 0
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(near), strict=True) if a != b]
    whole = closure(range(n), links)
    assert all(whole[got[i].component_id] == whole[i] and got[i].kept == (got[i].component_id == i) for i in range(n))


def test_embedding_blocks_count_every_pair(spark, monkeypatch):
    monkeypatch.setattr(cap_filters, "BLOCK", 16)
    chance = np.random.default_rng(9)
    rows = [(i, (np.ones(16) + chance.normal(size=16) * 0.01).tolist()) for i in range(150)]
    out = cap_filters.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {(r.n_links, r.component_id) for r in out} == {(149, 0)}


def brute_links(vectors):
    """Linked pairs of places among vectors of any lengths."""
    out = set()
    for d in {len(v) for v in vectors}:
        at = [i for i, v in enumerate(vectors) if len(v) == d]
        x = np.array([vectors[i] for i in at], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        a, b = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
        out |= {(at[i], at[j]) for i, j in zip(a, b, strict=True)}
    return out


def test_vectors_of_every_length(spark):
    chance = np.random.default_rng(21)
    vectors = [[5.0], [0.25], [-3.0], [7.0], [1.0, 0.0], [1.0, 0.0], [0.0, 1.0], [1.0, 0.01]]
    for d in (2, 3, 5, 15, 16, 40):
        centres = chance.normal(size=(12, d))
        vectors += [(c + chance.normal(size=d) * s).tolist() for c in centres for s in (0, 0.01, 0.2)]
    rows = [(i, v) for i, v in enumerate(vectors)]
    got = {r.vec_id: r for r in cap_filters.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    true = brute_links(vectors)
    assert [got[i].n_links for i in range(4)] == [2, 2, 0, 2] and [got[i].component_id for i in range(4)] == [0, 0, 2, 0]
    assert all(got[i].n_links >= 1 for i in (4, 5))
    found = sum(r.n_links for r in got.values())
    assert 0.9 * 2 * len(true) <= found <= 2 * len(true)
    whole = closure(range(len(rows)), true)
    assert all(whole[r.component_id] == whole[i] for i, r in got.items())


@pytest.mark.parametrize("pairs", [400, 2000])
def test_recall_just_above_the_limit(spark, pairs):
    """Pairs at cosines of 0.90 to 0.92, the hardest, among others that link with nothing."""
    chance = np.random.default_rng(pairs)
    a = chance.normal(size=(pairs, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    away = chance.normal(size=(pairs, 64))
    away -= (away * a).sum(1, keepdims=True) * a
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    c = chance.uniform(0.9001, 0.92, (pairs, 1))
    b = c * a + np.sqrt(1 - c**2) * away
    rows = [(i, v) for i, v in enumerate(np.concatenate([a, b]).tolist())]
    got = {r.vec_id: r.n_links for r in cap_filters.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    met = sum(got[i] for i in range(pairs)) / pairs
    assert met >= 0.9, met


def test_embeddings_take_little_disk(spark, monkeypatch):
    """Shuffle files at any time, over the bytes of the vectors; each vector passes about 49 filters."""
    monkeypatch.setattr(cap_filters, "ROUND_BYTES", 0, raising=False)
    vectors = np.random.default_rng(4).normal(size=(10_000, 64)).astype(np.float32)
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(vectors)), "embedding": list(vectors)}), "vec_id long, embedding array<float>")
    folders = [str(x) for x in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    held, over = [], threading.Event()

    def sizes():
        with suppress(OSError):  # files go meanwhile
            return sum(os.path.getsize(f"{d}/{x}") for top in folders for d, _, names in os.walk(top) for x in names if x.startswith(("shuffle", "temp")))

    def watch():
        while not over.wait(0.02):
            held.append(sizes() or 0)

    before, watching = sizes() or 0, threading.Thread(target=watch)
    watching.start()
    try:
        assert cap_filters.near_duplicates(frame).agg(F.sum("n_links")).first()[0] == 0
    finally:
        over.set()
        watching.join()
    assert max(held) - before < 4 * vectors.nbytes


def odd_vectors():
    """Vectors of some lengths in groups, many alike, with zeros of both signs, equal ones and some that link with nothing."""
    chance = np.random.default_rng(33)
    out = []
    for d, groups, each in ((1, 1, 3), (3, 4, 6), (24, 30, 8), (40, 2, 70)):
        centres = chance.normal(size=(groups, d))
        out += [c + chance.normal(size=d) * s for c in centres for s in chance.choice((0.0, 0.02, 0.25), each)]
    out += [np.array([0.0, 1.0, 1.0]), np.array([-0.0, 1.0, 1.0]), np.array([0.0, 1.0, 1.0]), np.zeros(3)]
    return [x.tolist() for x in out]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_cells_blocks_and_rounds_give_the_same(spark, monkeypatch, kind):
    vectors = odd_vectors()
    rows = [(i % 200, v) for i, v in enumerate(vectors)] + [(None, vectors[0]), (7, None)]
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    want = sorted(cap_filters.near_duplicates(frame).collect(), key=str)
    assert len(want) == len(rows) and sum(r.n_links for r in want) > 5000
    rounds = []
    send = cap_filters._send
    monkeypatch.setattr(cap_filters, "_send", lambda cells, first, last: rounds.append((first, last)) or send(cells, first, last))
    for name, value in {"BLOCK": 25, "ROUND_BYTES": 1 << 18, "ROUND": 0.1, "TILE": 9, "FIRST": 3, "WIDE": 11, "LARGE": 30, "DENSE": 10, "CROWDED": 1, "PAIRS": 50, "UNPACKED": 7}.items():
        monkeypatch.setattr(cap_filters, name, value)
    assert sorted(cap_filters.near_duplicates(frame).collect(), key=str) == want
    assert len(rounds) > 2 and all(a[1] == b[0] for a, b in zip(rounds, rounds[1:], strict=False))
    monkeypatch.undo()
    monkeypatch.setattr(cap_filters, "_digest", lambda column: F.size(column).cast("long"))
    assert sorted(cap_filters.near_duplicates(frame).collect(), key=str) == want


def test_cells_are_divided_and_joined_by_counts():
    assert cap_filters._divided(np.array([20, 3, 500]), np.array([0, 10, 20]), 21, 10) is None  # one filter is not divided
    assert cap_filters._divided(np.array([21, 3]), np.array([0, 10]), 20, 10).tolist() == [0, 1, 3, 5, 6, 8, 10]
    assert cap_filters._joined(np.array([4, 5, 3, 9, 40, 1, 1]), 10).tolist() == [0, 2, 3, 4, 5]


@pytest.mark.parametrize("dims", [2, 33])
def test_filters_passed_equal_those_of_all_tried(dims):
    chance = np.random.default_rng(dims)
    unit = chance.normal(size=(60, dims))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    rotation, parts = cap_filters.codes(dims, 900)
    for least in (0.3, 0.6, 0.95):
        turned = unit @ rotation[:dims]
        cut = parts[0].shape[1]
        a, b = turned[:, :cut] @ parts[0].T, turned[:, cut:] @ parts[1].T
        value = (a[:, :, None] + b[:, None, :]).reshape(60, -1)
        want = [(np.flatnonzero(x >= least) if (x >= least).any() else [np.argmax(x)]) for x in value]
        got = cap_filters.passed(unit, rotation, parts, least)
        assert [x.tolist() for x in got] == [list(x) for x in want]
        lists = cap_filters.pa.array([np.concatenate([[len(x)], x, n, y]).astype("<u2").tobytes() for x, n, y in cap_filters._listed(unit, rotation, parts, least)])
        assert [x.tolist() for x in cap_filters._lists(lists, 900)] == [x.tolist() for x in got]
        low, high = 500, 1700
        row, filters = cap_filters._entries(lists[5:40], 900, low, high)
        assert sorted(zip(row.tolist(), filters.tolist(), strict=True)) == [(i, f) for i, x in enumerate(got[5:40]) for f in x.tolist() if low <= f < high]


def test_first_shared_equals_intersections():
    chance = np.random.default_rng(2)
    lists = [np.unique(np.append(chance.integers(0, 60, chance.integers(1, 30)), 60)) for _ in range(50)]
    i, j = chance.integers(0, 50, (2, 400))
    want = [np.intersect1d(lists[a], lists[b])[0] for a, b in zip(i, j, strict=True)]
    assert cap_filters._first_shared(lists, i, j).tolist() == want
    assert len(cap_filters._first_shared(lists, i[:0], j[:0])) == 0


# urls


def test_listed_rules_and_parts(spark):
    urls = [
        None, "no scheme", "http://Example.ORG/es/1", "https://a.example.org/en/12?x#y", "http://example.org/en/2", "http://notexample.org/es/",
        "http://org", "http://x.com/fr/?a", "http://x.com/de/", "http://x.com/def", "http://x.net#/a://b", "x://com/fr/a\nb", "http://",
    ]
    pages = spark.createDataFrame([(i, u, "<p>", 1) for i, u in enumerate(urls)], "page_id long, url string, html string, tokens int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, labels).collect()}
    assert got == {
        0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("example.org", "/es/1", "example.org/es/", "block"),
        3: ("a.example.org", "/en/12", "example.org/en/1", "block"), 4: ("example.org", "/en/2", "org/", "allow"),
        5: ("notexample.org", "/es/", "org/", "allow"), 6: ("org", "", None, "allow"), 7: ("x.com", "/fr/", "com/fr/", "allow"),
        8: ("x.com", "/de/", "com/de/", "block"), 9: ("x.com", "/def", None, "allow"), 10: ("x.net", "", None, "allow"),
        11: ("com", "/fr/a\nb", "com/fr/", "allow"), 12: ("", "", None, "allow"),
    }
    assert url_filter.judge(pages.limit(0), labels).count() == 0


def test_mined_rules_match_by_index(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, f"http://{'casino' if bad else 'shop'}.site{i % 3}.net/{'win' if i % 2 == 0 else 'buy'}/{i}"))
        labels.append((i, 1, int(bad)))
    rows += [(1000, "http://casino.site1.net/win/9"), (1001, "http://shop.site1.net/buy/9"), (1000, "http://casino.site1.net/win/9")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = {r.page_id: (r.verdict, r.learned) for r in url_filter.judge(pages, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert got[1000][0] == "block" and "casino" in got[1000][1]
    assert got[1001][0] == "allow" and "casino" not in got[1001][1]


@pytest.mark.parametrize("blocks", [1, 2])
def test_dense_filters_equal_pairs_one_by_one(blocks, monkeypatch):
    """Matrix products give the links and components that single pairs give, within a filter and between blocks."""
    chance = np.random.default_rng(blocks)
    centres = chance.normal(size=(3, 16))
    v = centres[chance.integers(0, 3, 90)] + 0.35 * chance.normal(size=(90, 16))
    lists = [np.unique(np.append(chance.integers(0, 400, 6), 200)) for _ in v]
    side = np.full(90, 2) if blocks == 1 else np.repeat([0, 1], 45)
    rows = pd.DataFrame({"id": chance.permutation(90), "v": list(v), "copies": chance.integers(1, 4, 90), "filter": 200, "side": side, "filters": lists})
    got = cap_filters._compare(0.9)(rows.copy())
    monkeypatch.setattr(cap_filters, "DENSE", 1000)
    assert len(got) and got.equals(cap_filters._compare(0.9)(rows.copy()))
    monkeypatch.setattr(cap_filters, "DENSE", 2)
    monkeypatch.setattr(cap_filters, "WIDE", 7)
    assert got.equals(cap_filters._compare(0.9)(rows.copy()))


def plain_rules(rows, support, least, items, confidence, certainty):
    """Every rule of ``(tokens, block)`` rows by trying each set of tokens of each row."""
    n, bad = len(rows), sum(b for _, b in rows)
    support = max(support, least / n)
    frequency = Counter(t for tokens, _ in rows for t in tokens)
    every, marked = Counter(), Counter()
    for tokens, b in rows:
        some = tokens
        if len(tokens) > items:
            some = sorted((t for t in tokens if frequency[t] >= support * n), key=lambda t: (frequency[t], t))[:items]
        for k in range(1, len(some) + 1):
            for part in combinations(sorted(some), k):
                every[part] += 1
                marked[part, "=block" if b else "=allow"] += 1
    rules = {}
    for (part, label), m in marked.items():
        share = bad / n if label == "=block" else 1 - bad / n
        sure = m / every[part]
        if m >= support * n - 1e-9 and sure >= confidence and share < 1 and (sure - share) / (1 - share) >= certainty:
            rules[part, label] = (sure, m / n, (sure - share) / (1 - share))
    inner = lambda p: (q for k in range(1, len(p)) for q in combinations(p, k))
    return {r: x for r, x in rules.items() if all(rules.get((q, r[1]), (0,))[0] < x[0] for q in inner(r[0]))}


@pytest.mark.parametrize("items", [3, 12])
def test_rules_and_matches_equal_a_plain_version(spark, items):
    rng = random.Random(items)
    rows = []
    for _ in range(300):
        tokens = sorted({f"t{min(int(rng.expovariate(0.25)), 11)}" for _ in range(rng.randint(1, 6))})
        rows.append((tokens, rng.random() < (0.8 if {"t1", "t2"} <= set(tokens) or "t7" in tokens else 0.15)))
    labelled = spark.createDataFrame(rows, "tokens array<string>, block boolean")
    terms = {"support": 0.01, "least": 4, "items": items, "confidence": 0.5, "certainty": 0.25}
    mined = url_filter.mined_rules(labelled, **terms)
    got = {(tuple(r["items"]), r["label"]): (r["confidence"], r["support"], r["certainty"]) for r in mined.collect()}
    want = plain_rules(rows, **terms)
    assert want.keys() == got.keys() and {label for _, label in want} == {"=block", "=allow"}
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    found = {tuple(r["tokens"]): (r["label"], r["learned"]) for r in url_filter.matched(labelled.select("tokens"), mined).collect()}
    for tokens, _ in rows:
        held = [(round(x[2], 9), round(x[1], 9), label, " ".join(part)) for (part, label), x in want.items() if set(part) <= set(tokens)]
        assert found.get(tuple(tokens)) == (max(held)[2:] if held else None)


def test_long_urls_and_one_label(spark):
    """Thirty-five parts that always come together: a bounded number of sets, and no label share to beat where all are alike."""
    pages = spark.createDataFrame([(i, "http://a.b/" + "/".join(f"x{chr(97 + j % 26) * (1 + j // 26)}" for j in range(35))) for i in range(40)], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    assert {(r.verdict, r.learned) for r in url_filter.judge(pages, labels).collect()} == {("allow", None)}
    alike = spark.createDataFrame([(i, 1, 1) for i in range(40)], "doc_id long, quality int, toxic int")
    assert {(r.verdict, r.learned) for r in url_filter.judge(pages, alike).collect()} == {("allow", None)}


def test_every_token_of_long_urls_is_mined(spark):
    """Rows of more than twelve frequent tokens, some of which always come together, give the rules of trying every set."""
    rng = random.Random(5)
    rows = []
    for _ in range(60):
        fixed = [f"c{i}" for i in range(9)] if rng.random() < 0.6 else []
        some = {f"t{i}" for i in range(5) if rng.random() < 0.8}
        tokens = sorted({"all", *fixed, *some})
        rows.append((tokens, rng.random() < (0.9 if "c0" in tokens and "t1" in some else 0.1)))
    rows += [(sorted({"all", "c3x", "t1"}), True)] * 4
    assert max(len(t) for t, _ in rows) > 12
    terms = {"support": 0.05, "least": 4, "confidence": 0.5, "certainty": 0.25}
    mined = url_filter.mined_rules(spark.createDataFrame(rows, "tokens array<string>, block boolean"), **terms)
    got = {(tuple(r["items"]), r["label"]): (r["confidence"], r["support"], r["certainty"]) for r in mined.collect()}
    want = plain_rules(rows, items=99, **terms)
    assert want.keys() == got.keys() and {f"c{i}" for i in range(9)} <= {t for part, _ in want for t in part}
    assert all(got[k] == pytest.approx(want[k]) for k in want)


# registry and pipeline


def test_every_operator_has_one_query():
    found = sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES if q.startswith("op"))
    assert found == list(range(1, 14)) and "pipeline" in queries.QUERIES


@pytest.mark.parametrize("key", sorted(queries.oracle_texts()))
def test_oracles(spark, key):
    from compare import compare, duck_connect

    small = "/root/testdata/sf0.001"
    assert compare(spark, duck_connect(small), key, small, queries.QUERIES[key], queries.oracle_texts()[key])["match"]


def test_near_copies_of_the_stage(spark):
    """Five-word similarities from 0.80 go, though four-word ones are below 0.85; less similar ones stay."""

    def changed(seed, places):
        w = prose(seed, 100).split()
        for at in places:
            w[at] = f"changed{seed}x{at}"
        return " ".join(w)

    def similarity(a, b, k):
        a, b = ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (a.split(), b.split()))
        return len(a & b) / len(a | b)

    texts = [changed(40, []), changed(40, [30, 60]), changed(41, []), changed(41, [20, 40, 60]), changed(42, []), changed(42, [50])]
    assert 0.80 <= similarity(*texts[:2], 5) <= 0.83 and similarity(*texts[:2], 4) < 0.85
    assert similarity(*texts[2:4], 5) < 0.80 < similarity(*texts[4:], 5)
    docs = documents(spark, texts, odd_rows(100))
    kept = corpus_pipeline.without_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 100) == [0, 2, 3, 4]


def test_near_copies_equal_brute_force_at_five_words(spark):
    chance = random.Random(17)
    texts = []
    for i in range(25):
        base = prose(i, chance.choice([1, 4, 5, 9, 30, 60, 120])).split()
        for _ in range(6):
            copy = list(base)
            for _ in range(chance.randrange(0, 4)):
                copy[chance.randrange(len(copy))] = f"new{chance.randrange(9)}"
            texts.append(" ".join(copy))
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in map(ascii_words, texts)]
    links = [
        (a, b) for a in range(len(texts)) for b in range(a) if 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b])
    ]
    want = closure(range(len(texts)), links)
    kept = corpus_pipeline.without_near_copies(spark, documents(spark, texts), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, root in want.items() if i == root)


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.staged(stage(spark, docs, "/root/testdata/sf0.001"), name)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert 0 < out.count() <= docs.count()
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
        docs = out
    texts = {r.doc_id: r.text for r in docs.collect()}
    pieces = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert {p.doc_id for p in pieces} == set(texts)
