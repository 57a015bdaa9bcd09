from __future__ import annotations

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from conftest_helpers import AWKWARD, some_text

from spanloom.llm import decontam, simhash
from spanloom.llm.components import components, forest

LINKS = "a long, b long"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def slow_fingerprint(text):
    w = re.findall("[^\x20\x09-\x0d]+", lower(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_fingerprints_match_brute_force():
    rng = random.Random(0)
    texts = ["", None, " \n", "a", "A b", "a b c", "É\x0bÉ x", *(some_text(rng, n) for n in range(3, 60))]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_near_groups_match_brute_force(spark, frame, sf_dir):
    rows = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rng = random.Random(5)
    base = some_text(rng, 400, 10**6).split(" ")
    for i in range(40):  # a chain of near copies
        base[rng.randrange(len(base))] = f"n{i}"
        rows.append((5000 + i, " ".join(base), "en", "s", 1))
    rows += [(7000 + i, *r[1:]) if r[0] is not None else r for i, r in enumerate(AWKWARD)]
    got = simhash.near_groups(frame(rows)).collect()
    assert len(got) == len(rows)
    fps = {r[0]: slow_fingerprint(r[1]) for r in rows if r[0] is not None}
    ids = sorted(fps)
    pairs = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 3]
    want = groups_of(pairs, ids)
    for r in got:
        if r.doc_id is not None:
            assert r.fp & (1 << 64) - 1 == fps[r.doc_id] and r.component_id == want[r.doc_id]
    kept = simhash.keep_first(frame(rows))
    assert sorted(set(r.doc_id for r in kept.filter("doc_id is not null").collect())) == sorted(set(want.values()))
    assert kept.columns[-1] == "wid" and simhash.near_groups(frame(rows).filter("false")).count() == 0


@pytest.mark.parametrize("kw", [{}, {"bucket": 8}, {"groups": [(list(range(32)), 1), (list(range(32, 64)), 1)]}, {"groups": [(list(range(21)), 1), (list(range(21, 42)), 0), (list(range(42, 64)), 0)], "bucket": 8}, {"groups": [(list(range(64)), 3)]}])
def test_links_connect_all_pairs_within_the_distance(spark, kw):
    rng = random.Random(6)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for x in list(fps):
        for _ in range(12):  # balls, and chains out of them
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
    ordered = sorted(fps)
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(ordered)]
    if "groups" in kw and kw["groups"][0][1] == 3:
        rows, ordered = rows[:30], ordered[:30]
    pairs = [(i, j) for i, a in enumerate(ordered) for j in range(i + 1, len(ordered)) if (a ^ ordered[j]).bit_count() <= 3]
    want = groups_of(pairs, range(len(ordered)))
    links = [tuple(r) for r in simhash.hamming_links(spark.createDataFrame(rows, "fp long, node long"), **kw).collect()]
    assert all((ordered[a] ^ ordered[b]).bit_count() <= 3 for a, b in links)
    assert groups_of(links, range(len(ordered))) == want


def test_thresholds_add_up_for_every_size():
    rng = np.random.default_rng(0)
    x = rng.random((500, 64)) < rng.random(64)
    both = (x.T.astype(float) @ x) * 1.0
    for n in (10, 10**4, 10**6, 10**9, 10**11):
        groups = simhash.plan(n, both * n / 500)
        bits = sorted(b for g, _ in groups for b in g)
        assert len(bits) == len(set(bits)) and sum(t + 1 for _, t in groups) == simhash.DISTANCE + 1
    assert len({len(simhash.plan(n, both * n / 500)) for n in (10**4, 10**11)}) == 2  # more rows, fewer and wider groups


@pytest.mark.parametrize("task_links", [10**6, 3])
def test_components(spark, task_links):
    rng = random.Random(8)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)] + [(200, x) for x in range(201, 240)] + [(5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, LINKS), task_links).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == groups_of(pairs, nodes)
    assert components(spark.createDataFrame([], LINKS), task_links).count() == 0


def test_forest_of_a_path():
    n = 500
    a = np.random.default_rng(1).permutation(n)
    node, least = forest(a[:-1], a[1:])
    assert len(node) == n and (least == 0).all()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow_contamination(rows, items):
    windows = defaultdict(set)
    for i, x in items:
        w = WORD.findall(lower(x))
        for k in range(max(1, len(w) - 12)) if w else []:
            windows[tuple(w[k : k + 13])].add(i)
    sizes = {len(k) for k in windows}
    for doc_id, text in rows:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= got
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        yield doc_id, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)


ITEMS = "item_id long, text string"


def test_contamination_matches_brute_force(spark, frame, sf_dir):
    rng = random.Random(3)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    items += [(900, "a b"), (901, "A, b!"), (902, ""), (903, None), (904, "solo"), (905, "the " * 20), (906, items[0][1]), (907, "one two " * 10)]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    for i in range(60):
        w = items[i % len(items)][1].split() if items[i % len(items)][1] else []
        cut = w[rng.randint(0, 3) : len(w) - rng.randint(0, 3)]
        rows.append((20_000 + i, " ".join([*some_text(rng, rng.randint(0, 300)).split(), *cut, "tail", *cut])))
    rows += [(30_000, "the " * 500), (30_001, "A-b; a b. SOLO"), (30_002, "one two " * 200)]
    rows += [(r[0], r[1]) for r in AWKWARD] + [(None, "solo"), (None, "clean and long enough to stay"), (20_000, "clean here"), (900, "a b"), (900, "other")]
    df = frame([(a, b, "en", "s", 1) for a, b in rows])
    table = spark.createDataFrame(items, ITEMS)
    want = list(slow_contamination(rows, items))
    assert sorted(map(tuple, decontam.contamination(df, table).collect()), key=str) == sorted(want, key=str)
    kept = [(r.doc_id, r.text) for r in decontam.keep_clean(df, table).collect()]
    assert sorted(kept, key=str) == sorted((row for row, w in zip(rows, want) if not w[-1]), key=str)


def test_unlike_rows_of_one_id_are_judged_apart(spark, frame):
    item = " ".join(f"q{i}" for i in range(13))
    rows = [(1, item, "en", "s", 1), (1, "clean text here", "en", "s", 1), (None, item, "en", "s", 1), (None, "clean too", "en", "s", 1)]
    items = spark.createDataFrame([(7, item)], ITEMS)
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.contaminated) for r in decontam.contamination(frame(rows), items).collect())
    assert got == [(0, 2, 0, False), (0, 13, 13, True), (1, 3, 0, False), (1, 13, 13, True)]
    assert sorted(r.text for r in decontam.keep_clean(frame(rows), items).collect()) == ["clean text here", "clean too"]


def test_lists_are_intersected_by_place_before_words_are_compared(spark, frame, monkeypatch):
    item = " ".join(f"q{i}" for i in range(13))
    apart = " ".join(f"q{i} gap" for i in range(13))  # every term, no place in common
    near = item.replace("q5 ", "other ")  # rare terms agree, a word differs
    rows = decontam.numbered(frame([(1, item, "en", "s", 1), (2, apart, "en", "s", 1), (3, near, "en", "s", 1)]))
    kinds = spark.createDataFrame([(0, item.split())], "wid long, words array<string>")
    counts = spark.createDataFrame([(f"q{i}", 1 if i in (2, 7, 11) else 9) for i in range(13)], "term string, n long")
    marks = decontam.anchors(kinds, counts)
    index = decontam.postings(rows, marks.select("term").distinct())
    ids = {r.rid: r.doc_id for r in rows.collect()}
    assert sorted((ids[r.rid], r.start) for r in decontam.proposals(index, marks).collect()) == [(1, 0), (3, 0)]
    assert [(ids[r.rid], r.start, r.length) for r in decontam.phrase_matches(index, marks, kinds, rows).collect()] == [(1, 0, 13)]
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)  # dealt with salt instead
    monkeypatch.setattr(decontam.meet, "__defaults__", ("inner", 0))
    assert [(ids[r.rid], r.start, r.length) for r in decontam.phrase_matches(index, marks, kinds, rows).collect()] == [(1, 0, 13)]


def test_contamination_repeated_rows_and_empty_tables(spark, frame):
    items = spark.createDataFrame([(1, "alpha beta")], ITEMS)
    twice = [(1, "alpha beta", "en", "s", 1)] * 2
    assert [tuple(r)[:4] for r in decontam.contamination(frame(twice), items).collect()] == [(1, 2, 2, 1)] * 2
    assert decontam.contamination(frame(twice).filter("false"), items).count() == 0
    assert [r.n_hit for r in decontam.contamination(frame(twice), items.filter("false")).collect()] == [0, 0]


def test_proximity(spark, frame):
    docs = frame([(1, "red x x blue green", "en", "s", 1), (2, "red x x x x x blue", "en", "s", 1), (3, None, "en", "s", 1)])
    queries = spark.createDataFrame([(1, "blue RED"), (2, "green"), (3, ""), (4, "absent")], "query_id long, text string")
    got = sorted((r.doc_id, r.query_id) for r in decontam.proximity_matches(docs, queries, 3).collect())
    assert got == [(1, 1), (1, 2)]
