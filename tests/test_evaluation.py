from __future__ import annotations

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from spanloom.operators import evaluation
from spanloom.plans import evaluation_queries


def slow_near(t, places, radius):
    cuts = [b for a, b in zip(places, places[1:]) if t[a] != t[b]]
    return {p for b in cuts for p in range(b - radius, b + radius)}


def test_counted_matches_brute_force(spark):
    rng = random.Random(0)
    rows = [(i % 3, "".join(rng.choice("LLLDWP") for _ in range(n)), "".join(rng.choice("LDWP") for _ in range(n))) for i, n in enumerate([0, 1, 2, 30, 7, 100])]
    df = spark.createDataFrame([*rows, (None, None, None), rows[3]], "k int, truth string, pred string")
    rows = [*rows, rows[3]]
    for kw in ({}, {"valid": True}, {"near": 2}, {"valid": True, "near": 3, "over_valid": True}):
        want = Counter()
        for k, t, p in rows:
            places = [i for i in range(len(t)) if not kw.get("over_valid") or t[i] != "W"]
            near = slow_near(t, places, kw["near"]) if kw.get("near") else range(len(t))
            want.update((k, t[i], p[i]) for i in range(len(t)) if i in near and not (kw.get("valid") and t[i] == "W"))
        got = {(r.k, r.truth, r.pred): r.n for r in evaluation.counted(df, "truth", "pred", "k", **kw).collect()}
        assert got == want
    assert evaluation.counted(df.filter("false"), "truth", "pred", "k").count() == 0


def test_region_counts_match_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i, n in enumerate([0, 5, 40, 90]):
        t, p = ("".join(rng.choice("LDWP") for _ in range(n)) for _ in range(2))
        rows.append((i, t, p, [(rng.randint(-3, n), rng.randint(0, n + 5), rng.choice(["D", None]), rng.choice(["L", None])) for _ in range(4)]))
    df = spark.createDataFrame([*rows, (9, None, None, None)], f"id int, truth string, pred string, regions {evaluation.REGIONS}")
    got = {(r.id, r.region): r for r in evaluation.region_counts(df, "truth", "pred", "regions", "P", "id").collect()}
    assert len(got) == 16
    for i, t, p, regions in rows:
        for k, (a, b, label, host) in enumerate(regions):
            part = [x for x in range(max(0, a), min(b, len(t))) if t[x] != "W"]
            r = got[i, k]
            assert (r.total, r.exact) == (len(part), sum(p[x] == (label or t[x]) for x in part))
            assert r.other == sum(host is None or p[x] != host for x in part) and r["text"] == sum(p[x] == "P" for x in part)
            assert r.other_all == sum(t[x] != "W" and (host is None or p[x] != host) for x in range(len(t)))


def test_overlap_of_regions(spark):
    df = spark.createDataFrame([(0, "LLDDLL", "LLDDPL", [(2, 4, "D", "L")])], f"id int, truth string, pred string, regions {evaluation.REGIONS}")
    rows = evaluation.region_counts(df, "truth", "pred", "regions", "P", "id")
    assert rows.select(evaluation.iou().alias("x"), evaluation.found("exact").alias("f")).first()[:] == (2 / 3, True)


def test_byte_votes_and_means(spark):
    assert evaluation.byte_votes("aé€", "ABACAB") == "AAA" and evaluation.byte_votes("é", "CB") == "B"
    assert evaluation.byte_votes("", "") == "" and evaluation.byte_votes(None, "") == ""
    df = spark.createDataFrame([("aé", [1.0, 2.0, 4.0]), ("", []), (None, None)], "t string, p array<double>")
    assert [r.m for r in df.select(evaluation.char_means("t", F.coalesce("p", F.array().cast("array<double>"))).alias("m")).collect()] == [[1.0, 3.0], [], []]


def test_length_places_are_those_of_the_ordered_list(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), "x" * rng.randint(0, 30), rng.choice("hi")) for _ in range(90)] + [(None, "xx", "h")]
    df = spark.createDataFrame(rows, "k string, t string, host string")
    for r in evaluation.length_summary(df, F.length("t"), "host", "k").collect():
        sizes = sorted(len(t) for k, t, _ in rows if k == r.k)
        n = len(sizes)
        assert (r.n, r["median"], r.p95, r.longest) == (n, sizes[n // 2], sizes[max(int(n * 0.95) - 1, 0)], sizes[-1])
        assert r.n_hosts == len({h for k, _, h in rows if k == r.k})


def test_greedy_thresholds():
    counts = {"a": [(10, 10), (9, 0)], "b": [(5, 0), (1, 0)], "": [(20, 0)]}
    assert evaluation.thresholds(counts, [0.3, 0.5]) == {"a": 0.5, "b": 0.3}


def test_threshold_policy_counts_are_right(spark, sf_dir):
    got = {r.label: r.threshold for r in evaluation_queries.threshold_policy(spark, sf_dir).collect()}
    docs = evaluation_queries.labelled(spark, sf_dir).select("doc_id", "truth", "pred").collect()
    grid = evaluation_queries.GRID
    counts = {}
    for d in docs:
        p = np.array(list(d.pred))
        q = 0.3 + (np.arange(len(p)) * 7 + d.doc_id) % 50 / 100.0
        right = np.array(list(d.truth)) == p
        for c in set(d.pred):
            mine = counts.setdefault(c, [[0, 0] for _ in grid])
            for i, g in enumerate(grid):
                use = (p == c) & (q >= g)
                mine[i][0] += int((use & right).sum())
                mine[i][1] += int((use & ~right).sum())
    every = sum(len(d.pred) for d in docs)
    assert got == evaluation.thresholds({k: [tuple(x) for x in v] for k, v in counts.items()} | {"": [(every, 0)]}, grid)


def test_recurrence(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0],), ([],)], "v array<double>")
    assert [r.h for r in df.select(evaluation.recurrence(F.col("v"), F.lit(0.5)).alias("h")).collect()] == [5.25, 0.0]
