from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from spanloom.operators import relabel, sampling, windows


@pytest.mark.parametrize(
    "text, end",
    [("---\na: 1\n---\nx", 13), ("---\na: 1\n...\nx", 13), ("---\n...\nb\n---\n", 14), ("---\r\na\r\n---\r\nx", 13), ("---\na: 1\n", None), ("x\n---\n", None), ("", None), (None, None)],
)
def test_frontmatter_end(spark, text, end):
    assert spark.createDataFrame([(text,)], "t string").select(relabel.frontmatter_end(F.col("t"))).first()[0] == end


def test_yaml_behind_the_front_matter_becomes_markdown(spark):
    kind = "array<struct<start:int,end:int,label:string>>"
    text = "---\na: 1\n---\nxyz"
    for segments, want in (
        ([(0, 15, "yaml"), (15, 16, "python")], [(0, 13, "yaml"), (13, 15, "markdown"), (15, 16, "python")]),
        ([(0, 14, "yaml"), (14, 16, "markdown")], [(0, 13, "yaml"), (13, 16, "markdown")]),
        ([(0, 13, "yaml"), (13, 16, "text")], [(0, 13, "yaml"), (13, 16, "text")]),
        ([(0, 2, "text"), (2, 16, "yaml")], [(0, 2, "text"), (2, 16, "yaml")]),
        ([], []),
    ):
        df = spark.createDataFrame([(text, segments)], f"t string, s {kind}")
        assert [tuple(x) for x in df.select(relabel.frontmatter_guard(F.col("s"), F.col("t"))).first()[0]] == want


def test_file_verdicts(spark):
    rows = [("a", "model", True), ("a", "skipped_missing", False), ("a", "skipped_parse_failed", False), ("b", "model", True), ("b", None, False), ("c", "cached", True), ("d", "model", True), ("e", "model", None), ("f", None, True), (None, "model", True)]
    got = {r.f: (r.n_chunks, r.reason) for r in relabel.file_verdicts(spark.createDataFrame(rows, "f string, s string, a boolean"), "f", "s", "a").collect()}
    assert got == {"a": (3, "parse_failed"), "b": (2, "missing"), "c": (1, "unexpected_non_model"), "d": (1, None), "e": (1, "missing"), "f": (1, None), None: (1, None)}


def test_last_object_and_event_lines(spark):
    assert relabel.last_object('x\n{"a": {"b": 1}}\n{\n "c": 2\n}\nbye') == '{\n "c": 2\n}'
    assert [relabel.last_object(x) for x in (None, "", "none", "}", "{broken}", "[1]\n}", '{"a": 1')] == [None] * 7
    lines = [("EVENT {\"a\": 1}", '{"a": 1}'), ("  EVENT  {\"a\": 1} ", '{"a": 1}'), ("EVENT [1]", None), ("EVENT", None), ("other", None), (None, None)]
    df = spark.createDataFrame(lines, "l string, want string")
    assert [r.got for r in df.select(relabel.event_line(F.col("l"), "EVENT").alias("got")).collect()] == [w for _, w in lines]


def test_running_sums_over_ranges_match_one_pass(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i * 37 % 1009, "hot" if i % 3 else None if i % 2 else f"g{i % 5}", i % 7) for i in range(1009)]
        df = spark.createDataFrame(rows, "k int, g string, v int")
        got = {r.k: (r.round, r.batch) for r in sampling.round_robin(df, "g", F.col("k")).join(windows.batches(df, "k", F.col("v"), 50, "g").select("k", "batch"), "k").collect()}
        seen: dict = {}
        for k, g, v in sorted(rows):
            n, total = seen.get(g, (0, 0))
            assert got[k] == (n + 1, total // 50)
            seen[g] = (n + 1, total + v)
        assert sampling.round_robin(df.limit(0), "g", F.col("k")).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_seeded_subsets(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    a, b = ([r.k for r in sampling.seeded_subset(df, "k", 20, s).collect()] for s in (1, 2))
    assert a == sorted(a) and len(set(a)) == len(b) == 20 and a != b and a == [r.k for r in sampling.seeded_subset(df.repartition(3), "k", 20, 1).collect()]
    assert sampling.seeded_subset(df, "k", 500, 1).count() == 200
