from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from spanloom.sources import readers, writers
from spanloom.streaming import ingest


def test_language_source_takes_the_first_folder_and_shards(spark, tmp_path):
    spark.range(100).select(F.col("id"), F.lit("x").alias("content")).write.parquet(str(tmp_path / "b"))
    got = [readers.language_source(spark, [str(tmp_path / "a"), str(tmp_path / "b")], shard=i, shards=3) for i in range(3)]
    assert sorted(r.id for df in got for r in df.collect()) == list(range(100))
    whole = [r.id for r in readers.language_source(spark, [str(tmp_path / "b")], skip=0).collect()]
    late = [r.id for r in readers.language_source(spark, [str(tmp_path / "b")], skip=90).collect()]
    assert len(late) == 10 and set(late) < set(whole)
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, [str(tmp_path / "none")])


def test_combined_sources_go_in_rounds(spark):
    a, b = spark.createDataFrame([(1,), (3,)], "id long"), spark.createDataFrame([(2,)], "id long")
    got = readers.combined_sources({"a": a, "b": b}, "id").orderBy("round", "place").collect()
    assert [(r.id, r._source) for r in got] == [(1, "a"), (2, "b"), (3, "a")]


def test_label_aliases_are_read_together(spark, tmp_path):
    for name, n in (("c", 2), ("cpp", 3)):
        spark.range(n).write.parquet(str(tmp_path / "train" / name / "dataset"))
    assert readers.label_rows(spark, str(tmp_path), "train", "c_family").count() == 5
    with pytest.raises(FileNotFoundError):
        readers.label_rows(spark, str(tmp_path), "train", "go")


def test_web_texts_cache_and_snapshots(spark, tmp_path):
    (tmp_path / "w.jsonl").write_text('{"text": "a"}\n{"text": " ", "body": "b"}\n{"other": 1}\n')
    assert sorted(r.content for r in readers.web_texts(spark, str(tmp_path / "w.jsonl")).collect()) == ["a", "b"]
    (tmp_path / "c.jsonl").write_text('{"benchmark_id": "x", "cost_usd": 1.0}\n\nbroken {\n{"cost_usd": 5}\n{"benchmark_id": "x", "cost_usd": 2.0}\n{"benchmark_id": "y"}\n')
    got = {r.benchmark_id: r.cost_usd for r in readers.cache_lines(spark, str(tmp_path / "c.jsonl"), "benchmark_id string, cost_usd double", "benchmark_id").collect()}
    assert got == {"x": 2.0, "y": None}
    (tmp_path / "snap" / "deep").mkdir(parents=True)
    (tmp_path / "snap" / "deep" / "a.json").write_text(json.dumps({"run_id": "r1"}, indent=1))
    (tmp_path / "snap" / "b.json").write_text("{not json")
    rows = readers.snapshots(spark, str(tmp_path / "snap"), "run_id string").collect()
    assert sorted((r.run_id or "", r.error or "") for r in rows) == [("", "not readable as JSON"), ("r1", "")]


def test_annotated_files(spark):
    files = spark.createDataFrame([(1, bytearray(b"a\xe9b")), (2, bytearray(b"z"))], "file_id int, content binary")
    segments = spark.createDataFrame([(1, 0, 2, 5), (1, 2, 3, 99)], "file_id int, start int, end int, label int")
    got = {r.file_id: (r.text, [tuple(s) for s in r.segments]) for r in readers.annotated_files(files, segments, {5: "go"}).collect()}
    assert got == {1: ("aéb", [(0, 2, "go")]), 2: ("z", [])}


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a", "train", "go"), ("b", "val", "go")], "content string, split string, label string")
    out = str(tmp_path / "w")
    writers.write_windows(rows, out)
    writers.write_windows(rows, out)
    assert spark.read.parquet(out).filter("split = 'val'").count() == 2
    writers.replace_table(rows.filter("split = 'val'"), str(tmp_path / "t"))
    writers.replace_table(rows, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["t", "w"]
    examples = spark.createDataFrame([("t", "abc", [(0, 3, "go")]), ("t", "d", [(0, 1, "c")])], "task string, content string, segments array<struct<start:int,end:int,label:string>>")
    assert writers.write_examples(examples, str(tmp_path / "e")) == 2
    (m,) = writers.manifest(examples).collect()
    assert (m.n, m.n_chars, m.labels) == (2, 4, ["c", "go"])


def test_ingest_skips_known_windows_and_keeps_to_the_budget(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    write = lambda name, texts: (tmp_path / "in" / name).write_text("".join(json.dumps({"content": t, "label": "go"}) + "\n" for t in texts))
    write("a.json", ["one", "two", "two", " "])
    ingest.ingest(spark, source, out, check).awaitTermination(120)
    assert spark.read.parquet(out).count() == 2
    write("b.json", ["two", "three"])
    ingest.ingest(spark, source, out, check).awaitTermination(120)
    assert sorted(r.content for r in spark.read.parquet(out).collect()) == ["one", "three", "two"]
    write("c.json", [f"more {i}" for i in range(200)])
    ingest.ingest(spark, source, out, check, budget=20).awaitTermination(120)
    by = {r.split: r["count"] for r in spark.read.parquet(out).groupBy("split").count().collect()}
    assert by == {"train": 20, "val": 20}
