"""Incremental ingest of text files: windows with known ids are skipped, each split stops at its budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.functions.text import ascii_text
from spanloom.operators.sampling import window_split
from spanloom.sources.readers import exists


def windows_of(rows: DataFrame) -> DataFrame:
    """(content, label, uid, split) of texts (content, label), in the engine's alphabet; blank ones are dropped."""
    rows = rows.select(ascii_text(F.col("content")).alias("content"), "label").filter(F.trim("content") != "")
    rows = rows.withColumn("uid", F.sha2(F.concat_ws("|", "label", "content"), 256))
    return rows.withColumn("split", window_split(F.col("uid")))


def take_new(batch: DataFrame, old: DataFrame | None, budget: int) -> DataFrame:
    """Windows of a batch with ids that aren't stored, as many as each split and label still has room for.

    Which ones are taken when room is short is decided by id, so a repeated batch takes the same.
    """
    fresh = batch.dropDuplicates(["uid"])
    key = ["split", "label"]
    order = Window.partitionBy(*key).orderBy("uid")
    if old is None:
        return fresh.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= budget).drop("__rank")
    fresh = fresh.join(old.select("uid"), "uid", "left_anti")
    held = old.groupBy(*key).agg(F.count(F.lit(1)).alias("__held"))
    ranked = fresh.withColumn("__rank", F.row_number().over(order)).join(F.broadcast(held), key, "left")  # a row for each split and label
    return ranked.filter(F.col("__rank") + F.coalesce("__held", F.lit(0)) <= budget).drop("__rank", "__held")


def ingest(spark: SparkSession, source: str, out: str, checkpoint: str, budget: int = 1 << 40) -> StreamingQuery:
    """Starts reading new JSON files (content, label) of ``source`` and appending their windows to ``out``; ends when all are read.

    Each batch is written under its own number, replacing what a failed try left, so that
    a restart neither loses nor doubles rows.
    """

    def put(batch: DataFrame, number: int) -> None:
        old = None
        if exists(spark, out):
            held = spark.read.parquet(out)
            old = held.filter(F.col("batch") < number) if "batch" in held.columns else None
        new = take_new(windows_of(batch), old, budget)
        new.write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows = spark.readStream.schema("content string, label string").json(source)
    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
