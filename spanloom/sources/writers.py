"""Writers of corpus windows, evaluation sets, manifests and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_windows(df: DataFrame, out: str, mode: str = "append") -> None:
    """Rows under split and label folders; the job's commit makes all of them visible at once."""
    df.write.mode(mode).partitionBy("split", "label").parquet(out)


def replace_table(df: DataFrame, out: str) -> None:
    """Puts a table in another's place: it is written beside it first, and the old one kept as a backup until then."""
    spark = df.sparkSession
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    new, old = f"{out}.new-{uuid.uuid4().hex}", f"{out}.old-{uuid.uuid4().hex}"
    df.write.parquet(new)
    fs = path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    had = fs.exists(path(out))
    if had and not fs.rename(path(out), path(old)):
        raise OSError(f"{out} could not be moved")
    if not fs.rename(path(new), path(out)):
        if had:
            fs.rename(path(old), path(out))
        raise OSError(f"{new} could not be moved to {out}")
    if had:
        fs.delete(path(old), True)


def write_examples(df: DataFrame, out: str, overwrite: bool = False) -> int:
    """Writes evaluation examples and gives their number."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(out)
    return df.sparkSession.read.parquet(out).count()


def manifest(examples: DataFrame) -> DataFrame:
    """Examples, characters and labels of each task."""
    labels = F.array_distinct(F.flatten(F.collect_set(F.transform("segments", lambda s: s["label"]))))
    return examples.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("n_chars"), F.array_sort(labels).alias("labels"))


def example_id(task: str, lang: str, index: str, content: str) -> Column:
    """task-lang-number-hash."""
    return F.concat_ws("-", task, lang, F.lpad(F.col(index).cast("string"), 5, "0"), F.substring(F.sha2(F.col(content), 256), 1, 16))
