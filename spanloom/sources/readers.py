"""Readers of texts, caches, snapshots and annotated files. All go through Spark's own readers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException
from pyspark.sql.types import StructType

from spanloom.functions.text import TEXT_FIELDS, primary_text
from spanloom.operators import store

#: Labels that are stored under several names.
FAMILY_DIRS = {"c_family": ("c_family", "c", "cpp"), "javascript_typescript": ("javascript_typescript", "javascript", "typescript")}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store Spark reads it from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def first_existing(spark: SparkSession, candidates: Iterable[str]) -> str:
    """The first candidate that exists; an error names all if none does."""
    candidates = list(candidates)
    for path in candidates:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {candidates}")


def language_source(spark: SparkSession, candidates: Iterable[str], shard: int = 0, shards: int = 1, skip: int = 0, key: str = "id") -> DataFrame:
    """Rows of the first existing folder, of one shard by hash of the key, in a stable mixed order; ``skip`` rows of it left out.

    ``_source`` names the folder. Without ``skip`` nothing is sorted.
    """
    path = first_existing(spark, candidates)
    mixed = F.xxhash64(F.col(key).cast("string"), F.lit(42))
    rows = spark.read.parquet(path).filter(F.pmod(mixed, F.lit(shards)) == shard).withColumn("_source", F.lit(path))
    return rows.orderBy(mixed, key).offset(skip) if skip else rows


def combined_sources(parts: dict[str, DataFrame], key: str) -> DataFrame:
    """Rows of several sources one after the other, in rounds: ``round`` and ``place`` give the order."""
    from spanloom.operators.sampling import round_robin

    out = None
    for place, (name, df) in enumerate(parts.items()):
        part = df.withColumn("_source", F.lit(name)).withColumn("place", F.lit(place))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return round_robin(out, "_source", F.col(key))


def label_rows(spark: SparkSession, root: str, split: str, label: str) -> DataFrame:
    """Rows under ``root/split/label/dataset``, or of all names that the label has been stored under."""
    paths = [f"{root}/{split}/{name}/dataset" for name in FAMILY_DIRS.get(label, (label,))]
    found = [p for p in paths if exists(spark, p)]
    if not found:
        raise FileNotFoundError(f"none of {paths}")
    out = spark.read.parquet(found[0])
    for p in found[1:]:
        out = out.unionByName(spark.read.parquet(p), allowMissingColumns=True)
    return out


def web_texts(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (gz or not) with the first text field that isn't blank as ``content``; rows without one are dropped."""
    schema = StructType()
    for name in TEXT_FIELDS:
        schema.add(name, "string")
    rows = spark.read.schema(schema).json(path)
    return rows.select(primary_text({n: F.col(n) for n in TEXT_FIELDS}).alias("content")).filter("content IS NOT NULL")


def cache_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """The last line of each key of an append-only JSON lines cache; blank and broken lines and lines without a key are dropped."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_line"), F.col("_metadata.file_path").alias("_file"))
    rows = lines.select("_file", "_line", F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r")).select("_file", "_line", "r.*")
    rows = rows.filter(F.col("_bad").isNull() & F.col(key).isNotNull()).drop("_bad")
    return store.last_per_key(rows, key, F.struct("_file", "_line")).drop("_file", "_line")


def snapshots(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """One row for each JSON file of a tree, with its path; a broken file gives a row with ``error`` instead of a failure."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return rows.select("path", "r.*").withColumn("error", F.when(F.col("_bad").isNotNull(), "not readable as JSON")).drop("_bad")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): each file as one text; bytes that aren't UTF-8 become the replacement mark."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def annotated_files(files: DataFrame, segments: DataFrame, names: dict[int, str]) -> DataFrame:
    """(file_id, text, segments) from files (file_id, content binary) and their segments (file_id, start, end, label number).

    Contents hold one byte for each character. Numbers without a name are dropped; a file
    without segments has an empty list.
    """
    label = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("label")]
    known = segments.withColumn("label", label).filter("label IS NOT NULL")
    lists = known.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("segments"))
    empty = F.array().cast("array<struct<start:int,end:int,label:string>>")
    out = files.select("file_id", F.decode("content", "ISO-8859-1").alias("text")).join(lists, "file_id", "left")
    return out.withColumn("segments", F.coalesce(F.col("segments").cast("array<struct<start:int,end:int,label:string>>"), empty))


def unmatched(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys that are found but not known: an inventory's contract holds if there is none."""
    return found.select(key).distinct().join(known.select(key), key, "left_anti")


def matches(name: Column, accepted: tuple[str, ...]) -> Column:
    return F.lower(F.trim(name)).isin(*accepted)


def compatible_stores(spark: SparkSession, root: str, columns: tuple[str, ...]) -> list[str]:
    """Tables under a folder that have all of the columns, by path; plain files and folders without a table are passed over."""
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = []
    for status in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p):
        if not status.isDirectory():
            continue
        path = status.getPath().toString()
        try:
            names = spark.read.parquet(path).columns
        except AnalysisException:
            continue
        if set(columns) <= set(names):
            found.append(path)
    return sorted(found)
