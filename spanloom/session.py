"""Session helpers shared by the library."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session leaves it unset (tests on one machine) a temporary folder
    of this machine is chosen once and remembered in the session.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spanloom.local.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spanloom.local.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage, survives lost executors, and makes later passes see one
    frozen copy. The folder is deleted by ``discard``, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanloom-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    out = spark.read.schema(schema).parquet(path)
    out.spanloom_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more; any other table is left alone.

    The collectors are run too, so that Spark also drops the shuffle files of plans that
    are no longer referred to.
    """
    for df in tables:
        path = getattr(df, "spanloom_path", None)
        if path:
            spark = df.sparkSession
            jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
            gc.collect()
            spark._jvm.System.gc()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, unless their path holds it anyway."""
    root = Path(__file__).resolve().parents[1]
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if app in _shipped or root in known or Path.cwd() == root:
        return
    folder = tempfile.mkdtemp(prefix="spanloom-code-")  # read by the driver alone, which serves it
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/spanloom", "zip", root, "spanloom"))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its scan has fewer parts than there are cores, as one small file has.

    For work that costs far more than moving its input. A scan with enough parts, as any
    large table has, is left as it is and nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
