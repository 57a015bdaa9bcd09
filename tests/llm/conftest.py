from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

from conftest_helpers import DOC_SCHEMA  # noqa: E402


@pytest.fixture(scope="session")
def frame(spark, tmp_path_factory):
    """Makes a table on disk from rows; extra columns' names clash with those that operators add."""

    def make(rows, schema=DOC_SCHEMA, extra=True, partitions=3):
        from pyspark.sql import functions as F

        path = str(tmp_path_factory.mktemp("rows") / "t.parquet")
        df = spark.createDataFrame(rows, schema)
        if extra:
            for name in ("fp", "component_id", "term", "h", "block", "words", "host", "kept", "node", "wid"):
                df = df.withColumn(name, F.lit(f"own {name}"))
        df.repartition(partitions).write.parquet(path)
        return spark.read.parquet(path)

    return make
