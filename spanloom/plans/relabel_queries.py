"""Queries on relabelling rounds and seeded subsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import relabel, sampling, spans
from spanloom.session import table

HEAD = "---\nkey: value\n"
CLOSINGS = ("---\n", "...\n", "")


def guarded_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents behind front matter that is closed in one of two ways or not at all; the first half of each is called yaml."""
    closing = F.get(F.array(*map(F.lit, CLOSINGS)), F.pmod("doc_id", F.lit(len(CLOSINGS))).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(HEAD), closing, F.coalesce("text", F.lit(""))).alias("t"))
    half, n = F.floor(F.length("t") / 2), F.length("t")
    docs = docs.withColumn("s", F.array(spans.segment(F.lit(0), half, F.lit("yaml")), spans.segment(half, n, F.lit("markdown"))))
    return docs.select("doc_id", relabel.frontmatter_end(F.col("t")).alias("closed"), spans.joined(relabel.frontmatter_guard(F.col("s"), F.col("t"))).alias("segments"))


def relabel_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files and their turns as chunks, whose states go by number."""
    k = F.pmod(F.col("conv_id") * 7 + F.col("turn") * 3, F.lit(23))
    state = F.when(k == 0, "skipped_parse_failed").when(k == 1, "skipped_missing").when(k == 2, "cached").when(k != 3, "model")
    turns = table(spark, sf_dir, "conversations").select("conv_id", state.alias("state"), (k > 4).alias("answered"))
    return relabel.file_verdicts(turns, "conv_id", "state", "answered")


def last_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of conversations: each turn's text, then a summary over three lines; the last one is read."""
    line = F.concat(F.lit("said "), F.length(F.coalesce("text", F.lit(""))).cast("string"), F.lit('\n{\n  "turn": '), F.col("turn").cast("string"), F.lit("\n}\ndone"))
    logs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("log"))
    return logs.select("conv_id", F.get_json_object(relabel.last_json("log"), "$.turn").cast("long").alias("turn"))


def seeded_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 documents drawn by seed, in the table's order."""
    return sampling.seeded_subset(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 100, 7)


QUERIES = {f.__name__: f for f in (guarded_frontmatter, relabel_verdicts, last_summary, seeded_subset)}

ORACLE_SQL = {
    "guarded_frontmatter": r"""
        WITH d AS (SELECT doc_id, '---' || chr(10) || 'key: value' || chr(10) || CASE doc_id % 3 WHEN 0 THEN '---' || chr(10) WHEN 1 THEN '...' || chr(10) ELSE '' END || coalesce(text, '') AS t FROM documents),
        p AS (SELECT doc_id, length(t) AS n, length(t) // 2 AS h, strpos(substr(t, 5), chr(10) || '---' || chr(10)) AS a, strpos(substr(t, 5), chr(10) || '...' || chr(10)) AS b FROM d),
        e AS (SELECT *, CASE WHEN a > 0 THEN a + 8 WHEN b > 0 THEN b + 8 END::INTEGER AS closed FROM p)
        SELECT doc_id, closed, CASE WHEN closed < n AND h > closed THEN '0:' || closed || ':yaml,' || closed || ':' || n || ':markdown' ELSE '0:' || h || ':yaml,' || h || ':' || n || ':markdown' END AS segments FROM e""",
    "relabel_verdicts": """
        WITH k AS (SELECT conv_id, (conv_id * 7 + turn * 3) % 23 AS k FROM conversations)
        SELECT conv_id, count(*) AS n_chunks, CASE WHEN bool_or(k = 0) THEN 'parse_failed' WHEN bool_or(k IN (1, 3)) THEN 'missing' WHEN bool_or(k = 2) THEN 'unexpected_non_model' WHEN bool_or(k <= 4) THEN 'missing' END AS reason
        FROM k GROUP BY conv_id""",
    "last_summary": "SELECT conv_id, max(turn)::BIGINT AS turn FROM conversations GROUP BY conv_id",
    "seeded_subset": "SELECT doc_id, lang FROM documents ORDER BY sha256('7:' || doc_id), doc_id LIMIT 100",
}
