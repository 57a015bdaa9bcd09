"""The annotation store as tables: latest rows, merging, browsing and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators import dense
from spanloom.operators.spans import SEGMENTS


def last_per_key(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key, as one aggregate: a key's rows never meet in one place."""
    names = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*names), order).alias("r")).select(key, "r.*")


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both, the newer one (by ``order``) where a key is in both."""
    return last_per_key(old.unionByName(new, allowMissingColumns=True), key, F.col(order))


def merge_stores(rows: DataFrame, source: str, row_id: str, created: str) -> DataFrame:
    """Rows that are equal in everything but their source, number and time become one.

    The first by (source, number) gives time and number; ``n_sources`` and ``sources`` say where it was found.
    """
    key = [c for c in rows.columns if c not in (source, row_id, created)]
    first = F.min(F.struct(source, row_id, created))
    out = rows.groupBy(*key).agg(first.alias("first"), F.count(F.lit(1)).alias("n_rows"), F.array_sort(F.collect_set(source)).alias("sources"))
    return out.select(*key, F.col(f"first.{source}").alias(source), F.col(f"first.{row_id}").alias(row_id), F.col(f"first.{created}").alias(created), "n_rows", "sources")


def rounds(rows: DataFrame) -> DataFrame:
    return rows.groupBy("round_id").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id"))


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of rows in order, at most 100, with the page's number held within what there is, and the totals.

    Only ``number * size`` rows are ever sorted in one place.
    """
    size = max(1, min(100, size))
    total = rows.agg(F.count(F.lit(1)).alias("total"), F.greatest(F.ceil(F.count(F.lit(1)) / size), F.lit(1)).cast("long").alias("pages"))
    cut = rows.orderBy(*order).offset((number - 1) * size).limit(size)
    return cut.crossJoin(F.broadcast(total))  # one row


def search(rows: DataFrame, fields: list[Column], token: str, most: int = 400) -> DataFrame:
    """Rows whose fields, cut and put together in lower case, hold the token."""
    line = F.lower(F.concat_ws(" ", *[F.substring(f.cast("string"), 1, most) for f in fields]))
    return rows.filter(F.instr(line, token.lower()) > 0)


def with_difference(rows: DataFrame, length: str, predicted: str, refined: str, name: str) -> DataFrame:
    """``rows`` with the share of places on which two JSON segment lists differ; null for an empty text.

    Labels are written as one character each while they are compared, by their place among
    the row's labels.
    """
    parse = lambda c: F.coalesce(F.from_json(c, SEGMENTS), F.from_json(F.lit("[]"), SEGMENTS))
    rows = rows.withColumn("__p", parse(F.col(predicted))).withColumn("__r", parse(F.col(refined)))
    rows = rows.withColumn("__names", F.array_distinct(F.transform(F.concat("__p", "__r"), lambda s: s["label"])))
    code = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.char(F.array_position("__names", s["label"]) + 64).alias("label"))
    for c in ("__p", "__r"):
        rows = rows.withColumn(c, dense.dense_of(F.transform(c, code), F.col(length), "-"))
    equal = F.size(F.filter(F.zip_with(dense.codes(F.col("__p")), dense.codes(F.col("__r")), lambda a, b: a == b), lambda x: x))
    return rows.withColumn(name, F.when(F.col(length) > 0, 1 - equal / F.col(length))).drop("__p", "__r", "__names")


def ranked_value(values: str, share: float) -> Column:
    """The value at place int(share * (n - 1)) of the sorted values, as an aggregate."""
    ordered = F.array_sort(F.collect_list(values))
    return F.get(ordered, F.floor(F.lit(share) * (F.size(ordered) - 1)).cast("int"))


def tiered_cost(tokens: Column, tiers: list[tuple[int | None, float]]) -> Column:
    """Price of tokens by tiers (size or None, price for a million); what is over the last tier costs as there."""
    cost, used = F.lit(0.0), 0
    for k, (size, rate) in enumerate(tiers):
        last = size is None or k == len(tiers) - 1
        part = F.greatest(tokens - used, F.lit(0)) if last else F.greatest(F.least(tokens - used, F.lit(size)), F.lit(0))
        cost = cost + part / 1_000_000 * rate
        used += size or 0
    return cost


def cumulative_share(df: DataFrame, value: str, name: str) -> DataFrame:
    """(value, n, share of rows at or under it), from counts of each value: the ordered pass sees distinct values only."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(value, "n", (upto / F.sum("n").over(Window.partitionBy())).alias(name))


def matrix(long: DataFrame, metric: str, model: str, value: str, models: list[str]) -> DataFrame:
    """A row for each metric, a column for each of the named models."""
    return long.groupBy(metric).pivot(model, models).agg(F.first(value))


def with_optimal(long: DataFrame, metric: str, optimal: str) -> DataFrame:
    """The greatest finite optimal value that any report names for each metric."""
    return long.groupBy(metric).agg(F.max(F.when(~F.isnan(optimal), F.col(optimal))).alias("optimal"))


def compare_reports(long: DataFrame, a: str, b: str, groups: dict[str, tuple[str, ...]]) -> DataFrame:
    """(name, a, b): values over optimal of two models for each metric, and the means of named groups of metrics.

    long: (metric, model, value, optimal). A metric that only one report holds is an error.
    """
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("value") / F.col("optimal")))
    both = long.filter(F.col("model").isin(a, b)).groupBy("metric").agg(pick(a).alias("a"), pick(b).alias("b"))
    lone = F.raise_error(F.concat(F.lit("only in one report: "), "metric")).cast("double")
    both = both.select(F.col("metric").alias("name"), F.when(F.col("a").isNull() != F.col("b").isNull(), lone).otherwise(F.col("a")).alias("a"), "b")
    named = F.explode(F.array(*[F.struct(F.lit(g).alias("group"), F.lit(m).alias("name")) for g, ms in groups.items() for m in ms])).alias("g")
    rows = both.sparkSession.range(1).select(named).select("g.group", "g.name") if groups else None
    if rows is None:
        return both
    means = both.join(F.broadcast(rows), "name").groupBy("group").agg(F.avg("a").alias("a"), F.avg("b").alias("b"))  # as many rows as metrics are named
    return both.unionByName(means.withColumnRenamed("group", "name"))
