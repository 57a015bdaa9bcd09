"""Routing, splits, quotas and samples that depend on stable hashes alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.encoding import sha_number, sha_share
from spanloom.session import stored


def window_split(uid: Column) -> Column:
    """``train`` for 70 of 80 parts of the hash range, else ``val``."""
    return F.when(sha_number(uid) % 80 < 70, "train").otherwise("val")


def route(identity: Column) -> Column:
    """``window`` for 80 %, ``monitor`` for 10 %, else ``test``."""
    part = sha_number(identity) % 100
    return F.when(part < 80, "window").when(part < 90, "monitor").otherwise("test")


def quotas(counts: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """(key, quota): ``total`` shared by weight; what flooring leaves goes to the largest fractions, then by key.

    ``counts`` has a row for each class, so it is small by nature.
    """
    every = Window.partitionBy()
    share = F.col(weight) * F.lit(total) / F.sum(weight).over(every)
    rows = counts.withColumn("__share", share).withColumn("__floor", F.floor("__share").cast("long"))
    rows = rows.withColumn("__left", F.lit(total) - F.sum("__floor").over(every))
    rank = F.row_number().over(every.orderBy(F.desc(F.round(F.col("__share") - F.col("__floor"), 9)), key))
    return rows.select(key, (F.col("__floor") + F.when(rank <= F.col("__left"), 1).otherwise(0)).alias("quota"))


def percentile_sample(df: DataFrame, key: Column, share: float) -> DataFrame:
    """Rows whose key's hash falls into the first ``share`` of its range."""
    return df.filter(sha_share(key) < share)


def one_of_each(df: DataFrame, group: str, key: Column) -> DataFrame:
    """One row of each group, drawn by hash: the least hash wins, as a single aggregate."""
    names = [c for c in df.columns if c != group]
    return df.groupBy(group).agg(F.min_by(F.struct(*names), F.sha2(key, 256)).alias("r")).select(group, "r.*")


def before(df: DataFrame, group: str, order: Column, value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of its group that come before it in order.

    Rows are dealt into ranges of the order, summed inside each and moved by what earlier
    ranges of their group hold, so that a group of any size is many tasks' work. Rows that
    tie stand in any order; null orders come first; a null group is a group.
    """
    ranges = df.withColumn(name, value).repartitionByRange(order).withColumn("__part", F.spark_partition_id())
    rows = stored(ranges, "ranges")  # one frozen dealing for both readers
    earlier = (Window.unboundedPreceding, -1)
    here = F.sum(name).over(Window.partitionBy(group, "__part").orderBy(order).rowsBetween(*earlier))
    sums = rows.groupBy(group, "__part").agg(F.sum(name).alias("__sum"))  # a row for each group and range
    base = F.sum("__sum").over(Window.partitionBy(group).orderBy("__part").rowsBetween(*earlier))
    sums = sums.select(F.col(group).alias("__group"), F.col("__part").alias("__range"), F.coalesce(base, F.lit(0)).alias("__base"))
    rows = rows.withColumn(name, F.coalesce(here, F.lit(0)))
    out = rows.join(sums, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__range")))
    return out.withColumn(name, F.col(name) + F.col("__base")).select(*df.columns, name)


def round_robin(df: DataFrame, group: str, order: Column) -> DataFrame:
    """``df`` with ``round``: the n-th row of each group has round n."""
    return before(df, group, order, F.lit(1), "round").withColumn("round", (F.col("round") + 1).cast("int"))


def seeded_subset(df: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """``most`` rows drawn by the hash of seed and key, ordered by key; all rows if there are no more."""
    drawn = df.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256), key).limit(most)
    return drawn.orderBy(key)


def stratified_split(df: DataFrame, group: str, order: Column, first: int, second: int) -> DataFrame:
    """``df`` with ``part``: A for a group's first rows, B for the next; further rows are left out."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(order))
    rows = df.withColumn("__rank", rank).filter(F.col("__rank") <= first + second)
    return rows.withColumn("part", F.when(F.col("__rank") <= first, "A").otherwise("B")).drop("__rank")


def unseen(df: DataFrame, text: str, seen: DataFrame, most: int) -> DataFrame:
    """Rows whose text, cut to ``most`` characters, has a hash that isn't in ``seen`` (sha)."""
    return df.withColumn("sha", F.sha2(F.substring(text, 1, most), 256)).join(seen.select("sha").distinct(), "sha", "left_anti")


def full_cycle(index: Column, total: Column, start: int, step: int) -> Column:
    """The index-th place of a walk that visits all ``total`` places once, if step and total share no factor."""
    return F.pmod(F.lit(start) + F.lit(step) * index, total)


def pool_ranges(counts: DataFrame, key: str, n: str) -> DataFrame:
    """(key, first, last): the range of global row numbers of each dataset of a pool, in key order."""
    upto = F.sum(n).over(Window.partitionBy().orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(key, (upto - F.col(n)).alias("first"), upto.alias("last"))


def split_counts(total: int, shares: dict[str, float]) -> dict[str, int]:
    """``total`` dealt by share, rounded down; what is left goes one by one in the splits' order."""
    total = max(0, total)
    out = {name: int(total * share) for name, share in shares.items()}
    left = total - sum(out.values())
    return {name: n + left // len(out) + (k < left % len(out)) for k, (name, n) in enumerate(out.items())} if out else {}


def shortfall(target: dict[str, int], held: dict[str, int]) -> dict[str, int]:
    return {name: max(0, max(0, n) - max(0, held.get(name, 0))) for name, n in target.items()}


def weighted_choice(key: Column, weights: dict[str, float]) -> Column:
    """One of the names, drawn by the key's hash with the given weights (any sum)."""
    total, upto, out = sum(max(0.0, w) for w in weights.values()), 0.0, None
    share = sha_share(key)
    for name, w in weights.items():
        upto += max(0.0, w) / total
        out = F.when(share < upto, name) if out is None else out.when(share < upto, name)
    return out.otherwise(list(weights)[-1])
