"""Confusions and what is computed from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators import dense


def places(df: DataFrame, truth: str, pred: str, *keys: str) -> DataFrame:
    """(keys, pos, truth, pred): a row for each place; exploded inside the task, for a partial aggregate right above."""
    return df.select(*keys, F.explode_outer(dense.pairs_of(truth, pred)).alias("x")).filter("x IS NOT NULL").select(*keys, "x.pos", "x.truth", "x.pred")


def confusion(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys, "truth", "pred").agg(F.count(F.lit(1)).alias("n"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def per_class(matrix: DataFrame, *keys: str) -> DataFrame:
    """(keys, label, support, precision, recall, f1) for each label that is truth or prediction; 0 where undefined."""
    sides = matrix.select(*keys, F.explode(F.array(
        F.struct(F.col("truth").alias("label"), "n", F.lit(0).cast("long").alias("guessed"), F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("n"), F.col("n").alias("guessed"), F.lit(0).cast("long").alias("hit")),
    )).alias("s")).select(*keys, "s.*")
    sums = sides.groupBy(*keys, "label").agg(F.sum("n").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit"))
    p, r = ratio(F.col("hit"), F.col("guessed")), ratio(F.col("hit"), F.col("support"))
    return sums.select(*keys, "label", "support", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "hit", "guessed")


def overall(classes: DataFrame, *keys: str) -> DataFrame:
    """(keys, accuracy, macro_precision, macro_recall, macro_f1, weighted_f1); macro means are over labels with support."""
    present = F.col("support") > 0
    mean = lambda c: F.coalesce(F.avg(F.when(present, F.col(c))), F.lit(0.0))
    total = F.sum("support")
    return classes.groupBy(*keys).agg(
        ratio(F.sum("hit"), total).alias("accuracy"), mean("precision").alias("macro_precision"), mean("recall").alias("macro_recall"),
        mean("f1").alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), total).alias("weighted_f1"),
    )


def top_confusions(matrix: DataFrame, k: int = 3) -> DataFrame:
    """(truth, pred, n, share, rank): the k most frequent wrong predictions of each truth, by n then name."""
    row = Window.partitionBy("truth")
    order = row.orderBy(F.desc("n"), "pred")
    shares = matrix.withColumn("share", ratio(F.col("n"), F.sum("n").over(row))).filter("truth != pred")
    return shares.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("truth", "pred", "n", "share", "rank")


def with_near_boundary(df: DataFrame, truth: str, radius: int, name: str) -> DataFrame:
    """``df`` with an array that says of each place whether it lies in [b - radius, b + radius) of a boundary b.

    It does if its neighbourhood of ``radius`` places either way isn't all one label.
    """
    df = df.withColumn("__codes", dense.codes(F.col(truth)))
    last = F.size("__codes") - 1

    def near(c: Column, i: Column) -> Column:
        return F.exists(F.sequence(F.greatest(i - radius, F.lit(0)), F.least(i + radius, last)), lambda k: F.get("__codes", k) != c)

    return df.withColumn(name, F.transform("__codes", near)).drop("__codes")


def threshold_sweep(rows: DataFrame, score: str, positive: str, grid: list[float]) -> DataFrame:
    """(tau, tp, fp, fn, tn, precision, recall, specificity, f1, balanced) for each threshold of a fixed grid.

    Rows are aggregated once by how many thresholds they reach; sums over that few-row table give every threshold.
    """
    reach = sum((F.when(F.col(score) >= t, 1).otherwise(0) for t in sorted(grid)), F.lit(0))
    steps = rows.select(reach.alias("reach"), F.col(positive).cast("boolean").alias("yes")).groupBy("reach", "yes").agg(F.count(F.lit(1)).alias("n"))
    taus = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("tau"), F.lit(i + 1).alias("at")) for i, t in enumerate(sorted(grid))])).alias("t")
    cells = steps.select("reach", "yes", "n", taus).select("t.tau", (F.col("reach") >= F.col("t.at")).alias("said"), "yes", "n")
    count = lambda said, yes: F.sum(F.when((F.col("said") == said) & (F.col("yes") == yes), F.col("n")).otherwise(0))
    out = cells.groupBy("tau").agg(count(True, True).alias("tp"), count(True, False).alias("fp"), count(False, True).alias("fn"), count(False, False).alias("tn"))
    p, r, s = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn")), ratio(F.col("tn"), F.col("tn") + F.col("fp"))
    return out.select("tau", "tp", "fp", "fn", "tn", p.alias("precision"), r.alias("recall"), s.alias("specificity"), ratio(2 * p * r, p + r).alias("f1"), ((r + s) / 2).alias("balanced"))
