"""Scores of predicted labels over whole texts, regions and neighbourhoods.

Labels stay in the row as strings with one code for each character. What is counted is
counted there by numpy, a row at a time, so that a text never becomes rows of characters:
a row for each pair of labels or each region is all that leaves it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

SPACE = "W"
#: A region counts as found when this part of its valid places is.
FOUND = 0.5


def _codes(labels: str | None) -> np.ndarray:
    return np.frombuffer((labels or "").encode("latin-1"), np.uint8)


def _near_changes(codes: np.ndarray, places: np.ndarray, n: int, radius: int) -> np.ndarray:
    """Which of n places lie in [b - radius, b + radius) of a change between consecutive ``places``."""
    change = places[1:][codes[places][1:] != codes[places][:-1]]
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.maximum(change - radius, 0), 1)
    np.add.at(edge, np.minimum(change + radius, n), -1)
    return np.cumsum(edge[:-1]) > 0


def counted(df: DataFrame, truth: str, pred: str, *keys: str, valid: bool = False, near: int = 0, over_valid: bool = False) -> DataFrame:
    """(keys, truth, pred, n): the confusion of two label strings of equal length, added up by keys.

    valid: places whose truth is white space don't count. near: only places within that
    many of a change of the truth count; over_valid: a change between consecutive valid
    places, white space between them left out. Null or empty labels count nothing.
    """
    schema = ", ".join([*(f"`{k}` {t}" for k, t in df.select(*keys).dtypes), "truth string, pred string, n long"])
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pairs, counts = [], [], []
            for i, (t, p) in enumerate(zip(batch.column(width).to_pylist(), batch.column(width + 1).to_pylist())):
                t, p = _codes(t), _codes(p)
                if not len(t):
                    continue
                use = t != ord(SPACE) if valid else np.ones(len(t), bool)
                if near:
                    places = np.flatnonzero(use) if over_valid else np.arange(len(t))
                    use = use & _near_changes(t, places, len(t), near)
                found = np.bincount(t[use].astype(np.int64) << 8 | p[use], minlength=1)
                some = np.flatnonzero(found)
                rows += [i] * len(some)
                pairs += some.tolist()
                counts += found[some].tolist()
            where = pa.array(rows, pa.int64())
            labels = [pa.array([chr(x >> 8) for x in pairs], pa.string()), pa.array([chr(x & 255) for x in pairs], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(where) for k in range(width)), *labels, pa.array(counts, pa.int64())], names=[*keys, "truth", "pred", "n"])

    return df.select(*keys, truth, pred).mapInArrow(run, schema).groupBy(*keys, "truth", "pred").agg(F.sum("n").alias("n"))


REGIONS = "array<struct<start:int,end:int,label:string,host:string>>"


def region_counts(df: DataFrame, truth: str, pred: str, regions: str, text: str, *keys: str) -> DataFrame:
    """(keys, region, start, end, label, total, exact, other, text, other_all) for each region of each row.

    regions: an array of REGIONS. total: places in it whose truth isn't white space; of
    those, exact: predicted as its label (as their truth where that is null); other: not
    as its host; text: as the code ``text``. other_all: such places outside the host's
    label in the whole row. Regions are clipped to the text.
    """
    schema = ", ".join([*(f"`{k}` {t}" for k, t in df.select(*keys).dtypes), "region int, start int, end int, label string, total long, exact long, other long, text long, other_all long"])
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where, out = [], []
            for i, (t, p, found) in enumerate(zip(*(batch.column(width + k).to_pylist() for k in range(3)))):
                if not found:
                    continue
                t, p = _codes(t), _codes(p)
                valid = t != ord(SPACE)
                sums = lambda x: np.concatenate([[0], np.cumsum(x)])
                total, right, said = sums(valid), sums(valid & (t == p)), {}
                for k, r in enumerate(found):
                    for c in (r["label"], r["host"], text):
                        if c and c not in said:
                            said[c] = sums(valid & (p == ord(c)))
                    a, b = max(0, min(r["start"], len(t))), max(0, min(r["end"], len(t)))
                    b = max(a, b)
                    count = lambda s: int(s[b] - s[a])
                    n = count(total)
                    exact = count(said[r["label"]]) if r["label"] else count(right)
                    other = n - count(said[r["host"]]) if r["host"] else n
                    other_all = int(total[-1] - said[r["host"]][-1]) if r["host"] else int(total[-1])
                    where.append(i)
                    out.append((k, a, b, r["label"], n, exact, other, count(said[text]), other_all))
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 5]
            at = pa.array(where, pa.int64())
            columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 9, kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(width)), *columns], names=[*keys, "region", "start", "end", "label", "total", "exact", "other", "text", "other_all"])

    return df.select(*keys, truth, pred, F.col(regions).cast(REGIONS)).mapInArrow(run, schema)


def found(part: str | Column, total: str = "total") -> Column:
    """Whether at least half of a region's valid places count; an empty region isn't found."""
    part = F.col(part) if isinstance(part, str) else part
    return (F.col(total) > 0) & (part >= FOUND * F.col(total))


def share(part: str, total: str = "total") -> Column:
    return F.when(F.col(total) > 0, F.col(part) / F.col(total)).otherwise(0.0)


def iou() -> Column:
    """Places of a region not predicted as its host, over those and the rest of either."""
    both = F.col("total") + F.col("other_all") - F.col("other")
    return F.when(both > 0, F.col("other") / both).otherwise(0.0)


def text_like(matrix: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """(truth, pred, n): a confusion in which each label is told only as one of ``labels`` or not."""
    kind = lambda c: F.when(F.col(c).isin(*labels), "text").otherwise("rest")
    return matrix.groupBy(kind("truth").alias("truth"), kind("pred").alias("pred")).agg(F.sum("n").alias("n"))


def merged(*matrices: DataFrame) -> DataFrame:
    """(truth, pred, n): the sum of confusions over all their labels."""
    out = matrices[0].select("truth", "pred", "n")
    for m in matrices[1:]:
        out = out.unionByName(m.select("truth", "pred", "n"))
    return out.groupBy("truth", "pred").agg(F.sum("n").alias("n"))


def mistakes(matrix: DataFrame, other: str) -> DataFrame:
    """(truth, n, accuracy, pred, share): each truth's accuracy, and its wrong labels' shares of it; ``other`` left out of both sides."""
    rows = matrix.filter((F.col("truth") != other) & (F.col("pred") != other))
    sums = rows.groupBy("truth").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("right"))
    wrong = rows.filter("truth != pred")
    return sums.join(wrong, "truth", "left").select("truth", "total", (F.col("right") / F.col("total")).alias("accuracy"), "pred", (F.col("n") / F.col("total")).alias("share"))


def host_purity(matrix: DataFrame, doc: str, host: str) -> DataFrame:
    """(host, n_docs, perfect, half_wrong): documents of each host without a mistake, and with at most half of their places wrong."""
    docs = matrix.groupBy(doc, host).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") != F.col("pred"), F.col("n")).otherwise(0)).alias("wrong"))
    return docs.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.sum((F.col("wrong") == 0).cast("long")).alias("perfect"), F.sum((2 * F.col("wrong") <= F.col("n")).cast("long")).alias("half_wrong"))


def open_set(matrix: DataFrame, other: str, *keys: str) -> DataFrame:
    """(keys, tp, fp, fn, tn, too_often, too_little) for the label ``other``, 0 where a rate is undefined."""
    cell = lambda t, p: F.sum(F.when(((F.col("truth") == other) == t) & ((F.col("pred") == other) == p), F.col("n")).otherwise(0))
    sums = matrix.groupBy(*keys).agg(cell(True, True).alias("tp"), cell(False, True).alias("fp"), cell(True, False).alias("fn"), cell(False, False).alias("tn"))
    rate = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b))).otherwise(0.0)
    return sums.select(*keys, "tp", "fp", "fn", "tn", rate("fp", "tn").alias("too_often"), rate("fn", "tp").alias("too_little"))


def length_summary(df: DataFrame, length: Column, host: str, *keys: str) -> DataFrame:
    """(keys, n, median, p95, longest, n_hosts): the values at places n // 2 and max(int(.95 n) - 1, 0) of all lengths in order.

    Lengths are counted first, so that a group's ordered places are read from its distinct lengths.
    """
    from pyspark.sql import Window

    sizes = df.select(*keys, length.cast("long").alias("len")).groupBy(*keys, "len").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy("len")
    upto = sizes.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("len")))
    out = upto.groupBy(*keys).agg(
        F.max("all").alias("n"), at(F.floor(F.col("all") / 2)).alias("median"), at(F.greatest(F.floor(F.col("all") * 0.95) - 1, F.lit(0))).alias("p95"), F.max("len").alias("longest")
    )
    hosts = df.groupBy(*keys).agg(F.count_distinct(host).alias("n_hosts"))
    same = [out[k].eqNullSafe(hosts[k]) for k in keys]
    return out.join(hosts, same).select(*(out[k] for k in keys), "n", "median", "p95", "longest", "n_hosts")


def byte_votes(text: str | None, labels: str) -> str:
    """A label for each character from one for each byte of its UTF-8: the most frequent, the smallest of a tie."""
    out, at = [], 0
    for c in text or "":
        n = len(c.encode("utf-8", "surrogatepass"))
        mine = labels[at : at + n]
        out.append(mine[0] if n == 1 or mine == mine[0] * n else min(set(mine), key=lambda x: (-mine.count(x), x)))
        at += n
    return "".join(out)


@F.pandas_udf(StringType())
def char_labels(text, labels):
    """Byte labels as labels of characters; null texts have none."""
    import pandas as pd

    return pd.Series([byte_votes(t, b or "") for t, b in zip(text, labels)])


@F.pandas_udf(ArrayType(DoubleType()))
def char_means(text, values):
    """A mean for each character of the values of its bytes."""
    import pandas as pd

    out = []
    for t, v in zip(text, values):
        sizes = np.fromiter((len(c.encode("utf-8", "surrogatepass")) for c in t or ""), np.int64)
        ends = np.cumsum(sizes)
        sums = np.concatenate([[0.0], np.cumsum(np.asarray(v, float))]) if len(sizes) else np.zeros(1)
        out.append((sums[ends] - sums[ends - sizes]) / np.maximum(sizes, 1))
    return pd.Series(out)


def routed(probs: Column, routes: dict[str, list[int]]) -> Column:
    """A struct with the share of each route: its classes' probabilities added up, over the sum of all."""
    sums = {r: sum((F.get(probs, k) for k in ks), F.lit(0.0)) for r, ks in routes.items()}
    total = sum(sums.values(), F.lit(0.0))
    return F.struct(*[F.when(total > 0, s / total).otherwise(0.0).alias(r) for r, s in sums.items()])


def recurrence(values: Column, decay: Column) -> Column:
    """The last state of h = decay * h + value from 0 over an array."""
    return F.aggregate(values, F.lit(0.0), lambda h, x: decay * h + x)


def thresholds(counts: dict[str, list[tuple[int, int]]], grid: list[float]) -> dict[str, float]:
    """A threshold for each label by greedy search: one label's is moved at a time, to the grid's value of the best F1 of all, until none gains.

    counts: for each label, (right, wrong) answers at or above each threshold of the grid,
    and ``("", [(all, 0)])`` the number of all true places.
    """
    every = counts[""][0][0]
    chosen = {k: 0 for k in counts if k}

    def f1(pick: dict[str, int]) -> float:
        right, wrong = (sum(counts[k][i][j] for k, i in pick.items()) for j in (0, 1))
        return 2 * right / (right + wrong + every) if right + wrong + every else 0.0

    best = f1(chosen)
    while True:
        moves = [(f1(chosen | {k: i}), k, i) for k in sorted(chosen) for i in range(len(grid))]
        top = max(moves, key=lambda m: (m[0], -m[2]), default=(0.0, "", 0))
        if top[0] <= best + 1e-12:
            return {k: grid[i] for k, i in sorted(chosen.items())}
        best, chosen[top[1]] = top[0], top[2]
