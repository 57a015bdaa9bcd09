"""Scores of whole files: boundaries, transitions, and recovery of guest content."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators import dense
from spanloom.operators.metrics import ratio
from spanloom.operators.postprocess import edges, transition_match

# Classes that may be guests, encodings among them, and what each carrier holds anyway.
GUESTS = ("html", "css", "javascript", "xml/svg", "powershell", "vbscript", "shell", "python", "sql", "php", "base64", "hex")
ENCODINGS = ("base64", "hex")
EXPECTED = {
    "HTA": ("html", "css", "javascript", "xml/svg"), "HTML": ("html", "css", "javascript", "xml/svg"), "JavaScript": ("javascript",), "PHP": ("php", "html", "css", "javascript", "sql"),
    "PowerShell": ("powershell",), "Python": ("python",), "SVG/XML": ("xml/svg", "html", "css", "javascript"), "Shell script": ("shell",), "VBScript": ("vbscript",),
    "Windows Script File": ("xml/svg", "javascript", "vbscript"), "Windows command script": ("shell",),
}


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def exact_boundaries(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """(n_true, n_pred, n_both, precision, recall, f1) of boundary places over all rows."""
    rows = dense.with_runs(dense.with_runs(df, truth, "__t"), pred, "__p")
    places = lambda c: F.slice(F.transform(c, lambda r: r["start"]), F.lit(2), F.greatest(F.size(c), F.lit(1)))
    rows = rows.select(places("__t").alias("t"), places("__p").alias("p"))
    sums = rows.agg(*[F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long").alias(n) for n, c in (("n_true", F.col("t")), ("n_pred", F.col("p")), ("n_both", F.array_intersect("t", "p")))])
    p, r = ratio(F.col("n_both"), F.col("n_pred")), ratio(F.col("n_both"), F.col("n_true"))
    return sums.select("n_true", "n_pred", "n_both", p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"))


def near_matches(truth: list[int], pred: list[int], tolerance: int) -> int:
    """Predicted places, in order, each matched with the nearest true one within the tolerance that is still free, the earlier on a tie."""
    free = np.ones(len(truth), bool)
    hits = 0
    for p in pred:
        k = bisect_left(truth, p - tolerance)
        near = []
        while k < len(truth) and truth[k] <= p + tolerance:
            if free[k]:
                near.append((abs(truth[k] - p), k))
            k += 1
        if near:
            free[min(near)[1]] = False
            hits += 1
    return hits


def near_boundaries(df: DataFrame, key: str, truth: str, pred: str, tolerance: int = 4) -> DataFrame:
    """(key, n_true, n_pred, n_near, n_same_pair) for each row: boundaries within the tolerance, and those with the same two labels."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, t, p in zip(frame[key], frame[truth], frame[pred]):
                a, b = (np.frombuffer((x or "").encode("ascii"), np.uint8) for x in (t, p))
                want, got = edges(a)[1:-1].tolist(), edges(b)[1:-1].tolist()
                rows.append((k, len(want), len(got), near_matches(want, got, tolerance), transition_match(a, b, tolerance)[0]))
            yield pd.DataFrame(rows, columns=[key, "n_true", "n_pred", "n_near", "n_same_pair"])

    kind = dict(df.dtypes)[key]
    return df.select(key, truth, pred).mapInPandas(run, f"{key} {kind}, n_true long, n_pred long, n_near long, n_same_pair long")


def guest_recovery(segments: DataFrame, carrier: str, *keys: str) -> DataFrame:
    """(keys, guests, recovered, encodings, encodings_recovered) of true segments (class, size, hits, carrier).

    A guest is a segment of a tracked class that its carrier doesn't hold anyway; it is
    recovered if at least half of its places are predicted as its class.
    """
    table = F.create_map(*[x for name, held in EXPECTED.items() for x in (F.lit(name), F.array(*map(F.lit, held)))])
    usual = F.coalesce(F.array_contains(table[F.col(carrier)], F.col("class")), F.lit(False))
    guest = F.col("class").isin(*GUESTS) & ~usual
    found = guest & (F.col("hits") * 2 >= F.col("size")) & (F.col("size") > 0)
    code = F.col("class").isin(*ENCODINGS)
    count = lambda c: F.sum(c.cast("long"))
    return segments.groupBy(*keys).agg(count(guest).alias("guests"), count(found).alias("recovered"), count(guest & code).alias("encodings"), count(found & code).alias("encodings_recovered"))
