"""Picking uncertain spans for review."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entropy(probs: Column) -> Column:
    """Entropy of a probability array, over the logarithm of its size; values are held above 1e-8 and made to sum to 1."""
    safe = F.transform(probs, lambda p: F.greatest(F.lit(1e-8), F.least(p, F.lit(1.0))))
    total = F.aggregate(safe, F.lit(0.0), lambda a, p: a + p)
    plain = F.aggregate(safe, F.lit(0.0), lambda a, p: a + p * F.log(p))
    return (F.log(total) - plain / total) / F.log(F.size(probs).cast("double"))


def peaked_entropy(q: Column, classes: int) -> Column:
    """``entropy`` of the distribution with q for one class and equal shares for the others."""
    rest = (1 - q) / (classes - 1)
    return -(q * F.log(q) + (1 - q) * F.log(rest)) / math.log(classes)


SPAN = "struct<score:double,start:int,end:int,boundary:int,entropy:double,flip_rate:double,left_label:string,right_label:string>"
#: The same fields for Arrow; spans stay in its columns, since a Python object for each would fill an executor.
FIELDS = {"score": pa.float64(), "start": pa.int32(), "end": pa.int32(), "boundary": pa.int32(), "entropy": pa.float64(), "flip_rate": pa.float64(), "left_label": pa.string(), "right_label": pa.string()}


def _scored(codes: np.ndarray, doubt: np.ndarray, radius: int, flip_weight: float, least: float, context: int, other: str | None) -> list[np.ndarray]:
    """FIELDS, labels as codes, of the spans around one row's boundaries, from prefix sums of entropies and of label changes."""
    n = len(codes)
    change = codes[1:] != codes[:-1]
    cuts = np.flatnonzero(change) + 1
    low, high = np.maximum(cuts - radius, 0), np.minimum(cuts + radius + 1, n)
    sums, flips = np.concatenate([[0.0], np.cumsum(doubt)]), np.concatenate([[0], np.cumsum(change)])
    mean = (sums[high] - sums[low]) / (high - low)
    rate = (flips[high - 1] - flips[low]) / np.maximum(high - low - 1, 1)
    score = mean + flip_weight * rate
    left, right = codes[cuts - 1], codes[cuts]
    if other is not None:
        score = np.where((left == ord(other)) | (right == ord(other)), 1 - mean, score)
    score = np.round(score, 6)
    keep = score >= least
    found = score, np.maximum(cuts - context, 0), np.minimum(cuts + context, n), cuts, np.round(mean, 6), np.round(rate, 6), left, right
    return [x[keep] for x in found]


def pick(score: np.ndarray, start: np.ndarray, end: np.ndarray, boundary: np.ndarray, most: int = 16, gap: int = 24) -> np.ndarray:
    """Which spans are taken by falling score (by place on a tie) unless one taken before is nearer than ``gap``; at most ``most``, by start."""
    left = np.lexsort((boundary, -score))
    taken = []
    while len(left) and len(taken) < most:
        taken.append(k := left[0])
        left = left[(end[left] + gap <= start[k]) | (end[k] + gap <= start[left])]
    return np.array(sorted(taken, key=lambda k: (start[k], boundary[k])), np.int64)


def _spans(labels: pa.Array, doubt: pa.Array, most: int | None, gap: int, *options) -> pa.Array:
    values = np.asarray(doubt.flatten(), float)
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(doubt), 0), np.int64))
    rows, at = [], 0
    for text, end in zip(labels.to_pylist(), ends):
        found = _scored(np.frombuffer((text or "").encode("utf-32-le"), np.uint32), values[at:end], *options)
        if most is not None:
            taken = pick(*found[:4], most, gap)
            found = [x[taken] for x in found]
        rows.append(found)
        at = end
    columns = []
    for parts, kind in zip(zip(*rows) if rows else [[]] * len(FIELDS), FIELDS.values()):
        flat = np.concatenate([*parts]) if len(parts) else np.zeros(0, np.uint32)
        if kind == pa.string():
            names, where = np.unique(flat, return_inverse=True)
            columns.append(pa.array([chr(c) for c in names], kind).take(pa.array(where)))
        else:
            columns.append(pa.array(flat).cast(kind))
    offsets = np.cumsum([0, *(len(r[0]) for r in rows)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, names=list(FIELDS)))


def candidates(df: DataFrame, labels: str, doubt: str, name: str, radius: int = 12, flip_weight: float = 0.6, least: float = 0.2, context: int = 250, other: str | None = None, most: int | None = None, gap: int = 24) -> DataFrame:
    """``df`` with a scored span around each boundary of the labels.

    doubt: an array of entropies, one for each place. A boundary's score is the mean
    entropy within ``radius``, plus ``flip_weight`` times the share of label changes there;
    beside ``other`` it is 1 less the mean entropy. Scores under ``least`` are dropped.
    With ``most`` only those that ``pick`` takes are kept. Null or empty labels have no spans.
    """

    @F.arrow_udf(f"array<{SPAN}>")
    def spans(labels: pa.Array, doubt: pa.Array) -> pa.Array:
        return _spans(labels, doubt, most, gap, radius, flip_weight, least, context, other)

    return df.withColumn(name, spans(labels, doubt))


def mix_share(stored: Column, full: int, most: float) -> Column:
    """Share of reviewed rows in training: grows with how many are stored, up to ``most``."""
    return F.least(F.lit(most), F.lit(most) * stored / full)


def scored(df: DataFrame, key: str, text: str, scorer: Callable[[str, object], np.ndarray]) -> DataFrame:
    """(key, text, labels, doubt): each character's likeliest class as a code from A on, and its entropy, by a plugged-in scorer."""
    kind = dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, t in zip(frame[key], frame[text]):
                if t:
                    p = np.clip(scorer(t, k), 1e-8, 1.0)
                    p = p / p.sum(axis=1, keepdims=True)
                    rows.append((k, t, "".join(chr(65 + c) for c in p.argmax(axis=1)), (-(p * np.log(p)).sum(axis=1) / np.log(p.shape[1])).tolist()))
            yield pd.DataFrame(rows, columns=[key, text, "labels", "doubt"])

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, {text} string, labels string, doubt array<double>")


def review_round(df: DataFrame, key: str, text: str, seen: DataFrame, scorer: Callable[[str, object], np.ndarray], round_id: str, requests: int, batch: int, most: int = 16) -> DataFrame:
    """Snippets to be reviewed in a round: (round_id, key, sample_hash, start, end, boundary, score, snippet).

    Texts whose hash is in ``seen`` (sample_hash) are left out and copies scored once.
    Their spans are picked, and of all the ``requests * batch`` with the highest scores
    kept, by key and place on a tie; only that many rows ever meet in one place.
    """
    rows = df.filter(F.length(text) > 0).withColumn("sample_hash", F.sha2(F.col(text), 256))
    first = rows.groupBy("sample_hash").agg(F.min(key).alias(key), F.first(text).alias(text))
    fresh = first.join(seen.select("sample_hash").distinct(), "sample_hash", "left_anti")
    found = candidates(scored(fresh, key, text, scorer), "labels", "doubt", "__spans", most=most)
    chosen = found.select(key, text, F.explode_outer("__spans").alias("s")).filter("s IS NOT NULL")
    snippet = F.substring(F.col(text), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    out = chosen.select(F.lit(round_id).alias("round_id"), key, F.sha2(F.col(text), 256).alias("sample_hash"), "s.start", "s.end", "s.boundary", "s.score", snippet.alias("snippet"))
    return out.orderBy(F.desc("score"), key, "boundary").limit(requests * batch)
