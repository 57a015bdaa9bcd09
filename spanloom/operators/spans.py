"""Algebra of segments: arrays of (start, end, label) inside a row, end exclusive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEGMENTS = "array<struct<start:int,end:int,label:string>>"


def segment(start: Column, end: Column, label: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), label.alias("label"))


def merge_adjacent(segments: Column, overlap: bool = False) -> Column:
    """Neighbours of one label that touch (or overlap) become one; segments are taken by start."""
    ordered = F.array_sort(segments)

    def add(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        fits = (F.size(acc) > 0) & (last["label"] == s["label"])
        meets = (s["start"] <= last["end"]) if overlap else (s["start"] == last["end"])
        joined = segment(last["start"], F.greatest(last["end"], s["end"]), last["label"])
        return F.when(fits & meets, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(segment(s["start"], s["end"], s["label"]))))

    return F.aggregate(ordered, F.array().cast(SEGMENTS), add)


def clip(segments: Column, start: Column, end: Column) -> Column:
    """What lies in [start, end), moved so that start is 0."""
    cut = F.transform(segments, lambda s: segment(F.greatest(s["start"], start) - start, F.least(s["end"], end) - start, s["label"]))
    return F.filter(cut, lambda s: s["start"] < s["end"])


def shift(segments: Column, by: Column) -> Column:
    return F.transform(segments, lambda s: segment(s["start"] + by, s["end"] + by, s["label"]))


def insert(host: Column, guest: Column, at: Column, size: Column) -> Column:
    """``guest`` (of ``size`` places) put into ``host`` at a place: segments there are split, later ones move."""
    left = F.filter(F.transform(host, lambda s: segment(s["start"], F.least(s["end"], at), s["label"])), lambda s: s["start"] < s["end"])
    right = F.filter(F.transform(host, lambda s: segment(F.greatest(s["start"], at) + size, s["end"] + size, s["label"])), lambda s: s["start"] < s["end"])
    return merge_adjacent(F.concat(left, shift(guest, at), right))


def delete(segments: Column, start: Column, end: Column) -> Column:
    """[start, end) taken out: segments shrink, move up, or go; then neighbours of one label join."""
    place = lambda x: F.when(x <= start, x).when(x >= end, x - (end - start)).otherwise(start)
    moved = F.transform(segments, lambda s: segment(place(s["start"]), place(s["end"]), s["label"]))
    return merge_adjacent(F.filter(moved, lambda s: s["start"] < s["end"]))


def context_label(segments: Column, at: Column, default: str) -> Column:
    """Label of the segment around a place, else of one that ends there, else of one that starts there, else the default."""
    pick = lambda f: F.try_element_at(F.filter(segments, f), F.lit(1))["label"]
    return F.coalesce(pick(lambda s: (s["start"] < at) & (s["end"] > at)), pick(lambda s: s["end"] == at), pick(lambda s: s["start"] == at), F.lit(default))


def label_share(segments: Column, label: Column, total: Column) -> Column:
    held = F.aggregate(F.filter(segments, lambda s: s["label"] == label), F.lit(0), lambda a, s: a + s["end"] - s["start"])
    return F.when(total > 0, held / total).otherwise(0.0)


def cover_errors(segments: Column, length: Column, known: tuple[str, ...]) -> Column:
    """Names of what keeps segments, in the order given, from tiling [0, length) with known labels."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("errors"))

    def step(acc: Column, s: Column) -> Column:
        found = F.concat(
            acc["errors"],
            F.when(s["end"] <= s["start"], F.array(F.lit("empty"))).otherwise(F.array().cast("array<string>")),
            F.when(s["start"] > acc["at"], F.array(F.lit("gap"))).when(s["start"] < acc["at"], F.array(F.lit("overlap"))).otherwise(F.array().cast("array<string>")),
            F.when(~s["label"].isin(*known), F.array(F.lit("unknown label"))).otherwise(F.array().cast("array<string>")),
        )
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), found.alias("errors"))

    end = lambda acc: F.when(acc["at"] != length, F.concat(acc["errors"], F.array(F.lit("short cover")))).otherwise(acc["errors"])
    return F.array_sort(F.array_distinct(F.aggregate(segments, start, step, end)))


def concat_parts(parts: DataFrame, key: str, order: str, text: str, label: str, between: str = "") -> DataFrame:
    """(key, content, segments) of labelled parts put together in order, with ``between`` under the label before it."""
    rows = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"), F.col(label).alias("l")))).alias("parts"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SEGMENTS).alias("out"))

    def add(acc: Column, p: Column) -> Column:
        begin = F.when(F.size(acc["out"]) > 0, acc["at"] + len(between)).otherwise(0)
        end = begin + F.length(p["t"])
        grown = F.transform(acc["out"], lambda s: segment(s["start"], F.when(s["end"] == acc["at"], begin).otherwise(s["end"]), s["label"]))
        return F.struct(end.alias("at"), F.concat(grown, F.array(segment(begin, end, p["l"]))).alias("out"))

    spans = F.aggregate("parts", start, add, lambda acc: acc["out"])
    return rows.select(key, F.array_join(F.transform("parts", lambda p: p["t"]), between).alias("content"), spans.alias("segments"))


def joined(segments: Column) -> Column:
    """Segments as text, for reports and comparisons."""
    return F.array_join(F.transform(segments, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"), s["label"])), ",")
