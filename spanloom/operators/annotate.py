"""Parsing and repair of written annotations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.labels import LABELS, OTHER
from spanloom.operators import spans

MARK = r"<CONTENT-TYPE:\s*([^>\n]+?)\s*>"
BLOCK = "array<struct<type:string,content:string>>"


def content_blocks(text: Column) -> Column:
    """Blocks (type, content) after each ``<CONTENT-TYPE:x>`` mark; null without a mark, or with text before the first.

    One line end after a mark belongs to the mark. Types are in lower case.
    """
    types = F.regexp_extract_all(text, F.lit(MARK), F.lit(1))
    parts = F.split(text, MARK)
    bodies = F.slice(parts, 2, 1 << 30)
    blocks = F.zip_with(types, bodies, lambda t, b: F.struct(F.lower(F.trim(t)).alias("type"), F.regexp_replace(b, r"^(?:\r\n|\r|\n)", "").alias("content")))
    return F.when((F.size(types) > 0) & (F.trim(F.regexp_replace(F.get(parts, F.lit(0)), r"\s+", " ")) == ""), blocks)


def adjacent_twins(blocks: Column) -> Column:
    """Types that stand twice in a row, each once, in order."""
    twin = F.filter(blocks, lambda b, i: (i > 0) & (b["type"] == F.get(blocks, i - 1)["type"]))
    return F.array_distinct(F.transform(twin, lambda b: b["type"]))


def stitched(blocks: Column) -> Column:
    """(content, valid): the contents put together; valid if none is empty and every type is known or a discovered one."""
    fine = F.forall(blocks, lambda b: (b["content"] != "") & (b["type"].isin(*LABELS, OTHER) | b["type"].startswith("discovered_") | b["type"].startswith("other_")))
    return F.struct(F.array_join(F.transform(blocks, lambda b: b["content"]), "").alias("content"), (F.coalesce(F.size(blocks), F.lit(0)) > 0).alias("some"), F.coalesce(fine, F.lit(False)).alias("valid"))


def segments_of(blocks: Column) -> Column:
    """Blocks as segments (start, end, label) of the text that they make together."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(spans.SEGMENTS).alias("out"))
    add = lambda acc, b: F.struct((acc["at"] + F.length(b["content"])).alias("at"), F.concat(acc["out"], F.array(spans.segment(acc["at"], acc["at"] + F.length(b["content"]), b["type"]))).alias("out"))
    return F.aggregate(blocks, start, add, lambda acc: acc["out"])


def distance_limit(length: Column) -> Column:
    """Edits allowed for a text: a twentieth of its length, 8 at least and 200 at most."""
    return F.greatest(F.lit(8), F.least(F.lit(200), F.floor(length * 0.05))).cast("int")


def bounded_distance(a: Column, b: Column, limit: int) -> Column:
    """Edit distance; null if over the limit."""
    d = F.levenshtein(a, b, limit)
    return F.when(d >= 0, d)


def tiled(segments: Column, length: Column) -> Column:
    """Segments clipped to the text, neighbours of one label joined; none unless they then tile all of it."""
    held = F.filter(F.transform(segments, lambda s: spans.segment(F.greatest(s["start"], F.lit(0)), F.least(s["end"], length), s["label"])), lambda s: s["start"] < s["end"])
    joined = spans.merge_adjacent(held)
    gapless = F.forall(F.transform(joined, lambda s, i: s["start"] == F.when(i == 0, 0).otherwise(F.get(joined, i - 1)["end"])), lambda x: x)
    fine = (F.size(joined) > 0) & gapless & (F.try_element_at(joined, F.lit(-1))["end"] == length)
    return F.when(fine, joined).otherwise(F.array().cast(spans.SEGMENTS))


def json_payload(text: Column) -> Column:
    """The first fenced or braced JSON object in a text; null without one."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braced = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    found = F.when(fenced != "", fenced).when(braced != "", braced)
    return F.when(F.get_json_object(found, "$").isNotNull(), found)


def collapsed(predicted: Column, refined: Column, length: Column, changed: Column) -> Column:
    """Whether an answer only says ``text`` or ``other`` where the model said more, over the whole text or most of it."""
    generic = lambda s: s["label"].isin("text", OTHER)
    whole = (F.size(refined) == 1) & (F.get(refined, F.lit(0))["start"] == 0) & (F.get(refined, F.lit(0))["end"] == length)
    return F.forall(refined, generic) & ~F.forall(predicted, generic) & (whole | (changed >= 0.8 * length))
