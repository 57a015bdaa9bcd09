"""Judging answers of a relabelling round: guards on segments, verdicts on files, summaries in logs."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from spanloom.operators import spans


def _fenced_end(text: Column, eol: str) -> Column:
    opening = f"---{eol}"
    closings = [F.locate(f"{eol}{mark}{eol}", text, len(opening) + 1) for mark in ("---", "...")]
    return F.when(text.startswith(opening), F.coalesce(*[F.when(at > 0, at - 1 + len(opening) + len(eol)) for at in closings]))


def frontmatter_end(text: Column) -> Column:
    """Where a text's front matter ends: behind the first closing ``---`` line, else the first ``...`` line; null without one."""
    return F.coalesce(_fenced_end(text, "\n"), _fenced_end(text, "\r\n"))


def frontmatter_guard(segments: Column, text: Column) -> Column:
    """Segments of a Markdown text from its start: yaml that runs on behind the front matter becomes markdown there.

    Segments tile the text. Others, and those of texts that are nothing but front matter, stay as they are.
    """
    joined = spans.merge_adjacent(segments)
    first, end = F.get(joined, F.lit(0)), frontmatter_end(text)
    beyond = (first["label"] == "yaml") & (first["start"] == 0) & (end < F.length(text)) & (first["end"] > end)
    cut = F.array(spans.segment(F.lit(0), end, F.lit("yaml")), spans.segment(end, first["end"], F.lit("markdown")))
    return F.when(beyond, spans.merge_adjacent(F.concat(cut, F.slice(joined, 2, 1 << 30)))).otherwise(segments)


def file_verdicts(chunks: DataFrame, file: str, state: str, answered: str) -> DataFrame:
    """(file, n_chunks, reason): why a file's chunks are not stored, null if they are.

    A chunk's state is ``model``, ``skipped_parse_failed``, ``skipped_missing``, another
    word, or null where nothing is known of it; ``answered`` says whether it has segments.
    One chunk that couldn't be parsed rejects its file, then one that is missing, then one
    from elsewhere than the model, then one without an answer.
    """
    any_of = lambda c: F.max(F.coalesce(c, F.lit(False)))
    s, has = F.col(state), F.coalesce(F.col(answered), F.lit(False))
    missing = (s == "skipped_missing") | (s.isNull() & ~has)
    odd = ~s.isin("model", "skipped_parse_failed", "skipped_missing")
    reason = F.when(any_of(s == "skipped_parse_failed"), "parse_failed").when(any_of(missing), "missing").when(any_of(odd), "unexpected_non_model").when(any_of(~has), "missing")
    return chunks.groupBy(file).agg(F.count(F.lit(1)).alias("n_chunks"), reason.alias("reason"))


def last_object(log: str | None) -> str | None:
    """The last JSON object that a log's lines end with, or null: lines are taken back from the last closing brace until braces are even."""
    lines = (log or "").splitlines()
    last = next((k for k in range(len(lines) - 1, -1, -1) if "}" in lines[k]), -1)
    depth = 0
    for first in range(last, -1, -1):
        depth += lines[first].count("}") - lines[first].count("{")
        if depth <= 0 or first == 0:
            block = "\n".join(lines[first : last + 1])
            try:
                return block if isinstance(json.loads(block), dict) else None
            except ValueError:
                return None
    return None


@F.pandas_udf(StringType())
def last_json(log: pd.Series) -> pd.Series:
    """``last_object`` of a column."""
    return log.map(last_object)


def event_line(line: Column, prefix: str) -> Column:
    """The JSON object behind a line's prefix; null for other lines and for anything else behind it."""
    body = F.trim(F.substr(F.trim(line), F.lit(len(prefix) + 1)))
    return F.when(F.trim(line).startswith(prefix) & body.startswith("{") & F.get_json_object(body, "$").isNotNull(), body)
