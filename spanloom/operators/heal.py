"""Carrying the borders of a rewritten text over to its source.

An annotator's answer repeats a source in parts, each with a type, and may change it a
little on the way. Its borders are mapped onto the source, level by level: as it is; with
written-out escapes read; without regard to white space and unprintable characters; then
by a difference of bounded size. What can't be mapped is refused.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# The largest single replacement, and the bounds of the edits allowed over a text.
SMALL = 64
EDIT_SHARE, EDIT_LEAST, EDIT_MOST = 0.05, 8, 200
ESCAPES = {"\\n": "\n", "\\t": "\t", "\\r": "\r", '\\"': '"', "\\'": "'", "\\\\": "\\"}
ESCAPE = re.compile("|".join(map(re.escape, ESCAPES)))

Part = tuple[str, str]


def edit_limit(length: int) -> int:
    return max(EDIT_LEAST, min(EDIT_MOST, int(length * EDIT_SHARE)))


def _solid(text: str) -> np.ndarray:
    return np.flatnonzero(np.fromiter((c.isprintable() and not c.isspace() for c in text), bool, len(text)))


def _mapped(source: str, answer: str) -> tuple[np.ndarray, int] | None:
    """For each place of the answer, and its end, a place of the source; and the edits in between."""
    places, edits = np.zeros(len(answer) + 1, int), 0
    for kind, a, b, c, d in SequenceMatcher(a=source, b=answer, autojunk=False).get_opcodes():
        if kind == "equal":
            places[c:d] = np.arange(a, b)
            continue
        size = max(b - a, d - c)
        breaks = set(source[a:b] + answer[c:d]) <= set("\r\n\\")
        if kind != "insert" and size > SMALL and not breaks:
            return None
        edits += 0 if breaks else size
        places[c:d] = a
    places[-1] = len(source)
    return places, edits


def realign(source: str, parts: list[Part]) -> tuple[list[tuple[int, int, str]], str]:
    """Segments (start, end, type) that tile the source, and the level that found them; none and ``refused`` otherwise."""
    parts = [(kind, content) for kind, content in parts if content]
    if not source or not parts:
        return [], "refused"
    if len(parts) == 1:
        return [(0, len(source), parts[0][0])], "single"
    for level in ("exact", "escapes", "blanks", "edits"):
        contents = [c if level != "escapes" else ESCAPE.sub(lambda m: ESCAPES[m[0]], c) for _, c in parts]
        answer = "".join(contents)
        ends = np.cumsum([len(c) for c in contents])
        if level in ("exact", "escapes"):
            if answer != source:
                continue
            cuts = ends
        elif level == "blanks":
            a, b = _solid(source), _solid(answer)
            if len(a) != len(b) or not len(a) or "".join(source[k] for k in a) != "".join(answer[k] for k in b):
                continue
            nth = np.searchsorted(b, ends, "left")  # solid characters before each border
            cuts = np.where(nth < len(a), a[np.minimum(nth, len(a) - 1)], len(source))
            cuts[-1] = len(source)
        else:
            got = _mapped(source, answer)
            if got is None or got[1] > edit_limit(len(source)):
                continue
            cuts = got[0][ends]
            cuts[-1] = len(source)
        starts = np.concatenate([[0], cuts[:-1]])
        return [(int(s), int(e), kind) for (kind, _), s, e in zip(parts, starts, cuts) if s < e], level
    return [], "refused"


def drop_share(source: str, parts: list[Part]) -> tuple[int, float, bool]:
    """(characters that differ, similarity, whether at least a tenth of the source is missing) of an answer."""
    answer = "".join(c for _, c in parts)
    match = SequenceMatcher(a=source, b=answer, autojunk=False)
    blocks = [x for x in match.get_opcodes() if x[0] != "equal"]
    lost = sum(b - a for kind, a, b, _, _ in blocks if kind == "delete")
    return sum(max(b - a, d - c) for _, a, b, c, d in blocks), match.ratio(), lost * 10 >= len(source) > 0


def heal(df: DataFrame, key: str, source: str, parts: str) -> DataFrame:
    """(key, level, segments) for each row; parts: an array of (type, content)."""
    kind = dict(df.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, s, p in zip(frame[key], frame[source], frame[parts]):
                found, level = realign(s or "", [(x["type"], x["content"] or "") for x in (p if p is not None else ())])
                rows.append((k, level, [{"start": a, "end": b, "label": t} for a, b, t in found]))
            yield pd.DataFrame(rows, columns=[key, "level", "segments"])

    return df.select(key, source, parts).mapInPandas(run, f"{key} {kind}, level string, segments array<struct<start:int,end:int,label:string>>")
