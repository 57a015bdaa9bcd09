"""Quality rules: how much of a text lies inside repeated n-grams and lines."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.text import words

SYMBOLS = b"#*$%&|<>"
#: White space that parts words; any other character makes a line one with a word.
SPACES = " \t\n\x0b\x0c\r"
BASE_N = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: n-gram length -> largest share of word characters that may lie in repeated n-grams.
NGRAM_LIMITS = {8: 0.20, 12: 0.15}
LINE_LIMIT = 0.30
#: Words hashed at once.
BLOCK_WORDS = 400_000
_MULT = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, line_cover double, ngram_cover array<double>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-word window that occurs twice or more in their document.

    hashes: a 64-bit hash for each word; doc: the number of each word's document,
    ascending. One polynomial rolling hash is taken over all documents at once, and
    windows that cross a border are left out.
    """
    covered = np.zeros(len(hashes), bool)
    count = len(hashes) - n + 1
    if count < 2:
        return covered
    rolled = hashes[:count].copy()
    for j in range(1, n):
        rolled = rolled * _BASE + hashes[j : j + count]
    starts = np.flatnonzero(doc[:count] == doc[n - 1 :])
    key = _mix(rolled[starts] ^ _mix(doc[starts].astype(np.uint64) * _MULT))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    dup = np.zeros(len(order), bool)
    dup[:-1] |= same
    dup[1:] |= same
    hit = starts[order[dup]]
    edge = np.zeros(len(hashes) + 1, np.int32)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + n, -1)
    return np.cumsum(edge[:-1]) > 0


def _measure(texts: list[str | None], limits: dict[int, float], line_limit: float) -> dict[str, list]:
    parts = [words(t) if t else [] for t in texts]
    flat = [w for p in parts for w in p]
    n_words = np.fromiter(map(len, parts), np.int64, len(parts))
    doc = np.repeat(np.arange(len(parts)), n_words)
    sizes = np.fromiter(map(len, flat), np.int64, len(flat))
    hashes = _mix(np.fromiter(map(hash, flat), np.int64, len(flat)).view(np.uint64))
    per_doc = lambda weight: np.bincount(doc, weights=weight, minlength=len(parts))
    word_chars = per_doc(sizes).astype(np.int64)
    n_repeat = per_doc(repeated_words(hashes, doc, BASE_N)).astype(np.int64)
    cover = np.stack([per_doc(repeated_words(hashes, doc, n) * sizes) / np.maximum(word_chars, 1) for n in limits], 1) if limits else np.zeros((len(parts), 0))
    symbols, dup_lines, line_cover = [], [], []
    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        symbols.append(len(raw) - len(raw.translate(None, SYMBOLS)))
        lines = [x for x in (t or "").split("\n") if x.strip(SPACES)]
        again, chars = 0, sum(map(len, lines))
        if len(lines) != len(kinds := set(lines)):
            again = chars - sum(map(len, kinds))
        dup_lines.append(len(lines) - len(kinds))
        line_cover.append(again / max(1, chars))
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    bad = (np.array(line_cover) > line_limit) | (cover > np.array(list(limits.values()))).any(axis=1)
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": n_repeat,
        "base_failed": failed, "kept": ~(failed | bad), "line_cover": line_cover, "ngram_cover": cover.tolist(),
    }


def blocks(texts: list[str | None], most: int = BLOCK_WORDS * 6) -> Iterator[slice]:
    """Slices of about ``most`` characters; a longer text stands alone."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t or "") > most:
            yield slice(start, i)
            start, held = i, 0
        held += len(t or "") + 1
    if start < len(texts):
        yield slice(start, len(texts))


def quality_table(batches: Iterable[pa.RecordBatch], limits: dict[int, float], line_limit: float) -> Iterator[tuple[pa.RecordBatch, slice, dict]]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for part in blocks(texts):
            yield batch, part, _measure(texts[part], limits, line_limit)


def quality_rules(docs: DataFrame, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT) -> DataFrame:
    """Measures and verdict for each row of ``docs`` (doc_id, text; other columns are ignored).

    A document fails the base rules with under 10 words or with over 20 % of its words
    in 5-word windows found twice or more. It is also rejected if the share of its word
    characters inside repeated n-grams exceeds ``limits[n]``, or the share of its line
    characters in lines equal to an earlier one exceeds ``line_limit``.

    Null text counts as empty: no words, so it fails. A null doc_id stays null.
    Repeated rows are judged one by one. An empty table gives an empty table.
    """
    limits = NGRAM_LIMITS if limits is None else limits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part, got in quality_table(batches, limits, line_limit):
            ids = batch.column("doc_id").slice(part.start, part.stop - part.start)
            yield pa.RecordBatch.from_arrays([ids, *[pa.array(x, pa.list_(pa.float64()) if k == "ngram_cover" else None) for k, x in got.items()]], names=["doc_id", *got])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose text the rules keep.

    A null text counts as empty and goes, as do blank texts. Repeated rows stay or go
    alike, rows with a null doc_id are judged like others, and columns of any name are
    carried along. An empty table gives an empty table.
    """
    schema = docs.schema
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part, got in quality_table(batches, NGRAM_LIMITS, LINE_LIMIT):
            yield batch.slice(part.start, part.stop - part.start).filter(pa.array(got["kept"])).select(names)

    return docs.mapInArrow(run, schema)
