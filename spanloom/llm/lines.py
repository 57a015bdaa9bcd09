"""Line dedup: chunks of lines with content-defined borders, removed where they repeat globally."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from spanloom.llm.text import WORD
from spanloom.session import discard, stored

#: Lines end at \n; a longer one is wrapped behind each sentence in it, so that a passage inside a line has lines too.
LINE_END = re.compile(r"\n|[.!?](?=[ ])")
#: Lines under the rolling hash.
ROLL = 2
#: Of as many neighbouring rolling hashes, the least makes a border, so that four lines always hold one.
NEIGHBOURS = 2
#: A chunk ends at the first border that leaves it this many lines and characters. A line of LONE_CHARS has borders
#: of its own and is a chunk by itself, as no border may fall inside a short passage otherwise.
CHUNK_LINES, CHUNK_CHARS, LONE_CHARS = 2, 80, 200
#: A run of repeated chunks is compared if it has these characters, and cut if it has these words once it is
#: extended over its neighbours.
RUN_CHARS, PASSAGE_WORDS = 100, 50
#: Characters on either side of a run that are sent along with it, over which it may be extended.
CONTEXT = 400
#: Copies of a chunk that one task compares; more are dealt to several.
TASK_COPIES = 2000
#: Copies of a chunk up to which a join on chunks may gather them.
HOT = 100_000
#: Rows of a table of numbers (32 bytes each at most) up to which it is sent to all executors; they are counted first.
BROADCAST_ROWS = 1_000_000
#: Characters handled at once.
BLOCK_CHARS = 2_000_000

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_LAST = (1 << 63) - 1


def lines_of(text: str) -> tuple[list[int], list[int]]:
    """Where a text's lines start and end, without the white space between them; blank lines are left out."""
    starts, ends, at = [], [], 0
    for m in LINE_END.finditer(text):
        end = m.end()
        new = text[end - 1] == "\n"
        stop = end - new
        if stop > at and not text[at:stop].isspace():
            starts.append(at)
            ends.append(stop)
        at = end + (not new)
    if at < len(text) and not text[at:].isspace():
        starts.append(at)
        ends.append(len(text))
    return starts, ends


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def border_lines(hashes: np.ndarray, chars: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which lines a border stands before: those that begin a text, and those chosen by content.

    A rolling hash is taken over each line and the one before it. Where it is the least of
    NEIGHBOURS in a row, the line is chosen; and so are a line of LONE_CHARS and the one
    after it. That depends on the lines next to it alone, so borders inside a passage move
    with it.
    """
    n = len(hashes)
    chosen = np.zeros(n, bool)
    if not n:
        return chosen
    rolled, whole = hashes.copy(), np.ones(n, bool)
    for j in range(1, ROLL):
        rolled[j:] += hashes[:-j] * _U(pow(_BASE, j, 1 << 64))
        whole[:j] = False
        whole[j:] &= doc[j:] == doc[:-j]
    rolled = _mix(rolled)
    count = n - NEIGHBOURS + 1
    if count > 0:
        least, place = rolled[:count].copy(), np.zeros(count, np.int64)
        for j in range(1, NEIGHBOURS):
            less = rolled[j : count + j] < least
            least[less], place[less] = rolled[j : count + j][less], j
        good = np.flatnonzero(whole[:count] & (doc[:count] == doc[NEIGHBOURS - 1 :]))
        chosen[good + place[good]] = True
    lone = chars >= LONE_CHARS
    chosen |= lone
    chosen[1:] |= lone[:-1]
    chosen[0] = True
    chosen[1:] |= doc[1:] != doc[:-1]
    return chosen


def chunk_table(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, first character, characters, hash) of each chunk of these texts, in order.

    A chunk goes from a border to the first border that leaves it CHUNK_LINES lines and
    CHUNK_CHARS characters, or LONE_CHARS; the end of a text is one.
    """
    parts = [lines_of(t) for t in texts]
    sizes = np.fromiter((len(s) for s, _ in parts), np.int64, len(parts))
    starts = np.fromiter((x for s, _ in parts for x in s), np.int64, sizes.sum())
    ends = np.fromiter((x for _, e in parts for x in e), np.int64, len(starts))
    doc = np.repeat(np.arange(len(parts)), sizes)
    lines = (t[a:b] for t, (s, e) in zip(texts, parts) for a, b in zip(s, e))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, lines), _U, len(starts))
    n = len(starts)
    borders = np.append(np.flatnonzero(border_lines(hashes, ends - starts, doc)), n)
    first = borders[:-1]
    after = np.cumsum(sizes)[doc[first]]  # line after the text's last
    last = np.full(len(first), -1)
    open_, step = np.arange(len(first)), np.arange(1, len(first) + 1)
    while len(open_):
        stop = borders[step[open_]]
        inside = stop <= after[open_]
        chars = ends[stop - 1] - starts[first[open_]]
        fits = inside & ((stop - first[open_] >= CHUNK_LINES) & (chars >= CHUNK_CHARS) | (chars >= LONE_CHARS))
        last[open_[fits]] = stop[fits]
        step[open_] += 1
        open_ = open_[inside & ~fits & (step[open_] < len(borders))]
    kept = last >= 0
    a, b = first[kept], last[kept]
    powers = np.cumprod(np.append(_U(1), np.full(n, _U(_BASE))), dtype=_U)
    back = np.cumprod(np.append(_U(1), np.full(n, _U(pow(_BASE, -1, 1 << 64)))), dtype=_U)
    sums = np.append(_U(0), np.cumsum(hashes * powers[:-1], dtype=_U))
    h = _mix((sums[b] - sums[a]) * back[a] + (b - a).astype(_U))
    return doc[a], starts[a], ends[b - 1] - starts[a], h.view(np.int64)


def _blocks(texts: list[str | None]) -> Iterator[slice]:
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t or "") > BLOCK_CHARS:
            yield slice(start, i)
            start, held = i, 0
        held += len(t or "") + 1
    if start < len(texts):
        yield slice(start, len(texts))


def chunks(rows: DataFrame) -> DataFrame:
    """(rid, doc, at, size, h) of each chunk of each row (rid, doc, text): characters, and a hash of its lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for part in _blocks(texts):
                row, at, size, h = chunk_table([t or "" for t in texts[part]])
                where = pa.array(row + part.start)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(at), pa.array(size), pa.array(h)], names=["rid", "doc", "at", "size", "h"])

    return rows.select("rid", "doc", "text").mapInArrow(run, "rid long, doc long, at long, size long, h long")


def _dealt(copies: DataFrame, few: DataFrame, key: list[str]) -> DataFrame:
    """``copies`` (with ``n``, how many of them share a key) joined with ``few`` (one row for each key, with ``n``).

    A key with many copies is dealt to n / TASK_COPIES tasks, each of which gets few's row.
    """
    parts = (F.col("n") / TASK_COPIES).cast("long")
    left = copies.withColumn("__part", F.pmod(F.xxhash64("rid", "at"), parts + 1)).drop("n")
    right = few.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), parts))).drop("n")
    return left.join(right, [*key, "__part"]).drop("__part")


def copied_chunks(found: DataFrame) -> DataFrame:
    """(rid, at, size, from_rid, from_at) of each chunk in ``found`` (cid and chunks' columns) that isn't the first of its kind.

    The first one is that of the smallest (doc, cid). Counts are added up inside tasks
    before anything is shuffled, and a frequent chunk is dealt to several tasks.
    """
    repeated = stored(found.groupBy("h").agg(F.min("doc").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated")
    if repeated.count() <= BROADCAST_ROWS:
        marked = found.join(F.broadcast(repeated), "h")
    else:  # chunks with over HOT copies, of which there can't be more than BROADCAST_ROWS, never share a task
        hot = F.col("n") > max(HOT, found.count() // BROADCAST_ROWS)
        often = F.broadcast(stored(repeated.filter(hot), "often"))
        marked = found.join(often, "h").unionByName(found.join(often.select("h"), "h", "left_anti").join(repeated.filter(~hot), "h"))
    marked = stored(marked, "copies")
    discard(found, repeated)
    first = marked.filter("doc = low").groupBy("h").agg(F.min("cid").alias("keep"), F.min_by("rid", "cid").alias("from_rid"), F.min_by("at", "cid").alias("from_at"), F.max("n").alias("n"))
    out = _dealt(marked.select("h", "n", "cid", "rid", "at", "size"), first, ["h"])
    return out.filter("cid != keep").select("rid", "at", "size", "from_rid", "from_at")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of a row that follow each other in the same way in the row they are copied from, as one."""
    names = ["rid", "at", "size", "from_rid", "from_at"]
    for batch in batches:
        out: list[tuple] = []
        for rid, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            shift = lambda c: (c["from_rid"], c["from_at"] - c["at"])
            found.sort(key=lambda c: (*shift(c), c["at"]))
            mine: list[list[int]] = []
            for i, c in enumerate(found):
                if i and shift(c) == shift(found[i - 1]) and c["at"] <= mine[-1][1] + 2:  # parted by a line end at most
                    mine[-1][1] = max(mine[-1][1], c["at"] + c["size"])
                else:
                    mine.append([c["at"], c["at"] + c["size"], c["from_rid"], c["from_at"]])
            out += [(rid, at, end - at, from_rid, from_at) for at, end, from_rid, from_at in mine if end - at >= RUN_CHARS]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5)], names=names)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of each run that is asked of a row, with what stands before and after it, cut at whole words."""
    names = ["from_rid", "from_at", "size", "n", "before", "piece", "after"]
    types = [pa.int64()] * 4 + [pa.string()] * 3
    for batch in batches:
        for rid, text, asked in zip(*(batch.column(i).to_pylist() for i in range(3))):
            out = []
            for a in asked:
                at, end = a["from_at"], a["from_at"] + a["size"]
                before, after = text[max(0, at - CONTEXT) : at], text[end : end + CONTEXT]
                if at > CONTEXT and not text[at - CONTEXT - 1].isspace():
                    before = re.sub(r"^\S+", "", before)
                if end + CONTEXT < len(text) and not text[end + CONTEXT].isspace():
                    after = re.sub(r"\S+$", "", after)
                out.append((rid, at, a["size"], a["n"], before, text[at:end], after))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def extended(text: str, at: int, before: str, piece: str, after: str) -> tuple[int, int] | None:
    """The interval of ``text`` around ``at`` that equals the piece, and whole words of what stands beside it; None if it differs."""
    end = at + len(piece)
    if text[at:end] != piece:
        return None
    low = max(0, at - len(before) - 64)
    mine, theirs = list(WORD.finditer(text, low, at)), WORD.findall(before)
    if low and mine and mine[0].start() == low:
        del mine[0]  # it may have begun earlier
    start = at
    for m, w in zip(reversed(mine), reversed(theirs)):
        if m[0] != w:
            break
        start = m.start()
    for m, w in zip(WORD.finditer(text, end), WORD.findall(after)):
        if m[0] != w:
            break
        end = m.end()
    return start, end


def without(text: str, found: list[tuple[int, int]], least: int = PASSAGE_WORDS) -> tuple[str, int, int]:
    """``text`` without the intervals that hold ``least`` words, how many places were cut, and how many words."""
    merged: list[list[int]] = []
    for a, b in sorted(x for x in set(found) if sum(1 for _ in WORD.finditer(text, *x)) >= least):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    out, at, n = [], 0, 0
    for a, b in merged:
        n += sum(1 for _ in WORD.finditer(text, a, b))
        out.append(text[at:a])
        at = b
        while at < len(text) and text[at] == " ":
            at += 1
        if at < len(text) and text[at] == "\n" and (a == 0 or text[a - 1] == "\n"):  # no line is left
            at += 1
    return "".join(out) + text[at:], len(merged), n


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with repeated passages cut out of the text, and what was cut.

    New columns: n_lines, n_cuts, n_cut_words, n_cut_chars. Chunks of lines that occur
    twice or more in the table are found by hash. The one in the smallest doc_id (nulls
    last), first in the stored order of its rows, stays. Each other one is compared with it
    character by character, then word by word to either side as far as both agree, and cut
    if that makes PASSAGE_WORDS words. Whatever is cut is still held by an earlier place.
    A repeated row is a copy like others, whatever its doc_id. A null text stays null. An
    empty table gives an empty table. Columns of any name are carried along.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    doc, text = (F.col(names[docs.columns.index(n)]) for n in ("doc_id", "text"))
    copy = stored(docs.toDF(*names).withColumn("__rid", F.monotonically_increasing_id()), "docs")
    rows = copy.select(F.col("__rid").alias("rid"), F.coalesce(doc.cast("long"), F.lit(_LAST)).alias("doc"), text.alias("text"))
    found = stored(chunks(rows.filter("text IS NOT NULL")).withColumn("cid", F.monotonically_increasing_id()), "chunks")
    copies = copied_chunks(found)
    per_row = copies.groupBy("rid").agg(F.collect_list(F.struct("at", "size", "from_rid", "from_at")).alias("found"))
    runs = stored(per_row.mapInArrow(_runs, "rid long, at long, size long, from_rid long, from_at long"), "runs")
    key = ["from_rid", "from_at", "size"]
    asked = stored(runs.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "asked")
    source = stored(asked.groupBy(F.col("from_rid").alias("rid")).agg(F.collect_list(F.struct("from_at", "size", "n")).alias("asked")), "source")
    few = F.broadcast(source) if asked.count() <= BROADCAST_ROWS else source
    piece = rows.join(few, "rid").select("rid", "text", "asked").mapInArrow(_pieces, "from_rid long, from_at long, size long, n long, before string, piece string, after string")
    compared = _dealt(runs.join(F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked, key), piece, key)
    cuts = compared.groupBy(F.col("rid").alias("__row")).agg(F.collect_list(F.struct("at", "before", "piece", "after")).alias("__cuts"))
    ids = stored(runs.select(F.col("rid").alias("__row")).distinct(), "rows")
    same_row = F.col("__rid") == F.col("__row")
    if ids.count() <= 4 * BROADCAST_ROWS:  # rows without a run stay where they are
        ready = copy.join(F.broadcast(ids), same_row, "left_semi").join(cuts, same_row).drop("__rid", "__row")
        ready = ready.unionByName(copy.join(F.broadcast(ids), same_row, "left_anti").drop("__rid"), allowMissingColumns=True)
    else:
        ready = copy.join(cuts, same_row, "left").drop("__rid", "__row")
    at = docs.columns.index("text")
    out_schema = StructType(list(docs.schema.fields))  # a copy: add() changes its object
    for name in ("n_lines", "n_cuts", "n_cut_words", "n_cut_chars"):
        out_schema.add(name, "long")
    width = len(names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, cuts in zip(batch.column(at).to_pylist(), batch.column(width).to_pylist()):
                new, places, n = text, 0, 0
                if cuts:
                    spans = (extended(text, c["at"], c["before"], c["piece"], c["after"]) for c in cuts)
                    new, places, n = without(text, [s for s in spans if s])
                texts.append(new)
                counts.append((text.count("\n") + 1 if text is not None else 0, places, n, len(text or "") - len(new or "")))
            columns = [batch.column(i) for i in range(width)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in zip(*counts))], names=[f.name for f in out_schema])

    return ready.mapInArrow(cut, out_schema)


def keep_rest(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated passages, in its own columns; a row of which nothing is left goes.

    n_chars, where the table has it, follows the text. Rows with null or empty texts stay,
    repeated rows are copies of each other, and an empty table gives an empty table.
    """
    done = dedup_lines(docs)
    changed: Column = F.col("n_cut_chars") > 0
    done = done.filter(~(changed & F.coalesce(F.length(F.trim("text")) == 0, F.lit(False))))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)
