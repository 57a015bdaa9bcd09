"""Packing documents into fixed windows by non-negative least squares."""

from __future__ import annotations

import re
import warnings
import zlib
from array import array
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 4096
END_ID = 2
#: Lengths are counted in units of this many tokens when combinations are enumerated.
UNIT = 64
#: Documents whose cut pieces are packed together; a task packs one block after the other.
BLOCK_TOKENS = 6_000_000
#: Words kept with their ids in each worker while a task runs.
CACHE_WORDS = 400_000

#: Letters of Latin-1, which no normal form composes further, and a sign after them.
PLAIN = re.compile("([A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff]+)([.,]?)")
#: A letter beyond ASCII stands in the vocabulary as its two UTF-8 bytes, each as the
#: character of its number; byte values without a printable one follow from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}
BYTE_LETTERS = {c: "".join(_BYTE[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Known(dict):
    """Ids of chunks. When full, it becomes the older half, which is dropped at the next turn."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, chunk: str) -> bytes:
        if (ids := self.older.get(chunk)) is None:
            ids = self.make(chunk)
        if len(self) >= CACHE_WORDS // 2:
            self.older = dict(self)
            self.clear()
        self[chunk] = ids
        return ids


class WordIds:
    """Token ids of a text, as little-endian unsigned 32-bit bytes.

    The vocabulary's splitter never crosses white space, so a text's ids are those of
    its space-separated chunks, one after the other. Chunks repeat, so they are kept. A
    word of plain letters, with a full stop or comma at most, goes to the model at once,
    as the normaliser and the splitter only lower its case and part the sign from it.
    A text that may spell a special token goes to the tokenizer as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _Known(self.chunk)
        self.known[""] = b""
        self.signs = {"": b"", ".": self.whole("."), ",": self.whole(",")}
        self.model = self.tokenizer.model

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def chunk(self, chunk: str) -> bytes:
        if not (plain := PLAIN.fullmatch(chunk)):
            return self.whole(chunk)
        word = plain[1].lower()
        word = word if word.isascii() else word.translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes() + self.signs[plain[2]]

    def forget(self) -> None:
        self.known.clear()
        self.known.older = {}
        self.known[""] = b""

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.specials):
            return self.whole(text)
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


@lru_cache(maxsize=4)
def combinations(units: int) -> np.ndarray:
    """All ways to fill a window of ``units`` with one to three piece sizes; a column for each, a row for each size."""
    found = {(units,)}
    found |= {(a, units - a) for a in range(1, units // 2 + 1)}
    found |= {(a, b, units - a - b) for a in range(1, units // 3 + 1) for b in range(a, (units - a) // 2 + 1)}
    out = np.zeros((units + 1, len(found)))
    for k, sizes in enumerate(sorted(found)):
        for s in sizes:
            out[s, k] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 0) -> np.ndarray:
    """x >= 0 that makes |a x - b| least, by the active-set method.

    Each round lowers the residual, so the method ends; ``rounds`` (3 for each column
    where 0) guards against rounding errors only, and a warning tells when it is reached.
    What it then returns is feasible, if not the least.
    """
    gram, target = a.T @ a, a.T @ b
    x = np.zeros(a.shape[1])
    active: list[int] = []
    tolerance = 1e-9 * max(1.0, np.abs(target).max())
    for _ in range(rounds or 3 * a.shape[1]):
        slope = target - gram @ x
        slope[active] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= tolerance:
            break
        active.append(best)
        while active:
            s = np.linalg.lstsq(gram[np.ix_(active, active)], target[active], rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[active] = s
                break
            now = x[active]
            step = min((n / (n - t) if n > t else 0.0) for n, t in zip(now, s) if t <= 0)
            x[active] = now + step * (s - now)
            keep = [k for k in active if x[k] > 1e-12]
            for k in set(active) - set(keep):
                x[k] = 0
            active = keep
        else:
            break
    else:
        warnings.warn("non-negative least squares stopped before it was solved", RuntimeWarning, stacklevel=2)
    return x


Piece = tuple[int, int, int]  # document's number in the block, start, length


def pack(lengths: Iterable[int], window: int = WINDOW, unit: int = UNIT) -> Iterator[list[Piece]]:
    """Sequences for documents of these token counts; the pieces of each in order.

    Every full window of a long document is a sequence of its own. What is left of each
    document is counted by size; non-negative least squares finds how often each filling
    combination is used, rounded down. Pieces outside these combinations are cut to fill
    what the combinations leave open, then packed one after the other. The last, partial
    window is split at powers of two, so nothing is padded.
    """
    units = -(-window // unit)
    by_size: list[deque[Piece]] = [deque() for _ in range(units + 1)]
    for doc, n in enumerate(lengths):
        full = n - n % window
        for start in range(0, full, window):
            yield [(doc, start, window)]
        if n % window:
            by_size[-(-(n % window) // unit)].append((doc, full, n % window))
    histogram = np.array([len(x) for x in by_size], float)
    plan: list[list[Piece]] = []
    table = combinations(units)
    for k in np.flatnonzero(times := np.floor(nnls(table, histogram) + 1e-6).astype(int)):
        sizes = [s for s in range(units + 1) for _ in range(int(table[s, k]))]
        for _ in range(times[k]):
            if any(len(by_size[s]) < sizes.count(s) for s in set(sizes)):
                break
            plan.append([by_size[s].popleft() for s in sizes])
    rest = deque(sorted((p for x in by_size for p in x), key=lambda p: -p[2]))
    done = 0
    while done < len(plan):
        open_ = window - sum(p[2] for p in plan[done])
        while open_:
            if not rest:
                if done + 1 == len(plan):
                    break
                rest.extend(plan.pop())
            doc, start, n = rest.popleft()
            take = min(n, open_)
            plan[done].append((doc, start, take))
            open_ -= take
            if take < n:
                rest.appendleft((doc, start + take, n - take))
        if open_:
            rest.extend(plan.pop())
            break
        yield plan[done]
        done += 1
    left = sum(p[2] for p in rest)
    while left:
        size = window if left >= window else 1 << (left.bit_length() - 1)
        left -= size
        out = []
        while size:
            doc, start, n = rest.popleft()
            take = min(n, size)
            out.append((doc, start, take))
            size -= take
            if take < n:
                rest.appendleft((doc, start + take, n - take))
        yield out


def pack_documents(docs: DataFrame, tokenizer_path: str | Callable[[], str], window: int = WINDOW, unit: int = UNIT) -> DataFrame:
    """A row for each piece of each row of ``docs`` (doc_id, text; other columns are ignored).

    A document is its token ids, then ``END_ID``; null or empty text is the end id alone.
    Pieces with one sequence_id, by offset, are a training sequence of at most ``window``
    tokens. Each task packs its own rows in blocks of bounded size, so no row moves; a
    sequence_id is unique over all tasks. Repeated rows are packed one by one; a null
    doc_id stays null. An empty table gives an empty table.

    tokenizer_path: a tokenizer file, or a function that gives its path on an executor.
    """

    def emit(held: list[tuple[int, bytes]], first: int) -> tuple[pa.RecordBatch, int]:
        rows: list[tuple] = []
        for pieces in pack([len(ids) // 4 for _, ids in held], window, unit):
            at = 0
            for doc, start, n in pieces:
                doc_id, ids = held[doc]
                rows.append((doc_id, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, first, at))
                at += n
            first += 1
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 7)], names=[x.split()[0] for x in SCHEMA.split(", ")]), first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer_path if isinstance(tokenizer_path, str) else tokenizer_path())
        end = np.array([END_ID], "<u4").tobytes()
        first, held, size = TaskContext.get().partitionId() << 36, [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = (encode(text) if text else b"") + end
                held.append((doc_id, ids))
                size += len(ids) // 4
                if size >= BLOCK_TOKENS:
                    out, first = emit(held, first)
                    yield out
                    held, size = [], 0
        if held:
            yield emit(held, first)[0]
        encode.forget()  # a worker lives on after its task

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
