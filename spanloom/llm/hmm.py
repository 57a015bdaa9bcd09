"""A hidden Markov language model, trained by Baum-Welch over all partitions.

The states emit word classes: a fixed number of hash buckets and the end of a text. A
word's share of its class comes from exact counts over the whole training corpus. So the
model's tables have a fixed size, whatever the vocabulary, and

    P(text) = P(classes; forward recursion) * product of (c(w) + 1) / (c(class) + v(class) + 1)

with c the training counts and v the number of known words in a class; what is left in
each class is for unknown words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.text import crc_mod, lower_words
from spanloom.session import discard, stored

CLASSES = 1 << 15
STATES = 6
#: Passes over all training rows end when one gains less than this part of the log likelihood.
GAIN = 1e-2
#: First guess: Baum-Welch rounds over this many documents, drawn by hash.
START_DOCUMENTS = 1024
START_ROUNDS = 12
#: Texts with more tokens are handled in stretches of RUN, whose messages are passed on at their borders: the same sums, sooner.
LONG, RUN = 16_384, 256
#: Tokens handled at once, and tokens held until texts of like lengths are put together.
BATCH, HELD = 500_000, 3_000_000
#: Prior weight of the corpus' class shares in each state's emissions.
PRIOR = 5000.0
FOLDS, HELD_OUT = 7, 2
#: Text bytes that meet one slice of the vocabulary.
BLOCK_BYTES = 16_000_000
#: Words, each of as many bytes at most, that go to all executors with their counts; drawn from START_DOCUMENTS.
HOT_WORDS, HOT_BYTES = 20_000, 64
#: The end of a text as a token; no word contains white space.
END = b"\n"

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass
class Model:
    start: np.ndarray  # K
    move: np.ndarray  # K x K
    emit: np.ndarray  # (CLASSES + 1) x K


def class_ids(found: list[bytes]) -> np.ndarray:
    """Classes of the words and, at the end, of the text's end."""
    out = np.empty(len(found) + 1, np.int64)
    out[:-1] = np.fromiter(map(crc32, found), np.int64, len(found)) & (CLASSES - 1)
    out[-1] = CLASSES
    return out


def first_model(seed: int = 7, states: int = STATES) -> Model:
    rng = np.random.default_rng(seed)
    emit = rng.gamma(2.0, size=(CLASSES + 1, states))
    move = np.full((states, states), 0.05 / max(1, states - 1))
    np.fill_diagonal(move, 0.95 if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(0))


def alike(runs: list[np.ndarray], most: int) -> Iterator[list[int]]:
    """The numbers of the runs, by length, in groups of about ``most`` tokens, so that few steps are taken for few runs."""
    group, size = [], 0
    for i in sorted(range(len(runs)), key=lambda i: len(runs[i])):
        group.append(i)
        size += len(runs[i])
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def by_time(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The order of runs by falling length, and their tokens: all first ones in that order, then all second ones, and where each begins."""
    lengths = np.fromiter(map(len, runs), np.int64, len(runs))
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    flat = np.concatenate([runs[i] for i in order])
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    tokens = flat[np.argsort(at, kind="stable")]
    return order, tokens, [0, *np.cumsum(np.bincount(at)).tolist()]


def transfers(model: Model, runs: list[np.ndarray]) -> np.ndarray:
    """For each run, how its first state's weights become its last state's, up to a factor (runs x K x K)."""
    k = len(model.start)
    order, tokens, steps = by_time(runs)
    out = np.empty((len(runs), k, k))
    held = np.eye(k)[None] * model.emit[tokens[: steps[1]]][:, None, :]
    for a, b in zip(steps[1:], steps[2:]):
        out[b - a : len(held)] = held[b - a :]
        held = (held[: b - a] @ model.move) * model.emit[tokens[a:b]][:, None, :]
        held /= held.sum(axis=(1, 2), keepdims=True)
    out[: len(held)] = held
    back = np.empty_like(out)
    back[order] = out
    return back


def expect(model: Model, texts: Iterable[np.ndarray], most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions over these whole token lists, and their log likelihood."""
    k, most = len(model.start), most or BATCH
    emit, turn = np.ascontiguousarray(model.emit.T), np.ascontiguousarray(model.move.T)
    starts, moves, emits, total = np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES + 1, k)), 0.0

    def flush(runs: list[np.ndarray], first: list[bool], before: list[np.ndarray], after: list[np.ndarray]) -> float:
        """Runs with the state weights of the token before each (the start's, where a text begins) and the message from behind it."""
        order, tokens, steps = by_time(runs)
        begins, before_, after_ = np.array(first)[order], np.array(before)[order].T, np.array(after)[order].T
        likely = emit[:, tokens]  # a row for each state, which is what makes sums over states quick
        alpha, scale = np.empty_like(likely), np.empty(len(tokens))
        for t, (a, b) in enumerate(zip(steps, steps[1:])):
            prior = np.where(begins, before_, turn @ before_) if t == 0 else turn @ alpha[:, steps[t - 1] : steps[t - 1] + b - a]
            x = np.multiply(prior, likely[:, a:b], out=alpha[:, a:b])
            scale[a:b] = s = x.sum(0)
            x /= s
        likely /= scale
        beta = np.empty((k, len(runs)))
        for t in range(len(steps) - 2, -1, -1):
            a, b = steps[t], steps[t + 1]
            longer = steps[t + 2] - b if t + 2 < len(steps) else 0
            if longer < b - a:  # runs whose last token this is
                last = after_[:, longer : b - a]
                beta[:, longer : b - a] = last / (alpha[:, a + longer : b] * last).sum(0)
            here = beta[:, : b - a]
            back = likely[:, a:b] * here
            if t:
                moves[:] += model.move * (alpha[:, steps[t - 1] : steps[t - 1] + b - a] @ back.T)
            else:
                starts[:] += (alpha[:, a:b] * here)[:, begins].sum(1)
                moves[:] += model.move * (before_[:, ~begins] @ back[:, ~begins].T)
            alpha[:, a:b] *= here
            np.matmul(model.move, back, out=here)
        for state in range(k):
            emits[:, state] += np.bincount(tokens, weights=alpha[state], minlength=CLASSES + 1)
        return float(np.log(scale).sum())

    held: tuple[list, list, list, list] = ([], [], [], [])
    size = 0

    def done() -> None:
        nonlocal size, total, held
        for group in alike(held[0], most):
            total += flush(*([column[i] for i in group] for column in held))
        held, size = ([], [], [], []), 0

    def add(run: np.ndarray, *rest) -> None:
        nonlocal size
        for column, x in zip(held, (run, *rest)):
            column.append(x)
        size += len(run)
        if size >= max(most, HELD):
            done()

    for text in texts:
        if len(text) <= LONG:
            add(text, True, model.start, np.ones(k))
            continue
        runs = [text[i : i + RUN] for i in range(0, len(text), RUN)]
        through = np.concatenate([transfers(model, runs[i : i + 512]) for i in range(0, len(runs), 512)])
        before, after, message = [model.start], [np.ones(k)], np.ones(k)
        weights = model.start
        for m in through[:-1]:
            weights = weights @ m
            before.append(weights := weights / weights.sum())
            weights = weights @ model.move
        for m in through[:0:-1]:
            message = model.move @ (m @ message)
            after.append(message := message / message.sum())
        for i, run in enumerate(runs):
            add(run, i == 0, before[i], after[-1 - i])
    done()
    return starts, moves, emits, total


def maximise(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> Model:
    """The model of these counts; every class keeps a share in every state."""
    share = emits.sum(1) + 1.0
    share /= share.sum()
    emit = emits + PRIOR * share[:, None]
    move, start = moves + 1e-3, starts + 1e-3
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def log_likelihoods(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each whole token list, by the scaled forward recursion over those of like lengths at once."""
    out = np.empty(len(texts))
    for group in alike(texts, BATCH):
        out[group] = _forward(model, [texts[i] for i in group])
    return out


def _forward(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    order, tokens, steps = by_time(texts)
    likely, turn = np.ascontiguousarray(model.emit.T)[:, tokens], np.ascontiguousarray(model.move.T)
    scale, alpha = np.empty(len(tokens)), None
    for a, b in zip(steps, steps[1:]):
        alpha = (model.start[:, None] if alpha is None else turn @ alpha[:, : b - a]) * likely[:, a:b]
        scale[a:b] = s = alpha.sum(0)
        alpha /= s
    out, logs = np.zeros(len(texts)), np.log10(scale)
    for a, b in zip(steps, steps[1:]):
        out[: b - a] += logs[a:b]
    back = np.empty(len(texts))
    back[order] = out
    return back


def in_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, doc_id, text, held_out): a stored copy of ``docs``, dealt into blocks of about ``block_bytes`` where its rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = batch.column(3).to_numpy(zero_copy_only=False)
            place = (held + np.cumsum(sizes) - sizes) // block_bytes
            held += int(sizes.sum())
            yield pa.RecordBatch.from_arrays([pa.array(block + place), *(batch.column(i) for i in range(3))], names=["block", "doc_id", "text", "held_out"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    return stored(rows.mapInArrow(run, "block long, doc_id long, text string, held_out boolean"), "blocks")


def _drawn(rows: DataFrame) -> DataFrame:
    """START_DOCUMENTS training texts, drawn by hash, for one task."""
    return rows.filter(~F.col("held_out")).orderBy(F.xxhash64("doc_id"), "doc_id", F.octet_length("text")).limit(START_DOCUMENTS).select("text").coalesce(1)


def train(rows: DataFrame, states: int = STATES, gain: float = GAIN, passes: int | None = None) -> Model:
    """Baum-Welch over all ``rows`` (text, held_out) that are not held out.

    Each pass is one job over whole texts: tasks sum expected counts over their rows,
    Spark adds them up by class, and the driver gets one row for each class. Passes go on
    until one gains less than ``gain`` of the log likelihood, or for exactly ``passes``.
    """
    names = [f"s{i}" for i in range(states)]
    schema = "cell long, " + ", ".join(f"{n} float" for n in names)
    size = CLASSES + 1

    def cells(starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, likely: float) -> Iterator[pa.RecordBatch]:
        sums = np.concatenate([emits, moves, starts[None]])
        some = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(sums[some, i].astype(np.float32)) for i in range(states)]], names=["cell", *names])
        whole = np.zeros(states, np.float32)
        whole[0] = likely
        yield pa.RecordBatch.from_arrays([pa.array([-1]), *[pa.array(whole[i : i + 1]) for i in range(states)]], names=["cell", *names])

    def ids(batches: Iterable[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield class_ids(lower_words(text))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, model = list(ids(batches)), first_model(states=states)
        if texts:
            for _ in range(START_ROUNDS):
                *counts, likely = expect(model, texts)
                model = maximise(*counts)
            yield from cells(*counts, likely)

    def read(df: DataFrame) -> tuple[Model | None, float]:
        out, likely = np.zeros((size + states + 1, states)), 0.0
        for r in df.collect():
            if r.cell < 0:
                likely = r[1]
            else:
                out[r.cell] = r[1:]
        return (maximise(out[-1], out[size:-1], out[:size]) if out.any() else None), likely

    nothing = maximise(np.zeros(states), np.zeros((states, states)), np.zeros((size, states)))
    model = read(_drawn(rows).mapInArrow(first, schema))[0] or nothing
    last, n = None, 0
    while passes is None or n < passes:
        held = rows.sparkSession.sparkContext.broadcast(model)

        def step(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            yield from cells(*expect(held.value, ids(batches)))

        sums = rows.filter(~F.col("held_out")).select("text").mapInArrow(step, schema).groupBy("cell").agg(*[F.sum(n).alias(n) for n in names])
        new, likely = read(sums)
        held.unpersist()
        model, n = new or model, n + 1
        if new is None or passes is None and last is not None and likely - last < gain * abs(last):
            break
        last = likely
    return model


def hot_words(rows: DataFrame) -> list[bytes]:
    """The most frequent words of the drawn texts, and the end; none of them is one task's later, however frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(w for w in lower_words(text) if len(w) <= HOT_BYTES)
        words = [w for w, n in seen.most_common(HOT_WORDS) if n > 1]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary())], names=["word"])

    return sorted({END, *(bytes(r.word) for r in _drawn(rows).mapInArrow(run, "word binary").collect())})


def word_counts(rows: DataFrame, hot: list[bytes]) -> DataFrame:
    """(block, word, n): n of each word in the training rows of each block, 0 if only held-out rows have it.

    Rows with a ``hot`` word are added up over all blocks of a task, as block -1.
    """
    held = rows.sparkSession.sparkContext.broadcast(frozenset(hot))

    def table(block: int, counts: Counter[bytes]) -> Iterator[pa.RecordBatch]:
        words = sorted(counts)  # neighbours share beginnings, which compress
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(part, pa.binary()), pa.array(np.fromiter(map(counts.__getitem__, part), np.int64, len(part)))], names=["block", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, often = held.value, Counter()
        here, known = None, Counter()

        def done() -> Iterator[pa.RecordBatch]:
            for w in hot.intersection(known):
                often[w] += known.pop(w)
            if known:
                yield from table(here, known)
            known.clear()

        for batch in batches:
            for block, text, held_out in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if block != here:
                    yield from done()
                    here = block
                found = lower_words(text)
                found.append(END)
                known.update(dict.fromkeys(found, 0) if held_out else found)
        yield from done()
        if often:
            yield from table(-1, often)

    return stored(rows.select("block", "text", "held_out").mapInArrow(run, "block long, word binary, n long"), "counts")


def score(docs: DataFrame, model: Model | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores of each row of ``docs`` (doc_id, text; other columns are ignored) by whole texts.

    Rows whose crc32(doc_id as text) mod 7 is 2 are held out of all training counts.
    Rows are dealt into blocks of about ``block_bytes`` where they are; each block meets
    the counts of its own words only, so no vocabulary is ever held whole. Counts of
    frequent words (a list of bounded size) are added up inside tasks and sent to all
    executors, those of others go from blocks to words and back. Null and empty texts are
    one token, the end. A null doc_id counts as the empty text there and stays null.
    Repeated rows are scored, and counted, one by one. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = in_blocks(docs, block_bytes)
    model = train(rows) if model is None else model
    counts = word_counts(rows, hot_words(rows))
    bucket = F.when(F.col("word") == F.lit(END), F.lit(CLASSES)).otherwise(F.crc32("word").bitwiseAND(F.lit(CLASSES - 1)))
    often = {bytes(r.word): r.c for r in counts.filter("block < 0").groupBy("word").agg(F.sum("n").alias("c")).collect()}
    same = Window.partitionBy("word")
    slices = counts.filter("block >= 0").select("block", "word", F.sum("n").over(same).alias("c"), (F.col("block") == F.min("block").over(same)).alias("one"))  # a word has one row in a block
    slices = stored(slices, "words")
    discard(counts)
    held, kinds = np.zeros(CLASSES + 1), np.zeros(CLASSES + 1)
    for r in slices.filter("one").groupBy(bucket.alias("class")).agg(F.sum("c").alias("n"), F.sum((F.col("c") > 0).cast("long")).alias("v")).collect():
        held[r["class"]], kinds[r["class"]] = r.n, r.v
    for w, c in often.items():
        k = CLASSES if w == END else crc32(w) & (CLASSES - 1)
        held[k] += c
        kinds[k] += c > 0
    n_all, n_kinds = int(held.sum()), int(kinds.sum())
    shared = spark.sparkContext.broadcast((model, np.log10(held + kinds + 1), often))

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        model, class_log, often = shared.value
        listed = [*words.column("word").to_pylist(), *often]  # frequent words, the end among them, are in no block's slice
        place = {w: i for i, w in enumerate(listed)}
        count = np.concatenate([words.column("c").to_numpy(), np.fromiter(often.values(), np.int64, len(often))])
        kind = class_ids(listed)[:-1]
        kind[place[END]] = CLASSES
        share = np.log10(count + 1)
        columns = [[] for _ in range(7)]
        for batch in texts.select(["doc_id", "held_out", "text"]).to_batches(max_chunksize=20_000):
            size, ids, extra = 0, [], []

            def flush() -> None:
                nonlocal size, ids, extra
                if ids:
                    for x, (rest, row) in zip(log_likelihoods(model, ids).tolist(), extra):
                        for c, v in zip(columns, (*row, x + rest)):
                            c.append(v)
                size, ids, extra = 0, [], []

            for doc_id, held_out, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = lower_words(text)
                found.append(END)
                at = np.fromiter(map(place.__getitem__, found), np.int64, len(found))
                classes = kind[at]
                own = share[at].sum()
                base = own - len(at) * np.log10(n_all + n_kinds + 1)
                ids.append(classes)
                extra.append((own - class_log[classes].sum(), (doc_id, held_out, len(at), int(np.count_nonzero(count[at])), n_all, float(base))))
                size += len(at)
                if size > HELD:
                    flush()
            flush()
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    dealt = rows.repartition(max(1, rows.select("block").distinct().count()), "block")  # as many tasks as blocks, however many
    return dealt.groupBy("block").cogroup(slices.select("block", "word", "c").groupBy("block")).applyInArrow(run, SCHEMA)
