"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.text import crc_mod

BUCKETS = 1 << 14
DIMENSIONS = 16
SIZES = (1, 2, 3)
#: Bound of the labelled sample: documents for each language, drawn by hash.
SAMPLE = 300
EPOCHS, RATE, BATCH = 60, 2.0, 32
FOLDS, HELD_OUT = 4, 2
#: Share of right answers on the calibration part that may be rejected.
REJECT = 0.02
UNKNOWN = "und"
SPACE = 32
#: Characters hashed at once.
BLOCK_CHARS = 2_000_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all character n-grams of these texts, and the text of each; any character but a letter is a border."""
    letters = _letters()
    raw = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    sizes = np.fromiter((len(x) + 2 for x in raw), np.int64, len(raw))
    flat = np.full(sizes.sum(), SPACE, np.uint32)
    doc = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
    at = 0
    for x in raw:
        flat[at + 1 : at + 1 + len(x)] = x
        at += len(x) + 2
    is_letter = letters[flat]
    flat[~is_letter] = SPACE
    ids, docs = [], []
    for n in SIZES:
        count = len(flat) - n + 1
        if count < 1:
            continue
        h = np.full(count, n, np.uint32)
        for j in range(n):
            h = (h ^ flat[j : j + count]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        use = np.flatnonzero(is_letter[:count] if n == 1 else (is_letter[:count] | is_letter[1 : count + 1]) if n == 2 else is_letter[1 : count + 1])
        if n > 1:
            use = use[doc[use] == doc[use + n - 1]]
        ids.append((h[use] & np.uint32(BUCKETS - 1)).astype(np.int32))
        docs.append(doc[use])
    return np.concatenate(ids), np.concatenate(docs)


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # BUCKETS x languages: the embeddings times the softmax layer
    bias: np.ndarray
    temperature: float
    threshold: float


class Rows:
    """Average subword vectors held sparse: bucket numbers and shares of each document; parts of them are made dense."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]]):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def dense(self, part: np.ndarray) -> np.ndarray:
        out = np.zeros((len(part), BUCKETS), np.float32)
        for i, k in enumerate(part):
            ids, shares = self.rows[k]
            out[i, ids] = shares
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(x: Rows, y: np.ndarray, languages: list[str], seed: int = 5) -> Model:
    """Stochastic gradient descent on average subword vectors ``x`` with labels ``y``.

    Every fifth document is kept apart: it sets the temperature, and the probability below
    which an answer is rejected.
    """
    rng = np.random.default_rng(seed)
    apart = np.arange(len(x)) % 5 == 4
    if apart.sum() < 2 or len(languages) < 2:
        apart[:] = False
    fit_x, fit_y = np.flatnonzero(~apart), y[~apart]
    embed = (rng.standard_normal((BUCKETS, DIMENSIONS)) * 0.5).astype(np.float32)
    layer = np.zeros((DIMENSIONS, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(len(fit_x))
        for i in range(0, len(order), BATCH):
            part = order[i : i + BATCH]
            some = x.dense(fit_x[part])
            hidden = some @ embed
            off = softmax(hidden @ layer + bias)
            off[np.arange(len(part)), fit_y[part]] -= 1
            off /= len(part)
            back = off @ layer.T
            layer -= rate * hidden.T @ off
            bias -= rate * off.sum(0)
            embed -= rate * 20 * (some.T @ back)
    logits = embed @ layer
    temperature, threshold = 1.0, 0.0
    if apart.any():
        kept = np.flatnonzero(apart)
        z, t = np.concatenate([x.dense(kept[i : i + 1024]) @ logits for i in range(0, len(kept), 1024)]) + bias, y[apart]
        hope = np.full(z.shape, 1 / (len(t) + 2) / (len(languages) - 1))  # as if one more answer were wrong
        hope[np.arange(len(t)), t] = (len(t) + 1) / (len(t) + 2)
        loss = [(-(hope * np.log(softmax(z / k) + 1e-300)).sum(1).mean(), k) for k in np.geomspace(0.1, 10, 41)]
        temperature = float(min(loss)[1])
        p = softmax(z / temperature)
        right = p.max(1)[p.argmax(1) == t]
        threshold = float(np.quantile(right, REJECT)) if len(right) else 0.0
    return Model(languages, logits, bias, temperature, threshold)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The model of at most ``sample`` labelled texts of each language; None without any.

    Rows of the held-out fold are never read for training.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), FOLDS) != HELD_OUT))
    names = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not names:
        return None
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    drawn = rows.select("doc_id", "lang").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sample).select("doc_id", "lang").distinct()
    picked = rows.join(F.broadcast(drawn), ["doc_id", "lang"], "left_semi")  # at most sample ids of each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, doc_id, text in zip(*(batch.column(n).to_pylist() for n in ("lang", "doc_id", "text"))):
                counts = np.bincount(subwords([text])[0], minlength=BUCKETS)
                some = np.flatnonzero(counts)
                out.append((lang, doc_id, some.tolist(), counts[some].tolist()))
            kinds = (pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["lang", "doc_id", "ids", "counts"])

    got = sorted((r for r in picked.mapInArrow(run, "lang string, doc_id long, ids array<int>, counts array<long>").collect() if r.ids), key=lambda r: (hash_id(r.doc_id), r.lang, r.ids))
    got = got[: sample * len(names)]
    parts = [(np.array(r.ids, np.int32), np.array(r.counts, np.float32)) for r in got]
    x = Rows([(ids, counts / max(counts.sum(), np.float32(1))) for ids, counts in parts])
    where = {n: i for i, n in enumerate(names)}
    return fit(x, np.array([where[r.lang] for r in got], int), names) if got else None


def hash_id(doc_id: int | None) -> int:
    return (0 if doc_id is None else doc_id) * 0x9E3779B97F4A7C15 % (1 << 64)


def predict(model: Model, texts: list[str | None]) -> list[tuple[str, float, bool]]:
    """(language, calibrated probability, accepted) of each text; UNKNOWN with 0 where there is no letter."""
    out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, False)] * len(texts)
    some = [i for i, t in enumerate(texts) if t]
    start = 0
    while start < len(some):
        stop, chars = start, 0
        while stop < len(some) and (stop == start or chars + len(texts[some[stop]]) <= BLOCK_CHARS):
            chars += len(texts[some[stop]])
            stop += 1
        part = some[start:stop]
        start = stop
        ids, doc = subwords([texts[i] for i in part])
        n = np.bincount(doc, minlength=len(part))
        z = np.stack([np.bincount(doc, weights=model.logits[ids, k], minlength=len(part)) for k in range(len(model.languages))], 1)
        p = softmax((z / np.maximum(n, 1)[:, None] + model.bias) / model.temperature)
        best = p.argmax(1)
        for i, k, q, m in zip(part, best.tolist(), p.max(1).tolist(), n.tolist()):
            if m:
                out[i] = (model.languages[k], q, q >= model.threshold)
    return out


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The language of each row of ``docs`` (doc_id, text, lang; other columns are ignored) from its whole text.

    lang_pred is a language of the training rows, ``und`` where the text is null or has no
    letter. score is its calibrated probability. accepted is false where that is under the
    threshold that nearly all right answers of the calibration part pass. Without any
    labelled row, everything is ``und``. Repeated rows are judged one by one; a null
    doc_id stays null. An empty table gives an empty table.
    """
    model = train(docs) if model is None else model
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            got = predict(model, texts) if model else [(UNKNOWN, 0.0, False)] * len(texts)
            kinds = (pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *[pa.array([g[i] for g in got], t) for i, t in enumerate(kinds)]], names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (crc_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
