from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
from conftest_helpers import AWKWARD, some_text

import corpus_pipeline
from spanloom.llm import hmm, langid, registry


def words(text):
    return (text or "").encode().lower().split()


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def corpus(spark, sf_dir):
    return [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def test_base_scores_and_held_out_gain(spark, frame, sf_dir):
    rows = corpus(spark, sf_dir) + [(70_000 + i, *r[1:]) for i, r in enumerate(AWKWARD)] + [(None, "a b", "en", "s", 1)]
    got = hmm.score(frame(rows), block_bytes=60_000).collect()
    assert len(got) == len(rows)
    counts = Counter()
    for doc_id, text, *_ in rows:
        if crc(doc_id) % 7 != 2:
            counts.update([*words(text), b"\n"])
    n, v = sum(counts.values()), len(counts)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        w = [*words(texts[r.doc_id]), b"\n"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(r.doc_id) % 7 == 2, len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
        assert r.score < 0
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 60_000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_forward_is_exact_and_sums_to_one():
    rng = np.random.default_rng(1)
    model = hmm.maximise(rng.random(3), rng.random((3, 3)), rng.random((hmm.CLASSES + 1, 3)))
    tokens = np.array([5, 9, 5, hmm.CLASSES])
    slow = 0.0
    for path in itertools.product(range(3), repeat=len(tokens)):
        p = model.start[path[0]]
        for t, z in enumerate(path):
            p *= model.emit[tokens[t], z] * (model.move[path[t - 1], z] if t else 1)
        slow += p
    fast = hmm.log_likelihoods(model, [tokens, tokens[:1], np.tile(tokens, 500)])
    assert math.isclose(fast[0], math.log10(slow), rel_tol=1e-9) and np.isfinite(fast[2])
    assert np.allclose([model.start.sum(), *model.move.sum(1), *model.emit.sum(0)], 1)


def test_baum_welch_never_loses_likelihood():
    rng = random.Random(2)
    texts = [hmm.class_ids(some_text(rng, rng.randint(1, 200), 50).encode().split()) for _ in range(30)]
    model, before = hmm.first_model(states=3), -np.inf
    for _ in range(6):
        starts, moves, emits, total = hmm.expect(model, texts, most=700)
        assert math.isclose(emits.sum(), sum(map(len, texts)), rel_tol=1e-9)
        assert total >= before - 1e-6
        before = total
        model = hmm.Model(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))


def test_expected_counts_match_brute_force_and_pass_stretch_borders(monkeypatch):
    rng = np.random.default_rng(3)
    model = hmm.maximise(rng.random(3), rng.random((3, 3)), rng.random((hmm.CLASSES + 1, 3)))
    tokens = rng.integers(0, 5, 7)
    starts, moves, emits, total = np.zeros(3), np.zeros((3, 3)), np.zeros((hmm.CLASSES + 1, 3)), 0.0
    for path in itertools.product(range(3), repeat=len(tokens)):
        p = model.start[path[0]] * model.emit[tokens[0], path[0]]
        for t in range(1, len(path)):
            p *= model.move[path[t - 1], path[t]] * model.emit[tokens[t], path[t]]
        total += p
        starts[path[0]] += p
        for t, z in enumerate(path):
            emits[tokens[t], z] += p
            if t:
                moves[path[t - 1], z] += p
    for long, run in ((1024, 256), (3, 2), (2, 1), (3, 3)):
        monkeypatch.setattr(hmm, "LONG", long)
        monkeypatch.setattr(hmm, "RUN", run)
        got = hmm.expect(model, [tokens])
        assert all(np.allclose(g, w / total) for g, w in zip(got, (starts, moves, emits))) and math.isclose(got[3], math.log(total))
    texts = [rng.integers(0, 400, n) for n in (3000, 1, 17, 900, 257, 256, 2)]
    whole, parted = [], []
    for out, long in ((whole, 10**9), (parted, 100)):
        monkeypatch.setattr(hmm, "LONG", long)
        monkeypatch.setattr(hmm, "RUN", 64)
        out += hmm.expect(model, texts, most=1500)
    assert all(np.allclose(a, b) for a, b in zip(whole, parted))


def test_training_ends_when_a_pass_gains_little(spark, frame):
    rng = random.Random(7)
    rows = [(i, " ".join(f"{'ab'[i % 2]}{rng.randrange(40)}" for _ in range(rng.randint(1, 60))), "en", "s", 1) for i in range(300)]
    blocks = hmm.in_blocks(frame(rows), 2000)
    assert blocks.select("block").distinct().count() > 3 and blocks.count() == 300
    texts = [hmm.class_ids(w) for i, t, *_ in rows if crc(i) % 7 != 2 for w in [words(t)]]
    likely = [hmm.expect(hmm.train(blocks, states=2, passes=n), texts)[3] for n in (1, 2)]
    ended = hmm.expect(hmm.train(blocks, states=2, gain=1e-3), texts)[3]
    assert likely[0] <= likely[1] + 1e-6 and ended >= likely[1] - 1e-3 * abs(likely[1])


def test_empty_corpus(spark, frame):
    assert hmm.score(frame(AWKWARD).filter("false")).count() == 0
    assert langid.identify(frame(AWKWARD).filter("false")).count() == 0


def test_language_held_out_accuracy_and_unknown(spark, frame, sf_dir):
    rows = corpus(spark, "/root/testdata/sf0.01")
    odd = [(80_000, None, "en", "s", 0), (80_001, "12 34 !?", "en", "s", 0), (80_002, "", None, "s", 0), (None, "the thing and", None, "s", 1), (80_003, "é", None, None, None)]
    got = langid.identify(frame(rows + odd)).collect()
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (80_000, 80_001, 80_002)] == ["und"] * 3 and by[80_003].lang_pred != "und"
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert all(r.held_out == (crc(r.doc_id) % 4 == 2) for r in got)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got) and {r.lang_pred for r in got} <= {"en", "de", "fr", "es", "und"}
    assert sum(r.accepted for r in held) > 0.9 * len(held)


def test_language_without_labels(frame):
    rows = [(i, "some text", None, "s", 1) for i in range(5)]
    assert {(r.lang_pred, r.score) for r in langid.identify(frame(rows)).collect()} == {("und", 0.0)}


def test_language_of_one_text_does_not_depend_on_its_neighbours():
    rng = random.Random(1)
    texts = [some_text(rng, 30), "été à la plage", "", None, "x", "1 2"]
    logits = np.random.default_rng(0).random((langid.BUCKETS, 2))
    model = langid.Model(["a", "b"], logits, np.zeros(2), 1.0, 0.0)
    together = langid.predict(model, texts)
    for t, got in zip(texts, together):
        (alone,) = langid.predict(model, [t])
        assert alone[0] == got[0] and math.isclose(alone[1], got[1], rel_tol=1e-9)


def test_every_operator_has_a_query():
    assert [name.split("_")[0] for name in registry.QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_pipeline_stages(spark, sf_dir):
    from spanloom.llm import decontam, quality
    from spanloom.session import table

    docs = table(spark, sf_dir, "documents")
    assert len(corpus_pipeline.STAGES) == 5
    kept, seen = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in kept.collect()}
        kept = spark.createDataFrame(stage(spark, kept, sf_dir).collect(), docs.schema)
        assert kept.columns == docs.columns
        after = {r.doc_id: r for r in kept.collect()}
        assert after.keys() <= before.keys()
        seen.append((before, after, name))
    good = {r.doc_id for r in quality.quality_rules(docs).collect() if r.kept}
    assert seen[0][1].keys() == good
    assert all(r.text == seen[0][0][i].text for i, r in seen[0][1].items())
    for i, r in seen[1][1].items():  # what is left are whole words of the text, in order
        rest = iter((seen[1][0][i].text or "").split())
        assert r.text is None or all(x in rest for x in r.text.split())
        assert r.n_chars == len(r.text)
    bad = {r.doc_id for r in decontam.contamination(spark.createDataFrame(list(seen[3][0].values()), docs.schema), table(spark, sf_dir, "benchmark")).collect() if r.contaminated}
    assert seen[3][1].keys() == seen[3][0].keys() - bad
    packed = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in packed} == seen[3][1].keys()


def test_every_language_is_learned(frame):
    rows = [(i * 300 + j, " ".join([chr(0x4E00 + i) * 3] * 5), f"l{i:03}", "s", 1) for i in range(220) for j in range(4)]
    model = langid.train(frame(rows))
    assert len(model.languages) == len({r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % langid.FOLDS != langid.HELD_OUT}) > 200
