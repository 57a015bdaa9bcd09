from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from conftest_helpers import AWKWARD, some_text  # noqa: F401

from spanloom.llm import packing, quality
from spanloom.llm.registry import tokenizer_path

SPACE = "\x20\x09-\x0d"


def slow_quality(text):
    found = re.findall(f"[^{SPACE}]+", text or "")
    windows = [tuple(found[i : i + 5]) for i in range(len(found) - 4)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(f"[^{SPACE}]", x)]
    again = sum(x in lines[:i] for i, x in enumerate(lines))
    failed = len(found) < 10 or 100 * len(covered) > 20 * len(found)
    return len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered), failed


def test_quality_base_matches_brute_force(spark, frame, sf_dir):
    real = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(120).collect()]
    rows = [r for r in real + AWKWARD if len(r[1] or "") < 20_000]
    got = quality.quality_rules(frame(rows)).collect()
    want = Counter((r[0], *slow_quality(r[1])) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)


def test_quality_repetition_and_clean_texts(frame):
    import random

    rng = random.Random(1)
    clean = " ".join(f"u{i}" for i in range(400))
    block = " ".join(f"b{i}" for i in range(14))
    repeated = (block + " " + some_text(rng, 30, 10**9) + " ") * 3
    got = {r.doc_id: r for r in quality.quality_rules(frame([(1, clean, "en", "s", 1), (2, repeated, "en", "s", 1)])).collect()}
    assert got[1].kept and got[1].ngram_cover == [0.0, 0.0]
    assert not got[2].kept and max(got[2].ngram_cover) > 0.2
    assert quality.keep_good(frame([(1, clean, "en", "s", 1), (2, repeated, "en", "s", 1)])).select("doc_id", "fp").collect()[0][:] == (1, "own fp")


def test_line_cover_counts_characters_not_bytes():
    wide, plain = "é" * 30, "a" * 80
    text = f"{wide}\n{plain}\n{wide}\n \x85\n \x85\n\t"  # 32 of 144 characters; with bytes 63 of 206 and over the limit of 0.3
    got = quality._measure([text], {}, 0.3)
    assert abs(got["line_cover"][0] - 32 / 144) < 1e-12 and got["n_dup_lines"] == [2]
    assert slow_quality(text)[3] == 2


def test_quality_empty_table(frame):
    df = frame([(1, "a", "en", "s", 1)]).filter("doc_id < 0")
    assert quality.quality_rules(df).count() == 0 and quality.keep_good(df).count() == 0


def test_rolling_windows_stay_in_their_document():
    hashes = np.array([5, 6, 7, 5, 6, 7], np.uint64)
    assert not quality.repeated_words(hashes, np.array([0, 0, 0, 1, 1, 1]), 2).any()
    assert quality.repeated_words(hashes, np.zeros(6, int), 2).tolist() == [True] * 6


def test_nnls_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.random((12, 30)), rng.random(12) * 10
        x = packing.nnls(a, b)
        slope = a.T @ (b - a @ x)
        assert (x >= 0).all() and (slope <= 1e-6).all() and np.abs(slope[x > 1e-9]).max(initial=0) < 1e-6


def test_combinations_fill_the_window():
    table = packing.combinations(16)
    assert (np.arange(17) @ table == 16).all() and table.sum(0).max() == 3


def test_least_squares_decides_in_small_blocks_too(monkeypatch):
    solved = []
    real = packing.nnls
    monkeypatch.setattr(packing, "nnls", lambda a, b: solved.append(real(a, b)) or solved[-1])
    got = list(packing.pack([1024, 3072, 2048, 2048, 4096, 64, 4032]))
    assert len(solved) == 1 and np.floor(solved[0] + 1e-6).sum() == 3  # 16 + 48, 32 + 32 and 1 + 63 units
    assert sorted(len(s) for s in got) == [1, 2, 2, 2] and all(sum(p[2] for p in s) == 4096 for s in got)


def test_solver_says_when_it_stops_unsolved():
    import pytest

    table = packing.combinations(64)
    with pytest.warns(RuntimeWarning):
        packing.nnls(table, np.arange(65.0), 2)


def test_pack_covers_every_token_once_and_pads_nothing():
    rng = np.random.default_rng(3)
    for n, top in ((0, 10), (1, 9000), (7, 300), (3000, 2500), (500, 9000)):
        lengths = rng.integers(1, top, n).tolist()
        pieces = defaultdict(list)
        for sequence in packing.pack(lengths):
            used = sum(p[2] for p in sequence)
            assert used <= 4096 and used & (used - 1) == 0
            for doc, start, k in sequence:
                assert k > 0
                pieces[doc].append((start, k))
        for doc, total in enumerate(lengths):
            at = 0
            for start, k in sorted(pieces[doc]):
                assert start == at
                at += k
            assert at == total


def test_pack_documents_round_trip(spark, frame, sf_dir):
    from tokenizers import Tokenizer

    real = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = [*real, *[(10_000 + i, *r[1:]) for i, r in enumerate(AWKWARD)]]
    got = packing.pack_documents(frame(rows), tokenizer_path).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    texts = {r[0]: r[1] for r in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == texts.keys()
    for doc, pieces in by_doc.items():
        ids = np.array([*(tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids), packing.END_ID], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_pack_null_ids_repeated_rows_and_empty_table(frame):
    got = packing.pack_documents(frame(AWKWARD), tokenizer_path).collect()
    assert sum(r.doc_id is None for r in got) >= 2
    assert sum(r.length for r in got if r.doc_id == 4) == 2 * next(r.doc_tokens for r in got if r.doc_id == 4)
    assert packing.pack_documents(frame(AWKWARD).filter("false"), tokenizer_path).count() == 0
