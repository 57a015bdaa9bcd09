from __future__ import annotations

import numpy as np

from spanloom.operators import heal, rules
from spanloom.operators.postprocess import Page

IDS = {"text": 0, "markdown": 1, "tex": 2, "json": 3, "javascript_typescript": 4}


def test_text_goes_to_the_one_best_host():
    labels = np.array([0] * 5 + [1] * 12 + [2] * 11)
    visible = np.ones(28, bool)
    assert rules.host_relabel(labels, visible, IDS).tolist() == [1] * 17 + [2] * 11
    tie = np.array([0] * 5 + [1] * 12 + [2] * 12)
    assert rules.host_relabel(tie, np.ones(29, bool), IDS).tolist() == tie.tolist()
    few = np.array([0] * 5 + [1] * 9)
    assert rules.host_relabel(few, np.ones(14, bool), IDS).tolist() == few.tolist()


def test_inner_runs_go_to_a_supported_or_declared_host():
    labels = np.array([4] * 6 + [3] * 4 + [4] * 6)
    assert set(rules.host_relabel(labels, np.ones(16, bool), IDS).tolist()) == {4}
    far = np.array([4] * 12 + [0] * 2 + [3] * 4)
    assert rules.host_relabel(far, np.ones(18, bool), IDS)[-1] == 3
    assert rules.host_relabel(far, np.ones(18, bool), IDS, "javascript_typescript")[-1] == 4
    assert rules.host_relabel(np.zeros(0, int), np.zeros(0, bool), IDS).size == 0


def test_json_like():
    assert all(map(rules.json_like, ('{"a": 1}', "[1]", '"x"', "null", "-1.5e3", '"a": 1', "[1, 2")))
    assert not any(map(rules.json_like, ("", "word", "a, b", "01", "f(x)")))


def test_local_hosts():
    pairs = [(3, 4, True)]
    text = "ab[1]cd"
    assert rules.local_hosts(text, np.array([4, 4, 3, 3, 3, 4, 4]), pairs).tolist() == [4] * 7
    assert rules.local_hosts("abxyzcd", np.array([4, 4, 3, 3, 3, 4, 4]), pairs).tolist() == [4, 4, 3, 3, 3, 4, 4]
    one_side = np.array([4] * 4 + [3] * 3)
    assert rules.local_hosts("abcd[1]", one_side, pairs).tolist() == one_side.tolist()
    assert set(rules.local_hosts("abcdefghij[1]", np.array([4] * 10 + [3] * 3), pairs).tolist()) == {4}


def test_fences():
    text = "a ```x y``` b\n```py z\n``q``"
    labels = np.array([0] * len(text))
    labels[5] = 5
    got, settled = rules.fill_fences(Page(text, np.zeros((len(text), 2))), labels, 9)
    assert got[2:11].tolist() == [9, 9, 9, 0, 0, 0, 9, 9, 9]
    assert got[14:19].tolist() == [9] * 5 and got[19:].tolist() == [0] * 8
    assert settled.tolist() == [False] * 2 + [True] * 9 + [False] * 3 + [True] * 5 + [False] * 8


def test_line_edges():
    text = "aaaa\nbbbbb\ncccc"
    assert rules.line_edges(text, np.array([1, 1, 1, 7] + [1] + [7, 2, 2, 2, 7] + [2] + [7, 7, 3, 3])).tolist() == [1] * 5 + [2] * 6 + [3] * 4
    first = np.array([7, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 9])
    assert rules.line_edges(text, first)[0] == 7 and rules.line_edges(text, first)[-1] == 9


def test_realign_levels():
    source = 'x = "a"\n# b\nend of it\n'
    cut = lambda found: [source[a:b] for a, b, _ in found]
    found, level = heal.realign(source, [("py", 'x = "a"\n'), ("text", "# b\nend of it\n")])
    assert level == "exact" and cut(found) == ['x = "a"\n', "# b\nend of it\n"]
    found, level = heal.realign(source, [("py", 'x = \\"a\\"\\n'), ("text", "# b\\nend of it\\n")])
    assert level == "escapes" and cut(found) == ['x = "a"\n', "# b\nend of it\n"]
    found, level = heal.realign(source, [("py", 'x="a"'), ("text", "# b end of it")])
    assert level == "blanks" and cut(found) == ['x = "a"\n', "# b\nend of it\n"]
    found, level = heal.realign(source, [("py", 'x = "a"\n'), ("text", "# b\nend off it\n")])
    assert level == "edits" and cut(found) == ['x = "a"\n', "# b\nend of it\n"]
    assert heal.realign(source, [("py", "something"), ("text", "else altogether, that has nothing to do with it at all")]) == ([], "refused")
    assert heal.realign(source, [("py", "whatever")])[0] == [(0, len(source), "py")]
    assert heal.realign(source, []) == ([], "refused") and heal.realign("", [("a", "b")]) == ([], "refused")


def test_realigned_segments_tile_the_source():
    rng = np.random.default_rng(0)
    for _ in range(100):
        source = "".join(rng.choice(list("ab \n\"é"), 60))
        cut = int(rng.integers(1, 59))
        answer = list(source)
        for _ in range(int(rng.integers(0, 4))):
            answer[int(rng.integers(0, 60))] = str(rng.choice(["", "x", " "]))
        parts = [("a", "".join(answer[:cut])), ("b", "".join(answer[cut:]))]
        found, level = heal.realign(source, parts)
        if level != "refused":
            assert "".join(source[a:b] for a, b, _ in found) == source


def test_drop_share():
    assert heal.drop_share("abcdefghij" * 3, [("a", "abcdefghij" * 2)])[2] and not heal.drop_share("abc", [("a", "abc")])[2]


def test_heal_rows(spark):
    rows = spark.createDataFrame([(1, "ab", [("x", "a"), ("y", "b")]), (2, None, None)], "id long, source string, parts array<struct<type:string,content:string>>")
    got = {r.id: (r.level, [tuple(s) for s in r.segments]) for r in heal.heal(rows, "id", "source", "parts").collect()}
    assert got == {1: ("exact", [(0, 1, "x"), (1, 2, "y")]), 2: ("refused", [])}


def test_browsing_chain_traces_its_steps():
    text = "a ```x y``` b\nplain words here\n"
    labels = np.zeros(len(text), int)
    labels[6] = 1
    got, steps = rules.process_page(text, labels, np.full((len(text), 3), 1 / 3), 2, [(1, 0, True)])
    assert got[2:5].tolist() == [2] * 3 and steps[2] == 1 and (got[5:8] == got[5]).all()
    assert (steps[got == labels] == 0).all() or steps.max() > 1
    empty, none = rules.process_page("", np.zeros(0, int), np.zeros((0, 3)), 2, [])
    assert empty.size == none.size == 0


def test_review_round_skips_seen_texts_and_caps(spark):
    from pyspark.sql import functions as F

    from spanloom.operators import acquire

    rows = spark.createDataFrame([(i, "abc 123 " * 30 + f"end {i}") for i in range(5)] + [(9, "abc 123 " * 30 + "end 1"), (10, None)], "id long, text string")
    seen = rows.filter("id = 0").select(F.sha2("text", 256).alias("sample_hash"))
    scorer = lambda t, k: np.array([[0.6, 0.4] if c.isalpha() else [0.4, 0.6] for c in t])
    got = acquire.review_round(rows, "id", "text", seen, scorer, "r1", 2, 1).collect()
    assert len(got) == 2 and all(r.id in (1, 2, 3, 4) and r.snippet and r.round_id == "r1" for r in got)
    every = acquire.review_round(rows, "id", "text", seen, scorer, "r1", 100, 10).collect()
    assert {r.id for r in every} == {1, 2, 3, 4} and [r.score for r in every] == sorted((r.score for r in every), reverse=True)


def test_more_builders(spark):
    from pyspark.sql import functions as F

    from spanloom.operators import builders, spans

    hosts = spark.createDataFrame([(1,), (2,)], "rank int")
    got = {r.rank: r for r in builders.payloads(hosts, [("nc {ip} {port}", "shell"), ("x {name}", "python")]).collect()}
    assert got[2].needle.startswith("nc 10.") and got[2].needle_label == "shell" and got[1].needle_label == "python" and "{" not in got[1].needle + got[2].needle
    df = spark.createDataFrame([("abcdef", [(0, 3, "x"), (3, 6, "y")])], f"t string, s {spans.SEGMENTS}")
    r = builders.remove_substring(df, "t", "s", F.lit(2), F.lit(4)).first()
    assert r.t == "abef" and [tuple(x) for x in r.s] == [(0, 2, "x"), (2, 4, "y")]
    assert spark.range(1).select(builders.spaced_hex(F.lit("aab bcc d"), 2).alias("h")).first().h == "aa bb cc d"
    stored = spark.range(1000).select(F.col("id").cast("string").alias("id"))
    n = builders.replay(stored.limit(0), stored, F.col("id"), 0.3).count()
    assert 230 < n < 370
    texts = [r.content for r in builders.random_rows(stored.limit(20), F.col("id"), 50, "abc").collect()]
    assert all(len(t) == 50 and set(t) <= set("abc") for t in texts) and len(set(texts)) == 20


def test_compatible_stores(spark, tmp_path):
    from spanloom.sources.readers import compatible_stores

    spark.range(2).selectExpr("id", "id AS status").write.parquet(str(tmp_path / "good"))
    spark.range(2).write.parquet(str(tmp_path / "other"))
    (tmp_path / "text").write_text("x")
    assert [p.rpartition("/")[2] for p in compatible_stores(spark, str(tmp_path), ("id", "status"))] == ["good"]


def test_picks_match_brute_force(spark):
    import random

    from spanloom.operators import acquire

    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("AABBC") for _ in range(n)), [rng.randrange(8) / 8 for _ in range(n)]) for i, n in enumerate([0, 1, 2, 40, 300, 900])] + [(9, None, None)]
    df = acquire.candidates(spark.createDataFrame(rows, "id int, labels string, doubt array<double>"), "labels", "doubt", "spans", context=20)
    got = {r.id: (r.spans, r.picks) for r in acquire.candidates(df, "labels", "doubt", "picks", context=20, most=16).collect()}
    for i, labels, _ in rows:
        spans, taken = got[i][0], []
        assert {s.boundary for s in spans} <= {k for k in range(1, len(labels or "")) if labels[k] != labels[k - 1]}
        assert all((s.left_label, s.right_label) == (labels[s.boundary - 1], labels[s.boundary]) for s in spans)
        for s in sorted(spans, key=lambda s: (-s.score, s.boundary)):
            if len(taken) < 16 and all(s.end + 24 <= k.start or k.end + 24 <= s.start for k in taken):
                taken.append(s)
        assert got[i][1] == sorted(taken, key=lambda s: s.start)
