from __future__ import annotations

import random
import re
from collections import defaultdict
from html import unescape

from conftest_helpers import AWKWARD

from spanloom.llm import html, lines

PAGES = "page_id long, url string, html string"


def slow_article(page):
    inner = re.search(r"<article>(.*?)</article>", page or "", re.S)
    parts = re.split(r"</?(?:p|h1)\b[^>]*>", inner[1]) if inner else []
    texts = (" ".join(unescape(re.sub(r"<[^>]+>", "", p.replace("<br>", " "))).split()) for p in parts)
    return "\n".join(t for t in texts if t)


def test_pages_give_their_articles(spark, frame, sf_dir):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    rows += [(9001, None, None), (None, "u", ""), (9002, "u", "<script>"), (9002, "u", "<script>")]
    got = html.extract(frame(rows, PAGES)).collect()
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in got), key=str) == sorted(((i, u, slow_article(h), len(slow_article(h))) for i, u, h in rows), key=str)
    assert html.extract(frame(rows, PAGES).filter("false")).count() == 0


WORDS = "long enough sentences that carry the text of this page and little else, "


def test_boxes_go_and_text_stays():
    page = f"""<html><head><title>t</title></head><body class="has-sidebar"><div id=menu><a href=/>Home</a></div>
    <div class="cookie-banner">We use cookies</div><div class="main-content no-sidebar"><h1>A &lt;title&gt;</h1>
    <p>{WORDS * 4}<a href="x>y">a  link</a>&nbsp;&amp; more<p>Second <b>bold<p>Third</b> {WORDS * 3}
    <ul><li>one<li>two</ul><form><input value=1>Search</form><aside>Side note</aside><div class="advert">Buy</div>
    <table><tr><td>cell a<td>cell b<tr><td>{WORDS}</table></div>
    <section class="comments"><p>{WORDS * 2}nice post</p></section><footer>&copy; me</footer></body></html>"""
    got = html.main_text(page).split("\n")
    assert got[0] == "A <title>" and got[1].endswith("a link & more") and got[2] == "Second bold"
    assert got[4:] == ["one", "two", "cell a", "cell b", WORDS.strip()]
    assert not re.search("cookies|Home|Search|Side note|Buy|nice post|me$", "\n".join(got))


def test_densest_subtree_without_article():
    links = "".join(f"<li><a href=/{i}>link number {i}</a></li>" for i in range(40))
    page = f"<body><div><ul>{links}</ul></div><div><div><p>{WORDS * 5}</p><p>{WORDS * 5}</p></div></div></body>"
    assert html.main_text(page) == "\n".join([(WORDS * 5).strip()] * 2)


def test_density_decides_without_names(sf_dir):
    """All pages of sf0.01 with article as div and other class names: the same texts."""
    import duckdb

    rng = random.Random(0)
    pages = [h for (h,) in duckdb.connect().execute("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    rename = lambda h: re.sub(r'class="[^"]*"', lambda m: f'class="k{rng.randrange(10**6)}"', h).replace("<article", "<div").replace("</article", "</div")
    assert sum(html.main_text(rename(h)) == slow_article(h) for h in pages) == len(pages) == 250


def slow_best(node):
    """The block whose child blocks' densities have the greatest sum, by plain recursion over a tree without links."""
    import math

    def chars(x):
        return sum(len(p.strip()) if isinstance(p, str) else chars(p) for p in x.parts)

    def tags(x):
        return sum(1 + tags(p) for p in x.parts if not isinstance(p, str))

    def density(x):
        c, t = chars(x), max(tags(x), 1)
        return c / t * max(math.log(c * t), 0.0) / max(math.log(math.log(c * 0 + 0 + math.e)), 1e-3) if c else 0.0

    def walk(x):
        yield x
        for p in x.parts:
            if not isinstance(p, str):
                yield from walk(p)

    def total(x):
        kids = [p for p in x.parts if not isinstance(p, str)]
        return sum(map(density, kids)) if kids else density(x)

    return max(walk(node), key=total)


def test_best_node_matches_brute_force():
    rng = random.Random(2)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return f"<p>{'x' * rng.randint(1, 400)}</p>"
        return f"<section>{''.join(tree(depth - 1) for _ in range(rng.randint(1, 5)))}</section>"

    for _ in range(60):
        root = html.parse(f"<body>{tree(4)}{tree(4)}</body>")
        want = slow_best(root)
        nodes = html.in_order(root)
        html.measure(nodes)
        got = max((x for x in nodes if x.block is x), key=lambda x: x.sum)
        assert got is want or abs(got.sum - want.sum) <= 1e-9 * got.sum


def test_what_stands_beside_and_inside_the_text():
    long, links = (WORDS * 5).strip(), "".join(f"<li><a href=/{i}>link number {i}</a></li>" for i in range(40))
    teaser = f"<body><ul>{links}</ul><div><p>{long}</p><p>{long}</p><article class=teaser>short</article></div></body>"
    assert html.main_text(teaser) == f"{long}\n{long}\nshort"
    comment = f"<body><ul>{links}</ul><div><p>{long}</p><p>{long}</p></div><article class=comment><p>{long}</p><p>{long}</p><p>nice post</p></article></body>"
    assert html.main_text(comment) == f"{long}\n{long}"
    siblings = f"<body><ul>{links}</ul><div><article><p>{long}</p><p>{long}</p><p>{long}</p></article><article><p>second {long}</p></article><article><a href=/more>more</a></article></div></body>"
    assert html.main_text(siblings) == "\n".join([long] * 3 + [f"second {long}"])
    headed = f"<body><ul>{links}</ul><article><h1>Head</h1><div><p>{long}</p><p>{long}</p></div></article></body>"
    assert html.main_text(headed) == f"Head\n{long}\n{long}"
    menu = f"<body><main><ul><li><a href=/a>menu</a><li><a href=/b>menu2</a></ul><p>{long}</p><p>{long}</p></main></body>"
    assert html.main_text(menu) == f"{long}\n{long}"


def test_names_are_a_prior_and_never_decide_alone():
    prose = " ".join(f"This is sentence number {i} of the text." for i in range(30))
    for name in ("social-science", "notice-of-motion", "comment-le-faire", "comments"):
        page = f'<body><div class="{name}">{prose}</div><p>tail</p></body>'
        assert prose in html.main_text(page)
    assert html.main_text(f"<body><div class=text><p>{prose}</p><p>{prose}</p></div><div class=comments><p>{prose}</p><p>{prose}</p><p>{prose}</p></div></body>") == f"{prose}\n{prose}"


def test_time_is_linear_in_unclosed_elements():
    import time

    def took(n):
        start = time.perf_counter()
        html.main_text("<b>x" * n + "<p>y</i>" * n + "<article><p>z</p></article>" * n)
        return time.perf_counter() - start

    took(500)
    assert took(16_000) / took(4000) < 10


def test_broken_pages_end():
    assert html.main_text("<div>" * 20_000 + "x") == "x"
    assert html.main_text("plain <5 text") == "plain <5 text"
    assert html.main_text("<p>a<!-- b") == "a"
    assert html.main_text("<a '" * 2000) == ""
    assert html.main_text("<p>a <br> b</p><style>p{}</style><script>var t='</p>';</script>") == "a b"


def passage(rng, n):
    return [" ".join(f"q{rng.randrange(10**9)}" for _ in range(rng.randint(3, 60))) for _ in range(n)]


def words_of(text):
    return re.findall(lines.WORD, text or "")


def test_repeated_passages_are_cut_but_for_one_copy(frame):
    """Passages of over 50 words: whole lines, and sentences in the middle of a line."""
    rng = random.Random(4)
    sentence = lambda: " ".join(f"q{rng.randrange(10**9)}" for _ in range(rng.randint(3, 14))) + "."
    shared = [" ".join(sentence() for _ in range(k)) for k in (8, 9, 10, 12, 14, 30)]
    shared = [p if len(p.split()) > 50 else p + " " + " ".join(sentence() for _ in range(9)) for p in shared]
    rows, own = [], {}
    for i in range(60):
        mine = ["\n".join(" ".join(sentence() for _ in range(rng.randint(1, 4))) for _ in range(3)) for _ in range(2)]
        joint = rng.choice(["\n", " ", " unfinished "])
        rows.append((i, mine[0] + joint + shared[i % 6] + joint.replace("un", "") + mine[1] if i % 3 else "\n".join(mine), "en", "s", 1))
        own[i] = words_of(" ".join(mine))
    got = {r.doc_id: r for r in lines.dedup_lines(frame(rows)).collect()}
    for i, text, *_ in rows:
        left = words_of(got[i].text)
        kept = i % 3 and i == min(j for j in range(60) if j % 3 and j % 6 == i % 6)
        assert got[i].text == text if kept or not i % 3 else [w for w in left if w not in ("unfinished", "finished")] == own[i]
        assert got[i].n_cut_words == len(words_of(text)) - len(left) and got[i].n_cuts == (len(left) < len(words_of(text)))
        assert got[i].n_cut_chars == len(text) - len(got[i].text) and got[i].fp == "own fp"


def repeated_runs(rows):
    """Every maximal run of lines in a text that stands in an earlier text too, of 50 words or more: brute force."""
    from itertools import combinations

    split = [[t[a:b] for a, b in zip(*lines.lines_of(t or ""))] for _, t in rows]
    where = defaultdict(list)
    for d, ls in enumerate(split):
        for k in range(len(ls) - 1):
            where[ls[k], ls[k + 1]].append((d, k))
    runs = set()
    for places in where.values():
        for (d, i), (e, j) in combinations(sorted(places), 2):
            if d == e or i and j and split[d][i - 1] == split[e][j - 1]:
                continue
            n = 0
            while i + n < len(split[d]) and j + n < len(split[e]) and split[d][i + n] == split[e][j + n]:
                n += 1
            if sum(len(words_of(x)) for x in split[e][j : j + n]) >= 50:
                runs.add((e, j, n))
    return split, runs


def test_recall_over_all_repeated_runs_of_a_table(spark, frame):
    """At least 0.9 of the words in repeated runs are cut, and nothing that no other text holds."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(600).collect()
    rows = [(i, r.text) for i, r in enumerate(table)]
    split, runs = repeated_runs(rows)
    assert len(runs) > 20
    got = {r.doc_id: r for r in lines.dedup_lines(frame([(i, t, "en", "s", 1) for i, t in rows])).collect()}
    gone = found = 0
    for e, j, n in runs:
        run = split[e][j : j + n]
        left = got[e].text.count if got[e].text else lambda x: 0
        size = [len(words_of(x)) for x in run]
        found += sum(size)
        gone += sum(k for x, k in zip(run, size) if not left(x))
    assert gone >= 0.9 * found
    corpus = defaultdict(int)
    for _, t in rows:
        for w in set(words_of(t)):
            corpus[w] += 1
    for i, t in rows:  # a word of one text only is never cut
        assert {w for w in words_of(t) if corpus[w] == 1} <= set(words_of(got[i].text))


def test_line_cases(spark, frame):
    long_line = " ".join(f"x{i}" for i in range(60))
    rows = [*AWKWARD, (50, long_line, "en", "s", 1), (51, f"own words\n{long_line}", "en", "s", 1), (51, f"own words\n{long_line}", "en", "s", 1), (None, long_line, "en", "s", 1), (52, f"{long_line}\n{long_line}", "en", "s", 1)]
    got = lines.dedup_lines(frame(rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r.text)
    assert by[50] == [long_line] and sorted(by[51]) == ["", "own words\n"] and by[52] == [""] and "" in by[None] and None in by[2]
    assert sorted(by[4]) == [AWKWARD[5][1]] * 2  # short repeated texts stay
    assert lines.dedup_lines(frame(rows).filter("false")).count() == 0


def test_unlike_rows_of_one_id_and_null_ids(frame):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a), (3, a), (None, a), (None, None)]
    got = sorted(((r.doc_id or 9, r.text or "") for r in lines.dedup_lines(frame([(*r, "en", "s", 1) for r in rows])).collect()))
    assert got == [(1, a), (1, b), (2, ""), (3, ""), (9, ""), (9, "")]
    kept = lines.keep_rest(frame([(*r, "en", "s", 1) for r in rows]))
    assert sorted((r.doc_id or 9, r.text, r.n_chars) for r in kept.collect() if r.text) == [(1, a, 1), (1, b, 1)]
    assert kept.filter("text is null").count() == 1


def test_frequent_chunks_are_dealt_and_joined_without_broadcast(frame, monkeypatch):
    monkeypatch.setattr(lines, "TASK_COPIES", 3)
    monkeypatch.setattr(lines, "HOT", 4)
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 2)
    a, b, c = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(i, f"own{i} {i}\n{a if i % 2 else b}", "en", "s", 1) for i in range(30)] + [(40 + i, c, "en", "s", 1) for i in range(2)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(frame(rows)).collect()}
    assert got == {**{i: t if i < 2 else f"own{i} {i}\n" for i, t, *_ in rows if i < 40}, 40: c, 41: ""}


def test_chunks_differ_though_hashes_agree():
    assert lines.extended("one two three four", 4, "one", "two three", "four") == (0, 18)
    assert lines.extended("one two three four", 4, "zone", "two three", "fours") == (4, 13)
    assert lines.extended("one two three four", 4, "one", "two threx", "four") is None
    assert lines.without("a b c d e", [(2, 5), (4, 7)], 2) == ("a e", 1, 3)


def test_borders_shift_with_a_passage():
    rng = random.Random(9)
    body = "\n".join(passage(rng, 60))
    moved = "\n".join(passage(rng, 7)) + "\n" + body
    a, b = ({t[x : x + n] for _, x, n, _ in zip(*lines.chunk_table([t]))} for t in (body, moved))
    assert len(a) > 20 and len(a - b) <= 3
    hashes = lambda t: set(lines.chunk_table([t])[3].tolist())
    assert len(hashes(body) - hashes(moved)) <= 3
    single = lines.chunk_table(["", "x", " \n ", body])
    assert set(single[0]) == {3} and lines.chunk_table([])[0].size == 0
