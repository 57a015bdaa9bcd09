from __future__ import annotations

import hashlib
import random
import re

from conftest_helpers import AWKWARD

from spanloom.llm import pii, urls

BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def holds(kind, span):
    d = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(x) <= 255 for x in span.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
    return kind != "phone" or 9 <= len(d) <= 15


def slow_base(text):
    return [(k, m.start(), m.end()) for k, p in BASE for m in re.finditer(p, text or "") if holds(k, m[0])]


def test_base_spans_match_python(spark, frame, sf_dir):
    rng = random.Random(2)
    parts = ["a", "b.", "@", "x@y.z", ".", "1", "255", "256", "0", "1.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (212) 555-0100", "+", "-", " ", "é", "𝒳", "(", ")", "\n", "%", "_", "00", "79927398713", "12"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25))), "en", "s", 1) for i in range(100, 1500)]
    rows += [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = [(20_000 + i, *r[1:]) for i, r in enumerate(rows + AWKWARD)]
    got = pii.digest(pii.find_pii(frame(rows))).collect()
    texts = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        want = slow_base(texts[r.doc_id])
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x[0] for x in want) for k, _ in BASE], texts[r.doc_id][:200]
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest() and r.spans.startswith(line)


def test_checksums_and_context_decide_added_kinds(frame):
    text = "my iban DE89 3704 0044 0532 0130 00, GB82WEST12345698765432, wrong DE89 3704 0044 0532 0130 01; ssn 078-05-1120" + " x" * 60 + " 078-05-1121 and 000-05-1120"
    df = pii.find_pii(frame([(1, text, "en", "s", 1)]))
    row = df.collect()[0]
    assert [text[s.start : s.end] for s in row.pii_iban] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert [text[s.start : s.end] for s in row.pii_ssn] == ["078-05-1120"]
    masked = df.select(pii.masked(df["text"], df["pii_ssn"]).alias("m")).first().m
    assert masked == text.replace("078-05-1120", "[ssn]")


def test_many_matches_in_one_long_text(frame):
    got = pii.digest(pii.find_pii(frame([(1, " 1.2.3.4 a@b.cc" * 3000, "en", "s", 1), (2, "a.b@c" + ".d" * 100_000, "en", "s", 1), (3, "a" * 100_000, "en", "s", 1)]))).collect()
    by = {r.doc_id: r for r in got}
    assert (by[1].n_ip, by[1].n_email) == (3000, 3000) and by[1].spans.endswith(f"ip:{15 * 2999 + 1}:{15 * 2999 + 8}")
    assert by[2].spans == "email:0:200005" and by[3].spans == ""


def test_pii_empty_table(frame):
    assert pii.digest(pii.find_pii(frame(AWKWARD).filter("false"))).count() == 0


def slow_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


PAGES = "page_id long, url string, html string"


def test_urls_and_rules_match_brute_force(spark, frame, sf_dir):
    rows = [(r.page_id, r.url, "") for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    odd = [None, "", "no scheme", "http://", "http://COM/x", "x://a.É.com?q=/en/", "http://www.Example.com/en/1#a/b", "http://example.com/en/", "http://xexample.com/en/", "http://net/es/", "http://a.net/fr", "http://net?a#/fr/", "a://b://c/d", "http://1.2.3.4/", "http://com"]
    rows += [(9000 + i, u, None) for i, u in enumerate(odd)] + [(None, "http://q.org/", ""), (9000, None, None)]
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(30)] + [(None, 1, 1), (9003, None, None)], "doc_id long, quality int, toxic int")
    got = urls.judge_urls(frame(rows, PAGES), urls.outcomes_of(labels)).collect()
    assert len(got) == len(rows)
    want = {(r[0], r[1]): slow_url(r[1]) for r in rows}
    assert sorted(map(str, ((r.page_id, r.host, r.path, r.rule) for r in got))) == sorted(map(str, ((r[0], *want[r[0], r[1]][:3]) for r in rows)))
    verdict = {(h, p): v for h, p, _, v in want.values()}
    assert all(r.verdict == verdict[r.host, r.path] for r in got if r.rule) and {r.verdict for r in got} <= {"allow", "block"}


def test_reputation_shrinks_to_the_domain_and_blocks_by_the_bound(spark, frame):
    rows, marks = [], []
    for host, n, bad in (("a.bad.org", 60, 57), ("b.bad.org", 3, 3), ("c.bad.org", 1, 0), ("x.good.org", 60, 1), ("y.good.org", 1, 1), ("z.good.org", 40, 0), ("w.fine.org", 50, 2)):
        for i in range(n):
            rows.append((len(rows), f"http://{host}/{i}", ""))
            marks.append((rows[-1][0], 0 if i < bad else 1, 0))
    rows += [(10_000, "http://new.bad.org/", ""), (10_001, "http://new.good.org/", ""), (10_002, "http://other.info/", "")]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rate = {r.host: (r.bad_rate, r.verdict) for r in urls.judge_urls(frame(rows, PAGES), urls.outcomes_of(labels)).collect()}
    assert rate["a.bad.org"][1] == "block" and rate["x.good.org"][1] == "allow"
    assert rate["new.bad.org"][0] > rate["other.info"][0] > rate["new.good.org"][0]
    assert rate["y.good.org"][1] == "allow" and rate["y.good.org"][0] < 0.9  # one bad page doesn't condemn a host
    assert rate["c.bad.org"][0] > rate["w.fine.org"][0]


def test_urls_without_outcomes_or_pages(spark, frame):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = [(1, "http://a.org/", ""), (1, "http://a.org/", "")]
    assert [(r.verdict, r.rule) for r in urls.judge_urls(frame(rows, PAGES), urls.outcomes_of(labels)).collect()] == [("allow", None)] * 2
    assert urls.judge_urls(frame(rows, PAGES).filter("false"), urls.outcomes_of(labels)).count() == 0
