"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from spanloom.llm import quality, urls
from spanloom.llm.text import UPPER

_LOWER = f"translate({{0}}, '{UPPER}', '{UPPER.lower()}')"
_WORDS = rf"list_filter(string_split_regex({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x != '')"

OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
i AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, array_to_string(ws[k:k + 12], ' ') AS wid, least(len(ws), 13) AS n FROM (SELECT *, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS k FROM i WHERE len(ws) > 0)),
p AS (SELECT rid, n, k, array_to_string(ws[k:k + n - 1], ' ') AS wid FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n)),
m AS (SELECT p.rid, p.n, p.k, w.item_id FROM p JOIN w ON p.wid = w.wid AND p.n = w.n),
h AS (SELECT rid, count(DISTINCT place) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS place FROM m) GROUP BY rid),
t AS (SELECT rid, count(item) AS n_items, sha256(coalesce(string_agg(item, ',' ORDER BY item), '')) AS items_sha256 FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM m) GROUP BY rid)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)"""


def _fits(rule: tuple[str, str, str]) -> str:
    return f"(host = '{rule[1]}' OR ends_with(host, '.{rule[1]}')) AND starts_with(path, '{rule[2]}')"


_order = sorted(urls.RULES, key=lambda r: -len(r[1] + r[2]))
_rule = "CASE " + " ".join(f"WHEN {_fits(r)} THEN '{r[1] + r[2]}'" for r in _order) + " END"
_verdict = "CASE " + " ".join(f"WHEN {_fits(r)} THEN '{r[0]}'" for r in _order) + " END"
_two = "array_to_string(string_split(host, '.')[-2:], '.')"
_long = f"regexp_matches({_two}, '{urls.TWO_LABELS}')"
_whole = r"regexp_matches(host, '^[0-9.]+$|^[^.]*$|^\[')"


def _weight(keys: str, source: str) -> str:
    low, high = urls.WEIGHTS
    return f"""SELECT {keys} n, bad, CASE WHEN e > 0 AND kids > 1 THEN least(greatest(e / greatest(scatter - e * kids / n, e / {high}) - 1, {low}), {high}) ELSE {high / 10} END AS weight
      FROM (SELECT {keys} sum(n) AS n, sum(bad) AS bad, sum(bad) / sum(n) * (1 - sum(bad) / sum(n)) AS e, sum(bad * bad / n) / sum(n) - (sum(bad) / sum(n)) * (sum(bad) / sum(n)) AS scatter, count(*) AS kids FROM {source} GROUP BY ALL)"""


OP5 = rf"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
s AS (SELECT page_id, coalesce({_LOWER.format("regexp_extract(rest, '(?s)^([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
o AS (SELECT doc_id AS page_id, avg(CASE WHEN toxic = 1 OR quality = 0 THEN 1.0 ELSE 0.0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (toxic IS NOT NULL OR quality IS NOT NULL) GROUP BY doc_id),
k AS (SELECT host, count(*)::DOUBLE AS n, sum(bad) AS bad FROM s JOIN o USING (page_id) GROUP BY host),
h AS (SELECT host, coalesce(n, 0.0) AS n, coalesce(bad, 0.0) AS bad, CASE WHEN {_whole} THEN host WHEN {_long} THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE {_two} END AS domain,
  CASE WHEN {_whole} THEN host WHEN {_long} THEN {_two} ELSE string_split(host, '.')[-1] END AS suffix FROM (SELECT DISTINCT host FROM s) LEFT JOIN k USING (host)),
dm AS ({_weight("domain, suffix,", "(SELECT * FROM h WHERE n > 0)")}),
sf AS ({_weight("suffix,", "(SELECT domain, suffix, n, bad FROM dm)")}),
al AS (SELECT coalesce(max((bad + 1) / (n + 2)), 0.5) AS p0, coalesce(max(weight), {urls.WEIGHTS[0]}) AS w0 FROM ({_weight("", "(SELECT suffix, n, bad FROM sf)")})),
s1 AS (SELECT suffix, (bad + p0 * w0) / (n + w0) AS p1, weight AS w1 FROM sf, al),
d1 AS (SELECT domain, suffix, (bad + p1 * w1) / (n + w1) AS p2, weight AS w2 FROM dm JOIN s1 USING (suffix)),
g AS (SELECT host, h.bad + coalesce(p2, p1, p0) * coalesce(w2, w1, w0) AS a, h.n - h.bad + (1 - coalesce(p2, p1, p0)) * coalesce(w2, w1, w0) AS b FROM h CROSS JOIN al LEFT JOIN d1 USING (domain, suffix) LEFT JOIN s1 USING (suffix)),
r AS (SELECT host, a / (a + b) AS rate, a / (a + b) - {urls.Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS low FROM g)
SELECT page_id, host, path, {_rule} AS rule, coalesce({_verdict}, CASE WHEN low > {urls.LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, round(rate, 9) AS bad_rate FROM s JOIN r USING (host)"""

_grams = "\n".join(
    f"""g{n} AS (SELECT rid, k, count(*) OVER (PARTITION BY rid, array_to_string(ws[k:k + {n - 1}], ' ')) AS seen FROM (SELECT rid, ws, unnest(range(1, len(ws) - {n - 2})) AS k FROM w WHERE len(ws) >= {n})),
c{n} AS (SELECT rid, place, true AS hit FROM (SELECT DISTINCT rid, unnest(range(k, k + {n})) AS place FROM g{n} WHERE seen > 1)),
s{n} AS (SELECT rid, count(*) AS n{n}, sum(length(ws[place]))::BIGINT AS x{n} FROM c{n} JOIN w USING (rid) GROUP BY rid),"""
    for n in (quality.BASE_N, *quality.NGRAM_LIMITS)
)
_bad = " OR ".join(f"coalesce(x{n}, 0) / greatest(word_chars, 1) > {limit}" for n, limit in quality.NGRAM_LIMITS.items())
OP10 = rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x != '') AS ws FROM documents),
{_grams}
l AS (SELECT rid, l, length(l) AS size, row_number() OVER (PARTITION BY rid, l) AS nth FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
ll AS (SELECT rid, count(*) FILTER (nth > 1) AS again, sum(size) FILTER (nth > 1) / greatest(sum(size), 1) AS cover FROM l GROUP BY rid),
b AS (SELECT w.rid, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(again, 0) AS n_dup_lines, coalesce(n5, 0) AS n_repeat_words, coalesce(cover, 0) AS cover, {", ".join(f"x{n}" for n in quality.NGRAM_LIMITS)} FROM w LEFT JOIN ll USING (rid) LEFT JOIN s5 USING (rid) {" ".join(f"LEFT JOIN s{n} USING (rid)" for n in quality.NGRAM_LIMITS)}),
f AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR cover > {quality.LINE_LIMIT} OR {_bad}) AS kept FROM f"""

ORACLE_SQL = {"op4_decontamination": OP4, "op5_urls": OP5, "op10_quality": OP10}
