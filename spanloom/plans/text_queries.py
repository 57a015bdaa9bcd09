"""Queries on texts: cleaning, labels, encodings, sampling and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import encoding, labels, text
from spanloom.operators import sampling, windows
from spanloom.session import table

RAW_NAMES = (
    "JS", "tsx", "C++", "c#", "C-Sharp", "vb.net", " Shell batchfile ", "yml", "plain text", "Makefile", "discovered_lua", "other_x", "go_template", "nginx_config",
    "h", "batch", "Rust", "encoding_base64", "unknown", "", "md", "TypeScript",
)
LICENSES = (("MIT",), ("Apache-2.0", "GPL-3.0"), ("BSD-3-Clause",), (), ("Proprietary",), ("Creative Commons",), ("CC BY-NC 4.0",), ("none",), ("Unlicense", "mit-0"), ("accepted terms",))

#: Characters that the reference hashes to tell whether a text was seen.
MAX_INPUT_CHARS = 10_000


def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and characters for each language and source."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.length("text")).alias("n_chars"))


def ascii_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts over the engine's alphabet."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.ascii_text(F.col("text"))).alias("digest"), F.length(text.ascii_text(F.col("text"))).cast("long").alias("n"))


def text_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    plain = text.ascii_text(t)
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.octet_length(t).cast("long").alias("n_bytes"), text.visible_chars(plain).alias("n_visible"), text.ascii_letters(t).alias("n_letters"),
        F.size(F.split(t, "\n")).cast("long").alias("n_lines"), text.looks_like_json(plain).alias("jsonish"), text.names_framework(plain).alias("framework"),
    )


def clamp_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to 257 bytes, never inside a character."""
    cut = text.clamp_bytes(F.col("text"), 257)
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(cut).cast("long").alias("n_bytes"), F.md5(cut).alias("digest"))


def web_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = text.web_text(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(plain).cast("long").alias("n"), F.md5(plain).alias("digest"))


def strip_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = text.strip_scripts(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(clean).cast("long").alias("n"), F.md5(clean).alias("digest"))


def strip_svg_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.strip_svg_style(F.col("html"))).alias("digest"))


def clean_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read as Markdown: lines, fences, tags and inline code."""
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.clean_markdown(F.col("html"))).alias("digest"))


def php_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PHP parts and template marks of pages, each wrapped into PHP by its number."""
    h = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("<?php echo "), "page_id", F.lit(";?>"), "html", F.lit("<?= $x ?>"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("@section('a')\n{{ $b }}"), "html")).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", h.alias("h")).select("page_id", text.is_php_template(F.col("h")).alias("template"), F.md5(text.php_code(F.col("h"))).alias("digest"))


def license_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents take one of a few license lists by number; verdicts for each list and language."""
    lists = F.array(*[F.array(*map(F.lit, x)).cast("array<string>") for x in LICENSES])
    docs = table(spark, sf_dir, "documents").select("lang", F.pmod("doc_id", F.lit(len(LICENSES))).alias("k"))
    rows = docs.groupBy("lang", "k").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("lang", "k", "n", text.license_verdict(F.get(lists, F.col("k").cast("int"))).alias("v")).select("lang", "k", "n", "v.allowed", "v.reason")


def canonical_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw names, dealt to documents by number: canonical label and routing class with counts."""
    names = F.array(*map(F.lit, RAW_NAMES))
    docs = table(spark, sf_dir, "documents").groupBy(F.pmod("doc_id", F.lit(len(RAW_NAMES))).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    rows = docs.select(F.get(names, F.col("k")).alias("raw"), "n")
    label = labels.canonical_label(F.col("raw"))
    return rows.select("raw", "n", label.alias("label"), labels.route_label(label).alias("route"))


def encode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in hexadecimal and base 64, and how much fits into as many characters."""
    data = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(encoding.encode("hex", data)).alias("hex_md5"), F.md5(encoding.encode("base64", data)).alias("base64_md5"), *[encoding.most_input(k, F.col("n_chars")).alias(f"room_{k}") for k in ("hex", "base64", "base32", "base85")])


def encode_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in base 32, 58 and 85, which neither engine has built in."""
    data = F.encode("text", "UTF-8")
    return table(spark, sf_dir, "documents").select("doc_id", *[encoding.encode(k, data).alias(k) for k in ("base32", "base58", "base85")], encoding.most_input("base58", F.col("n_chars")).alias("room_base58"))


def route_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing and window splits by hashed identity."""
    identity = F.concat_ws("|", "lang", F.substring("text", 1, 256))
    uid = F.sha2(F.col("text"), 256)
    rows = table(spark, sf_dir, "documents").select("lang", sampling.route(identity).alias("route"), sampling.window_split(uid).alias("split"))
    return rows.groupBy("lang", "route", "split").agg(F.count(F.lit(1)).alias("n"))


def source_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return sampling.quotas(counts, "source", "n", 997)


def percentile_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws("::", "lang", "source", F.col("doc_id").cast("string"))
    return sampling.percentile_sample(table(spark, sf_dir, "documents"), key, 0.25).select("doc_id", "lang", "source")


def one_of_each_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    return sampling.one_of_each(docs, "source", F.col("doc_id").cast("string"))


def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    return sampling.round_robin(docs, "source", F.col("doc_id"))


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id")
    return sampling.stratified_split(docs, "lang", F.col("doc_id"), 20, 30)


def unseen_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose first 10,000 characters, as the reference hashes them, aren't those of any labelled document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hashed = docs.select("doc_id", F.sha2(F.substring("text", 1, MAX_INPUT_CHARS), 256).alias("sha"))  # before the join, which then moves no text
    seen = hashed.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("sha")
    return sampling.unseen(docs, "text", seen, MAX_INPUT_CHARS).select("doc_id", "sha")


def full_cycle_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A walk over all documents by rank, in steps of 7919."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return docs.select("doc_id", sampling.full_cycle(F.col("doc_id"), F.lit(1_000_003), 11, 7919).alias("place"))


def pool_locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every global row number of a pool of sources, traced to source and row within it."""
    docs = table(spark, sf_dir, "documents")
    ranges = F.broadcast(sampling.pool_ranges(docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", "n"))  # a row for each source
    hit = (F.col("global_row") >= F.col("first")) & (F.col("global_row") < F.col("last"))
    return docs.select(F.col("doc_id").alias("global_row")).join(ranges, hit).select("global_row", "source", (F.col("global_row") - F.col("first")).alias("row"))


def byte_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 1024 bytes, mapped to the alphabet and cut again."""
    cut = windows.byte_windows(table(spark, sf_dir, "documents"), "text", 1024, "doc_id")
    clean = text.clamp_bytes(text.ascii_text(F.col("content")), 1024)
    return cut.select("doc_id", "win", F.octet_length("content").cast("long").alias("raw_bytes"), F.length(clean).cast("long").alias("n"), F.md5(text.ascii_text(F.col("content"))).alias("digest"))


def overlapping_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(windows.overlapping_spans(F.length("text"), 512)).alias("k", "s")).select("doc_id", "k", "s.start", "s.end")


def cover_all_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.select("doc_id", F.posexplode(windows.cover_all_spans(F.octet_length("text"), 600)).alias("k", "s")).select("doc_id", "k", "s.start", "s.end")


def length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    return docs.groupBy(windows.padded_length(n, "power").alias("power"), windows.padded_length(n, "blocks").alias("blocks")).agg(F.count(F.lit(1)).alias("n"))


def memory_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of each source's documents within a budget of characters."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"))
    rows = windows.batches(docs, "doc_id", F.col("size"), 20_000, "source")
    return rows.groupBy("source", "batch").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("n_chars"))


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation joined and cut at 1000 characters, with the ranges that are left."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    packed = windows.pack_pieces(turns, "conv_id", "turn", "text", 1000)
    ranges = F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",")
    return packed.select("conv_id", F.md5("content").alias("digest"), ranges.alias("ranges"))


ASCII = r"regexp_replace(replace({0}, chr(13), chr(10)), '[^\x20-\x7E\n\t]', '¤', 'g')"


def _unescape(x: str) -> str:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{name}', '{char}')"
    return x


def _rep(x: str, pattern: str, new: str = "") -> str:
    quoted = pattern.replace("'", "''")
    return f"regexp_replace({x}, '{quoted}', '{new}', 'g')"


def _case(pairs: dict[str, str], x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs.items()) + f" ELSE {x} END"


_names = ", ".join(f"'{n}'" for n in RAW_NAMES)
_licenses = ", ".join("[" + ", ".join(f"'{x}'" for x in y) + "]::VARCHAR[]" for y in LICENSES)
_refused = " OR ".join(f"list_contains(list_transform(names, lambda s: contains(s, '{w}')), true)" for w in text.REFUSED_LICENSES)
_allowed = " OR ".join(f"list_contains(list_transform(names, lambda s: contains(s, '{w}')), true)" for w in text.ALLOWED_LICENSES)
_known = ", ".join(f"'{x}'" for x in labels.LABELS)
_scripts = _rep(_rep("html", text.BLOCKS), text.SELF_CLOSED)
_scripts = _rep(_rep(_rep(_scripts, text.HANDLERS), text.SCRIPT_URIS), text.STRAY)
_share = "(('0x' || left(sha256({0}), 13))::BIGINT)::DOUBLE / 4503599627370496.0"
_hash8 = "('0x' || left(sha256({0}), 8))::BIGINT"

QUERIES = {
    f.__name__: f
    for f in (
        corpus_summary, ascii_map, text_measures, clamp_bytes, web_text, strip_scripts, strip_svg_style, clean_markdown, php_code, license_filter, canonical_labels, encode_text,
        encode_rare, route_documents, source_quotas, percentile_sample, one_of_each_source, round_robin, stratified_split, unseen_documents, full_cycle_sample, pool_locate,
        byte_windows, overlapping_spans, cover_all_spans, length_buckets, memory_batches, pack_conversations,
    )
}

ORACLE_SQL = {
    "corpus_summary": "SELECT lang, source, count(*) AS n_docs, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY lang, source",
    "ascii_map": f"SELECT doc_id, md5({ASCII.format('text')}) AS digest, length({ASCII.format('text')}) AS n FROM documents",
    "text_measures": rf"""
        SELECT doc_id, octet_length(encode(text)) AS n_bytes, length(regexp_replace(a, '\s', '', 'g')) AS n_visible, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters,
          len(string_split(text, chr(10)))::BIGINT AS n_lines,
          regexp_matches(trim(a), '(?s)^\{{.*\}}$|^\[.*\]$') OR regexp_matches(trim(a), '^(?:true|false|null|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|"[^"]*")$')
            OR (regexp_matches(trim(a), '[:,]') AND regexp_matches(trim(a), '[{{}}\[\]"]')) AS jsonish,
          regexp_matches(a, '(?i)\b(?:angular|react|svelte|vue)\b') AS framework
        FROM (SELECT *, {ASCII.format("text")} AS a FROM documents)""",
    "clamp_bytes": """
        WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(len(string_split(text, '')))) AS pos FROM documents),
        s AS (SELECT *, sum(octet_length(encode(c))) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM c),
        k AS (SELECT doc_id, max(upto) AS n_bytes, max(pos) + 1 AS n FROM s WHERE upto <= 257 GROUP BY doc_id)
        SELECT d.doc_id, coalesce(k.n_bytes, 0)::BIGINT AS n_bytes, md5(left(text, coalesce(n, 0))) AS digest FROM documents d LEFT JOIN k USING (doc_id)""",
    "web_text": rf"SELECT page_id, length(t) AS n, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(replace({_unescape('html')}, '\n', chr(10)), '<[^>]+>', '', 'g'), '[\s ]+', ' ', 'g')) AS t FROM pages)",
    "strip_scripts": f"SELECT page_id, length(t) AS n, md5(t) AS digest FROM (SELECT page_id, {_scripts} AS t FROM pages)",
    "strip_svg_style": f"SELECT page_id, md5({_rep(_rep('html', text.SVG_STYLE), text.SVG_STYLE_SELF_CLOSED)}) AS digest FROM pages",
    "clean_markdown": f"SELECT page_id, md5({_rep('html', text.TAG)}) AS digest FROM pages WHERE NOT contains(html, '`') AND NOT contains(html, '~~~') UNION ALL SELECT page_id, NULL FROM pages WHERE contains(html, '`') OR contains(html, '~~~')",
    "php_code": rf"""
        SELECT page_id, page_id % 3 = 1 AS template, md5(CASE page_id % 3 WHEN 0 THEN ' echo ' || page_id || ';' || chr(10) || ' $x '
          WHEN 2 THEN CASE WHEN contains(left(html, 4096), '$') AND regexp_matches(lower(left(html, 4096)), 'function|class|->|::') THEN html ELSE '' END ELSE '' END) AS digest FROM pages""",
    "license_filter": rf"""
        SELECT lang, k, n, reason = '' AS allowed, reason FROM (
          SELECT *, CASE WHEN len(names) = 0 THEN 'no_license_info' WHEN {_refused} THEN 'disallowed_license' WHEN {_allowed} THEN '' ELSE 'no_allowed_license' END AS reason FROM (
            SELECT lang, k, n, list_transform([{_licenses}][k + 1], lambda s: regexp_replace(lower(s), '[^a-z0-9.+-]+', ' ', 'g')) AS names FROM (
              SELECT lang, doc_id % {len(LICENSES)} AS k, count(*) AS n FROM documents GROUP BY ALL)))""",
    "canonical_labels": f"""
        WITH a AS (SELECT [{_names}][doc_id % {len(RAW_NAMES)} + 1] AS raw, count(*) AS n FROM documents GROUP BY 1),
        b AS (SELECT *, {_case(labels.ALIASES, "translate(lower(trim(raw)), ' -.', '___')")} AS key FROM a),
        c AS (SELECT *, {_case(labels.MERGED, "key")} AS merged FROM b),
        d AS (SELECT raw, n, CASE WHEN starts_with(key, 'other_') OR starts_with(key, 'discovered_') OR contains(key, 'template') OR ends_with(key, '_config') OR key = 'makefile' THEN 'other'
          WHEN merged IN ({_known}) THEN merged ELSE 'other' END AS label FROM c)
        SELECT raw, n, label, CASE WHEN starts_with(label, 'encoding_base') THEN 'base64' {" ".join(f"WHEN label = '{a}' THEN '{b}'" for a, b in labels.ROUTES.items())} ELSE 'other-lang' END AS route FROM d""",
    "encode_text": """
        SELECT doc_id, md5(lower(hex(encode(text)))) AS hex_md5, md5(base64(encode(text))) AS base64_md5, n_chars // 2 AS room_hex, n_chars // 4 * 3 AS room_base64,
          n_chars // 8 * 5 AS room_base32, n_chars // 5 * 4 AS room_base85 FROM documents""",
    "route_documents": f"""
        SELECT lang, CASE WHEN i < 80 THEN 'window' WHEN i < 90 THEN 'monitor' ELSE 'test' END AS route, CASE WHEN u < 70 THEN 'train' ELSE 'val' END AS split, count(*) AS n FROM (
          SELECT lang, {_hash8.format("lang || '|' || left(text, 256)")} % 100 AS i, {_hash8.format("sha256(text)")} % 80 AS u FROM documents) GROUP BY ALL""",
    "source_quotas": """
        WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
        s AS (SELECT source, n * 997 / sum(n) OVER () AS share FROM c),
        f AS (SELECT source, floor(share)::BIGINT AS low, 997 - sum(floor(share)::BIGINT) OVER () AS rest, row_number() OVER (ORDER BY round(share - floor(share), 9) DESC, source) AS rank FROM s)
        SELECT source, (low + CASE WHEN rank <= rest THEN 1 ELSE 0 END)::BIGINT AS quota FROM f""",
    "percentile_sample": f"SELECT doc_id, lang, source FROM documents WHERE {_share.format(chr(39).join(['lang || ', '::', ' || source || ', '::', ' || doc_id']))} < 0.25",
    "one_of_each_source": "SELECT source, doc_id, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR)) = 1",
    "round_robin": "SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id)::INTEGER AS round FROM documents",
    "stratified_split": "SELECT lang, doc_id, CASE WHEN r <= 20 THEN 'A' ELSE 'B' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 50",
    "unseen_documents": f"""
        WITH d AS (SELECT doc_id, sha256(left(text, {MAX_INPUT_CHARS})) AS sha FROM documents), s AS (SELECT sha FROM d SEMI JOIN labels USING (doc_id))
        SELECT doc_id, sha FROM d ANTI JOIN s USING (sha)""",
    "full_cycle_sample": "SELECT doc_id, (11 + 7919 * doc_id) % 1000003 AS place FROM documents",
    "pool_locate": """
        WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), r AS (SELECT source, sum(n) OVER (ORDER BY source) - n AS a, sum(n) OVER (ORDER BY source) AS b FROM c)
        SELECT doc_id AS global_row, r.source, (doc_id - a)::BIGINT AS "row" FROM documents d JOIN r ON doc_id >= a AND doc_id < b""",
    "byte_windows": rf"""
        WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(len(string_split(text, '')))) AS pos FROM documents WHERE length(text) > 0),
        s AS (SELECT *, sum(octet_length(encode(c))) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM c),
        w AS (SELECT doc_id, ((b - 1) // 1024)::INTEGER AS win, string_agg(c, '' ORDER BY pos) AS content FROM s WHERE (b - octet_length(encode(c))) // 1024 = (b - 1) // 1024 GROUP BY 1, 2)
        SELECT doc_id, win, octet_length(encode(content)) AS raw_bytes, least(length(a), (SELECT max(k) FROM (SELECT unnest(range(length(a) + 1)) AS k) WHERE octet_length(encode(left(a, k))) <= 1024))::BIGINT AS n, md5(a) AS digest
        FROM (SELECT *, {ASCII.format("content")} AS a FROM w)""",
    "overlapping_spans": """
        WITH d AS (SELECT doc_id, length(text) AS n, CASE WHEN length(text) <= 512 THEN 1 ELSE 1 + ceil((length(text) - 512) / 256.0)::BIGINT END AS m FROM documents WHERE text IS NOT NULL),
        k AS (SELECT doc_id, n, unnest(range(m))::INTEGER AS k FROM d)
        SELECT doc_id, k, (k * 256)::INTEGER AS start, least(k * 256 + 512, n)::INTEGER AS "end" FROM k""",
    "cover_all_spans": """
        WITH d AS (SELECT doc_id, octet_length(encode(text)) AS n FROM documents WHERE text IS NOT NULL),
        k AS (SELECT doc_id, n, unnest(range((n + 599) // 600))::INTEGER AS k FROM d WHERE n >= 600)
        SELECT doc_id, k, least(k * 600, n - 600)::INTEGER AS start, least(k * 600 + 600, n)::INTEGER AS "end" FROM k""",
    "length_buckets": """
        SELECT greatest(1024, pow(2, ceil(round(log2(greatest(length(text), 1)), 9))))::BIGINT AS power, (ceil(greatest(length(text), 1) / 256.0) * 256)::BIGINT AS blocks, count(*) AS n
        FROM documents WHERE text IS NOT NULL GROUP BY ALL""",
    "memory_batches": """
        SELECT source, batch, count(*) AS n_docs, sum(size)::BIGINT AS n_chars FROM (
          SELECT source, size, (coalesce(sum(size) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 20000)::BIGINT AS batch
          FROM (SELECT *, coalesce(length(text), 0) AS size FROM documents)) GROUP BY ALL""",
    "pack_conversations": """
        WITH p AS (SELECT conv_id, turn, coalesce(text, '') AS t, sum(length(coalesce(text, '')) + 2) OVER (PARTITION BY conv_id ORDER BY turn) - 2 AS upto FROM conversations)
        SELECT conv_id, md5(left(string_agg(t, chr(10) || chr(10) ORDER BY turn), 1000)) AS digest,
          string_agg((upto - length(t))::BIGINT || '-' || least(upto, 1000)::BIGINT, ',' ORDER BY turn) FILTER (WHERE upto - length(t) < 1000) AS ranges FROM p GROUP BY conv_id""",
}
