"""Queries on the annotation store, reports, built mixtures and written annotations.

The store's rows are made from conversation turns: a turn is a snippet, its role the
oracle, and two segment lists are laid over its text, moved against each other.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import acquire, annotate, builders, dense, metrics, postprocess, sampling, spans, store, windows
from spanloom.plans.label_queries import CHARS, RUNS
from spanloom.session import spread, table

TIERS = [(200, 2.0), (1000, 1.5), (None, 1.0)]
EVENTS = ["click", "purchase", "view"]


def refinements(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    n = F.coalesce(F.length("text"), F.lit(0))
    half = F.floor(n / 2).cast("int")
    lists = lambda cut: F.to_json(F.array(spans.segment(F.lit(0), cut, F.lit("python")), spans.segment(cut, n, F.lit("text"))))
    return turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("r"), (F.col("conv_id") % 5).cast("string")).alias("round_id"), F.when(F.col("turn") % 4 == 3, "rejected").otherwise("ok").alias("status"),
        F.coalesce("role", F.lit("")).alias("oracle"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sample_hash"), F.coalesce("text", F.lit("")).alias("snippet"), n.alias("n"),
        lists(half).alias("predicted"), lists(F.floor(n * (F.col("turn") % 3 + 1) / 4).cast("int")).alias("refined"),
    )


def store_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.rounds(refinements(spark, sf_dir))


def store_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refinements(spark, sf_dir).groupBy("round_id", "status").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sample_hash").alias("n_hashes"))


def store_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and 95th place of the share of characters that a review changed, for each round."""
    rows = store.with_difference(refinements(spark, sf_dir), "n", "predicted", "refined", "diff").filter("n > 0")
    rows = rows.withColumn("diff", F.round("diff", 9))
    return rows.groupBy("round_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("diff"), 8).alias("mean_diff"), store.ranked_value("diff", 0.95).alias("p95_diff"))


def store_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of accepted rows that hold "the", newest first."""
    rows = refinements(spark, sf_dir).filter("status = 'ok'").select("id", "round_id", "snippet")
    return store.page(store.search(rows, [F.col("round_id"), F.col("snippet")], "the"), [F.desc("id")], 2, 25).select("id", "round_id", "total", "pages")


def store_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three copies of the store, partly overlapping, merged."""
    rows = refinements(spark, sf_dir).filter("status = 'ok'").select("sample_hash", "n", "oracle", F.col("id").alias("row_id"), (F.col("id") * 7 % 1000).alias("created"))
    copies = rows.withColumn("source", F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c")))).filter("source = 'a' OR (source = 'b' AND row_id % 2 = 0) OR (source = 'c' AND row_id % 3 = 0)")
    merged = store.merge_stores(copies, "source", "row_id", "created")
    return merged.select("sample_hash", "n", "oracle", "source", "row_id", "created", "n_rows", F.array_join("sources", ",").alias("sources"))


def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return store.upsert(events.filter("event_id % 2 = 0"), events.filter("event_id % 2 = 1"), "user_id", "event_id")


def queried_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with and without a label, by language: semi and anti joins."""
    docs, known = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select("doc_id")
    count = lambda df, name: df.groupBy("lang").agg(F.count(F.lit(1)).alias(name))
    return count(docs.join(known, "doc_id", "left_semi"), "queried").join(count(docs.join(known, "doc_id", "left_anti"), "unqueried"), "lang", "full").na.fill(0)


def change_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.with_difference(refinements(spark, sf_dir), "n", "predicted", "refined", "diff").filter("n > 0").withColumn("diff", F.round("diff", 3))
    return store.cumulative_share(rows, "diff", "share").withColumn("share", F.round("share", 9))


def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.round(F.sum(F.round(store.tiered_cost(F.floor(F.col("n_chars") / 4), TIERS), 9)), 6).alias("cost"))


def metric_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and means of events, a row for each metric and month, a column for each kind."""
    events = table(spark, sf_dir, "events").filter(F.col("event_type").isin(EVENTS))
    long = events.groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("count"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("max"))
    long = long.select("event_type", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("count", "mean", "max")])).alias("m")).select("event_type", "m.*")
    return store.matrix(long, "metric", "event_type", "value", EVENTS)


def pair_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An English, a German and a French text, 200 characters of each, one after the other."""
    docs = builders.ranked(table(spark, sf_dir, "documents").filter("length(text) >= 200 AND lang IN ('en', 'de', 'fr')").select("doc_id", "lang", "text"), "lang", F.col("doc_id").cast("string"))
    out = builders.chains(docs, "lang", ["en", "de", "fr"], "text", 200, "\n\n")
    return out.select("rank", F.md5("content").alias("digest"), spans.joined(F.col("segments")).alias("segments"))


def needle_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 30 characters of a Spanish text put into an English one at a line end past its middle."""
    docs = builders.ranked(table(spark, sf_dir, "documents").filter("length(text) >= 60 AND lang IN ('en', 'es')").select("doc_id", "lang", "text"), "lang", F.col("doc_id").cast("string"))
    hosts = docs.filter("lang = 'en'").select("rank", "text", F.col("lang").alias("label"))
    donors = docs.filter("lang = 'es'").select("rank", F.substring("text", 1, 30).alias("needle"), F.col("lang").alias("needle_label"))
    out = builders.needles(hosts, donors, 0.5)
    return out.select("rank", F.md5("content").alias("digest"), spans.joined(F.col("segments")).alias("segments"), "start")


def fenced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = builders.ranked(table(spark, sf_dir, "documents").filter("length(text) > 0 AND lang IN ('en', 'de')").select("doc_id", "lang", "text"), "lang", F.col("doc_id").cast("string"))
    hosts = docs.filter("lang = 'en'").select("rank", "text")
    blocks = docs.filter("lang = 'de'").select("rank", F.substring("text", 1, 50).alias("block"), F.lit("text").alias("block_label"))
    out = builders.fenced(hosts, blocks, "txt")
    return out.select("rank", F.md5("content").alias("digest"), spans.joined(F.col("segments")).alias("segments"))


def throughput_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = builders.sized(table(spark, sf_dir, "benchmark"), "text", [1024, 10240, 102400])
    return out.select("item_id", "size", F.md5("content").alias("digest"))


def support_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters and documents by stand-in label: what a task's truth holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("truth", dense.lexical_labels(F.col("text")))
    runs = dense.runs_of(docs, "truth", "doc_id")
    return runs.groupBy("label").agg(F.sum(F.col("end") - F.col("start")).alias("n_chars"), F.count(F.lit(1)).alias("n_runs"), F.countDistinct("doc_id").alias("n_docs"))


def parsed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns written as marked blocks by role, parsed back: turns of a conversation are its blocks."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("x")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    said = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: F.concat(F.lit("<CONTENT-TYPE:"), F.upper(x["role"]), F.lit(">\n"), x["text"])), "")
    rows = said.select("conv_id", annotate.content_blocks(text).alias("b"))
    return rows.select("conv_id", F.size("b").cast("long").alias("n_blocks"), F.md5(annotate.stitched(F.col("b"))["content"]).alias("digest"), F.array_join(annotate.adjacent_twins(F.col("b")), ",").alias("twins"), spans.joined(annotate.segments_of(F.col("b"))).alias("segments"))


def near_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance of each whole item to the next item, where it is within the item's own limit."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", r"[^\x20-\x7E]", "?").alias("a"))
    nxt = items.select((F.col("item_id") - 1).alias("item_id"), F.col("a").alias("b"))
    allowed = annotate.distance_limit(F.length("a"))
    distance = annotate.bounded_distance(F.col("a"), F.col("b"), 200)  # no item's limit is over 200
    return items.join(nxt, "item_id").select("item_id", F.when(distance <= allowed, distance).alias("distance"), allowed.alias("allowed"))


def tiled_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three segments of each document, with a hole in every third and an overhang in every fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(30)).alias("n"))
    hole, over = F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0), F.when(F.col("doc_id") % 5 == 0, 9).otherwise(0)
    s = F.array(spans.segment(F.lit(0), F.lit(10), F.lit("a")), spans.segment(10 + hole, F.lit(20), F.lit("a")), spans.segment(F.lit(20), F.col("n") + over, F.lit("b")))
    return docs.withColumn("s", s).select("doc_id", spans.joined(annotate.tiled(F.col("s"), F.col("n"))).alias("segments"))


def word_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 300 characters of every document, 200 apart, ended at a space."""
    out = windows.word_windows(table(spark, sf_dir, "documents"), "text", 300, 200, 120, "doc_id")
    return out.select("doc_id", "win", F.length("content").cast("long").alias("n"), F.md5("content").alias("digest"))


def chunked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most 400 characters, ended at line ends where that is possible."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", windows.chunk_bounds(F.col("text"), 400).alias("b"))
    return docs.select("doc_id", F.posexplode_outer("b").alias("chunk", "x")).filter("x IS NOT NULL").select("doc_id", "chunk", "x.start", "x.end")


def training_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of documents in windows of 512, padded; how many places of each label every window holds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", dense.lexical_labels(F.coalesce("text", F.lit(""))).alias("truth"))
    cut = builders.training_windows(docs, "doc_id", "truth", 512, "-")
    count = lambda c: (F.length("labels") - F.length(F.replace(F.col("labels"), F.lit(c), F.lit("")))).cast("long")
    return cut.select("doc_id", "win", *[count(c).alias(n) for c, n in (("L", "letters"), ("W", "spaces"), ("-", "padding"))])


def window_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Building modes drawn by weight for each document."""
    weights = {"pure": 0.65, "line_inject": 0.15, "markdown": 0.10, "mixed": 0.15}
    docs = table(spark, sf_dir, "documents").select("lang", sampling.weighted_choice(F.concat(F.lit("mode:"), F.col("doc_id").cast("string")), weights).alias("mode"))
    return docs.groupBy("lang", "mode").agg(F.count(F.lit(1)).alias("n"))


def dominant_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document, the 40 characters from the start of a word that hold most letters."""
    docs = table(spark, sf_dir, "benchmark").select("item_id", dense.lexical_labels(F.coalesce("text", F.lit(""))).alias("truth"))
    docs = builders.dominant_window(dense.with_runs(docs, "truth", "runs"), "truth", "runs", F.lit("L"), 40, "w")
    return docs.select("item_id", "w.start", "w.n", "w.share")


def report_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of events as two models: their measures over the best of all, and a mean of two of them."""
    events = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("count"), F.avg("value").alias("mean"), F.max("value").alias("max"))
    long = events.select(F.col("event_type").alias("model"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("count", "mean", "max")])).alias("m")).select("model", "m.*")
    long = long.join(F.broadcast(store.with_optimal(long, "metric", "value")), "metric")
    out = store.compare_reports(long, "click", "view", {"size": ("count", "max")})
    return out.select("name", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


def _scores(text: str, key: object) -> np.ndarray:
    """The stand-in scorer: mostly sure of a character's lexical class, with a doubt that moves with its place."""
    n = len(text)
    kind = np.fromiter((0 if c.isascii() and c.isalpha() else 1 if c.isdigit() and c.isascii() else 2 if c.isspace() else 3 for c in text), int, n)
    place = np.arange(n) + int(key)
    kind = np.where(place % 17 == 0, 3, kind)
    sure = 0.4 + (place * 7 % 50) / 100
    probs = np.repeat(((1 - sure) / 3)[:, None], 4, axis=1)
    probs[np.arange(n), kind] = sure
    return probs


NAMES = ("letter", "digit", "space", "sign")


def processed_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of texts after the whole post-processing chain; the scorer is a stand-in."""
    return postprocess.segment(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", _scores, NAMES)


def thesis_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = postprocess.Options(thesis=True, shortest=4)
    return postprocess.segment(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text", _scores, NAMES, options)


def review_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One round over the benchmark's texts: those that no document equals are scored by the stand-in, 20 requests of 5 snippets."""
    seen = table(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("sample_hash"))
    items = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "id")
    return acquire.review_round(items, "id", "text", seen, _scores, "round-1", 20, 5).drop("snippet")


def label_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of the label ``toxic`` told from low quality, by source."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").select("source", F.when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("truth"), F.when(F.col("quality") == 0, "toxic").otherwise("clean").alias("pred"))
    out = metrics.per_class(metrics.confusion(rows, "source"), "source").filter("label = 'toxic'")
    return out.select("source", "support", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round("f1", 9).alias("f1"))


QUERIES = {
    f.__name__: f
    for f in (
        store_rounds, store_status, store_summary, store_page, store_merge, store_upsert, queried_share, change_ecdf, token_cost, metric_matrix, pair_chains, needle_mix, fenced_mix,
        throughput_set, support_summary, parsed_blocks, near_items, tiled_segments, processed_segments, thesis_segments, label_prices, word_windows, chunked_documents,
        training_windows, window_modes, dominant_windows, report_compare, review_round,
    )
}

REF = """
    ref AS (SELECT conv_id * 1000 + turn AS id, 'r' || (conv_id % 5) AS round_id, CASE WHEN turn % 4 = 3 THEN 'rejected' ELSE 'ok' END AS status, coalesce(role, '') AS oracle, sha256(coalesce(text, '')) AS sample_hash,
      coalesce(text, '') AS snippet, length(coalesce(text, ''))::INTEGER AS n, length(coalesce(text, '')) // 2 AS cut, length(coalesce(text, '')) * (turn % 3 + 1) // 4 AS cut2 FROM conversations)"""
DIFF = "abs(cut - cut2) / n"
RANKED = "SELECT doc_id, lang, text, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id::VARCHAR), doc_id::VARCHAR)::INTEGER AS rank FROM documents WHERE"

ORACLE_SQL = {
    "store_rounds": f"WITH {REF} SELECT round_id, count(*) AS n, max(id) AS last_id FROM ref GROUP BY round_id",
    "store_status": f"WITH {REF} SELECT round_id, status, count(*) AS n, count(DISTINCT sample_hash) AS n_hashes FROM ref GROUP BY ALL",
    "store_summary": f"""
        WITH {REF}, d AS (SELECT round_id, round({DIFF}, 9) AS diff FROM ref WHERE n > 0)
        SELECT round_id, count(*) AS n, round(avg(diff), 8) AS mean_diff, list_sort(list(diff))[floor(0.95 * (count(*) - 1))::INTEGER + 1] AS p95_diff FROM d GROUP BY round_id""",
    "store_page": f"""
        WITH {REF}, s AS (SELECT id, round_id FROM ref WHERE status = 'ok' AND contains(lower(round_id || ' ' || left(snippet, 400)), 'the'))
        SELECT id, round_id, (SELECT count(*) FROM s) AS total, (SELECT greatest(ceil(count(*) / 25), 1)::BIGINT FROM s) AS pages FROM s ORDER BY id DESC LIMIT 25 OFFSET 25""",
    "store_merge": f"""
        WITH {REF}, c AS (SELECT sample_hash, n, oracle, id AS row_id, id * 7 % 1000 AS created, unnest(['a', 'b', 'c']) AS source FROM ref WHERE status = 'ok'),
        k AS (SELECT * FROM c WHERE source = 'a' OR (source = 'b' AND row_id % 2 = 0) OR (source = 'c' AND row_id % 3 = 0))
        SELECT sample_hash, n, oracle, arg_min(source, (source, row_id)) AS source, arg_min(row_id, (source, row_id)) AS row_id, arg_min(created, (source, row_id)) AS created, count(*) AS n_rows,
          array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM k GROUP BY sample_hash, n, oracle""",
    "store_upsert": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id",
    "queried_share": """
        SELECT lang, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS queried, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS unqueried FROM documents GROUP BY lang""",
    "change_ecdf": f"""
        WITH {REF}, d AS (SELECT round({DIFF}, 3) AS diff, count(*) AS n FROM ref WHERE n > 0 GROUP BY 1)
        SELECT diff, n, round(sum(n) OVER (ORDER BY diff) / sum(n) OVER (), 9)::DOUBLE AS share FROM d""",
    "token_cost": """
        SELECT lang, round(sum(round((least(t, 200) * 2.0 + greatest(least(t - 200, 1000), 0) * 1.5 + greatest(t - 1200, 0) * 1.0)::DOUBLE / 1000000, 9)), 6) AS cost
        FROM (SELECT lang, n_chars // 4 AS t FROM documents) GROUP BY lang""",
    "metric_matrix": """
        WITH l AS (SELECT event_type, count(*)::DOUBLE AS "count", round(avg(value), 6) AS mean, max(value) AS "max" FROM events WHERE event_type IN ('click', 'purchase', 'view') GROUP BY 1),
        m AS (UNPIVOT l ON "count", mean, "max" INTO NAME metric VALUE value)
        SELECT metric, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'purchase') AS purchase, max(value) FILTER (event_type = 'view') AS "view" FROM m GROUP BY metric""",
    "pair_chains": f"""
        WITH r AS ({RANKED} length(text) >= 200 AND lang IN ('en', 'de', 'fr'))
        SELECT a.rank, md5(left(a.text, 200) || chr(10) || chr(10) || left(b.text, 200) || chr(10) || chr(10) || left(c.text, 200)) AS digest, '0:202:en,202:404:de,404:604:fr' AS segments
        FROM r a JOIN r b ON a.rank = b.rank AND b.lang = 'de' JOIN r c ON a.rank = c.rank AND c.lang = 'fr' WHERE a.lang = 'en'""",
    "needle_mix": f"""
        WITH r AS ({RANKED} length(text) >= 60 AND lang IN ('en', 'es')),
        p AS (SELECT a.rank, a.text, left(b.text, 30) AS needle, length(a.text) AS n, length(a.text) // 2 AS near FROM r a JOIN r b ON a.rank = b.rank AND b.lang = 'es' WHERE a.lang = 'en'),
        q AS (SELECT *, CASE WHEN contains(substr(text, near + 1), chr(10)) THEN near + strpos(substr(text, near + 1), chr(10)) ELSE n END AS cut FROM p)
        SELECT rank, md5(left(text, cut) || needle || substr(text, cut + 1)) AS digest, '0:' || cut || ':en,' || cut || ':' || (cut + 30) || ':es' || CASE WHEN cut < n THEN ',' || (cut + 30) || ':' || (n + 30) || ':en' ELSE '' END AS segments, cut::INTEGER AS start FROM q""",
    "fenced_mix": f"""
        WITH r AS ({RANKED} length(text) > 0 AND lang IN ('en', 'de')),
        p AS (SELECT a.rank, a.text, left(b.text, 50) AS block, length(a.text) + 8 AS s, length(a.text) + 8 + length(left(b.text, 50)) AS e FROM r a JOIN r b ON a.rank = b.rank AND b.lang = 'de' WHERE a.lang = 'en')
        SELECT rank, md5(text || chr(10) || '```txt' || chr(10) || block || chr(10) || '```' || chr(10)) AS digest, '0:' || s || ':markdown,' || s || ':' || e || ':text,' || e || ':' || (e + 5) || ':markdown' AS segments FROM p""",
    "throughput_set": "SELECT item_id, size, md5(left(repeat(text, (size // length(text) + 1)::BIGINT), size)) AS digest FROM benchmark, (SELECT unnest([1024, 10240, 102400]) AS size) WHERE length(text) > 0",
    "support_summary": f"""
        WITH {CHARS}, {RUNS.format("truth")} SELECT label, sum("end" - start)::BIGINT AS n_chars, count(*) AS n_runs, count(DISTINCT doc_id) AS n_docs FROM r GROUP BY label""",
    "parsed_blocks": """
        WITH t AS (SELECT conv_id, turn, lower(coalesce(role, 'x')) AS role, coalesce(text, '') AS text, sum(length(coalesce(text, ''))) OVER w AS e, lag(lower(coalesce(role, 'x'))) OVER w AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT conv_id, count(*) AS n_blocks, md5(string_agg(text, '' ORDER BY turn)) AS digest, coalesce(string_agg(DISTINCT role, ',') FILTER (role = before), '') AS twins,
          string_agg((e - length(text))::BIGINT || ':' || e::BIGINT || ':' || role, ',' ORDER BY turn) AS segments FROM t GROUP BY conv_id""",
    "near_items": r"""
        WITH i AS (SELECT item_id, regexp_replace(text, '[^\x20-\x7E]', '?', 'g') AS t FROM benchmark),
        p AS (SELECT a.item_id, levenshtein(a.t, b.t) AS d, greatest(8, least(200, floor(length(a.t) * 0.05)))::INTEGER AS allowed FROM i a JOIN i b ON b.item_id = a.item_id + 1)
        SELECT item_id, CASE WHEN d <= allowed THEN d END::INTEGER AS distance, allowed FROM p""",
    "tiled_segments": """
        SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '0:20:a,20:' || greatest(coalesce(length(text), 0), 30) || ':b' END AS segments FROM documents""",
    "word_windows": """
        WITH w AS (SELECT doc_id, text, unnest(range((length(text) - 1) // 200 + 1))::INTEGER AS win FROM documents WHERE length(text) >= 120),
        p AS (SELECT doc_id, win, substr(text, win * 200 + 1, 300) AS p FROM w),
        c AS (SELECT doc_id, win, CASE WHEN length(p) = 300 AND contains(p, ' ') AND 300 - strpos(reverse(p), ' ') >= 150 THEN left(p, 300 - strpos(reverse(p), ' ')) ELSE p END AS c FROM p),
        s AS (SELECT *, min(CASE WHEN length(c) < 120 THEN win END) OVER (PARTITION BY doc_id) AS stop FROM c)
        SELECT doc_id, win, length(c) AS n, md5(c) AS digest FROM s WHERE stop IS NULL OR win < stop""",
    "training_windows": f"""
        WITH {CHARS}, w AS (SELECT doc_id, (pos // 512)::INTEGER AS win, count(*) FILTER (truth = 'L') AS letters, count(*) FILTER (truth = 'W') AS spaces, count(*) AS n FROM x GROUP BY 1, 2)
        SELECT doc_id, win, letters, spaces, 512 - n AS padding FROM w""",
    "window_modes": """
        SELECT lang, CASE WHEN s < 0.65 / 1.05 THEN 'pure' WHEN s < 0.80 / 1.05 THEN 'line_inject' WHEN s < 0.90 / 1.05 THEN 'markdown' ELSE 'mixed' END AS mode, count(*) AS n
        FROM (SELECT lang, (('0x' || left(sha256('mode:' || doc_id), 13))::BIGINT)::DOUBLE / 4503599627370496.0 AS s FROM documents) GROUP BY ALL""",
    "dominant_windows": r"""
        WITH c AS (SELECT item_id, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS pos FROM benchmark WHERE length(text) > 0),
        t AS (SELECT item_id, pos, regexp_full_match(c, '[A-Za-z]') AS l FROM c),
        s AS (SELECT *, coalesce(lag(l) OVER w, false) AS before, count(*) FILTER (l) OVER w2 AS n, count(*) OVER w2 AS size FROM t WINDOW w AS (PARTITION BY item_id ORDER BY pos), w2 AS (PARTITION BY item_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 39 FOLLOWING)),
        b AS (SELECT item_id, pos, n, size FROM s WHERE l AND NOT before QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, pos) = 1)
        SELECT i.item_id, b.pos::INTEGER AS start, b.n::INTEGER AS n, round(b.n / b.size, 9)::DOUBLE AS share FROM benchmark i LEFT JOIN b USING (item_id)""",
    "report_compare": """
        WITH e AS (SELECT event_type, count(*)::DOUBLE AS c, avg(value) AS a, max(value) AS m FROM events GROUP BY 1),
        o AS (SELECT max(c) AS c, max(a) AS a, max(m) AS m FROM e), x AS (SELECT * FROM e WHERE event_type = 'click'), y AS (SELECT * FROM e WHERE event_type = 'view'),
        r AS (SELECT x.c / o.c AS c1, y.c / o.c AS c2, x.a / o.a AS a1, y.a / o.a AS a2, x.m / o.m AS m1, y.m / o.m AS m2 FROM x, y, o)
        SELECT 'count' AS name, round(c1, 6) AS a, round(c2, 6) AS b FROM r UNION ALL SELECT 'mean', round(a1, 6), round(a2, 6) FROM r UNION ALL SELECT 'max', round(m1, 6), round(m2, 6) FROM r
        UNION ALL SELECT 'size', round((c1 + m1) / 2, 6), round((c2 + m2) / 2, 6) FROM r""",
    "label_prices": """
        WITH x AS (SELECT source, toxic = 1 AS t, quality = 0 AS p FROM labels JOIN documents USING (doc_id)),
        s AS (SELECT source, count(*) FILTER (t) AS support, count(*) FILTER (t AND p) AS hit, count(*) FILTER (p) AS guessed FROM x GROUP BY source HAVING count(*) FILTER (t) + count(*) FILTER (p) > 0),
        q AS (SELECT source, support, CASE WHEN guessed > 0 THEN hit / guessed ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r FROM s)
        SELECT source, support, round(p, 9)::DOUBLE AS precision, round(r, 9)::DOUBLE AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9)::DOUBLE AS f1 FROM q""",
}
