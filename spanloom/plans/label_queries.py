"""Queries on dense labels: runs, segments, post-processing, metrics and acquisition.

No scores of a neural model are at hand, so a stand-in labelling is used: the truth is
the lexical class of each character, the prediction the same with every 17th place
(shifted by document) called a sign.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.operators import acquire, dense, evaluation, files, metrics, spans, windows
from spanloom.session import spread, table

RADIUS = 4


def labelled(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """(doc_id, keep, text, truth, pred); null texts are empty."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", *keep, F.coalesce("text", F.lit("")).alias("text")))
    docs = docs.withColumn("truth", dense.lexical_labels(F.col("text")))
    return docs.withColumn("pred", dense.perturbed(F.col("truth"), F.col("doc_id")))


def label_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.runs_of(labelled(spark, sf_dir), "truth", "doc_id")


def dense_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels painted from segments with gaps, and their digest."""
    docs = labelled(spark, sf_dir)
    n = F.length("text")
    segments = F.array(*[F.struct((n * a / 10).cast("int").alias("start"), (n * b / 10).cast("int").alias("end"), F.lit(c).alias("label")) for a, b, c in ((0, 3, "A"), (2, 6, "B"), (7, 7, "C"), (8, 12, "D"))])
    return docs.select("doc_id", F.md5(dense.dense_of(segments, n, "-")).alias("digest"))


def label_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = dense.with_runs(labelled(spark, sf_dir), "truth", "runs")
    return runs.select("doc_id", F.greatest(F.size("runs") - 1, F.lit(0)).cast("long").alias("n_boundaries"), F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["start"]).alias("sum_places"))


def label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.counted(labelled(spark, sf_dir), "truth", "pred")


def _seen(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """The confusion at places whose truth isn't white space."""
    return evaluation.counted(labelled(spark, sf_dir, *keep), "truth", "pred", *keep, valid=True)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in df.dtypes])


def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.per_class(_seen(spark, sf_dir)).drop("hit", "guessed"))


def overall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.overall(metrics.per_class(_seen(spark, sf_dir, "lang"), "lang"), "lang"))


def top_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.top_confusions(_seen(spark, sf_dir), 2))


def accuracy_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy overall, for each language, and for each language and source."""
    rows = evaluation.counted(labelled(spark, sf_dir, "lang", "source"), "truth", "pred", "lang", "source")
    hits = F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0))
    sums = rows.groupingSets([[], ["lang"], ["lang", "source"]], "lang", "source").agg(F.sum("n").alias("n"), hits.alias("hits"), F.grouping_id().cast("long").alias("level"))
    return sums.select("lang", "source", "level", "n", "hits")


def boundary_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confusion within four places of a boundary of the truth."""
    return evaluation.counted(labelled(spark, sf_dir), "truth", "pred", near=RADIUS)


def region_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document, the middle third: visible places, right ones, and whether half are right."""
    n = F.length("text")
    middle = F.struct(F.floor(n / 3).cast("int").alias("start"), F.floor(n * 2 / 3).cast("int").alias("end"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("host"))
    rows = evaluation.region_counts(labelled(spark, sf_dir).withColumn("regions", F.array(middle)), "truth", "pred", "regions", "L", "doc_id").filter("total > 0")
    return rows.select("doc_id", "total", F.col("exact").alias("right"), (F.col("exact") * 2 >= F.col("total")).alias("hit"))


def space_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dense.fill_space(labelled(spark, sf_dir), "text", "pred", "filled")
    return docs.select("doc_id", F.md5("filled").alias("digest"))


def confidence_gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places whose stand-in probability is under .35, by predicted label."""
    docs = labelled(spark, sf_dir).withColumn("best", F.transform(dense.codes(F.col("pred")), lambda c, i: F.pmod(i * 13 + F.col("doc_id"), F.lit(20)) / 20.0))
    gated = dense.gate(docs, "pred", "best", 0.35, "gated")
    return metrics.confusion(metrics.places(gated, "pred", "gated").select(F.col("truth"), F.col("pred")))


def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dense.smooth_once(labelled(spark, sf_dir), "pred", 3, "smooth")
    return docs.select("doc_id", F.md5("smooth").alias("digest"))


def segment_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clip, shift, insert, delete and merge on three segments made from each document's length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.coalesce(F.length("text"), F.lit(0)), F.lit(9)).alias("n"))
    third = F.floor(F.col("n") / 3).cast("int")
    seg = spans.segment
    docs = docs.withColumn("s", F.array(seg(F.lit(0), third, F.lit("a")), seg(third, 2 * third, F.lit("b")), seg(2 * third, F.col("n"), F.lit("a"))))
    guest = F.array(seg(F.lit(0), F.lit(5), F.lit("g")))
    return docs.select(
        "doc_id", spans.joined(spans.clip(F.col("s"), third - 2, 2 * third + 1)).alias("clipped"), spans.joined(spans.insert(F.col("s"), guest, third + 1, F.lit(5))).alias("inserted"),
        spans.joined(spans.delete(F.col("s"), third, 2 * third)).alias("deleted"), spans.joined(spans.delete(F.col("s"), third - 1, third + 1)).alias("cut"),
        spans.context_label(F.col("s"), third, "x").alias("context"), F.round(spans.label_share(F.col("s"), F.lit("a"), F.col("n")), 9).alias("share"),
        F.array_join(spans.cover_errors(F.slice("s", 2, 2), F.col("n"), ("a", "c")), ",").alias("errors"),
    )


def byte_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each line starts, in characters and in bytes."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").withColumn("lines", F.split("text", "\n"))
    rows = docs.select("doc_id", F.posexplode_outer("lines").alias("line", "l"))
    before = Window.partitionBy("doc_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c + 1).over(before), F.lit(0)).cast("int")
    return rows.select("doc_id", "line", upto(F.length("l")).alias("char_start"), upto(F.octet_length("l")).alias("byte_start"))


def overlap_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of overlapping windows of turns, voted with Gaussian weights; how many places change label."""
    turns = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).filter("length(text) > 0").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    turns = turns.withColumn("truth", dense.lexical_labels(F.col("text")))
    cut = turns.select("id", "truth", F.posexplode_outer(windows.overlapping_spans(F.length("text"), 64)).alias("k", "s"))
    marked = cut.select("id", "s", F.posexplode_outer(F.transform(dense.codes(F.substring(F.col("truth"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))), lambda c, i: F.when(F.pmod(i + F.col("k"), F.lit(11)) == 0, "P").otherwise(c))).alias("off", "label"))
    votes = marked.select("id", (F.col("s.start") + F.col("off")).alias("pos"), "label", windows.gaussian_weight(F.col("off"), F.col("s.end") - F.col("s.start")).alias("weight"))
    return windows.vote_merge(votes, "id").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def _doubt(q: float) -> str:
    return f"(-({q} * ln({q}) + (1 - {q}) * ln((1 - {q}) / 4)) / ln(5))"


def _doubted(spark: SparkSession, sf_dir: str, most: int | None = None) -> DataFrame:
    """(id, truth, spans): scored boundaries of turns at the operator's own threshold and context, with a stand-in probability for each place."""
    turns = spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")).filter("length(text) > 0").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    turns = turns.withColumn("truth", dense.lexical_labels(F.col("text")))
    q = lambda i: F.lit(0.3) + F.pmod(i * 7 + F.col("id"), F.lit(50)) / 100.0
    turns = turns.withColumn("doubt", F.transform(F.sequence(F.lit(0), F.length("text") - 1), lambda i: acquire.peaked_entropy(q(i), 5)))
    return acquire.candidates(turns, "truth", "doubt", "spans", most=most)


def review_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _doubted(spark, sf_dir)
    return found.select("id", F.explode_outer("spans").alias("s")).filter("s IS NOT NULL").select("id", "s.boundary", "s.start", "s.end", "s.score", "s.flip_rate", "s.left_label", "s.right_label")


def review_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of each turn that are picked greedily, by the operators' own parameters."""
    found = _doubted(spark, sf_dir, most=16)
    return found.select("id", F.explode_outer("spans").alias("s")).filter("s IS NOT NULL").select("id", "s.boundary", "s.start", "s.end")


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity told by text length, at ten thresholds."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.pmod("n_chars", F.lit(1000)).alias("score"), F.col("toxic").alias("yes"))
    return _rounded(metrics.threshold_sweep(docs, "score", "yes", [100.0 * k for k in range(10)]))


def boundary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(files.exact_boundaries(labelled(spark, sf_dir), "truth", "pred"))


def near_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries of each document matched within four places."""
    return files.near_boundaries(labelled(spark, sf_dir), "doc_id", "truth", "pred")


def guest_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of digits and wide characters as guests (of base64 and sql) in carriers named by the source."""
    docs = dense.with_runs(labelled(spark, sf_dir, "source"), "truth", "runs").withColumn("codes", dense.codes(F.col("pred")))
    held = lambda r: F.aggregate(F.sequence(r["start"], r["end"] - 1), F.lit(0), lambda a, k: a + (F.get("codes", k) == r["label"]).cast("int"))
    few = F.filter("runs", lambda r: r["label"].isin("D", "N"))
    rows = docs.select("source", F.explode_outer(F.transform(few, lambda r: F.struct(r["label"].alias("label"), (r["end"] - r["start"]).alias("size"), held(r).alias("hits")))).alias("r")).filter("r IS NOT NULL")
    carrier = F.when(F.col("source").endswith("1"), "PHP").when(F.col("source").endswith("2"), "HTML").otherwise("Shell script")
    rows = rows.select(carrier.alias("carrier"), F.when(F.col("r.label") == "D", "base64").otherwise("sql").alias("class"), "r.size", "r.hits")
    return files.guest_recovery(rows, "carrier", "carrier")


CHARS = r"""
    c AS (SELECT doc_id, lang, source, unnest(string_split(text, '')) AS c, unnest(range(len(string_split(text, ''))))::BIGINT AS pos FROM documents WHERE length(text) > 0),
    t AS (SELECT *, CASE WHEN regexp_full_match(c, '[A-Za-z]') THEN 'L' WHEN regexp_full_match(c, '[0-9]') THEN 'D' WHEN c IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13)) THEN 'W' WHEN ord(c) > 127 THEN 'N' ELSE 'P' END AS truth FROM c),
    x AS (SELECT *, CASE WHEN (pos + doc_id) % 17 = 0 THEN 'P' ELSE truth END AS pred FROM t)"""
RUNS = """
    m AS (SELECT *, CASE WHEN lag({0}) OVER w = {0} THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM m),
    r AS (SELECT doc_id, (g - 1)::INTEGER AS run, min(pos)::INTEGER AS start, (max(pos) + 1)::INTEGER AS "end", any_value({0}) AS label FROM g GROUP BY doc_id, g)"""
PER_CLASS = """
    s AS (SELECT {0} label, sum(n) AS support, sum(hit) AS hit, sum(guessed) AS guessed FROM (
      SELECT {0} truth AS label, n, CASE WHEN truth = pred THEN n ELSE 0 END AS hit, 0 AS guessed FROM f UNION ALL SELECT {0} pred, 0, 0, n FROM f) GROUP BY ALL),
    q AS (SELECT *, CASE WHEN guessed > 0 THEN hit / guessed ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS rc FROM s),
    k AS (SELECT *, CASE WHEN p + rc > 0 THEN 2 * p * rc / (p + rc) ELSE 0 END AS f1 FROM q)"""
TURNS = r"""
    c AS (SELECT conv_id * 1000 + turn AS id, unnest(string_split(text, '')) AS c, unnest(range(length(text)))::BIGINT AS pos, length(text) AS n FROM conversations WHERE length(text) > 0),
    t AS (SELECT *, CASE WHEN regexp_full_match(c, '[A-Za-z]') THEN 'L' WHEN regexp_full_match(c, '[0-9]') THEN 'D' WHEN c IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13)) THEN 'W' WHEN ord(c) > 127 THEN 'N' ELSE 'P' END AS truth FROM c)"""

QUERIES = {
    f.__name__: f
    for f in (
        label_runs, dense_round_trip, label_boundaries, label_confusion, class_metrics, overall_metrics, top_confusions, accuracy_by_group, boundary_confusion, region_coverage,
        space_filled, confidence_gated, smoothed, segment_algebra, byte_offsets, overlap_votes, review_spans, review_picks, threshold_sweep,
        boundary_scores, near_boundaries, guest_recovery,
    )
}

ORACLE_SQL = {
    "label_runs": f'WITH {CHARS}, {RUNS.format("truth")} SELECT doc_id, run, start, "end", label FROM r',
    "dense_round_trip": """
        SELECT doc_id, md5(CASE WHEN n = 0 THEN '' ELSE left(repeat('A', a) || repeat('B', b - a) || repeat('-', d - b) || repeat('D', n - d), n) END) AS digest
        FROM (SELECT doc_id, n, (n * 2 / 10)::DOUBLE, trunc(n * 2 / 10.0)::BIGINT AS a, trunc(n * 6 / 10.0)::BIGINT AS b, trunc(n * 8 / 10.0)::BIGINT AS d FROM (SELECT doc_id, coalesce(length(text), 0) AS n FROM documents))""",
    "label_boundaries": f"""
        WITH {CHARS}, {RUNS.format("truth")}
        SELECT d.doc_id, coalesce(max(run), 0)::BIGINT AS n_boundaries, coalesce(sum(start), 0)::BIGINT AS sum_places FROM documents d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id""",
    "label_confusion": f"WITH {CHARS} SELECT truth, pred, count(*) AS n FROM x GROUP BY ALL",
    "class_metrics": f"""
        WITH {CHARS}, f AS (SELECT truth, pred, count(*) AS n FROM x WHERE truth != 'W' GROUP BY ALL), {PER_CLASS.format("")}
        SELECT label, support::BIGINT AS support, round(p, 9)::DOUBLE AS precision, round(rc, 9)::DOUBLE AS recall, round(f1, 9)::DOUBLE AS f1 FROM k""",
    "overall_metrics": f"""
        WITH {CHARS}, f AS (SELECT lang, truth, pred, count(*) AS n FROM x WHERE truth != 'W' GROUP BY ALL), {PER_CLASS.format("lang,")}
        SELECT lang, round(sum(hit) / sum(support), 9)::DOUBLE AS accuracy, round(avg(p) FILTER (support > 0), 9)::DOUBLE AS macro_precision, round(avg(rc) FILTER (support > 0), 9)::DOUBLE AS macro_recall,
          round(avg(f1) FILTER (support > 0), 9)::DOUBLE AS macro_f1, round(sum(f1 * support) / sum(support), 9)::DOUBLE AS weighted_f1 FROM k GROUP BY lang""",
    "top_confusions": f"""
        WITH {CHARS}, f AS (SELECT truth, pred, count(*) AS n FROM x WHERE truth != 'W' GROUP BY ALL), s AS (SELECT *, round(n / sum(n) OVER (PARTITION BY truth), 9)::DOUBLE AS share FROM f)
        SELECT truth, pred, n, share, row_number() OVER (PARTITION BY truth ORDER BY n DESC, pred)::INTEGER AS rank FROM s WHERE truth != pred QUALIFY row_number() OVER (PARTITION BY truth ORDER BY n DESC, pred) <= 2""",
    "accuracy_by_group": f"WITH {CHARS} SELECT lang, source, GROUPING(lang, source)::BIGINT AS level, count(*) AS n, sum((truth = pred)::INTEGER)::BIGINT AS hits FROM x GROUP BY GROUPING SETS ((), (lang), (lang, source))",
    "boundary_confusion": f"""
        WITH {CHARS}, m AS (SELECT *, CASE WHEN lag(truth) OVER w != truth THEN 1 ELSE 0 END AS new FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        n AS (SELECT *, max(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {RADIUS - 1} PRECEDING AND {RADIUS} FOLLOWING) AS near FROM m)
        SELECT truth, pred, count(*) AS n FROM n WHERE near = 1 GROUP BY ALL""",
    "region_coverage": f"""
        WITH {CHARS}, l AS (SELECT doc_id, length(text) AS n FROM documents)
        SELECT doc_id, count(*) AS total, sum((truth = pred)::INTEGER)::BIGINT AS "right", sum((truth = pred)::INTEGER) * 2 >= count(*) AS hit
        FROM x JOIN l USING (doc_id) WHERE pos >= n // 3 AND pos < n * 2 // 3 AND truth != 'W' GROUP BY doc_id""",
    "space_filled": f"""
        WITH {CHARS}, v AS (SELECT *, CASE WHEN truth = 'W' THEN NULL ELSE pred END AS v FROM x),
        y AS (SELECT doc_id, pos, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), first_value(v IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), pred) AS f FROM v),
        z AS (SELECT doc_id, string_agg(f, '' ORDER BY pos) AS filled FROM y GROUP BY doc_id)
        SELECT d.doc_id, md5(coalesce(filled, '')) AS digest FROM documents d LEFT JOIN z USING (doc_id)""",
    "confidence_gated": f"WITH {CHARS} SELECT pred AS truth, CASE WHEN ((pos * 13 + doc_id) % 20) / 20.0 < 0.35 THEN 'O' ELSE pred END AS pred, count(*) AS n FROM x GROUP BY ALL",
    "smoothed": f"""
        WITH {CHARS}, {RUNS.format("pred")},
        b AS (SELECT *, "end" - start AS len, lag(label) OVER w AS ll, lag("end" - start) OVER w AS lz, lead(label) OVER w AS rl, lead("end" - start) OVER w AS rz, count(*) OVER (PARTITION BY doc_id) AS k FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY run)),
        s AS (SELECT doc_id, string_agg(repeat(CASE WHEN k <= 2 OR len >= 3 THEN label WHEN coalesce(lz, 0) >= coalesce(rz, 0) THEN coalesce(ll, label) ELSE coalesce(rl, label) END, len), '' ORDER BY run) AS smooth FROM b GROUP BY doc_id)
        SELECT d.doc_id, md5(coalesce(smooth, '')) AS digest FROM documents d LEFT JOIN s USING (doc_id)""",
    "segment_algebra": """
        SELECT doc_id, '0:2:a,2:' || (t + 2) || ':b,' || (t + 2) || ':' || (t + 3) || ':a' AS clipped,
          '0:' || t || ':a,' || t || ':' || (t + 1) || ':b,' || (t + 1) || ':' || (t + 6) || ':g,' || (t + 6) || ':' || (2 * t + 5) || ':b,' || (2 * t + 5) || ':' || (n + 5) || ':a' AS inserted,
          '0:' || (n - t) || ':a' AS deleted, '0:' || (t - 1) || ':a,' || (t - 1) || ':' || (2 * t - 2) || ':b,' || (2 * t - 2) || ':' || (n - 2) || ':a' AS cut,
          'a' AS context, round((n - t) / n, 9)::DOUBLE AS share, 'gap,unknown label' AS errors
        FROM (SELECT *, n // 3 AS t FROM (SELECT doc_id, greatest(coalesce(length(text), 0), 9) AS n FROM documents))""",
    "byte_offsets": """
        WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS line FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, line, coalesce(sum(length(l) + 1) OVER w, 0)::INTEGER AS char_start, coalesce(sum(octet_length(encode(l)) + 1) OVER w, 0)::INTEGER AS byte_start
        FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "overlap_votes": f"""
        WITH {TURNS}, w AS (SELECT id, pos, n, truth, unnest(range(CASE WHEN n <= 64 THEN 1 ELSE 1 + ceil((n - 64) / 32.0)::BIGINT END)) AS k FROM t),
        v AS (SELECT *, pos - k * 32 AS off, least(64, n - k * 32) AS len FROM w WHERE pos >= k * 32 AND pos < k * 32 + 64),
        s AS (SELECT id, pos, CASE WHEN (off + k) % 11 = 0 THEN 'P' ELSE truth END AS label, round(sum({windows.stand_in_weight_sql("off", "len")}), 9) AS w FROM v GROUP BY ALL),
        o AS (SELECT label FROM s QUALIFY row_number() OVER (PARTITION BY id, pos ORDER BY w DESC, label) = 1)
        SELECT label, count(*) AS n FROM o GROUP BY label""",
    "review_spans": f"""
        WITH {TURNS}, e AS (SELECT *, {_doubt("q")} AS e, CASE WHEN lag(truth) OVER (PARTITION BY id ORDER BY pos) != truth THEN 1 ELSE 0 END AS f, lag(truth) OVER (PARTITION BY id ORDER BY pos) AS l FROM (SELECT *, 0.3::DOUBLE + ((pos * 7 + id) % 50)::DOUBLE / 100 AS q FROM t)),
        s AS (SELECT *, avg(e) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS m, sum(f) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN 11 PRECEDING AND 12 FOLLOWING) AS k FROM e),
        b AS (SELECT *, k / greatest(least(pos + 13, n) - greatest(pos - 12, 0) - 1, 1) AS fr FROM s WHERE f = 1)
        SELECT id, pos::INTEGER AS boundary, greatest(pos - 250, 0)::INTEGER AS start, least(pos + 250, n)::INTEGER AS "end", round(m + 0.6 * fr, 6)::DOUBLE AS score, round(fr, 6)::DOUBLE AS flip_rate, l AS left_label, truth AS right_label
        FROM b WHERE round(m + 0.6 * fr, 6) >= 0.2""",
    "boundary_scores": f"""
        WITH {CHARS}, b AS (SELECT CASE WHEN lag(truth) OVER w != truth THEN 1 ELSE 0 END AS t, CASE WHEN lag(pred) OVER w != pred THEN 1 ELSE 0 END AS p FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        s AS (SELECT sum(t)::BIGINT AS n_true, sum(p)::BIGINT AS n_pred, sum(t * p)::BIGINT AS n_both FROM b)
        SELECT n_true, n_pred, n_both, round(n_both / n_pred, 9) AS precision, round(n_both / n_true, 9) AS recall, round(2 * n_both / (n_true + n_pred), 9) AS f1 FROM s""",
    "guest_recovery": f"""
        WITH {CHARS}, {RUNS.format("truth")},
        h AS (SELECT r.doc_id, r.run, any_value(r.label) AS label, any_value(x.source) AS source, count(*) AS size, sum((x.pred = r.label)::INTEGER) AS hits FROM r JOIN x ON x.doc_id = r.doc_id AND x.pos >= r.start AND x.pos < r."end" WHERE r.label IN ('D', 'N') GROUP BY r.doc_id, r.run),
        cr AS (SELECT CASE WHEN ends_with(source, '1') THEN 'PHP' WHEN ends_with(source, '2') THEN 'HTML' ELSE 'Shell script' END AS carrier, label = 'D' AS code, hits * 2 >= size AS found FROM h),
        gu AS (SELECT *, code OR carrier != 'PHP' AS guest FROM cr)
        SELECT carrier, count(*) FILTER (guest) AS guests, count(*) FILTER (guest AND found) AS recovered, count(*) FILTER (guest AND code) AS encodings, count(*) FILTER (guest AND code AND found) AS encodings_recovered FROM gu GROUP BY carrier""",
    "threshold_sweep": """
        WITH d AS (SELECT n_chars % 1000 AS score, toxic = 1 AS yes FROM documents JOIN labels USING (doc_id)), t AS (SELECT unnest(range(10)) * 100.0::DOUBLE AS tau),
        s AS (SELECT tau, count(*) FILTER (score >= tau AND yes) AS tp, count(*) FILTER (score >= tau AND NOT yes) AS fp, count(*) FILTER (score < tau AND yes) AS fn, count(*) FILTER (score < tau AND NOT yes) AS tn FROM d, t GROUP BY tau),
        q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END AS sp FROM s)
        SELECT tau, tp, fp, fn, tn, round(p, 9)::DOUBLE AS precision, round(r, 9)::DOUBLE AS recall, round(sp, 9)::DOUBLE AS specificity,
          round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9)::DOUBLE AS f1, round((r + sp) / 2, 9)::DOUBLE AS balanced FROM q""",
}
