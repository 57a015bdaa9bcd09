"""Queries of the evaluation report: confusions, regions, neighbourhoods, payloads, open set, byte labels.

They use the stand-in labelling of ``label_queries``: truth is the lexical class of each
character, the prediction differs at every 17th place. Runs of two digits or more stand for
needles and payloads in hosts of letters; a text's source stands for a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import dense, evaluation, metrics
from spanloom.plans.label_queries import CHARS, PER_CLASS, RADIUS, RUNS, _rounded, labelled
from spanloom.session import stored, table

#: Places of each part of a sequence, and of a window to either side of a label in focus.
ANCHOR, FOCUS = 50, 250
#: Stand-in probabilities: that of a place not being its host's, and that of its own label.
SOFT = 0.05
GRID = [0.3, 0.4, 0.5, 0.6, 0.7]
ROUTES = {"code": [1, 4], "prose": [0, 3], "space": [2]}


def text_like_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.text_like(evaluation.counted(labelled(spark, sf_dir), "truth", "pred", valid=True), ("L", "N"))


def merged_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusions of documents and of turns, summed over the union of their labels."""
    turns = table(spark, sf_dir, "conversations").select(F.coalesce("text", F.lit("")).alias("text"), F.col("turn")).withColumn("truth", dense.lexical_labels(F.col("text")))
    turns = turns.withColumn("pred", dense.perturbed(F.col("truth"), F.col("turn")))
    return evaluation.merged(evaluation.counted(labelled(spark, sf_dir), "truth", "pred"), evaluation.counted(turns, "truth", "pred"))


def pure_mistakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.mistakes(evaluation.counted(labelled(spark, sf_dir), "truth", "pred", valid=True), "N"))


def host_purity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.host_purity(evaluation.counted(labelled(spark, sf_dir, "lang"), "truth", "pred", "doc_id", "lang", valid=True), "doc_id", "lang")


def _region(start: Column, end: Column, label: str | None, host: str | None) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(label).cast("string").alias("label"), F.lit(host).cast("string").alias("host"))


def _needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each run of two digits or more, in a host of letters."""
    docs = dense.with_runs(labelled(spark, sf_dir, "lang", "source"), "truth", "runs")
    runs = F.filter("runs", lambda r: (r["label"] == "D") & (r["end"] - r["start"] >= 2))
    docs = docs.withColumn("regions", F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.lit("D").alias("label"), F.lit("L").alias("host"))))
    return evaluation.region_counts(docs, "truth", "pred", "regions", "L", "doc_id", "lang", "source")


def middle_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle third of each document: exact, non-host and text coverage."""
    n = F.length("text")
    docs = labelled(spark, sf_dir).withColumn("regions", F.array(_region(F.floor(n / 3), F.floor(n * 2 / 3), None, "L")))
    rows = evaluation.region_counts(docs, "truth", "pred", "regions", "L", "doc_id").filter("total > 0")
    return rows.select("doc_id", "total", "exact", "other", "text", (F.col("total") - F.col("text")).alias("non_text"), evaluation.found("exact").alias("exact_hit"), evaluation.found("other").alias("any_hit"))


def needle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needles found, overall and by the host's language."""
    rows = _needles(spark, sf_dir).withColumn("hit", evaluation.found("exact").cast("long")).withColumn("any_hit", evaluation.found("other").cast("long"))
    out = rows.groupingSets([[], ["lang"]], "lang").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.sum("hit").alias("detected"), F.sum("any_hit").alias("any_detected"), F.sum("exact").alias("places"), F.sum("total").alias("all_places"))
    return _rounded(out.select("lang", "level", "n", "detected", "any_detected", (F.col("places") / F.col("all_places")).alias("coverage")))


def needle_mistakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What places of digits are taken for, by language."""
    return evaluation.counted(labelled(spark, sf_dir, "lang"), "truth", "pred", "lang", valid=True).filter("truth = 'D' AND pred != 'D'").select("lang", "pred", "n")


def sequence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of a sequence's first, second and third part, cut at the anchors even where a part is shorter."""
    docs = labelled(spark, sf_dir).withColumn("regions", F.array(_region(F.lit(0), F.lit(ANCHOR), None, None), _region(F.lit(ANCHOR), F.lit(2 * ANCHOR), None, None), _region(F.lit(2 * ANCHOR), F.length("text"), None, None)))
    rows = evaluation.region_counts(docs, "truth", "pred", "regions", "L", "doc_id").filter("total > 0")
    return _rounded(rows.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum(evaluation.found("exact").cast("long")).alias("hits"), (F.sum("exact") / F.sum("total")).alias("coverage")))


def realistic_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confusion around changes between consecutive characters that aren't white space."""
    return evaluation.counted(labelled(spark, sf_dir), "truth", "pred", valid=True, near=RADIUS, over_valid=True)


def block_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks (runs of digits) by role, by language, and all: coverage, overlap, and those taken for another label."""
    rows = _needles(spark, sf_dir).withColumn("role", F.when(F.col("end") - F.col("start") >= 4, "wrapped").otherwise("plain"))
    rows = rows.withColumn("wrong", (2 * (F.col("total") - F.col("exact")) > F.col("total")).cast("long")).withColumn("hit", evaluation.found("exact").cast("long"))
    out = rows.groupingSets([[], ["role"], ["lang"]], "role", "lang").agg(F.grouping_id().cast("long").alias("level"), F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"), F.sum("wrong").alias("fooled"), F.sum("exact").alias("exact"), F.sum("total").alias("total"))
    return _rounded(out.select("role", "lang", "level", "n", "hits", "fooled", (F.col("exact") / F.col("total")).alias("coverage")))


def payload_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads by task: overlap with what isn't predicted as the host, and soft detection by a low probability over half of it."""
    place = lambda k: F.pmod(k * 13 + F.col("doc_id"), F.lit(20)) / 20.0
    soft = F.aggregate(F.sequence(F.col("start"), F.col("end") - 1), F.lit(0).cast("long"), lambda a, k: a + (place(k) >= SOFT).cast("long"))
    rows = _needles(spark, sf_dir).withColumn("soft", soft)
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum((F.round(evaluation.iou(), 9) >= 0.5).cast("long")).alias("by_overlap"), F.sum(evaluation.found("soft").cast("long")).alias("by_soft"), F.round(F.sum(F.round(evaluation.iou(), 9)) / F.count(F.lit(1)), 6).alias("mean_overlap"))


def excluded_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label that is left out (wide characters), counted by language and label, and those that stay."""
    docs = labelled(spark, sf_dir, "lang").withColumn("out", F.filter(F.array(F.lit("N"), F.lit("D")), lambda c: F.contains(F.col("truth"), c)))
    rows = docs.select("lang", F.explode(F.when(F.size("out") > 0, F.col("out")).otherwise(F.array(F.lit("")))).alias("label"))
    return rows.groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n"))


def _gated(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Predictions of which those under .35 become other."""
    docs = labelled(spark, sf_dir, *keep).withColumn("best", F.transform(dense.codes(F.col("pred")), lambda c, i: F.pmod(i * 13 + F.col("doc_id"), F.lit(20)) / 20.0))
    return dense.gate(docs, "pred", "best", 0.35, "gated").withColumn("truth", F.translate("truth", "N", "O"))


def open_set_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often wide characters, taken as other, and others are told apart, by task."""
    return _rounded(evaluation.open_set(evaluation.counted(_gated(spark, sf_dir, "source"), "truth", "gated", "source", valid=True), "O", "source"))


def monitor_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy and macro F1 of gated predictions by task, over all valid places and near boundaries."""
    docs = _gated(spark, sf_dir, "source")
    parts = []
    for scope, near in (("all", 0), ("near", RADIUS)):
        matrix = evaluation.counted(docs, "truth", "gated", "source", valid=True, near=near)
        parts.append(metrics.overall(metrics.per_class(matrix, "source"), "source").withColumn("scope", F.lit(scope)))
    return _rounded(parts[0].unionByName(parts[1]).select("source", "scope", "accuracy", "macro_f1", "weighted_f1"))


def task_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each task: documents, valid places, scores, boundary accuracy, found thirds and needles."""
    docs = stored(labelled(spark, sf_dir, "source", "lang"), "labelled")
    whole = evaluation.counted(docs, "truth", "pred", "source", valid=True)
    scores = metrics.overall(metrics.per_class(whole, "source"), "source").select("source", "accuracy", "macro_f1", "weighted_f1")
    near = evaluation.counted(docs, "truth", "pred", "source", valid=True, near=RADIUS, over_valid=True).groupBy("source").agg((F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("boundary_accuracy"))
    n = F.length("text")
    thirds = docs.withColumn("regions", F.array(_region(F.floor(n / 3), F.floor(n * 2 / 3), None, "L")))
    found = evaluation.region_counts(thirds, "truth", "pred", "regions", "L", "source").filter("total > 0").groupBy("source").agg(F.count(F.lit(1)).alias("n_regions"), F.sum(evaluation.found("exact").cast("long")).alias("n_found"))
    size = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    out = size
    for part in (scores, near, found):
        part = part.withColumnRenamed("source", "__s")
        out = out.join(part, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    return _rounded(out)


def length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.length_summary(table(spark, sf_dir, "documents"), F.coalesce(F.length("text"), F.lit(0)), "source", "lang")


def length_extrapolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy on benchmark items repeated once, twice and four times."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.explode(F.array(*map(F.lit, (1, 2, 4)))).alias("times"))
    items = items.withColumn("truth", dense.lexical_labels(F.expr("repeat(text, times)"))).withColumn("pred", dense.perturbed(F.col("truth"), F.col("doc_id")))
    matrix = evaluation.counted(items, "truth", "pred", "times", valid=True)
    return _rounded(matrix.groupBy("times").agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy")))


def focus_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, and precision, recall and F1 of digits, in the window around each document's first one."""
    docs = labelled(spark, sf_dir).withColumn("at", F.instr("truth", "D")).filter("at > 0").withColumn("first", F.greatest(F.col("at") - FOCUS, F.lit(1)))
    part = lambda c: F.substring(F.col(c), F.col("first"), F.col("at") + FOCUS - F.col("first"))
    rows = evaluation.counted(docs.select("doc_id", part("truth").alias("truth"), part("pred").alias("pred")), "truth", "pred", "doc_id")
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    t, p = F.col("truth") == "D", F.col("pred") == "D"
    sums = rows.groupBy("doc_id").agg(F.sum("n").alias("n"), n(F.col("truth") != F.col("pred")).alias("differ"), n(t & p).alias("tp"), n(~t & p).alias("fp"), n(t & ~p).alias("fn"))
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    return _rounded(sums.select("doc_id", "n", "tp", "fp", "fn", (F.col("differ") / F.col("n")).alias("diff_ratio"), f1.alias("f1")))


def _turn_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").filter("length(text) > 0").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return turns.withColumn("truth", dense.lexical_labels(F.col("text")))


def masked_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean cross-entropy and accuracy of turns over places that aren't white space, and with places after a change weighted twice."""
    turns = _turn_labels(spark, sf_dir).withColumn("codes", dense.codes(F.col("truth")))
    p = lambda i: F.lit(0.3) + F.pmod(i * 7 + F.col("id"), F.lit(50)) / 100.0
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("loss"), F.lit(0).cast("long").alias("right"), F.lit(0).cast("long").alias("weight"), F.lit(0.0).alias("weighted"))

    def add(a: Column, i: Column) -> Column:
        use = F.get("codes", i) != "W"
        w = F.when((i > 0) & (F.get("codes", i) != F.get("codes", i - 1)), 2).otherwise(1)
        loss = -F.log(p(i))
        new = F.struct((a["n"] + 1).alias("n"), (a["loss"] + loss).alias("loss"), (a["right"] + (p(i) >= 0.5).cast("long")).alias("right"), (a["weight"] + w).alias("weight"), (a["weighted"] + w * loss).alias("weighted"))
        return F.when(use, new).otherwise(a)

    sums = turns.select(F.aggregate(F.sequence(F.lit(0), F.size("codes") - 1), zero, add).alias("s")).select("s.*")
    out = sums.agg(F.sum("n").alias("n"), (F.sum("loss") / F.sum("n")).alias("cross_entropy"), (F.sum("right") / F.sum("n")).alias("accuracy"), (F.sum("weighted") / F.sum("weight")).alias("boundary_weighted"))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("cross_entropy", "accuracy", "boundary_weighted")])


def _byte_labels(text: Column, key: Column) -> Column:
    """A stand-in label for each byte: its place by document, of three."""
    places = F.sequence(F.lit(1), F.octet_length(text))
    return F.when(F.octet_length(text) > 0, F.array_join(F.transform(places, lambda i: F.get(F.array(*map(F.lit, "ABC")), F.pmod(i * 7 + key, F.lit(3)).cast("int"))), "")).otherwise("")


def char_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of characters from those of their bytes, as a digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("bytes", _byte_labels(F.col("text"), F.col("doc_id")))
    return docs.select("doc_id", F.md5(evaluation.char_labels("text", "bytes")).alias("digest"))


def char_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean probabilities of turns' characters over their bytes: their number, sum and greatest."""
    turns = _turn_labels(spark, sf_dir).withColumn("p", F.transform(F.sequence(F.lit(1), F.octet_length("text")), lambda i: F.pmod(i * 7 + F.col("id"), F.lit(50)) / 50.0))
    means = turns.select("id", evaluation.char_means("text", "p").alias("m"))
    return means.select("id", F.size("m").alias("n"), F.round(F.aggregate("m", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.array_max("m"), 9).alias("most"))


def route_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of five classes (by the document's counts of them, one added) as shares of three routes."""
    docs = labelled(spark, sf_dir)
    count = lambda c: F.length("truth") - F.length(F.replace("truth", F.lit(c), F.lit("")))
    probs = F.array(*[(count(c) + 1) / (F.length("truth") + 5) for c in "LDWNP"])
    out = docs.withColumn("probs", probs).withColumn("r", evaluation.routed(F.col("probs"), ROUTES))
    return out.select("doc_id", *[F.round(F.col(f"r.{r}"), 9).alias(r) for r in ROUTES])


def scan_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of a first-order linear recurrence over the lengths of a document's lines."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    sizes = F.transform(F.split("text", "\n"), lambda x: F.length(x).cast("double"))
    return docs.select("doc_id", F.round(evaluation.recurrence(sizes, F.lit(0.5)), 6).alias("state"))


def threshold_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold for each label by greedy search over counts that are added up once; the table is as small as labels x grid."""
    docs = labelled(spark, sf_dir)
    reach = F.transform(dense.codes(F.col("pred")), lambda c, i: F.substring(F.lit("abcdef"), sum(((F.lit(0.3) + F.pmod(i * 7 + F.col("doc_id"), F.lit(50)) / 100.0) >= g).cast("int") for g in GRID) + 1, F.lit(1)))
    docs = docs.withColumn("reach", F.array_join(reach, ""))
    rows = evaluation.counted(docs.withColumn("right", F.array_join(F.zip_with(dense.codes(F.col("truth")), dense.codes(F.col("pred")), lambda t, p: F.when(t == p, p).otherwise(F.lower(p))), "")), "right", "reach").collect()
    counts: dict[str, list[list[int]]] = {}
    for r in rows:
        label = r.truth.upper()
        mine = counts.setdefault(label, [[0, 0] for _ in GRID])
        for i in range(ord(r.pred) - ord("a")):
            mine[i][r.truth.islower()] += r.n
    every = sum(r.n for r in rows)
    picked = evaluation.thresholds({k: [tuple(x) for x in v] for k, v in counts.items()} | {"": [(every, 0)]}, GRID)
    return spark.createDataFrame(sorted(picked.items()), "label string, threshold double")


QUERIES = {
    f.__name__: f
    for f in (
        text_like_confusion, merged_confusion, pure_mistakes, host_purity, middle_regions, needle_stats, needle_mistakes, sequence_stats, realistic_confusion, block_stats, payload_detection,
        excluded_truth, open_set_summary, monitor_evaluation, task_evaluation, length_summary, length_extrapolation, focus_windows, masked_losses, char_labels, char_probs, route_probs, scan_states, threshold_policy,
    )
}

_VALID = "v AS (SELECT * FROM x WHERE truth != 'W')"
_NEEDLES = f"""{CHARS}, {RUNS.format("truth")}, d AS (SELECT * FROM r WHERE label = 'D' AND "end" - start >= 2),
    oa AS (SELECT doc_id, count(*) FILTER (pred != 'L') AS other_all FROM x WHERE truth != 'W' GROUP BY doc_id),
    e AS (SELECT d.doc_id, d.run, any_value(x.lang) AS lang, any_value(x.source) AS source, d."end" - d.start AS size, count(*) AS total, count(*) FILTER (x.pred = 'D') AS exact, count(*) FILTER (x.pred != 'L') AS other, count(*) FILTER (((x.pos * 13 + x.doc_id) % 20) / 20.0 >= {SOFT}) AS soft
      FROM d JOIN x ON x.doc_id = d.doc_id AND x.pos >= d.start AND x.pos < d."end" GROUP BY d.doc_id, d.run, d."end", d.start),
    n AS (SELECT e.*, other / (total + other_all - other) AS iou FROM e JOIN oa USING (doc_id))"""
_NEAR = f"""m AS (SELECT *, CASE WHEN lag(truth) OVER w != truth THEN 1 ELSE 0 END AS new FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    nr AS (SELECT *, max(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {RADIUS - 1} PRECEDING AND {RADIUS} FOLLOWING) AS near FROM m)"""
_NEAR_VALID = f"""mv AS (SELECT doc_id, pos, CASE WHEN lag(truth) OVER (PARTITION BY doc_id ORDER BY pos) != truth THEN 1 ELSE 0 END AS new FROM x WHERE truth != 'W'),
    nv AS (SELECT x.*, max(coalesce(mv.new, 0)) OVER (PARTITION BY x.doc_id ORDER BY x.pos ROWS BETWEEN {RADIUS - 1} PRECEDING AND {RADIUS} FOLLOWING) AS near FROM x LEFT JOIN mv ON mv.doc_id = x.doc_id AND mv.pos = x.pos)"""
_GATED = "y AS (SELECT doc_id, lang, source, pos, CASE WHEN truth = 'N' THEN 'O' ELSE truth END AS truth, CASE WHEN ((pos * 13 + doc_id) % 20) / 20.0 < 0.35 THEN 'O' ELSE pred END AS pred, truth AS raw FROM x)"


def _overall(source: str, keys: str) -> str:
    return f"""SELECT {keys} sum(hit) / sum(support) AS accuracy, avg(f1) FILTER (support > 0) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM {source} GROUP BY ALL"""


_CLASSES = """s{0} AS (SELECT source, label, sum(n) AS support, sum(hit) AS hit, sum(guessed) AS guessed FROM (
      SELECT source, truth AS label, n, CASE WHEN truth = pred THEN n ELSE 0 END AS hit, 0 AS guessed FROM f{0} UNION ALL SELECT source, pred, 0, 0, n FROM f{0}) GROUP BY ALL),
    k{0} AS (SELECT *, CASE WHEN hit > 0 THEN 2 * hit / (support + guessed) ELSE 0 END AS f1 FROM s{0})"""

ORACLE_SQL = {
    "text_like_confusion": f"WITH {CHARS}, {_VALID} SELECT CASE WHEN truth IN ('L', 'N') THEN 'text' ELSE 'rest' END AS truth, CASE WHEN pred IN ('L', 'N') THEN 'text' ELSE 'rest' END AS pred, count(*) AS n FROM v GROUP BY ALL",
    "merged_confusion": rf"""
        WITH {CHARS}, tc AS (SELECT turn, unnest(string_split(text, '')) AS c, unnest(range(len(string_split(text, ''))))::BIGINT AS pos FROM conversations WHERE length(text) > 0),
        tt AS (SELECT *, CASE WHEN regexp_full_match(c, '[A-Za-z]') THEN 'L' WHEN regexp_full_match(c, '[0-9]') THEN 'D' WHEN c IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13)) THEN 'W' WHEN ord(c) > 127 THEN 'N' ELSE 'P' END AS truth FROM tc)
        SELECT truth, pred, count(*) AS n FROM (SELECT truth, pred FROM x UNION ALL SELECT truth, CASE WHEN (pos + turn) % 17 = 0 THEN 'P' ELSE truth END FROM tt) GROUP BY ALL""",
    "pure_mistakes": f"""
        WITH {CHARS}, {_VALID}, f AS (SELECT truth, pred, count(*) AS n FROM v WHERE truth != 'N' AND pred != 'N' GROUP BY ALL), s AS (SELECT truth, sum(n)::BIGINT AS total, sum(n) FILTER (truth = pred) AS hits FROM f GROUP BY truth)
        SELECT s.truth, total, round(coalesce(hits, 0) / total, 9)::DOUBLE AS accuracy, f.pred, round(n / total, 9)::DOUBLE AS share FROM s LEFT JOIN f ON f.truth = s.truth AND f.truth != f.pred""",
    "host_purity": f"""
        WITH {CHARS}, {_VALID}, d AS (SELECT doc_id, lang, count(*) AS n, count(*) FILTER (truth != pred) AS wrong FROM v GROUP BY ALL)
        SELECT lang, count(*) AS n_docs, count(*) FILTER (wrong = 0) AS perfect, count(*) FILTER (2 * wrong <= n) AS half_wrong FROM d GROUP BY lang""",
    "middle_regions": f"""
        WITH {CHARS}, {_VALID}, l AS (SELECT doc_id, length(text) AS n FROM documents),
        s AS (SELECT doc_id, count(*) AS total, count(*) FILTER (truth = pred) AS exact, count(*) FILTER (pred != 'L') AS other, count(*) FILTER (pred = 'L') AS text FROM v JOIN l USING (doc_id) WHERE pos >= n // 3 AND pos < n * 2 // 3 GROUP BY doc_id)
        SELECT doc_id, total, exact, other, text, total - text AS non_text, 2 * exact >= total AS exact_hit, 2 * other >= total AS any_hit FROM s""",
    "needle_stats": f"""
        WITH {_NEEDLES} SELECT lang, GROUPING(lang)::BIGINT AS level, count(*) AS n, count(*) FILTER (2 * exact >= total) AS detected, count(*) FILTER (2 * other >= total) AS any_detected, round(sum(exact) / sum(total), 9)::DOUBLE AS coverage
        FROM n GROUP BY GROUPING SETS ((), (lang))""",
    "needle_mistakes": f"WITH {CHARS} SELECT lang, pred, count(*) AS n FROM x WHERE truth = 'D' AND pred != 'D' GROUP BY ALL",
    "sequence_stats": f"""
        WITH {CHARS}, {_VALID}, s AS (SELECT doc_id, least(pos // {ANCHOR}, 2)::INTEGER AS region, count(*) AS total, count(*) FILTER (truth = pred) AS exact FROM v GROUP BY ALL)
        SELECT region, count(*) AS n, count(*) FILTER (2 * exact >= total) AS hits, round(sum(exact) / sum(total), 9)::DOUBLE AS coverage FROM s GROUP BY region""",
    "realistic_confusion": f"WITH {CHARS}, {_NEAR_VALID} SELECT truth, pred, count(*) AS n FROM nv WHERE near = 1 AND truth != 'W' GROUP BY ALL",
    "block_stats": f"""
        WITH {_NEEDLES}, b AS (SELECT *, CASE WHEN size >= 4 THEN 'wrapped' ELSE 'plain' END AS role FROM n)
        SELECT role, lang, GROUPING(role, lang)::BIGINT AS level, count(*) AS n, count(*) FILTER (2 * exact >= total) AS hits, count(*) FILTER (2 * (total - exact) > total) AS fooled, round(sum(exact) / sum(total), 9)::DOUBLE AS coverage FROM b GROUP BY GROUPING SETS ((), (role), (lang))""",
    "payload_detection": f"""
        WITH {_NEEDLES} SELECT source, count(*) AS n, count(*) FILTER (round(iou, 9) >= 0.5) AS by_overlap, count(*) FILTER (2 * soft >= total) AS by_soft, round(sum(round(iou, 9)) / count(*), 6)::DOUBLE AS mean_overlap FROM n GROUP BY source""",
    "excluded_truth": r"""
        WITH d AS (SELECT lang, regexp_matches(coalesce(text, ''), '[^\x00-\x7F]') AS wide, regexp_matches(coalesce(text, ''), '[0-9]') AS digit FROM documents),
        l AS (SELECT lang, 'N' AS label FROM d WHERE wide UNION ALL SELECT lang, 'D' FROM d WHERE digit UNION ALL SELECT lang, '' FROM d WHERE NOT wide AND NOT digit)
        SELECT lang, label, count(*) AS n FROM l GROUP BY ALL""",
    "open_set_summary": f"""
        WITH {CHARS}, {_GATED}, s AS (SELECT source, count(*) FILTER (truth = 'O' AND pred = 'O') AS tp, count(*) FILTER (truth != 'O' AND pred = 'O') AS fp, count(*) FILTER (truth = 'O' AND pred != 'O') AS fn, count(*) FILTER (truth != 'O' AND pred != 'O') AS tn FROM y WHERE raw != 'W' GROUP BY source)
        SELECT source, tp, fp, fn, tn, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) ELSE 0 END, 9)::DOUBLE AS too_often, round(CASE WHEN fn + tp > 0 THEN fn / (fn + tp) ELSE 0 END, 9)::DOUBLE AS too_little FROM s""",
    "monitor_evaluation": f"""
        WITH {CHARS}, {_GATED}, m AS (SELECT *, CASE WHEN lag(truth) OVER (PARTITION BY doc_id ORDER BY pos) != truth THEN 1 ELSE 0 END AS new FROM y),
        nr AS (SELECT *, max(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {RADIUS - 1} PRECEDING AND {RADIUS} FOLLOWING) AS near FROM m),
        f1_ AS (SELECT source, truth, pred, count(*) AS n FROM nr WHERE raw != 'W' GROUP BY ALL), f2_ AS (SELECT source, truth, pred, count(*) AS n FROM nr WHERE raw != 'W' AND near = 1 GROUP BY ALL), {_CLASSES.format("1_")}, {_CLASSES.format("2_")}
        SELECT source, scope, round(accuracy, 9)::DOUBLE AS accuracy, round(macro_f1, 9)::DOUBLE AS macro_f1, round(weighted_f1, 9)::DOUBLE AS weighted_f1
        FROM (SELECT *, 'all' AS scope FROM ({_overall("k1_", "source,")}) UNION ALL SELECT *, 'near' FROM ({_overall("k2_", "source,")}))""",
    "task_evaluation": f"""
        WITH {CHARS}, {_NEAR_VALID}, {_VALID}, f1_ AS (SELECT source, truth, pred, count(*) AS n FROM v GROUP BY ALL), {_CLASSES.format("1_")}, o AS ({_overall("k1_", "source,")}),
        b AS (SELECT source, count(*) FILTER (truth = pred) / count(*) AS boundary_accuracy FROM nv WHERE near = 1 AND truth != 'W' GROUP BY source),
        l AS (SELECT doc_id, length(text) AS n FROM documents), th AS (SELECT source, doc_id, count(*) AS total, count(*) FILTER (truth = pred) AS exact FROM v JOIN l USING (doc_id) WHERE pos >= n // 3 AND pos < n * 2 // 3 GROUP BY ALL),
        g AS (SELECT source, count(*) AS n_regions, count(*) FILTER (2 * exact >= total) AS n_found FROM th GROUP BY source), d AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source)
        SELECT d.source, n_docs, round(accuracy, 9)::DOUBLE AS accuracy, round(macro_f1, 9)::DOUBLE AS macro_f1, round(weighted_f1, 9)::DOUBLE AS weighted_f1, round(boundary_accuracy, 9)::DOUBLE AS boundary_accuracy, n_regions, n_found
        FROM d LEFT JOIN o ON d.source IS NOT DISTINCT FROM o.source LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN g ON d.source IS NOT DISTINCT FROM g.source""",
    "length_summary": """
        WITH d AS (SELECT lang, source, coalesce(length(text), 0)::BIGINT AS len FROM documents), s AS (SELECT lang, list_sort(list(len)) AS l, count(*) AS n, count(DISTINCT source) AS n_hosts FROM d GROUP BY lang)
        SELECT lang, n, l[n // 2 + 1] AS median, l[greatest(floor(n * 0.95)::BIGINT - 1, 0) + 1] AS p95, l[-1] AS longest, n_hosts FROM s""",
    "length_extrapolation": r"""
        WITH i AS (SELECT item_id AS doc_id, times, repeat(text, times::INTEGER) AS text FROM benchmark, (SELECT unnest([1, 2, 4])::INTEGER AS times) WHERE length(text) > 0),
        c AS (SELECT doc_id, times, unnest(string_split(text, '')) AS c, unnest(range(len(string_split(text, ''))))::BIGINT AS pos FROM i),
        t AS (SELECT *, CASE WHEN regexp_full_match(c, '[A-Za-z]') THEN 'L' WHEN regexp_full_match(c, '[0-9]') THEN 'D' WHEN c IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13)) THEN 'W' WHEN ord(c) > 127 THEN 'N' ELSE 'P' END AS truth FROM c)
        SELECT times, count(*) AS n, round(count(*) FILTER (truth = CASE WHEN (pos + doc_id) % 17 = 0 THEN 'P' ELSE truth END) / count(*), 9)::DOUBLE AS accuracy FROM t WHERE truth != 'W' GROUP BY times""",
    "focus_windows": f"""
        WITH {CHARS}, a AS (SELECT doc_id, min(pos) AS here FROM x WHERE truth = 'D' GROUP BY doc_id),
        s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (truth = 'D' AND pred = 'D') AS tp, count(*) FILTER (truth != 'D' AND pred = 'D') AS fp, count(*) FILTER (truth = 'D' AND pred != 'D') AS fn, count(*) FILTER (truth != pred) AS differ
          FROM x JOIN a USING (doc_id) WHERE pos >= greatest(here + 1 - {FOCUS}, 1) - 1 AND pos < here + {FOCUS} GROUP BY doc_id)
        SELECT doc_id, n, tp, fp, fn, round(differ / n, 9)::DOUBLE AS diff_ratio, round(CASE WHEN tp > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 9)::DOUBLE AS f1 FROM s""",
    "masked_losses": r"""
        WITH c AS (SELECT conv_id * 1000 + turn AS id, unnest(string_split(text, '')) AS c, unnest(range(length(text)))::BIGINT AS pos FROM conversations WHERE length(text) > 0),
        t AS (SELECT *, CASE WHEN regexp_full_match(c, '[A-Za-z]') THEN 'L' WHEN regexp_full_match(c, '[0-9]') THEN 'D' WHEN c IN (' ', chr(9), chr(10), chr(11), chr(12), chr(13)) THEN 'W' WHEN ord(c) > 127 THEN 'N' ELSE 'P' END AS truth, 0.3::DOUBLE + ((pos * 7 + id) % 50)::DOUBLE / 100 AS p FROM c),
        w AS (SELECT *, CASE WHEN lag(truth) OVER (PARTITION BY id ORDER BY pos) != truth THEN 2 ELSE 1 END AS w FROM t)
        SELECT count(*) AS n, round(sum(-ln(p)) / count(*), 6)::DOUBLE AS cross_entropy, round(count(*) FILTER (p >= 0.5) / count(*), 6)::DOUBLE AS accuracy, round(sum(-w * ln(p)) / sum(w), 6)::DOUBLE AS boundary_weighted FROM w WHERE truth != 'W'""",
    "char_labels": """
        WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c, unnest(range(len(string_split(text, ''))))::BIGINT AS pos FROM documents WHERE length(text) > 0),
        b AS (SELECT doc_id, pos, octet_length(encode(c)) AS k, coalesce(sum(octet_length(encode(c))) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM c),
        l AS (SELECT doc_id, pos, substr('ABC', ((j * 7 + doc_id) % 3 + 1)::BIGINT, 1) AS label FROM (SELECT doc_id, pos, unnest(range(before + 1, before + k + 1)) AS j FROM b)),
        v AS (SELECT doc_id, pos, label FROM (SELECT doc_id, pos, label, count(*) AS n FROM l GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY n DESC, label) = 1),
        s AS (SELECT doc_id, string_agg(label, '' ORDER BY pos) AS labels FROM v GROUP BY doc_id)
        SELECT d.doc_id, md5(coalesce(labels, '')) AS digest FROM documents d LEFT JOIN s USING (doc_id)""",
    "char_probs": """
        WITH c AS (SELECT conv_id * 1000 + turn AS id, unnest(string_split(text, '')) AS c, unnest(range(length(text)))::BIGINT AS pos FROM conversations WHERE length(text) > 0),
        b AS (SELECT id, pos, octet_length(encode(c)) AS k, coalesce(sum(octet_length(encode(c))) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM c),
        m AS (SELECT id, pos, avg(((j * 7 + id) % 50) / 50.0::DOUBLE) AS m FROM (SELECT id, pos, unnest(range(before + 1, before + k + 1)) AS j FROM b) GROUP BY ALL)
        SELECT id, count(*)::INTEGER AS n, round(sum(m), 6)::DOUBLE AS total, round(max(m), 9)::DOUBLE AS most FROM m GROUP BY id""",
    "route_probs": f"""
        WITH {CHARS}, k AS (SELECT doc_id, count(*) FILTER (truth IN ('D', 'P')) AS code, count(*) FILTER (truth IN ('L', 'N')) AS prose, count(*) FILTER (truth = 'W') AS space, count(*) AS n FROM x GROUP BY doc_id)
        SELECT d.doc_id, round((coalesce(code, 0) + 2) / (coalesce(n, 0) + 5), 9)::DOUBLE AS code, round((coalesce(prose, 0) + 2) / (coalesce(n, 0) + 5), 9)::DOUBLE AS prose, round((coalesce(space, 0) + 1) / (coalesce(n, 0) + 5), 9)::DOUBLE AS space FROM documents d LEFT JOIN k USING (doc_id)""",
    "scan_states": "SELECT doc_id, round(list_reduce(list_prepend(0.0::DOUBLE, list_transform(string_split(text, chr(10)), lambda x: length(x)::DOUBLE)), lambda h, x: 0.5 * h + x), 6)::DOUBLE AS state FROM documents WHERE text IS NOT NULL",
}
