"""Dense labels: one code character for each character of a text, kept as a string in the row.

Everything here works inside a row: no row moves, and a document's labels never become
rows of their own unless a query asks for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes of the stand-in labelling, by code: letters, digits, white space, beyond ASCII, the rest.
CLASSES = {"L": "letter", "D": "digit", "W": "space", "N": "wide", "P": "sign"}
OTHER = "O"
SPACE = " \t\n"


def lexical_labels(text: Column) -> Column:
    """The stand-in truth: the lexical class of each character."""
    marked = F.regexp_replace(text, r"[^\x00-\x7F]", "\x01")
    marked = F.regexp_replace(marked, "[0-9]", "\x02")
    marked = F.regexp_replace(marked, "[A-Za-z]", "\x03")
    marked = F.regexp_replace(marked, r"[\x09\x0A-\x0D\x20]", "\x04")
    marked = F.regexp_replace(marked, r"[^\x01-\x04]", "P")
    return F.translate(marked, "\x01\x02\x03\x04", "NDLW")


def codes(labels: Column) -> Column:
    """The codes of a label string as an array."""
    return F.filter(F.split(labels, ""), lambda c: c != "")


def perturbed(labels: Column, doc_id: Column, every: int = 17) -> Column:
    """The stand-in prediction: every ``every``-th place, by document, is a sign."""
    return F.array_join(F.transform(codes(labels), lambda c, i: F.when(F.pmod(i + doc_id, F.lit(every)) == 0, "P").otherwise(c)), "")


def with_runs(df: DataFrame, labels: str, name: str) -> DataFrame:
    """``df`` with the maximal spans of equal labels: array of (start, end, label), end exclusive."""
    df = df.withColumn("__codes", codes(F.col(labels)))
    n = F.size("__codes")
    change = lambda i: (i == 0) | (i == n) | (F.get("__codes", i) != F.get("__codes", i - 1))
    df = df.withColumn("__cuts", F.when(n > 0, F.filter(F.sequence(F.lit(0), n), change)).otherwise(F.array().cast("array<int>")))
    span = lambda k: F.struct(F.get("__cuts", k).alias("start"), F.get("__cuts", k + 1).alias("end"), F.get("__codes", F.get("__cuts", k)).alias("label"))
    spans = F.transform(F.sequence(F.lit(0), F.size("__cuts") - 2), span)
    empty = F.array().cast("array<struct<start:int,end:int,label:string>>")
    return df.withColumn(name, F.when(F.size("__cuts") > 1, spans).otherwise(empty)).drop("__codes", "__cuts")


def runs_of(df: DataFrame, labels: str, *keys: str) -> DataFrame:
    """(keys, run, start, end, label), a row for each run.

    The outer form keeps the optimizer from testing the array's size below the projections
    that make it, which would put them inside one another's functions.
    """
    rows = with_runs(df, labels, "__runs").select(*keys, F.posexplode_outer("__runs").alias("run", "r")).filter("run IS NOT NULL")
    return rows.select(*keys, "run", "r.start", "r.end", "r.label")


def dense_of(segments: Column, length: Column, gap: str) -> Column:
    """Label string of segments (start, end, label) over ``length`` places; later ones win, gaps get ``gap``.

    Segments are clipped to the text; empty ones are skipped.
    """
    start = F.repeat(F.lit(gap), length)

    def paint(acc: Column, s: Column) -> Column:
        a, b = F.greatest(s["start"], F.lit(0)), F.least(s["end"], F.length(acc))
        new = F.concat(F.substring(acc, F.lit(1), a), F.repeat(s["label"], b - a), F.substring(acc, b + 1, F.length(acc) - b))
        return F.when(a < b, new).otherwise(acc)

    return F.aggregate(segments, start, paint)


def fill_space(df: DataFrame, text: str, labels: str, name: str) -> DataFrame:
    """White space takes the label of the nearest character before it that isn't white space, else after it.

    A label string in which white space is blanked is filled by one regular expression for
    each direction, so a long text takes linear time.
    """
    df = df.withColumn("__text", F.split(text, ""))
    blank = F.array_join(F.zip_with(codes(F.col(labels)), F.slice("__text", F.lit(1), F.length(labels)), lambda c, t: F.when(F.instr(F.lit(SPACE + "\r\x0b\x0c"), t) > 0, " ").otherwise(c)), "")
    df = df.withColumn("__blank", F.when(F.length(labels) > 0, blank).otherwise(""))
    pieces = F.regexp_extract_all("__blank", F.lit("[^ ] *"), F.lit(0))
    filled = F.array_join(F.transform(pieces, lambda p: F.rpad(F.rtrim(p), F.length(p), F.substring(p, 1, 1))), "")
    lead = F.length(F.regexp_extract("__blank", "^( *)", 1))
    first = F.substring(F.ltrim("__blank"), 1, 1)
    out = F.concat(F.repeat(first, lead), filled)
    return df.withColumn(name, F.when(F.trim("__blank") == "", F.col(labels)).otherwise(out)).drop("__text", "__blank")


def gate(df: DataFrame, labels: str, best: str, least: float, name: str) -> DataFrame:
    """Labels whose best probability (an array, one for each place) is under ``least`` become OTHER; 0 or less changes nothing."""
    if least <= 0:
        return df.withColumn(name, F.col(labels))
    out = F.array_join(F.zip_with(codes(F.col(labels)), best, lambda c, p: F.when(p < least, OTHER).otherwise(c)), "")
    return df.withColumn(name, out)


def smooth_once(df: DataFrame, labels: str, shortest: int, name: str) -> DataFrame:
    """One pass over the runs: one under ``shortest`` takes its longer neighbour's label, the left one's on a tie.

    Runs at the ends take their only neighbour's; two runs or fewer stay.
    """
    df = with_runs(df, labels, "__r")
    at = lambda k: F.get("__r", k)
    size = lambda r: F.coalesce(r["end"] - r["start"], F.lit(0))

    def one(r: Column, k: Column) -> Column:
        left, right = at(k - 1), at(k + 1)
        label = F.when(size(r) >= shortest, r["label"]).when(size(left) >= size(right), F.coalesce(left["label"], r["label"])).otherwise(F.coalesce(right["label"], r["label"]))
        return F.repeat(label, size(r))

    out = F.array_join(F.transform("__r", one), "")
    return df.withColumn(name, F.when((F.size("__r") > 2) & F.lit(shortest > 1), out).otherwise(F.col(labels))).drop("__r")


def pairs_of(truth: str, pred: str) -> Column:
    """(pos, truth, pred) for each place of two label strings."""
    return F.transform(F.arrays_zip(codes(F.col(truth)).alias("t"), codes(F.col(pred)).alias("p")), lambda x, i: F.struct(i.alias("pos"), x["t"].alias("truth"), x["p"].alias("pred")))
