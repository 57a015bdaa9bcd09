"""Windows over texts, and merging of what was predicted in overlapping ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.sampling import before


def overlapping_spans(length: Column, chunk: int) -> Column:
    """(start, end) of windows of max(64, chunk) places, half a window apart; the last is clipped, a short text has one."""
    size = max(64, chunk)
    step = size // 2
    count = F.when(length <= size, 1).otherwise(1 + F.ceil((length - size) / step))
    span = lambda k: F.struct((k * step).cast("int").alias("start"), F.least(k * step + size, length).cast("int").alias("end"))
    return F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), span)


def cover_all_spans(size: Column, window: int) -> Column:
    """Full windows end to end, and one that ends with the text if they leave a rest; none for a shorter text."""
    full = F.floor(size / window).cast("int")
    ends = F.transform(F.sequence(F.lit(1), full), lambda k: F.struct(((k - 1) * window).cast("int").alias("start"), (k * window).cast("int").alias("end")))
    tail = F.array(F.struct((size - window).cast("int").alias("start"), size.cast("int").alias("end")))
    return F.when(size < window, F.array().cast("array<struct<start:int,end:int>>")).when(size % window == 0, ends).otherwise(F.concat(ends, tail))


def byte_windows(df: DataFrame, text: str, size: int, *keys: str) -> DataFrame:
    """(keys, win, content): every ``size`` UTF-8 bytes of a text; a character cut by an edge is lost on both sides."""
    raw = F.encode(F.col(text), "UTF-8")
    count = F.ceil(F.octet_length(text) / size).cast("int")
    df = df.filter(F.octet_length(text) > 0).withColumn("__raw", raw)
    cut = df.select(*keys, "__raw", F.explode(F.sequence(F.lit(0), count - 1)).alias("win")).select(*keys, "win", F.hex(F.substring("__raw", F.col("win") * size + 1, F.lit(size))).alias("h"))
    head = F.regexp_replace("h", "^(?:[89AB][0-9A-F]){1,3}", "")
    tail = F.regexp_replace(head, "^((?:[0-9A-F]{2})*?)(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-7](?:[89AB][0-9A-F]){0,2})$", "$1")
    return cut.select(*keys, "win", F.decode(F.unhex(tail), "UTF-8").alias("content"))


def gaussian_weight(offset: Column, length: Column) -> Column:
    """exp(-((x / 0.5) ** 2) / 2) for x from -1 to 1 over a window."""
    x = F.when(length > 1, 2.0 * offset / (length - 1) - 1.0).otherwise(-1.0)
    return F.exp(-0.5 * (x / 0.5) * (x / 0.5))


def vote_merge(votes: DataFrame, key: str) -> DataFrame:
    """(key, pos, label): the label with the greatest sum of weights at each place, the smallest one on a tie.

    votes: (key, pos, label, weight).
    """
    sums = votes.groupBy(key, "pos", "label").agg(F.round(F.sum("weight"), 9).alias("w"))
    return sums.groupBy(key, "pos").agg(F.max_by(F.col("label"), F.struct("w", (-F.ascii("label")).alias("first"))).alias("label"))


def weighted_mean(parts: DataFrame, key: str) -> DataFrame:
    """(key, pos, label, p): means of probabilities over windows, by weight. parts: (key, pos, label, p, weight)."""
    return parts.groupBy(key, "pos", "label").agg((F.sum(F.col("p") * F.col("weight")) / F.sum("weight")).alias("p"))


def padded_length(length: Column, kind: str) -> Column:
    """Length classes: powers of two from 1024 on, or multiples of 256."""
    if kind == "power":
        return F.greatest(F.lit(1024), F.pow(F.lit(2.0), F.ceil(F.round(F.log2(F.greatest(length, F.lit(1)).cast("double")), 9)))).cast("long")
    return (F.ceil(F.greatest(length, F.lit(1)) / 256) * 256).cast("long")


def centred_start(focus_start: Column, focus_end: Column, length: Column, window: int) -> Column:
    """Start of a window around a span's middle, kept inside the text."""
    middle = F.floor((focus_start + focus_end) / 2)
    return F.greatest(F.lit(0), F.least(middle - window // 2, length - window)).cast("int")


def batches(df: DataFrame, key: str, size: Column, budget: int, group: str) -> DataFrame:
    """``df`` with ``batch``: rows of a group in order, a new batch wherever the running sum passes a multiple of the budget."""
    rows = before(df, group, F.col(key), size, "batch")
    return rows.withColumn("batch", F.floor(F.col("batch") / budget).cast("long"))


def pack_pieces(df: DataFrame, group: str, order: str, text: str, target: int, between: str = "\n\n") -> DataFrame:
    """(group, content, ranges): texts of a group joined in order, cut at ``target``; ranges of what is left of each."""
    rows = df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("parts"))
    lengths = F.transform("parts", lambda p: F.length(p["t"]))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def add(acc: Column, n: Column) -> Column:
        begin = F.when(F.size(acc["out"]) > 0, acc["at"] + len(between)).otherwise(0)
        fits = F.array(F.struct(begin.cast("int").alias("start"), F.least(begin + n, F.lit(target)).cast("int").alias("end")))
        return F.struct((begin + n).cast("int").alias("at"), F.when(begin < target, F.concat(acc["out"], fits)).otherwise(acc["out"]).alias("out"))

    ranges = F.aggregate(lengths, start, add, lambda acc: acc["out"])
    return rows.select(group, F.substring(F.array_join(F.transform("parts", lambda p: p["t"]), between), 1, target).alias("content"), ranges.alias("ranges"))


def stand_in_weight_sql(offset: str, length: str) -> str:
    """``gaussian_weight`` as SQL."""
    x = f"(CASE WHEN {length} > 1 THEN 2.0 * {offset} / ({length} - 1) - 1.0 ELSE -1.0 END)"
    return f"exp(-0.5 * ({x} / 0.5) * ({x} / 0.5))"




def word_windows(df: DataFrame, text: str, size: int, stride: int, least: int, *keys: str) -> DataFrame:
    """(keys, win, content): windows of ``size`` characters, cut at their last space if that is in their second half.

    The windows of a text end before the first that is shorter than ``least``.
    """
    stride = stride if stride > 0 else size
    n = F.length(text)
    rows = df.filter(n >= least).select(*keys, F.col(text).alias("__text"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / stride).cast("int"))).alias("win"))
    part = F.substring(F.col("__text"), F.col("win") * stride + 1, F.lit(size))
    rows = rows.select(*keys, "win", part.alias("__part"))
    space = F.length("__part") - F.instr(F.reverse("__part"), " ")
    cut = F.when((F.length("__part") == size) & (F.instr("__part", " ") > 0) & (space >= size // 2), F.substring(F.col("__part"), F.lit(1), space)).otherwise(F.col("__part"))
    rows = rows.select(*keys, "win", cut.alias("content"))
    first_short = F.min(F.when(F.length("content") < least, F.col("win"))).over(Window.partitionBy(*keys))
    return rows.withColumn("__stop", first_short).filter(F.col("__stop").isNull() | (F.col("win") < F.col("__stop"))).drop("__stop")


def chunk_bounds(text: Column, most: int) -> Column:
    """(start, end) of chunks of at most ``most`` characters, each ended after the last line end in its second half if there is one.

    ``text`` is a column; one regular expression tells the cut of each chunk from what is left.
    """
    half = max(1, most // 2)
    shapes = [rf".{{1,{most}}}\z", rf".{{1,{most}}}"]  # what is left fits; a full chunk
    if half < most:
        shapes.insert(1, rf".{{{half},{most - 1}}}\n")
    parts = F.regexp_extract_all(text, F.lit(f"(?s)(?:{'|'.join(shapes)})"), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
    add = lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.length(p)).alias("end")))).alias("out"))
    return F.aggregate(parts, start, add, lambda acc: acc["out"])
