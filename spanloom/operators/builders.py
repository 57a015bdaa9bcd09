"""Mixed texts with known segments, built from rows that are paired by rank of a stable hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators import spans


def ranked(df: DataFrame, group: str, key: Column) -> DataFrame:
    """``df`` with its rank in its group, by the hash of a key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.sha2(key, 256), key)))


def chains(parts: DataFrame, group: str, groups: list[str], text: str, anchor: int, between: str) -> DataFrame:
    """(rank, content, segments): the rank-th text of each named group, cut to ``anchor``, one after the other.

    Ranks at which a group has no text give none.
    """
    rows = parts.filter(F.col(group).isin(groups)).withColumn("part", F.substring(text, 1, anchor))
    order = F.create_map(*[F.lit(x) for i, g in enumerate(groups) for x in (g, i)])[F.col(group)]
    full = rows.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(groups)).select("rank")
    rows = rows.join(full, "rank").withColumn("place", order).withColumn("label", F.col(group))
    return spans.concat_parts(rows, "rank", "place", "part", "label", between)


def needles(hosts: DataFrame, donors: DataFrame, share: float) -> DataFrame:
    """(rank, content, segments, start): a donor's text put into the host of its rank, after the line in which ``share`` of it ends.

    hosts: (rank, text, label); donors: (rank, needle, needle_label). A host of one line takes it at its end.
    """
    pairs = hosts.join(donors, "rank")
    near = F.floor(F.length("text") * share).cast("int")
    line = F.instr(F.substring(F.col("text"), near + 1, F.length("text")), "\n")
    at = F.when(line > 0, near + line).otherwise(F.length("text"))
    rows = pairs.withColumn("start", at.cast("int"))
    host = F.array(spans.segment(F.lit(0), F.length("text"), F.col("label")))
    guest = F.array(spans.segment(F.lit(0), F.length("needle"), F.col("needle_label")))
    content = F.concat(F.substring(F.col("text"), F.lit(1), F.col("start")), "needle", F.substring(F.col("text"), F.col("start") + 1, F.length("text")))
    return rows.select("rank", content.alias("content"), spans.insert(host, guest, F.col("start"), F.length("needle")).alias("segments"), "start")


def fenced(hosts: DataFrame, blocks: DataFrame, word: str) -> DataFrame:
    """(rank, content, segments): a block in a Markdown fence after the host's text; the fence belongs to the Markdown."""
    rows = hosts.join(blocks, "rank")
    open_, close = F.lit(f"\n```{word}\n"), F.lit("\n```\n")
    a = F.length("text") + F.length(open_)
    b = a + F.length("block")
    content = F.concat("text", open_, "block", close)
    parts = F.array(spans.segment(F.lit(0), a, F.lit("markdown")), spans.segment(a, b, F.col("block_label")), spans.segment(b, b + F.length(close), F.lit("markdown")))
    return rows.select("rank", content.alias("content"), parts.alias("segments"))


def sized(df: DataFrame, text: str, sizes: list[int]) -> DataFrame:
    """Each text repeated and cut to each of the sizes; empty texts give none."""
    rows = df.filter(F.length(text) > 0).withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    return rows.withColumn("content", F.substring(F.repeat(F.col(text), F.ceil(F.col("size") / F.length(text)).cast("int")), F.lit(1), F.col("size")))


def training_windows(df: DataFrame, key: str, labels: str, size: int, pad: str) -> DataFrame:
    """(key, win, labels): label strings cut into windows end to end, the last one padded."""
    n = F.length(labels)
    rows = df.filter(n > 0).select(key, F.col(labels).alias("__all"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).alias("win"))
    return rows.select(key, "win", F.rpad(F.substring(F.col("__all"), F.col("win") * size + 1, F.lit(size)), F.lit(size), F.lit(pad)).alias("labels"))


def dominant_window(df: DataFrame, labels: str, runs: str, host: Column, size: int, name: str) -> DataFrame:
    """``df`` with (start, n, share): the window of ``size`` places, from the start of a run of the host, with most of its label.

    The first of equals; null without such a run.
    """
    host_runs = F.filter(runs, lambda r: r["label"] == host)

    def held(r: Column) -> Column:
        part = F.substring(F.col(labels), r["start"] + 1, F.lit(size))
        n = F.length(part) - F.length(F.replace(part, host, F.lit("")))
        return F.struct(n.alias("n"), (-r["start"]).alias("key"), r["start"].alias("start"), F.round(n / F.length(part), 9).alias("share"))

    best = F.array_max(F.transform(host_runs, held))
    return df.withColumn(name, F.when(best.isNotNull(), F.struct(best["start"].alias("start"), best["n"].alias("n"), best["share"].alias("share"))))


def payloads(hosts: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """(rank, needle, needle_label): a template for each host's rank, its {ip}, {port} and {name} filled from a hash of the rank.

    Templates are (text, label); fill them with inert text in tests.
    """
    texts, labels = (F.array(*[F.lit(t[k]) for t in templates]) for k in (0, 1))
    digits = F.sha2(F.concat(F.lit("payload:"), F.col("rank").cast("string")), 256)
    byte = lambda k: F.conv(F.substring(digits, 2 * k + 1, 2), 16, 10)
    which = F.pmod(F.col("rank"), F.lit(len(templates))).cast("int")
    filled = F.get(texts, which)
    for mark, value in (("{ip}", F.concat_ws(".", F.lit("10"), byte(0), byte(1), byte(2))), ("{port}", (F.lit(1024) + byte(3).cast("int") * 200).cast("string")), ("{name}", F.substring(digits, 9, 8))):
        filled = F.replace(filled, F.lit(mark), value)
    return hosts.select("rank", filled.alias("needle"), F.get(labels, which).alias("needle_label"))


def remove_substring(df: DataFrame, text: str, segments: str, start: Column, end: Column) -> DataFrame:
    """``df`` with [start, end) taken out of the text and of its segments."""
    cut = F.concat(F.substring(F.col(text), F.lit(1), start), F.substring(F.col(text), end + 1, F.length(text)))
    return df.withColumn("__cut", cut).withColumn(segments, spans.delete(F.col(segments), start, end)).withColumn(text, F.col("__cut")).drop("__cut")


def spaced_hex(text: Column, every: int) -> Column:
    """Hexadecimal text with a space after every ``every`` digits."""
    return F.rtrim(F.regexp_replace(F.regexp_replace(text, r"\s", ""), f"(.{{{every}}})", "$1 "))


def replay(fresh: DataFrame, stored: DataFrame, key: Column, share: float) -> DataFrame:
    """Fresh rows, and of the stored ones the given share by hash."""
    from spanloom.functions.encoding import sha_share

    return fresh.unionByName(stored.filter(sha_share(key) < share), allowMissingColumns=True)


def random_rows(rows: DataFrame, key: Column, length: int, alphabet: str) -> DataFrame:
    """``rows`` with ``content``: text without meaning, its characters drawn by hash from an alphabet of at most 256."""
    blocks = F.transform(F.sequence(F.lit(0), F.lit((length - 1) // 32)), lambda k: F.sha2(F.concat(key, F.lit(":"), k.cast("string")), 256))
    digits = F.array_join(blocks, "")
    letters = F.split(F.lit(alphabet), "")
    pick = lambda i: F.get(letters, F.pmod(F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("int"), F.lit(len(alphabet))))
    return rows.withColumn("content", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), pick), ""))
