"""Benchmark decontamination on a positional inverted index, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.text import ascii_lower
from spanloom.session import discard, stored

#: Words in a window.
WINDOW = 13
#: Rarest terms of a window whose lists are intersected.
LISTS = 3
#: Bytes of a benchmark table (terms, anchors, windows) up to which it is sent to all executors; they are summed first.
BROADCAST_BYTES = 32 << 20
#: Parts into which each key is dealt where a benchmark table is too large to be sent, so that a frequent word isn't one task's.
SALTS = 32
#: Lower-cased texts are split at everything but a-z, 0-9 and characters beyond ASCII. A-Z is gone by then.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: Column) -> Column:
    """Lower-cased words of a text; null has none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), lambda w: w != "")


def size_of(df: DataFrame) -> int:
    """Bytes of a stored table's strings and arrays, and 16 for each row."""
    parts = [F.coalesce(F.sum(F.octet_length(F.array_join(n, " ") if t.startswith("array") else F.col(n))), F.lit(0)) for n, t in df.dtypes if t == "string" or t == "array<string>"]
    row = df.agg(F.count(F.lit(1)).alias("rows"), sum(parts, F.lit(0)).alias("bytes")).first()
    return 16 * row["rows"] + row["bytes"]


def meet(large: DataFrame, few: DataFrame, key: str, how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """``large`` joined with the stored table ``few``: sent to all executors if its summed bytes allow, else dealt with salt.

    With salt every row of ``few`` goes to SALTS tasks and a row of ``large`` to one of
    them, so that a frequent key is spread.
    """
    if size_of(few) <= most:
        return large.join(F.broadcast(few), key, how)
    salted = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return large.withColumn("__salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int")).join(salted, [key, "__salt"], how).drop("__salt")


def numbered(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, words): a stored copy of ``docs`` (doc_id, text) whose rows have numbers of their own.

    Hits are kept by row and not by doc_id, which may be null or occur on unlike rows. A
    column ``__rid`` of ``docs`` is taken as that number.
    """
    rid = F.col("__rid") if "__rid" in docs.columns else F.monotonically_increasing_id()
    return stored(docs.select(rid.alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), word_list(F.col("text")).alias("words")), "numbered")


def phrase_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(wid, item_id, words) of each window of each item (item_id, text): equal windows share a wid, their text."""
    listed = items.select("item_id", word_list(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.size("ws") - (window - 1), F.lit(1)))).alias("at")
    cut = listed.select("item_id", "ws", starts).select("item_id", F.slice("ws", F.col("at"), F.lit(window)).alias("words"))
    return cut.select(F.array_join("words", " ").alias("wid"), "item_id", "words").distinct()


def term_counts(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of the terms occurs in all ``rows`` (rid, words)."""
    words = rows.select("rid", F.explode_outer("words").alias("term"))
    return meet(words, terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


def anchors(kinds: DataFrame, counts: DataFrame, lists: int = LISTS) -> DataFrame:
    """(term, wid, rank, off, lists): the rarest places of each of ``kinds`` (wid, words) and the terms there."""
    terms = kinds.select("wid", F.posexplode("words").alias("off", "term"))
    ranked = terms.join(counts, "term", "left").groupBy("wid").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "off"))).alias("order"))
    few = ranked.select("wid", F.slice("order", 1, lists).alias("order"))
    return few.select("wid", F.size("order").alias("lists"), F.posexplode("order").alias("rank", "o")).select(F.col("o.term").alias("term"), "wid", "rank", F.col("o.off").alias("off"), "lists")


def postings(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: (term, rid, pos) for each occurrence in ``rows`` (rid, words) of a term that is looked up."""
    return meet(rows.select("rid", F.posexplode_outer("words").alias("pos", "term")), terms, "term").select("term", "rid", "pos")


def proposals(index: DataFrame, marks: DataFrame) -> DataFrame:
    """(rid, wid, start) where all lists of a window agree.

    The lists of its rarest terms are moved by the terms' places in the window and
    intersected; only places are compared and shuffled, never words.
    """
    moved = meet(index, marks, "term").withColumn("start", F.col("pos") - F.col("off")).filter("start >= 0")
    both = moved.groupBy("rid", "wid", "start", "lists").agg(F.bit_or(F.expr("shiftleft(1, rank)")).alias("met"))
    return both.filter("met = shiftleft(1, lists) - 1").select("rid", "wid", "start")


def phrase_matches(index: DataFrame, marks: DataFrame, kinds: DataFrame, rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """(rid, wid, start, length) of every occurrence in ``rows`` (rid, words) of each of ``kinds`` (wid, words).

    What survives the intersection is compared word by word with the row's own words.
    """
    agreed = stored(proposals(index, marks), "proposals")
    found = agreed.groupBy("rid").agg(F.collect_list(F.struct("wid", "start")).alias("at"))
    if agreed.count() * 24 <= BROADCAST_BYTES:  # a row for each place: three numbers
        near = rows.select("rid", F.col("words").alias("ws")).join(F.broadcast(found), "rid")
    else:  # words hold no space, so that a text is shuffled, which is smaller than a list
        near = rows.select("rid", F.array_join("words", " ").alias("text")).join(found, "rid").withColumn("ws", F.split("text", " "))
    near = near.select("rid", "ws", F.explode("at").alias("p"))
    near = near.select("rid", F.col("p.wid").alias("wid"), F.col("p.start").alias("start"), F.slice("ws", F.col("p.start") + 1, window).alias("here"))
    same = meet(near, kinds, "wid").filter(F.slice("here", 1, F.size("words")) == F.col("words"))
    return same.select("rid", "wid", "start", F.size("words").alias("length"))


def proximity_matches(docs: DataFrame, queries: DataFrame, slop: int) -> DataFrame:
    """(doc_id, query_id, pos): places of a query's rarest term with all its other terms within ``slop`` words.

    queries: (query_id, text). A query without words matches nothing; a term named twice
    counts once. Each query's rarest term is looked up in the index; the words around
    each place then decide. Rows are told apart by number, so ids may repeat or be null;
    equal rows give equal matches each.
    """
    rows = numbered(docs)
    listed = queries.select("query_id", F.array_distinct(word_list(F.col("text"))).alias("wanted")).filter(F.size("wanted") > 0)
    terms = stored(listed.select(F.explode("wanted").alias("term")).distinct(), "terms")
    counts = stored(term_counts(rows, terms), "counts")
    ranked = listed.select("query_id", "wanted", F.explode("wanted").alias("term")).join(counts, "term", "left")
    rare = stored(ranked.groupBy("query_id", "wanted").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term"))["term"].alias("term")), "rare")
    index = stored(postings(rows, stored(rare.select("term").distinct(), "keys")), "postings")
    places = meet(index, rare, "term").groupBy("rid").agg(F.collect_list(F.struct("query_id", "pos", "wanted")).alias("at"))
    near = rows.join(places, "rid").select("doc_id", "words", F.explode("at").alias("p")).select("doc_id", "words", "p.*")
    first = F.greatest(F.col("pos") - slop, F.lit(0))
    around = near.withColumn("near", F.slice("words", first + 1, F.col("pos") - first + slop + 1))
    return around.filter(F.forall("wanted", lambda w: F.array_contains(F.col("near"), w))).select("doc_id", "query_id", "pos")


def _covered(spans: Column) -> Column:
    """Number of places inside sorted spans (start, end)."""
    none = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, s: Column) -> Column:
        new = F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["start"]))
        return F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + new).alias("n"))

    return F.aggregate(spans, none, add, lambda acc: acc["n"])


def hit_rows(rows: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(rid, n_hit, n_items, items_sha256) of the ``rows`` (rid, words) in which any window of ``items`` occurs."""
    windows = phrase_windows(items, window)
    numbers = stored(windows.groupBy(F.col("wid").alias("phrase")).agg(F.first("words").alias("words"), F.collect_set(F.col("item_id").cast("string")).alias("owners")).withColumn("wid", F.monotonically_increasing_id()), "windows")
    kinds, owners = numbers.select("wid", "words"), numbers.select("wid", "owners")
    terms = stored(kinds.select(F.explode("words").alias("term")).distinct(), "terms")
    counts = stored(term_counts(rows, terms), "counts")
    marks = stored(anchors(kinds, counts), "anchors")
    index = stored(postings(rows, stored(marks.select("term").distinct(), "keys")), "postings")
    matches = stored(phrase_matches(index, marks, kinds, rows, window), "matches")
    discard(index)
    hits = matches.groupBy("rid").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end")))).alias("spans"))
    found = meet(matches.select("rid", "wid").distinct(), owners, "wid").select("rid", F.explode("owners").alias("item"))
    found = found.groupBy("rid").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return hits.join(found, "rid", "left").select(
        "rid", _covered(F.col("spans")).alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.array_join(F.coalesce("items", F.array().cast("array<string>")), ","), 256).alias("items_sha256")
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for each row of ``docs`` (doc_id, text).

    A word is hit if it lies in an occurrence of any window of ``items`` (item_id, text);
    a document is contaminated if it has a hit and at least 5 % of its words are hit.
    Each row is judged by its own text alone, whatever its doc_id: repeated rows, rows of
    unlike texts under one id and null ids included. Other columns are ignored. Null and
    empty texts have no words; items without words have no window; a window that several
    items share counts for each; an item without an id has its hits and isn't listed.
    Empty tables give no rows or no hits.
    """
    return _judged(numbered(docs), items, window).drop("rid")


def _judged(rows: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    hits = hit_rows(rows, items, window)
    n_hit, n_words = F.coalesce("n_hit", F.lit(0).cast("long")), F.size("words").cast("long")
    return rows.select("rid", "doc_id", n_words.alias("n_words")).join(hits, "rid", "left").select(
        "rid", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that aren't contaminated.

    Rows are told apart by number: a clean row stays whatever other rows have its doc_id.
    Rows with null or empty texts stay, repeated rows stay or go alike, and an empty
    table gives an empty table; without items every row stays. Columns of any other name
    are carried along.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    copy = stored(docs.toDF(*names).withColumn("__rid", F.monotonically_increasing_id()), "docs")
    at = {n: names[docs.columns.index(n)] for n in ("doc_id", "text")}
    rows = numbered(copy.select("__rid", F.col(at["doc_id"]).alias("doc_id"), F.col(at["text"]).alias("text")))
    bad = stored(_judged(rows, items).filter("contaminated").select(F.col("rid").alias("__rid")), "bad")
    return copy.join(bad, "__rid", "left_anti").drop("__rid").toDF(*docs.columns)
