"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Everything here is a Spark expression over one row, so no row moves and no Python runs
on executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places summed one by one; further ones start from a block's sum, so that offsets take linear time.
STRIDE = 128
#: Characters before and after a span, up to the next one of its kind, in which context words count.
NEAR = 48
#: Spans below this score are dropped, but for the base kinds.
THRESHOLD = 0.5


@dataclass(frozen=True)
class Kind:
    """A kind of personal data.

    pattern: in Java's syntax, without backtracking into what it has taken; quick: a
    pattern that a text with any such span contains; check: whether a proposed span holds;
    score: before context; always: kept whatever its score.
    """

    name: str
    pattern: str
    quick: str
    check: str
    score: float
    context: tuple[str, ...]
    always: bool = False


def digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits of ``number`` pass the Luhn checksum: every second one from the right is doubled."""
    def add(total: Column, i: Column) -> Column:
        d = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(number) - 1), F.lit(0), add) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account code, its first four characters last and letters as 10 to 35, is 1 modulo 97."""
    plain = F.regexp_replace(code, "[ ]", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _check(name: str, span: Column) -> Column:
    n = F.length(digits(span))
    if name == "ip":
        return F.forall(F.split(span, "[.]"), lambda part: part.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if name == "card":
        return F.when(n.between(13, 19), luhn(digits(span))).otherwise(False)
    if name == "phone":
        return n.between(9, 15)
    if name == "iban":
        return F.when(F.length(F.regexp_replace(span, "[ ]", "")).between(15, 34), mod97(span)).otherwise(False)
    if name == "ssn":
        return ~span.rlike("^(000|666|9)|-00-|0000$")
    return F.lit(True)


#: The four base kinds, in the order in which they are reported, then those that the method adds.
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", "", 0.9, ("mail", "contact", "@"), True),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]", "ip", 0.8, ("ip", "host", "server", "address"), True),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9][0-9 -]{11}", "card", 0.9, ("card", "visa", "credit"), True),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", "phone", 0.8, ("phone", "tel", "call", "fax"), True),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "[A-Z]{2}[0-9]{2}", "iban", 0.7, ("iban", "account", "bank", "konto", "compte", "cuenta"), False),
    Kind("ssn", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "ssn", 0.35, ("ssn", "social", "security", "tax"), False),
)
BASE = tuple(k.name for k in KINDS if k.always)

SPAN = "array<struct<kind:string,start:long,end:long,score:double>>"


def _lengths(parts: Column, found: Column) -> Column:
    """For each match, the length of the text before it, since the last one, and of itself."""
    return F.transform(found, lambda m, i: F.length(F.get(parts, i)).cast("long") + F.length(m))


def _sum(lengths: Column, start: Column, stop: Column) -> Column:
    """Sum of lengths[start:stop]; single items are read in place, where slice() would copy the array."""
    return F.when(start < stop, F.aggregate(F.sequence(start, stop - 1), F.lit(0).cast("long"), lambda a, k: a + F.get(lengths, k))).otherwise(F.lit(0).cast("long"))


def _block_sums(lengths: Column) -> Column:
    """Length of each block of STRIDE matches."""
    n = F.size(lengths)
    return F.transform(F.sequence(F.lit(0), F.floor((n - 1) / STRIDE).cast("int")), lambda b: _sum(lengths, b * STRIDE, F.least(n, b * STRIDE + STRIDE)))


def _block_starts(sums: Column) -> Column:
    return F.transform(sums, lambda _, b: _sum(sums, F.lit(0), b))


def _located(found: Column, lengths: Column, starts: Column) -> Column:
    """(start, end) of each match; the arguments are columns, else they'd be computed for each match."""

    def place(m: Column, i: Column) -> Column:
        block = F.floor(i / STRIDE).cast("int")
        end = F.get(starts, block) + _sum(lengths, block * STRIDE, i + 1)
        return F.struct((end - F.length(m)).alias("start"), end.alias("end"))

    return F.transform(found, place)


def spans_of(docs: DataFrame, kind: Kind, name: str) -> DataFrame:
    """``docs`` with a column of this kind's spans; needs the column ``__text``."""
    text = F.col("__text")
    has = text.contains(kind.quick) if kind.quick == "@" else text.rlike(kind.quick)
    docs = docs.withColumn("__found", F.when(has, F.expr(f"regexp_extract_all(__text, r'{kind.pattern}', 0)")))
    docs = docs.withColumn("__parts", F.when(F.size("__found") > 0, F.split(text, kind.pattern, -1)))
    some = F.size("__found") > 0
    docs = docs.withColumn("__lengths", F.when(some, _lengths(F.col("__parts"), F.col("__found"))))
    docs = docs.withColumn("__sums", F.when(some, _block_sums(F.col("__lengths"))))
    docs = docs.withColumn("__starts", F.when(some, _block_starts(F.col("__sums"))))
    # named twice, so that the optimizer doesn't move its expression into the function of each match
    docs = docs.withColumn("__at", F.when(F.size("__starts") > 0, _located(F.col("__found"), F.col("__lengths"), F.col("__starts"))))
    words = "|".join(kind.context)

    def scored(at: Column, i: Column) -> Column:
        near = F.lower(F.concat(F.substring(F.get("__parts", i), F.lit(-NEAR), F.lit(NEAR)), F.lit(" "), F.substring(F.get("__parts", i + 1), F.lit(1), F.lit(NEAR))))
        bonus = F.when(near.rlike(rf"(?<![a-z])(?:{words})"), 0.3).otherwise(0.0)
        score = F.least(F.lit(1.0), F.lit(kind.score) + bonus)
        return F.struct(F.lit(kind.name).alias("kind"), at["start"].alias("start"), at["end"].alias("end"), score.alias("score"), _check(kind.name, F.get("__found", i)).alias("holds"))

    all_spans = F.transform("__at", scored)
    keep = F.filter(all_spans, lambda s: s["holds"] if kind.always else s["holds"] & (s["score"] >= THRESHOLD))
    plain = F.transform(keep, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["score"].alias("score")))
    empty = F.from_json(F.lit("[]"), SPAN)
    return docs.withColumn(name, F.when(F.size("__found") > 0, plain).otherwise(empty)).drop("__found", "__parts", "__lengths", "__sums", "__starts", "__at")


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(doc_id, text, and a column of spans for each kind) for each row of ``docs`` (doc_id, text; others are ignored).

    A span has kind, start, end (code points, end exclusive) and score. Within a kind,
    spans are leftmost and don't overlap; one that fails its check is dropped, and nothing
    inside it is tried again. Null and empty texts have no span. A null doc_id stays null.
    Repeated rows are searched one by one. An empty table gives an empty table.
    """
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("text", F.lit("")).alias("__text"))
    for kind in kinds:
        out = spans_of(out, kind, f"pii_{kind.name}")
    return out.drop("__text")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mask: str = "*") -> Column:
    """``text`` with each span (in order, apart from each other) replaced by its kind in brackets."""
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    starts = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text).cast("long")))
    tags = F.concat(F.transform(spans, lambda s: F.concat(F.lit("["), s["kind"], F.lit("]"))), F.array(F.lit("")))
    pieces = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b"), tags.alias("t")), lambda x: F.concat(F.substring(text, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")), x["t"]))
    return F.array_join(pieces, "")


def digest(found: DataFrame) -> DataFrame:
    """Counts and span lists of ``find_pii``'s rows."""
    base = F.concat(*[f"pii_{k}" for k in BASE])
    every = F.concat(*[f"pii_{k.name}" for k in KINDS])
    return found.select(
        "doc_id",
        *[F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(every).alias("spans"),
    )
