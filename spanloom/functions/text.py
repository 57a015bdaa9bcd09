"""Cleaners and tests on texts, as Column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

PLACEHOLDER = "¤"

# License families that are taken, and fragments that are not.
ALLOWED_LICENSES = ("mit", "apache", "bsd", "unlicense", "0bsd", "mit-0")
REFUSED_LICENSES = ("gpl", "agpl", "lgpl", "mpl", "epl", "cdla", "cddl", "artistic", "cern", "cecill", "affero", "proprietary", "arr", "cc")
TEXT_FIELDS = ("content", "text", "raw_content", "body", "document", "content_text")

# Patterns of markup that is cut out or counted.
BLOCKS = r"(?is)<\s*script\b[^>]*>.*?</\s*script\s*>|<\s*style\b[^>]*>.*?</\s*style\s*>"
SELF_CLOSED = r"(?is)<\s*(?:script|style)\b[^>]*/>"
STRAY = r"(?is)<\s*(?:script|style)\b[^>]*>|</\s*(?:script|style)\s*>"
SVG_STYLE = r"(?is)<\s*style\b[^>]*>.*?</\s*style\s*>"
SVG_STYLE_SELF_CLOSED = r"(?is)<\s*style\b[^>]*/>"
HANDLERS = r"""(?is)\s(?:on[a-z]+|:on[a-z]+|@[a-z.:-]+|x-on[a-z.:-]*|hx-on[a-z.:-]*)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)"""
SCRIPT_URIS = r"""(?is)\s[a-z-]+\s*=\s*(?:"\s*javascript:[^"]*"|'\s*javascript:[^']*')"""
FRAMEWORKS = r"(?i)\b(?:angular|react|svelte|vue)\b"
TAG = r"(?i)</?[^>\s]+(?:\s+[^<>]*)?>"
INLINE_CODE = r"(?<!`)`([^`\n]+?)`(?!`)"
BLADE = r"(?im)^\s*@(?:extends|section|yield|endsection|include|component|slot|push|stop|parent|stack|csrf|method|error|lang|forelse|empty|endforelse|php|endphp|verbatim|endverbatim)\b"
BLADE_COMMENT = r"(?is)\{\{--.*?--\}\}"
TWIG = r"(?i)\{%\s*[a-z]"
SMARTY = r"(?i)\{/?\s*(?:if|foreach|section|block|capture|literal|extends|include)\b"
CURLY = r"\{\{[^}]+\}\}"
PHP = r"(?is)<\?(?!xml)(?:php|=)?(.*?)\?>"
ASP = r"(?is)<%(.*?)%>"
TEMPLATE_PATHS = r"\.blade\.php|/resources/views/|\.twig$|\.tpl$|\.tpl\.php$"


def ascii_text(text: Column) -> Column:
    """Line ends as \\n; anything but printable ASCII, \\n and tab as the placeholder."""
    return F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("\n")), r"[^\x20-\x7E\n\t]", PLACEHOLDER)


def line_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def replacement_marks(text: Column) -> Column:
    return F.replace(text, F.lit("�"), F.lit(PLACEHOLDER))


def limit_length(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)


def clamp_bytes(text: Column, most: int) -> Column:
    """The longest prefix of whole characters within ``most`` UTF-8 bytes.

    UTF-8 is cut at the byte; then up to three bytes of a split character go.
    """
    raw = F.substring(F.encode(text, "UTF-8"), 1, most)
    last = F.hex(F.substring(raw, -4, 4))
    # lead bytes within the last three places whose character is longer than what is left of it
    whole = F.regexp_replace(last, "^(?:[0-9A-F]{2})*?((?:C|D)[0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-7](?:[89AB][0-9A-F]){0,2})$", "!$1")
    cut = F.when(whole.startswith("!"), (F.length(whole) - 1) / 2).otherwise(0).cast("int")
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(raw, F.lit(1), F.length(raw) - cut), "UTF-8"))


def unescape_basic(text: Column) -> Column:
    """The five named XML references and the no-break space, decoded; ``&amp;`` last."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def web_text(text: Column) -> Column:
    """References decoded, written-out \\n as line ends, tags dropped, white space as one space, trimmed."""
    plain = F.regexp_replace(F.replace(unescape_basic(text), F.lit("\\n"), F.lit("\n")), "<[^>]+>", "")
    return F.trim(F.regexp_replace(plain, r"[\s ]+", " "))


def to_fixpoint(text: Column, pattern: str, rounds: int = 3) -> Column:
    """Matches removed again and again, since a removal may join what becomes a match.

    A match can only arise anew where one was nested in the parts of another. ``rounds``
    rounds are built in; rows that still match, which nest deeper, are looped over alone
    until nothing changes.
    """
    for _ in range(rounds):
        text = F.regexp_replace(text, pattern, "")
    deep = F.when(text.rlike(pattern), text)
    return F.coalesce(_looped(deep, F.lit(pattern)), text)


@F.pandas_udf(StringType())
def _looped(text: pd.Series, pattern: pd.Series) -> pd.Series:
    def loop(x: str, p: str) -> str:
        was = None
        # as in Java: white space is ASCII alone
        found = re.compile(p, re.ASCII)
        while was != x:
            was, x = x, found.sub("", x)
        return x

    return pd.Series([None if x is None else loop(x, p) for x, p in zip(text, pattern)], dtype=object)


def strip_scripts(html: Column) -> Column:
    """HTML without script and style elements, event handlers and script URIs."""
    text = F.regexp_replace(to_fixpoint(html, BLOCKS), SELF_CLOSED, "")
    text = F.regexp_replace(F.regexp_replace(text, HANDLERS, ""), SCRIPT_URIS, "")
    return F.regexp_replace(text, STRAY, "")


def strip_svg_style(svg: Column) -> Column:
    return F.regexp_replace(to_fixpoint(svg, SVG_STYLE), SVG_STYLE_SELF_CLOSED, "")


def names_framework(text: Column) -> Column:
    return text.rlike(FRAMEWORKS)


def clean_markdown(text: Column) -> Column:
    """Bodies of fenced blocks dropped (the fences stay), tags dropped, inline code as two backticks."""
    lines = F.transform(F.split(text, "\n"), lambda l: F.struct(l.alias("line"), F.regexp_extract(l, r"^\s*(`{3,}|~{3,})", 1).alias("fence")))
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        closes = (acc["open"] != "") & (F.length(x["fence"]) >= F.length(acc["open"])) & (F.substring(x["fence"], 1, 1) == F.substring(acc["open"], 1, 1))
        opens = (acc["open"] == "") & (x["fence"] != "")
        keep = (acc["open"] == "") | closes
        return F.struct(
            F.when(closes, "").when(opens, x["fence"]).otherwise(acc["open"]).alias("open"),
            F.when(keep, F.concat(acc["out"], F.array(x["line"]))).otherwise(acc["out"]).alias("out"),
        )

    body = F.array_join(F.aggregate(lines, start, step, lambda acc: acc["out"]), "\n")
    return F.regexp_replace(F.regexp_replace(body, TAG, ""), INLINE_CODE, "``")


def is_php_template(text: Column, path: Column | None = None) -> Column:
    """Whether a text is a template rather than PHP: by its path, or by two kinds of marks."""
    tagged = text.contains("<?")
    curly = F.size(F.regexp_extract_all(text, F.lit(CURLY), F.lit(0)))
    blade = text.rlike(BLADE)
    marks = [blade, text.rlike(BLADE_COMMENT), (curly >= 2) & ~tagged, (curly >= 1) & blade, text.rlike(TWIG) & ~tagged, text.rlike(SMARTY) & ~tagged]
    count = sum((m.cast("int") for m in marks), F.lit(0))
    by_path = F.lower(path).rlike(TEMPLATE_PATHS) if path is not None else F.lit(False)
    return F.coalesce((text != "") & (F.coalesce(by_path, F.lit(False)) | (count >= 2)), F.lit(False))


def php_code(text: Column, path: Column | None = None) -> Column:
    """The PHP parts of a text, by line ends; else its ASP-style parts; else all of it if its start looks like PHP."""
    php, asp = (F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (PHP, ASP))
    head = F.lower(F.substring(text, 1, 4096))
    looks = head.contains("$") & (head.contains("function") | head.contains("class") | head.contains("->") | head.contains("::"))
    found = F.when(F.size(php) > 0, F.array_join(php, "\n")).when(F.size(asp) > 0, F.array_join(asp, "\n")).when(looks, text).otherwise("")
    return F.when(F.coalesce(text, F.lit("")) == "", "").when(is_php_template(text, path), "").otherwise(found)


def license_verdict(licenses: Column) -> Column:
    """(allowed, reason) of an array of license texts; a refused fragment anywhere refuses, even inside a word."""
    names = F.transform(F.filter(licenses, lambda x: x.isNotNull()), lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9.+-]+", " "))
    has = lambda words: F.exists(names, lambda s: sum((s.contains(w).cast("int") for w in words), F.lit(0)) > 0)
    reason = F.when(F.coalesce(F.size(names), F.lit(0)) <= 0, "no_license_info").when(has(REFUSED_LICENSES), "disallowed_license").when(has(ALLOWED_LICENSES), "").otherwise("no_allowed_license")
    return F.struct((reason == "").alias("allowed"), reason.alias("reason"))


def primary_text(columns: dict[str, Column]) -> Column:
    """The first text that isn't blank among the known text fields."""
    found = [F.when(F.trim(columns[n]) != "", columns[n]) for n in TEXT_FIELDS if n in columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def visible_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"\s", "")).cast("long")


def ascii_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z]", "")).cast("long")


def looks_like_json(text: Column) -> Column:
    """Bracketed, a literal or number, or delimited by colons or commas."""
    t = F.trim(text)
    literal = t.rlike(r"^(?:true|false|null|-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|\"[^\"]*\")$")
    return t.rlike(r"(?s)^\{.*\}$|^\[.*\]$") | literal | (t.rlike("[:,]") & t.rlike(r"[{}\[\]\"]"))


def ends_line(line: Column) -> Column:
    """Whether a line looks finished: blank, or ended by a closer or terminator."""
    t = F.rtrim(line)
    return (t == "") | F.right(t, F.lit(1)).isin(*";}{)],:>.")


def file_name(label: Column) -> Column:
    """A label as a safe file name."""
    return F.regexp_replace(F.regexp_replace(label, "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def escape_html(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text
