"""Word splitting shared by the operators of this package."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: White space that str.split() splits at, beyond ASCII's six.
WIDER_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text: str) -> list[str]:
    """Runs of characters other than the six ASCII white space characters."""
    return WORD.findall(text) if WIDER_SPACE.search(text) else text.split()


def lower_words(text: str | None) -> list[bytes]:
    """UTF-8 words with only A-Z lower-cased; bytes.split() knows exactly the six ASCII spaces."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, any other character as it is; null stays null.

    ``lower`` is exact for pure ASCII texts and much faster than ``translate``.
    """
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)
