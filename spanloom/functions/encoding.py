"""Encodings of bytes and how much input they take."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BITCOIN = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


DIGITS = np.frombuffer(BITCOIN.encode(), np.uint8)
#: Digits of a leaf: 58 ** 10 is under 2 ** 63.
LEAF = 10


@lru_cache(maxsize=32)
def _power(k: int) -> int:
    return 58 ** (LEAF << k)


def base58(data: bytes) -> str:
    """Digits of the number that the bytes spell, in base 58; each leading zero byte is a 1.

    The number is halved by powers of 58 down to leaves of ten digits, so that whole texts
    cost far less than a division for each digit.
    """
    zeros = len(data) - len(data.lstrip(b"\0"))
    if zeros == len(data):
        return "1" * zeros
    parts, k = [int.from_bytes(data, "big")], 0
    while _power(k) <= parts[0]:
        k += 1
    for i in range(k - 1, -1, -1):
        parts = [half for n in parts for half in divmod(n, _power(i))]
    left = np.array(parts, np.int64)
    out = np.empty((len(left), LEAF), np.uint8)
    for i in range(LEAF - 1, -1, -1):
        left, digit = np.divmod(left, 58)
        out[:, i] = DIGITS[digit]
    return "1" * zeros + out.tobytes().decode().lstrip("1")


@F.pandas_udf(StringType())
def base32_text(data: pd.Series) -> pd.Series:
    return data.map(lambda b: base64.b32encode(b).decode(), na_action="ignore")


@F.pandas_udf(StringType())
def base58_text(data: pd.Series) -> pd.Series:
    return data.map(base58, na_action="ignore")


@F.pandas_udf(StringType())
def base85_text(data: pd.Series) -> pd.Series:
    return data.map(lambda b: base64.a85encode(b).decode(), na_action="ignore")


def encode(kind: str, data: Column) -> Column:
    if kind == "hex":
        return F.lower(F.hex(data))
    if kind == "base64":
        return F.regexp_replace(F.base64(data), "\r?\n", "")
    return {"base32": base32_text, "base58": base58_text, "base85": base85_text}[kind](data)


def most_input(kind: str, output: Column) -> Column:
    """Bytes that can be encoded into ``output`` characters."""
    if kind == "base58":  # 58 ** k covers 256 ** n for n <= k * log 58 / log 256
        return F.floor(output * 0.7322476243909465).cast("long")
    per, size = {"hex": (2, 1), "base64": (4, 3), "base32": (8, 5), "base85": (5, 4)}[kind]
    return F.floor(output / per).cast("long") * size


def sha_number(key: Column, digits: int = 8) -> Column:
    """A number from the first hexadecimal digits of a key's SHA-256; the same in any engine."""
    return F.conv(F.substring(F.sha2(key, 256), 1, digits), 16, 10).cast("long")


def sha_share(key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a key's SHA-256."""
    return sha_number(key, 13) / F.lit(float(16**13))
