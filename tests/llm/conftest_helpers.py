"""Rows and brute-force helpers shared by the tests of this folder."""

from __future__ import annotations

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Rows with nulls in every column, empty and blank texts, ties, repeated rows, and one long text.
AWKWARD = [
    (1, "", "en", "s", 0),
    (2, None, None, None, None),
    (None, "A text without an id, but with words.", "en", "s", 37),
    (None, None, None, None, None),
    (3, " \n\t\x0b ", "en", "s", 5),
    (4, "One two three.\nOne two three.\nFour é 𝒳.", "en", "s", 39),
    (4, "One two three.\nOne two three.\nFour é 𝒳.", "en", "s", 39),
    (5, "One two three.\nOne two three.\nFour é 𝒳.", "de", "s", 39),
    (6, "word " * 30_000, "fr", "s", 150_000),
    (7, "x", None, "s", 1),
    (-8, "\x85   a b <|endoftext|>", "es", "s", 20),
]


def some_text(rng: random.Random, n: int, vocabulary: int = 300) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))
