"""Cleaners and classifiers that read a text line by line with a memory, as vectorised functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType

# Marks of comments by family.
CODE_DIRECTIVE = re.compile(r"\s*\.\.\s+code(?:-block)?::", re.I)
LINE_MARKS = ("//", "#", "--", "%", "rem ")
BLOCKS = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" \t"))


def clean_rst_text(text: str) -> str:
    """reStructuredText without the bodies of code directives and literal blocks.

    The line that opens a block stays, a directive's options too, and one blank line after
    them. A body is what is indented deeper than its opening line, up to the first line
    that is indented less than the body's first.
    """
    kept, state = [], "text"  # text; options and blank after an opening line; body
    outer = body = 0
    for line in text.splitlines(keepends=True):
        blank, indent = not line.strip(), _indent(line)
        if state == "options" and line.strip().startswith(":") and indent > outer:
            kept.append(line)
            continue
        if state in ("options", "gap"):
            if blank:
                kept.append(line)
                state = "first"
                continue
            state = "first"
        if state == "first":
            if blank:
                continue
            if indent > outer:
                state, body = "body", indent
                continue
            state = "text"
        if state == "body":
            if blank or indent >= body:
                continue
            state = "text"
        kept.append(line)
        bare = line.strip()
        if CODE_DIRECTIVE.match(line):
            state, outer = "options", indent
        elif bare.endswith("::") and not bare.endswith(":::") and not bare.startswith(".."):
            state, outer = "gap", indent
    return "".join(kept)


@F.pandas_udf(StringType())
def clean_rst(texts: pd.Series) -> pd.Series:
    return texts.map(clean_rst_text, na_action="ignore")


def comment_flags(text: str) -> list[bool]:
    """For each line, whether it is a comment: by its first mark, or inside a block that an earlier line opened."""
    flags, until = [], ""
    for line in text.split("\n"):
        bare = line.strip()
        if until:
            flags.append(True)
            if until in bare:
                until = ""
            continue
        opened = next((mark for mark in BLOCKS if bare.startswith(mark)), "")
        flags.append(bool(opened) or bare.lower().startswith(LINE_MARKS) or bare.lower() == "rem")
        if opened and BLOCKS[opened] not in bare[len(opened) :]:
            until = BLOCKS[opened]
    return flags


@F.pandas_udf(ArrayType(BooleanType()))
def comment_lines(texts: pd.Series) -> pd.Series:
    return texts.map(comment_flags, na_action="ignore")


def docker_shell_spans(text: str) -> list[tuple[int, int]]:
    """Where RUN commands of a Dockerfile hold shell: after the word and its options, over continued lines and heredocs."""
    out, at, lines = [], 0, text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    while at < len(lines):
        head = re.match(r"\s*RUN\s+(?:--\S+\s+)*", lines[at], re.I)
        if not head:
            at += 1
            continue
        begin, last = starts[at] + head.end(), at
        here = re.search(r"<<-?\s*['\"]?(\w+)['\"]?", lines[at])
        if here:
            last = next((k for k in range(at + 1, len(lines)) if lines[k].strip() == here[1]), len(lines) - 1)
        else:
            while lines[last].rstrip().endswith("\\") and last + 1 < len(lines):
                last += 1
        end = starts[last] + len(lines[last])
        if end > begin:
            out.append((begin, end))
        at = last + 1
    return out
