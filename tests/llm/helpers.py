"""Awkward documents, and plain Python versions of what the operators share."""

from __future__ import annotations

import re

LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


PROSE = "the quick brown fox jumps over the lazy dog while seven wizards watch from a distant hill and wonder why"
AWKWARD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "one two three four"), (6, PROSE), (7, PROSE.upper()), (8, PROSE + " now"), (9, "é à ü ß 日本語 テスト Ωμέγα"), (10, "don't  stop.\r\nnow!!  it's 3.14,  ok? "),
    (11, PROSE + " " + PROSE), (12, "x" * 3000), (13, " ".join(f"w{i % 97}" for i in range(5000))), (14, "tail space \n\n"), (6, PROSE), (6, "other text under the same id"), (None, PROSE), (None, None), (15, "\U0001f600\U0001f601 emoji á combining  nbsp em"), (16, "<|endoftext|> plain"), (17, "\x00\x1c control \x85 chars"),
]


def documents(spark, rows=AWKWARD, lang="en"):
    """Documents with the columns of the table and one more whose name clashes with a result."""
    full = [(i, t, lang, "src0", len(t or ""), 7.0) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA + ", score double")
