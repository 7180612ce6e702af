"""Line-first cleaning: rules judge each line, failing lines go, then documents that lose too much go.

Lines are what stands between line feeds; words are runs of anything but ASCII white space. A line without
words fails nothing. Otherwise it fails
- navigation: at least 3 of its words are menu marks and they are a fifth of its words, or at least 3 words
  carry a symbol of `#*$%&|<>` and they are three tenths of its words,
- boilerplate: it contains a phrase of BOILERPLATE, whatever the case of A-Z,
- punctuation: none of its words ends in a mark that ends a sentence, a quotation or a list lead-in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolescope.llm import common

SPACE = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
ENDS = ".!?…:;\"')]}»”’。！？"
MENU_MARKS = (b"|", b"/", b">", b"-", "·".encode(), "»".encode(), "›".encode(), "•".encode())
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "this work is licensed", "cookie policy", "privacy policy",
    "terms of use", "terms of service", "enable javascript", "click here", "sign up for our newsletter", "lorem ipsum",
)
_has_symbol = re.compile(rb"[#*$%&|<>]").search
_has_phrase = re.compile("|".join(map(re.escape, BOILERPLATE)).encode()).search


class Judged(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept_words: int
    kept: bool
    cleaned: str


def line_fails(words: list[bytes], line: bytes) -> str | None:
    """The rule that a line with words fails, or None."""
    marks = sum(w in MENU_MARKS for w in words)
    if marks >= 3 and marks * 5 >= len(words):
        return "navigation"
    if _has_symbol(line):
        symbols = sum(_has_symbol(w) is not None for w in words)
        if symbols >= 3 and symbols * 10 >= len(words) * 3:
            return "navigation"
    if _has_phrase(line.lower()):
        return "boilerplate"
    if any(w.decode()[-1] in ENDS for w in reversed(words)):
        return None
    return "punctuation"


def repeat_words(words: list[bytes]) -> int:
    """Words in 3-word windows that occur at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) >= 1 << 21:
        pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * len(known) + ids[2:]
    else:
        windows = (ids[:-2] * len(known) + ids[1:-1]) * len(known) + ids[2:]
    _, which, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(count[which] > 1)
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[twice + i] = True
    return int(covered.sum())


def judge(text: str | None, lost_most: float = 0.5) -> Judged:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    word_chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    with_words, kept, kept_words = [], [], 0
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            continue
        with_words.append(line)
        if line_fails(own, line) is None:
            kept.append(line)
            kept_words += len(own)
    repeated = repeat_words(words)
    failed = n < 50 or 100 * repeated > 50 * n
    return Judged(n, word_chars, n_symbols, len(with_words) - len(set(with_words)), repeated, failed, kept_words,
                  not failed and n - kept_words <= lost_most * n, b"\n".join(kept).decode())


COLUMNS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
           "kept_words long, kept boolean, cleaned string")


def _judge(lost_most: float):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            found = [judge(t, lost_most) for t in batch.column("_text").to_pylist()]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in
                       enumerate([pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.bool_(), pa.string()])]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *columns], ["_row", *Judged._fields])
    return run


def clean_lines(docs: DataFrame, text: str = "text", lost_most: float = 0.5) -> DataFrame:
    """All columns, with the counts, base_failed, kept_words, kept and cleaned (lines that passed, with words).

    A document is kept if it has 50 words or more, at most half of them in repeated 3-word windows, and its
    failing lines hold at most `lost_most` of its words. Null texts have no words and fail. Columns called
    like the new ones are replaced. Repeated rows are judged alike. No rows in, no rows out.
    """
    docs = docs.drop(*Judged._fields)
    rows = docs.select(common.row(docs).alias("_row"), F.col(text).alias("_text"))
    kind = rows.schema["_row"].dataType.simpleString()
    return rows.mapInArrow(_judge(lost_most), f"_row {kind}, {COLUMNS}").select("_row.*", *Judged._fields)
