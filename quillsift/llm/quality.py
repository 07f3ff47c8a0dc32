"""Quality rules by repetition coverage.

Rolling hashes of several word n-gram lengths (numpy) mark every n-gram that occurs twice or more in
the text; what counts is the share of the text's word characters that lie inside marked n-grams, and
the share inside lines that repeat an earlier line. A text goes when any share passes its limit.

Null or empty texts have no words: all counts are 0, base_failed is true, kept is false. Repeated rows
are judged alike, one row each. Very long texts are measured whole; hashing goes through them in slices.
An empty table gives an empty result. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm import textcore
from quillsift.llm.runtime import steady

#: Most that may lie inside repeated n-grams of so many words, as a share of word characters.
COVERAGE_LIMITS = {3: 0.45, 5: 0.20, 7: 0.16, 10: 0.12}
#: Most word characters inside lines equal to an earlier line; most symbols for each word character.
LINE_LIMIT, SYMBOL_LIMIT = 0.30, 0.10
SYMBOLS = b"#*$%&|<>"
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, coverage array<double>, dup_line_share double"


def repeated(h: np.ndarray) -> np.ndarray:
    """Which hashes occur twice or more."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.zeros(len(h), bool)
    if len(h) > 1:
        eq = s[1:] == s[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.empty(len(h), bool)
    out[order] = same
    return out


def covered(hit: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in a hit window of n words."""
    edge = np.zeros(len(hit) + n, np.int32)
    edge[: len(hit)] += hit
    edge[n:] -= hit
    return np.cumsum(edge)[: len(hit) + n - 1] > 0


def measure(text: str | None) -> tuple:
    data = textcore.raw(text)
    starts, ends, words = textcore.words_and_hashes(data)
    n_words = len(words)
    b = np.frombuffer(data, np.uint8)
    lead = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
    chars = lead[ends] - lead[starts]
    word_chars = int(chars.sum())
    n_symbols = sum(data.count(bytes([s])) for s in SYMBOLS)
    lines, dup_lines, dup_chars, at = set(), 0, 0, 0
    for line in data.split(b"\n"):
        if line.strip(b" \t\n\r\x0b\x0c"):
            if line in lines:
                dup_lines += 1
                dup_chars += int(chars[np.searchsorted(starts, at) : np.searchsorted(starts, at + len(line))].sum())
            lines.add(line)
        at += len(line) + 1
    shares, n_repeat = [], 0
    for n in COVERAGE_LIMITS:
        marks = covered(repeated(textcore.ngram_hashes(words, n)), n) if n_words >= n else np.zeros(n_words, bool)
        if n == 5:
            n_repeat = int(marks.sum())
        shares.append(float(chars[marks].sum()) / word_chars if word_chars else 0.0)
    line_share = dup_chars / word_chars if word_chars else 0.0
    failed = n_words < 10 or 100 * n_repeat > 20 * n_words
    good = all(s <= most for s, most in zip(shares, COVERAGE_LIMITS.values(), strict=True))
    good = good and line_share <= LINE_LIMIT and n_symbols <= SYMBOL_LIMIT * word_chars
    return n_words, word_chars, n_symbols, dup_lines, n_repeat, failed, bool(not failed and good), shares, line_share


def measured(df: DataFrame, text: str = "text") -> F.Column:
    """A struct column of SCHEMA for a text column."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([measure(t) for t in texts], columns=names)

    return run(df[text])


def quality_report(docs: DataFrame) -> DataFrame:
    """One row for each document: its counts, shares and the verdict. A narrow map; nothing is shuffled."""
    steady(docs.sparkSession)
    return docs.select("doc_id", measured(docs).alias("q")).select("doc_id", "q.*")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns they came with."""
    steady(docs.sparkSession)

    @F.pandas_udf("boolean")
    def good(texts: pd.Series) -> pd.Series:
        return pd.Series([measure(t)[6] for t in texts], dtype=bool)

    return docs.where(good(docs["text"]))
