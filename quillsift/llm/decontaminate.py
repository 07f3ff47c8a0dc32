"""Benchmark decontamination by one Aho-Corasick automaton over normalised test questions and answers.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased; a normalised text is its words
with one space before, between and behind them. An item's windows are its runs of WINDOW words (all its
words, if they are fewer). The automaton holds the windows of all items; each text goes through it once, and
places in the normalised text are mapped to words and to code points of the original.

The benchmark's windows come to the driver in blocks of at most BLOCK_CHARS characters, so what is broadcast
has a bound; a window and an item that holds it are dealt to a block together. One block is the rule; with
more, documents are stored under numbers and go through each block's automaton, and what the blocks found is
united by document. Results don't depend on the blocks.

Null and empty texts, and those without a word, have no words and no hits. Items without a word have no
windows; an item is its item_id (null counts as the empty string), so rows that repeat an item_id are one
item with the windows of all of them. Repeated documents give repeated rows; null doc_ids are kept. Texts
of any length are read whole. Without items nothing is hit; an empty table gives an empty result. Only
doc_id, text and the benchmark's item_id, text are read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm import textcore
from quillsift.llm.runtime import dropped, steady, stored

WINDOW = 10
#: Characters of the windows of one automaton (a node of some 50 bytes each, at most).
BLOCK_CHARS = 2 << 20
#: Bytes of words as they count, a space for all others.
PLAIN = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
#: Spans of a document: words from start on, up to end; code points of the original text.
SPANS = "array<struct<start_word:bigint,end_word:bigint,start_char:bigint,end_char:bigint>>"
_automata: dict[str, ahocorasick.Automaton] = {}


def normalised(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the normalised text, and the places of its words' first bytes in the original's bytes."""
    plain = np.frombuffer(textcore.raw(text).translate(PLAIN), np.uint8)
    word = plain != 32
    first = word & ~np.concatenate([[False], word[:-1]])
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint8), starts
    # of each run of other bytes the last stays, as the space before a word
    keep = word.copy()
    keep[:-1] |= first[1:]
    return np.concatenate([[32] * bool(starts[0] == 0), plain[keep], [32]]).astype(np.uint8), starts


def windows(text: str | None) -> list[str]:
    """The distinct windows of an item, normalised (a byte a letter)."""
    words = normalised(text)[0].tobytes().decode("latin-1").split(" ")[1:-1]
    n = min(len(words), WINDOW)
    return list(dict.fromkeys(f" {' '.join(words[i : i + n])} " for i in range(len(words) - n + 1))) if words else []


def automaton_of(rows: list[tuple[str, str]]) -> ahocorasick.Automaton:
    """rows: window, item. The value of a window is its number of words and its items."""
    out, items = ahocorasick.Automaton(), {}
    for window, item in rows:
        items.setdefault(window, []).append(item)
    for window, of in items.items():
        out.add_word(window, (window.count(" ") - 1, of))
    out.make_automaton()
    return out


def occurrences(norm: np.ndarray, automaton: ahocorasick.Automaton) -> tuple[list[tuple[int, int]], set[str]]:
    """The words hit, as ranges that don't touch, and the items with an occurring window."""
    if not len(norm) or not len(automaton):
        return [], set()
    found = list(automaton.iter(norm.tobytes().decode("latin-1")))
    if not found:
        return [], set()
    spaces = np.flatnonzero(norm == 32)  # the space behind the k-th word is spaces[k + 1]
    ends = np.searchsorted(spaces, [at for at, _ in found])
    items: set[str] = set()
    for of in {id(of): of for _, (_, of) in found}.values():
        items.update(of)
    return united([(end - n, end) for end, (_, (n, _)) in zip(ends.tolist(), found, strict=True)]), items


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def located(text: str, starts: np.ndarray, ranges: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Word ranges with the code points of the original text that they take."""
    data = np.frombuffer(textcore.raw(text), np.uint8)
    chars = np.cumsum((data & 0xC0) != 0x80)  # code points up to and with each byte
    plain = np.frombuffer(data.tobytes().translate(PLAIN), np.uint8) != 32
    last = np.flatnonzero(plain & ~np.append(plain[1:], False))
    return [(a, b, int(chars[starts[a]]) - 1, int(chars[last[b - 1]])) for a, b in ranges]


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """window, item: each window of each item once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(w, i) for i, t in zip(b.item, b.text, strict=True) for w in windows(t)], columns=["window", "item"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return items.mapInPandas(run, "window string, item string").distinct()


def scanned(docs: DataFrame, block: Broadcast) -> DataFrame:
    """docs with n_words, spans, items instead of the text. block: a name, and rows window, item."""
    kind = dict(docs.dtypes)["doc_id"]
    keys = [c for c in docs.columns if c not in ("doc_id", "text")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, rows = block.value
        if name not in _automata:
            _automata.clear()  # one at a time
            _automata[name] = automaton_of(rows)
        for b in batches:
            n, spans, items = [], [], []
            for text in b.text:
                norm, starts = normalised(text)
                ranges, of = occurrences(norm, _automata[name])
                n.append(len(starts))
                spans.append([dict(zip(("start_word", "end_word", "start_char", "end_char"), x, strict=True)) for x in located(text, starts, ranges)] if ranges else [])
                items.append(sorted(of))
            yield pd.DataFrame({"doc_id": b.doc_id} | {c: b[c] for c in keys} | {"n_words": n, "spans": spans, "items": items})

    more = "".join(f"{c} {dict(docs.dtypes)[c]}, " for c in keys)
    # ids travel as text: pandas would make floats of a column with nulls
    out = docs.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, f"doc_id string, {more}n_words long, spans {SPANS}, items array<string>")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def united_spans(each: list[dict]) -> list[dict]:
    """Spans of several blocks as spans that don't touch."""
    held: list[dict] = []
    for x in sorted(each, key=lambda x: (x["start_word"], -x["end_word"])):
        if held and x["start_word"] <= held[-1]["end_word"]:
            if x["end_word"] > held[-1]["end_word"]:
                held[-1] |= {"end_word": x["end_word"], "end_char": x["end_char"]}
        else:
            held.append(dict(x))
    return held


def contamination(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, spans, items for each document: the stretches of words that lie in occurring windows,
    and the items that these belong to, sorted as strings."""
    spark = docs.sparkSession
    steady(spark)
    found = stored(benchmark_windows(benchmark), "windows")
    size = found.agg(F.coalesce(F.sum(F.length("window") + F.length("item")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_chars))
    docs = docs.select("doc_id", "text")
    if blocks > 1:
        docs = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")

    def block(k: int) -> Broadcast:
        rows = found.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == k).collect()
        return spark.sparkContext.broadcast((uuid.uuid4().hex, [(r.window, r.item) for r in rows]))

    if blocks == 1:
        out = scanned(docs, block(0))
        dropped(found)
        return out
    parts = []
    for k in range(blocks):
        held = block(k)
        parts.append(stored(scanned(docs, held).where((F.size("items") > 0) | (F.lit(k) == 0)), "found"))
        held.destroy()
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # a row for each block that found something in the document
    per = every.groupBy("__row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    once = F.pandas_udf(lambda spans: pd.Series([united_spans(x) for x in spans]), SPANS)
    out = stored(per.select("doc_id", "n_words", once("spans").alias("spans"), "items"), "contamination")
    dropped(found, docs, *parts)
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""
    found = contamination(docs, benchmark)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end_word"] - x["start_word"])
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated")
    )
