"""Words of whole texts in Arrow batches: what ``text`` and ``stemming`` say as columns, without a row for each word.

Tokens are runs of ASCII letters and digits, so words of a text's UTF-8 bytes are words of the text. A Python process
stems a word once as long as it remembers it, whatever tasks it serves; what is forgotten is stemmed anew.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from quillsift.functions.stemming import stem
from quillsift.functions.text import STOPWORDS

#: Bytes of tokens in lower case; any other is a space.
_LOWER = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_STOPS = {w.encode() for w in STOPWORDS}
#: Words that a process remembers, their greatest length, and rows of a batch that it hands on, about.
REMEMBERED, LONGEST, BATCH_ROWS = 400_000, 40, 1 << 16


class Terms(dict):
    """The term of each word, None of stop words."""

    def __missing__(self, word: bytes) -> str | None:
        term = None if word in _STOPS else stem(word.decode())
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = term
        return term


_terms = Terms()


def places(text: bytes) -> dict[str, list[int]]:
    """Where each term of a text is; positions count words, stop words aside."""
    found: dict[str, list[int]] = {}
    at = 0
    for word in text.translate(_LOWER).split():
        term = _terms[word]
        if term is not None:
            if (known := found.get(term)) is None:
                found[term] = [at]
            else:
                known.append(at)
            at += 1
    return found


def batch_of(ids: pa.Array, found: list[dict[str, list[int]]]) -> pa.RecordBatch:
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ids, sizes, found = ids.filter(pa.array(sizes > 0)), sizes[sizes > 0], [f for f in found if f]
    lists = list(chain.from_iterable(f.values() for f in found))
    tf = np.fromiter(map(len, lists), np.int32, len(lists))
    ends = np.cumsum(tf, dtype=np.int64)
    flat = np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1]) if len(ends) else 0)
    starts = np.cumsum(sizes) - sizes
    dl = np.add.reduceat(tf, starts, dtype=np.int64) if len(found) else np.zeros(0, np.int64)
    norm = np.sqrt(np.add.reduceat((1 + np.log10(tf)) ** 2, starts)) if len(found) else np.zeros(0)
    columns = [
        ids.take(pa.array(np.repeat(np.arange(len(found)), sizes))), pa.array(list(chain.from_iterable(found)), pa.string()), pa.array(tf),
        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat)), pa.array(np.repeat(dl, sizes)), pa.array(np.repeat(norm, sizes)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["docid", "term", "tf", "positions", "dl", "norm"])


def analyzed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        first, rows, found = 0, 0, []
        for i in range(batch.num_rows):
            found.append(places(batch.column(1)[i].as_py()))
            rows += len(found[-1])
            if rows >= BATCH_ROWS or i + 1 == batch.num_rows:
                yield batch_of(batch.column(0).slice(first, len(found)), found)
                first, rows, found = i + 1, 0, []


def term_rows(docs: DataFrame, text: Column) -> DataFrame:
    """docid, term, tf, positions, dl, norm: a row for each document and term, a document's rows together. dl and norm are
    the number of the text's words and the norm of its log tf weights."""
    kind = docs.schema["docid"].dataType.simpleString()
    return docs.select("docid", text.cast("binary").alias("text")).mapInArrow(analyzed, f"docid {kind}, term string, tf int, positions array<int>, dl long, norm double")
