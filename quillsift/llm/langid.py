"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are all runs of 1 to 4 bytes of its lower-cased letters, words being separated by one
space. Each is hashed to one of BUCKETS rows of an embedding; a text is the mean of its subwords'
rows, and a linear softmax gives the languages. Both are trained by stochastic gradient descent in
numpy on a bounded sample: at most SAMPLE_ROWS labelled rows, spread evenly over the languages, each
as a whole and once as a short run of words. A third part of the sample calibrates: a temperature is
fitted on it, and the least score at which PRECISION of the accepted rows are right becomes the
rejection limit.

For prediction the two layers are one table (bucket x language), so a text is the mean of table rows.
Whole texts are read, in slices, so that of a very long one no more than a slice is expanded. lang, source and doc_id are never inputs of a prediction.

Null texts and texts without a letter are ``und`` with score 0 and rejected; so is everything if no
labelled row exists. A null lang is no label. A null doc_id counts as an empty id when rows are dealt
into folds. Repeated rows are predicted each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm.runtime import in_fold, steady

FOLDS, HELD_OUT = 4, 2
BUCKETS, WIDTH, SIZES = 1 << 16, 16, (1, 2, 3, 4)
SAMPLE_ROWS, EPOCHS, RATE, SEED = 1600, 8, 1.0, 7
PRECISION = 0.99
LETTER = re.compile(r"[^\W\d_]")
NOT_LETTERS = re.compile(r"[\W\d_]+")
SLICE = 1 << 20


def subwords(text: str) -> Iterator[np.ndarray]:
    """Buckets of all subwords, in slices of the text."""
    plain = f" {NOT_LETTERS.sub(' ', text.lower()).strip()} ".encode("utf-8", "surrogatepass")
    reach = SIZES[-1] - 1
    for at in range(0, len(plain), SLICE):
        b = np.frombuffer(plain[at : at + SLICE + reach], np.uint8).astype(np.uint32) + np.uint32(1)
        h = np.zeros(len(b), np.uint32)
        last = at + SLICE >= len(plain)
        for n in range(1, SIZES[-1] + 1):
            m = len(b) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint32(0x01000193) + b[n - 1 :]
            if n in SIZES:
                x = (h + np.uint32(n)) * np.uint32(0x9E3779B1)
                x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77)
                yield (x if last else x[:SLICE]) >> np.uint32(16)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    counts = np.zeros(BUCKETS, np.int64)
    for s in subwords(text):
        counts += np.bincount(s, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at.astype(np.uint16), (counts[at] / max(1, counts.sum())).astype(np.float32)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float = 1.0
    limit: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for s in subwords(text):
            total += self.table.take(s, axis=0).sum(axis=0, dtype=np.float64)
            n += len(s)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.languages or not LETTER.search(text):
            return "und", 0.0, True
        p = softmax(self.logits(text) / self.temperature)
        best = int(np.argmax(p))
        score = min(1.0, float(p[best]))
        return self.languages[best], score, score < self.limit


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray, bool]]) -> Model:
    """rows: language, buckets, shares, whether the row calibrates."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(SEED)
    code = {x: i for i, x in enumerate(languages)}
    embed = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    train, held = [r for r in rows if not r[3]] or rows, [r for r in rows if r[3]]
    steps, done = EPOCHS * len(train), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(train)):
            lang, at, share, _ = train[i]
            rate = np.float32(RATE * (1 - done / steps) + 0.01)
            done += 1
            x = share @ embed[at]
            g = softmax(x @ out + bias).astype(np.float32)
            g[code[lang]] -= 1
            back = out @ g
            out -= rate * np.outer(x, g)
            bias -= np.float32(0.1) * rate * g
            embed[at] -= np.outer(share * (rate * len(at) ** 0.5), back)
    model = Model(languages, embed @ out, bias.astype(np.float64))
    if held:
        z = np.array([share @ model.table[at] + bias for _, at, share, _ in held], np.float64)
        y = np.array([code[r[0]] for r in held])
        grid = np.geomspace(0.05, 5, 60)
        model.temperature = float(min(grid, key=lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()))
        p = softmax(z / model.temperature)
        score, right = p.max(axis=1), p.argmax(axis=1) == y
        order = np.argsort(-score, kind="stable")
        precise = np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= PRECISION
        model.limit = float(score[order][np.flatnonzero(precise)[-1]]) if precise.any() else 1.0
    return model


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learns from rows with a language outside the held-out fold. The sample is chosen by a hash of
    doc_id, evenly over the languages; its subword counts, at most BUCKETS numbers a row, reach the driver."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~in_fold(FOLDS, HELD_OUT))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(sample_rows).collect()}
    if not sizes:
        return fit([])
    each = max(1, sample_rows // len(sizes))
    scale = 1 << 30
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, each / n) * scale))]), F.col("lang"))
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(scale)) < share)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for lang, text, h in zip(b.lang, b.text, b.h, strict=True):
                words = text.split()
                at, n = h // 16 % max(1, len(words)), 3 + h % 10
                for piece in (text, " ".join(words[at : at + n])):
                    if LETTER.search(piece):
                        ids, shares = counted(piece)
                        out.append((lang, ids.tobytes(), shares.tobytes(), h // 3 % 3 == 0))
            yield pd.DataFrame(out, columns=["lang", "ids", "shares", "held"])

    sample = chosen.withColumn("h", F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(1 << 40))).select("lang", "text", "h")
    got = sample.mapInPandas(features, "lang string, ids binary, shares binary, held boolean").limit(4 * sample_rows).collect()
    got.sort(key=lambda r: (r.lang, bytes(r.ids), bytes(r.shares)))
    return fit([(r.lang, np.frombuffer(r.ids, np.uint16), np.frombuffer(r.shares, np.float32), r.held) for r in got])


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each document: a narrow map over the texts with
    the model (a few MB, of fixed size) sent to the tasks."""
    spark = docs.sparkSession
    steady(spark)
    sent = spark.sparkContext.broadcast(model or train(docs))

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for texts in batches:
            yield pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return docs.select("doc_id", in_fold(FOLDS, HELD_OUT).alias("held_out"), run("text").alias("p")).select("doc_id", "held_out", "p.*")
