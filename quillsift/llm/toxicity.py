"""Toxicity scores from a factorization machine over hashed terms.

Terms are a text's words (lower-cased, punctuation apart) and the first 4 to 9 bytes of longer words,
hashed to BUCKETS. A term's value is log(1 + count). The score is the logistic of
``bias + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``: single weights miss what only a pair of terms
says (an insult and the mention of a group), the factors v learn it.

Learning: at most SAMPLE_ROWS labelled rows outside the held-out fold, chosen by a hash of doc_id, in
which rare labels are not thinned (up to half of the sample). The TERMS buckets that tell the labels
apart best enter the machine; it is trained by AdaGrad in numpy. Then the bias is set on a part of the
sample that was not trained on, so that 0.5 separates the labels best.

Whole texts are scored, very long ones in slices. labels, lang, source and doc_id are never inputs of a score. Null and empty
texts get the score of no terms; without any labelled row that is 0. A null label is no label;
where a document has several labels the largest counts. A null doc_id counts as an empty one for the
folds and is joined with no label. Repeated rows are scored each on its own. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm import textcore
from quillsift.llm.runtime import in_fold, steady

FOLDS, HELD_OUT = 5, 0
BUCKETS, FACTORS, TERMS = 1 << 18, 8, 6000
PREFIXES = (4, 5, 6, 7, 8, 9)
SAMPLE_ROWS, EPOCHS, RATE, DECAY, SEED = 6000, 12, 0.08, 2e-5, 11
#: Bytes that end words: ASCII other than letters and digits.
PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text's terms and how often each occurs."""
    data = (text or "").lower().encode("utf-8", "surrogatepass").translate(PLAIN)
    buckets = np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = 0
    while start < len(data):  # long texts in slices, cut between words
        end = min(len(data), start + textcore.SLICE)
        while end < len(data) and data[end] != 32:
            end += 1
        got = _terms(data[start:end])
        if len(got):
            ids, n = np.unique(np.concatenate([np.repeat(*buckets), got]) if len(buckets[0]) else got, return_counts=True)
            buckets = ids, n
        start = end
    return buckets


def _terms(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    starts, ends = textcore.spans(b)
    if not len(starts):
        return np.zeros(0, np.int64)
    first, last = int(starts[0]), int(ends[-1])
    lengths = ends - starts
    offsets = np.arange(first, last) - np.repeat(starts, np.append(starts[1:], last) - starts)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(textcore.BYTE_VALUE[b[first:last]] * textcore.powers(int(offsets.max()) + 1)[offsets])])
    begin = starts - first
    parts = [textcore.mix(sums[ends - first] - sums[begin] + np.uint64(1))]
    for k in PREFIXES:
        at = begin[lengths > k]
        parts.append(textcore.mix(sums[at + k] - sums[at] + np.uint64(k * 1000003)))
    return (np.concatenate(parts) >> np.uint64(64 - 18)).astype(np.int64)


@dataclass
class Machine:
    slot: np.ndarray  # bucket -> place in w and v, or -1
    w: np.ndarray
    v: np.ndarray
    bias: float

    def value(self, ids: np.ndarray, n: np.ndarray) -> float:
        at = self.slot[ids] if len(ids) else np.zeros(0, np.int64)
        x = np.log1p(n[at >= 0])
        at = at[at >= 0]
        xv = x[:, None] * self.v[at]
        s = xv.sum(axis=0)
        return float(self.bias + x @ self.w[at] + 0.5 * (s @ s - (xv * xv).sum()))

    def score(self, text: str | None) -> float:
        if not len(self.w):
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.value(*terms(text)), -30, 30))))


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Machine:
    """rows: label, buckets, counts."""
    slot = np.full(BUCKETS, -1, np.int32)
    if len({r[0] for r in rows}) < 2:
        return Machine(slot, np.zeros(0), np.zeros((0, FACTORS)), 0.0)
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(rows))
    held, used = order[: len(rows) // 5], order[len(rows) // 5 :]
    if len({rows[i][0] for i in held}) < 2 or len({rows[i][0] for i in used}) < 2:
        held = used = order
    seen = np.zeros((2, BUCKETS))
    size = np.bincount([rows[i][0] for i in used], minlength=2)
    for i in used:
        seen[rows[i][0], rows[i][1]] += 1
    p1, p0 = (seen[1] + 0.5) / (size[1] + 1), (seen[0] + 0.5) / (size[0] + 1)
    gain = np.where(seen.sum(axis=0) >= 2, np.abs(np.sqrt(p1) - np.sqrt(p0)), 0)
    top = np.sort(np.argsort(-gain, kind="stable")[:TERMS])
    top = top[gain[top] > 0]
    slot[top] = np.arange(len(top))
    w, v, bias = np.zeros(len(top)), rng.normal(0, 0.01, (len(top), FACTORS)), 0.0
    gw, gv, gb = np.full(len(top), 1e-6), np.full((len(top), FACTORS), 1e-6), 1e-6
    ready = []
    for y, ids, n in rows:
        at = slot[ids]
        ready.append((y, at[at >= 0], np.log1p(n[at >= 0])))
    weight = size.sum() / (2 * np.maximum(size, 1))
    for _ in range(EPOCHS):
        for i in rng.permutation(used):
            y, at, x = ready[i]
            va = v[at]
            xv = x[:, None] * va
            s = xv.sum(axis=0)
            z = bias + x @ w[at] + 0.5 * (s @ s - (xv * xv).sum())
            g = weight[y] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            dw = g * x + DECAY * w[at]
            dv = g * (x[:, None] * s - (x * x)[:, None] * va) + DECAY * va
            gw[at] += dw * dw
            gv[at] += dv * dv
            gb += g * g
            w[at] -= RATE * dw / np.sqrt(gw[at])
            v[at] -= RATE * dv / np.sqrt(gv[at])
            bias -= RATE * g / np.sqrt(gb)
    m = Machine(slot, w, v, bias)
    z = np.array([m.value(rows[i][1], rows[i][2]) for i in held])
    y = np.array([rows[i][0] for i in held])
    cuts = np.unique(z)
    middle = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [cuts[-1] + 1]])
    wrong = np.array([((z >= c) != (y == 1)).sum() for c in middle])
    best = middle[wrong == wrong.min()]
    m.bias -= float(best[np.argmin(np.abs(best))])
    return m


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Machine:
    """Learns from labelled documents outside the held-out fold. At most sample_rows ids (a bounded
    table, broadcast) pick the texts; their term counts reach the driver."""
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold(FOLDS, HELD_OUT)).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return fit([])
    scale = 1 << 30
    rare = min(min(sizes.values()), sample_rows // 2)
    share = [int(min(1.0, (rare if n == min(sizes.values()) else sample_rows - rare) / n) * scale) for n in (sizes[0], sizes[1])]
    chosen = rows.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(scale)) < F.when(F.col("label") == 0, share[0]).otherwise(share[1])).limit(2 * sample_rows)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [terms(t) for t in b.text]
            yield pd.DataFrame({"label": b.label, "ids": [i.astype(np.int32).tobytes() for i, _ in got], "n": [n.astype(np.uint32).tobytes() for _, n in got]})

    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text").mapInPandas(features, "label int, ids binary, n binary").collect()
    got.sort(key=lambda r: (r.label, bytes(r.ids), bytes(r.n)))
    return fit([(r.label, np.frombuffer(r.ids, np.int32).astype(np.int64), np.frombuffer(r.n, np.uint32).astype(np.int64)) for r in got])


def toxicity(docs: DataFrame, labels: DataFrame, machine: Machine | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each document: a narrow map with a model of fixed size."""
    steady(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine or train(docs, labels))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = sent.value
        for texts in batches:
            yield pd.Series([m.score(t) for t in texts], dtype=float)

    scored = docs.select("doc_id", in_fold(FOLDS, HELD_OUT).alias("held_out"), run("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
