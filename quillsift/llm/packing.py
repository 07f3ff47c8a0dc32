"""Best-fit packing of token sequences by exact-complement hashing.

Documents become token ids; longer ones are cut into full pieces behind a first piece that may be
shorter. Only a histogram of piece lengths (at most CAPACITY numbers) reaches the planner. It indexes
the sums of single lengths, pairs and triples, goes through the lengths from the longest down and fills
each gap exactly: by a single, else a pair, else a triple that the index has under the gap, as often as
the counts allow; combinations whose lengths are used up leave the index. What then remains is packed
best-fit decreasing, again by counts. Last, pieces are dealt to the plan's places by their rank within
their length.

Ranks are exact and distributed: a piece's rank is its row number within a hash bucket of its length
plus the sizes of the buckets before it, so a length that a third of all pieces have spreads over
RANK_BUCKETS tasks. Full pieces need no rank.

Ids are those of the ``tokenizers`` file. Where it says plainly that it is a byte-level BPE of the kind
that tiktoken's merge loop computes too, that loop is used, in a quarter of the time; texts with a stretch of
LONG_RUN characters that white space never begins or ends, on whose splitting tiktoken may run out of stack, go
through ``tokenizers``.

A null text is an empty one: its document is the single end id. Texts of any length, and of any
characters, are encoded whole.
Repeated rows are packed each on its own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm import textcore
from quillsift.llm.runtime import steady, stored

CAPACITY, END_ID, RANK_BUCKETS = 1024, 2, 128
LONG_RUN = 1 << 16
#: How a ByteLevel pre-tokenizer splits a text before merging: a fixed value of that format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encoders: dict[str, object] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable ones stand for themselves,
    the others follow from code point 256 in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in plain):
        out[chr(256 + n)] = b
    return out


def plain_ranks(spec: dict) -> dict[bytes, int] | None:
    """The tokens of a ``tokenizers`` file as merge ranks, or None where its ids may not be those of a plain
    byte-level BPE: no normalizer, this file's way of splitting, all bytes in the vocabulary, and every other
    token the result of one merge, ids in the order of merges."""
    model, special = spec["model"], {t["content"] for t in spec.get("added_tokens", [])}
    before = spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        and spec.get("normalizer") is None
        and (before.get("type"), before.get("add_prefix_space"), before.get("use_regex", True)) == ("ByteLevel", False, True)
    )
    letters = byte_letters()
    vocab = {t: i for t, i in model["vocab"].items() if t not in special} if plain else {}
    if not plain or any(c not in letters for t in vocab for c in t):
        return None
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [vocab.get(t, -1) for t in merged]
    first = max((vocab.get(c, 1 << 40) for c in letters), default=0)
    if len(set(merged)) != len(merged) or len(vocab) != len(merged) + len(letters) or not ids or ids[0] <= first or any(x >= y for x, y in zip(ids, ids[1:], strict=False)):
        return None
    return {bytes(letters[c] for c in t): i for t, i in vocab.items()}


def longest_run(text: str) -> int:
    """The longest stretch (in bytes) without a change between ASCII white space and other bytes."""
    space = textcore.SEPARATOR[np.frombuffer(textcore.raw(text), np.uint8)]
    edges = np.flatnonzero(np.diff(space.view(np.int8)))
    return int(np.diff(np.concatenate([[-1], edges, [len(space) - 1]])).max(initial=0))


def long_run(text: str) -> bool:
    return len(text) >= LONG_RUN and longest_run(text) >= LONG_RUN


class Encoder:
    """Ids of the ``tokenizers`` file at a path; fast is tiktoken's loop, where it gives the same. Texts with
    a special token's string or a long run go through ``tokenizers`` itself."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = plain_ranks(spec)
        self.fast = ranks and tiktoken.Encoding("from_file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or any(s in text for s in self.special) or long_run(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of each piece of n ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path)
        for b in batches:
            rows = []
            for doc_id, text in zip(b.doc_id, b.text, strict=True):
                ids = np.array(encode(text or "") + [END_ID], "<u4")
                rows += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)["doc_id"]
    # ids travel as text: pandas would make floats of a column with nulls
    out = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, "doc_id string, piece int, start long, length long, ids_crc32 long")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


class Plan:
    """Places for pieces: runs of (length, first rank, last rank, copies in a sequence, first sequence,
    offset in it). A pattern is a tuple of (length, copies); it is used a number of times."""

    def __init__(self):
        self.runs: dict[int, list[tuple[int, int, int, int, int]]] = {}
        self.used: dict[int, int] = {}
        self.sequences = 0

    def add(self, pattern: list[tuple[int, int]], times: int) -> None:
        offset = 0
        for length, copies in pattern:
            lo = self.used.get(length, 0)
            self.runs.setdefault(length, []).append((lo, lo + copies * times, copies, self.sequences, offset))
            self.used[length] = lo + copies * times
            offset += length * copies
        self.sequences += times


def grouped(lengths: list[int]) -> list[tuple[int, int]]:
    out: dict[int, int] = {}
    for n in lengths:
        out[n] = out.get(n, 0) + 1
    return list(out.items())


def plan_packing(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """counts[n]: pieces of length n < capacity. Where long pieces abound, short ones are better kept
    for their gaps than combined with each other; of the plans that stop the exact filling at several
    lengths, the one with the fewest sequences is taken."""
    stops = (0, capacity // 4, capacity // 3, capacity // 2, capacity * 2 // 3, capacity * 3 // 4)
    return min((plan_from(counts, capacity, stop) for stop in stops), key=lambda p: p.sequences)


class Sums:
    """Index of the sums of lengths: under each sum the smaller lengths of its pairs, and the lengths that
    make triples with a pair of the rest. What the counts no longer allow leaves the index when it is met."""

    def __init__(self, left: np.ndarray):
        self.left = left
        have = np.flatnonzero(left)
        self.pairs = [have[: np.searchsorted(have, s // 2, side="right")] for s in range(len(left))]
        self.thirds: dict[int, list[int]] = {}

    def often(self, total: int) -> np.ndarray:
        """How often the counts allow each pair with this sum."""
        a = self.pairs[total]
        out = np.minimum(self.left[a], self.left[total - a])
        if len(a) and 2 * a[-1] == total:
            out[-1] = self.left[a[-1]] // 2
        return out

    def pair(self, total: int, *others: int) -> tuple[int, ...] | None:
        """The pair with this sum that the counts allow most often next to the others."""
        if not len(self.pairs[total]):
            return None
        often = self.often(total)
        if not often.all():
            self.pairs[total], often = self.pairs[total][often > 0], often[often > 0]
        for n in others:
            self.left[n] -= 1
        if others and len(often):
            often = self.often(total)
        for n in others:
            self.left[n] += 1
        if not len(often) or often.max() <= 0:
            return None
        a = int(self.pairs[total][np.argmax(often)])
        return a, total - a

    def triple(self, total: int, *others: int) -> tuple[int, ...] | None:
        """A triple with this sum that the counts allow next to the others: the longest third that has a pair."""
        if total not in self.thirds:
            self.thirds[total] = np.flatnonzero(self.left[: max(0, total - 1)]).tolist()
        stack = self.thirds[total]
        while stack and (not self.left[stack[-1]] or not len(self.pairs[total - stack[-1]])):
            stack.pop()
        for c in reversed(stack):
            if self.left[c] > others.count(c) and (found := self.pair(total - c, c, *others)):
                return (c, *found)
        return None


def plan_from(counts: np.ndarray, capacity: int, stop: int) -> Plan:
    """Fills the gaps of pieces longer than stop exactly, the rest best-fit. The work depends on the
    capacity alone: each step uses up a length or an open bin."""
    left, plan = counts.astype(np.int64).copy(), Plan()
    index = Sums(left)

    def consume(*lengths: int) -> bool:
        runs = grouped(list(lengths))
        times = min(int(left[n]) // k for n, k in runs)
        for n, k in runs:
            left[n] -= times * k
        if times:
            plan.add(runs, times)
        return times > 0

    for n in range(capacity - 1, stop, -1):
        gap = capacity - n
        if left[n] and left[gap]:
            consume(n, gap)
        for find in (index.pair, index.triple):
            while left[n] and (found := find(gap, n)):
                consume(n, *found)
    # the rest, best-fit decreasing; open: gap -> [(pattern, bins)]
    open_bins: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    for n in range(capacity - 1, 0, -1):
        while left[n]:
            gap = min((g for g in open_bins if g >= n), default=None)
            if gap is None:
                k = min(capacity // n, int(left[n]))
                bins = int(left[n]) // k
                open_bins.setdefault(capacity - k * n, []).append(([(n, k)], bins))
                left[n] -= k * bins
                continue
            pattern, bins = open_bins[gap].pop()
            k = min(gap // n, int(left[n]))
            times = min(bins, int(left[n]) // k)
            if times < bins:
                open_bins[gap].append((pattern, bins - times))
            if not open_bins[gap]:
                del open_bins[gap]
            open_bins.setdefault(gap - k * n, []).append(([*pattern, (n, k)], times))
            left[n] -= k * times
    for groups in open_bins.values():
        for pattern, bins in groups:
            plan.add(pattern, bins)
    return plan


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    steady(docs.sparkSession)
    cuts = stored(pieces(docs, tokenizer, capacity), "pieces")
    full = cuts.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    short = cuts.where(F.col("length") < capacity).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(RANK_BUCKETS)).cast("int"))
    sizes = np.zeros((capacity, RANK_BUCKETS), np.int64)  # at most capacity x RANK_BUCKETS rows come to the driver
    for length, bucket, n in short.groupBy("length", "bucket").agg(F.count("*").alias("n")).collect():
        sizes[length, bucket] = n
    before = np.cumsum(sizes, axis=1) - sizes
    runs = {n: np.array(r, np.int64) for n, r in plan_packing(sizes.sum(axis=1), capacity).runs.items()}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length = b.length.to_numpy()
            rank = b["rank"].to_numpy() - 1 + before[length, b.bucket.to_numpy()]
            sequence, offset = np.empty(len(b), np.int64), np.empty(len(b), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                r = runs[int(n)]
                i = np.searchsorted(r[:, 0], rank[at], side="right") - 1
                into = rank[at] - r[i, 0]
                sequence[at] = r[i, 3] + into // r[i, 2]
                offset[at] = r[i, 4] + into % r[i, 2] * n
            yield b.drop(columns=["bucket", "rank"]).assign(sequence_id=sequence, offset=offset)

    kind = dict(docs.dtypes)["doc_id"]
    ranked = short.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")))
    placed = ranked.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(place, "doc_id string, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumn("doc_id", F.col("doc_id").cast(kind)).unionByName(full)
