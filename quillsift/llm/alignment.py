"""Cross-tokenizer alignment over id-striped dense count matrices.

Each text, with a space before it, is encoded by two tokenizers: A, a byte-level BPE file of ``tokenizers``,
and B, a ``sentencepiece`` model (which adds the space itself). Strings of special tokens are plain text to
both. Tokens are ranges of bytes; where a token of A and one of B end together the two are linked and a group
of tokens ends. A text has no tokens if it is null or empty, or if the bytes of either side's tokens aren't
the space and the text.

1. Documents are encoded once. Some thousand documents form a block; its distinct (document, pair) rows are
   stored by stripe of their B id (id modulo STRIPES), a row for each block and stripe: the pairs, how
   often the block has each, and the documents and counts behind each pair.
2. Pairs are partitioned by stripe and salt; a task adds them with np.add.at into a dense matrix of the
   stripe's B ids by all A ids. The salts' matrices are added up by stripe; maxima of rows are the best.
3. Scoring: the links are partitioned by stripe and salt, the finished matrix of the stripe goes ahead of
   them to each salt, and each link reads its count and whether it is its row's greatest from the matrix.
   What a task finds is summed by document.

A task holds one matrix of vocabulary A times vocabulary B / STRIPES numbers, however many links there are.
The salts grow with the number of partitions, so a B id that a large share of links have spreads over tasks.

Encoding by chunks. Both tokenizers treat what lies between spaces apart: A's way of splitting always
cuts before a space behind a character that isn't white space, and no token of B holds its space mark
behind another character (both are verified of the files, else texts are encoded whole). So a text is
cut there, chunks are looked up in a bounded table, and those that aren't there are encoded together.

Null ids are kept; repeated rows are documents of their own. Texts of any length are read whole, in slices.
An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm import packing, textcore
from quillsift.llm.runtime import dropped, partitions, steady, stored

#: 128 stripes of a vocabulary of 32,000 by 50,257 ids are matrices of 100 MB each.
STRIPES = 128
#: A block is closed after so many rows of distinct (document, pair) or documents.
BLOCK_ROWS, BLOCK_DOCS = 1 << 20, 16_384
#: Chunks that are remembered before all are forgotten; so many are encoded at once. Texts of so many
#: characters together are looked up at a time, of a longer one so many chunks.
MEMO, AT_ONCE, SLICE, HELD = 300_000, 16_384, 2 << 20, 1 << 16
#: Cells of a matrix in a row of a table.
CELLS = 1 << 16
_pairs: dict[tuple[str, str], Pair] = {}


def default_tokenizers() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class ByteSide:
    """A: ids and their bytes."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = packing.byte_letters()
        size = self.slow.get_vocab_size()
        names = [self.slow.id_to_token(i) or "" for i in range(size)]
        self.bytes = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in names]
        ranks = packing.plain_ranks(spec)
        self.by_chunk = ranks is not None
        self.fast = ranks and tiktoken.Encoding("from_file", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or packing.long_run(text):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


class PieceSide:
    """B: ids and their bytes; the model adds the space before a text."""

    MARK = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(self.MARK, " ").encode() for i, p in enumerate(names)]
        inside = any(self.MARK in p.lstrip(self.MARK) for p in names)
        self.space = [self.model.piece_to_id(self.MARK)]
        self.by_chunk = not inside and self.model.encode("a  b ") == self.model.encode("a") + self.model.encode(" b") + self.space

    def __call__(self, text: str) -> list[int]:
        return self.model.encode(text) if text else self.space


@dataclass(frozen=True)
class Chunks:
    """Some parts of texts: tokens of A, of B and groups of each; these as text; linked pairs of all, and how many are
    each one's; whether the bytes differ."""

    parts: list[str]
    sizes: np.ndarray
    groups: list[str]
    links: np.ndarray
    count: np.ndarray
    odd: np.ndarray


class Known:
    """Chunks by number, in arrays that grow."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.groups: list[str] = []
        self.sizes, self.count, self.start, self.links, self.odd = np.zeros((0, 3), np.int64), NO_LINKS, NO_LINKS, NO_LINKS, np.zeros(0, bool)

    def add(self, found: list[Chunks]) -> None:
        for x in found:
            self.number.update(zip(x.parts, range(len(self.number), len(self.number) + len(x.parts)), strict=True))
            self.groups += x.groups
        self.sizes, self.links, self.count, self.odd = (np.concatenate([getattr(self, c), *[getattr(x, c) for x in found]]) for c in ("sizes", "links", "count", "odd"))
        self.start = np.cumsum(self.count) - self.count

    def of(self, parts: Sequence[str]) -> tuple[np.ndarray, str, tuple[np.ndarray, np.ndarray]] | None:
        """Tokens and groups, the groups as text, the distinct pairs with how often each is; None if bytes differ."""
        at = np.array([self.number[p] for p in parts])
        if self.odd[at].any():
            return None
        count = self.count[at]
        stop = np.cumsum(count)
        links = self.links[np.arange(stop[-1]) + np.repeat(self.start[at] - stop + count, count)]
        return self.sizes[at].sum(axis=0), ";".join([self.groups[i] for i in at.tolist()]), np.unique(links, return_counts=True)


NO_LINKS = np.zeros(0, np.int64)
NOTHING = (0, 0, 0, "", NO_LINKS, NO_LINKS)


class Pair:
    """Both tokenizers, and the chunks encoded so far. A pair of ids is a number: B's * vocabulary of A + A's."""

    def __init__(self, a: str, b: str):
        self.a, self.b = ByteSide(a), PieceSide(b)
        if not all(self.a.bytes) or not all(self.b.bytes):
            raise ValueError("a token without bytes has no place to end at")
        self.lengths = tuple(np.array([len(x) for x in side.bytes]) for side in (self.a, self.b))
        self.by_chunk = self.a.by_chunk and self.b.by_chunk
        self.width = len(self.a.bytes)
        self.known = Known()

    def chunks(self, parts: list[str]) -> list[Chunks]:
        """Of many parts that end in no white space (or one that does), encoded as one text: where they meet, both
        sides cut."""
        text = " ".join(parts)
        a, b, data = self.a(f" {text}"), self.b(text), b" " + textcore.raw(text)
        if b"".join([self.a.bytes[i] for i in a]) != data or b"".join([self.b.bytes[i] for i in b]) != data:
            if len(parts) == 1:
                return [Chunks(parts, np.zeros((1, 3), np.int64), [""], NO_LINKS, np.zeros(1, np.int64), np.ones(1, bool))]
            half = len(parts) // 2  # find those whose bytes differ
            return self.chunks(parts[:half]) + self.chunks(parts[half:])
        ids_a, ids_b = np.array(a), np.array(b)
        ends_a, ends_b = np.cumsum(self.lengths[0][ids_a]), np.cumsum(self.lengths[1][ids_b])
        at = np.minimum(np.searchsorted(ends_b, ends_a), len(ends_b) - 1)
        at_a = np.flatnonzero(ends_b[at] == ends_a)
        at_b = at[at_a]
        both = ends_a[at_a]
        stops = np.cumsum([1 + len(x) for x in map(textcore.raw, parts)])
        last = np.searchsorted(both, stops)  # of each part's groups
        if not np.array_equal(both[np.minimum(last, len(both) - 1)], stops):
            raise AssertionError("a token goes over a space behind a word")
        # tokens in the order in which the groups say them, each with the sign behind it
        group_a, group_b = np.searchsorted(both, ends_a), np.searchsorted(both, ends_b)
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        signs = np.full(len(a) + len(b), ",")
        signs[at_a] = "|"
        signs[len(a) + at_b] = ";"
        signs[len(a) + at_b[last]] = "\n"
        said = [""] * (2 * len(order))
        said[::2], said[1::2] = map(str, np.concatenate([ids_a, ids_b])[order].tolist()), signs[order].tolist()
        links = ids_b[at_b].astype(np.int64) * self.width + ids_a[at_a]
        sizes = np.diff(np.stack([at_a[last] + 1, at_b[last] + 1, last + 1], axis=1), axis=0, prepend=0)
        return [Chunks(parts, sizes, "".join(said).split("\n")[:-1], links, sizes[:, 2], np.zeros(len(parts), bool))]

    def learn(self, parts: set[str]) -> Known:
        """Knows these parts from now on, as long as no others are learned."""
        if len(self.known.number) >= MEMO:
            self.known = Known()
        rest = [p for p in parts if p not in self.known.number]
        alone = {p for p in rest if not self.by_chunk or not p or p[-1].isspace()}
        found = [x for p in alone for x in self.chunks([p])]
        for some in batched([p for p in rest if p not in alone] if alone else rest, AT_ONCE):
            found += self.chunks(list(some))
        if found:
            self.known.add(found)
        return self.known

    def aligned(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """For each text the tokens of A and B, groups, the hash of the groups' text; the distinct pairs and how
        often each is linked. Some texts are looked up at a time; of a long one some parts."""
        held, size = [], 0
        for text in texts:
            if text and len(text) >= SLICE:
                yield from self.short(held)
                held, size = [], 0
                yield united(self.learn(set(parts)).of(parts) for parts in batched(parts_of(text) if self.by_chunk else [text], HELD))
                continue
            held.append(text or "")
            size += len(held[-1])
            if size >= SLICE:
                yield from self.short(held)
                held, size = [], 0
        yield from self.short(held)

    def short(self, texts: list[str]) -> Iterator[tuple]:
        parts = [([t] if not self.by_chunk else t.split(" ")) if t else [] for t in texts]
        if self.by_chunk and (odd := {p for p in set().union(*parts) if not p or p[-1].isspace()}):
            parts = [p if odd.isdisjoint(p) else list(parts_of(t)) for p, t in zip(parts, texts, strict=True)]
        known = self.learn(set().union(*parts))
        for p in parts:
            yield united([known.of(p)] if p else [])


def united(found: Iterable[tuple | None]) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
    """What the slices of a text come to."""
    sizes, said, links = np.zeros(3, np.int64), hashlib.sha256(), []
    for x in found:
        if x is None:
            return NOTHING
        sizes += x[0]
        said.update((";" * bool(links) + x[1]).encode())
        links.append(x[2])
    if not links:
        return NOTHING
    pairs, counts = links[0]
    if len(links) > 1:
        pairs, at = np.unique(np.concatenate([x for x, _ in links]), return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, at, np.concatenate([n for _, n in links]))
    return *sizes.tolist(), said.hexdigest(), pairs, counts


def pair_of(a: str, b: str) -> Pair:
    if (a, b) not in _pairs:
        _pairs[a, b] = Pair(a, b)
    return _pairs[a, b]


def parts_of(text: str) -> Iterator[str]:
    """A text in parts, each but the first behind a space: cut at the spaces behind a character that isn't
    white space."""
    at, held, last = 0, [], ""
    while at <= len(text):
        end = text.find(" ", at + SLICE)
        end = len(text) if end < 0 else end
        for part in text[at:end].split(" "):
            if last and not last[-1].isspace():
                yield held[0] if len(held) == 1 else " ".join(held)
                held = [part]
            else:
                held.append(part)
            last = part
        at = end + 1
    yield " ".join(held)


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 up, in as few bytes each as the largest takes, compressed."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return kind.char.encode() + zstandard.compress(x.astype(kind).tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob[1:]), blob[:1].decode()).astype(np.int64)


def packed_codes(codes: np.ndarray) -> bytes:
    """Rising numbers, as their steps."""
    return packed(np.diff(codes, prepend=0))


def unpacked_codes(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob))


ENCODED = "block long, idx int, doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, stripe int, codes binary, runs binary, docs binary, counts binary, sums binary"
DOCUMENT = ["idx", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
LINKS = ["stripe", "codes", "runs", "docs", "counts", "sums"]


def block_rows(block: int, documents: list[tuple], links: list[tuple[int, np.ndarray, np.ndarray]], width: int) -> pd.DataFrame:
    """The rows of a block: one for each document, one for each stripe. A code is a pair's place in the
    stripe's matrix; runs says of how many documents each code is, docs and counts which and how often."""
    out = pd.DataFrame(documents, columns=DOCUMENT)
    rows = []
    if links:
        pairs, count = np.concatenate([x for _, x, _ in links]), np.concatenate([n for _, _, n in links])
        doc = np.repeat([i for i, _, _ in links], [len(x) for _, x, _ in links])
        b = pairs // width
        code = b // STRIPES * width + pairs % width
        order = np.argsort((b % STRIPES << 40) + code, kind="stable")
        stripe, code, doc, count = (b % STRIPES)[order], code[order], doc[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (stripe[1:] != stripe[:-1])]))
        runs, sums = np.diff(np.append(first, len(code))), np.add.reduceat(count, first)
        of = stripe[first]
        for lo, hi in zip(at := np.flatnonzero(np.diff(of, prepend=-1)).tolist(), [*at[1:], len(of)], strict=True):
            p, q = int(first[lo]), int(first[hi]) if hi < len(of) else len(code)
            rows.append((int(of[lo]), packed_codes(code[first[lo:hi]]), packed(runs[lo:hi]), packed(doc[p:q]), packed(count[p:q]), packed(sums[lo:hi])))
    found = pd.concat([out, pd.DataFrame(rows, columns=LINKS)], ignore_index=True) if rows else out.reindex(columns=DOCUMENT + LINKS)
    # arrays with masks: floats would not hold the numbers
    whole = {c: found[c].astype("Int64") for c in ("idx", "n_a", "n_b", "n_groups", "n_links", "stripe")}
    return found.assign(block=block, **whole)[["block", *DOCUMENT, *LINKS]]


def encoded(docs: DataFrame, a: str, b: str) -> DataFrame:
    """The rows of all blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = pair_of(a, b)
        block, documents, links, n = None, [], [], 0
        for batch in batches:
            for row, doc_id, (n_a, n_b, n_groups, said, pairs, counts) in zip(batch["row"], batch.doc_id, pair.aligned(batch.text.tolist()), strict=True):
                block = row if block is None else block
                if len(pairs):
                    links.append((len(documents), pairs, counts))
                documents.append((len(documents), doc_id, n_a, n_b, n_groups, int(counts.sum()), said))
                n += len(pairs)
                if n >= BLOCK_ROWS or len(documents) >= BLOCK_DOCS:
                    yield block_rows(block, documents, links, pair.width)
                    block, documents, links, n = None, [], [], 0
        if documents:
            yield block_rows(block, documents, links, pair.width)

    # ids travel as text: pandas would make floats of a column with nulls
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(run, ENCODED)


class Matrix:
    """Counts of a stripe's B ids by all A ids."""

    def __init__(self, rows: int, width: int):
        self.rows, self.width = rows, width
        self.clear()

    def clear(self) -> None:
        self.cells, self.best = np.zeros(self.rows * self.width, np.int64), None

    def add(self, codes: np.ndarray, sums: np.ndarray) -> None:
        np.add.at(self.cells, codes, sums)

    def maxima(self) -> np.ndarray:
        if self.best is None:
            self.best = self.cells.reshape(self.rows, self.width).max(axis=1)
        return self.best

    def pieces(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        codes = np.flatnonzero(self.cells)
        for i in range(0, len(codes), CELLS):
            yield codes[i : i + CELLS], self.cells[codes[i : i + CELLS]]


def added(rows: DataFrame, shape: tuple[int, int], *keys: str) -> DataFrame:
    """stripe, codes, sums: the rows of equal keys added up in a matrix each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, now = Matrix(*shape), None

        def told() -> pd.DataFrame:
            return pd.DataFrame([(now[0], packed_codes(c), packed(n)) for c, n in matrix.pieces()], columns=["stripe", "codes", "sums"])

        for b in batches:
            for key, codes, sums in zip(zip(*(b[k].tolist() for k in keys), strict=True), b.codes, b.sums, strict=True):
                if now is not None and key != now:
                    yield told()
                    matrix.clear()
                now = key
                matrix.add(unpacked_codes(codes), unpacked(sums))
        if now is not None:
            yield told()

    n = partitions(rows.sparkSession)
    return rows.select(*keys, "codes", "sums").repartition(n, *keys).sortWithinPartitions(*keys).mapInPandas(run, "stripe int, codes binary, sums binary")


def scores(matrices: DataFrame, links: DataFrame, shape: tuple[int, int], salts: int) -> DataFrame:
    """block, idx, n_best, count_sum: what a stripe's matrix says of the documents' links. The matrix goes ahead
    of the links of each salt."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, now = Matrix(*shape), None
        for b in batches:
            out = []
            for stripe, salt, block, codes, runs, docs, counts, sums in zip(b.stripe, b.salt, b.block, b.codes, b.runs, b.docs, b.counts, b.sums, strict=True):
                if (stripe, salt) != now:
                    matrix.clear()
                    now = stripe, salt
                codes = unpacked_codes(codes)
                if runs is None:
                    matrix.add(codes, unpacked(sums))
                    continue
                count, runs = matrix.cells[codes], unpacked(runs)
                best = count == matrix.maxima()[codes // matrix.width]
                docs, times = unpacked(docs), unpacked(counts)
                found, at = np.unique(docs, return_inverse=True)
                n_best, count_sum = np.zeros((2, len(found)), np.int64)
                np.add.at(n_best, at, times * np.repeat(best, runs))
                np.add.at(count_sum, at, times * np.repeat(count, runs))
                out.append(pd.DataFrame({"block": block, "idx": found, "n_best": n_best, "count_sum": count_sum}))
            if out:
                yield pd.concat(out)

    none = F.lit(None).cast("binary")
    ahead = matrices.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).select("stripe", "salt", F.lit(0).cast("long").alias("block"), "codes", none.alias("runs"), none.alias("docs"), none.alias("counts"), "sums")
    behind = links.select("stripe", "salt", "block", "codes", "runs", "docs", "counts", none.alias("sums"))
    rows = ahead.unionByName(behind).repartition(partitions(links.sparkSession), "stripe", "salt").sortWithinPartitions("stripe", "salt", F.col("runs").isNotNull())
    found = rows.mapInPandas(run, "block long, idx int, n_best long, count_sum long")
    return found.groupBy("block", "idx").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def shape_of(a: str, b: str) -> tuple[int, int]:
    """Rows and columns of a stripe's matrix."""
    import sentencepiece
    from tokenizers import Tokenizer

    return -(-sentencepiece.SentencePieceProcessor(model_file=b).get_piece_size() // STRIPES), Tokenizer.from_file(a).get_vocab_size()


def salted(blocks: DataFrame) -> tuple[DataFrame, int]:
    """The rows of links with a salt by block, and the number of salts."""
    salts = max(1, -(-4 * partitions(blocks.sparkSession) // STRIPES))
    return blocks.where("stripe is not null").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int")), salts


def count_matrices(links: DataFrame, shape: tuple[int, int]) -> DataFrame:
    """stripe, codes, sums: how often each pair is linked, stored."""
    return stored(added(added(links, shape, "stripe", "salt"), shape, "stripe"), "matrices")


def alignment(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each document."""
    a, b = tokenizer_a or default_tokenizers()[0], tokenizer_b or default_tokenizers()[1]
    steady(docs.sparkSession)
    blocks, shape = stored(encoded(docs.select("doc_id", "text"), a, b), "blocks"), shape_of(a, b)
    links, salts = salted(blocks)
    matrices = count_matrices(links, shape)
    found = stored(scores(matrices, links, shape, salts), "scores")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    per = blocks.where("stripe is null").select("block", *DOCUMENT).join(found, ["block", "idx"], "left")
    out = per.select(F.col("doc_id").cast(dict(docs.dtypes)["doc_id"]).alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
    out = stored(out, "alignment")
    dropped(blocks, matrices, found)
    return out


def best_matches(docs: DataFrame, tokenizer_a: str | None = None, tokenizer_b: str | None = None) -> DataFrame:
    """b, a, n: for each id of B that is linked the ids of A that it is linked with most often."""
    a, b = tokenizer_a or default_tokenizers()[0], tokenizer_b or default_tokenizers()[1]
    steady(docs.sparkSession)
    blocks, shape = stored(encoded(docs.select("doc_id", "text"), a, b), "blocks"), shape_of(a, b)
    matrices = count_matrices(salted(blocks)[0], shape)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, now = Matrix(*shape), None

        def told() -> pd.DataFrame:
            rows = matrix.cells.reshape(shape)
            i, j = np.nonzero((rows == matrix.maxima()[:, None]) & (rows > 0))
            return pd.DataFrame({"b": i * STRIPES + now, "a": j, "n": rows[i, j]})

        for batch in batches:
            for stripe, codes, sums in zip(batch.stripe, batch.codes, batch.sums, strict=True):
                if now is not None and stripe != now:
                    yield told()
                    matrix.clear()
                now = stripe
                matrix.add(unpacked_codes(codes), unpacked(sums))
        if now is not None:
            yield told()

    dealt = matrices.repartition(partitions(docs.sparkSession), "stripe").sortWithinPartitions("stripe")
    out = stored(dealt.mapInPandas(run, "b int, a int, n long"), "matches")
    dropped(blocks, matrices)
    return out
