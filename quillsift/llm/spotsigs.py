"""SpotSigs: document fingerprints from chains of content words behind common words.

Each anchor of a text and the CHAIN content words that follow it (or as many as there are) form one
signature. Anchors are the common words and the beginning of the text: one rule for texts of every length and
language, so a text and its edit are never measured by different rules. A text without a common word has the
signature of its beginning alone. A text's signatures are a set; its fingerprint holds the set's size and
the whole set, 64 bits for each signature, so the likeness of two fingerprints is the Jaccard of the sets.
A text without a word has one signature, the text itself (null counts as empty). So texts with equal
signature sets, and no others but by a collision of 64-bit hashes, have equal fingerprints.

``near_duplicates`` joins all fingerprints' sets as SpotSigs does: sets are partitioned by length, so that a
set meets only those of its own partition and the next one, and a pair is dropped as soon as too few
signatures are left for a Jaccard of 0.75; it runs on the n-gram join's trees. The fixed comparisons of a
document with its edit and with the next document want their likeness whatever it is: none can be left out.

The next document: ascending doc_id, after the last the first; null ids come first, rows with one id
in the order of their texts' hashes. Documents are dealt to ranges of doc_id, a range that one id fills to
ranges of the hash, and each range also gets the first document of the range behind it. So one shuffle
brings all neighbours together and a task holds two texts at a time. One document alone is its own next
one. Ids may be numbers or strings. Texts of any length are read whole. An empty table gives an empty
result; only doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.llm import jaccard as jaccard_join
from quillsift.llm import textcore
from quillsift.llm.runtime import partitions, steady

CHAIN = 2
#: Most ranges of doc_id that documents are dealt to. A range of one id alone is cut into ranges of about the mean size.
MOST_RANGES = 16_384
#: Where ids are no numbers, a sample of so many a range finds the ranges' bounds.
SAMPLE_IDS = 20
#: Common words of English, German, French and Spanish: fixed values.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "als auf das dem den der des die ein eine im ist mit nicht sich sie und von zu für "
    "avec dans de des du elle en est et il la le les on par pas pour que qui sur un une au "
    "con del el es los las no para por que se su un una y"
).split()
#: ASCII punctuation ends words here, and A-Z is lower-cased.
PLAIN = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() or c >= 128 else 32 for c in range(256))
BEGINNING = np.array([0x5EED], np.uint64)
ANCHOR_HASHES = np.unique(np.array([textcore.word_hashes(w.encode())[0] for w in dict.fromkeys(ANCHORS)], np.uint64))


def chains(anchors: np.ndarray, content: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Hashes of the anchors with CHAIN content words from the starts on, or as many as there are."""
    sig = anchors * textcore.WORD_BASE
    padded = np.append(content, np.uint64(0))
    for k in range(CHAIN):
        sig = (textcore.mix(sig) + padded[np.minimum(starts + k, len(content))]) * textcore.WORD_BASE
    return textcore.mix(sig)


def signatures(text: str) -> np.ndarray:
    """The sorted set of 64-bit spot signatures; never empty."""
    data = textcore.raw(text)
    h = textcore.word_hashes(data.translate(PLAIN))
    if not len(h):
        return np.frombuffer(hashlib.blake2b(data, digest_size=8).digest(), "<u8")
    at = np.minimum(np.searchsorted(ANCHOR_HASHES, h), len(ANCHOR_HASHES) - 1)
    common = ANCHOR_HASHES[at] == h
    anchors = np.flatnonzero(common)
    starts = anchors - np.arange(len(anchors))  # content words before each anchor: where its chain starts
    content = h[~common]
    return np.unique(chains(np.append(BEGINNING, h[anchors]), content, np.append(0, starts)))


def written(sigs: np.ndarray) -> str:
    return f"{len(sigs):x}:" + base64.b64encode(sigs.astype(">u8").tobytes()).decode()


def fingerprint(text: str) -> str:
    return written(signatures(text))


def read(fp: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fp.partition(":")[2]), ">u8").astype(np.uint64)


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Of two sorted signature sets. 0 without a comparison if their sizes alone keep it under ``least``."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def likeness(a: str, b: str, least: float = 0.0) -> float:
    """Jaccard of two fingerprints' sets."""
    return 1.0 if a == b else jaccard(read(a), read(b), least)


def edited(text: str, following: str) -> str:
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_signatures, component_id: groups of documents linked by likenesses of 0.75 or more. A
    document without a word is like its copies alone."""
    found = jaccard_join.near_duplicates(docs, lambda text: signatures(text or ""))
    return found.select("doc_id", F.col("n_shingles").alias("n_signatures"), "component_id")


def index_among(cuts: list, value: F.Column) -> F.Column:
    """How many of the sorted cuts are at most the value: found in two steps over about the square root
    of their number each."""
    if not cuts:
        return F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    parts = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    upto = lambda c: F.size(F.filter(c, lambda x: x <= value))
    part = upto(F.array(*[F.lit(p[0]) for p in parts]))
    inside = F.element_at(F.array(*[F.array(*map(F.lit, p)) for p in parts]), F.greatest(part, F.lit(1)))
    return F.when(part == 0, 0).otherwise((part - 1) * width + upto(inside))


def partition_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of n partitions a number that hash partitioning sends there, so that each range gets a
    partition of its own."""
    ids = spark.range(24 * n).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p"))
    found = {r.p: r.id for r in ids.groupBy("p").agg(F.min("id").alias("id")).collect()}
    return [found.get(i, i) for i in range(n)]


def bounds_of(docs: DataFrame, ranges: int) -> list:
    """Values of doc_id that cut the documents into about so many ranges of equal size. What they are
    decides on the balance of tasks alone."""
    kind = dict(docs.dtypes)["doc_id"]
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return docs.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)] or [0.5], max(10_000, 20 * ranges))).first()[0] or []
    n = docs.count()
    share = int(min(1.0, SAMPLE_IDS * ranges / max(1, n)) * (1 << 30)) + 1
    found = sorted(r[0] for r in docs.select("doc_id").where(F.col("doc_id").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)).limit(4 * SAMPLE_IDS * ranges).collect())
    return found[:: max(1, len(found) // ranges)][1:]


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, text, home, halo: the documents by ranges of doc_id, each range with the first document
    of the next one (halo)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    kind = dict(docs.dtypes)["doc_id"]
    ranges = min(ranges or 2 * partitions(spark), MOST_RANGES)
    bounds = bounds_of(docs, ranges)
    several = [x for x, n in Counter(bounds).items() if n > 1]  # ids that fill a range: ranges of their own
    among = 2 * index_among(sorted(set(bounds)), F.col("doc_id")) + F.when(F.col("doc_id").isin(several), 1).otherwise(2)
    docs = docs.withColumn("range", F.when(F.col("doc_id").isNull(), 0).otherwise(among))
    # a row for each range, at most 2 * MOST_RANGES + 1, and of one id's ranges no more than these again
    sizes = docs.groupBy("range").agg(F.count("*").alias("n"), F.min("doc_id").eqNullSafe(F.max("doc_id")).alias("one")).collect()
    mean = max(1, sum(r.n for r in sizes) // ranges)
    cuts = {r.range: -(-r.n // mean) for r in sizes if r.one and r.n > 2 * mean}
    cut = spark.createDataFrame(list(cuts.items()), "range int, cut int")
    # the hash's upper bits, as a number from 0 up in the order of the hashes, say which part of the range
    place = F.shiftright(F.shiftright("text_hash", 32) + F.lit(1 << 31), 1) * F.coalesce("cut", F.lit(1)) / F.lit(1 << 31)
    docs = docs.join(F.broadcast(cut), "range", "left").withColumn("part", F.floor(place).cast("int")).drop("cut")
    first = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "text_hash")
    firsts = sorted(docs.groupBy("range", "part").agg(F.min(first).alias("f")).collect(), key=lambda r: (r.range, r.part))
    keys = partition_keys(spark, max(1, len(firsts)))
    rows = [(r.range, r.part, i, (i - 1) % len(firsts), r.f.doc_id, r.f.text_hash) for i, r in enumerate(firsts)]
    table = spark.createDataFrame(rows, f"range int, part int, home int, before int, first_id {kind}, first_hash long")
    at = docs.join(F.broadcast(table), ["range", "part"])
    own = F.struct("home", F.lit(False).alias("halo"))
    both = F.array(own, F.struct(F.col("before").alias("home"), F.lit(True).alias("halo")))
    spread = F.when(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash")), both).otherwise(F.array(own))
    dealt = at.select("doc_id", "text", "text_hash", F.explode(spread).alias("at")).select("doc_id", "text", "text_hash", "at.home", "at.halo")
    dealt = dealt.join(F.broadcast(spark.createDataFrame(list(enumerate(keys)), "home int, key long")), "home")
    return dealt.repartition(len(keys), "key").drop("key").sortWithinPartitions("home", "halo", F.asc_nulls_first("doc_id"), "text_hash")


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    n_signatures for each document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_signatures"]
        home = last = None
        for b in batches:
            rows = []
            for doc_id, text, h, halo in zip(b.doc_id, b.text, b.home, b.halo, strict=True):
                if h != home:
                    home, last = h, None
                if halo and last is None:  # its range is done
                    continue
                sigs = signatures(text)
                if last:
                    other = edited(last[1], text)
                    own, esigs = last[2], signatures(other)
                    rows.append((last[0], len(last[1]), hashlib.sha256(textcore.raw(other)).hexdigest(), written(own), written(esigs), jaccard(own, esigs), jaccard(own, sigs), len(own)))
                last = None if halo else (doc_id, text, sigs)
            yield pd.DataFrame(rows, columns=columns)

    steady(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    rows = with_next(docs, ranges).withColumn("doc_id", F.col("doc_id").cast("string"))
    schema = "doc_id string, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_signatures long"
    return rows.mapInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(kind))
