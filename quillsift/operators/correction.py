"""Query correction by edit distance to the vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillsift.operators.index import Index
from quillsift.operators.rank import Queries, analyzed, query_terms, vsm

#: Most edits that a correction may need; the letters at the beginning of a word whose deletions are indexed.
MOST_EDITS, PREFIX = 2, 7


def deletions(word: Column) -> Column:
    """Hashes of what is left of a word's first PREFIX letters when up to MOST_EDITS are taken away, each
    once: at most 29. Words within so many edits of each other have one in common. For of an alignment of
    the two with that many edits, the letters of both prefixes that are matched to each other stay; from either
    prefix at most as many are taken away as there are edits, since each inserted letter of one word pushes one
    matched letter of the other out of its prefix."""
    start = F.substring(word, 1, PREFIX)
    without = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.left(s, i - 1), F.substr(s, i + 1)))
    fewer = lambda all_: F.flatten(F.transform(F.filter(all_, lambda s: F.length(s) > 0), without))
    level, out = F.array(start), F.array(start)
    for _ in range(MOST_EDITS):
        level = F.array_distinct(fewer(level))
        out = F.concat(out, level)
    return F.transform(F.array_distinct(out), lambda s: F.xxhash64(s))


def near_words(index: Index) -> DataFrame:
    """key, known: each term under the hashes of its deletions, in buckets of the key. Made of the vocabulary when
    it is needed first, stored with the index."""
    made = lambda: index.terms.select(F.explode(deletions(F.col("term"))).alias("key"), F.col("term").alias("known"))
    return index.derived("deletions", made, "key", "key", "known")


def suggestions(index: Index, queries: Queries, most: int = MOST_EDITS) -> DataFrame:
    """term, suggestion, distance for the unknown terms that a known one is near to: the nearest, of
    equally near ones the smallest. An unknown term meets those known ones alone that share a deletion."""
    if most > MOST_EDITS:
        raise ValueError(f"corrections are indexed for up to {MOST_EDITS} edits")
    q = analyzed(queries)
    oov = q.words.select("term").distinct().join(q.of_terms(index.terms), "term", "left_anti").select("term")
    keys = oov.select("term", F.explode(deletions(F.col("term"))).alias("key"))
    met = near_words(index).join(keys, "key").where(F.abs(F.length("term") - F.length("known")) <= most).select("term", "known").distinct()
    near = met.withColumn("distance", F.levenshtein("term", "known", most)).where("distance >= 0")
    best = near.groupBy("term").agg(F.min(F.struct("distance", "known")).alias("best"))
    return best.select("term", F.col("best.known").alias("suggestion"), F.col("best.distance").alias("distance"))


def corrected(index: Index, queries: Queries) -> DataFrame:
    """qid, text: the queries' stems with corrections in place, in order."""
    a = analyzed(queries)
    q = query_terms(a).join(suggestions(index, a), "term", "left")
    word = F.coalesce("suggestion", "term")
    per = q.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("off", word.alias("word")))).alias("words"))
    return per.select("qid", F.array_join(F.col("words.word"), " ").alias("text"))


def typo_tolerant(index: Index, queries: Queries, k: int = 10) -> DataFrame:
    """VSM over the corrected queries. The corrected stems are analyzed like any text, so they are
    stopped and stemmed a second time."""
    return vsm(index, corrected(index, queries), k)


