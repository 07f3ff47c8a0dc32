"""Audit of how sources of one language diverge in their words, by deduplicated count columns.

Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. Of each language the terms in LEAST_DOCS
of its documents or more are kept. A term's column is the sparse vector of its counts by source; terms with
identical columns are made one, with their multiplicity. A group (language and source) gives a term with count c
the integer probability p = 1 + floor(SCALE * (c + 1) / (N + V)), where N counts the group's kept terms and V
the language's different ones; the language itself has such a p from its whole counts. The divergence of p
from q is floor((p - q)^2 / q). All arithmetic is on integers.

Part ``pair``: for each two sources of a language, the divergence of the one from the other, summed over all
kept terms. Each pair of sources is evaluated once for each distinct column that holds both, times the column's
multiplicity. With f(p, q) the divergence and 0 the p of a count of zero, the sum is

    sum over columns with both of f(p, q) - f(p, 0) - f(0, q) + f(0, 0)  +  sum over counts of the one of
    f(p, 0) - f(0, 0)  +  sum over counts of the other of f(0, q) - f(0, 0)  +  V * f(0, 0)

so a column costs the square of the sources that it holds, not of all sources, and what a source has alone is
evaluated once for each distinct count.

Part ``term``: the kept terms that a group has more often than its language, by their divergence from the
language, down to rank TERM_RANKS. Columns are ranked first; of a column only its TERM_RANKS smallest terms
can be among them.

Words are counted in the tasks that read the documents, so a common word has a row for each source in what a task holds
at a time; these are dealt once, by language and term, so no hot source gathers rows. Every occurring group is there, even without
terms, and a language without kept terms has pairs with value 0. Null language, source and text count as
''. Repeated rows count again; texts of any length are read whole, in slices. One source alone has no pairs.
An empty table gives an empty result. Only text, lang and source are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm import textcore
from quillsift.llm.runtime import dropped, steady, stored

LEAST_DOCS, SCALE, TERM_RANKS = 3, 1_000_000_000, 200
#: Bytes of terms, a space for all others. So many counts are held before they are handed on.
PLAIN = bytes(b if b >= 0x80 or chr(b).islower() else b + 32 if chr(b).isupper() else 32 for b in range(256))
HELD, SLICE = 400_000, 4 << 20
WHOLE = "decimal(38,0)"


def slices_of(text: bytes) -> Iterator[list[bytes]]:
    """All terms of a text, one slice's at a time."""
    plain, at = text.translate(PLAIN), 0
    while at < len(plain):
        end = plain.find(b" ", at + SLICE)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def terms_of(text: str | None) -> Counter:
    """How often each term (as bytes) is in a text."""
    return Counter(chain.from_iterable(slices_of(textcore.raw(text))))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, df: occurrences of each term in some of a group's documents, and how many of these hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def told() -> pa.RecordBatch:
            counts, sizes = list(held.values()), [len(tf) for tf, _ in held.values()]
            rows = sum(sizes)
            of_groups = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            names = [pa.DictionaryArray.from_arrays(of_groups, pa.array(c, pa.string())).cast(pa.string()) for c in zip(*held, strict=True)]
            terms = pa.array(list(chain.from_iterable(tf for tf, _ in counts)), pa.binary()).cast(pa.string())
            n = np.fromiter(chain.from_iterable(tf.values() for tf, _ in counts), np.int64, rows)
            df = np.fromiter(chain.from_iterable(map(df.__getitem__, tf) for tf, df in counts), np.int64, rows)
            held.clear()
            return pa.RecordBatch.from_arrays([*names, terms, pa.array(n), pa.array(df)], ["lang", "source", "term", "n", "df"])

        for b in batches:
            for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"].cast(pa.binary()).to_pylist(), strict=True):
                tf, df = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for terms in slices_of(text):  # of lists and sets, counts are made without a step of Python for each
                    tf.update(terms)
                    seen.update(terms)
                df.update(seen)
            if sum(len(tf) for tf, _ in held.values()) >= HELD:
                yield told()
        if held:
            yield told()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, df long")


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)); 1 where the language has no terms."""
    of = (total + terms).cast("decimal(20,0)")
    whole = F.call_function("div", F.lit(SCALE).cast("decimal(12,0)") * (count + 1).cast("decimal(20,0)"), F.when(of > 0, of).otherwise(F.lit(1).cast("decimal(20,0)")))
    return F.when(of > 0, whole.cast("long") + 1).otherwise(F.lit(1).cast("long"))


def diverges(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def columns_of(docs: DataFrame) -> DataFrame:
    """lang, term, column: the kept terms with their counts by source (array of source, n). The tasks that read the
    documents have counted already; one shuffle by language and term serves both sums."""
    dealt = term_counts(docs).repartition("lang", "term")
    of_groups = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    per = of_groups.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("column"))  # no more than a language has sources
    return per.where(F.col("df") >= LEAST_DOCS).drop("df")


def pair_values(groups: DataFrame, entries: DataFrame) -> DataFrame:
    """lang, source, item, value for all ordered pairs of a language's sources."""
    whole = lambda c: c.cast(WHOLE)
    one, other = groups.select("lang", "source", "terms", F.col("none").alias("p0")), groups.select("lang", F.col("source").alias("item"), F.col("none").alias("q0"))
    apart = F.col("source") != F.col("item")
    every = one.join(other, "lang").where(apart).select("lang", "source", "item", (whole(F.col("terms")) * diverges(F.col("p0"), F.col("q0"))).alias("value"))
    # by the distinct counts of a source
    counts = stored(entries.groupBy("lang", "source", "p", F.col("none").alias("p0")).agg(F.sum("times").alias("times")), "counts")
    alone = counts.join(other, "lang").where(apart)
    ahead = alone.select("lang", "source", "item", (whole(F.col("times")) * (diverges(F.col("p"), F.col("q0")) - diverges(F.col("p0"), F.col("q0")))).alias("value"))
    behind = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (whole(F.col("times")) * (diverges(F.col("q0"), F.col("p")) - diverges(F.col("q0"), F.col("p0")))).alias("value"))
    # by the distinct columns that hold both
    sides = entries.groupBy("id").agg(F.first("lang").alias("lang"), F.first("times").alias("times"), F.collect_list(F.struct("source", "p", "none")).alias("a"))
    both = sides.select("lang", "times", F.explode("a").alias("a"), F.col("a").alias("b")).select("lang", "times", "a", F.explode("b").alias("b")).where(F.col("a.source") != F.col("b.source"))
    p, q, p0, q0 = (F.col(c) for c in ("a.p", "b.p", "a.none", "b.none"))
    both = both.select("lang", F.col("a.source").alias("source"), F.col("b.source").alias("item"), (whole(F.col("times")) * (diverges(p, q) - diverges(p, q0) - diverges(p0, q) + diverges(p0, q0))).alias("value"))
    parts = every
    for x in (ahead, behind, both):
        parts = parts.unionByName(x.groupBy("lang", "source", "item").agg(F.sum("value").cast(WHOLE).alias("value")))
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))


def term_values(held: DataFrame, ids: DataFrame, entries: DataFrame) -> DataFrame:
    """lang, source, item, value, rank of the kept terms that groups have most above their language."""
    above = entries.where(F.col("p") > F.col("q")).select("id", "lang", "source", diverges(F.col("p"), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    best = above.withColumn("r", F.rank().over(by_value)).where(F.col("r") <= TERM_RANKS).drop("r")  # columns of equal value all stay
    least = Window.partitionBy("lang", "column").orderBy("term")
    leading = held.withColumn("r", F.row_number().over(least)).where(F.col("r") <= TERM_RANKS).join(ids.select("lang", "column", "id"), ["lang", "column"]).select("id", F.col("term").alias("item"))
    ranked = best.join(leading, "id").withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked.where(F.col("rank") <= TERM_RANKS).select("lang", "source", "item", "value", "rank")


def audit(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank."""
    steady(docs.sparkSession)
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    held = stored(columns_of(docs), "columns")
    ids = stored(held.groupBy("lang", "column").agg(F.count("*").alias("times")).withColumn("id", F.monotonically_increasing_id()), "distinct_columns")
    each = ids.select("id", "lang", "times", F.aggregate("column", F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("all"), F.explode("column").alias("at")).select("id", "lang", "times", "all", "at.source", "at.n")
    totals = stored(each.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("times")).alias("total")), "totals")
    langs = stored(ids.groupBy("lang").agg(F.sum("times").alias("terms")).join(totals.groupBy("lang").agg(F.sum("total").alias("all_total")), "lang"), "langs")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select("lang", "source", zero("total"), zero("terms"), zero("all_total"))
    groups = stored(groups.withColumn("none", probability(F.lit(0).cast("long"), F.col("total"), F.col("terms"))), "groups")
    # both sides are stored, so that the join may be split where a source is hot
    entries = each.join(groups, ["lang", "source"]).select(
        "id", "lang", "source", "times", "none", probability(F.col("n"), F.col("total"), F.col("terms")).alias("p"), probability(F.col("all"), F.col("all_total"), F.col("terms")).alias("q")
    )
    entries = stored(entries, "entries")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_values(groups, entries).withColumn("rank", F.row_number().over(by_value))
    parts = [t.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for name, t in (("pair", pairs), ("term", term_values(held, ids, entries)))]
    out = stored(parts[0].unionByName(parts[1]), "audit")
    dropped(held, ids, totals, langs, groups, entries)
    return out
