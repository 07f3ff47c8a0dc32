"""Best-window snippets with the query's terms marked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions.text import full_text, word_spans
from quillsift.operators.index import Index
from quillsift.operators.rank import Queries, analyzed, matched
from quillsift.plans.storage import gathered

WINDOW, MARGIN, NO_WORDS = 16, 3, 140
#: Results up to so many are known to the driver: their documents become conditions of the scans.
MOST_RESULTS = 10_000
#: What is made of a marked word: marks before and behind it, or a column function.
Mark = tuple[str, str] | Callable[[Column], Column]


def best_windows(hits: DataFrame, window: int) -> DataFrame:
    """qid, docid, at: the first place from which a window holds the most hits (qid, docid, i). The first such
    window either begins the text or ends with a hit, else one further back would hold as many."""
    behind = Window.partitionBy("qid", "docid").orderBy("i").rangeBetween(1 - window, Window.currentRow)
    counted = hits.withColumn("hits", F.count("*").over(behind)).withColumn("at", F.greatest(F.col("i") - (window - 1), F.lit(0)))
    return counted.groupBy("qid", "docid").agg(F.min(F.struct((-F.col("hits")).alias("h"), "at")).alias("w")).select("qid", "docid", F.col("w.at").alias("at"))


def snippets(index: Index, results: DataFrame, queries: Queries, window: int = WINDOW, mark: Mark = ("**", "**")) -> DataFrame:
    """qid, docid, snippet for results qid, docid: the first window of so many words that holds the most
    occurrences of query terms, a few characters more on both sides, and an ellipsis where text is cut
    off. Occurrences come from the postings, so nothing is stemmed; of the texts the results' alone are read, and
    of these the words' places in the text."""
    keys = ["qid", "docid"]
    results, known = gathered(results.select(*keys).distinct(), MOST_RESULTS)
    ids = None if known is None else sorted({r.docid for r in known})
    of_results = (lambda t: t) if ids is None else lambda t: t.where(F.col("docid").isin(ids))
    texts = of_results(index.docs).select("docid", full_text().alias("full")).join(results.select("docid").distinct(), "docid", "left_semi")
    a = analyzed(queries)
    hits = of_results(matched(index, a.words.select("qid", "term").distinct(), a, "docid", "positions")).join(results, keys, "left_semi")
    hits = hits.select(*keys, F.explode("positions").alias("i"))
    framed = results.join(best_windows(hits, window), keys, "left").withColumn("at", F.coalesce("at", F.lit(0)))
    words = word_spans(texts, F.col("full"), "docid").join(framed, "docid").where((F.col("i") >= F.col("at")) & (F.col("i") < F.col("at") + window))
    words = words.join(hits.withColumn("hit", F.lit(True)), [*keys, "i"], "left")
    inside = words.groupBy(*keys).agg(F.min("start").alias("first"), F.max("end").alias("last"), F.sort_array(F.collect_list(F.when(F.col("hit"), F.struct("start", "end")))).alias("marks"))
    full_len = F.length("full")
    joined = (
        results.join(texts, "docid").join(inside, keys, "left")
        .withColumn("low", F.greatest(F.col("first") - MARGIN, F.lit(0)))
        .withColumn("high", F.least(F.col("last") + MARGIN, full_len))
    )
    marked = mark if callable(mark) else lambda word: F.concat(F.lit(mark[0]), word, F.lit(mark[1]))
    marks = F.coalesce("marks", F.array().cast("array<struct<start:int,end:int>>"))
    start = F.struct(F.col("low").alias("at"), F.lit("").alias("said"))
    piece = lambda a, b: F.substring(F.col("full"), a + 1, b - a)
    told = F.aggregate(
        marks, start, lambda acc, m: F.struct(m["end"].alias("at"), F.concat(acc["said"], piece(acc["at"], m["start"]), marked(piece(m["start"], m["end"]))).alias("said"))
    )
    joined = joined.withColumn("told", told)
    body = F.concat(F.col("told.said"), piece(F.col("told.at"), F.col("high")))
    cut = F.concat(F.when(F.col("low") > 0, "…").otherwise(""), body, F.when(F.col("high") < full_len, "…").otherwise(""))
    return joined.select(*keys, F.when(F.col("first").isNull(), F.substring("full", 1, NO_WORDS)).otherwise(cut).alias("snippet"))
