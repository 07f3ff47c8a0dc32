"""Phrases and proximity over the positional index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillsift.operators.index import Index
from quillsift.operators.rank import PAYS, Analyzed, Queries, Reading, analyzed, chosen_parts, matched, read_parts
from quillsift.plans.storage import stored


#: A rarest term of up to so many documents is broadcast to the others' postings.
MOST_BROADCAST = 500_000


def conjunction(index: Index, queries: Queries, *columns: str, pays: int = PAYS) -> DataFrame:
    """qid, docid, held: documents that hold every term of a query, with columns of their postings (an array of
    term and these). None if a term is unknown. The rarest term's postings come first; of the others' only
    those of its documents go on, and no posting is read twice. Where the others have many postings, only
    their parts in the length classes of the rarest term's documents are read."""
    a = analyzed(queries)
    terms = a.words.select("qid", "term").distinct().join(a.of_terms(index.terms), "term", "left")
    by = Window.partitionBy("qid")
    terms = terms.withColumn("r", F.row_number().over(by.orderBy("df", "term"))).withColumn("wanted", F.count("*").over(by)).withColumn("least", F.min(F.coalesce("df", F.lit(0))).over(by))
    terms = stored(terms.where("least > 0"), "conjunctions")  # a row for each term of a query
    most = terms.where("r = 1").agg(F.sum("df")).first()[0] or 0
    rarest = matched(index, terms.where("r = 1").select("qid", "term", "wanted"), a, "docid", *columns)
    entry = F.struct("term", *columns)
    docs = rarest.select("qid", "docid", "wanted", entry.alias("first"))
    few = F.broadcast(docs) if most <= MOST_BROADCAST else docs
    rest = terms.where("r > 1").select("qid", "term")
    if a.known is not None and sum(p.n for p in index.places(a.known) if p.part) >= pays:
        reading = classes_read(index, a, index.with_docs(rarest.select("qid", "docid"), "dl"), rest)
        others = read_parts(index, reading, dict(rest.dtypes)["qid"], "docid", *columns)
    else:
        others = matched(index, rest, a, "docid", *columns)
    others = others.select("qid", "docid", entry.alias("other"))
    joined = others.join(few, ["qid", "docid"]).groupBy("qid", "docid").agg(F.count("*").alias("k"), F.first("wanted").alias("wanted"), F.first("first").alias("first"), F.collect_list("other").alias("others"))
    several = joined.where("k = wanted - 1").select("qid", "docid", F.concat(F.array("first"), "others").alias("held"))
    return several.unionByName(docs.where("wanted = 1").select("qid", "docid", F.array("first").alias("held")))


def classes_read(index: Index, a: Analyzed, rarest: DataFrame, rest: DataFrame) -> Reading:
    """The parts of the other terms in the length classes in which a query's rarest term is."""
    classes = {(r.qid, r.c) for r in rarest.select("qid", index.length_class(F.col("dl")).alias("c")).distinct().collect()}  # a row for each query and class
    weights = [(r.qid, r.term, 1.0) for r in rest.collect()]
    return chosen_parts(weights, index.places(a.known), lambda qid, c: (qid, c) in classes)


def candidate_docs(index: Index, queries: Queries) -> DataFrame:
    """qid, docid: documents that hold every term of a query; none if a term is unknown."""
    return conjunction(index, queries).select("qid", "docid")


def phrase_hits(index: Index, queries: Queries) -> DataFrame:
    """qid, docid, start: places where the terms of a query stand in order without a gap. Each occurrence
    votes for the place where the phrase would start; a place with as many votes as the phrase has
    terms is a hit. No pairs of positions are made."""
    a = analyzed(queries)
    wanted = a.words.groupBy("qid").agg(F.count("*").alias("wanted"))
    held = conjunction(index, a, "positions").select("qid", "docid", F.explode("held").alias("at")).select("qid", "docid", "at.term", "at.positions")
    votes = held.select("qid", "docid", "term", F.explode("positions").alias("pos")).join(a.words, ["qid", "term"])
    found = votes.groupBy("qid", "docid", (F.col("pos") - F.col("off")).alias("start")).agg(F.count("*").alias("votes"))
    return found.join(wanted, "qid").where("votes = wanted").select("qid", "docid", "start")


def first_terms(pairs: DataFrame) -> tuple[DataFrame, Analyzed, Analyzed]:
    """qid, k, a, b from rows qid, term_a, term_b, k: the first term of each argument; both sides analyzed."""
    out, sides = pairs.select("qid", "k"), []
    for side in ("a", "b"):
        sides.append(analyzed(pairs.select("qid", F.col(f"term_{side}").alias("text"))))
        out = out.join(sides[-1].words.where("off = 0").select("qid", F.col("term").alias(side)), "qid")
    return out, *sides


def proximity_hits(index: Index, pairs: DataFrame, ordered: bool = True) -> DataFrame:
    """qid, docid, pa, pb: positions of the two terms at most k apart, b behind a if ordered. Positions
    are put in bins k wide, so partners are in the same bin or the next: an equi-join on document and
    bin, with the distance as a condition on its rows, never all pairs of a document."""
    q, one, other = first_terms(pairs)
    q = q.where("k > 0")
    width = F.floor(F.col("pos") / F.col("k"))
    places = lambda x, side: matched(index, q.select("qid", "k", F.col(side).alias("term")), x, "docid", "positions").select("qid", "k", "docid", F.explode("positions").alias("pos"))
    a = places(one, "a").select("qid", "k", "docid", F.col("pos").alias("pa"), width.alias("bin"))
    bins = F.array(width - 1, width) if ordered else F.array(width - 1, width, width + 1)
    b = places(other, "b").select("qid", "docid", F.col("pos").alias("pb"), F.explode(bins).alias("bin"))
    gap = F.col("pb") - F.col("pa")
    near = (gap > 0) & (gap <= F.col("k")) if ordered else (gap != 0) & (F.abs(gap) <= F.col("k"))
    return a.join(b, ["qid", "docid", "bin"]).where(near).select("qid", "docid", "pa", "pb")


def by_hits(hits: DataFrame, k: int, *columns: str) -> DataFrame:
    """qid, docid, rank, n_hits, match_positions: the documents with the most hits. Hits are counted first;
    places are gathered of the best documents alone."""
    per = hits.groupBy("qid", "docid").agg(F.count("*").alias("n_hits"))
    order = Window.partitionBy("qid").orderBy(F.desc("n_hits"), "docid")
    best = per.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    match = F.sort_array(F.collect_list(columns[0] if len(columns) == 1 else F.struct(*columns)))
    return hits.join(best, ["qid", "docid"]).groupBy("qid", "docid", "rank", "n_hits").agg(match.alias("match_positions"))
