"""Ranked retrieval. Every ranker takes a table of queries (qid, text) and returns qid, docid, score,
rank for the best documents of each query, so one job ranks a whole batch.

Scores are sums over the postings of a query's terms. They are ranked by value rounded to 10 places,
then docid: the order of a distributed sum doesn't decide between equal documents.

Queries of few words are known to the driver, and so are the parts of postings of their terms: scans open these
alone. Where that would still be many postings, a first pass over the rare terms (and the length class that
promises most) gives each query a score that its best documents reach; classes of common terms' postings
that can't lift a document to it are left out. Larger batches are shuffled to the postings' buckets.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions import weighting
from quillsift.functions.text import analyze
from quillsift.operators.index import COMMON, OF_DOCS, ROUND_ROWS, Index, class_of_part, rounds_of, shares, union
from quillsift.plans.storage import broadcast, stored

#: Up to so many analyzed words of queries are known to the driver: their terms become conditions of the scans.
MOST_KNOWN = 2000
#: Up to so many parts are named in a condition; from so many postings on, bounds are looked at before they are read.
MOST_SLOTS, PAYS = 10_000, 4_000_000
#: Tables of counts of near pairs, and of the terms that are counted.
BIGRAMS, BIGRAM_TERMS = "bigrams", "bigram_terms"
BOOST, BOOST_POOL = 1.5, 200
SDM_WEIGHTS, SDM_POOL, ORDERED_WINDOW, UNORDERED_WINDOW = (0.8, 0.15, 0.05), 50, 2, 4


@dataclass(frozen=True)
class Analyzed:
    """Queries that are analyzed: texts(qid, text), words(qid, off, term), and their distinct terms where
    they are few. Rankers that call others hand them on, so that a plan analyzes its queries once."""

    texts: DataFrame
    words: DataFrame
    known: tuple[str, ...] | None = field(default=None)

    def of_terms(self, rows: DataFrame, column: str = "term") -> DataFrame:
        """The rows of the queries' terms, as far as a condition can tell: files are sorted by term, so
        a scan reads the row groups of these terms alone. A batch of many queries reads the whole table."""
        return rows if self.known is None else rows.where(F.col(column).isin(*self.known))


Queries = DataFrame | Analyzed
#: A ranker: index, queries, number of documents for each query -> qid, docid, score, rank.
Ranker = Callable[[Index, Queries, int], DataFrame]


def analyzed(queries: Queries) -> Analyzed:
    """Analyzes a table of queries (qid, text). Few words come to the driver and back as a local table; else
    they are stored."""
    if isinstance(queries, Analyzed):
        return queries
    words = analyze(queries, F.coalesce("text", F.lit("")), "qid", position="off")
    few = words.limit(MOST_KNOWN + 1).collect()
    if len(few) > MOST_KNOWN:
        return Analyzed(queries, stored(words, "queries"))
    rows = sorted((tuple(r) for r in few), key=lambda r: (str(r[0]), r[1]))
    return Analyzed(queries, queries.sparkSession.createDataFrame(rows, words.schema), tuple(sorted({r.term for r in few})))


def of_slots(rows: DataFrame, slots: list[int]) -> DataFrame:
    """The postings of some parts: a condition on slots opens their buckets alone. Too many are not named."""
    return rows.where(F.col("slot").isin(*slots)) if len(slots) <= MOST_SLOTS else rows


def matched(index: Index, q: DataFrame, a: Analyzed, *columns: str, term: str = "term") -> DataFrame:
    """q (with a column of terms) joined with columns of these terms' postings. The postings are never
    shuffled: few terms come to them as a condition and a broadcast, others are shuffled to their buckets. What is of
    documents (dl, lnc; columns must have docid, and tf for lnc) is joined with the matches."""
    stored_columns = [c for c in columns if c not in OF_DOCS]
    if a.known is not None:
        rows = of_slots(a.of_terms(index.entries), [p.slot for p in index.places(a.known)])
        return index.with_docs(q.join(rows.select(F.col("term").alias(term), *stored_columns), term), *columns)
    out = []
    for s in index.segments:
        placed = q.join(s.blocks.select(F.col("term").alias(term), "slot"), term)
        rows = s.postings.select("slot", F.col("term").alias("__term"), *stored_columns)
        # the buckets are of slot alone: another equality would be a key of the join too, and deal the postings anew
        out.append(placed.join(rows, "slot").where(F.col("__term").between(F.col(term), F.col(term))).drop("slot", "__term"))
    return index.with_docs(union(out), *columns)


@dataclass(frozen=True)
class Reading:
    """Which parts of postings a search needs: rows qid, term, part, slot, w; how many postings that is, and how
    many all parts of the queries' terms have."""

    rows: list[tuple]
    read: int
    of: int


def class_bounds(weights: list[tuple], places: list, most: str) -> dict[tuple, dict[int, float]]:
    """For each query and length class the most that its common terms can weigh there."""
    by_class: dict[str, dict[int, float]] = {}
    for p in places:
        if p.part:
            of = by_class.setdefault(p.term, {})
            of[class_of_part(p.part)] = max(p[most], of.get(class_of_part(p.part), 0.0))
    out: dict[tuple, dict[int, float]] = {}
    for qid, term, w in weights:
        for c, m in by_class.get(term, {}).items():
            of = out.setdefault(qid, {})
            of[c] = of.get(c, 0.0) + w * m
    return out


def chosen_parts(weights: list[tuple], places: list, keep: Callable[[object, int], bool]) -> Reading:
    """The parts of rare terms, and of common ones those of the classes to keep for a query. A posting that
    several queries share is read once."""
    of_term: dict[str, list] = {}
    for p in places:
        of_term.setdefault(p.term, []).append(p)
    rows = [(qid, p.term, p.part, p.slot, float(w)) for qid, term, w in weights for p in of_term.get(term, ()) if not p.part or keep(qid, class_of_part(p.part))]
    read = {(p[1], p[2]) for p in rows}
    return Reading(rows, sum(p.n for p in places if (p.term, p.part) in read), sum(p.n for p in places))


def read_parts(index: Index, reading: Reading, kind: str, *columns: str) -> DataFrame:
    """qid, w and columns of the postings of a reading; docid and tf must be among them for lnc."""
    q = index.spark.createDataFrame(reading.rows, f"qid {kind}, term string, part int, slot int, w double")
    slots, terms = sorted({r[3] for r in reading.rows}), sorted({r[1] for r in reading.rows})
    rows = of_slots(index.entries.where(F.col("term").isin(*terms)), slots)
    q = q.distinct()  # several segments may hold a part
    own = dict.fromkeys([c for c in columns if c not in OF_DOCS] + (["docid", "tf"] if "lnc" in columns else []))
    found = F.broadcast(q).join(rows.select("slot", "term", "part", *own), ["slot", "term", "part"])  # a row for each query's part, known here
    return index.with_docs(found, *columns)


def bounded_reading(index: Index, weights: DataFrame, a: Analyzed, k: int, value: Column, most: str) -> Reading:
    """What a search for the k best must read. weights: qid, term, w (from 0 up); value: what a posting's columns
    make of w, at most ``most`` of its part."""
    kind, places = dict(weights.dtypes)["qid"], index.places(a.known)
    held = [tuple(r) for r in weights.select("qid", "term", "w").where("w > 0").collect()]
    bounds = class_bounds(held, places, most)
    best = {qid: max(of, key=lambda c, of=of: (of[c], -c)) for qid, of in bounds.items()}
    first = chosen_parts(held, places, lambda qid, c: best.get(qid) == c)
    cls = index.length_class(F.col("dl"))
    scores = read_parts(index, first, kind, "docid", "dl", "tf", "lnc").groupBy("qid", "docid").agg(F.sum(F.col("w") * value).alias("score"), F.first(cls).alias("c"))
    # the k-th score so far, which the k best of all reach; the best candidate of each class: a row for each query and class
    seen = scores.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"))))
    told = seen.groupBy("qid", "c").agg(F.max("score").alias("most"), F.min(F.when(F.col("r") == k, F.col("score"))).alias("kth")).collect()
    least, candidate = {}, {}
    for r in told:
        candidate[r.qid, r.c] = r.most
        if r.kth is not None:
            least[r.qid] = r.kth

    def keep(qid: object, c: int) -> bool:
        if qid not in least or c == best.get(qid):
            return True
        reach = bounds[qid].get(c, 0.0) + candidate.get((qid, c), 0.0)
        return reach >= least[qid] * (1 - 1e-9) - 1e-9  # sums of floats, ranked by 10 places

    return chosen_parts(held, places, keep)


def summed(index: Index, weights: DataFrame, a: Analyzed, k: int, value: Column, most: str, pays: int) -> DataFrame:
    """qid, docid, score: the sums of w * value over the postings of the queries' terms; where these are many, of
    the documents that may be among the k best."""
    if a.known is not None and sum(p.n for p in index.places(a.known) if p.part) >= pays:
        reading = bounded_reading(index, weights, a, k, value, most)
        hits = read_parts(index, reading, dict(weights.dtypes)["qid"], "docid", "dl", "tf", "lnc")
    else:
        hits = matched(index, weights.select("qid", "term", "w"), a, "docid", "dl", "tf", "lnc")
    return hits.groupBy("qid", "docid").agg(F.sum(F.col("w") * value).alias("score"))


def query_terms(queries: Queries) -> DataFrame:
    """qid, off, term: the analyzed queries."""
    return analyzed(queries).words


def top(scores: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 10)), "docid")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def of_collection(df: DataFrame, index: Index) -> DataFrame:
    """Adds n and avgdl."""
    return df.withColumns({"n": F.lit(index.size[0]), "avgdl": F.lit(index.size[1])})


def oov_terms(index: Index, queries: Queries) -> DataFrame:
    """qid, term: distinct query terms that are in no document."""
    q = analyzed(queries)
    return q.words.select("qid", "term").distinct().join(q.of_terms(index.terms), "term", "left_anti").select("qid", "term")


def vsm_idf(index: Index) -> DataFrame:
    return of_collection(index.terms, index).select("term", "df", F.log10(F.col("n").cast("double") / F.col("df")).alias("idf"))


def bm25_idf(index: Index) -> DataFrame:
    return of_collection(index.terms, index).select("term", "df", weighting.bm25_idf(F.col("df"), F.col("n")).alias("idf"))


def unit(df: DataFrame, key: str, raw: str) -> Column:
    norm = F.sqrt(F.sum(F.col(raw) * F.col(raw)).over(Window.partitionBy(key)))
    return F.col(raw) / F.when(norm > 0, norm).otherwise(1.0)


def ltc_query(index: Index, queries: Queries) -> DataFrame:
    """qid, term, w; terms without weight (unknown, or in every document) have 0."""
    a = analyzed(queries)
    q = of_collection(a.words.groupBy("qid", "term").agg(F.count("*").alias("qtf")).join(a.of_terms(index.terms), "term", "left"), index)
    idf = weighting.df_weight("t", F.coalesce("df", F.lit(0)), F.col("n"))
    raw = q.withColumn("raw", F.when(idf > 0, weighting.tf_weight("l", F.col("qtf"), F.col("qtf"), F.col("qtf")) * idf).otherwise(0.0))
    return raw.select("qid", "term", unit(raw, "qid", "raw").alias("w"))


def vsm(index: Index, queries: Queries, k: int = 10, pays: int = PAYS) -> DataFrame:
    """Vector space, lnc.ltc."""
    a = analyzed(queries)
    return top(summed(index, ltc_query(index, a).where("w <> 0"), a, k, F.col("lnc"), "most_lnc", pays), k)


def bm25(index: Index, queries: Queries, k: int = 10, pays: int = PAYS) -> DataFrame:
    """Each distinct query term counts once."""
    a = analyzed(queries)
    q = of_collection(a.words.select("qid", "term").distinct().join(a.of_terms(index.terms), "term"), index)
    weights = q.select("qid", "term", weighting.bm25_idf(F.col("df"), F.col("n")).alias("w"))
    return top(summed(index, weights, a, k, weighting.bm25_saturation(F.col("tf"), F.col("dl"), F.lit(index.size[1])), "most_bm25", pays), k)


def fielded(index: Index, queries: Queries, k: int = 10, base: Ranker = vsm, boost: float = BOOST, pool: int = BOOST_POOL) -> DataFrame:
    """The best of a base ranking, multiplied by boost for each distinct query term in title or category."""
    a = analyzed(queries)
    ranked = base(index, a, pool).select("qid", "docid", "score")
    terms = a.words.select("qid", "term").distinct()
    found = terms.join(a.of_terms(index.title_postings).select("term", "docid"), "term").groupBy("qid", "docid").agg(F.count("*").alias("hits"))
    boosted = ranked.join(found, ["qid", "docid"], "left").withColumn("score", F.col("score") * F.pow(F.lit(boost), F.coalesce("hits", F.lit(0))))
    return top(boosted.drop("hits"), k)


def query_bigrams(index: Index, queries: Queries) -> DataFrame:
    """qid, ta, tb: neighbours among a query's distinct terms in order of first occurrence, both known."""
    a = analyzed(queries)
    distinct = a.words.groupBy("qid", "term").agg(F.min("off").alias("off"))
    pairs = distinct.select("qid", F.col("term").alias("ta"), F.lead("term").over(Window.partitionBy("qid").orderBy("off")).alias("tb")).where("tb is not null")
    for side in ("ta", "tb"):
        pairs = pairs.join(a.of_terms(index.terms).select(F.col("term").alias(side)), side, "left_semi")
    return pairs.select("qid", "ta", "tb")


def shifted_hits(a: str, b: str, shifts: list[int]) -> Column:
    """Pairs of positions with b - a among the shifts. A term stands once at a position, so each shift is
    an intersection of sets: linear in the positions, not quadratic."""
    moved = lambda d: F.transform(a, lambda x: x + d)
    return sum((F.size(F.array_intersect(moved(d), b)) for d in shifts), F.lit(0))


def near_pairs(index: Index, common: int = COMMON) -> None:
    """Stores with the index how often each two terms of ``common`` documents or more stand near each other in a
    document: bigrams(docid, ta, tb, ahead, back, near), a row for both orders of two terms, ta before tb by code
    points, and the terms for which that is so. Evidence for two such terms then reads counts; what isn't there
    is 0. A document's words are in one place, so what stands behind a word is looked at, never all pairs of
    its places. The rows stay with their documents and are sorted by terms: what is counted of a collection is many
    times as large, and only a share of its words, not of its pairs, is shuffled at a time."""
    if index.has(BIGRAM_TERMS):  # written last
        return
    terms = index.terms.where(F.col("df") >= common).select("term")
    index.made(f"{BIGRAMS}_of", lambda: [terms])
    held, _ = broadcast(index.made(f"{BIGRAMS}_of", lambda: []))
    rows = index.entries.select("docid", "term", "positions").join(held, "term")
    order = Window.partitionBy("docid").orderBy("pos")
    behind = [F.struct(F.lead("term", k).over(order).alias("other"), (F.lead("pos", k).over(order) - F.col("pos")).alias("gap")) for k in range(1, UNORDERED_WINDOW + 1)]

    def counted(some: DataFrame) -> DataFrame:
        words = some.repartition("docid").select("docid", "term", F.explode("positions").alias("pos"))
        near = words.select("docid", "term", F.array(*behind).alias("behind")).select("docid", "term", F.inline("behind"))
        near = near.where((F.col("gap") <= UNORDERED_WINDOW) & (F.col("other") != F.col("term")))
        first, close = F.col("term") < F.col("other"), F.col("gap") <= ORDERED_WINDOW
        sides = near.select("docid", F.least("term", "other").alias("ta"), F.greatest("term", "other").alias("tb"), (first & close).cast("int").alias("a"), (~first & close).cast("int").alias("b"))
        sums = sides.groupBy("docid", "ta", "tb").agg(*[F.sum(c).cast("int").alias(n) for c, n in (("a", "ahead"), ("b", "back"))], F.count("*").cast("int").alias("near"))
        return sums.sortWithinPartitions("ta", "tb", "docid")

    rounds = rounds_of(index.doc_stats.agg(F.sum("dl")).first()[0], ROUND_ROWS)
    index.made(BIGRAMS, lambda: map(counted, shares(rows, rounds)))
    index.derived(BIGRAM_TERMS, lambda: terms, "term", "term")


def sdm_evidence(index: Index, queries: Queries) -> DataFrame:
    """qid, docid, ordered, unordered: for every document that holds both terms of some bigram (counts
    may be 0) the pairs within the ordered and unordered windows, summed over the bigrams. Where counts of
    near pairs are stored with the index (``near_pairs``), the places of such terms are not read."""
    a = analyzed(queries)
    pairs = query_bigrams(index, a)
    counted = None
    if index.has(BIGRAM_TERMS):
        terms = index.derived(BIGRAM_TERMS, lambda: None, "term", "term")
        pairs = stored(pairs, "bigrams")
        held = pairs.join(terms.select(F.col("term").alias("ta")), "ta", "left_semi").join(terms.select(F.col("term").alias("tb")), "tb", "left_semi").select("qid", "ta", "tb")
        held = stored(held, "counted_bigrams")
        pairs = pairs.join(held, ["qid", "ta", "tb"], "left_anti")
        rows = index.made(BIGRAMS, lambda: [])
        if a.known is not None:
            rows = rows.where(F.col("ta").isin(*a.known) & F.col("tb").isin(*a.known))
        both = matched(index, held, a, "docid", term="ta").join(matched(index, held, a, "docid", term="tb"), ["qid", "ta", "tb", "docid"])
        asked = held.select("qid", F.col("ta").alias("from"), F.col("tb").alias("to"), F.least("ta", "tb").alias("ta"), F.greatest("ta", "tb").alias("tb"))
        ordered = F.when(F.col("from") == F.col("ta"), F.col("ahead")).otherwise(F.col("back"))
        near = broadcast(asked)[0].join(rows, ["ta", "tb"]).select("qid", F.col("from").alias("ta"), F.col("to").alias("tb"), "docid", ordered.cast("long").alias("ordered"), F.col("near").cast("long").alias("unordered"))
        counted = both.join(near, ["qid", "ta", "tb", "docid"], "left").select("qid", "docid", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("ordered", "unordered")])
    left = matched(index, pairs, a, "docid", "positions", term="ta").withColumnRenamed("positions", "pa")
    right = matched(index, pairs, a, "docid", "positions", term="tb").withColumnRenamed("positions", "pb")
    both = left.join(right, ["qid", "ta", "tb", "docid"])
    ahead, near = list(range(1, ORDERED_WINDOW + 1)), [d for k in range(1, UNORDERED_WINDOW + 1) for d in (k, -k)]
    each = both.select("qid", "docid", shifted_hits("pa", "pb", ahead).cast("long").alias("ordered"), shifted_hits("pa", "pb", near).cast("long").alias("unordered"))
    if counted is not None:
        each = each.unionByName(counted)
    return each.groupBy("qid", "docid").agg(F.sum("ordered").alias("ordered"), F.sum("unordered").alias("unordered"))


def sdm(index: Index, queries: Queries, k: int = 10, base: Ranker = vsm, pool: int = SDM_POOL, weights: tuple[float, float, float] = SDM_WEIGHTS) -> DataFrame:
    """Sequential dependence: the base ranking's pool, ordered and unordered bigram windows, each over
    its greatest value for the query, mixed linearly."""
    a = analyzed(queries)
    unigram = base(index, a, pool).select("qid", "docid", F.col("score").alias("ft"), F.lit(0).cast("long").alias("fo"), F.lit(0).cast("long").alias("fu"))
    grams = sdm_evidence(index, a).select("qid", "docid", F.lit(0.0).alias("ft"), F.col("ordered").alias("fo"), F.col("unordered").alias("fu"))
    parts = ("ft", "fo", "fu")
    every = unigram.unionByName(grams).groupBy("qid", "docid").agg(*[F.sum(c).alias(c) for c in parts])
    # a query may have any number of candidates: its greatest values are partial aggregates, a row a query
    most = every.groupBy("qid").agg(*[F.max(c).cast("double").alias(f"most_{c}") for c in parts])
    share = lambda c: F.col(c) / F.when(F.col(f"most_{c}") != 0, F.col(f"most_{c}")).otherwise(1.0)
    score = sum((F.lit(w) * share(c) for w, c in zip(weights, parts, strict=True)), F.lit(0.0))
    return top(every.join(most, "qid").select("qid", "docid", score.alias("score")), k)


def sdm_on_bm25(index: Index, queries: Queries, k: int = 10) -> DataFrame:
    return sdm(index, queries, k, base=bm25)


def smart_weight(index: Index, scheme: str) -> Column:
    """The document weight of postings with df and the document's statistics. Cosine norms of every tf and df
    code are stored with the documents, so that no other posting is read."""
    tf, df, norm = weighting.check_scheme(scheme)
    raw = weighting.tf_weight(tf, F.col("tf"), F.col("max_tf"), F.col("avg_tf")) * weighting.df_weight(df, F.col("df"), F.lit(index.size[0]))
    by = {"n": F.lit(1.0), "c": F.col(weighting.norm_name(tf, df)), "u": F.col("n_unique").cast("double"), "b": F.pow(F.col("char_len").cast("double"), F.lit(weighting.BYTE_POWER))}[norm]
    return raw / F.when(by > 0, by).otherwise(1.0)


def smart_doc_weights(index: Index, scheme: str) -> DataFrame:
    """term, docid, w of a document scheme, of all terms."""
    rows = index.entries.select("term", "docid", "tf").join(index.terms, "term").join(index.doc_stats.drop("dl"), "docid")
    return rows.select("term", "docid", smart_weight(index, scheme).alias("w"))


def smart_query_weights(index: Index, queries: Queries, scheme: str) -> DataFrame:
    """qid, term, w, df of a query scheme. Both length norms u and b divide by the length of the query's
    text; unknown terms (df 0) count in the cosine norm where the scheme has no idf."""
    tf, df, norm = weighting.check_scheme(scheme)
    over = Window.partitionBy("qid")
    a = analyzed(queries)
    q = a.words.groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    q = q.withColumn("max_tf", F.max("qtf").over(over)).withColumn("avg_tf", F.avg("qtf").over(over))
    q = of_collection(q.join(a.of_terms(index.terms), "term", "left").withColumn("df", F.coalesce("df", F.lit(0))).join(a.texts.select("qid", F.length("text").cast("double").alias("chars")), "qid"), index)
    q = q.withColumn("raw", weighting.tf_weight(tf, F.col("qtf"), F.col("max_tf"), F.col("avg_tf")) * weighting.df_weight(df, F.col("df"), F.col("n")))
    by = {"n": F.lit(1.0), "c": F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(over)), "u": F.col("chars"), "b": F.pow("chars", F.lit(weighting.BYTE_POWER))}[norm]
    q = q.withColumn("by", by)
    return q.select("qid", "term", (F.col("raw") / F.when(F.col("by") > 0, F.col("by")).otherwise(1.0)).alias("w"), "df")


def smart(index: Index, queries: Queries, k: int = 10, doc_scheme: str = "lnc", query_scheme: str = "ltc") -> DataFrame:
    """Any pair of SMART schemes; documents that score 0 are left out."""
    weighting.check_scheme(doc_scheme)
    a = analyzed(queries)
    q = smart_query_weights(index, a, query_scheme).where("w <> 0 and df > 0")
    hits = matched(index, q, a, "docid", "tf").join(index.doc_stats.drop("dl"), "docid")
    return top(hits.groupBy("qid", "docid").agg(F.sum(F.col("w") * smart_weight(index, doc_scheme)).alias("score")).where("score <> 0"), k)
