"""DCG and NDCG, rule-based grades, comparison of rankings. Rankings are tables ranker, qid, rank, docid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.operators.index import Index
from quillsift.operators.positional import by_hits, phrase_hits
from quillsift.operators.rank import BOOST_POOL, Queries, Ranker, analyzed, bm25, fielded, matched, sdm, smart, vsm
from quillsift.plans.storage import stored

BASELINE_POOL, PHRASE_POOL = 100, 100


def gain(grade: Column, rank: Column, k: int) -> Column:
    return F.sum(F.when(rank <= k, (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank.cast("double") + 1)).otherwise(0.0))


def dcg(graded: DataFrame, k: int, *keys: str) -> DataFrame:
    """keys, dcg of graded results with a rank and a grade."""
    return graded.groupBy(*keys).agg(gain(F.col("grade"), F.col("rank"), k).alias("dcg"))


def ndcg(rankings: DataFrame, judgments: DataFrame) -> DataFrame:
    """ranker, qid, ndcg_at_10, ndcg_at_5. The ideal is the retrieved list's own grades, best first;
    documents without a judgment have grade 0; without any gain the value is 0."""
    keys = ("ranker", "qid")
    graded = rankings.join(judgments, ["qid", "docid"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    graded = graded.withColumn("ideal", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("grade"), "rank")))
    sums = graded.groupBy(*keys).agg(*[gain(F.col("grade"), F.col(c), k).alias(f"{c}{k}") for k in (10, 5) for c in ("rank", "ideal")])
    share = lambda k: F.when(F.col(f"ideal{k}") > 0, F.col(f"rank{k}") / F.col(f"ideal{k}")).otherwise(0.0).alias(f"ndcg_at_{k}")
    return sums.select(*keys, share(10), share(5))


def rankings(index: Index, queries: Queries, k: int = 10, custom: tuple[str, str] | None = None) -> DataFrame:
    """The lists of all rankers; custom: a pair of SMART schemes to add. The vector space is ranked once,
    as far down as its own list and the pools of the rankers built on it reach."""
    a = analyzed(queries)
    base = stored(vsm(index, a, max(k, BOOST_POOL)), "base")
    cut: Ranker = lambda i, q, n: base.where(F.col("rank") <= n)
    found = {"VSM (lnc.ltc)": cut(index, a, k), "BM25": bm25(index, a, k), "SDM": sdm(index, a, k, base=cut), "Title-boosted VSM": fielded(index, a, k, base=cut)}
    lists = [r.withColumn("ranker", F.lit(name)) for name, r in found.items()]
    if custom:
        lists.append(smart(index, a, k, *custom).withColumn("ranker", F.lit(f"Custom ({custom[0]}.{custom[1]})")))
    out = lists[0].select("ranker", "qid", "rank", "docid")
    for x in lists[1:]:
        out = out.unionByName(x.select("ranker", "qid", "rank", "docid"))
    return out


def pool(ranked: DataFrame) -> DataFrame:
    return ranked.select("qid", "docid").distinct()


def rule_judgments(index: Index, queries: Queries, pooled: DataFrame) -> DataFrame:
    """qid, docid, grade: 3 for a phrase hit (among the first so many), 2 for all terms, 1 for any."""
    a = analyzed(queries)
    terms = a.words.select("qid", "term").distinct()
    wanted = terms.groupBy("qid").agg(F.count("*").alias("wanted"))
    held = matched(index, terms, a, "docid").join(pooled, ["qid", "docid"], "left_semi").groupBy("qid", "docid").agg(F.count("*").alias("held"))
    phrases = by_hits(phrase_hits(index, a), PHRASE_POOL, "start").select("qid", "docid", F.lit(True).alias("phrase"))
    rows = pooled.join(wanted, "qid", "left").join(held, ["qid", "docid"], "left").join(phrases, ["qid", "docid"], "left")
    grade = F.when(F.col("phrase"), 3).when(F.col("held") == F.col("wanted"), 2).when(F.col("held") > 0, 1).otherwise(0)
    return rows.select("qid", "docid", grade.alias("grade"))


def report(index: Index, queries: Queries, judgments: DataFrame | None = None, k: int = 10, custom: tuple[str, str] | None = ("lnc", "ltc")) -> DataFrame:
    """NDCG of every ranker and the documents it ranks, best first; without judgments the rule grades the
    pooled documents."""
    a = analyzed(queries)
    lists = stored(rankings(index, a, k, custom), "rankings")  # read for the pool, for the grades and for the documents
    values = ndcg(lists, rule_judgments(index, a, pool(lists)) if judgments is None else judgments)
    ranked = lists.groupBy("ranker", "qid").agg(F.sort_array(F.collect_list(F.struct("rank", "docid"))).alias("all"))
    return values.join(ranked.select("ranker", "qid", F.col("all.docid").alias("ranked_docids")), ["ranker", "qid"])


def with_badges(index: Index, ranked: DataFrame, queries: Queries) -> DataFrame:
    """Adds vsm_rank and rank_shift: NEW, = , ^n (up) or vn (down) against VSM's first hundred."""
    baseline = vsm(index, queries, BASELINE_POOL).select("qid", "docid", F.col("rank").alias("vsm_rank"))
    up = F.col("vsm_rank") - F.col("rank")
    badge = F.when(F.col("vsm_rank").isNull(), "NEW").when(up == 0, "=").when(up > 0, F.concat(F.lit("^"), up.cast("string"))).otherwise(F.concat(F.lit("v"), (-up).cast("string")))
    return ranked.join(baseline, ["qid", "docid"], "left").withColumn("rank_shift", badge)


def divergence(one: DataFrame, other: DataFrame, evidence: DataFrame, reach: int = 3) -> DataFrame:
    """qid, docid, moved, ordered_hits: where two rankings part, the documents that only the second
    (promoted) or only the first (demoted) has within so many ranks behind that place."""
    a, b = one.select("qid", "rank", F.col("docid").alias("a")), other.select("qid", "rank", F.col("docid").alias("b"))
    first = a.join(b, ["qid", "rank"]).where("a <> b").groupBy("qid").agg(F.min("rank").alias("first"))
    near = lambda t: t.join(first, "qid").where(F.col("rank") < F.col("first") + reach).select("qid", "docid")
    up = near(other).join(near(one), ["qid", "docid"], "left_anti").withColumn("moved", F.lit("promoted"))
    down = near(one).join(near(other), ["qid", "docid"], "left_anti").withColumn("moved", F.lit("demoted"))
    hits = evidence.select("qid", "docid", F.col("ordered").alias("ordered_hits"))
    return up.unionByName(down).join(hits, ["qid", "docid"], "left").withColumn("ordered_hits", F.coalesce("ordered_hits", F.lit(0)))


def result_sets(index: Index, queries: Queries, k: int = 10) -> DataFrame:
    """qid, docid, in_vsm, in_phrase, in_sdm: which of three searches find a document. Terms that every
    document holds have idf 0: VSM finds nothing by them, positions still do."""
    a = analyzed(queries)
    lists = {"in_vsm": vsm(index, a, k), "in_phrase": by_hits(phrase_hits(index, a), k, "start"), "in_sdm": sdm(index, a, k)}
    every = None
    for name, t in lists.items():
        t = t.select("qid", "docid", F.lit(name).alias("found"))
        every = t if every is None else every.unionByName(t)
    return every.groupBy("qid", "docid").agg(*[F.max((F.col("found") == n).cast("int")).alias(n) for n in lists])
