"""The search engine as one object: builds or opens an index and answers single queries or batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.functions.weighting import check_scheme
from quillsift.operators import correction, evaluation, positional, rank
from quillsift.operators.index import Index, build_index, extend_index, load_index
from quillsift.operators.snippets import MOST_RESULTS, Mark, snippets
from quillsift.plans.storage import gathered
from quillsift.sources.collections import checked, tagged_documents

Queries = str | list[str] | DataFrame | rank.Analyzed


class SearchEngine:
    """All searches return DataFrames with qid (0 for a single text), so batches and single queries go
    the same way. Nothing is changed by a search; a scheme is an argument."""

    def __init__(self, index: Index, mark: Mark = ("**", "**")):
        """mark: what snippets make of a word that was searched for."""
        self.index, self.mark = index, mark

    @classmethod
    def from_documents(cls, docs: DataFrame, path: str | None = None) -> SearchEngine:
        return cls(build_index(checked(docs), path))

    @classmethod
    def from_tagged_file(cls, spark: SparkSession, path: str) -> SearchEngine:
        return cls.from_documents(tagged_documents(spark, path))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SearchEngine:
        return cls(load_index(spark, path))

    def with_documents(self, docs: DataFrame, path: str | None = None) -> SearchEngine:
        """An engine over these documents too; the ones before are not analyzed again."""
        return SearchEngine(extend_index(self.index, checked(docs), path), self.mark)

    def count_near_pairs(self) -> SearchEngine:
        """Stores counts of near pairs of common terms with the index, for sequential dependence."""
        rank.near_pairs(self.index)
        return self

    def queries(self, q: Queries) -> rank.Analyzed:
        if not isinstance(q, DataFrame | rank.Analyzed):
            q = self.index.spark.createDataFrame(list(enumerate([q] if isinstance(q, str) else q)), "qid int, text string")
        return rank.analyzed(q)

    def described(self, ranked: DataFrame, queries: rank.Queries) -> DataFrame:
        """Adds title, category and snippet. The ranking is computed once; few results become conditions of
        the scan of documents."""
        ranked, known = gathered(ranked, MOST_RESULTS)
        docs = self.index.docs.select("docid", "title", "category")
        docs = docs if known is None else docs.where(F.col("docid").isin(sorted({r.docid for r in known})))
        return ranked.join(docs, "docid").join(snippets(self.index, ranked, queries, mark=self.mark), ["qid", "docid"])

    def formatted(self, ranked: DataFrame, queries: rank.Queries) -> DataFrame:
        """qid, rank, docid, title, category, score (4 places), snippet."""
        found = self.described(ranked, queries)
        return found.select("qid", "rank", "docid", "title", "category", F.round("score", 4).alias("score"), "snippet").orderBy("qid", "rank")

    def oov(self, q: Queries) -> DataFrame:
        return rank.oov_terms(self.index, self.queries(q))

    def search_vsm(self, q: Queries, top_k: int = 10) -> DataFrame:
        q = self.queries(q)
        return self.formatted(rank.vsm(self.index, q, top_k), q)

    def search_bm25(self, q: Queries, top_k: int = 10) -> DataFrame:
        q = self.queries(q)
        return self.formatted(rank.bm25(self.index, q, top_k), q)

    def search_sdm(self, q: Queries, top_k: int = 10, base: str = "vsm") -> DataFrame:
        q = self.queries(q)
        return self.formatted(rank.sdm(self.index, q, top_k, base=rank.vsm if base == "vsm" else rank.bm25), q)

    def sdm_evidence(self, q: Queries) -> DataFrame:
        return rank.sdm_evidence(self.index, self.queries(q))

    def search_fielded(self, q: Queries, top_k: int = 10) -> DataFrame:
        q = self.queries(q)
        return self.formatted(rank.fielded(self.index, q, top_k), q)

    def search_custom(self, q: Queries, top_k: int = 10, doc_scheme: str = "lnc", query_scheme: str = "ltc") -> DataFrame:
        q = self.queries(q)
        return self.formatted(rank.smart(self.index, q, top_k, check_scheme(doc_scheme), check_scheme(query_scheme)), q)

    def search_with_typo_tolerance(self, q: Queries, top_k: int = 10) -> DataFrame:
        fixed = rank.analyzed(correction.corrected(self.index, self.queries(q)))
        return self.formatted(rank.vsm(self.index, fixed, top_k), fixed)

    def corrections(self, q: Queries) -> DataFrame:
        return correction.suggestions(self.index, self.queries(q))

    def _positional(self, hits: DataFrame, queries: rank.Queries, *columns: str, top_k: int) -> DataFrame:
        ranked = evaluation.with_badges(self.index, positional.by_hits(hits, top_k, *columns), queries)
        found = self.described(ranked, queries)
        return found.select("qid", "rank", "docid", "title", "category", "match_positions", "rank_shift", "vsm_rank", "snippet").orderBy("qid", "rank")

    def search_phrase(self, q: Queries, top_k: int = 10) -> DataFrame:
        q = self.queries(q)
        return self._positional(positional.phrase_hits(self.index, q), q, "start", top_k=top_k)

    def search_proximity(self, term_a: str, term_b: str, k: int, ordered: bool = True, top_k: int = 10) -> DataFrame:
        pairs = self.index.spark.createDataFrame([(0, term_a, term_b, k)], "qid int, term_a string, term_b string, k int")
        return self._positional(positional.proximity_hits(self.index, pairs, ordered), self.queries(f"{term_a} {term_b}"), "pa", "pb", top_k=top_k)

    def ndcg_report(self, q: Queries, judgments: DataFrame | None = None, top_k: int = 10, custom: tuple[str, str] | None = None) -> DataFrame:
        """ranker, qid, ndcg_at_10, ndcg_at_5, ranked_docids; judgments: qid, docid, grade (the rule's if none)."""
        return evaluation.report(self.index, self.queries(q), judgments, top_k, custom)
