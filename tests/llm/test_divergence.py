"""op12 against whole-number arithmetic over every term."""

import re
from collections import Counter, defaultdict

import pytest
from compare import rows
from conftest import DATA

from quillsift.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def plain(docs):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        found = TERM.findall(text.translate(LOW))
        counts[lang, source].update(found)
        df[lang].update(set(found))
        groups[lang].add(source)
    for lang, sources in groups.items():
        kept = sorted((t for t, n in df[lang].items() if n >= divergence.LEAST_DOCS), key=lambda t: t.encode())
        n = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + divergence.SCALE * (counts[lang, s][t] + 1) // (n[s] + len(kept)) for t in kept} for s in sources}
        q = {t: 1 + divergence.SCALE * (sum(counts[lang, s][t] for s in sources) + 1) // (sum(n.values()) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, values, most in (("pair", pairs, len(pairs)), ("term", terms, divergence.TERM_RANKS)):
                for r, (v, item) in enumerate(sorted(values, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    yield lang, s, part, item, v, r


ROWS = [
    *[("Alpha beta gamma, alpha", "en", "a")] * 3,
    *[("alpha ALPHA delta4epsilon", "en", "b")] * 3,
    ("beta rare1 rare", "en", "c"),
    ("beta rare two", "en", None),
    ("", "en", "empty"),
    (None, "en", "null"),
    ("zzz " * 1000, "en", "c"),
    ("nur einmal", "de", "a"),
    ("zweimal hier", "de", "b"),
    *[("été ÉTÉ naïve", "fr", "a")] * 4,
    *[("12 34 ?!", None, "a")] * 3,
    *[("lone term", "", "only")] * 3,
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "x") for r in ROWS], "text string, lang string, source string, p int, id string").repartition(3)


def test_plain(docs):
    assert rows(COLUMNS, divergence.audit(docs).select(COLUMNS).collect()) == rows(COLUMNS, plain(ROWS))


def test_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    want = list(plain([(r.text, r.lang, r.source) for r in docs.collect()]))
    assert max(r[5] for r in want) == divergence.TERM_RANKS and {r[2] for r in want} == {"pair", "term"}
    assert rows(COLUMNS, divergence.audit(docs).select(COLUMNS).collect()) == rows(COLUMNS, want)


def test_ties_beyond_the_ranks(spark):
    """More equal terms than ranks: the first by their bytes are ranked."""
    some = [(" ".join(f"t{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)), "en", "a")] * 3 + [("other words", "en", "b")] * 3
    got = divergence.audit(spark.createDataFrame(some, "text string, lang string, source string"))
    assert rows(COLUMNS, got.select(COLUMNS).collect()) == rows(COLUMNS, plain(some))


def test_large_counts(spark):
    """Probabilities are exact where counts times SCALE pass 64 bits."""
    from pyspark.sql import functions as F

    n, of = 3 * 10**13, 10**14
    row = spark.createDataFrame([(n, of, 12345)], "n long, of long, v long").select(divergence.probability(F.col("n"), F.col("of"), F.col("v")).alias("p")).first()
    assert row.p == 1 + divergence.SCALE * (n + 1) // (of + 12345)


def test_empty(docs):
    assert divergence.audit(docs.limit(0)).collect() == []


def test_slices(monkeypatch):
    text = "Ab cd, ef" * 50
    whole = divergence.terms_of(text)
    monkeypatch.setattr(divergence, "SLICE", 7)
    assert divergence.terms_of(text) == whole and whole[b"cd"] == 50


def test_terms_are_shuffled_once(docs):
    """Counts of groups and columns of terms come from one shuffle: a second one moved all groups' terms again."""
    some = docs.selectExpr("coalesce(text, '') text", "coalesce(lang, '') lang", "coalesce(source, '') source")
    plan = divergence.columns_of(some)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_a_document_counts_once_over_slices_and_batches(spark, monkeypatch):
    """A term in several slices of a document is in one document; what a task hands on early is added up."""
    assert len(list(divergence.slices_of(b"Ab cd, ef " * 900_000))) == 3
    monkeypatch.setattr(divergence, "HELD", 2)
    some = [("Ab cd, ef " * 900_000, "en", "a"), ("ab x", "en", "b"), ("ab cd x é", "en", "a"), ("cd x é É", "en", "c")]
    got = divergence.audit(spark.createDataFrame(some, "text string, lang string, source string").repartition(2))
    assert rows(COLUMNS, got.select(COLUMNS).collect()) == rows(COLUMNS, plain(some))
