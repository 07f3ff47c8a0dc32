"""Parts and buckets of postings, bounds, the correction index: the same results with less read."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillsift.functions.text import STOPWORDS
from quillsift.operators import correction, positional, rank, snippets
from quillsift.operators.index import build_index, class_of_part, extend_index, load_index

FIELDS = "docid long, category string, title string, text string"


def made(n=1500, seed=5):
    """Texts of very different lengths; word zN is in about one of N documents, so some are common and some rare."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = int(4 * 40 ** rng.random())
        words = [f"z{k}" for k in (1, 2, 3, 5, 10, 30, 100, 300) if rng.random() < 1 / k for _ in range(rng.choice((1, 1, 2, 5)))]
        words += [f"u{int(2 ** (rng.random() * 9))}" for _ in range(size)]
        rng.shuffle(words)
        out.append((i, f"c{i % 3}", " ".join(words[:2]), " ".join(words)))
    return out


DOCS = made()
QUERIES = ["z1", "z1 z2 z3", "z300", "z100 z1 z2", "z300 z1", "z2 z5 u3 u3", "z30 z10 nothere", "u200 z1 z2", "u1 u2 u3", "nothere", "", "z1 z1 z2", "u500 u501 u502 z1"]


@pytest.fixture(scope="module")
def tables(spark):
    return spark.createDataFrame(DOCS, FIELDS)


@pytest.fixture(scope="module")
def index(tables):
    """Terms of 100 documents are common here, in classes of about 190 documents."""
    return build_index(tables, common=100, classes=8, part_rows=64)


@pytest.fixture(scope="module")
def plain(tables):
    """Every term is one part."""
    return build_index(tables)


@pytest.fixture(scope="module")
def queries(spark):
    return rank.analyzed(spark.createDataFrame(list(enumerate(QUERIES)), "qid int, text string"))


def found(df):
    return sorted((r.qid, r["rank"], r.docid, round(r.score, 9)) for r in df.collect())


def test_parts(index, plain):
    """Each posting is in one part; common terms have parts of bounded size, in the class of their documents."""
    df = {r.term: r.df for r in index.terms.collect()}
    per, parts = {}, index.blocks.collect()
    for r in parts:
        per[r.term] = per.get(r.term, 0) + r.n
        assert (r.part > 0) == (df[r.term] >= 100) and r.n <= (3 * 64 if r.part else 100)
    assert per == df and max(r.part for r in parts) > 0 and plain.blocks.where("part > 0").count() == 0
    rows = index.postings.withColumn("cls", index.length_class(F.col("dl"))).select("term", "part", "slot", "dl", "lnc", "cls").collect()
    most = {(r.term, r.part): r.most_lnc for r in parts}
    assert all(r.lnc <= most[r.term, r.part] and (not r.part or class_of_part(r.part) == r.cls) for r in rows)
    assert len({r.slot for r in rows}) == len(parts)
    assert sorted(index.inverted.collect()) == sorted(plain.inverted.collect())


@pytest.mark.parametrize("ranker", [rank.vsm, rank.bm25])
@pytest.mark.parametrize("k", [1, 10, 200])
def test_bounds_change_no_result(index, plain, queries, ranker, k):
    want = found(ranker(plain, queries, k))
    assert want and found(ranker(index, queries, k)) == want
    assert found(ranker(index, queries, k, pays=0)) == want


def test_bounds_read_less(index, queries, spark):
    """Of a common term beside a rare one only the classes are read that can lift a document to the k best."""
    q = rank.analyzed(spark.createDataFrame([(0, "z100 z1 z2 z3")], "qid int, text string"))
    weights = rank.ltc_query(index, q)
    reading = rank.bounded_reading(index, weights, q, 5, F.col("lnc"), "most_lnc")
    assert reading.of == sum(r.df for r in index.terms.where("term in ('z100', 'z1', 'z2', 'z3')").collect())
    assert reading.read < 0.5 * reading.of
    # the scan's own count says the same
    hits = rank.read_parts(index, reading, "int", "docid", "lnc")
    hits.collect()
    plan = hits._jdf.queryExecution().executedPlan()
    assert reading.read <= scanned_rows(plan) <= reading.of


def scanned_rows(plan):
    """Rows that scans of postings hand on behind their conditions."""
    node = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    rows, todo = [], [node]
    while todo:
        x = todo.pop()
        if x.nodeName() == "Filter" and "slot" in x.toString():
            rows.append(x.metrics().apply("numOutputRows").value())
        children = x.children()
        todo += [children.apply(i) for i in range(children.size())]
        if x.nodeName().endswith("QueryStage"):
            todo.append(x.plan())
    return max(rows)


def test_buckets_are_pruned(index, spark):
    q = rank.analyzed(spark.createDataFrame([(0, "z300")], "qid int, text string"))
    plan = rank.vsm(index, q)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SelectedBucketsCount: 1 out of \d+", plan) and "In(slot" in plan.replace("EqualTo(slot", "In(slot")


def exchanged(plan):
    """Names of the columns that exchanges below joins deal postings by: the lines under an exchange up to its scan."""
    lines, out = plan.split("\n"), []
    for i, line in enumerate(lines):
        if re.search(r"\bExchange (hash|range)", line):
            depth = len(line) - len(line.lstrip(" :+-*"))
            for below in lines[i + 1 :]:
                if len(below) - len(below.lstrip(" :+-*")) <= depth:
                    break
                if "FileScan" in below and "positions" not in line:
                    out.append((line, below))
    return out


def test_batches_leave_postings_where_they_are(index, plain, queries, spark, monkeypatch):
    """More words than the driver knows, both sides too large to broadcast: only the queries' side is shuffled to
    the buckets."""
    monkeypatch.setattr(rank, "MOST_KNOWN", 3)
    batch = rank.analyzed(spark.createDataFrame(list(enumerate(QUERIES)), "qid int, text string"))
    assert batch.known is None and found(rank.bm25(index, batch)) == found(rank.bm25(plain, queries)) and found(rank.vsm(index, batch)) == found(rank.vsm(plain, queries))
    for scheme in (("anc", "apc"), ("Lnu", "ltn")):
        assert found(rank.smart(index, batch, 10, *scheme)) == found(rank.smart(plain, queries, 10, *scheme))
    assert found(rank.sdm(index, batch)) == found(rank.sdm(plain, queries))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = rank.matched(index, batch.words.select("qid", "term").distinct(), batch, "docid", "tf")
        text = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and not [x for x in exchanged(text) if "docid" in x[1] and "tf" in x[1]]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_conjunctions(index, plain, queries, spark):
    texts = [set(re.findall("[a-z0-9]+", f"{t}. {b}".lower())) for _, _, t, b in DOCS]
    got = {}
    for r in positional.candidate_docs(index, queries).collect():
        got.setdefault(r.qid, set()).add(r.docid)
    want = {}
    for i, q in enumerate(QUERIES):
        words = set(q.split())
        if words and (docs := {d for d, t in enumerate(texts) if words <= t}):
            want[i] = docs
    assert got == want
    assert sorted(positional.phrase_hits(index, queries).collect()) == sorted(positional.phrase_hits(plain, queries).collect())
    scans = positional.candidate_docs(index, queries)._jdf.queryExecution().executedPlan().toString()
    assert "positions" not in scans  # documents are found without places


def test_save_and_open(index, queries, tmp_path):
    again = index.save(str(tmp_path / "saved"))
    assert found(rank.vsm(again, queries, 10, pays=0)) == found(rank.vsm(index, queries, 10)) and again.size == index.size
    assert again.docs.count() == len(DOCS)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, above = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(above[j] + 1, row[-1] + 1, above[j - 1] + (x != y)))
    return row[-1]


def test_corrections_against_every_term(spark):
    """Words of all lengths, edited anywhere: the same as the edit distance to each known term."""
    rng = random.Random(1)
    letters = "abcdexyz"
    known = {"".join(rng.choice(letters) for _ in range(rng.choice((1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 20)))) + "0" for _ in range(400)}
    index = build_index(spark.createDataFrame([(i, "", "", w) for i, w in enumerate(sorted(known))], FIELDS))
    known = {r.term for r in index.terms.collect()}
    asked = []
    for w in rng.sample(sorted(known), 150):
        for n in (1, 2, 3):
            for _ in range(n):
                at, how = rng.randrange(len(w) + 1), rng.randrange(3)
                w = w[:at] + rng.choice(letters) * (how < 2) + w[at + (how > 0) :]
            asked.append(w + "0")
    got = {r.term: (r.distance, r.suggestion) for r in correction.suggestions(index, spark.createDataFrame([(0, " ".join(asked))], "qid int, text string")).collect()}
    oov = {r.term for r in rank.oov_terms(index, spark.createDataFrame([(0, " ".join(asked))], "qid int, text string")).collect()}
    want = {w: best for w in oov if (best := min((edits(w, t), t) for t in known))[0] <= 2}
    assert got == want and len(want) > 100
    one = spark.createDataFrame([(0, asked[0])], "qid int, text string")
    assert {r.distance for r in correction.suggestions(index, one, 1).collect()} <= {1}
    with pytest.raises(ValueError):
        correction.suggestions(index, one, 3)


def test_correction_index_is_made_once(index, spark):
    first = correction.near_words(index)
    assert correction.near_words(index) is first and first.groupBy("known").count().agg(F.max("count")).first()[0] <= 29
    many = spark.range(3000).selectExpr("CAST(id AS int) AS qid", "concat('z3', id, 'q') AS text")
    a = rank.analyzed(many)
    plan = correction.suggestions(index, a)._jdf.queryExecution().executedPlan().toString()
    assert a.known is None and "Join [key" in plan and "size" not in plan
    assert {r.distance for r in correction.suggestions(index, a).collect()} <= {1, 2}


WORD = re.compile("[a-zA-Z0-9]+")


def plain_snippet(full, stems, window=16):
    words = [(m.start(), m.end(), m[0].lower()) for m in WORD.finditer(full) if m[0].lower() not in STOPWORDS]
    if not words:
        return full[:140]
    starts = range(max(1, len(words) - window + 1))
    at = max(starts, key=lambda i: (sum(w[2] in stems for w in words[i : i + window]), -i))
    inside = words[at : at + window]
    low, high = max(0, inside[0][0] - 3), min(len(full), inside[-1][1] + 3)
    out, last = "", low
    for s, e, w in inside:
        if w in stems:
            out, last = out + full[last:s] + "**" + full[s:e] + "**", e
    return "…" * (low > 0) + out + full[last:high] + "…" * (high < len(full))


def test_snippets_against_plain_texts(index, queries, spark):
    """Of documents with hits, without, and without words; long and short."""
    results = spark.createDataFrame([(q, d) for q in range(len(QUERIES)) for d in range(0, 1500, 75)], "qid int, docid long")
    got = {(r.qid, r.docid): r.snippet for r in snippets.snippets(index, results, queries).collect()}
    assert got == {(q, d): plain_snippet(f"{DOCS[d][2]}. {DOCS[d][3]}", set(QUERIES[q].split())) for q in range(len(QUERIES)) for d in range(0, 1500, 75)}


def test_snippets_read_their_documents(index, queries, spark):
    one = spark.createDataFrame([(0, 75)], "qid int, docid long")
    plan = snippets.snippets(index, one, queries)._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 1 out of" in plan and "(docid" in plan and "regexp_like" not in plan.replace("rlike", "")


def test_norms_are_the_definition(index, plain):
    """Cosine norms from sums equal those from each weight."""
    from quillsift.functions import weighting

    n = len(DOCS)
    known = plain.postings.select("docid", "term", "tf").join(plain.terms, "term").join(plain.doc_stats.select("docid", "max_tf", "avg_tf"), "docid")
    for t in weighting.TF_CODES:
        for d in weighting.DF_CODES:
            w = weighting.tf_weight(t, F.col("tf"), F.col("max_tf"), F.col("avg_tf")) * weighting.df_weight(d, F.col("df"), F.lit(n))
            name = weighting.norm_name(t, d)
            off = known.groupBy("docid").agg(F.sqrt(F.sum(w * w)).alias("x")).join(index.doc_stats.select("docid", name), "docid").select(F.max(F.abs(F.col("x") - F.col(name)))).first()[0]
            assert off is not None and math.isclose(off, 0, abs_tol=1e-9), (t, d)


@pytest.fixture(scope="module")
def grown(tables):
    """The same documents in three segments, the last one of longer texts."""
    first = build_index(tables.where("docid % 3 = 0"), common=40, classes=8, part_rows=64)
    second = extend_index(first, tables.where("docid % 3 = 1 and length(text) < 300"), common=40, part_rows=64)
    return extend_index(second, tables.where("docid % 3 = 2 or docid % 3 = 1 and length(text) >= 300"), common=40, part_rows=64)


def test_segments_are_one_index(grown, index, plain, queries, spark, monkeypatch, tmp_path):
    assert len(grown.segments) == 3 and grown.size == index.size and len({s.path for s in grown.segments}) == 3
    assert sorted(grown.terms.collect()) == sorted(index.terms.collect())
    round_ = lambda t: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in t.collect())
    assert round_(grown.doc_stats) == round_(index.doc_stats)
    assert sorted(grown.inverted.collect()) == sorted(plain.inverted.collect()) and grown.docs.count() == len(DOCS)
    for ranker in (rank.vsm, rank.bm25, rank.sdm, rank.fielded):
        want = found(ranker(plain, queries, 10))
        assert found(ranker(grown, queries, 10)) == want
    for ranker in (rank.vsm, rank.bm25):
        assert found(ranker(grown, queries, 10, pays=0)) == found(ranker(plain, queries, 10))
    assert found(rank.smart(grown, queries, 10, "Lpc", "apc")) == found(rank.smart(plain, queries, 10, "Lpc", "apc"))
    assert sorted(positional.phrase_hits(grown, queries).collect()) == sorted(positional.phrase_hits(plain, queries).collect())
    typo = spark.createDataFrame([(0, "z3000 u5122")], "qid int, text string")
    assert sorted(correction.suggestions(grown, typo).collect()) == sorted(correction.suggestions(plain, typo).collect())
    one = grown.save(str(tmp_path / "one"))
    assert len(one.segments) == 1 and found(rank.bm25(one, queries, 10, pays=0)) == found(rank.bm25(plain, queries, 10))
    monkeypatch.setattr(rank, "MOST_KNOWN", 3)
    batch = rank.analyzed(spark.createDataFrame(list(enumerate(QUERIES)), "qid int, text string"))
    assert found(rank.bm25(grown, batch)) == found(rank.bm25(plain, queries))


def test_bounds_hold_under_another_mean(grown):
    """A segment's greatest saturation bounds its postings' under the mean length of all."""
    from quillsift.functions import weighting

    now = grown.postings.select("term", "part", weighting.bm25_saturation(F.col("tf"), F.col("dl"), F.lit(grown.size[1])).alias("x"))
    most = grown.blocks.groupBy("term", "part").agg(F.max("most_bm25").alias("most"))
    assert now.join(most, ["term", "part"]).where(F.col("x") > F.col("most") + 1e-12).isEmpty() and len({s.avgdl for s in grown.segments}) == 3


def test_a_docid_is_added_once(grown, tables):
    with pytest.raises(ValueError):
        extend_index(grown, tables.where("docid = 3"))


def test_conjunctions_read_classes(index, queries, spark):
    """The other terms' postings are read in the rarest term's length classes alone, with the same result."""
    want = sorted((r.qid, r.docid) for r in positional.candidate_docs(index, queries).collect())
    assert sorted((r.qid, r.docid) for r in positional.conjunction(index, queries, pays=0).collect()) == want
    q = rank.analyzed(spark.createDataFrame([(0, "z300 z1 z2")], "qid int, text string"))
    rarest = rank.matched(index, spark.createDataFrame([(0, "z300")], "qid int, term string"), q, "docid", "dl")
    reading = positional.classes_read(index, q, rarest, spark.createDataFrame([(0, "z1"), (0, "z2")], "qid int, term string"))
    assert 0 < reading.read < 0.7 * reading.of


def test_counts_of_near_pairs(tables, queries, spark):
    """Evidence from stored counts is that from places, for pairs of two, one or no common term; for the former
    no places are read."""
    some = build_index(tables.where("docid % 2 = 0"), common=60, classes=4, part_rows=64)
    some = extend_index(some, tables.where("docid % 2 = 1"), common=60, part_rows=64)
    rows = lambda: sorted(rank.sdm_evidence(some, queries).collect())
    want = rows()
    assert any(r.ordered for r in want) and any(not r.unordered for r in want) and not some.has(rank.BIGRAMS)
    rank.near_pairs(some, common=100)
    assert some.has(rank.BIGRAMS) and rows() == want
    held = {r.term for r in some.derived(rank.BIGRAM_TERMS, lambda: None, "term", "term").collect()}
    assert held == {r.term for r in some.terms.where("df >= 100").collect()} and {"z1", "z2", "z3"} <= held
    q = rank.analyzed(spark.createDataFrame([(0, "z1 z2 z3")], "qid int, text string"))
    read = rank.sdm_evidence(some, q)
    read.collect()
    node, todo, placed = read._jdf.queryExecution().executedPlan().executedPlan(), [], 0
    todo.append(node)
    while todo:
        x = todo.pop()
        if x.nodeName().startswith("Scan parquet") and "positions" in x.schema().simpleString():
            placed += x.metrics().apply("numOutputRows").value()
        todo += [x.children().apply(i) for i in range(x.children().size())] + ([x.plan()] if x.nodeName().endswith("QueryStage") else [])
    assert placed == 0
    assert found(rank.sdm(some, queries)) and len(rank.sdm_evidence(some, q).collect()) > 0


def test_long_texts_by_slices(tables, index, queries, spark, monkeypatch):
    """Texts cut into many slices: the same words at the same places, the same snippets."""
    from quillsift.functions import text

    full = [r.full for r in tables.select(text.full_text().alias("full")).limit(50).collect()] + ["é" * 30 + "a" * 30 + "🙂 b", "x", "  " * 30]
    df = spark.createDataFrame([(x,) for x in full], "full string")
    for n in (1, 7, 20):
        cut = df.select("full", text.slices(F.col("full"), n).alias("s")).collect()
        assert all("".join(r.s) == r.full and WORD.findall(r.full) == [w for p in r.s for w in WORD.findall(p)] for r in cut)
    results = spark.createDataFrame([(q, d) for q in range(4) for d in range(0, 1500, 150)], "qid int, docid long")
    want = sorted(snippets.snippets(index, results, queries).collect())
    monkeypatch.setattr(text, "SLICE", 40)
    cut = build_index(tables.where("docid % 5 = 0"))
    places = lambda i: sorted(tuple(r) for r in i.postings.where("docid % 5 = 0").select("term", "docid", "tf", "positions", "dl").collect())
    assert places(cut) == places(index)
    assert sorted(snippets.snippets(index, results, queries).collect()) == want


def test_a_document_of_millions_of_words(spark):
    """Its words never are in one row."""
    docs = spark.range(1).select(F.col("id").alias("docid"), F.lit("").alias("category"), F.lit("long").alias("title"), F.repeat(F.lit("alpha beta gamma9 "), 700_000).alias("text"))
    index = build_index(docs)
    assert {(r.term, r.tf, r.positions[-1]) for r in index.postings.where("term <> 'long'").collect()} == {("alpha", 700_000, 2_099_998), ("beta", 700_000, 2_099_999), ("gamma9", 700_000, 2_100_000)}
    assert index.size == (1, 2_100_001.0)


def test_an_index_may_be_moved(tables, queries, spark, tmp_path):
    """And its path may be a relative one, or say its file system."""
    import os
    import shutil

    there = os.path.relpath(tmp_path / "one", spark._jvm.java.lang.System.getProperty("user.dir"))
    made = build_index(tables.limit(100), there)
    assert (tmp_path / "one" / "postings" / "_SUCCESS").exists()
    want = found(rank.bm25(made, queries))
    shutil.move(tmp_path / "one", tmp_path / "two")
    assert want and found(rank.bm25(load_index(spark, f"file://{tmp_path}/two"), queries)) == want


def test_large_collections_go_in_rounds(tables, index, queries, spark, monkeypatch, tmp_path):
    """A share of the documents is shuffled at a time, with the same tables, whether words are broadcast or not; no
    shuffle files stay behind."""
    from quillsift.operators import index as module
    from quillsift.plans import storage

    monkeypatch.setattr(module, "ROUND_CHARS", 100_000)
    monkeypatch.setattr(module, "ROUND_ROWS", 10_000)
    monkeypatch.setattr(rank, "ROUND_ROWS", 10_000)
    rows = lambda t: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in t.collect())
    for most in (1_000_000, 10):
        monkeypatch.setattr(storage, "MOST_BROADCAST", most)
        path = tmp_path / f"most{most}"
        cut = build_index(tables, str(path), common=100, classes=8, part_rows=64)
        files = list((path / "postings").glob("*.parquet"))
        assert len(files) > cut.segments[0].buckets  # a file for each bucket and round
        for name in ("terms", "doc_stats", "postings", "blocks", "title_postings"):
            assert rows(getattr(cut, name)) == rows(getattr(index, name)), name
        want = sorted(rank.sdm_evidence(cut, queries).collect())
        rank.near_pairs(cut, common=100)
        assert len(list((path / rank.BIGRAMS).glob("*.parquet"))) > 1 and sorted(rank.sdm_evidence(cut, queries).collect()) == want
    assert spark.conf.get(storage.CLEANUP) == "false"


def test_only_evidence_needs_near_pairs(spark):
    """Counts of near pairs are many times the collection: an index that grew has none before evidence asks for them."""
    from quillsift.plans import queries as registered

    path = "/root/testdata/sf0.001"
    registered.grown_search_bm25(spark, path).collect()
    grown = registered.grown(spark, path)
    assert not grown.has(rank.BIGRAMS)
    registered.grown_sdm_evidence(spark, path).collect()
    assert grown.has(rank.BIGRAMS)


def test_documents_rows_go_when_postings_are_there(tables, grown, queries, spark, tmp_path):
    """An index keeps no second copy of its postings, nor the words that it was built with; what grows of it and what is
    saved of that have what they need."""
    first = build_index(tables.where("docid % 2 = 0"), str(tmp_path / "first"), common=100, classes=8, part_rows=64)
    both = extend_index(first, tables.where("docid % 2 = 1"), str(tmp_path / "both"), common=100, part_rows=64)
    saved = both.save(str(tmp_path / "saved"))
    for name in ("first", "both", "saved"):
        assert {p.name for p in (tmp_path / name).iterdir()} == {"docs", "postings", "blocks", "title_postings", "terms", "doc_stats", "collection"}, name
    rows = lambda t: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in t.collect())
    for i in (both, saved):
        assert rows(i.doc_stats) == rows(grown.doc_stats) and rows(i.terms) == rows(grown.terms)
        assert found(rank.bm25(i, queries)) == found(rank.bm25(grown, queries))


def test_shares_of_documents_chosen_by_a_hash(spark):
    """Documents that came in two lots by a hash of docid go in as many rounds as any others."""
    from quillsift.operators.index import shares

    lot = spark.range(2000).select(F.col("id").alias("docid")).where(F.pmod(F.xxhash64("docid"), F.lit(2)) == 1)
    counts = [s.count() for s in shares(lot, 8)]
    assert sum(counts) == lot.count() and min(counts) > 60


def test_postings_hold_nothing_of_their_documents(tables, index, spark, tmp_path):
    """A document's length and norm are stored once: repeated in each posting they were as large as the postings in
    files of very many documents. Postings have them when asked."""
    path = str(tmp_path / "index")
    some = build_index(tables, path, common=100, classes=8, part_rows=64)
    assert spark.read.parquet(f"{path}/postings").columns == ["slot", "term", "part", "docid", "tf", "positions"]
    dl, tf = {}, {}
    for d, _, title, text in DOCS:
        words = [w for w in re.findall("[a-z0-9]+", f"{title}. {text}".lower()) if w not in STOPWORDS]
        dl[d], tf[d] = len(words), {}
        for w in words:
            tf[d][w] = tf[d].get(w, 0) + 1
    norm = {d: math.sqrt(sum((1 + math.log10(n)) ** 2 for n in of.values())) for d, of in tf.items()}
    rows = some.postings.select("docid", "term", "tf", "dl", "lnc").where("docid % 50 = 0").collect()
    assert len(rows) == sum(len(of) for d, of in tf.items() if d % 50 == 0)
    assert all(r.dl == dl[r.docid] and abs(r.lnc - (1 + math.log10(r.tf)) / norm[r.docid]) < 1e-12 for r in rows)
    assert "lnc" not in some.entries.columns and some.with_docs(some.entries, "docid", "tf") is some.entries


def test_words_are_stemmed_only_where_unknown(spark):
    """Of a vocabulary too large to be broadcast: the steps are one expression behind the known stems, as columns they
    were computed for every word."""
    from quillsift.functions.stemming import stems_of, with_stems

    words = [f"{a}{b}{c}" for a in ("relat", "hopp", "fil", "tr", "control", "conflat", "agre", "y", "sky", "a") for b in ("", "ion", "al", "iz", "at", "ful", "l") for c in ("", "s", "ed", "ing", "eed", "ies", "y", "e", "ness", "ly")]
    raw = spark.createDataFrame([(w,) for w in [*words, "is", "a1", "2000"]], "raw string").distinct()
    want = sorted(stems_of(raw).collect())
    for some in (0, 50):
        got = with_stems(raw, spark.createDataFrame(want[:some], "raw string, term string"), False)
        assert sorted(got.select("raw", "term").collect()) == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "AS cut" not in plan and "AS w#" not in plan


def test_rows_by_document_repeat_no_weight(tables, spark, tmp_path):
    """What hangs on a document alone is one value in all of its rows, which files store as a run; a weight in each row was
    a tenth of their bytes."""
    from quillsift.operators.index import write_documents

    _, rows = write_documents(tables, str(tmp_path / "index"))
    table = spark.read.parquet(*rows)
    assert table.columns == ["docid", "term", "tf", "positions", "dl", "norm"]
    assert table.groupBy("docid").agg(F.count_distinct("dl", "norm").alias("n"), F.sum("tf").alias("tf"), F.first("dl").alias("dl")).where("n <> 1 or tf <> dl").isEmpty()


def test_frequencies_are_added_up_share_by_share(tables, index, spark, monkeypatch, tmp_path):
    """Terms of all shares were shuffled at once, the most that lay on disk at a time."""
    from quillsift.operators import index as module

    monkeypatch.setattr(module, "ROUND_CHARS", 1 << 15)
    written, write_table = [], module.write_table
    monkeypatch.setattr(module, "write_table", lambda parts, path: (written.append(path), write_table(parts, path)))
    for name, lot in (("first", tables.where("docid % 2 = 0")), ("both", tables.where("docid % 2 = 1"))):
        del written[:]
        path = str(tmp_path / name)
        built = build_index(lot, path, common=100, classes=8, part_rows=64) if name == "first" else extend_index(built, lot, path, common=100, part_rows=64)
        shares = [p for p in written if "/forward/" in p]
        assert len([p for p in written if "/counted/" in p]) == len(shares) > 3
        assert not (tmp_path / name / "counted").exists()
    assert sorted(built.terms.collect()) == sorted(index.terms.collect())
    assert built.terms.schema == index.terms.schema


ODD = ["", None, "   ", "The \u212aelvin \u0130stanbul caf\u00e9s x-ray running\nRUNNERS 007 a", "\U0001f642relational\u00e9hoping hopping\x00skies", "the of and", "ties " * 300, "y" * 500 + " Zed"]


def texts_by_words(module, docs, monkeypatch, path):
    from quillsift.functions import text

    with monkeypatch.context() as m:
        m.setattr(text, "SLICE", 0)
        return module.build_index(docs, path)


def test_ordinary_texts_have_no_row_for_each_word(spark, monkeypatch, tmp_path):
    """They become rows by document in batches; long ones, and texts with one docid, word by word, with the same rows."""
    from quillsift.operators import index as module

    docs = spark.createDataFrame([(i, "Cat s", None if i % 3 else "a Title", t) for i, t in enumerate(ODD)], FIELDS)
    want = texts_by_words(module, docs, monkeypatch, str(tmp_path / "words"))
    rows = lambda t: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in t.collect())
    with monkeypatch.context() as m:
        m.setattr(module, "document_rows", None)
        got = build_index(docs, str(tmp_path / "batches"))
    for name in ("postings", "title_postings", "terms", "doc_stats"):
        assert rows(getattr(got, name)) == rows(getattr(want, name)) and getattr(got, name).schema == getattr(want, name).schema, name
    assert {r.term for r in got.terms.collect()} >= {"elvin", "stanbul", "caf", "relat", "hope", "hop", "run", "runner", "007", "ti"}


def test_texts_with_one_docid_have_one_row_for_each_term(spark):
    docs = spark.createDataFrame([(1, "c", "", "alpha beta"), (1, "c", "", "alpha"), (2, "c", "", "beta"), (None, "c", "", "beta beta")], FIELDS)
    assert sorted((r.docid or 0, r.term, r.tf) for r in build_index(docs).entries.collect()) == [(0, "beta", 2), (1, "alpha", 2), (1, "beta", 1), (2, "beta", 1)]


def test_length_classes_by_halves(spark):
    """31 comparisons for each posting, several times in a stage, were more code than the JVM compiles."""
    from bisect import bisect_left

    from quillsift.operators.index import length_class

    for bounds in ([], [3], [1, 4, 9], sorted(random.Random(3).sample(range(500), 31))):
        rows = spark.range(510).select("id", length_class(F.col("id"), bounds).alias("c"))
        assert [r.c for r in rows.orderBy("id").collect()] == [bisect_left(bounds, i) for i in range(510)]
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(">") == len(bounds)
