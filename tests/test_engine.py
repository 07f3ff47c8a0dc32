"""A small collection with expectations computed by hand."""

import math

import pytest

from quillsift.cli import Console
from quillsift.functions.weighting import check_scheme
from quillsift.operators import correction, evaluation, positional, rank
from quillsift.plans.engine import SearchEngine
from quillsift.sources import collections, sinks

DOCS = [
    ("D1", "Shirt", "Owl's Painted Cotton Shirt - Black", "Owl's Painted Cotton Shirt - Black. Sewn from yarn, this shirt is for everyday walks. It has pockets on both sides."),
    ("D2", "Shirt", "", "cotton x x shirt all"),
    ("D3", "Shirt", "", "shirt x cotton y y y y shirt all"),
    ("D4", "Twin", "Twin", "winter jacket winter jacket all"),
    ("D5", "Twin", "Twin", "winter jacket winter jacket all"),
    ("D6", "None", "", "the of and"),
    ("D7", "Cap", "Crew cap", "Été 100% cotton, this t-shirt a b c d e f g h i j k l m n o p q r s leg all"),
    ("D8", "", "", ""),
]


@pytest.fixture(scope="module")
def engine(spark):
    return SearchEngine.from_documents(spark.createDataFrame(DOCS, "docid string, category string, title string, text string"))


def one(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


def test_collection(engine):
    assert engine.index.size[0] == 8
    lengths = dict(one(engine.index.doc_stats, "docid", "dl"))
    assert lengths["D6"] == lengths["D8"] == 0 and lengths["D2"] == 5
    assert engine.index.size[1] == sum(lengths.values()) / 8
    df = dict(one(engine.index.terms, "term", "df"))
    assert df["all"] == 5 and df["cotton"] == 4 and "the" not in df


def test_phrase_crosses_title_and_stopwords(engine):
    found = {r.docid: r.match_positions for r in engine.search_phrase("cotton shirt").collect()}
    assert found == {"D1": [3, 9]}
    assert {r.docid: r.match_positions for r in engine.search_phrase("shirt everyday").collect()} == {"D1": [14]}
    assert engine.search_phrase("the").count() == 0
    assert engine.search_phrase("cotton zzqqx").count() == 0


def test_proximity(engine):
    ordered = {r.docid: [tuple(p) for p in r.match_positions] for r in engine.search_proximity("cotton", "shirt", 3).collect()}
    assert ordered["D2"] == [(0, 3)] and "D3" not in ordered and ordered["D7"] == [(4, 6)]
    both = {r.docid: [tuple(p) for p in r.match_positions] for r in engine.search_proximity("cotton", "shirt", 2, ordered=False).collect()}
    assert both["D3"] == [(2, 0)]
    assert engine.search_proximity("cotton", "shirt", 0).count() == 0
    same = {r.docid: [tuple(p) for p in r.match_positions] for r in engine.search_proximity("winter", "winter", 2, ordered=False).collect()}
    assert same["D4"] == [(1, 3), (3, 1)]
    k1 = {(h.docid, h.start) for h in positional.phrase_hits(engine.index, engine.queries("winter jacket")).collect()}
    pairs = engine.index.spark.createDataFrame([(0, "winter", "jacket", 1)], "qid int, term_a string, term_b string, k int")
    assert k1 == {(h.docid, h.pa) for h in positional.proximity_hits(engine.index, pairs).collect()}


def test_ties_by_docid(engine):
    for search in (engine.search_vsm, engine.search_bm25, engine.search_sdm, engine.search_fielded):
        assert one(search("winter jacket"), "docid")[:2] == ["D4", "D5"]


def test_smart_equals_vsm(engine):
    q = ["cotton shirt men", "winter jacket", "all zzqqx leg"]
    a = {(r.qid, r.docid): r.score for r in rank.vsm(engine.index, engine.queries(q)).collect()}
    b = {(r.qid, r.docid): r.score for r in rank.smart(engine.index, engine.queries(q)).collect()}
    assert a.keys() == b.keys() and all(math.isclose(a[k], b[k]) for k in a)


def test_boost(engine):
    plain = dict(one(rank.vsm(engine.index, engine.queries("cotton shirt"), 200), "docid", "score"))
    for r in rank.fielded(engine.index, engine.queries("cotton shirt")).collect():
        hits = {"D1": 2, "D2": 1, "D3": 1}.get(r.docid, 0)
        assert math.isclose(r.score, plain[r.docid] * 1.5**hits)


def test_sdm_keeps_candidates_without_hits(engine):
    found = {r.docid: (r.ordered, r.unordered) for r in engine.sdm_evidence("cotton shirt").collect()}
    assert found["D1"][0] == 2 and found["D2"] == (0, 1) and found["D7"] == (1, 1)
    assert found["D3"] == (0, 1)
    assert engine.sdm_evidence("cotton zzqqx shirt").count() == 0  # an unknown term parts its neighbours


def test_schemes():
    for bad in ("ln", "lncx", "xnc", "lxc", "lnx"):
        with pytest.raises(ValueError):
            check_scheme(bad)


def test_correction(engine):
    q = engine.queries("coton shrit zzqqxzz")
    fixed = {r.term: (r.suggestion, r.distance) for r in correction.suggestions(engine.index, q).collect()}
    assert fixed == {"coton": ("cotton", 1), "shrit": ("shirt", 2)}
    assert one(correction.corrected(engine.index, q), "text") == ["cotton shirt zzqqxzz"]


def test_snippets(engine):
    s = {r.docid: r.snippet for r in engine.search_vsm("leg").collect()}
    assert s["D7"].startswith("…") and s["D7"].endswith("**leg** al…")
    s = {r.docid: r.snippet for r in engine.search_phrase("cotton shirt").collect()}
    assert s["D1"].startswith("Owl's Painted **Cotton** **Shirt** - Black. Owl's") and s["D1"].endswith("…")


def test_badges(engine):
    found = {r.docid: r.rank_shift for r in engine.search_phrase("all").collect()}
    assert found["D2"] in ("=", "^1", "v1") or found["D2"][0] in "^v"
    every = engine.index.spark.createDataFrame([(f"E{i}", "c", "t", "wear it") for i in range(3)], "docid string, category string, title string, text string")
    e = SearchEngine.from_documents(every)
    assert {r.rank_shift for r in e.search_phrase("wear").collect()} == {"NEW"}  # idf 0: VSM finds nothing
    assert e.search_vsm("wear").count() == 0 and e.search_bm25("wear").count() == 3


def test_ndcg_golden(spark):
    grades = [3, 3, 3, 2, 2, 2, 3, 3, 2, 2]
    lists = spark.createDataFrame([("r", 0, i + 1, i) for i in range(10)], "ranker string, qid int, rank int, docid int")
    judged = spark.createDataFrame([(0, i, g) for i, g in enumerate(grades)], "qid int, docid int, grade int")
    r = evaluation.ndcg(lists, judged).first()
    assert round(r.ndcg_at_10, 4) == 0.9735 and round(r.ndcg_at_5, 4) == 0.8416
    assert evaluation.ndcg(lists, judged.where("false")).first().ndcg_at_10 == 0


def test_report(engine):
    r = engine.ndcg_report("cotton shirt", custom=("lnc", "ltc")).collect()
    assert len(r) == 5 and all(0 <= x.ndcg_at_5 <= 1 and 0 <= x.ndcg_at_10 <= 1 for x in r)


def test_batch_is_union_of_singles(engine):
    q = ["cotton shirt", "winter jacket", "leg"]
    batch = {(r.qid, r.docid, r.rank) for r in rank.bm25(engine.index, engine.queries(q)).collect()}
    singles = {(i, r.docid, r.rank) for i, x in enumerate(q) for r in rank.bm25(engine.index, engine.queries(x)).collect()}
    assert batch == singles


def test_tagged_file(spark, tmp_path):
    text = "\n<DOC>\n<DOCID> 7 </DOCID>\n<CATEGORY>c</CATEGORY>\n<TITLE>t\n</TITLE>\n<TEXT> a\nb </TEXT>\n</DOC>\n<DOC><DOCID>8</DOCID><TITLE>x</TITLE></DOC>\n"
    (tmp_path / "c.txt").write_text(text, encoding="utf-8")
    assert [tuple(r) for r in collections.tagged_documents(spark, str(tmp_path / "c.txt")).collect()] == [("7", "c", "t", "a\nb")]


def test_duplicate_ids(spark):
    twice = spark.createDataFrame([("a", "", "", "x")] * 2, "docid string, category string, title string, text string")
    with pytest.raises(ValueError):
        collections.checked(twice)


def test_dumps(engine, tmp_path):
    sinks.dump_index(engine.index, str(tmp_path / "i"))
    lines = "\n".join(p.read_text() for p in sorted((tmp_path / "i").glob("part-*"))).split("\n")
    assert lines[0].startswith("INVERTED INDEX  (N=8 documents") and "jacket          df=2    -> [(D4,2), (D5,2)]" in lines
    sinks.dump_index(engine.index, str(tmp_path / "p"), positional=True)
    assert "(D4,2,[2, 4])" in "".join(p.read_text() for p in (tmp_path / "p").glob("part-*"))


def test_saved_index(engine, spark, tmp_path):
    engine.index.save(str(tmp_path / "x"))
    again = SearchEngine.open(spark, str(tmp_path / "x"))
    assert one(again.search_bm25("cotton"), "docid", "score") == one(engine.search_bm25("cotton"), "docid", "score")


def test_long_dumps(engine, monkeypatch):
    """A term of many documents goes on in further lines; no posting is lost."""
    monkeypatch.setattr(sinks, "LINE_POSTINGS", 2)
    monkeypatch.setattr(sinks, "LINE_POSITIONAL", 2)
    for positional_ in (False, True):
        rows = [r for r in sinks.dump_lines(engine.index, positional_).orderBy("term", "line").collect() if r.term == "all"]
        text = "\n".join(r.value for r in rows)
        assert len(rows) > 1 and text.startswith("all ") and text.count("]" if not positional_ else "])") == (1 if not positional_ else 5)
        assert all(text.count(f"({d},") == 1 for d in ("D2", "D3", "D4", "D5", "D7"))


def test_long_dumps_are_one_value(engine, monkeypatch):
    """Dumps as a table hold one value a term, documents in order, also where a file has further lines for it."""
    want = [sorted(sinks.dump_values(engine.index, p).collect()) for p in (False, True)]
    monkeypatch.setattr(sinks, "LINE_POSTINGS", 2)
    monkeypatch.setattr(sinks, "LINE_POSITIONAL", 2)
    for positional_ in (False, True):
        assert sorted(sinks.dump_values(engine.index, positional_).collect()) == want[positional_]
        lines = [r.value for r in sinks.dump_lines(engine.index, positional_).where("term = 'all'").orderBy("line").collect()]
        value = next(r.value for r in want[positional_] if r.term == "all")
        assert len(lines) > 1 and "\n".join(lines).split() == value.split()


def test_dump_entry(spark, tmp_path):
    from quillsift import cli

    docs = spark.createDataFrame([(1, "first words here", "s"), (2, "second words", None)], "doc_id long, text string, source string")
    docs.write.parquet(str(tmp_path / "d.parquet"))
    cli.main(["--documents", str(tmp_path / "d.parquet"), "--dump", str(tmp_path / "out")])
    lines = "\n".join(p.read_text() for p in sorted((tmp_path / "out" / "inverted_index").glob("part-*")))
    assert lines.startswith("INVERTED INDEX  (N=2 documents") and "word            df=2    -> [(1,2), (2,2)]" in lines
    assert "(1,2,[" in "".join(p.read_text() for p in (tmp_path / "out" / "positional_index").glob("part-*"))


def test_own_highlighter(engine):
    from pyspark.sql import functions as F

    from quillsift.operators.snippets import snippets

    found = rank.vsm(engine.index, engine.queries("leg"))
    s = {r.docid: r.snippet for r in snippets(engine.index, found, engine.queries("leg"), mark=lambda w: F.concat(F.lit("<"), F.upper(w), F.lit(">"))).collect()}
    assert "<LEG>" in s["D7"]


def test_markdown_says_what_is_left_out(spark):
    df = spark.range(5)
    assert sinks.markdown(df).count("\n") == 6 and "more" not in sinks.markdown(df)
    assert "The first 3 rows; there are more." in sinks.markdown(df, most=3)


def test_scans_are_pruned(engine):
    """Searches of few words read the postings of their terms, batches of many words are joined."""
    q = engine.queries("cotton shirt")
    for found in (rank.vsm(engine.index, q), rank.bm25(engine.index, q), rank.sdm(engine.index, q), rank.smart(engine.index, q, 10, "anc", "apc"), positional.phrase_hits(engine.index, q)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in plan.split("PushedFilters: [")[1:] if "struct<term:string" in x.split("ReadSchema")[1][:60]]
        assert scans and all("In(term, [cotton,shirt])" in x for x in scans)
    many = engine.index.spark.range(rank.MOST_KNOWN + 10).selectExpr("CAST(id AS int) AS qid", "concat('cotton t', id) AS text")
    batch = rank.analyzed(many)
    assert batch.known is None and rank.bm25(engine.index, batch).where("qid < 3").count() == 3 * rank.bm25(engine.index, engine.queries("cotton")).count()
    assert rank.analyzed(batch) is batch


def test_one_ranking_for_all_that_build_on_it(engine):
    r = {x.ranker: list(x.ranked_docids) for x in engine.ndcg_report("cotton shirt").collect()}
    assert r["VSM (lnc.ltc)"] == one(engine.search_vsm("cotton shirt"), "docid") and r["SDM"] == one(engine.search_sdm("cotton shirt"), "docid")
    assert r["Title-boosted VSM"] == one(engine.search_fielded("cotton shirt"), "docid")


def test_console(engine):
    asked = ["find coton shirt", "phrase winter jacket", "near cotton shirt", "near cotton shirt 1", "judge leg", "3", "scheme xxx ltc", "scheme bnn btn", "find", "nonsense", "judge zzqqx", "near cotton", "quit"]
    answers, said = iter(asked), []
    Console(engine, lambda _: next(answers, "quit"), said.append).run()
    text = "\n".join(map(str, said))
    assert "coton -> cotton" in text and "at 1, 3" in text and "not done: unknown scheme" in text and "scheme bnn.btn" in text and "| ranker |" in text
    assert "no model finds a document" in text and text.count("near A B") >= 3
