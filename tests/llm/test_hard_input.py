"""Damaged markup, long runs of characters, several texts under one id."""

import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillsift.llm import html_extract, jaccard, mixing, packing, suffixes, warc
from quillsift.llm.runtime import split_by_bitmap

PIECES = ["<", ">", "</", "<!--", "-->", "<![", "]]>", "<!", "<?", "&", "&#", "&#x41;", "&amp;", ";", '"', "'", "=", "/", " ", "\n", "a", "p", "div", "script", "<p>", "</p>", "<script>", "</script>", "<a href=", "class=ad", "9" * 20, "text"]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<p>a <![ b</p>c", "a c"), ("<![foo[ x ]]>y", "y"), ("<![]>z", "z"), ("<![%foo;[z]]>q", "q"), ("a <![ b", "a <![ b"), ("a <b c", "a <b c"), ('<a x="1>2">t</a>', "t"),
        ("x<!-- never <p>yes</p>", "xyes"), ("<!-- a > b -->c", "c"), ("<!-->c", "c"), ("a<!doctype html>b", "ab"), ("a<?php > ?>b", "a ?>b"), ("</>e</ f>g", "eg"), ("1 < 2", "1 < 2"),
        ("<script>if (a<b) x</script>t<style>u", "t"), ('<p title="a>b">c', "c"), ("&#" + "9" * 5000 + ";x", "�x"), ("&#65;&#x42;&copy;&nosuch;", "AB©&nosuch;"), ('<b x="1>t', "t"), ("<P CLASS='Ad'>no</P>yes", "yes"),
    ],
)
def test_damaged_markup(html, text):
    assert html_extract.main_text(html) == text


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=30))
def test_any_markup(pieces):
    html = "".join(pieces)
    found = html_extract.main_text(html)
    assert found == html_extract.main_text(html) and not set(" \n\t") & {found[:1], found[-1:]}
    html_extract.counted_hashes(html)


@pytest.mark.parametrize("piece", ["<!--", "<a ", "<![", '<a x="', "</", "<?", "</a ", "<p><a href='", "&#", "<script>", "<b a=1 "])
def test_repeated_markup_is_linear(piece):
    """Eight times the page takes about eight times as long, not 64 times."""

    def took(n, tail):
        t = time.perf_counter()
        html_extract.main_text(piece * n + tail)
        return time.perf_counter() - t

    for tail in ("", ">", "x -->", '"'):
        took(1000, tail)
        assert took(200_000, tail) < max(2.0, 24 * took(25_000, tail)), (piece, tail)


def test_long_runs():
    """tiktoken alone would end the process on some of these."""
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    whole, encode = Tokenizer.from_file(path), packing.encoder(path)
    assert encode.fast is not None
    for text in (" " * 5_000_000, "\n" * 1_000_000 + "x", "a" * 1_000_000, "x" + " \t" * 500_000 + "y", "1" * 300_000, "é" * 300_000, "　" * 300_000, "ab " * 30_000 + " " * 70_000, " " * (packing.LONG_RUN - 1) + "a"):
        assert encode(text) == whole.encode(text, add_special_tokens=False).ids, text[:5]
    assert packing.longest_run("ab  c") == 2 and packing.longest_run("") == 0 and packing.longest_run(" " * 9) == 9


def test_pack_long_run(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000 + "a"), (2, "b")], "doc_id long, text string")
    found = packing.pack(docs).collect()
    assert Counter(r.doc_id for r in found)[2] == 1 and sum(r.length for r in found if r.doc_id == 1) == len(packing.encoder(packing.default_tokenizer())(" " * 1_000_000 + "a")) + 1


A, B, C = (" ".join(f"{x}{i}" for i in range(100)) for x in "abc")
NEAR_B = B.replace("b50 ", "other ")


def test_keep_one_of_several_texts(spark):
    """A document is an id with a text: one of each group stays, whatever other text its id has."""
    for rows, want in [
        ([(0, B), (1, A), (1, B)], {(0, B), (1, A)}),
        ([(0, B), (0, NEAR_B), (1, NEAR_B)], None),
        ([(1, A), (1, B), (2, A), (2, B), (3, C)], {(1, A), (1, B), (3, C)}),
        ([(1, A), (1, A), (1, A), (2, "")], {(1, A), (2, "")}),
        ([(5, None), (5, ""), (5, "one"), (6, "ONE")], {(5, None), (5, ""), (5, "one")}),
        ([(None, A), (None, A), (1, A)], None),
    ]:
        docs = spark.createDataFrame([(i, t, "l", 1, "k") for i, t in rows], "doc_id long, text string, stays string, rows int, group string").repartition(3)
        kept = jaccard.keep_one(docs)
        got = [(r.doc_id, r.text) for r in kept.collect()]
        assert kept.columns == docs.columns
        if want is not None:
            assert len(got) == len(want) and set(got) == want
        elif rows[0][0] is None:
            assert Counter(got) == {(None, A): 2, (1, A): 1}
        else:
            assert len(got) == 1 and got[0][0] == 0


def test_bitmap(spark):
    """No row with a partner is told apart, most others are; null and string keys."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 7 > 0, F.col("id")).alias("a"), F.col("id").cast("string").alias("b"))
    among = rows.where("b % 10 = 0").select(F.col("a").alias("x"), F.col("b").alias("y"))
    apart, unsure = split_by_bitmap(rows, among, [F.col("a"), F.col("b")], [F.col("x"), F.col("y")])
    assert apart.columns == rows.columns and apart.count() + unsure.count() == 20_000
    assert apart.where("b % 10 = 0").count() == 0 and 2000 <= unsure.count() < 2100
    assert split_by_bitmap(rows, among.limit(0), [F.col("a")], [F.col("x")])[1].count() == 0


def test_copies_under_the_bitmap(spark):
    """Rows without copies stay as they are, the others lose them, as a plain join says."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, f"{A} {passage}"), (2, f"{passage} {B}"), (2, C), (3, None), (None, passage), (4, f"x {passage} y")]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {(r.doc_id, r.text, r.n_chars) for r in suffixes.without_copies(docs).collect()}
    assert got == {(1, f"{A} {passage}", len(f"{A} {passage}")), (2, B, len(B)), (2, C, len(C)), (3, None, 0), (None, passage, len(passage)), (4, "x y", 3)}


def test_registered_names():
    """A fault in the subpackage would drop its queries from the entry in silence."""
    import __spark_entry__ as entry

    assert {n.split("_")[0] for n in entry.queries() if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in entry.queries()
    assert {n for n in entry.oracle_sql() if n.startswith("op")} == {"op3_quality_rules", "op4_ngram_jaccard_join", "op6_suffix_dedup", "op9_warc_round_trip", "op11_benchmark_decontamination", "op12_source_divergence"}


def test_pages_without_id_are_responses(spark):
    """As documented: they revisit nothing, and nothing revisits them."""
    long = "<p>" + "x" * 1000
    got = warc.archive_round_trip(spark.createDataFrame([(None, "u", long), (None, "u", long), (3, "u", long), (7, "u", long)], "page_id long, url string, html string")).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter({(None, "response", None): 2, (3, "revisit", 7): 1, (7, "response", None): 1})


def test_very_many_rows_alike_in_a_mix(spark):
    """They are dealt out by numbers before they are told one by one; their sums stay."""
    docs = spark.createDataFrame([(1, "a b c", "s")], "doc_id long, text string, source string").withColumn("x", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("x")
    docs = docs.unionByName(spark.createDataFrame([(2, "d e", "t"), (None, None, None)], docs.schema))
    got = mixing.mix_report(docs).collect()
    assert Counter(r.doc_id for r in got) == {1: 3000, 2: 1, None: 1}
    assert abs(sum(r.taken for r in got if r.source == "s") - next(r.target for r in got if r.source == "s")) <= 3 and max(r.taken for r in got) <= 6
