"""op11 against regular expressions and slices."""

import hashlib
import re

import pytest
from compare import rows
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from quillsift.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def words(text):
    return WORD.findall((text or "").translate(LOW))


def windows(text):
    w = words(text)
    n = min(len(w), decontaminate.WINDOW)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def plain(docs, items):
    """doc_id, the six columns' values, and the words hit."""
    of = [("" if i is None else str(i), windows(t)) for i, t in items]
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, wins in of:
            for n in {len(x) for x in wins}:
                for i in range(len(w) - n + 1):
                    if tuple(w[i : i + n]) in wins:
                        hit.update(range(i, i + n))
                        found.add(item)
        yield doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


ITEMS = [
    (1, "What is the Capital of France? It is Paris, of course, as everyone well knows."),
    (2, "two words"),
    (10, "Überfällig: ÄRGER, naïve café — déjà vu, jamais vu, presque vu; one-two three four five six"),
    (3, "a a a a a a a a a a a a"),
    (3, "another text under the same id as before with some more words"),
    (None, "an item without id that has more than ten words in it"),
    (4, None),
    (5, "?!"),
    (6, "TWO words"),
]
DOCS = [
    (1, "x What is the capital of FRANCE it is paris of course as everyone! y"),
    (1, "x What is the capital of FRANCE it is paris of course as everyone! y"),
    (2, "two-words, two\twords; two worlds"),
    (3, "a " * 30),
    (4, None),
    (5, ""),
    (None, "an ITEM without id that has more than ten words in it, an item"),
    (6, "überfällig: Ärger"),
    (7, "Überfällig: ÄRGER, naïve café — déjà vu, jamais vu, presque vu; one-two"),
    (8, " ".join(f"w{i}" for i in range(200_000)) + " two words"),
    (9, " .,; two words"),
    (10, "xtwo wordsx two  words"),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(*r, "clash") for r in DOCS], "doc_id long, text string, n_words string")
    return docs.repartition(3), spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("block_chars", [decontaminate.BLOCK_CHARS, 300])
def test_plain(tables, block_chars):
    """In one automaton, or in blocks."""
    docs, items = tables
    found = decontaminate.contamination(docs, items, block_chars)
    got = [(r.doc_id, r.n_words, sum(s.end_word - s.start_word for s in r["spans"]), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), bool(r["items"])) for r in found.collect()]
    assert rows(COLUMNS, got) == rows(COLUMNS, plain(DOCS, ITEMS))


def test_report_on_documents(spark):
    docs, items = (spark.read.parquet(f"{DATA}/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    want = list(plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()]))
    assert any(r[5] for r in want) and not all(r[5] for r in want)
    assert rows(COLUMNS, decontaminate.report(docs, items).select(COLUMNS).collect()) == rows(COLUMNS, want)


def test_offsets(tables):
    """Spans name the same words in the original as in the normalised text."""
    docs, items = tables
    for r in docs.join(decontaminate.contamination(docs.dropDuplicates(["doc_id"]), items).select("doc_id", "spans"), "doc_id").collect():
        for s in r["spans"]:
            piece = r.text[s.start_char : s.end_char]
            assert words(piece) == words(r.text)[s.start_word : s.end_word] and WORD.match(piece.translate(LOW)) and WORD.match(piece[-1].translate(LOW))


def test_empty_tables(tables, spark):
    docs, items = tables
    assert decontaminate.report(docs.limit(0), items).collect() == []
    assert {(r.n_hit, r.n_items, r.contaminated) for r in decontaminate.report(docs, items.limit(0)).collect()} == {(0, 0, False)}


def test_string_ids(tables):
    docs, items = tables
    found = decontaminate.report(docs.withColumn("doc_id", docs.doc_id.cast("string")), items)
    assert dict(found.dtypes)["doc_id"] == "string" and {r.doc_id for r in found.collect()} >= {"1", None}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab ,É-", max_size=40), min_size=1, max_size=4), st.text("ab ,É-", max_size=120))
def test_any_text(items, text):
    """The automaton over short alphabets, where windows overlap in all ways."""
    named = [(str(i), t) for i, t in enumerate(items)]
    automaton = decontaminate.automaton_of([(w, i) for i, t in named for w in decontaminate.windows(t)])
    ranges, found = decontaminate.occurrences(decontaminate.normalised(text)[0], automaton)
    want = next(plain([(0, text)], named))
    assert (sum(b - a for a, b in ranges), len(found)) == (want[2], want[3])
