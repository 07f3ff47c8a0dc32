"""Every operator on awkward rows (nulls, empty and long texts, ties, repeated rows, clashing extra
columns), on an empty table, and against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillsift.llm import html_extract, jaccard, langid, mixing, packing, quality, spotsigs, suffixes, textcore, toxicity, warc
from quillsift.llm.runtime import connected_components, read_table

from .conftest import PASSAGE, ROWS, STORY, row

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [(r[0], r[1]) for r in ROWS]


def words(t):
    return WORD.findall(t or "")


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect() if r.doc_id is not None}


# text core


@given(st.text())
@settings(max_examples=150, deadline=None)
def test_words_of_any_text(t):
    data = t.encode("utf-8", "surrogatepass")
    starts, ends, hashes = textcore.words_and_hashes(data)
    found = [data[s:e].decode("utf-8", "surrogatepass") for s, e in zip(starts, ends, strict=True)]
    assert found == words(t)
    assert [h == textcore.word_hashes(w.encode("utf-8", "surrogatepass"))[0] for h, w in zip(hashes, found, strict=True)] == [True] * len(found)


def test_long_texts_in_slices(monkeypatch):
    data = " ".join(f"w{i * i}" for i in range(500)).encode()
    whole = textcore.word_hashes(data)
    monkeypatch.setattr(textcore, "SLICE", 64)
    assert (textcore.word_hashes(data) == whole).all()


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2400)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in list(up) if any(x in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header>Site name</header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- ad --><div class="ad">Buy</div>
<article><h1>Title &amp; more</h1><p>First <b>bold</b>   para&nbsp;graph.<br>next<p>Second &#233;&eacute; &lt;b&gt;<ul><li>one<li>two</ul><aside>side</aside><form><input>form</form>
<div class="comments"><p>Nice post</p></div></article><div class="sidebar">Related</div><div>Template text</div><footer>&copy; x</footer></body></html>"""
MAIN = "Title & more\n\nFirst bold para graph. next\n\nSecond éé <b>\n\none\n\ntwo"


def test_main_text():
    assert html_extract.main_text(PAGE) == MAIN
    assert html_extract.main_text(None) == html_extract.main_text("") == ""
    assert html_extract.main_text("<p>a &amp;amp; b") == "a &amp; b"
    assert html_extract.main_text("<nav><a>x</a><article><p>kept</article>") == "kept"
    assert html_extract.main_text("<div>" * 3000 + "deep") == "deep"
    assert html_extract.main_text("<main><p>m</p><nav>x</nav></main><div>o</div>") == "m"


def test_templates_go(spark):
    page = lambda i: f"<body><div id=top><span>My site</span></div><div><p>Story {i} of the day</p></div><div><div>Terms</div></div></body>"
    rows = [(i, f"http://h.org/{i}", page(i), "x") for i in range(12)] + [(100, "http://other.org/", page(100), "x"), (101, None, None, "x"), (101, None, None, "x")]
    got = {r.page_id: (r.text, r.n_chars) for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()}
    assert got[3] == ("Story 3 of the day", 18)
    assert got[100][0] == "My site\n\nStory 100 of the day\n\nTerms" and got[101] == ("", 0)
    same = [(i, f"http://h.org/{i}", PAGE, "x") for i in range(12)]
    assert {r.text for r in html_extract.extract_main_text(spark.createDataFrame(same, "page_id long, url string, html string, text string")).collect()} == {MAIN}
    assert html_extract.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def prose(i):
    return " ".join(f"t{i * 7919 % 1009}w{k * i % 97}" for k in range(40))


def texts_of(spark, rows):
    return {r.page_id: r.text for r in html_extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_one_heading_over_many_articles(spark):
    page = lambda text: f"<body><main><h2>News</h2><div><div>Read our terms</div></div><p>{text}</p></main></body>"
    got = texts_of(spark, [(i, f"http://n.org/{i}", page(prose(i))) for i in range(1, 13)])
    assert all(got[i] == "News\n\n" + prose(i) for i in range(1, 13))
    # copies of one article with changes: nothing of it is template
    copies = [prose(1).replace(f"w{k * 1 % 97}", "changed", 1) for k in range(30, 38)] + [prose(1)] * 8
    got = texts_of(spark, [(i, f"http://n.org/{i}", page(t)) for i, t in enumerate(copies)])
    assert all(got[i] == "News\n\nRead our terms\n\n" + t for i, t in enumerate(copies))


def test_section_templates_of_a_large_host(spark):
    banner = lambda k: f"<div><div>Desk number {k}</div></div>"
    plain = lambda k, text, date: f"<body>{banner(k)}<div><p>{text}</p></div><div>{date}</div></body>"
    marked = lambda k, i: f"<body><main><h2>Story {i}</h2>{banner(k)}<p>{prose(i)}</p></main></body>"
    rows = [(i, f"http://plain.org/{i}", plain(i % 10, prose(i), f"day {i}")) for i in range(1, 151)]
    rows += [(1000 + i, f"http://plain.org/copy{i}", plain(77, prose(999), f"day {1000 + i}")) for i in range(12)]
    rows += [(2000 + i, f"http://marked.org/{i}", marked(i % 10, i)) for i in range(1, 151)]
    got = texts_of(spark, rows)
    for i in range(1, 151):  # each banner is on a tenth of its host's pages
        assert got[i] == f"{prose(i)}\n\nday {i}" and got[2000 + i] == f"Story {i}\n\n{prose(i)}"
    for i in range(12):  # copies of one article
        assert prose(999) in got[1000 + i]


def test_subtrees_against_a_plain_count(spark):
    """Pages without tags or names that say anything: what recurs goes, by a plain count of nested subtrees."""
    rng = np.random.default_rng(9)
    names = ["x1", "q7b", "zz", "m0"]
    fixed = [("p", "", ["Follow us everywhere"]), ("div", "q7b", [("p", "", ["All rights are ours"]), ("div", "", ["Call now"])]), ("div", "", [("span", "zz", ["Top stories"])]), ("p", "m0", ["Written by the desk"])]

    def page(i):
        body = [("p", "", [prose(100 * i + k)]) for k in range(int(rng.integers(1, 5)))]
        for block in fixed:
            if rng.random() < 0.7:
                body.insert(int(rng.integers(len(body) + 1)), block)
        if rng.random() < 0.1:
            body.insert(0, ("p", "", [f"Rare line {i % 3}"]))
        return ("div", "x1", [("div", names[int(rng.integers(4))], body)])

    def html(n):
        return n if isinstance(n, str) else f'<{n[0]}{f" class={n[1]}" if n[1] else ""}>{"".join(map(html, n[2]))}</{n[0]}>'

    def subtrees(n):
        return [] if isinstance(n, str) else [repr(n)] + [x for c in n[2] for x in subtrees(c)]

    def said(n, gone):
        if isinstance(n, str):
            return [n]
        return [] if repr(n) in gone else [x for c in n[2] for x in said(c, gone)]

    trees = [page(i) for i in range(40)]
    count = Counter(x for t in trees for x in set(subtrees(t)))
    gone = {x for x, n in count.items() if n >= max(html_extract.LEAST_ARTICLES, html_extract.LEAST_SHARE * len(trees))}
    assert len(gone) > 5
    got = texts_of(spark, [(i, f"http://plain.org/{i}", f"<body>{html(t)}</body>") for i, t in enumerate(trees)])
    assert got == {i: "\n\n".join(said(t, gone)) for i, t in enumerate(trees)}


def test_paragraphs_in_articles(spark):
    """A paragraph of many different articles is template; one of many copies of an article isn't."""
    page = lambda head, text, more: f"<body><article><h1>{head}</h1><p>{text}</p>{more}</article></body>"
    line = "<p>Subscribe <b>now</b> to our letters</p>"
    rows = [(i, f"http://a.org/{i}", page(f"Story {i}", prose(i), line if i % 2 else "<p>Only here %d</p>" % i)) for i in range(20)]
    rows += [(100 + i, f"http://b.org/{i}", page(f"Copy {i}", prose(7), "<p>Its second paragraph</p>")) for i in range(20)]
    saying = "<p>As they say everywhere</p>"
    rows += [(1000 + 20 * h + i, f"http://h{h}.org/{i}", page(f"Tale {h} {i}", prose(500 + 20 * h + i), saying if i % 2 else "")) for h in range(5) for i in range(20)]
    got = texts_of(spark, rows)
    assert all(got[1000 + 20 * h + i].endswith("\n\nAs they say everywhere") == (i % 2 == 1) for h in range(5) for i in range(20))
    for i in range(20):
        assert got[i] == f"Story {i}\n\n{prose(i)}" + ("" if i % 2 else f"\n\nOnly here {i}")
        assert got[100 + i] == f"Copy {i}\n\n{prose(7)}\n\nIts second paragraph"


def test_templates_decide_without_tags(spark):
    """The driver's pages with article, menu, advert and footer renamed to meaningless names of their hosts."""
    pages = read_table(spark, "/root/testdata/sf0.1", "pages").collect()
    hosts = Counter(r.url.split("/")[2] for r in pages)
    pages = [r for r in pages if 40 <= hosts[r.url.split("/")[2]] <= 90]
    assert len(pages) > 400

    def renamed(r):
        name = lambda tag: "k" + hashlib.md5((r.url.split("/")[2] + tag).encode()).hexdigest()[:6]
        out = re.sub(r"<(nav|article|footer)>", lambda m: f'<div class="{name(m[1])}">', r.html)
        return re.sub(r"</(nav|article|footer)>", "</div>", out).replace('class="ad"', f'class="{name("ad")}"')

    got = texts_of(spark, [(r.page_id, r.url, renamed(r)) for r in pages])
    want = {r.page_id: html_extract.main_text(r.html) for r in pages}
    assert sum(got[i] == t for i, t in want.items()) >= 0.95 * len(want)
    assert not any(html_extract.main_text(renamed(r)) == want[r.page_id] for r in pages)
    assert texts_of(spark, [(r.page_id, r.url, r.html) for r in pages]) == want


def test_awkward_pages(spark):
    """Null ids beside large ones, null urls, deep and long pages in linear time."""
    import time

    big = (1 << 60) + 1
    rows = [(big, "http://a.org/1", "<p>one"), (None, "http://a.org/2", "<p>two"), (None, None, None), (5, "", "")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, host string, main int").coalesce(1)
    assert Counter(tuple(r)[:4] for r in html_extract.extract_main_text(df).collect()) == Counter([(big, "http://a.org/1", "one", 3), (None, "http://a.org/2", "two", 3), (None, None, "", 0), (5, "", "", 0)])
    began = time.process_time()
    for html in ("<b>" * 200_000 + "deep", "<div>" * 200_000 + "<p>deep" * 3, "<article>" * 50_000 + "deep", "<p>a</b>" * 100_000):
        html_extract.counted_hashes(html)
        assert html_extract.main_text(html, html_extract.Template(frozenset([1]), frozenset([1]), frozenset([1]), 1))
    assert time.process_time() - began < 60


# 2


def test_language(spark, edge, none):
    model = langid.fit([(lang, *langid.counted(t), False) for lang, t in [("en", "the house and the tree"), ("de", "das haus und der baum"), ("en", "this is the end"), ("de", "das ist nicht das ende")] * 20])
    assert model.predict("the tree of the house")[0] == "en" and model.predict("der baum und das haus")[0] == "de"
    assert model.predict(None) == ("und", 0.0, True) and model.predict("123 __ !")[0] == "und"
    long = "der baum und das haus " * 70000
    assert np.allclose(model.logits(long), model.logits("der baum und das haus " * 700), atol=1e-2)
    rows = langid.identify(edge, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.doc_id: r.held_out for r in rows if r.doc_id} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in TEXTS if i}
    assert {r.lang_pred for r in rows if r.doc_id in (4, 5, 6, 13)} == {"und"}
    assert langid.identify(none).count() == 0
    # a model trained on these rows scores the awkward ones too
    labelled = [(100 + 2 * i + k, t, lang, "s", 0) for i in range(60) for k, (lang, t) in enumerate((("en", f"the house number {i} and the tree"), ("de", f"das haus nummer {i} und der baum")))]
    both = spark.createDataFrame(labelled, "doc_id long, text string, lang string, source string, n_chars long").unionByName(edge.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), "source", "n_chars"))
    got = langid.identify(both).collect()
    assert len(got) == len(labelled) + len(ROWS) and {r.lang_pred for r in got if r.doc_id in (4, 5, 6, 13)} == {"und"}
    assert all(r.lang_pred in ("en", "de", "und") and 0 <= r.score <= 1 for r in got)
    assert {(r.doc_id, r.lang_pred) for r in got if r.doc_id and r.doc_id >= 100} == {(x[0], x[2]) for x in labelled}
    assert {r.lang_pred for r in langid.identify(edge.withColumn("lang", edge.lang.substr(9, 1)).where("lang is null or lang = 'x'")).collect()} <= {"und"}


def plain_subwords(t):
    """Bytes of every run of 1 to 4 bytes of the letters, words apart by one space."""
    b = (" " + " ".join(re.findall(r"[^\W\d_]+", t.lower())) + " ").encode()
    return [b[i : i + n] for n in langid.SIZES for i in range(len(b) - n + 1)]


def plain_bucket(run):
    h = 0
    for c in run:
        h = (h * 0x01000193 + c + 1) % 2**32
    x = (h + len(run)) * 0x9E3779B1 % 2**32
    return (x ^ x >> 15) * 0x85EBCA77 % 2**32 >> 16


@given(st.text(alphabet="abÄß é9_ .\n漢", max_size=60))
@settings(max_examples=100, deadline=None)
def test_language_scores_are_means(t):
    """A text's logits are the plain mean of its subwords' rows; the score is their softmax."""
    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b", "c"], rng.normal(size=(langid.BUCKETS, 3)).astype(np.float32), rng.normal(size=3), temperature=0.7)
    rows = [model.table[plain_bucket(r)].astype(float) for r in plain_subwords(t)]
    logits = np.mean(rows, axis=0) + model.bias
    assert np.allclose(model.logits(t), logits, atol=1e-5)
    e = np.exp((logits - logits.max()) / 0.7)
    lang, score, _ = model.predict(t)
    if re.search(r"[^\W\d_]", t):
        assert np.isclose(score, (e / e.sum()).max(), atol=1e-5) and lang == model.languages[int(np.argmax(logits))]
    else:
        assert (lang, score) == ("und", 0.0)


# 3


def measured(t):
    t = t or ""
    w = words(t)
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    inside = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)


@given(st.lists(st.sampled_from(["a", "b", "é#", "\n", "c\n", "$$"]), max_size=60).map(" ".join))
@settings(max_examples=150, deadline=None)
def test_quality_counts(t):
    got = quality.measure(t)
    want = measured(t)
    assert got[:5] == want
    assert got[5] == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_quality(edge, none):
    assert quality.quality_report(edge).count() == len(ROWS)
    got = by_id(quality.quality_report(edge), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert all(got[i] == measured(t) for i, t in TEXTS if i is not None)
    kept = quality.keep_good(edge)
    assert kept.columns == edge.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 9, 10, None, 14, -5}
    assert quality.quality_report(none).count() == 0


# 4


def shingles(t):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(texts):
    """Plain: every pair."""
    sets = [(i, shingles(t)) for i, t in texts]
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, (_, a) in enumerate(sets):
        for y in range(x):
            b = sets[y][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[find(x)] = find(y)
    least = defaultdict(list)
    for x, (i, _) in enumerate(sets):
        least[find(x)].append(i)
    return sorted((i, len(s), min(least[find(x)])) for x, (i, s) in enumerate(sets))


def test_jaccard_edge(edge, none):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(edge).collect()]
    assert sorted(x for x in got if x[0] is not None) == components([x for x in TEXTS if x[0] is not None])
    assert sorted(x[1:] for x in got if x[0] is None) == sorted([(116, None), (0, None)])
    kept = jaccard.keep_one(edge)
    assert kept.columns == edge.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 4, 5, 6, 7, 9, 10, None, None, 11, 12, 13, 14, 15, -5])
    assert jaccard.near_duplicates(none).count() == 0


def near_copies(seed, groups=12, size=40, words_=60):
    rng = np.random.default_rng(seed)
    texts, i = [], 0
    common = [f"common{k}" for k in range(30)]
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(int(rng.integers(3, words_)))] + (common if g % 3 == 0 else [])
        for _ in range(int(rng.integers(1, size))):
            w = list(base)
            for _ in range(int(rng.integers(0, 4))):
                w[int(rng.integers(len(w)))] = f"e{int(rng.integers(9))}"
            texts.append((i, " ".join(w)))
            i += 1
    return texts


@pytest.mark.parametrize("limits", [(4096, 1 << 21), (5, 1 << 21)])
def test_jaccard_near_copies(spark, monkeypatch, limits):
    """Also with blocks cut into many chunks."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", limits[0])
    texts = near_copies(7)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    keys = jaccard.KEYS if limits[0] == 5 else None  # or as many as make a shared one certain
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(df, keys=keys).collect()) == components(texts)


def test_block_joins():
    rng = np.random.default_rng(0)
    for _ in range(25):
        base = [rng.integers(0, 2**63, rng.integers(1, 300)).astype(np.uint64) for _ in range(rng.integers(1, 6))]
        sets = []
        for _ in range(rng.integers(2, 120)):
            b = base[rng.integers(len(base))]
            s = np.unique(np.concatenate([b[rng.random(len(b)) < rng.uniform(0.6, 1)], rng.integers(0, 2**63, rng.integers(0, len(b) // 5 + 1)).astype(np.uint64)]))
            sets += [s] if len(s) else []
        exact = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard.linked(jaccard.overlap(sets[i], sets[j]), len(sets[i]), len(sets[j]))]
        forests = []
        for links in (exact, jaccard.join_block(sets)):
            f = jaccard.Forest(len(sets))
            for a, b in links:
                f.union(a, b)
            forests.append([f.find(i) for i in range(len(sets))])
        assert forests[0] == forests[1]
        partner = jaccard.with_partner([jaccard.signature(s) for s in sets], [len(s) for s in sets], list(range(len(sets))))
        assert all(partner[i] and partner[j] for i, j in exact)


# 5


def targets(sizes):
    """Plain water-filling: source -> target."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    free, left, out = set(order), 1.5 * sum(sizes.values()), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * level > 2 * sizes[s]}
        out |= {s: 2.0 * sizes[s] for s in full} if full else {s: weight[s] * level for s in free}
        if not full:
            break
        left -= sum(2 * sizes[s] for s in full)
        free -= full
    return out


def test_mixing(spark, edge, none):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 300))), None if i % 7 == 0 else f"s{int(rng.integers(6)) ** 2 % 5}") for i in range(3000)]
    rows += [(5000 + i, "same text of six words here", "hot") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_report(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want, taken = targets(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * want[r.source] + 1e-9
        assert r.taken % max(1, r["size"]) == 0 and 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 8 for s in sizes)
    again = mixing.mix_report(df.repartition(7)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    assert mixing.mix_report(edge).count() == len(ROWS) and mixing.mix_report(none).count() == 0
    copies = mixing.mixed(edge)
    assert copies.columns == edge.columns and max(Counter((r.doc_id, r.text) for r in copies.collect()).values()) <= 4
    one = df.where("doc_id < 5000")
    assert Counter(r.doc_id for r in mixing.mixed(one).collect()) == Counter({r.doc_id: r.taken // r["size"] for r in mixing.mix_report(one).collect() if r.taken})
    assert mixing.mixed(none).count() == 0


@given(st.dictionaries(st.integers(1, 400), st.integers(1, 5), min_size=1, max_size=60), st.floats(0, 1))
@settings(max_examples=80, deadline=None)
def test_fitting(counts, share):
    lengths = np.array(sorted(counts))
    n = np.array([counts[x] for x in lengths])
    budget = int(share * (lengths * n).sum())
    take = mixing.fit(lengths, n, budget)
    assert (take >= 0).all() and (take <= n).all() and abs(int((take * lengths).sum()) - budget) <= lengths.max()


@given(st.integers(0, 10**6))
@settings(max_examples=20, deadline=None)
def test_fitting_with_long_documents(seed):
    def nearest(counts, budget):
        """Plain: all sums as bits of a number."""
        sums = 1
        for x, n in counts.items():
            for _ in range(n):
                sums |= sums << x
        return next(d for d in range(budget + 1) if sums >> (budget - d) & 1 or sums >> (budget + d) & 1)

    rng = np.random.default_rng(seed)
    short = Counter(rng.integers(50, 550, 500).tolist())
    cases = [({200_000: 1, 100: 1000}, 200_000), ({300_000: 1} | short, 310_000), ({1: 1, 1000: 2000}, 900_500), ({900_000: 1, 40_000: 3}, 100_000)]
    cases.append((dict(Counter(rng.integers(33_000, 99_000, 12).tolist())), int(rng.integers(50_000, 500_000))))
    cases.append((dict(Counter(rng.integers(33_000, 99_000, 6).tolist())) | {7: 300}, int(rng.integers(50_000, 300_000))))
    for counts, budget in cases:
        lengths = np.array(sorted(counts))
        n = np.array([counts[x] for x in lengths.tolist()])
        take = mixing.fit(lengths, n, budget)
        assert (take >= 0).all() and (take <= n).all() and abs(int((take * lengths).sum()) - budget) == nearest(counts, budget)


@given(st.dictionaries(st.integers(1, 100_000), st.integers(1, 3), min_size=1, max_size=8), st.floats(0, 1))
@settings(max_examples=60, deadline=None)
def test_fits_are_the_nearest_sums(counts, share):
    """Against every sum, by the table of sums and by their list."""
    lengths = np.array(sorted(counts))
    n = np.array([counts[x] for x in lengths.tolist()])
    budget = int(share * (lengths * n).sum())
    sums = {0}
    for x, k in counts.items():
        sums = {s + x * i for s in sums for i in range(k + 1)}
    nearest = min(abs(s - budget) for s in sums)
    take = mixing.fit(lengths, n, budget)
    assert (take >= 0).all() and (take <= n).all() and abs(int((take * lengths).sum()) - budget) == nearest
    listed = mixing.listed_knapsack(lengths, n, budget)
    assert all(k <= counts[x] for x, k in listed.items()) and abs(sum(x * k for x, k in listed.items()) - budget) == nearest
    coarse = mixing.listed_knapsack(lengths, n, budget, most=500)
    assert all(k <= counts[x] for x, k in coarse.items()) and abs(sum(x * k for x, k in coarse.items()) - budget) <= nearest + 24 * (2 * budget // 500 + 1)


def test_fits_of_huge_documents():
    lengths, n = np.array([30_000_001, 41_000_007, 50_300_000, 61_000_019]), np.array([3, 3, 2, 2])
    budget = 2 * 30_000_001 + 50_300_000 + 61_000_019
    assert int((mixing.fit(lengths, n, budget) * lengths).sum()) == budget
    for lengths, n, budget in (([40000, 50000], [5, 5], 90_000), ([40000, 50000, 60000], [3, 3, 3], 110_000)):
        assert int((mixing.fit(np.array(lengths), np.array(n), budget) * np.array(lengths)).sum()) == budget


def test_mix_of_rows_without_names(spark):
    """Rows that share an id, or have none, are taken one by one."""
    rows = [(None, " ".join(f"w{i}" for i in range(20 + i)), "a", i) for i in range(40)] + [(7, "x y z", "b", 99)] * 50 + [("8", "only " * 300, "b", 1)]
    df = spark.createDataFrame([(None if i is None else str(i), *r) for i, *r in rows], "doc_id string, text string, source string, size long").repartition(3)
    report = mixing.mix_report(df).collect()
    assert len(report) == len(rows)
    taken, mixed = Counter(), Counter()
    for r in report:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    copies = mixing.mixed(df)
    assert copies.columns == df.columns
    for r in copies.collect():
        mixed[r.source] += len(words(r.text))
    assert mixed == taken and all(abs(taken[r.source] - r.target) <= 3 for r in report)


def test_targets_that_do_not_settle(spark):
    sizes = spark.createDataFrame([("0a", 1), ("0b", 1000), ("0c", 1)], "key string, size long")
    assert len(mixing.source_targets(sizes).collect()) == 3
    with pytest.raises(RuntimeError):
        mixing.source_targets(sizes, most_rounds=1)


# 6


def repeats(texts):
    """Plain: every window of 50 words."""
    at = defaultdict(list)
    for i, t in texts:
        w = words(t)
        for p in range(len(w) - 49):
            at[tuple(w[p : p + 50])].append((i, p))
    marks = defaultdict(list)
    for places in at.values():
        if len(set(places)) > 1:
            for x in set(places):
                marks[x[0], x != min(places)].append((x[1], min(places)[0]))
    out = []
    for (i, copy), ps in marks.items():
        ps.sort()
        s, e, f = ps[0][0], ps[0][0] + 50, ps[0][1]
        for p, first in ps[1:]:
            if p > e:
                out.append((i, s, e - s, copy, f))
                s, f = p, first
            e, f = p + 50, min(f, first)
        out.append((i, s, e - s, copy, f))
    return sorted(out)


def spans_of(df):
    return sorted(tuple(r) for r in suffixes.repeated_spans(df).collect())


def test_suffixes_edge(edge, none):
    texts = list({x for x in TEXTS if x[0] is not None})
    assert spans_of(edge) == repeats(texts)
    cut = suffixes.without_copies(edge)
    assert cut.columns == edge.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in cut.collect() if r.doc_id}
    assert 2 not in got and got[1][0] == STORY and got[9][0].endswith(PASSAGE) and got[10][0].startswith("outro0") and got[10][1] == len(got[10][0])
    assert got[3][0] == "other50" or "other50" in got[3][0] and "tale60" not in got[3][0]
    assert suffixes.repeated_spans(none).count() == 0 and suffixes.without_copies(none).count() == 0


@pytest.mark.parametrize("group", [20_000, 3])
def test_suffixes_mixture(spark, monkeypatch, group):
    """Passages in changing company; also with all grams dealt by their contents."""
    monkeypatch.setattr(suffixes, "GROUP", group)
    rng = np.random.default_rng(11)
    passages = [[f"p{k}w{j}" for j in range(int(rng.integers(45, 160)))] for k in range(10)] + [["a", "b", "c"] * 40, ["x"] * 130]
    texts = []
    for i in range(150):
        w = []
        for _ in range(int(rng.integers(1, 4))):
            p = list(passages[rng.integers(len(passages))])
            a = int(rng.integers(0, 40))
            p = p[a : len(p) - int(rng.integers(0, 40))]
            if len(p) > 60 and rng.random() < 0.5:
                p[int(rng.integers(len(p)))] = "edit"
            w += p + [f"d{i}_{j}" for j in range(int(rng.integers(0, 30)))]
        texts.append((i, " ".join(w)))
    assert spans_of(spark.createDataFrame(texts, "doc_id long, text string").repartition(4)) == repeats(texts)


def test_texts_under_one_id(spark):
    """Only copies go, whatever else has the same id; ids may be strings."""
    a, tail, b = STORY, " ".join(f"tail{i}" for i in range(60)), " ".join(f"own{i}" for i in range(100))
    rows = [(0, a), (1, f"{a} {tail}"), (1, b), (1, b), (None, a)]
    for kind, name in (("long", lambda i: i), ("string", lambda i: i if i is None else f"id{i}")):
        df = spark.createDataFrame([(name(i), t) for i, t in rows], f"doc_id {kind}, text string")
        assert spans_of(df) == [(name(0), 0, 120, False, name(0)), (name(1), 0, 120, True, name(0))]
        left = Counter((r.doc_id, r.text) for r in suffixes.without_copies(df).collect())
        assert left == Counter([(name(0), a), (name(1), tail), (name(1), b), (name(1), b), (None, a)])
    twice = spark.createDataFrame([(1, a), (1, f"{a} {tail}"), (1, a)], "doc_id long, text string")
    assert sorted(x[1:] for x in spans_of(twice)) == [(0, 120, False, 1), (0, 120, True, 1)]


# 7


def test_toxicity(spark, edge, none):
    rng = np.random.default_rng(2)
    filler = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(4000):
        bad, group = rng.random() < 0.5, rng.random() < 0.5
        w = list(rng.choice(filler, 40)) + ["insult"] * bad + ["group"] * group
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad and group), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scored = toxicity.toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int, score int")).collect()
    right = [r.predicted == labels[r.doc_id][1] for r in scored if r.held_out]
    assert len(right) > 600 and np.mean(right) > 0.97  # only the pair tells
    # the awkward rows under a trained machine: any text has a score, without terms that of no terms
    learned = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, toxic int, score int"))
    got = toxicity.toxicity(edge.unionByName(edge.limit(0)), spark.createDataFrame([], "doc_id long, toxic int"), learned).collect()
    nothing = learned.score(None)
    assert len(got) == len(ROWS) and all(0 < r.score < 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert nothing == learned.score("") == learned.score(" \n") and {r.score for r in got if r.doc_id in (4, 5, 6)} == {nothing}
    assert learned.score("insult group " * 300_000) >= 0.5 and toxicity.toxicity(none, spark.createDataFrame([], "doc_id long, toxic int"), learned).count() == 0
    machine = toxicity.fit([])
    for df in (edge, none):
        rows = toxicity.toxicity(df, spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int"), machine).collect()
        assert len(rows) == df.count() and all(r.score == 0 for r in rows)
    assert toxicity.toxicity(edge, spark.createDataFrame([], "doc_id long, toxic int")).count() == len(ROWS)
    long = " ".join(f"a{i}" for i in range(1000))
    assert (toxicity.terms(long)[1] > 0).all()


@given(st.lists(st.sampled_from(["insult", "group", "Insults!", "other-word", "x", "ünï"]), max_size=30).map(" ".join))
@settings(max_examples=80, deadline=None)
def test_toxicity_scores_are_sums_over_pairs(t):
    """Against every single term and every pair of terms."""
    rng = np.random.default_rng(5)
    slot = np.full(toxicity.BUCKETS, -1, np.int32)
    known = sorted({int(i) for w in ("insult", "group", "insults", "other", "word") for i in toxicity.terms(w)[0]})
    slot[known] = np.arange(len(known))
    m = toxicity.Machine(slot, rng.normal(size=len(known)), rng.normal(size=(len(known), toxicity.FACTORS)), 0.3)
    count = Counter()
    for w in re.sub(r"[^a-z0-9\x80-\U0010ffff]", " ", t.lower()).split():
        count[w] += 1
        b = w.encode()
        for k in toxicity.PREFIXES:
            if len(b) > k:
                count[b[:k], k] += 1
    buckets = Counter()
    for term, n in count.items():
        if isinstance(term, str):
            buckets[whole_bucket(term)] += n
        else:
            buckets[prefix_bucket(*term)] += n
    x = {slot[b]: np.log1p(n) for b, n in buckets.items() if slot[b] >= 0}
    value = m.bias + sum(m.w[i] * v for i, v in x.items()) + sum(m.v[i] @ m.v[j] * x[i] * x[j] for i in x for j in x if i < j)
    assert np.isclose(m.value(*toxicity.terms(t)), value)
    assert np.isclose(m.score(t), 1 / (1 + np.exp(-np.clip(value, -30, 30))))


def rolling(b):
    """The sum of a word's byte values, each times its place's power."""
    base = int(textcore.BYTE_BASE)
    return sum(int(textcore.BYTE_VALUE[c]) * pow(base, i, 1 << 64) for i, c in enumerate(b)) % (1 << 64)


def whole_bucket(w):
    return int(textcore.mix(np.array([(rolling(w.encode()) + 1) % (1 << 64)], np.uint64))[0]) >> 46


def prefix_bucket(b, k):
    return int(textcore.mix(np.array([(rolling(b) + k * 1000003) % (1 << 64)], np.uint64))[0]) >> 46


def test_terms_in_slices(monkeypatch):
    text = " ".join(f"term{i % 50} other" for i in range(400))
    a = toxicity.terms(text)
    monkeypatch.setattr(textcore, "SLICE", 100)
    b = toxicity.terms(text)
    assert (a[0] == b[0]).all() and (a[1] == b[1]).all()


# 8


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_same_ids(text):
    e = packing.encoder(packing.default_tokenizer())
    assert e(text) == e.tokenizer.encode(text, add_special_tokens=False).ids


def packed_well(rows, texts):
    e = packing.encoder(packing.default_tokenizer()).tokenizer
    docs = Counter()
    for i, t in texts:
        ids = np.array(e.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids))):
            docs[i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == docs
    at = defaultdict(list)
    for r in rows:
        at[r.sequence_id].append((r.offset, r.length))
    for places in at.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= 1024
    return len(at)


def test_packing(spark, edge, none):
    packed_well(packing.pack(edge).collect(), TEXTS)
    assert packing.pack(none).count() == 0
    rng = np.random.default_rng(4)
    texts = [(i, " ".join(["word"] * int(rng.integers(1, 700)))) for i in range(600)]
    n = packed_well(packing.pack(spark.createDataFrame(texts, "doc_id long, text string")).collect(), texts)
    assert n <= 1.03 * sum(len(words(t)) + 1 for _, t in texts) / 1024 + 1


@pytest.mark.parametrize("n,seed", [(1, 0), (40, 1), (3000, 2), (3000, 3)])
def test_plans(n, seed):
    rng = np.random.default_rng(seed)
    counts = np.bincount(rng.integers(1, 1024, n) if seed < 3 else rng.integers(1, 200, n), minlength=1024)
    plan = packing.plan_packing(counts)
    assert all(plan.used.get(i, 0) == counts[i] for i in range(1, 1024))
    fill = Counter()
    for length, runs in plan.runs.items():
        for lo, hi, copies, first, _ in runs:
            for k in range((hi - lo) // copies):
                fill[first + k] += length * copies
    assert max(fill.values()) <= 1024 and len(fill) == plan.sequences
    gaps: list[int] = []  # first-fit decreasing is never much better
    for length in sorted(np.repeat(np.arange(1024), counts), reverse=True):
        for k, g in enumerate(gaps):
            if g >= length:
                gaps[k] -= length
                break
        else:
            gaps.append(1024 - length)
    assert plan.sequences <= len(gaps) * 1.01 + 1


@given(st.lists(st.integers(1, 60), min_size=1, max_size=40), st.integers(3, 60))
@settings(max_examples=100, deadline=None)
def test_sums_are_indexed(lengths, total):
    """What the index gives under a sum is there, as often as it says; if it gives nothing, there is nothing."""
    left = np.bincount(lengths, minlength=64)
    pairs = [(a, total - a) for a in range(1, total) if left[a] and left[total - a] and (2 * a != total or left[a] > 1)]
    pair, triple = packing.Sums(left.copy()).pair(total), packing.Sums(left.copy()).triple(total)
    assert (pair is None) == (not pairs) and (pair is None or sum(pair) == total and pair in pairs)
    triples = {tuple(sorted((a, b, total - a - b))) for a in range(1, total) for b in range(1, total - a)}
    triples = {t for t in triples if all(left[x] >= t.count(x) for x in t)}
    assert (triple is None) == (not triples) and (triple is None or tuple(sorted(triple)) in triples)
    index = packing.Sums(left.copy())
    while found := index.triple(total):  # consumed to the end
        for x in found:
            index.left[x] -= 1
    assert (index.left >= 0).all() and not [t for t in triples if all(index.left[x] >= t.count(x) for x in t)]


def test_other_tokenizers(tmp_path, spark):
    """Files that say anything else go through tokenizers itself."""
    import json

    import public_tokenizers

    texts = ["Words, words's  and   WORDS 123\n\n", "é ünï 漢字 🙂", "<|endoftext|> x", ""]
    assert packing.encoder(packing.default_tokenizer()).fast
    with open(packing.default_tokenizer(), encoding="utf-8") as f:
        spec = json.load(f)
    files = [public_tokenizers.path("word_bpe_49k.json")]
    for k, change in enumerate(({"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, {"normalizer": {"type": "Lowercase"}}, {"model": spec["model"] | {"merges": spec["model"]["merges"][:-1]}})):
        files.append(str(tmp_path / f"{k}.json"))
        with open(files[-1], "w", encoding="utf-8") as f:
            json.dump(spec | change, f)
    for path in files:
        e = packing.Encoder(path)
        assert e.fast is None and all(e(t) == e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts)
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tokenizer=files[0]).collect()
    ids = {i: np.array([*packing.Encoder(files[0]).tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4") for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids_crc32 for r in rows} == {i: zlib.crc32(x.tobytes()) for i, x in ids.items()}


def test_cuts():
    assert packing.cut(1) == [(0, 1)] and packing.cut(1024) == [(0, 1024)]
    assert packing.cut(2500) == [(0, 452), (452, 1024), (1476, 1024)]


# 9


def archived(pages):
    digest = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    keeper = {}
    for i, _, h in pages:
        if len((h or "").encode()) >= 1000 and i is not None:
            keeper[digest(h)] = max(i, keeper.get(digest(h), i))
    out = []
    for i, _, h in pages:
        k = keeper.get(digest(h))
        again = i is not None and k is not None and k != i
        out.append((i, len((h or "").encode()), digest(h), "revisit" if again else "response", k if again else None))
    return sorted(out, key=repr)


def test_archives(spark):
    big = "é" * 600
    pages = [(1, "http://a", big), (2, "http://a", big), (9, None, big), (3, "u\r\nx", "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", ""), (None, "u", big), (7, "u", "<p>" * 90000), (8, "u", "y" * 1000), (8, "u", "y" * 1000)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    back = warc.archive_round_trip(df).collect()
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back), key=repr)
    assert got == archived(pages)
    assert warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("split", [1, 7, 100, 1000, 1 << 20])
def test_splits(tmp_path, split):
    rng = np.random.default_rng(0)
    payloads = [rng.integers(0x20, 0x7F, int(n)).astype(np.uint8).tobytes() for n in rng.integers(0, 3000, 25)]
    data = b"".join(warc.record(i, "u", p, hashlib.sha1(p).hexdigest(), None) for i, p in enumerate(payloads))
    (tmp_path / "a.warc.gz").write_bytes(data)
    with open(tmp_path / "a.warc.gz", "rb") as f:
        got = [warc.parse_record(r) for s in range(0, len(data), split) for r in warc.records_in(f, s, min(len(data), s + split), len(data))]
    assert [(r["page_id"], r["payload"]) for r in got] == [(str(i), p) for i, p in enumerate(payloads)]


def test_false_magic_and_damage(tmp_path):
    import gzip

    good = warc.record(1, "u", b"p", hashlib.sha1(b"p").hexdigest(), None)
    data = b"\x1f\x8b\x08 no member" + good + gzip.compress(b"no record") + warc.MAGIC + good
    (tmp_path / "a").write_bytes(data)
    with open(tmp_path / "a", "rb") as f:
        assert len(list(warc.records_in(f, 0, len(data), len(data)))) == 2
        with pytest.raises(warc.Corrupt):
            list(warc.records_in(f, 0, len(data), len(data) - 3))


def test_rows_come_from_the_payload(spark):
    whole, again = hashlib.sha1(b"payload").hexdigest(), lambda data: gzip_text(data)
    assert warc.parse_record(again(warc.record(1, "u", b"payload", whole, None)))["payload_digest"] == whole
    with pytest.raises(warc.Corrupt):  # a wrong digest in the head
        warc.parse_record(again(warc.record(1, "u", b"payload", "notthedigest", None)))
    good = again(warc.record(1, "u", b"payload", whole, None))
    for damaged in (good.replace(b"payload\r\n", b"pAyload\r\n"), good.replace(b"Content-Length: 7", b"Content-Length: 8"), good[:-8]):
        with pytest.raises(warc.Corrupt):
            warc.parse_record(damaged)
    schema = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string"
    rows = [("9", 7, whole, "response", None), ("1", 7, whole, "revisit", "9")]
    warc.check_revisits(spark.createDataFrame(rows, schema))
    for wrong in (("1", 8, whole, "revisit", "9"), ("1", 7, "other", "revisit", "9"), ("1", 7, whole, "revisit", "8")):
        with pytest.raises(warc.Corrupt):
            warc.check_revisits(spark.createDataFrame([*rows, wrong], schema))


def gzip_text(data):
    import gzip

    return gzip.decompress(data)


# 10


def test_fingerprints(spark, edge, none):
    rows = [(i, t) for i, t in TEXTS if i is not None and i != 3] + [(3, TEXTS[2][1])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fingerprint string, n_chars int")
    order = sorted(rows)
    for ranges in (1, 2, 7, 100):
        got = {r.doc_id: r for r in spotsigs.fingerprints(df.repartition(3), ranges).collect()}
        assert len(got) == len(rows)
        for k, (i, t) in enumerate(order):
            t, following = t or "", order[(k + 1) % len(order)][1] or ""
            m = len(t) // 4
            text = t[: len(t) - m] + following[:m]
            assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
            assert got[i].fingerprint == spotsigs.fingerprint(t) and got[i].edited_fingerprint == spotsigs.fingerprint(text)
            assert got[i].near_next == spotsigs.likeness(spotsigs.fingerprint(t), spotsigs.fingerprint(following))
    assert spotsigs.fingerprints(edge).count() == len(ROWS) and spotsigs.fingerprints(none).count() == 0
    alone = spotsigs.fingerprints(spark.createDataFrame([(7, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0
    twins = spotsigs.fingerprints(spark.createDataFrame([(7, "a b"), (7, "a b"), (7, "c d"), (None, "a b")], "doc_id long, text string")).collect()
    assert len(twins) == 4


def test_likeness():
    rng = np.random.default_rng(5)
    w = [f"w{i}" for i in range(3000)]
    a = [("the " if rng.random() < 0.4 else "") + x for x in w[:2000]]
    b = a[:1500] + [("the " if rng.random() < 0.4 else "") + x for x in w[2000:2500]]
    sa, sb = set(spotsigs.signatures(" ".join(a)).tolist()), set(spotsigs.signatures(" ".join(b)).tolist())
    exact = len(sa & sb) / len(sa | sb)
    assert abs(spotsigs.likeness(spotsigs.fingerprint(" ".join(a)), spotsigs.fingerprint(" ".join(b))) - exact) < 0.25
    small = "the cat is on a mat and the dog was at the door of the old house by the sea"
    other = small.replace("old", "new")
    x, y = set(spotsigs.signatures(small).tolist()), set(spotsigs.signatures(other).tolist())
    assert spotsigs.likeness(spotsigs.fingerprint(small), spotsigs.fingerprint(other)) == pytest.approx(len(x & y) / len(x | y))
    assert spotsigs.likeness(spotsigs.fingerprint("a b"), spotsigs.fingerprint(" ".join(a)), least=0.5) == 0.0


def plain_signatures(t):
    """Chains as tuples of words."""
    said = re.sub(r"[\x00-\x7f]", lambda m: m[0].lower() if m[0].isalnum() else " ", t).split(" ")
    said = [w for w in said if w]
    common = set(spotsigs.ANCHORS)
    content = [w for w in said if w not in common]
    out, k = {("", *content[:2])} if said else {t}, 0
    for w in said:
        if w in common:
            out.add((w, *content[k : k + 2]))
        else:
            k += 1
    return out


def overlap_of(a, b):
    return len(a & b) / len(a | b)


def test_signatures_of_plain_texts():
    """Texts of every length under one rule, against sets of chains."""
    rng = np.random.default_rng(3)
    vocabulary = ["the", "of", "and", "in", "der", "und", "que", "la"] * 10 + [f"w{i}" for i in range(300)] + ["Ünï", "A-b", "x,y"]
    texts = ["", " .,", "the", "the of", "word", "Word!", "the end"] + [" ".join(rng.choice(vocabulary, n)) for n in list(range(1, 90)) * 2]
    for t, u in zip(texts, [*texts[1:], texts[0]], strict=True):
        other = spotsigs.edited(t, u)
        a, b, c = plain_signatures(t), plain_signatures(u), plain_signatures(other)
        assert len(spotsigs.signatures(t)) == len(a)
        prints = [spotsigs.fingerprint(x) for x in (t, u, other)]
        assert spotsigs.likeness(prints[0], prints[1]) == overlap_of(a, b) and spotsigs.likeness(prints[0], prints[2]) == overlap_of(a, c)
        assert (prints[0] == prints[1]) == (a == b)
    # the likeness to an edit follows the edit, not the length: about 0.6 where a quarter is another text's
    for low, high in ((16, 30), (30, 50), (50, 90)):
        near = [spotsigs.likeness(spotsigs.fingerprint(t), spotsigs.fingerprint(spotsigs.edited(t, " ".join(rng.choice(vocabulary, 90))))) for t in texts if low <= len(t.split()) < high]
        assert 0.45 < np.median(near) < 0.72 and np.quantile(near, 0.05) > 0.25


def test_ranges(spark):
    """A range that one id fills is cut by text; strings are cut by a sample; no neighbour is lost."""
    texts = [f"text number {i} of the whole" for i in range(400)]
    cases = [[(5, t) for t in texts[:300]] + [(i, t) for i, t in enumerate(texts[300:])], [(None, t) for t in texts[:300]] + list(enumerate(texts[300:]))]
    for rows, kind, ranges in [(cases[0], "long", 10), (cases[1], "long", 10), ([(f"id{i:04d}", t) for i, t in enumerate(texts)], "string", 20)]:
        df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(5)
        dealt = spotsigs.with_next(df, ranges).collect()
        assert max(Counter(r.home for r in dealt).values()) <= 120 and len(dealt) <= len(rows) + len({r.home for r in dealt})
        got = spotsigs.fingerprints(df, ranges).collect()
        assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
        hashes = {r.text: r.h for r in df.selectExpr("text", "xxhash64(text) AS h").collect()}
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1]]))
        want = Counter((i, hashlib.sha256(spotsigs.edited(t, order[(k + 1) % len(order)][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
        assert Counter((r.doc_id, r.edited_sha256) for r in got) == want


def test_similar_fingerprints(spark):
    """Partitions by length and bounds lose no pair: against every pair of plain sets."""
    texts = [(i, t) for i, t in near_copies(23, groups=8, size=25, words_=200)]
    texts = [(i, " ".join(w if k % 3 else f"the {w}" for k, w in enumerate(t.split()))) for i, t in texts] + [(900, None), (901, ""), (902, "..")]
    sets = {i: plain_signatures(t or "") for i, t in texts}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and overlap_of(sets[a], sets[b]) >= 0.75:
                x, y = sorted((find(a), find(b)))
                up[y] = x
    got = {r.doc_id: (r.n_signatures, r.component_id) for r in spotsigs.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_large_sets_are_compared_whole(spark):
    rng = np.random.default_rng(7)
    w = [("the " if rng.random() < 0.4 else "") + f"w{i}" for i in range(2000)]
    text, sets = " ".join(w), lambda t: set(spotsigs.signatures(t).tolist())
    one = [" ".join([*w[:i], w[i] + "x", *w[i + 1 :]]) for i in range(100, 2000, 100)]
    one = [t for t in one if sets(t) != sets(text)]
    assert len(one) > 10 and len(sets(text)) > 500
    for t in one:
        exact = len(sets(t) & sets(text)) / len(sets(t) | sets(text))
        assert spotsigs.fingerprint(t) != spotsigs.fingerprint(text) and spotsigs.likeness(spotsigs.fingerprint(t), spotsigs.fingerprint(text)) == exact < 1
    rows = [(2 * i, text) for i in range(len(one))] + [(2 * i + 1, t) for i, t in enumerate(one)]
    got = {r.doc_id: r for r in spotsigs.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in enumerate(one):
        r = got[2 * i]
        assert r.near_next == len(sets(t) & sets(text)) / len(sets(t) | sets(text)) and r.n_signatures == len(sets(text))
        other = spotsigs.edited(text, t)
        assert r.near_edited == len(sets(other) & sets(text)) / len(sets(other) | sets(text))


def test_ids_stay_whole(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([row(big, "a b c"), row(None, "d")], "doc_id long, text string, lang string, source string, n_chars long, a int, b string, c string, d string, e string, f string, g string, h string, i string, j string, k string, l string")
    for found in (packing.pack(df), spotsigs.fingerprints(df), jaccard.near_duplicates(df), mixing.mix_report(df), quality.quality_report(df)):
        assert {r.doc_id for r in found.collect()} == {big, None}
