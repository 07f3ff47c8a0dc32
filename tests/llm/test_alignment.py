"""op13 against whole texts encoded by both libraries and counted in dictionaries."""

import hashlib
from collections import Counter

import pytest
from compare import rows
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from quillsift.llm import alignment

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
TEXTS = [
    "The quick brown fox.", "The quick brown fox.", " leading", "trailing ", "two  spaces   three", "line\nend\n\n \n x", "tab\t x \t\ty", "   ", "\n", " ", "<s> a</s><unk> <|endoftext|>", "▁literal ▁mark▁", "a▁ b",
    "naïve café 漢字 🙂 é", " nbsp  x 　y", "'ll don't I'LL", "x\x00y \x1f z", "1234567 89", "", None, "a" * 70_000, " " * 70_000 + "b", "word " * 20_000,
]


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = alignment.default_tokenizers()
    t = Tokenizer.from_file(a)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=b)


def letters():
    """Byte-level vocabularies: the letters of bytes, by the rule of the format."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


LETTERS = letters()


def tokens(libraries, text):
    """ids and ends of both sides, or nothing."""
    if not text:
        return None
    t, sp = libraries
    a, b = t.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
    said_a = [bytes(LETTERS[c] for c in t.id_to_token(i)) for i in a]
    said_b = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(said_a) != (" " + text).encode() or b"".join(said_b) != (" " + text).encode():
        return None
    ends = lambda said: [sum(map(len, said[: i + 1])) for i in range(len(said))] if len(said) < 2000 else running(said)
    return a, ends(said_a), b, ends(said_b)


def running(said):
    out, n = [], 0
    for x in said:
        n += len(x)
        out.append(n)
    return out


def groups(a, ends_a, b, ends_b):
    both, out, i, j = sorted(set(ends_a) & set(ends_b)), [], 0, 0
    for e in both:
        ga, gb = [], []
        while i < len(a) and ends_a[i] <= e:
            ga.append(a[i])
            i += 1
        while j < len(b) and ends_b[j] <= e:
            gb.append(b[j])
            j += 1
        out.append((ga, gb))
    return out


def plain(libraries, docs):
    found = [(d, tokens(libraries, t)) for d, t in docs]
    cut = [(d, x, groups(*x) if x else []) for d, x in found]
    counts = Counter((ga[-1], gb[-1]) for _, _, gs in cut for ga, gb in gs)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    for d, x, gs in cut:
        links = [(ga[-1], gb[-1]) for ga, gb in gs]
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in gs)
        yield d, len(x[0]) if x else 0, len(x[2]) if x else 0, len(gs), len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(said.encode()).hexdigest() if x else ""


@pytest.fixture(scope="module")
def docs(spark):
    ids = [*range(len(TEXTS) - 2), None, 0]
    return spark.createDataFrame([(i, t, 1, "x") for i, t in zip(ids, TEXTS, strict=True)], "doc_id long, text string, n_a int, stripe string").repartition(3)


def test_plain(docs, libraries):
    want = list(plain(libraries, [(r.doc_id, r.text) for r in docs.collect()]))
    assert sum(r[1] == 0 for r in want) < 8
    assert rows(COLUMNS, alignment.alignment(docs).collect()) == rows(COLUMNS, want)


def test_documents(spark, libraries, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    want = rows(COLUMNS, plain(libraries, [(r.doc_id, r.text) for r in docs.collect()]))
    assert rows(COLUMNS, alignment.alignment(docs).collect()) == want


def test_slices_and_forgetting(libraries, monkeypatch):
    """Long texts by parts, and a table that is forgotten again and again: the same."""
    texts = [t for t in TEXTS if t] + ["one two one three " * 50, None]
    pair = alignment.Pair(*alignment.default_tokenizers())
    want = [(x[:4], x[4].tolist(), x[5].tolist()) for x in pair.aligned(texts)]
    for name, value in (("MEMO", 7), ("HELD", 3), ("SLICE", 20), ("AT_ONCE", 2)):
        monkeypatch.setattr(alignment, name, value)
    assert [(x[:4], x[4].tolist(), x[5].tolist()) for x in alignment.Pair(*alignment.default_tokenizers()).aligned(texts)] == want


def test_best_matches(docs, libraries):
    counts = Counter()
    for r in docs.collect():
        if x := tokens(libraries, r.text):
            counts.update((ga[-1], gb[-1]) for ga, gb in groups(*x))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    want = {(b, a, n) for (a, b), n in counts.items() if n == most[b]}
    assert {tuple(r) for r in alignment.best_matches(docs).collect()} == want


def test_empty(docs):
    assert alignment.alignment(docs.limit(0)).collect() == []
    assert alignment.alignment(docs.where("text = ''")).select("n_a", "groups_sha256").collect() == [(0, "")]


def test_blocks(libraries):
    """A block's rows hold what went in, whatever the sizes of runs."""
    pair = alignment.pair_of(*alignment.default_tokenizers())
    found = list(pair.aligned(["one two one", "two three", "one"]))
    out = alignment.block_rows(7, [(i, str(i), *x[:3], int(x[5].sum()), x[3]) for i, x in enumerate(found)], [(i, x[4], x[5]) for i, x in enumerate(found)], pair.width)
    got = Counter()
    for r in out[out.stripe.notna()].itertuples():
        codes, runs = alignment.unpacked_codes(r.codes), alignment.unpacked(r.runs)
        assert (alignment.unpacked(r.sums) == [x.sum() for x in __import__("numpy").split(alignment.unpacked(r.counts), runs.cumsum()[:-1])]).all()
        for c, d, n in zip(codes.repeat(runs).tolist(), alignment.unpacked(r.docs).tolist(), alignment.unpacked(r.counts).tolist(), strict=True):
            got[d, (c // pair.width * alignment.STRIPES + r.stripe) * pair.width + c % pair.width] += n
    assert got == Counter({(i, p): n for i, x in enumerate(found) for p, n in zip(x[4].tolist(), x[5].tolist(), strict=True)})


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(" \t\n\r  　\x1c\x85ab'lé漢▁1.-🙂"), min_size=1, max_size=40))
def test_chunks_are_the_whole(libraries, text):
    """Cut at spaces or whole: the same ids, whatever the white space."""
    pair = alignment.pair_of(*alignment.default_tokenizers())
    x = tokens(libraries, text)
    n_a, n_b, n_groups, said, _, _ = next(pair.aligned([text]))
    gs = groups(*x) if x else []
    joined = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in gs)
    assert pair.by_chunk and (n_a, n_b, n_groups, said) == ((len(x[0]), len(x[2]), len(gs), hashlib.sha256(joined.encode()).hexdigest()) if x else (0, 0, 0, ""))
