"""Suffix-array dedup with sparse suffixes.

Finds every passage of LEAST words or more that occurs at two places or more. Only suffixes at
content-selected positions are kept: the leftmost smallest hash of GRAM words within each window of
LEAST words (minimisers). Equal windows select the same place in themselves, so nothing is missed; about
one position in 18 is kept, and each window belongs to one suffix, its selector.

Suffixes are brought together by their first words. Those equal in all the words of their windows form
a class: a partial aggregate, so copies in any number cost one row. The classes that share their first
words are sorted and neighbours are compared: each suffix is extended to the left and right to each of its
windows, equal extensions lie side by side, and adjacent ones unite to maximal matches of any length.
First words that over GROUP classes share are dealt again by the extended content, so no task holds an
unbounded group.

Of equal passages the first (smallest doc_id, then place) is the original, all others are copies.

Words are ``[^\\x20\\x09-\\x0D]+``; spans are in words. Null and empty texts hold nothing; texts of any
length are read whole. Rows without a doc_id are left out. A document is a doc_id with a text: a repeated
row is no repeat of itself, and several texts under one id are documents of their own, in the order of
their hashes. Ids may be numbers or strings. An empty table gives an empty result. Only doc_id and text
are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm import textcore
from quillsift.llm.runtime import dropped, partitions, split_by_bitmap, steady, stored

LEAST, GRAM = 50, 16
LEFT = LEAST - GRAM
SPAN = LEFT + LEAST
#: Classes of equal first words that one task compares; some 700 bytes each. So many rows are compared at a time.
GROUP, AT_ONCE = 20_000, 4096


def selectors(grams: np.ndarray) -> np.ndarray:
    """For each window of LEFT + 1 grams the place of its leftmost smallest hash; never falls."""
    window = LEFT + 1
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, size = grams, 1
    while 2 * size <= window:  # minima of windows by doubling
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    low = np.minimum(low[:n], low[window - size : window - size + n])
    out = np.empty(n, np.int64)
    at = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    for s, e in zip(at.tolist(), np.append(at[1:], n).tolist(), strict=True):
        hits = s + np.flatnonzero(grams[s : e + window - 1] == low[s])
        out[s:e] = hits[0] if len(hits) == 1 else hits[np.searchsorted(hits, np.arange(s, e))]
    return out


_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)
_INVERSE_BASE = np.uint64(pow(int(textcore.WORD_BASE), -1, 1 << 64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        one = np.ones(1, np.uint64)
        _powers = np.multiply.accumulate(np.concatenate([one, np.full(2 * n, textcore.WORD_BASE)]))
        _inverse = np.multiply.accumulate(np.concatenate([one, np.full(2 * n, _INVERSE_BASE)]))
    return _powers[:n], _inverse[:n]


def suffixes_of(words: np.ndarray) -> tuple[np.ndarray, ...]:
    """Place, words to the left and to the right that its windows span, hash of the first words and hash
    of all those words, for each sparse suffix."""
    grams = textcore.ngram_hashes(words, GRAM)
    own = selectors(grams)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else own
    last = np.append(first[1:], len(own)) - 1 if len(own) else own
    p = own[first]
    up, down = powers(len(words) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * up[: len(words)])])
    left, right = p - first, last + LEAST - p
    content = (sums[last + LEAST] - sums[first]) * down[first]
    around = textcore.mix(content ^ textcore.mix((left * 4096 + right).astype(np.uint64)))
    return p, left, right, grams[p], around


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, p, left, right, gram, around: the sparse suffixes of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts, ids, hashes, n = [], [], [], []
            for doc_id, text_hash, text in zip(b.doc_id, b.text_hash, b.text, strict=True):
                words = textcore.word_hashes(textcore.raw(text))
                if len(words) >= LEAST:
                    p, left, right, gram, around = suffixes_of(words)
                    n.append(len(p))
                    ids.append(doc_id)
                    hashes.append(text_hash)
                    parts.append((p, left, right, gram.view(np.int64), around.view(np.int64)))
            if parts:
                each = dict(zip(("p", "left", "right", "gram", "around"), map(np.concatenate, zip(*parts, strict=True)), strict=True))
                yield pd.DataFrame({"doc_id": pd.Series(ids).repeat(n).array, "text_hash": np.repeat(hashes, n)} | each)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.where("doc_id is not null").mapInPandas(run, f"doc_id {kind}, text_hash long, p int, left int, right int, gram long, around long")


def extensions(words: np.ndarray, length: np.ndarray, left: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows of up to SPAN word hashes: a hash of each window of LEAST words (and of where the suffix
    begins in it), with the row and the start of each."""
    up, down = powers(SPAN + 1)
    sums = np.zeros((len(words), SPAN + 1), np.uint64)
    np.cumsum(words * up[:SPAN], axis=1, out=sums[:, 1:])
    s = np.arange(LEFT + 1)
    place = textcore.mix(gram)[:, None] ^ textcore.mix((left[:, None] - s[None, :]).astype(np.uint64))
    h = textcore.mix((sums[:, LEAST:] - sums[:, : LEFT + 1]) * down[: LEFT + 1] ^ place)
    row, start = np.nonzero(s[None, :] + LEAST <= length[:, None])
    return h[row, start], row, start


def matrix(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    out, length = np.zeros((len(blobs), SPAN), np.uint64), np.array([len(x) // 8 for x in blobs])
    for i, x in enumerate(blobs):
        out[i, : length[i]] = np.frombuffer(x, np.uint64)
    return out, length


def runs(row: np.ndarray, start: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches covered by runs of LEAST words: row, begin, end."""
    edge = np.zeros((rows, SPAN + 2), np.int32)
    np.add.at(edge, (row, start), 1)
    np.add.at(edge, (row, start + LEAST), -1)
    inside = (np.cumsum(edge, axis=1) > 0).astype(np.int8)
    step = np.diff(inside, axis=1, prepend=0)
    a, b = np.nonzero(step == 1), np.nonzero(step == -1)
    return a[0], a[1], b[1]


#: The first_doc of matches has the type of the ids.
MATCHES = "gram long, around long, a int, b int, is_copy boolean, first_doc {}"


def compared(classes: pd.DataFrame) -> pd.DataFrame:
    """Matches between classes (is_copy: the class has an earlier one; else it is the earliest, and
    there are others or other members of its own); the rows of a gram are all there."""
    classes = classes.drop_duplicates(["gram", "around"], ignore_index=True)  # repeated documents brought their classes again
    words, length = matrix(list(classes.words))
    left, several = classes.left.to_numpy(), classes.several.to_numpy().astype(bool)
    h, row, start = extensions(words, length, left, classes.gram.to_numpy().view(np.uint64))
    code, ids = pd.factorize(classes.first_doc, sort=True)
    rank = np.empty(len(classes), np.int64)
    rank[np.lexsort((classes.first_p, classes.first_hash, code))] = np.arange(len(classes))
    order = np.lexsort((rank[row], h))
    h, row, start = h[order], row[order], start[order]
    if not len(h):
        return pd.DataFrame(columns=[x.split()[0] for x in MATCHES.split(", ")])
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    of = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(h))))
    lead = row[at][of]  # the earliest class with this content
    some = np.maximum.reduceat((row != lead).astype(np.int8), at)[of] > 0
    out = []
    for copy in (True, False):
        pick = row != lead if copy else (row == lead) & (some | several[row])
        r, a, b = runs(row[pick], start[pick], len(classes))
        first = np.full(len(classes), len(ids))
        np.minimum.at(first, row[pick], code[lead[pick]])
        c = classes.iloc[r]
        out.append(pd.DataFrame({"gram": c.gram.to_numpy(), "around": c.around.to_numpy(), "a": a - left[r], "b": b - left[r], "is_copy": copy, "first_doc": ids[first[r]]}))
    return pd.concat(out)


def grouped_matches(classes: DataFrame) -> DataFrame:
    """Matches within each gram's classes, some thousand rows at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= AT_ONCE:
                all_rows = pd.concat(held, ignore_index=True)
                whole = all_rows.gram.to_numpy() != all_rows.gram.iloc[-1]
                if whole.any():
                    yield compared(all_rows[whole].reset_index(drop=True))
                held = [all_rows[~whole]]
        if held and len(rest := pd.concat(held, ignore_index=True)):
            yield compared(rest)

    n = partitions(classes.sparkSession)
    return classes.repartition(n, "gram").sortWithinPartitions("gram").mapInPandas(run, MATCHES.format(dict(classes.dtypes)["first_doc"]))


def dealt_matches(classes: DataFrame) -> DataFrame:
    """The same for grams of very many classes: the extended content is the key of an aggregate."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words, length = matrix(list(b.words))
            h, row, start = extensions(words, length, b.left.to_numpy(), b.gram.to_numpy().view(np.uint64))
            c = b.drop(columns="words").iloc[row]
            yield pd.DataFrame({"h": h.view(np.int64), "gram": c.gram, "around": c.around, "s": start - c.left.to_numpy(), "first_doc": c.first_doc, "first_hash": c.first_hash, "first_p": c.first_p, "several": c.several})

    kind = dict(classes.dtypes)["first_doc"]
    rows = classes.mapInPandas(spread, f"h long, gram long, around long, s int, first_doc {kind}, first_hash long, first_p int, several boolean")
    leads = rows.groupBy("h").agg(F.min(F.struct("first_doc", "first_hash", "first_p", "around")).alias("lead"), (F.min("around") != F.max("around")).alias("some"))
    marks = rows.join(leads, "h").withColumn("is_copy", F.col("around") != F.col("lead.around")).where("is_copy or some or several")
    marks = marks.select("gram", "around", "s", "is_copy", F.col("lead.first_doc").alias("first_doc"))
    per = marks.groupBy("gram", "around", "is_copy").agg(F.collect_set("s").alias("s"), F.min("first_doc").alias("first_doc"))  # at most LEFT + 1 starts each

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            row = np.repeat(np.arange(len(b)), [len(x) for x in b.s])
            start = np.concatenate([np.asarray(x) for x in b.s]) + LEFT if len(b) else np.zeros(0, int)
            r, a, e = runs(row, start, len(b))
            c = b.iloc[r]
            yield pd.DataFrame({"gram": c.gram, "around": c.around, "a": a - LEFT, "b": e - LEFT, "is_copy": c.is_copy, "first_doc": c.first_doc})

    return per.mapInPandas(unite, MATCHES.format(kind))


def with_words(picked: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds to classes the word hashes of their windows, from their first place: left, words."""
    place = ("gram", "around", "first_p", "several")
    wanted = picked.groupBy("first_doc", "first_hash").agg(F.collect_list(F.struct(*place)).alias("wanted"))  # no more than a document has suffixes
    wanted = wanted.select("first_doc", "first_hash", *[F.col(f"wanted.{c}").alias(c) for c in place])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text_hash, text, grams, arounds, places, several in zip(b.first_doc, b.first_hash, b.text, b.gram, b.around, b.first_p, b.several, strict=True):
                words = textcore.word_hashes(textcore.raw(text))
                p, left, right, _, _ = suffixes_of(words)
                at = {x: i for i, x in enumerate(p.tolist())}
                for g, a, x, many in zip(grams.tolist(), arounds.tolist(), places.tolist(), several.tolist(), strict=True):
                    i = at[x]
                    rows.append((g, a, doc_id, text_hash, x, left[i], many, words[x - left[i] : x + right[i]].tobytes()))
            yield pd.DataFrame(rows, columns=["gram", "around", "first_doc", "first_hash", "first_p", "left", "several", "words"])

    rows = docs.select(F.col("doc_id").alias("first_doc"), F.col("text_hash").alias("first_hash"), "text").join(wanted, ["first_doc", "first_hash"])
    return rows.mapInPandas(run, f"gram long, around long, first_doc {dict(docs.dtypes)['doc_id']}, first_hash long, first_p int, left int, several boolean, words binary")


#: What names a document, and the first place of a class.
DOC, FIRST = ["doc_id", "text_hash"], ["first_doc", "first_hash", "first_p"]


def spans_by_document(docs: DataFrame) -> DataFrame:
    """The rows of ``repeated_spans`` with the text_hash of the document that each belongs to."""
    steady(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    kind = dict(docs.dtypes)["doc_id"]
    all_anchors = stored(anchors(docs), "anchors")
    place = F.xxhash64(*DOC, "p")
    grams = all_anchors.groupBy("gram").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.min("around").alias("c0"), F.max("around").alias("c1")).where("x <> y")
    # stored first, so that the join's other side may be split where a gram is hot
    grams = stored(grams.select("gram", (F.col("c0") != F.col("c1")).alias("varied")), "grams")
    hits = stored(all_anchors.join(grams, "gram"), "hits")
    dropped(all_anchors, grams)
    classes = stored(
        hits.groupBy("gram", "around", "varied").agg(F.min(F.struct(*DOC, "p")).alias("first"), F.min(place).alias("x"), F.max(place).alias("y"))
        .select("gram", "around", "varied", F.col("first.doc_id").alias("first_doc"), F.col("first.text_hash").alias("first_hash"), F.col("first.p").alias("first_p"), (F.col("x") != F.col("y")).alias("several")),
        "classes",
    )
    varied = stored(with_words(classes.where("varied").select("gram", "around", *FIRST, "several"), docs), "contexts")
    crowded = varied.groupBy("gram").agg(F.count("*").alias("k")).where(F.col("k") > GROUP).select("gram")
    crowded = stored(crowded, "crowded")
    across = grouped_matches(varied.join(crowded, "gram", "left_anti"))
    if not crowded.isEmpty():
        across = across.unionByName(dealt_matches(varied.join(crowded, "gram")))
    across = stored(across, "across")
    dropped(varied, crowded)
    # within classes: every member but the first is a copy in all its windows; the first one is original
    # unless a comparison with other classes decides that
    is_first = (F.col("doc_id") == F.col("first_doc")) & (F.col("text_hash") == F.col("first_hash")) & (F.col("p") == F.col("first_p"))
    own = hits.join(classes.where("several").select("gram", "around", *FIRST), ["gram", "around"])
    own = own.withColumn("is_copy", ~is_first).where("is_copy or not varied")
    own = own.select(*DOC, (F.col("p") - F.col("left")).alias("a"), (F.col("p") + F.col("right")).alias("b"), "is_copy", "first_doc")
    # matches across classes hold for each member; the originals' other members are copies already
    matches = stored(across.withColumnRenamed("first_doc", "found_doc").join(classes.select("gram", "around", *FIRST), ["gram", "around"]), "matches")
    spread = hits.join(matches, ["gram", "around"]).where(F.col("is_copy") | is_first)
    spread = spread.select(*DOC, (F.col("p") + F.col("a")).alias("a"), (F.col("p") + F.col("b")).alias("b"), "is_copy", F.col("found_doc").alias("first_doc"))
    marks = own.unionByName(spread).groupBy(*DOC, "is_copy", "a", "b").agg(F.min("first_doc").alias("first_doc"))
    per = marks.groupBy(*DOC, "is_copy").agg(F.array_sort(F.collect_list(F.struct("a", "b", "first_doc"))).alias("marks"))  # no more than a document has suffixes
    per = per.select(*DOC, "is_copy", *[F.col(f"marks.{c}").alias(c) for c in ("a", "b", "first_doc")])

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text_hash, copy, starts, ends, firsts in zip(b.doc_id, b.text_hash, b.is_copy, b.a, b.b, b.first_doc, strict=True):
                # a stretch begins where no earlier one reaches
                reach = np.maximum.accumulate(ends)
                at = np.flatnonzero(np.concatenate([[True], starts[1:] > reach[:-1]]))
                until = np.append(at[1:], len(starts)) - 1
                for s, e, u, v in zip(starts[at].tolist(), reach[until].tolist(), at.tolist(), until.tolist(), strict=True):
                    rows.append((doc_id, text_hash, s, e - s, copy, min(firsts[u : v + 1])))
            yield pd.DataFrame(rows, columns=["doc_id", "text_hash", "start_word", "n_words", "is_copy", "first_doc_id"])

    out = stored(per.mapInPandas(unite, f"doc_id {kind}, text_hash long, start_word long, n_words long, is_copy boolean, first_doc_id {kind}"), "spans")
    dropped(hits, classes, across, matches)
    return out


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, start_word, n_words, is_copy, first_doc_id: the maximal stretches of each document that
    lie in passages repeated elsewhere (is_copy: there is an earlier occurrence; else these are the
    originals). first_doc_id is the smallest id that holds an original of a part of the stretch."""
    return spans_by_document(docs).drop("text_hash")


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans and the white space behind each of them."""
    if text is None or not spans:
        return text
    data = textcore.raw(text)
    starts, _ = textcore.spans(np.frombuffer(data, np.uint8))
    out, at = [], 0
    for s, n in sorted(spans):
        if s < len(starts):
            out.append(data[at : max(at, starts[s])])
            at = max(at, int(starts[s + n]) if s + n < len(starts) else len(data))
    out.append(data[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents with every copied passage cut out (originals stay), with the columns they came
    with; n_chars, where there is such a column, counts anew. Each row loses the copies of its own text
    alone, whatever else is stored under its id; rows without an id stay as they are. Documents of which
    no word is left go. Only rows that may hold copies are shuffled, as a bitmap of their documents tells."""
    copies = spans_by_document(docs).where("is_copy").groupBy(*DOC).agg(F.collect_list(F.struct("start_word", "n_words")).alias("spans"))
    copies = stored(copies, "copies")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else without_spans(t, [(x["start_word"], x["n_words"]) for x in s]) for t, s in zip(texts, spans, strict=True)], dtype=object)

    apart, unsure = split_by_bitmap(docs, copies, [F.col("doc_id"), F.xxhash64("text")], [F.col(c) for c in DOC])
    same = (F.col("d.doc_id") == F.col("c.doc_id")) & (F.xxhash64("d.text") == F.col("c.text_hash"))
    joined = unsure.alias("d").join(copies.alias("c"), same, "left").withColumn("__cut", cut(F.col("d.text"), F.col("c.spans")))
    fresh = {"text": F.col("__cut")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.when(F.col("c.spans").isNull(), F.col("d.n_chars")).otherwise(F.length("__cut").cast(dict(docs.dtypes)["n_chars"]))
    left = joined.where(F.col("c.spans").isNull() | F.col("__cut").rlike(r"[^\x20\x09-\x0D]")).select(*[fresh.get(c, F.col(f"d.`{c}`")).alias(c) for c in docs.columns])
    return apart.unionByName(left)
