"""Held-out accuracy on the driver's tables, and the pipeline stage by stage against plain versions."""

from collections import Counter

import numpy as np
from conftest import DATA

import corpus_pipeline
from quillsift.llm import queries, quality
from quillsift.llm.runtime import read_table

from .test_small import components, packed_well, repeats, targets, words


def test_language_held_out(spark):
    truth = {r.doc_id: r.lang for r in read_table(spark, f"{DATA}/sf0.01", "documents").select("doc_id", "lang").collect()}
    rows = [r for r in queries.op2_language_id(spark, f"{DATA}/sf0.01").collect() if r.held_out]
    assert len(rows) > 200 and np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.97
    accepted = [r for r in rows if not r.rejected]
    assert len(accepted) > 0.9 * len(rows) and np.mean([r.lang_pred == truth[r.doc_id] for r in accepted]) > 0.98


def test_toxicity_held_out(spark):
    truth = {r.doc_id: r.toxic for r in read_table(spark, f"{DATA}/sf0.1", "labels").collect()}
    rows = [r for r in queries.op7_toxicity(spark, f"{DATA}/sf0.1").collect() if r.held_out and r.doc_id in truth]
    assert len(rows) > 700 and np.mean([r.predicted == truth[r.doc_id] for r in rows]) > 0.96
    found = [r.predicted for r in rows if truth[r.doc_id]]
    assert np.mean(found) > 0.85


def test_pipeline(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "source_mix", "sequences"]
    sf = f"{DATA}/sf0.001"
    docs = read_table(spark, sf, "documents")
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality_rules"](spark, docs, sf)
    one = {r.doc_id: r for r in kept.collect()}
    assert kept.columns == columns and set(one) == {i for i, r in before.items() if quality.measure(r.text)[6]}
    single = stage["near_duplicates"](spark, kept, sf)
    two = {r.doc_id: r for r in single.collect()}
    assert single.columns == columns and set(two) == {i for i, _, c in components([(i, r.text) for i, r in one.items()]) if i == c}
    cut = stage["repeated_passages"](spark, single, sf)
    three = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == columns
    gone = {}
    for i, start, n, copy, _ in repeats([(i, r.text) for i, r in two.items()]):
        if copy:
            gone.setdefault(i, set()).update(range(start, start + n))
    for i, r in two.items():
        left = [w for k, w in enumerate(words(r.text)) if k not in gone.get(i, ())]
        assert (words(three[i].text) if i in three else []) == left
        assert i not in three or i in gone or three[i].text == r.text
    mix = stage["source_mix"](spark, cut, sf)
    four = mix.collect()
    assert mix.columns == columns and max(Counter(r.doc_id for r in four).values()) <= 2
    sizes, taken = Counter(), Counter()
    for r in three.values():
        sizes[r.source] += len(words(r.text))
    for r in four:
        taken[r.source] += len(words(r.text))
    want = targets(sizes)
    for s in sizes:  # as near as whole documents come
        budget, sums = want[s] % sizes[s] if want[s] < 2 * sizes[s] else 0, {0}
        for r in three.values():
            if r.source == s:
                sums |= {x + len(words(r.text)) for x in sums}
        assert abs(taken[s] - want[s]) <= min(abs(x - budget) for x in sums) + 1
    packed_well(stage["sequences"](spark, mix, sf).collect(), [(r.doc_id, r.text) for r in four])
    assert corpus_pipeline.run(spark, sf).count() > 0 and corpus_pipeline.ORACLE_SQL is None
