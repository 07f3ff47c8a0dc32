"""The Porter stemmer (1980) as five CASE steps over a column of words.

One table of rules gives the text of the steps for Spark SQL and, with other names for three
functions, for DuckDB. Measures of a stem are regular expressions without look-around or
back-references, so Java's and RE2's engines agree on them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the algorithm: suffixes and what replaces them, tried in this order.
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

# A consonant run, a vowel run (y after a consonant is a vowel), and what may stand before the first
# vowel-consonant pair.
_C, _V = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
_START = f"^(?:{_C}{_V}|[aeiou]+)"
MEASURE_OVER_0 = f"{_START}{_C}"
MEASURE_1 = f"{_START}{_C}(?:{_V})?$"
MEASURE_OVER_1 = f"{_START}{_C}{_V}{_C}"
HAS_VOWEL = f"^(?:{_C}[aeiouy]|[aeiou])"
#: consonant, vowel, consonant other than w, x, y - for stems of measure 1.
SHORT = f"^{_C}[aeiouy][^aeiouwxy]$"
#: A trailing run of y whose last one is a consonant.
DOUBLE_Y = "(?:^|[aeiou])y(?:yy)+$|[^aeiouy](?:yy)+$"


@dataclass(frozen=True)
class Dialect:
    match: str
    ends: str

    def m(self, s: str, pattern: str) -> str:
        return f"{self.match}({s}, '{pattern}')"

    def e(self, s: str, suffix: str) -> str:
        return f"{self.ends}({s}, '{suffix}')"


SPARK, DUCKDB = Dialect("regexp_like", "endswith"), Dialect("regexp_matches", "suffix")


def but(s: str, n: int) -> str:
    """s without its last n letters."""
    return f"left({s}, length({s}) - {n})"


def steps(d: Dialect) -> list[dict[str, str]]:
    """New columns of each step, as SQL over column w (and cut); every step reads the one before."""
    over0, over1 = lambda s: d.m(s, MEASURE_OVER_0), lambda s: d.m(s, MEASURE_OVER_1)
    short = f"({d.m('w', MEASURE_1)} AND {d.m('w', SHORT)})"
    out = []
    plural = f"CASE WHEN {d.e('w', 'sses')} OR {d.e('w', 'ies')} THEN {but('w', 2)} WHEN {d.e('w', 's')} AND NOT {d.e('w', 'ss')} THEN {but('w', 1)} ELSE w END"
    out.append({"w": plural})
    vowel = lambda n: d.m(but("w", n), HAS_VOWEL)
    past = (
        f"CASE WHEN {d.e('w', 'eed')} THEN CASE WHEN {over0(but('w', 3))} THEN {but('w', 1)} ELSE w END "
        f"WHEN {d.e('w', 'ed')} AND {vowel(2)} THEN {but('w', 2)} WHEN {d.e('w', 'ing')} AND {vowel(3)} THEN {but('w', 3)} ELSE w END"
    )
    cut = f"NOT {d.e('w', 'eed')} AND (({d.e('w', 'ed')} AND {vowel(2)}) OR ({d.e('w', 'ing')} AND {vowel(3)}))"
    out.append({"w": past, "cut": cut})
    double = f"(length(w) > 1 AND right(w, 1) = left(right(w, 2), 1) AND right(w, 1) NOT IN ('a', 'e', 'i', 'o', 'u') AND (right(w, 1) <> 'y' OR {d.m('w', DOUBLE_Y)}))"
    out.append(
        {
            "w": f"CASE WHEN NOT cut THEN w WHEN {d.e('w', 'at')} OR {d.e('w', 'bl')} OR {d.e('w', 'iz')} THEN concat(w, 'e') "
            f"WHEN {double} THEN CASE WHEN right(w, 1) IN ('l', 's', 'z') THEN w ELSE {but('w', 1)} END WHEN {short} THEN concat(w, 'e') ELSE w END"
        }
    )
    out.append({"w": f"CASE WHEN {d.e('w', 'y')} AND {vowel(1)} THEN concat({but('w', 1)}, 'i') ELSE w END"})
    for rules in (STEP2, STEP3):
        cases = " ".join(f"WHEN {d.e('w', s)} THEN CASE WHEN {over0(but('w', len(s)))} THEN concat({but('w', len(s))}, '{r}') ELSE w END" for s, r in rules)
        out.append({"w": f"CASE {cases} ELSE w END"})
    cases = " ".join(f"WHEN {d.e('w', s)} THEN CASE WHEN {over1(but('w', len(s)))} THEN {but('w', len(s))} ELSE w END" for s in STEP4)
    out.append({"w": f"CASE {cases} WHEN {d.e('w', 'sion')} OR {d.e('w', 'tion')} THEN CASE WHEN {over1(but('w', 3))} THEN {but('w', 3)} ELSE w END ELSE w END"})
    stem = but("w", 1)
    short_stem = f"({d.m(stem, MEASURE_1)} AND {d.m(stem, SHORT)})"
    out.append({"w": f"CASE WHEN {d.e('w', 'e')} AND ({d.m('w', MEASURE_OVER_1)} OR ({d.m('w', MEASURE_1)} AND NOT {short_stem})) THEN {stem} ELSE w END"})
    out.append({"w": f"CASE WHEN {d.e('w', 'll')} AND {over1('w')} THEN {but('w', 1)} ELSE w END"})
    return out


def stems_of(words: DataFrame, word: str = "raw") -> DataFrame:
    """raw, term: each distinct lower-case word with its stem; words of one or two letters stay.

    The aggregate at the end shuffles nothing (the words are dealt already) and keeps the optimizer from
    moving conditions on the stem down through the steps, where each step would multiply their size.
    """
    df = stepped(words.select(F.col(word).alias("raw")).distinct().withColumn("w", F.col("raw")))
    return df.groupBy("raw").agg(F.min(stem_of_steps()).alias("term"))


def stepped(df: DataFrame) -> DataFrame:
    """The steps over a column w."""
    df = df.withColumn("cut", F.lit(False))
    for step in steps(SPARK):
        df = df.withColumns({c: F.expr(e) for c, e in step.items()})
    return df


def stem_of_steps() -> Column:
    return F.when(F.length("raw") <= 2, F.col("raw")).otherwise(F.col("w"))


def bound_steps() -> Column:
    """The stem of raw as one expression, each step's w bound as the only element of an array: evaluated where a
    condition asks for it alone. As columns the steps make a stage's code so long that the JVM never compiles it."""
    out = "w"
    for step in reversed(steps(SPARK)):
        out = f"transform(array({step['w']}), w -> {out})[0]"
        if "cut" in step:
            out = f"transform(array({step['cut']}), cut -> {out})[0]"
    return F.expr(f"transform(array(raw), w -> {out})[0]")


def with_stems(words: DataFrame, known: DataFrame, whole: bool) -> DataFrame:
    """Adds term, the stem of raw: from a table (raw, term) that goes to all executors; unless that holds every word,
    the others are stemmed where they stand. So no word is shuffled, however many there are."""
    if whole:
        return words.join(F.broadcast(known), "raw")
    df = words.join(F.broadcast(known.withColumnRenamed("term", "known")), "raw", "left")
    return df.withColumn("term", F.coalesce("known", F.when(F.length("raw") <= 2, F.col("raw")).otherwise(bound_steps()))).drop("known")


_over_0, _over_1, _one, _vowel, _short, _double_y = (re.compile(p).search for p in (MEASURE_OVER_0, MEASURE_OVER_1, MEASURE_1, HAS_VOWEL, SHORT, DOUBLE_Y))
_RULES = [(rules, tuple(s for s, _ in rules)) for rules in (STEP2, STEP3)]
_STEP4 = tuple(STEP4)


def stem(w: str) -> str:
    """The same steps for one word of ASCII letters and digits."""
    if len(w) <= 2:
        return w
    if w[-1] == "s":
        w = w[:-2] if w.endswith(("sses", "ies")) else w if w[-2] == "s" else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _over_0(w[:-3]) else w
    elif cut := 2 if w.endswith("ed") and _vowel(w[:-2]) else 3 if w.endswith("ing") and _vowel(w[:-3]) else 0:
        w = w[:-cut]
        last = w[-1]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and last == w[-2] and last not in "aeiou" and (last != "y" or _double_y(w)):
            w = w if last in "lsz" else w[:-1]
        elif _one(w) and _short(w):
            w += "e"
    if w[-1:] == "y" and _vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules, ends in _RULES:
        if w.endswith(ends):
            s, r = next(x for x in rules if w.endswith(x[0]))
            w = w[: -len(s)] + r if _over_0(w[: -len(s)]) else w
    if w.endswith(_STEP4):
        s = next(x for x in STEP4 if w.endswith(x))
        w = w[: -len(s)] if _over_1(w[: -len(s)]) else w
    elif w.endswith(("sion", "tion")):
        w = w[:-3] if _over_1(w[:-3]) else w
    if w[-1:] == "e" and (_over_1(w) or (_one(w) and not (_one(w[:-1]) and _short(w[:-1])))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _over_1(w) else w


def stem_ctes(source: str, name: str) -> str:
    """DuckDB: a chain of common table expressions from ``source`` (a column ``raw``) to ``name``
    (columns raw, term), without the leading WITH."""
    parts, last = [], f"(SELECT DISTINCT raw, raw AS w, false AS cut FROM {source})"
    for i, step in enumerate(steps(DUCKDB)):
        parts.append(f"{name}_{i} AS MATERIALIZED (SELECT raw, {step['w']} AS w, {step.get('cut', 'cut')} AS cut FROM {last})")
        last = f"{name}_{i}"
    parts.append(f"{name} AS MATERIALIZED (SELECT raw, CASE WHEN length(raw) <= 2 THEN raw ELSE w END AS term FROM {last})")
    return ",\n".join(parts)
