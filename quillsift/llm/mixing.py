"""Mixing sources to target weights by subset-sum budget fitting.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share 150 % of all
words; a target stops at twice its source's words, and the excess is reshared by weight until no
target is above. Every document of a source is taken floor(target / source size) times; the rest of
the budget is filled with one more copy of chosen documents. Which: documents are counted by exact
length, each length gives its share (rounded by a seeded number), some are given back, and a bounded
knapsack over the counts fits what is missing. If that is not met, more is given back, up to the whole
budget: so the sum is the nearest there is. Only where over MOST_WORDS are missing and more than MOST_SUMS
different sums can be made, sums closer together than a MOST_SUMS-th of the budget count as one. Last, so
many documents of each length are chosen by seeded hash.

Only counts by length reach the fitting, one group for each source; their number is bounded by the
longest text, not by the documents. Documents of one length are ranked in buckets of about
BUCKET_ROWS, so copies in any number spread over tasks.

Null text has size 0; documents of size 0 are never taken. A null source is a source of its own. Texts
of any length are counted whole. Rows are dealt one by one, whatever their doc_id (it may be null, repeated,
a string): of rows alike in doc_id, source and text, which one is taken once more is told by nothing, and
they are ranked as one row that stands for several. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.llm.runtime import partitions, stored

WEIGHTS = (5, 2, 1)
SHARE, MOST_TIMES = 1.5, 2
SEED = 20240607
BUCKET_ROWS = 1024
#: At first so many words, or the longest document, are open to the knapsack; then OPEN_FACTOR times as many
#: until the budget is met or wholly open. Above MOST_WORDS the sums are a list instead of a table.
LEAST_WORDS, OPEN_FACTOR, MOST_WORDS, MOST_SUMS = 16_384, 8, 1 << 24, 1 << 21
ROW = "__row_of_mix"
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def source_key(source: Column) -> Column:
    """Sorts by code point, null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def source_targets(sizes: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """key, source_size, target from rows key, size. Capped water-filling, a small aggregate a round;
    each round but the last caps a source more."""
    per = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy("key")  # over sources, not documents
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    per = stored(per.withColumn("weight", weight.cast("double")), "sources")
    level, left = 0.0, None
    most = F.col("source_size") * float(MOST_TIMES)
    for _ in range(most_rounds):
        capped = F.col("weight") * level > most if left is not None else F.lit(False)
        all_words, fixed, weights = per.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum(F.when(capped, most)), F.lit(0.0)), F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0))
        ).first()
        now = (SHARE * all_words - fixed) / weights if weights else level
        if left is not None and now <= level:
            break
        left, level = fixed, now
    else:
        raise RuntimeError(f"targets did not settle in {most_rounds} rounds")
    return per.select("key", "source_size", F.least(F.col("weight") * F.lit(level), most).alias("target"))


def seeded(x: np.ndarray) -> np.ndarray:
    """Numbers in [0, 1) that depend on the seed and x alone."""
    from quillsift.llm.textcore import mix

    return (mix(x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(SEED)) >> np.uint64(11)) / float(1 << 53)


def knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int) -> dict[int, int]:
    """How many of each length come nearest to the budget (over it by at most as much as under it)."""
    unit = int(np.gcd.reduce(lengths))
    lengths = lengths // unit
    goal = (2 * budget + unit) // (2 * unit)
    top = min(2 * goal, goal + int(lengths.max())) + 1
    reach = np.zeros(top + 1, bool)
    reach[0] = True
    via = np.full(top + 1, -1, np.int32)
    items: list[tuple[int, int]] = []
    order = np.argsort(seeded(lengths + 2), kind="stable")  # no length has the first call on the budget
    for length, count in zip(lengths[order].tolist(), counts[order].tolist(), strict=True):
        k = 1
        while count and length * k <= top and not reach[goal]:
            k = min(k, count)
            v = length * k
            if v > top:
                break
            new = np.flatnonzero(reach[: top + 1 - v] & ~reach[v:]) + v
            via[new] = len(items)
            reach[new] = True
            items.append((length, k))
            count -= k
            k *= 2
        if reach[goal]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums * unit - budget))])
    out: dict[int, int] = {}
    while at:
        length, k = items[via[at]]
        out[length * unit] = out.get(length * unit, 0) + k
        at -= length * k
    return out


def listed_knapsack(lengths: np.ndarray, counts: np.ndarray, budget: int, most: int | None = None) -> dict[int, int]:
    """The same with a sorted list of the sums that can be made, for few but very long documents. Over
    ``most`` sums, those of one most-th of the reach count as one."""
    most, top = most or MOST_SUMS, 2 * budget
    sums, made = np.zeros(1, np.int64), np.zeros(1, np.int64)  # and the step that made each sum first
    steps: list[tuple[int, int]] = [(0, 0)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        length, count, k = int(lengths[i]), int(counts[i]), 1
        while count and length * k <= top:
            k = min(k, count)
            v = length * k
            new = sums[sums <= top - v] + v
            at = np.minimum(np.searchsorted(sums, new), len(sums) - 1)
            new = new[sums[at] != new]
            if len(sums) + len(new) > most:  # one new sum for each cell that has none yet
                cell = new * most // (top + 1)
                first = np.concatenate([[True], cell[1:] != cell[:-1]]) if len(new) else np.zeros(0, bool)
                new = new[first & ~np.isin(cell, sums * most // (top + 1))]
            if len(new):
                steps.append((length, k))
                order = np.argsort(both := np.concatenate([sums, new]), kind="stable")
                sums, made = both[order], np.concatenate([made, np.full(len(new), len(steps) - 1)])[order]
            count, k = count - k, 2 * k
    at = int(sums[np.argmin(np.abs(sums - budget))])
    out: dict[int, int] = {}
    while at:
        length, k = steps[int(made[np.searchsorted(sums, at)])]
        out[length] = out.get(length, 0) + k
        at -= length * k
    return out


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take, so that their words come nearest to the budget."""
    take = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    if budget <= 0 or not total:
        return take
    if budget >= total:
        return counts.copy()
    take = np.minimum(counts, np.floor(budget / total * counts + seeded(lengths)).astype(np.int64))
    useful = lengths <= 2 * budget  # with a longer one the sum is further off than without any
    take[~useful] = 0
    if not useful.any():
        return take
    unit = int(np.gcd.reduce(lengths[useful]))
    least = min(budget % unit, -budget % unit)
    room, best, off = max(LEAST_WORDS, int(lengths[useful].max())), take, budget + 1
    while True:
        tried, left = opened(lengths, np.where(useful, counts, 0), take, budget, room)
        fits = useful & (counts > tried)
        if left > 0 and fits.any():
            where = {int(x): i for i, x in enumerate(lengths)}
            for length, k in knapsack(lengths[fits], (counts - tried)[fits], left).items():
                tried[where[length]] += k
        miss = abs(budget - int((tried * lengths).sum()))
        if miss < off:
            best, off = tried, miss
        if off <= least or room >= budget or not fits.any():
            return best
        if room >= MOST_WORDS:  # a table of sums would be too large
            break
        room = min(OPEN_FACTOR * room, max(room, MOST_WORDS))
    tried = np.zeros(len(lengths), np.int64)
    where = {int(x): i for i, x in enumerate(lengths)}
    for length, k in listed_knapsack(lengths[useful], counts[useful], budget).items():
        tried[where[length]] = k
    return tried if abs(budget - int((tried * lengths).sum())) < off else best


def opened(lengths: np.ndarray, counts: np.ndarray, take: np.ndarray, budget: int, room: int) -> tuple[np.ndarray, int]:
    """What to take so that from room to 2 * room words of the budget (all of it, if it is smaller) are
    left, and how many are. No length is above room."""
    take = take.copy()
    left = budget - int((take * lengths).sum())
    order = np.argsort(seeded(lengths + 1), kind="stable")
    for i in order:  # give some back, so that the knapsack has choice enough
        if left >= room:
            break
        k = min(int(take[i]), -((left - room) // int(lengths[i])))
        take[i] -= k
        left += k * int(lengths[i])
    for i in order:  # far too little: whole documents in seeded order
        if left <= 2 * room:
            break
        k = min(int(counts[i] - take[i]), (left - room) // int(lengths[i]))
        take[i] += k
        left -= k * int(lengths[i])
    return take, left


def fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size").reset_index(drop=True)
    size, target = int(rows.source_size[0]), float(rows.target[0])
    base = min(MOST_TIMES, int(target // size)) if size else 0
    budget = int(round(target - base * size)) if base < MOST_TIMES else 0
    return rows[["key", "size"]].assign(base=base, more=fit(rows["size"].to_numpy(), rows["n"].to_numpy(), budget))


def mix_copies(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, key, size, source_size, target, rows, base, once_more: rows that are alike, each taken base
    times and once_more of them once again. Of the columns in ``more`` the least value is kept."""
    h = F.xxhash64(F.lit(SEED), "doc_id", "source", "text")
    sized = docs.select("doc_id", source_key(F.col("source")).alias("key"), n_words(F.col("text")).alias("size"), h.alias("h"), *more)
    sized = stored(sized.groupBy("doc_id", "key", "size", "h").agg(F.count("*").alias("rows"), *[F.min(c).alias(c) for c in more]), "sizes")
    counts = stored(sized.groupBy("key", "size").agg(F.sum("rows").alias("n")), "lengths")
    targets = stored(source_targets(counts.select("key", (F.col("size") * F.col("n")).alias("size"))), "targets")
    plan = (
        counts.where("size > 0")
        .join(targets, "key")
        .select("key", "size", "n", "source_size", "target")
        .groupBy("key")
        .applyInPandas(fit_source, "key string, size long, base long, more long")
    )
    plan = stored(plan.join(counts, ["key", "size"]).withColumn("buckets", F.ceil(F.col("n") / BUCKET_ROWS).cast("long")), "plan")
    dealt = sized.join(plan, ["key", "size"], "left").withColumn("bucket", F.when((F.col("more") > 0) & (F.col("more") < F.col("n")), F.pmod("h", "buckets")))
    # dealt by bucket too: else the windows would take over the join's dealing by length, hot lengths and all
    some = dealt.where("bucket is not null").repartition(partitions(docs.sparkSession), "key", "size", "bucket")
    before = some.groupBy("key", "size", "bucket").agg(F.sum("rows").alias("in_bucket")).withColumn(
        "before", F.sum("in_bucket").over(Window.partitionBy("key", "size").orderBy("bucket")) - F.col("in_bucket")
    )
    upto = F.sum("rows").over(Window.partitionBy("key", "size", "bucket").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    left = F.col("more") - F.col("before") - (F.col("upto") - F.col("rows"))  # for these rows and those behind them
    ranked = some.withColumn("upto", upto).join(before, ["key", "size", "bucket"]).withColumn("once_more", F.greatest(F.lit(0), F.least("rows", left)))
    rest = dealt.where("bucket is null").withColumn("base", F.coalesce("base", F.lit(0))).withColumn("once_more", F.when(F.col("more") > 0, F.col("rows")).otherwise(0))
    columns = ["doc_id", "key", "size", "rows", "base", "once_more", *more]
    return ranked.select(columns).unionByName(rest.select(columns)).join(targets, "key")


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, source for each document."""
    source = F.when(F.substring("key", 1, 1) == "0", F.expr("substring(key, 2)"))
    whole = lambda n: F.lit(n).cast("long")
    alike = mix_copies(docs)
    # rows alike in any number: first by numbers of up to BUCKET_ROWS, which are dealt out, then one by one
    many = alike.where(F.col("rows") > BUCKET_ROWS).withColumn("first", F.explode(F.sequence(whole(1), F.col("rows"), whole(BUCKET_ROWS)))).repartition(partitions(docs.sparkSession))
    some = alike.where(F.col("rows") <= BUCKET_ROWS).withColumn("first", whole(1)).unionByName(many)
    each = some.withColumn("i", F.explode(F.sequence(F.col("first"), F.least(F.col("rows"), F.col("first") + whole(BUCKET_ROWS - 1)))))
    taken = F.col("size") * (F.col("base") + F.when(F.col("i") <= F.col("once_more"), 1).otherwise(0))
    return each.select("doc_id", "size", "source_size", "target", taken.alias("taken"), source.alias("source"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken, with the columns it came with. The rows are
    written once under numbers, which name them whatever their ids are; of rows alike in doc_id, source and
    text the first stands for all."""
    held = stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    times = mix_copies(held, ROW).select(ROW, (F.col("rows") * F.col("base") + F.col("once_more")).cast("int").alias("__times")).where("__times > 0")
    each = held.join(times, ROW)
    return each.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.array_repeat(F.lit(True), F.col("__times"))).alias("__copy_of_mix")).drop("__copy_of_mix")
