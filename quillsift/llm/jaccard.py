"""N-gram Jaccard join by signature trees.

Documents are sets of hashed five-word shingles. Two link when 100 * intersection >= 75 * union.

Distribution. Equal sets are first made one (a partial aggregate by set hash), so copies in any number
cost one row. Each set then joins the blocks of its KEYS smallest shingle hashes (or of its
floor(n / 4) + 1 smallest, if those are fewer: then sharing one is certain for linked sets). In a random
order of the shingles each of the first KEYS of the union lies in both sets with probability of at least
3/4, so linked sets of any size share a block but for a chance of 4 ** -KEYS, below that of a collision
of hashes; ``keys=None`` takes floor(n / 4) + 1 for sets of any size. Blocks of one set end there.
Bitmaps and texts are held in buckets of set_id, so each pass shuffles its block rows to them and nothing
else, and then only the texts of sets that the bitmaps leave a partner.

Inside a block a signature tree is joined with itself: a set's signature is a bitmap of its shingles, a
node holds the OR of its children's bitmaps and the range of their sizes. Dual traversal drops a pair of
nodes when sizes are too far apart or when the common bits (plus what bit collisions may hide) are
fewer than the overlap that any linked pair needs. Only sets with a surviving partner in another
component go on; their texts then meet in the same blocks, the trees are traversed again, and surviving
pairs are counted exactly. A union-find skips pairs that are connected already, so a group of copies
costs a number of comparisons about linear in its size.

Passes. 1: blocks of the smallest hashes only, which connects most groups. 2: of each component one set
in each block. 3: whole blocks that still hold several components, unless pass 2 saw all of them. A
block of over BLOCK_SETS sets or BLOCK_SHINGLES shingles is cut into chunks, and pass 3 joins each two
chunks in a task of their own, so no task holds an unbounded group and no link is lost. Small blocks
with the same sets are looked at once.

Null and empty texts have no shingles and link with nothing. Rows without a doc_id get no component
and link with nothing. Repeated rows are equal sets. Texts of any length are read whole. An empty table
gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsift.llm import textcore
from quillsift.llm.runtime import bucketed, connected_components, dropped, partitions, split_by_bitmap, steady, stored

SHINGLE, KEYS, HOME_KEYS = 5, 24, 2
#: What makes a text the sorted set of 64-bit hashes that is joined.
Sets = Callable[[str | None], np.ndarray]
BLOCK_SETS, BLOCK_SHINGLES = 4096, 1 << 21
LEAF, FANOUT, SMALL_BLOCK = 8, 8, 16
#: Bits for each shingle of a size class's largest set.
BITS = 4


def linked(inter: int, a: int, b: int) -> bool:
    return 100 * inter >= 75 * (a + b - inter)


def least_overlap(total):
    """The smallest intersection of two linked sets whose sizes sum to total: 7 i >= 3 total."""
    return -(-3 * total // 7)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    c = np.concatenate([a, b])
    c.sort(kind="stable")
    return int((c[1:] == c[:-1]).sum())


class Forest:
    """Union-find; the smallest index is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def size_class(n: int) -> int:
    """Powers of two: linked sets are in one class or in adjacent ones."""
    return n.bit_length()


def bits_of(k: int) -> int:
    return max(64, BITS << k)


def signature(s: np.ndarray) -> np.ndarray:
    """A set's bitmap, of the length of its size class. The low bits of a hash name its bit, so a bitmap
    of half the length is the OR of the two halves."""
    bits = bits_of(size_class(len(s)))
    out = np.zeros(bits, np.uint8)
    out[s & np.uint64(bits - 1)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


class Tree:
    """Levels of nodes from the sets (level 0) up: OR of bitmaps, least and greatest size, most
    shingles hidden by collisions of bits."""

    def __init__(self, sig: np.ndarray, size: np.ndarray):
        self.levels = [(sig, size, size, size - np.bitwise_count(sig).sum(axis=1).astype(np.int64))]
        width = LEAF
        while len(self.levels[-1][1]) > 1:
            sig, low, high, hidden = self.levels[-1]
            at = np.arange(0, len(low), width)
            self.levels.append((np.bitwise_or.reduceat(sig, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(hidden, at)))
            width = FANOUT


def may_link(s: tuple, t: tuple, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of nodes could hold linked sets, by sizes and maximum possible overlap."""
    (sig, low, high, hidden), (sig2, low2, high2, hidden2) = s, t
    ok = (4 * high[a] >= 3 * low2[b]) & (4 * high2[b] >= 3 * low[a])
    i = np.flatnonzero(ok)
    for c in range(0, len(i), 1 << 15):
        j = i[c : c + (1 << 15)]
        bound = np.bitwise_count(sig[a[j]] & sig2[b[j]]).sum(axis=1).astype(np.int64) + np.minimum(hidden[a[j]], hidden2[b[j]])
        bound = np.minimum(bound, np.minimum(high[a[j]], high2[b[j]]))
        ok[j] = bound >= least_overlap(low[a[j]] + low2[b[j]])
    return ok


def children(nodes: np.ndarray, width: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """For each node its children, and which node each belongs to."""
    start = nodes * width
    n = np.minimum(width, count - start)
    which = np.repeat(np.arange(len(nodes)), n)
    return start[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n), which


def expand(a: np.ndarray, b: np.ndarray, width: int, counts: tuple[int, int], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of children of pairs of nodes; in a self-join each pair once."""
    x, which = children(a, width, counts[0])
    y, again = children(b[which], width, counts[1])
    x = x[again]
    keep = x <= y if same else slice(None)
    return x[keep], y[keep]


def survivors(s: Tree, t: Tree, roots: Callable[[], np.ndarray], p: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dual traversal of two trees, or of one with itself. Yields pairs of sets (of their indexes p, q)
    that may be linked and aren't in one component by now."""
    same, top = s is t, max(len(s.levels), len(t.levels)) - 1
    level = lambda tree, k: tree.levels[min(k, len(tree.levels) - 1)]
    a = b = np.zeros(1, np.int64)
    for k in range(top, 0, -1):
        ok = may_link(level(s, k), level(t, k), a, b)
        a, b = a[ok], b[ok]
        if k == 1:
            break
        down = [k - 1 < len(x.levels) - 1 for x in (s, t)]
        if down[0] and down[1]:
            a, b = expand(a, b, FANOUT, (len(level(s, k - 1)[1]), len(level(t, k - 1)[1])), same)
        elif down[0]:
            a, w = children(a, FANOUT, len(level(s, k - 1)[1]))
            b = b[w]
        elif down[1]:
            b, w = children(b, FANOUT, len(level(t, k - 1)[1]))
            a = a[w]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    for c in range(0, len(a), 512):
        r = roots()
        x, y = a[c : c + 512], b[c : c + 512]
        one, other = uniform(r[p], LEAF), uniform(r[q], LEAF)
        keep = (one[x] < 0) | (one[x] != other[y])
        x, y = expand(x[keep], y[keep], LEAF, (len(p), len(q)), same)
        keep = (r[p[x]] != r[q[y]]) & ((x < y) if same else True)
        x, y = x[keep], y[keep]
        ok = may_link(s.levels[0], t.levels[0], x, y)
        yield p[x[ok]], q[y[ok]]


def uniform(roots: np.ndarray, width: int) -> np.ndarray:
    """For each leaf the component that all its sets are in, or -1."""
    at = np.arange(0, len(roots), width)
    low, high = np.minimum.reduceat(roots, at), np.maximum.reduceat(roots, at)
    return np.where(low == high, low, -1)


def block_survivors(sigs: list[np.ndarray], sizes: list[int], roots: Callable[[], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of sets of a block that may be linked, from their bitmaps."""
    size = np.array(sizes)
    order = np.lexsort(([int(x[0]) for x in sigs], size))
    classes: dict[int, list[int]] = {}
    for i in order.tolist():
        classes.setdefault(size_class(sizes[i]), []).append(i)
    for k in sorted(classes):
        own = np.array(classes[k])
        mine = np.stack([sigs[i] for i in own])
        tree = Tree(mine, size[own])
        if len(own) > 1:
            yield from survivors(tree, tree, roots, own, own)
        if k + 1 in classes:
            more = np.array(classes[k + 1])
            wide = np.stack([sigs[i] for i in more])
            if wide.shape[1] > mine.shape[1]:
                wide = wide[:, : mine.shape[1]] | wide[:, mine.shape[1] :]
            yield from survivors(tree, Tree(wide, size[more]), roots, own, more)


def start_forest(n: int, components: list | None) -> Forest:
    forest, first = Forest(n), {}
    for i, c in enumerate(components or ()):
        forest.union(first.setdefault(c, i), i)
    return forest


def join_block(sets: list[np.ndarray], components: list | None = None) -> list[tuple[int, int]]:
    """Links that connect the sets of a block as all its links do. Sets of equal components count as
    connected."""
    forest, links = start_forest(len(sets), components), []
    sizes = [len(s) for s in sets]
    now = lambda: np.array([forest.find(i) for i in range(len(sets))])
    for a, b in block_survivors([signature(s) for s in sets], sizes, now):
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            if forest.find(i) != forest.find(j) and linked(overlap(sets[i], sets[j]), sizes[i], sizes[j]):
                forest.union(i, j)
                links.append((i, j))
    return links


def with_partner(sigs: list[np.ndarray], sizes: list[int], components: list) -> np.ndarray:
    """Which sets of a block have a partner in another component that they may be linked with."""
    forest, out = start_forest(len(sigs), components), np.zeros(len(sigs), bool)
    roots = np.array([forest.find(i) for i in range(len(sigs))])
    for a, b in block_survivors(sigs, sizes, lambda: roots):
        out[a] = out[b] = True
    return out


def shingles(text: str | None) -> np.ndarray:
    return textcore.shingle_set(text, SHINGLE)


def shingled(docs: DataFrame, sets: Sets = shingles, most_keys: int | None = KEYS) -> DataFrame:
    """doc_id, n, set_id, keys, sig, text_hash for each document; set_id, keys, sig are null without shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, ids, keys, sigs = [], [], [], []
            for text in b.text:
                s = sets(text)
                n.append(len(s))
                ids.append(int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None)
                keys.append(s[: min(most_keys or len(s), len(s) // 4 + 1)].view(np.int64) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            # an array with a mask: floats would not hold the ids
            yield pd.DataFrame({"doc_id": b.doc_id, "n": n, "set_id": pd.array(ids, "Int64"), "keys": keys, "sig": sigs, "text_hash": b.text_hash})

    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.where("doc_id is not null").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInPandas(run, f"doc_id {kind}, n long, set_id long, keys array<long>, sig binary, text_hash long")


BLOCK = ["b0", "b1", "b2"]


def by_block(rows: DataFrame, *columns: str) -> DataFrame:
    """The rows of a block one after another in one task. Nothing is decided by the order of blocks."""
    n = partitions(rows.sparkSession)
    return rows.select(*BLOCK, "set_id", "component", *columns).repartition(n, *BLOCK).sortWithinPartitions(*BLOCK, "set_id")


def blocks_in(batches: Iterator[pd.DataFrame], *columns: str) -> Iterator[list[tuple]]:
    """Lists of (block, set_id, component, columns...) by block."""
    key, held = None, []
    for b in batches:
        for row in zip(zip(b.b0, b.b1, b.b2, strict=True), b.set_id, b.component, *(b[c] for c in columns), strict=True):
            if row[0] != key:
                if len(held) > 1:
                    yield held
                key, held = row[0], []
            held.append(row)
    if len(held) > 1:
        yield held


def promising(rows: DataFrame, sigs: DataFrame) -> DataFrame:
    """rows: block, set_id, component. Those whose bitmaps leave them a partner."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in blocks_in(batches, "n", "sig"):
            keep = with_partner([np.frombuffer(r[4], np.uint64) for r in held], [int(r[3]) for r in held], [r[2] for r in held])
            if keep.any():
                yield pd.DataFrame([(*r[0], r[1], r[2]) for r, k in zip(held, keep, strict=True) if k], columns=[*BLOCK, "set_id", "component"])

    return by_block(rows.join(sigs, "set_id"), "n", "sig").mapInPandas(run, "b0 long, b1 int, b2 int, set_id long, component long")


def distinct_blocks(rows: DataFrame) -> DataFrame:
    """Of small blocks that hold the same sets one is kept: the names of the blocks that stay."""
    sizes = rows.groupBy(*BLOCK).agg(F.count("*").alias("k"), F.sum(F.xxhash64("set_id", F.lit(1)).cast("decimal(38,0)")).alias("x"), F.sum(F.xxhash64("set_id", F.lit(2)).cast("decimal(38,0)")).alias("y"))
    small = sizes.where(F.col("k") <= SMALL_BLOCK).groupBy("k", "x", "y").agg(F.min(F.struct(*BLOCK)).alias("b")).select("b.*")
    return stored(small.unionByName(sizes.where(F.col("k") > SMALL_BLOCK).select(*BLOCK)), "kept")


def links_of(rows: DataFrame, sigs: DataFrame, texts: DataFrame, sets: Sets = shingles) -> DataFrame:
    """rows: block, set_id, component. Links a, b found inside the blocks, stored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in blocks_in(batches, "text"):
            found = join_block([sets(r[3]) for r in held], [r[2] for r in held])
            if found:
                yield pd.DataFrame([(held[i][1], held[j][1]) for i, j in found], columns=["a", "b"])

    left = stored(promising(rows, sigs), "promising")
    kept = distinct_blocks(left)
    links = stored(by_block(left.join(kept, BLOCK).join(texts, "set_id"), "text").mapInPandas(run, "a long, b long"), "links")
    dropped(left, kept)
    return links


def chunks(n: str, words: str) -> F.Column:
    return F.greatest(F.ceil(F.col(n) / BLOCK_SETS), F.ceil(F.col(words) / BLOCK_SHINGLES)).cast("int")


def near_duplicates(docs: DataFrame, set_of: Sets = shingles, keys: int | None = KEYS) -> DataFrame:
    """doc_id, n_shingles, component_id, set_id, text_hash, group for each document. group names the component
    whatever its documents' ids are (null without shingles). set_of: the sets that are joined; keys: the most
    blocks that a set joins, None for as many as make sharing one certain."""
    steady(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sigs = stored(shingled(docs, set_of, keys), "shingled")
    sets = bucketed(
        sigs.where("set_id is not null").groupBy("set_id").agg(F.min(F.struct("doc_id", "text_hash")).alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("sig").alias("sig")), "sets", "set_id"
    )
    tokens = sets.select("set_id", "n", F.posexplode("keys").alias("r", "b0"))
    # aggregates that a join needs are stored first: its other side may then be split where a key is hot
    shared = stored(tokens.groupBy("b0").agg(F.count("*").alias("k")).where("k > 1").select("b0"), "shared")
    members = stored(tokens.join(shared, "b0"), "members")
    wanted = members.select("set_id").distinct().join(sets, "set_id").select("set_id", F.col("least.doc_id").alias("doc_id"), F.col("least.text_hash").alias("text_hash"))
    # of a repeated row one is taken; the join has brought them together
    texts = docs.withColumn("text_hash", F.xxhash64("text")).join(wanted, ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"]).select("set_id", "text")
    texts = bucketed(texts.repartition(partitions(docs.sparkSession), "set_id"), "texts", "set_id")

    sigs_of = sets.select("set_id", "n", "sig")
    zero = F.lit(0)
    no_comp = lambda df: df.withColumn("component", F.col("set_id"))
    # pass 1
    home = members.where(F.col("r") < HOME_KEYS)
    sizes = stored(home.groupBy("b0").agg(F.count("*").alias("k"), F.sum("n").alias("w")).where("k > 1"), "blocks")
    rows = no_comp(home.join(sizes, "b0")).select("b0", F.pmod(F.xxhash64("set_id"), chunks("k", "w")).cast("int").alias("b1"), zero.alias("b2"), "set_id", "component")
    first = links_of(rows, sigs_of, texts, set_of)
    dropped(shared, sizes)

    def with_components(comps: DataFrame) -> DataFrame:
        named = members.join(comps, members.set_id == comps.node, "left").select("b0", "set_id", "n", F.coalesce("component", "set_id").alias("component"))
        return stored(named, "members")

    # pass 2
    links = first
    comps = stored(connected_components(links), "components")
    now = with_components(comps)
    heads = now.groupBy("b0", "component").agg(F.min("set_id").alias("set_id"), F.max("n").alias("n"), F.count("*").alias("in_component"))
    sizes = heads.groupBy("b0").agg(F.count("*").alias("k"), F.sum("n").alias("w"), F.sum("in_component").alias("all_sets")).where("k > 1")
    sizes = stored(sizes, "blocks")
    rows = heads.join(sizes, "b0").select("b0", F.pmod(F.xxhash64("set_id"), chunks("k", "w")).cast("int").alias("b1"), zero.alias("b2"), "set_id", "component")
    second = links_of(rows, sigs_of, texts, set_of)
    seen = sizes.where((F.col("k") == F.col("all_sets")) & (chunks("k", "w") == 1)).select("b0")
    # pass 3
    if not second.isEmpty():
        dropped(comps, now)
        links = links.unionByName(second)
        comps = stored(connected_components(links), "components")
        now = with_components(comps)
    after, now = now, stored(now.join(seen, "b0", "left_anti"), "members")
    dropped(after, sizes)
    sizes = stored(now.groupBy("b0").agg(F.count("*").alias("k"), F.sum("n").alias("w"), F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1"), "blocks")
    cut = now.join(sizes, "b0").withColumn("chunks", chunks("k", "w")).withColumn("chunk", F.pmod(F.xxhash64("set_id"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("chunks") > 1, F.col("chunks") - 1).otherwise(0)))
    pairs = cut.withColumn("other", other).select("b0", F.least("chunk", "other").alias("b1"), F.greatest("chunk", "other").alias("b2"), "set_id", "component")
    third = links_of(pairs, sigs_of, texts, set_of)
    dropped(now, members, texts, sizes)
    if not third.isEmpty():
        dropped(comps)
        comps = stored(connected_components(links.unionByName(third)), "components")
    dropped(first, second, third)
    of_set = sets.select("set_id", F.col("least.doc_id").alias("doc_id")).join(comps, F.col("set_id") == F.col("node"))
    smallest = stored(of_set.groupBy("component").agg(F.min("doc_id").alias("smallest")), "smallest")
    of_set = of_set.join(smallest, "component").select("set_id", "smallest", "component")
    alone = sets.select("set_id", F.col("least.doc_id").alias("alone")).join(of_set, "set_id", "left").select("set_id", F.coalesce("smallest", "alone").alias("component_id"), F.coalesce("component", "set_id").alias("group"))
    result = sigs.join(alone, "set_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "set_id", "text_hash", "group")
    kind = dict(docs.dtypes)["doc_id"]
    unnamed = docs.where("doc_id is null")

    @F.pandas_udf("long")
    def count(text: pd.Series) -> pd.Series:
        return pd.Series([len(set_of(t)) for t in text], dtype="int64")

    none = F.lit(None).cast("long")
    return result.unionByName(
        unnamed.select("doc_id", count("text").alias("n_shingles"), F.lit(None).cast(kind).alias("component_id"), none.alias("set_id"), F.xxhash64("text").alias("text_hash"), none.alias("group"))
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group, that with the smallest id (of several texts under it, the smallest hash), with
    the columns it came with. A document is a doc_id with a text: another text under the id is judged by its own
    group. Rows without an id stay; of rows with the same id and text one stays. Only documents that may be
    dropped or repeated are shuffled: the rest are known by a bitmap and stay where they are."""
    name = ["doc_id", "text_hash"]
    found = stored(near_duplicates(docs).where("doc_id is not null").select(*name, "group"), "groups")
    first = stored(found.where("group is not null").groupBy("group").agg(F.min(F.struct(*name)).alias("first")), "firsts")
    in_groups = found.where("group is not null").join(first, "group").withColumn("stays", F.struct(*name).eqNullSafe(F.col("first")))
    judged = in_groups.select(*name, "stays").unionByName(found.where("group is null").select(*name, F.lit(True).alias("stays")))
    per = judged.groupBy(*name).agg(F.max("stays").alias("stays"), F.count("*").alias("rows"))
    doubtful = stored(per.where("not stays or rows > 1"), "doubtful")
    rows = docs.withColumn("__text_hash", F.xxhash64("text"))
    apart, unsure = split_by_bitmap(rows, doubtful, [F.col("doc_id"), F.col("__text_hash")], [F.col(c) for c in name])
    same = (F.col("d.doc_id") == F.col("k.doc_id")) & (F.col("d.__text_hash") == F.col("k.text_hash"))
    marked = unsure.alias("d").join(doubtful.alias("k"), same, "left").select("d.*", F.col("k.stays").alias("__stays"), F.coalesce("k.rows", F.lit(1)).alias("__rows"))
    marked = marked.where(F.coalesce("__stays", F.lit(True)))
    single = marked.where("__rows = 1 or doc_id is null").select(*apart.columns)
    several = marked.where("__rows > 1 and doc_id is not null").select(*apart.columns).dropDuplicates(["doc_id", "__text_hash"])
    return apart.unionByName(single).unionByName(several).drop("__text_hash")
