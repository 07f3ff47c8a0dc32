"""Shared Spark plumbing: durable intermediate tables, table reading, connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillsift.plans.storage import dropped, removed, stored, table_path

__all__ = ["bucketed", "connected_components", "dropped", "id_text", "in_fold", "partitions", "read_table", "removed", "split_by_bitmap", "steady", "stored", "table_path"]


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """A stored table in as many buckets of a key as shuffles have partitions: joins on the key shuffle
    the other side alone. df should be dealt by the key already."""
    spark = df.sparkSession
    path = table_path(spark, name)
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").option("path", path).bucketBy(partitions(spark), key).saveAsTable(table)
    out = spark.table(table)
    out._stored_at, out._stored_as = path, table
    return out


#: Rows in a batch that goes to Python: a batch of whole texts stays small beside a worker's libraries.
BATCH_ROWS = 512


def steady(spark: SparkSession) -> None:
    """Bounds the memory of Python workers: batches of few rows, for texts may be long. The results of the
    operators are lazy and planned when they are read, so the session keeps the smaller batches."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def id_text(col: str = "doc_id") -> F.Column:
    """The text whose crc32 deals rows into folds; a null id counts as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def in_fold(modulus: int, remainder: int, col: str = "doc_id") -> F.Column:
    return F.crc32(id_text(col)) % modulus == remainder


#: Bitmaps are rows of so many bits; a set's is cut into MAPS of them, 1 MB in all, however large the set is.
MAP_BITS, MAPS = 32_768, 256


def split_by_bitmap(rows: DataFrame, among: DataFrame, key: list[F.Column], among_key: list[F.Column]) -> tuple[DataFrame, DataFrame]:
    """Rows whose key is certainly not among the others' keys, and those where it may be. A bitmap of hashes is
    broadcast, of at most MAPS rows: so of a large table joined with a smaller one only what may have a
    partner must be shuffled. Large sets fill the bitmap, and then all rows may have one."""
    bits = MAP_BITS * MAPS
    place = lambda k: F.pmod(F.xxhash64(*k), F.lit(bits)) + 1  # noqa: E731  the functions number buckets and bits from position 1
    hashed = among.select(place(among_key).alias("p"))
    maps = hashed.groupBy(F.bitmap_bucket_number("p").alias("__map")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits"))
    at = place(key)
    marked = rows.withColumn("__map", F.bitmap_bucket_number(at)).withColumn("__at", F.bitmap_bit_position(at).cast("int")).join(F.broadcast(stored(maps, "bitmap")), "__map", "left")
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    held = F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col("__at") % 8)) != 0, F.lit(False))
    marked = marked.withColumn("__held", held).drop("__map", "__at", "__bits")
    return marked.where("not __held").drop("__held"), marked.where("__held").drop("__held")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node of an undirected graph.

    edges: columns a, b (long). Returns node, component for each node that has an edge to another
    one. Alternates large-star and small-star steps (each a partial aggregate and an equi-join, so a
    node with very many links is pre-aggregated and its join side may be split), each round stored in
    the shared folder. Ends when a round leaves the set of edges as it was.
    """
    cur = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(),
        "edges",
    )
    size = lambda t: t.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    before = size(cur)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = cur.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            cur.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        # stored, so that the rows of a node with very many links are an exchange of their own that may be split
        least = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(down, "hi")
            .select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo")
            .where("hi <> lo")
            .distinct()
        )
        new = stored(small, "edges")
        after = size(new)
        dropped(cur, least)
        cur = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    out = cur.groupBy("hi").agg(F.min("lo").alias("lo"))
    return out.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        out.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
