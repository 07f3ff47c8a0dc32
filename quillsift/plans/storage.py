"""Where a session keeps the tables it writes."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of up to so many rows go to all executors in joins, whatever the session's limit in bytes.
MOST_BROADCAST = 1_000_000
#: Of larger tables of words or terms, about so many of the most frequent go to them.
FREQUENT = 200_000
#: Compression of the tables that stay, and the setting that drops a write's shuffle files when it is done.
CODEC, CLEANUP = "zstd", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Batches of rows that go to Python: so many rows and bytes at most.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 512, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir). Where that is unset, a temporary one of this
    machine that goes with the process, which only a local master can share."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="quillsift-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: lineage is cut, and a lost
    executor costs only the rereading of a file."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def gathered(df: DataFrame, most: int) -> tuple[DataFrame, list | None]:
    """A result that is read more than once: up to so many rows come to the driver and back as a local table,
    with the rows; more are stored."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        return stored(df, "gathered"), None
    return df.sparkSession.createDataFrame(rows, df.schema), rows


@contextmanager
def setting(spark: SparkSession, values: dict[str, str | int]) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Writes in here leave no shuffle files behind: else these stay until the driver's memory is collected."""
    return setting(spark, {CLEANUP: "true"})


def broadcast(df: DataFrame) -> tuple[DataFrame, bool]:
    """A stored table that joins send to all executors as long as it has few enough rows, and whether it has."""
    few = df.count() <= MOST_BROADCAST
    return F.broadcast(df) if few else df, few


def most_frequent(df: DataFrame, count: str) -> tuple[DataFrame, DataFrame | None]:
    """A stored table's rows of the greatest counts, which joins send to all executors, and the others, if there are any."""
    n, most = df.count(), min(FREQUENT, MOST_BROADCAST)
    if n <= most:
        return F.broadcast(df), None
    least = df.agg(F.percentile_approx(count, F.lit(1 - most / n), F.lit(10_000))).first()[0]
    return F.broadcast(df.where(F.col(count) > least)), df.where(F.col(count) <= least)


def write_table(parts: DataFrame | Iterable[DataFrame], path: str) -> None:
    """Writes a table, or its parts one after the other: each part's shuffles are gone before the next."""
    for i, df in enumerate([parts] if isinstance(parts, DataFrame) else parts):
        with shuffles_dropped(df.sparkSession):
            df.write.mode("append" if i else "errorifexists").option("compression", CODEC).parquet(path)


def write_bucketed(parts: DataFrame | Iterable[DataFrame], path: str, key: str, buckets: int, *order: str) -> None:
    """Writes a table dealt into buckets of a key, a file for each bucket, its rows in order. Of a table that comes in
    parts, each bucket has a file for each part, and only one part's rows are shuffled at a time."""
    table = f"written_{uuid.uuid4().hex}"
    for i, df in enumerate([parts] if isinstance(parts, DataFrame) else parts):
        spark = df.sparkSession
        with shuffles_dropped(spark):
            writer = df.repartition(buckets, key).write.format("parquet").option("path", path).option("compression", CODEC)
            writer.mode("append" if i else "errorifexists").bucketBy(buckets, key).sortBy(*order).saveAsTable(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay: a table with a path of its own owns none


def read_bucketed(spark: SparkSession, path: str, key: str, buckets: int, *order: str) -> DataFrame:
    """Reads such files as a table of the session: joins and aggregates on the key don't shuffle it, and a
    condition on the key opens the files of its buckets alone."""
    table, columns = f"read_{uuid.uuid4().hex}", spark.read.parquet(path).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.fields)
    where = path.replace("'", "\\'")
    spark.sql(f"CREATE TABLE {table} ({fields}) USING parquet CLUSTERED BY ({key}) SORTED BY ({', '.join(order)}) INTO {buckets} BUCKETS LOCATION '{where}'")
    return spark.table(table)


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its file system and folder named: tables of a session would look for others in the warehouse."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        if name := getattr(t, "_stored_as", None):
            t.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        if path := getattr(t, "_stored_at", None):
            removed(t.sparkSession, path)
