"""Collections of documents: docid, category, title, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tags of a record, in their fixed order.
FIELDS = {"docid": "DOCID", "category": "CATEGORY", "title": "TITLE", "text": "TEXT"}


def tagged_documents(spark: SparkSession, path: str) -> DataFrame:
    """Reads ``<DOC><DOCID>..</DOCID><CATEGORY>..</CATEGORY><TITLE>..</TITLE><TEXT>..</TEXT></DOC>``
    records, split at the end tag so that a large file is read in parallel. Records without the four
    tags in order are left out; fields lose white space at both ends."""
    records = spark.read.option("lineSep", "</DOC>").text(path).where(F.col("value").contains("<DOC>"))
    body = r"(?s)<DOC>\s*" + r"\s*".join(f"<{t}>(.*?)</{t}>" for t in FIELDS.values())
    strip = lambda c: F.regexp_replace(c, r"^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    fields = [strip(F.regexp_extract("value", body, i + 1)).alias(name) for i, name in enumerate(FIELDS)]
    return records.where(F.col("value").rlike(body)).select(*fields)


#: The words of a first line that go into so many characters are a title; a longer first word makes none.
TITLE = r"^([^\n]{0,79}[^ \n])( |\n|\z)"


def from_documents(documents: DataFrame) -> DataFrame:
    """The documents table: the first line's words, up to 80 characters, are the title, the source the category."""
    text = F.coalesce("text", F.lit(""))
    return documents.select(F.col("doc_id").alias("docid"), F.coalesce("source", F.lit("")).alias("category"), F.regexp_extract(text, TITLE, 1).alias("title"), text.alias("text"))


def from_parts(part: DataFrame) -> DataFrame:
    """The part table as very short documents."""
    return part.select(F.col("p_partkey").alias("docid"), F.col("p_type").alias("category"), F.col("p_name").alias("title"), F.col("p_brand").alias("text"))


def checked(docs: DataFrame) -> DataFrame:
    """Document ids must be unique."""
    twice = docs.groupBy("docid").count().where("count > 1").take(1)
    if twice:
        raise ValueError(f"document id {twice[0][0]!r} occurs more than once")
    return docs
