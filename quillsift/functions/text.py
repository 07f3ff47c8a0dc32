"""Text analysis as column functions: tokens, stop words, spans, full texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.functions.stemming import stems_of

# The stop words (tested on lower-cased words before stemming) and the token pattern.
STOPWORDS = (
    "a an and are as at available be by can common depending designed features for from has have in into is it its made of on or other "
    "paired such suitable than that the this to well with works"
).split()
TOKEN = "[a-zA-Z0-9]+"
SEGMENT = "[a-zA-Z0-9]+|[^a-zA-Z0-9]+"
#: Texts of more characters are cut into slices of so many before they become words.
SLICE = 1 << 20


def tokenize(text: Column) -> Column:
    """All tokens of a text, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.lower)


def without_stopwords(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*STOPWORDS))


def words(text: Column) -> Column:
    """The words whose stems are the terms of a text, in order; positions count these alone."""
    return without_stopwords(tokenize(text))


def slices(text: Column, size: int | None = None) -> Column:
    """A text in pieces of about so many characters that end with a token or outside one: the words of the pieces
    are the words of the text, and no row holds more of them than a piece has."""
    n = size or SLICE
    return F.when(F.length(text) <= n, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{{n}}}[a-zA-Z0-9]*|.+"), F.lit(0)))


def is_long(text: Column) -> Column:
    """Whether a text is cut into slices."""
    return F.length(text) > SLICE


def full_text(title: str = "title", text: str = "text") -> Column:
    return F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(". "), F.coalesce(F.col(text), F.lit("")))


def title_text(title: str = "title", category: str = "category") -> Column:
    return F.concat_ws(" ", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(category), F.lit("")))


def analyze(rows: DataFrame, text: Column, *keys: str, position: str = "pos") -> DataFrame:
    """keys, position, term for each word of each row. Each distinct word is stemmed
    once."""
    exploded = rows.select(*keys, F.posexplode(words(text)).alias(position, "raw"))
    return exploded.join(stems_of(exploded), "raw").select(*keys, position, "term")


def word_spans(rows: DataFrame, text: Column, *keys: str) -> DataFrame:
    """keys, i, raw, start, end for each word, stop words aside; offsets count code points, end is
    exclusive, and i equals the word's position in the index."""
    segments = F.regexp_extract_all("piece", F.lit(SEGMENT), F.lit(0))
    by = Window.partitionBy(*keys).orderBy("slice", "seg")
    cut = rows.select(*keys, F.posexplode(slices(text)).alias("slice", "piece")).select(*keys, "slice", F.posexplode(segments).alias("seg", "raw"))
    cut = cut.withColumn("end", F.sum(F.length("raw")).over(by).cast("int")).withColumn("start", F.col("end") - F.length("raw"))
    kept = cut.where(F.col("raw").rlike("^[a-zA-Z0-9]") & ~F.lower("raw").isin(*STOPWORDS))
    return kept.select(*keys, (F.row_number().over(by) - 1).alias("i"), "raw", "start", "end")


def spans(rows: DataFrame, text: Column, *keys: str) -> DataFrame:
    """keys, i, raw, start, end, term for each word."""
    kept = word_spans(rows, text, *keys).withColumn("low", F.lower("raw"))
    stems = stems_of(kept.select("low"), "low").withColumnRenamed("raw", "low")
    return kept.join(stems, "low").select(*keys, "i", "raw", "start", "end", "term")
