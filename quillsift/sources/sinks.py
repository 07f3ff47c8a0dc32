"""Index dumps, Markdown tables, console output."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillsift.operators.index import Index


# The head and the columns of the dumps.
RULE = "=" * 70
HEAD = "{kind} INDEX  (N={n} documents, {terms} unique terms)"
FORMAT = "Format: term  df  -> [{form}, ...]"


def head(index: Index, kind: str, form: str) -> DataFrame:
    """The lines above a dump, with keys that sort before any term."""
    n, terms = index.size[0], index.terms.count()
    lines = [HEAD.format(kind=kind, n=n, terms=terms), FORMAT.format(form=form), RULE]
    return index.spark.createDataFrame([("", i, x) for i, x in enumerate(lines)], "term string, line int, value string")


#: Postings that one line of a dump holds, about, without and with positions; most pieces in which long terms are sorted.
LINE_POSTINGS, LINE_POSITIONAL, MOST_PIECES = 1_000_000, 20_000, 2000


def pieces(index: Index, positional: bool) -> tuple[DataFrame, DataFrame | None]:
    """term, df, piece, said: the text of a term's postings, for terms that go into one line, and for the others, if
    there are any. The latter's postings are dealt by ranges of term and document, so a term's pieces follow each
    other and none holds more than a range does."""
    posting = F.concat(F.lit("("), F.col("docid").cast("string"), F.lit(","), F.col("tf").cast("string"), *([F.lit(",["), F.array_join(F.col("positions").cast("array<string>"), ", "), F.lit("])")] if positional else [F.lit(")")]))
    lines = F.ceil(F.col("df") / (LINE_POSITIONAL if positional else LINE_POSTINGS)).cast("int")
    terms = index.terms.withColumn("lines", lines)

    def said(rows: DataFrame) -> DataFrame:
        per = rows.groupBy("term", "df", "piece").agg(F.sort_array(F.collect_list(F.struct("docid", posting.alias("said")))).alias("all"))
        return per.select("term", "df", "piece", F.array_join("all.said", between(positional)).alias("said"))

    short = said(index.entries.join(terms.where("lines = 1"), "term").withColumn("piece", F.lit(0)))
    n = terms.where("lines > 1").agg(F.sum("lines")).first()[0]
    if not n:
        return short, None
    ranges = index.entries.join(terms.where("lines > 1"), "term").repartitionByRange(min(n, MOST_PIECES), "term", "docid")
    return short, said(ranges.withColumn("piece", F.spark_partition_id()))


def between(positional: bool) -> str:
    return ",\n     " if positional else ", "


def opening(positional: bool) -> Column:
    start = F.concat(F.expr("rpad(term, greatest(15, length(term)), ' ')"), F.lit(" df="), F.expr("rpad(cast(df AS string), greatest(4, length(cast(df AS string))), ' ')"))
    return F.concat(start, F.lit(" ->\n    [" if positional else " -> ["))


def closing(positional: bool) -> Column:
    return F.lit("]\n" if positional else "]")


def dump_values(index: Index, positional: bool = False) -> DataFrame:
    """term, value: the text of a dump but for its head, one value for each term however many documents it has."""
    short, long_ = pieces(index, positional)
    if long_ is not None:
        whole = long_.groupBy("term", "df").agg(F.sort_array(F.collect_list(F.struct("piece", "said"))).alias("all"))
        short = short.select("term", "df", "said").unionByName(whole.select("term", "df", F.array_join("all.said", between(positional)).alias("said")))
    return short.select("term", F.concat(opening(positional), F.col("said"), closing(positional)).alias("value"))


def dump_lines(index: Index, positional: bool = False) -> DataFrame:
    """term, line, value: the same as lines of a file. A term of more documents than a line may hold goes on in
    further lines, in order of the documents over all of them."""
    short, long_ = pieces(index, positional)
    out = short.select("term", F.lit(0).alias("line"), F.concat(opening(positional), F.col("said"), closing(positional)).alias("value"))
    if long_ is None:
        return out
    order = Window.partitionBy("term").orderBy("piece")
    numbered = long_.withColumn("line", F.row_number().over(order) - 1).withColumn("last", F.lead("piece").over(order).isNull())
    opened = F.when(F.col("line") == 0, opening(positional)).otherwise(F.lit("     "))
    closed = F.when(F.col("last"), closing(positional)).otherwise(F.lit(","))
    return out.unionByName(numbered.select("term", "line", F.concat(opened, F.col("said"), closed).alias("value")))


def dump_index(index: Index, path: str, positional: bool = False) -> None:
    """Writes a dump as text, terms ascending over the part files."""
    kind, form = ("POSITIONAL", "(docID, tf, [positions])") if positional else ("INVERTED", "(docID, tf)")
    head(index, kind, form).unionByName(dump_lines(index, positional)).sort("term", "line").select("value").write.mode("overwrite").text(path)


def markdown_table(rows: Iterable[Sequence[object]], headers: Sequence[str]) -> str:
    line = lambda cells: "| " + " | ".join(map(str, cells)) + " |"
    return "\n".join([line(headers), "|" + "---|" * len(headers), *map(line, rows)])


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report table of a small result. Where there are more rows, the last line says so."""
    rows = df.limit(most + 1).collect()
    return markdown_table(rows[:most], df.columns) + (f"\n\nThe first {most} rows; there are more." if len(rows) > most else "")


def ranked_lines(results: Iterable, oov: Sequence[str] = ()) -> list[str]:
    """What the console shows of a ranking."""
    out = [f"  (not in the collection: {', '.join(oov)})"] if oov else []
    rows = list(results)
    if not rows:
        return [*out, "  Nothing found."]
    for r in rows:
        out.append(f"{r['rank']:>4}. {r['docid']}  {r['score']:.4f}  {r['title']} [{r['category']}]")
        out += [f"      {r['snippet']}"] if r["snippet"] else []
    return out


def positional_lines(results: Iterable) -> list[str]:
    out = []
    for r in results:
        places = ", ".join(str(tuple(p) if isinstance(p, tuple) else p) for p in r["match_positions"])
        out.append(f"{r['rank']:>4}. {r['docid']}  {r['title']} [{r['category']}], {r['rank_shift']} against VSM, at {places}")
        out += [f"      {r['snippet']}"] if r["snippet"] else []
    return out or ["  Nothing found."]
