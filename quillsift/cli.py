"""A console for the search engine.

    python -m quillsift.cli --tagged FILE | --documents PARQUET | --index FOLDER
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import SparkSession

from quillsift.functions import weighting
from quillsift.operators import evaluation
from quillsift.plans.engine import SearchEngine
from quillsift.plans.storage import stored
from quillsift.sources import collections, sinks


HELP = """find WORDS             rank by every model
phrase WORDS           exact phrases
near A B [DISTANCE]    A before B, at most so many words apart (3)
judge WORDS            grade the pooled documents 0 to 3, compare the models by NDCG
scheme [DOCS QUERIES]  show or set the SMART pair of the custom model
quit"""


class Console:
    """Commands over an engine; read and write stand for input and print."""

    def __init__(self, engine: SearchEngine, read: Callable[[str], str] = input, write: Callable[[str], None] = print):
        self.engine, self.read, self.write = engine, read, write
        self.scheme = ("lnc", "ltc")
        self.commands = {"find": self.find, "phrase": self.phrase, "near": self.near, "judge": self.judge, "scheme": self.set_scheme}

    def block(self, title: str, lines: list[str]) -> None:
        self.write("\n".join([f"== {title}", *lines]))

    def find(self, words: str) -> None:
        """Rankings of every model; with unknown words also their corrections and a search for these."""
        e, q = self.engine, self.engine.queries(words)
        unknown = sorted(r.term for r in e.oov(q).collect())
        models = {
            "vector space": e.search_vsm(q),
            "bm25": e.search_bm25(q),
            "sequential dependence": e.search_sdm(q),
            "title boost": e.search_fielded(q),
            f"smart {'.'.join(self.scheme)}": e.search_custom(q, 10, *self.scheme),
        }
        for title, found in models.items():
            self.block(title, sinks.ranked_lines(found.collect(), unknown))
        if unknown:
            fixed = ", ".join(f"{r.term} -> {r.suggestion}" for r in e.corrections(q).orderBy("term").collect())
            self.block(f"corrected ({fixed or 'nothing near'})", sinks.ranked_lines(e.search_with_typo_tolerance(q).collect()))

    def phrase(self, words: str) -> None:
        self.block("phrase", sinks.positional_lines(self.engine.search_phrase(words).collect()))

    def near(self, words: str) -> None:
        a, b, *most = words.split()
        self.block("near", sinks.positional_lines(self.engine.search_proximity(a, b, int(most[0]) if most else 3).collect()))

    def judge(self, words: str) -> None:
        """Asks for a grade of each document that some model finds; what is no grade counts 0."""
        e = self.engine
        lists = stored(evaluation.rankings(e.index, e.queries(words), 10, self.scheme), "rankings")
        pooled = evaluation.pool(lists).join(e.index.docs, "docid").select("docid", "title").orderBy("docid").collect()
        if not pooled:
            self.write("no model finds a document")
            return
        rows = []
        for d in pooled:
            said = self.read(f"{d.docid} {d.title!r} grade> ").strip()
            rows.append((0, d.docid, int(said) if said in {"0", "1", "2", "3"} else 0))
        kind = dict(e.index.docs.dtypes)["docid"]
        judged = e.index.spark.createDataFrame(rows, f"qid int, docid {kind}, grade int")
        self.write(sinks.markdown(evaluation.ndcg(lists, judged).orderBy("ndcg_at_10", ascending=False)))

    def set_scheme(self, words: str) -> None:
        pair = tuple(words.split())
        if pair:
            if len(pair) != 2:
                raise ValueError("a pair of schemes is wanted")
            self.scheme = weighting.check_scheme(pair[0]), weighting.check_scheme(pair[1])
        self.write(f"scheme {'.'.join(self.scheme)} (tf {weighting.TF_CODES}, df {weighting.DF_CODES}, norm {weighting.NORM_CODES})")

    def run(self) -> None:
        self.write(HELP)
        while (line := self.read("quillsift> ").strip()) != "quit":
            name, _, words = line.partition(" ")
            if name not in self.commands or not words.strip() and name != "scheme":
                self.write(HELP)
                continue
            try:
                self.commands[name](words.strip())
            except ValueError as e:
                self.write(f"not done: {e}")


def main(words: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    source = args.add_mutually_exclusive_group(required=True)
    for name in ("tagged", "documents", "index"):
        source.add_argument(f"--{name}")
    args.add_argument("--dump", help="write both index dumps below this folder and end")
    a = args.parse_args(words)
    spark = SparkSession.builder.getOrCreate()
    if a.index:
        engine = SearchEngine.open(spark, a.index)
    else:
        engine = SearchEngine.from_documents(collections.tagged_documents(spark, a.tagged) if a.tagged else collections.from_documents(spark.read.parquet(a.documents)))
    if a.dump:
        for kind in ("inverted", "positional"):
            sinks.dump_index(engine.index, f"{a.dump}/{kind}_index", kind == "positional")
    else:
        Console(engine).run()


if __name__ == "__main__":
    main()
