"""Command line: build an index from JSON lines or a synthetic corpus, and search it."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from lexshard.operators.boolean import boolean_search
from lexshard.operators.index import Index, build_saved, open_index
from lexshard.operators.phrase import phrase_search
from lexshard.operators.rank import BM25, TfIdf, ranked_search
from lexshard.sources.corpus import load_jsonl, synthetic_corpus

DEFAULT_SYNTHETIC = 20000


def _session() -> SparkSession:
    return SparkSession.builder.appName("lexshard").getOrCreate()


def build(args: argparse.Namespace) -> list[str]:
    """--wiki wins over --synthetic; --mem-cap and --progress are accepted and have no effect: Spark spills by itself."""
    spark = _session()
    if args.wiki:
        docs = load_jsonl(spark, args.wiki, args.limit)
    else:
        docs = synthetic_corpus(spark, args.synthetic or DEFAULT_SYNTHETIC).drop("topic")
    meta = build_saved(docs, args.out).meta
    # The lines of the report.
    return ["Done. Index meta:", *(f"  {k}: {v}" for k, v in sorted(meta.items()))]


def _listed(index: Index, ids: DataFrame, k: int) -> list[str]:
    """The first k by doc_id, with title and address."""
    # The format of the lines, here and in search.
    rows = ids.orderBy("doc_id").limit(k).join(index.docstats, "doc_id").orderBy("doc_id").collect()
    return [f"{i:2d}. {r.title}  ({r.url})" for i, r in enumerate(rows, 1)] or ["(no matches)"]


def search(args: argparse.Namespace) -> list[str]:
    """--bool wins over --phrase; --k1 and --b matter for BM25 only. Nothing is said where a ranked query finds nothing."""
    index = open_index(_session(), args.index)
    if args.bool:
        return _listed(index, boolean_search(index, args.query), args.k)
    if args.phrase:
        return _listed(index, phrase_search(index, args.query), args.k)
    ranker = TfIdf() if args.tfidf else BM25(args.k1, args.b)
    return [f"{r['rank']:2d}. [{r.score:7.4f}] {r.title}  ({r.url})" for r in ranked_search(index, args.query, ranker, args.k).collect()]


def parser() -> argparse.ArgumentParser:
    # The names and defaults of the options.
    top = argparse.ArgumentParser(prog="lexshard")
    commands = top.add_subparsers(dest="command", required=True)
    b = commands.add_parser("build", help="build an index")
    b.add_argument("--out", required=True)
    b.add_argument("--wiki", help="JSON lines with title, url and text")
    b.add_argument("--synthetic", type=int, help=f"so many synthetic documents (default {DEFAULT_SYNTHETIC})")
    b.add_argument("--limit", type=int, help="at most so many documents of --wiki")
    b.add_argument("--mem-cap", type=int, default=1_000_000)
    b.add_argument("--progress", type=int, default=0)
    b.set_defaults(run=build)
    s = commands.add_parser("search", help="search an index")
    s.add_argument("query")
    s.add_argument("--index", required=True)
    s.add_argument("--k", type=int, default=10)
    s.add_argument("--bool", action="store_true")
    s.add_argument("--phrase", action="store_true")
    s.add_argument("--tfidf", action="store_true")
    s.add_argument("--k1", type=float, default=1.5)
    s.add_argument("--b", type=float, default=0.75)
    s.set_defaults(run=search)
    return top


def main(argv: Sequence[str] | None = None) -> None:
    args = parser().parse_args(argv)
    for line in args.run(args):
        print(line)


if __name__ == "__main__":
    main()
