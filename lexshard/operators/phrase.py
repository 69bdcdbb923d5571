"""Exact phrases over positional postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexshard.operators.index import Index


def _moved(positions: Column, offset: int) -> Column:
    return F.transform(positions, lambda p: p - offset)


def _offsets(index: Index, phrase: str, strict_gaps: bool = False) -> dict[str, list[int]]:
    """How far after the first term each term of a phrase must stand."""
    found = index.analyzer.analyze(phrase)
    offsets: dict[str, list[int]] = {}
    for i, (term, pos) in enumerate(found):
        offsets.setdefault(term, []).append(pos - found[0][1] if strict_gaps else i)
    return offsets


def phrase_search(index: Index, phrase: str, strict_gaps: bool = False) -> DataFrame:
    """(doc_id) of the documents that hold the terms of the phrase at successive positions, in order of doc_id.

    The i-th term that is left of the phrase must stand i places after the first: stop words dropped from the phrase
    close their gap there, while documents keep theirs. strict_gaps keeps the gaps of the phrase too. A phrase of no
    terms finds nothing, one of one term all its documents. Repeated terms are allowed. The documents that hold all
    terms are found first, by their ids alone; positions are read for those only.
    """
    offsets = _offsets(index, phrase, strict_gaps)
    if not offsets:
        return index.postings.where(F.lit(False)).select("doc_id")
    rows = index.postings.where(F.col("term").isin(list(offsets)))
    if list(map(len, offsets.values())) == [1]:
        return rows.select("doc_id").distinct().orderBy("doc_id")
    if len(offsets) > 1:
        complete = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(offsets)).select("doc_id")
        rows = rows.join(complete, "doc_id", "left_semi")
    lists = F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("lists")
    starts = [_moved(F.col("lists")[term], o) for term, os in offsets.items() for o in os]
    common = starts[0]
    for s in starts[1:]:
        common = F.array_intersect(common, s)
    return rows.groupBy("doc_id").agg(lists).where(F.size(common) > 0).select("doc_id").orderBy("doc_id")


def phrase_batch(index: Index, phrases: Sequence[tuple[int, str]]) -> DataFrame:
    """(query_id, doc_id) of many phrases in one job, as phrase_search finds them.

    The documents that hold all terms of a phrase are found first, by their ids. Of those every occurrence of a term
    names the place where the phrase would begin; a place named by all terms is a match.
    """
    spark = index.postings.sparkSession
    wanted = [(q, t, os, len(offsets), sum(map(len, offsets.values()))) for q, text in phrases for offsets in [_offsets(index, text)] for t, os in offsets.items()]
    asked = F.broadcast(spark.createDataFrame(wanted, "query_id long, term string, offsets array<int>, terms int, places int"))
    rows = index.postings.where(F.col("term").isin(sorted({t for _, t, *_ in wanted}))).join(asked, "term")
    complete = rows.groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("terms").alias("terms")).where(F.col("n") == F.col("terms"))
    held = rows.join(complete.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    at = held.select("query_id", "doc_id", "places", "offsets", F.explode("positions").alias("pos")).select("query_id", "doc_id", "places", "pos", F.explode("offsets").alias("o"))
    named = at.groupBy("query_id", "doc_id", (F.col("pos") - F.col("o")).alias("begin")).agg(F.count(F.lit(1)).alias("n"), F.first("places").alias("places"))
    return named.where(F.col("n") == F.col("places")).select("query_id", "doc_id").distinct()


def phrase_by_anchors(index: Index, phrase: str) -> DataFrame:
    """The same relationally: every occurrence names the place where the phrase would begin; places named by all terms match."""
    terms = index.analyzer.terms(phrase)
    ordinals = F.create_map(*(x for t in dict.fromkeys(terms) for x in (F.lit(t), F.array(*(F.lit(i) for i, u in enumerate(terms) if u == t))))) if terms else None
    rows = index.postings.where(F.col("term").isin(list(dict.fromkeys(terms))))
    if not terms:
        return rows.select("doc_id")
    places = rows.select("doc_id", F.explode("positions").alias("pos"), ordinals[F.col("term")].alias("os")).select("doc_id", "pos", F.explode("os").alias("o"))
    if len(terms) == 1:
        return rows.select("doc_id").distinct().orderBy("doc_id")
    named = places.groupBy("doc_id", (F.col("pos") - F.col("o")).alias("anchor")).agg(F.count(F.lit(1)).alias("n"))
    return named.where(F.col("n") == len(terms)).select("doc_id").distinct().orderBy("doc_id")
