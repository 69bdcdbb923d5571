"""Ranked retrieval: BM25 and TF-IDF as Columns, one query or many at a time, with exact top-k.

Many queries are one job: their terms select the postings, which carry their document's length, the states of a document
and query come together in one shuffle, scores are summed in the order of the query's terms (so equal documents get equal
scores, bit for bit), and the best k of each query are kept per task before they meet. Queries may be a list in the
driver's hands or a table of any size.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lexshard.operators.index import Index, analyzed

#: Different query terms of a list of queries: they and their document frequencies are held by the driver and broadcast.
TERM_LIMIT = 100_000
#: Up to so many rows a group Spark itself cuts within each task before a window's shuffle.
PUSHED = 1000
#: Rows that a task gathers beyond those it keeps, before it cuts again.
GATHERED = 100_000
#: Result rows that are broadcast to fetch titles.
FEW = 100_000
#: Results of one query that the driver puts in order.
MANY = 10_000


class Ranker(Protocol):
    """Anything that scores a term in a document, as Columns: tf, df, length of the document, their number and average length."""

    def idf(self, df: Column, n_docs: Column) -> Column: ...
    def term_score(self, tf: Column, idf: Column, length: Column, avgdl: Column) -> Column: ...
    def max_score(self, idf: Column) -> Column: ...


@dataclass(frozen=True)
class BM25:
    k1: float | Column = 1.5
    b: float | Column = 0.75

    def idf(self, df: Column, n_docs: Column) -> Column:
        return F.log((n_docs - df + 0.5) / (df + 0.5) + 1.0)

    def term_score(self, tf: Column, idf: Column, length: Column, avgdl: Column) -> Column:
        k1, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (self.k1, self.b))
        mean = F.when(avgdl == 0, 1.0).otherwise(avgdl)
        return idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * length / mean))

    def max_score(self, idf: Column) -> Column:
        k1 = self.k1 if isinstance(self.k1, Column) else F.lit(float(self.k1))
        return idf * (k1 + 1)


@dataclass(frozen=True)
class TfIdf:
    """(1 + ln tf) ln(N / df) / sqrt(length): documents that match with score 0 are results as well."""

    def idf(self, df: Column, n_docs: Column) -> Column:
        return F.log(n_docs / F.greatest(df, F.lit(1)))

    def term_score(self, tf: Column, idf: Column, length: Column, avgdl: Column) -> Column:
        weight = F.when(tf > 0, 1.0 + F.log(tf)).otherwise(0.0)
        return weight * idf / F.sqrt(F.when(length == 0, 1).otherwise(length).cast("double"))

    def max_score(self, idf: Column) -> Column:
        return idf * 10.0


def term_weights(index: Index, ranker: Ranker) -> DataFrame:
    """dictionary with idf and max_score, an upper bound of what the term can add to a score."""
    idf = ranker.idf(F.col("df"), F.lit(index.n_docs))
    return index.dictionary.withColumn("idf", idf).withColumn("max_score", ranker.max_score(idf))


def query_terms(index: Index, queries: Sequence[tuple[int, str]]) -> list[tuple[int, int, str]]:
    """(query_id, ordinal, term): the distinct terms of each query in order."""
    return [(q, i, t) for q, text in queries for i, t in enumerate(dict.fromkeys(index.analyzer.terms(text)))]


def _wanted(index: Index, queries: Sequence[tuple[int, str]]) -> list[tuple[int, int, str, int]]:
    """(query_id, ordinal, term, df) of the known terms. The queries are in the driver's hands, and so is a df for each of their terms."""
    wanted = query_terms(index, queries)
    terms = sorted({t for _, _, t in wanted})
    if len(terms) > TERM_LIMIT:
        raise ValueError(f"{len(terms)} different terms; at most {TERM_LIMIT} are searched in one job")
    dfs = index.dfs(terms)
    return [(q, i, t, dfs[t]) for q, i, t in wanted if dfs.get(t)]


def scores(index: Index, queries: Sequence[tuple[int, str]], ranker: Ranker | None = None, variants: Sequence[tuple[float, float]] = ()) -> DataFrame:
    """(query_id, doc_id, score) of every document that holds a term of the query; variants adds k1, b and BM25 for each.

    Unknown terms add nothing. Documents that match with score 0 stay. The frequencies of a query's terms in a document
    become one row of as many numbers as the longest query has terms, so they combine before they are shuffled.
    """
    wanted = _wanted(index, queries)
    width = max((i for _, i, _, _ in wanted), default=0) + 1
    n_docs, avgdl = F.lit(index.n_docs), F.lit(float(index.avgdl))
    hits = index.postings.where(F.col("term").isin(sorted({t for _, _, t, _ in wanted}))).select("term", "doc_id", "tf", "length")
    length = F.max("length").alias("length")
    if len(queries) == 1:  # the query is in the plan
        terms = {i: (t, df) for _, i, t, df in wanted}
        of = {i: F.col("term") == terms[i][0] if i in terms else F.lit(False) for i in range(width)}
        dfs = F.array(*(F.lit(terms[i][1] if i in terms else None).cast("long") for i in range(width)))
        docs = hits.groupBy("doc_id").agg(length, *(F.max(F.when(of[i], F.col("tf"))).alias(f"tf{i}") for i in range(width)))
        docs = docs.withColumns({"query_id": F.lit(queries[0][0]).cast("long"), "dfs": dfs})
    else:
        spark = index.postings.sparkSession
        by_query: dict[int, list[int | None]] = {}
        for q, i, _, df in wanted:
            by_query.setdefault(q, [None] * width)[i] = df
        rows = spark.createDataFrame([(q, i, t) for q, i, t, _ in wanted], "query_id long, ordinal int, term string")
        docs = hits.join(F.broadcast(rows), "term").groupBy("query_id", "doc_id").agg(length, *(F.max(F.when(F.col("ordinal") == i, F.col("tf"))).alias(f"tf{i}") for i in range(width)))
        docs = docs.join(F.broadcast(spark.createDataFrame(list(by_query.items()), "query_id long, dfs array<long>")), "query_id")
    keys = ["query_id"]
    if variants:
        docs = docs.withColumn("v", F.explode(F.array(*(F.struct(F.lit(float(k)).alias("k1"), F.lit(float(b)).alias("b")) for k, b in variants)))).select("*", "v.k1", "v.b")
        keys, ranker = ["query_id", "k1", "b"], BM25(F.col("k1"), F.col("b"))
    ranker = ranker or BM25()
    score = F.lit(0.0)
    for i in range(width):  # in the order of the query's terms, so that equal documents get the same sum
        score = score + F.coalesce(ranker.term_score(F.col(f"tf{i}"), ranker.idf(F.col("dfs")[i], n_docs), F.col("length"), avgdl), F.lit(0.0))
    return docs.select(*keys, "doc_id", score.alias("score"))


def query_table(index: Index, queries: DataFrame) -> DataFrame:
    """(query_id, ordinal, term): the distinct terms of each row of (query_id, text), in order of their first occurrence."""
    docs = analyzed(queries.select(F.col("query_id").alias("doc_id"), F.lit("").alias("title"), F.lit("").alias("url"), F.col("text").alias("body")), index.analyzer)
    terms = docs.select(F.col("doc_id").alias("query_id"), F.explode("postings").alias("p"))
    return terms.select("query_id", F.element_at("p.positions", 1).alias("ordinal"), "p.term")


def table_scores(index: Index, queries: DataFrame, ranker: Ranker | None = None) -> DataFrame:
    """(query_id, doc_id, score) as scores, for a table (query_id, text) of any size; no query's terms come to the driver.

    Ids of queries are distinct; null ids and texts are no queries.
    """
    ranker, n_docs, avgdl = ranker or BM25(), F.lit(index.n_docs), F.lit(float(index.avgdl))
    wanted = query_table(index, queries.where(F.col("query_id").isNotNull())).join(index.dictionary.select("term", "df"), "term")
    hits = wanted.join(index.postings.select("term", "doc_id", "tf", "length"), "term")
    part = ranker.term_score(F.col("tf"), ranker.idf(F.col("df"), n_docs), F.col("length"), avgdl)
    parts = hits.groupBy("query_id", "doc_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", part.alias("s")))).alias("parts"))
    return parts.select("query_id", "doc_id", F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p.s).alias("score"))


def _cut(rows: DataFrame, by: Sequence[str], keep: int) -> DataFrame:
    """Of each group the first rows by falling score and rising doc_id, as many as keep, within each task: before a shuffle."""

    def best(t: pa.Table) -> pa.Table:
        t = t.sort_by([*((c, "ascending") for c in by), ("score", "descending"), ("doc_id", "ascending")]).combine_chunks()
        new = np.zeros(len(t), bool)
        new[:1] = True
        for c in by:
            codes = t.column(c).combine_chunks().dictionary_encode()
            codes = (codes.chunk(0) if isinstance(codes, pa.ChunkedArray) else codes).indices.fill_null(-1).to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(new)
        return t.filter(pa.array(np.arange(len(t)) - np.repeat(starts, np.diff(np.append(starts, len(t)))) < keep))

    def run(batches):
        held, kept = [], 0
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) > kept + max(kept, GATHERED):
                held = best(pa.Table.from_batches(held)).to_batches()
                kept = sum(b.num_rows for b in held)
        if held:
            yield from best(pa.Table.from_batches(held, schema)).cast(schema).to_batches(max_chunksize=10_000)

    schema = to_arrow_schema(rows.schema)
    return rows.mapInArrow(run, rows.schema)


def top_k(scored: DataFrame, k: int, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """The k best of each group with their rank, ties at the boundary as a heap leaves them that sees documents by id.

    Such a heap takes a later document only if it beats the least one kept, and then gives up the smallest (score,
    id). So with t the k-th best score: all above t stay; of those at t that are among the first k documents, by id,
    with a score of t or more, the largest ids fill the rest. They are among the k smallest ids at t, so the first 2k
    of each group by score and id hold all that can be chosen: each task passes on no more than that, whatever k, and what
    follows sees 2k rows a group and task. Documents whose score is null or NaN are not expected. k must be positive.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if 2 * k > PUSHED:
        scored = _cut(scored, by, 2 * k)
    group = Window.partitionBy(*by)
    rows = scored.withColumn("r", F.row_number().over(group.orderBy(F.desc("score"), "doc_id"))).where(F.col("r") <= 2 * k)
    rows = rows.withColumn("t", F.min(F.when(F.col("r") <= k, F.col("score"))).over(group)).where(F.col("score") >= F.col("t"))
    rows = rows.withColumn("at", F.row_number().over(group.orderBy("doc_id"))).where((F.col("score") > F.col("t")) | (F.col("at") <= k))
    rows = rows.withColumn("r", F.row_number().over(group.orderBy(F.desc("score"), F.desc("doc_id")))).where(F.col("r") <= k)
    return rows.withColumn("rank", F.row_number().over(group.orderBy(F.desc("score"), "doc_id"))).drop("r", "t", "at")


def with_titles(index: Index, best: DataFrame, rows: int) -> DataFrame:
    """best with title and url; rows bounds its size: few are broadcast, so docstats isn't shuffled."""
    return (F.broadcast(best) if rows <= FEW else best).join(index.docstats.select("doc_id", "title", "url"), "doc_id")


def batch_search(index: Index, queries: Sequence[tuple[int, str]], ranker: Ranker | None = None, k: int = 10) -> DataFrame:
    """(query_id, rank, doc_id, score, title, url) for many queries in one job."""
    best = top_k(scores(index, queries, ranker), k)
    return with_titles(index, best, k * len(queries)).select("query_id", "rank", "doc_id", "score", "title", "url")


def _best(rows: Sequence[tuple[int, float]], k: int) -> list[tuple[int, int, float]]:
    """(rank, doc_id, score): the rule of top_k for one group, given its first 2k (doc_id, score) by score and id."""
    least = rows[min(k, len(rows)) - 1][1] if rows else 0.0
    held = [(d, s) for i, (d, s) in enumerate(sorted(r for r in rows if r[1] >= least)) if s > least or i < k]
    chosen = sorted(held, key=lambda r: (-r[1], -r[0]))[:k]
    return [(i, d, s) for i, (d, s) in enumerate(sorted(chosen, key=lambda r: (-r[1], r[0])), 1)]


def ranked_search(index: Index, query: str, ranker: Ranker | None = None, k: int = 10) -> DataFrame:
    """(rank, doc_id, score, title, url) for one query, best first; no rows if no term is known.

    Up to MANY results the search runs at once: each task keeps its best 2k, and the best 2k of all come to the driver,
    which chooses among them and looks up their titles by id.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if k > MANY:
        return batch_search(index, [(0, query)], ranker, k).drop("query_id").orderBy("rank")
    first = scores(index, [(0, query)], ranker).orderBy(F.desc("score"), "doc_id").limit(2 * k).select("doc_id", "score").collect()
    best = _best([tuple(r) for r in first], k)
    ids = [d for _, d, _ in best]
    about = {r.doc_id: (r.title, r.url) for r in index.docstats.where(F.col("doc_id").isin(ids)).select("doc_id", "title", "url").collect()} if ids else {}
    columns = list(zip(*((i, d, s, *about[d]) for i, d, s in best if d in about))) or [()] * 5
    kinds = (("rank", pa.int32()), ("doc_id", pa.int64()), ("score", pa.float64()), ("title", pa.string()), ("url", pa.string()))
    return index.postings.sparkSession.createDataFrame(pa.table([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], names=[n for n, _ in kinds]))
