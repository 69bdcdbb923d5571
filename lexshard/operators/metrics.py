"""Quality of ranked results: precision at k, average precision, nDCG, their means, and latency percentiles."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judged(results: DataFrame, qrels: DataFrame, k: int, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Per query (and further keys in by): p_at_k, ap, ndcg_at_k over results (by, rank, doc_id) against qrels (query_id, doc_id).

    P@k divides by the results there are, at most k; AP by all relevant documents, over the results given; nDCG by the
    best order of min(relevant, k). Nothing returned or nothing relevant gives 0. Repeated or null judgements count
    once or not at all. Queries without results or without judgements are not in the output; see evaluate.
    """
    by = list(by)
    good = qrels.where(F.col("query_id").isNotNull() & F.col("doc_id").isNotNull()).select("query_id", "doc_id").distinct()
    many = good.groupBy("query_id").agg(F.count(F.lit(1)).alias("relevant"))
    rows = results.select(*by, "rank", "doc_id").join(good.withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    # the results of a query are as few as were asked for
    lists = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("rank", F.coalesce("hit", F.lit(0)).alias("hit")))).alias("list"))
    lists = lists.join(many, "query_id", "left").withColumn("relevant", F.coalesce("relevant", F.lit(0)))
    top = F.filter("list", lambda x: x.rank <= k)
    hits = F.aggregate(top, F.lit(0), lambda a, x: a + x.hit)
    found = F.aggregate(
        "list", F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("s")),
        lambda a, x: F.struct((a.n + x.hit).alias("n"), (a.s + F.when(x.hit == 1, (a.n + 1) / x.rank).otherwise(0.0)).alias("s")),
    ).getField("s")
    gain = F.aggregate(top, F.lit(0.0), lambda a, x: a + x.hit / F.log2(x.rank + 1))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("relevant", F.lit(k)), F.lit(1))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    some = F.col("relevant") > 0
    return lists.select(
        *by, (hits / F.greatest(F.least(F.lit(k), F.size("list")), F.lit(1))).alias("p_at_k"),
        F.when(some, found / F.col("relevant")).otherwise(0.0).alias("ap"), F.when(some, gain / ideal).otherwise(0.0).alias("ndcg_at_k"),
    )


def evaluate(results: DataFrame, qrels: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """One row of means over all queries (query_id): p_at_k, map, ndcg_at_k, n_queries; zeros where nothing was found."""
    rows = queries.select("query_id").distinct().join(judged(results, qrels, k), "query_id", "left")
    mean = lambda c: F.coalesce(F.avg(F.coalesce(F.col(c), F.lit(0.0))), F.lit(0.0))
    return rows.agg(mean("p_at_k").alias("p_at_k"), mean("ap").alias("map"), mean("ndcg_at_k").alias("ndcg_at_k"), F.count(F.lit(1)).alias("n_queries"))


def place_of(n: int, p: float) -> int:
    """The place, from 0, of a percentile among n sorted values: p/100 (n - 1), halves to even."""
    return min(n - 1, round(p / 100 * (n - 1)))


def nearest_percentiles(values: DataFrame, column: str, ps: Sequence[float]) -> DataFrame:
    """(p, value): nearest-rank percentiles of a column; 0.0 if it holds no values. Nulls are no values.

    Exact without putting all values in order: an approximate sketch gives, for each p, a narrow range of values that
    surely holds its place (the sketch errs by 1/10000 of the ranks, the range spans 40 times that); how many values
    lie below is counted, and only the different values within are put in order.
    """
    spark = values.sparkSession
    v = F.col(column).cast("double")
    some = values.select(v.alias("v")).where(F.col("v").isNotNull())
    around = [x for p in ps for x in (max(p / 100 - 0.002, 0.0), min(p / 100 + 0.002, 1.0))]
    ends = some.agg(F.percentile_approx("v", around, 10_000).alias("e")).first().e
    if not ends:
        return spark.createDataFrame([(float(p), 0.0) for p in ps], "p double, value double")
    ranges = list(zip(map(float, ps), ends[::2], ends[1::2]))
    n, *below = some.agg(F.count(F.lit(1)), *(F.sum((F.col("v") < lo).cast("long")) for _, lo, _ in ranges)).first()
    out = None
    for (p, lo, hi), under in zip(ranges, below):
        counts = some.where(F.col("v").between(lo, hi)).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("v"))).where(F.col("upto") > place_of(n, p) - under)
        one = upto.agg(F.min("v").alias("value")).select(F.lit(p).alias("p"), "value")
        out = one if out is None else out.unionAll(one)
    return out


def benchmark_latency(queries: Sequence[str], search: Callable[[str], DataFrame], warmup: int = 5, limit_s: float | None = None) -> dict[str, float]:
    """Wall-clock milliseconds of each query, collected; p50, p95, mean and n, how many were run before limit_s was over."""

    def run(q: str) -> float:
        start = time.perf_counter()
        search(q).collect()
        return (time.perf_counter() - start) * 1000

    for q in queries[:warmup]:
        run(q)
    took, began = [], time.perf_counter()
    for q in queries:
        if limit_s is not None and time.perf_counter() - began > limit_s:
            break
        took.append(run(q))
    took.sort()
    at = lambda p: took[place_of(len(took), p)] if took else 0.0
    return {"p50_ms": at(50), "p95_ms": at(95), "mean_ms": sum(took) / len(took) if took else 0.0, "n": len(took)}
