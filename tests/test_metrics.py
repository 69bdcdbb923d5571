import random

from lexshard.operators import metrics


def test_measures(spark):
    results = spark.createDataFrame([(1, 1, 4), (1, 2, 2), (1, 3, 1), (2, 1, 9), (3, 1, 5)], "query_id long, rank int, doc_id long")
    qrels = spark.createDataFrame([(1, 1), (1, 4), (1, 4), (None, 3), (2, None), (3, 5), (3, 6), (4, 1)], "query_id long, doc_id long")
    rows = {r.query_id: (round(r.p_at_k, 6), round(r.ap, 6), round(r.ndcg_at_k, 6)) for r in metrics.judged(results, qrels, 10).collect()}
    assert rows == {1: (0.666667, 0.833333, 0.919721), 2: (0.0, 0.0, 0.0), 3: (1.0, 0.5, 0.613147)}
    queries = spark.createDataFrame([(1,), (2,), (3,), (4,)], "query_id long")
    mean = metrics.evaluate(results, qrels, queries).first()
    assert mean.n_queries == 4 and round(mean.p_at_k, 6) == round((2 / 3 + 1) / 4, 6)
    nothing = metrics.evaluate(results.limit(0), qrels, queries.limit(0)).first()
    assert (nothing.p_at_k, nothing.map, nothing.ndcg_at_k, nothing.n_queries) == (0.0, 0.0, 0.0, 0)


def test_percentiles_are_nearest_ranks(spark):
    pick = random.Random(8)
    for values in ([pick.random() for _ in range(360)], [1.0] * 50 + [2.0], [3.0], [float(x) for x in range(5000)]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double")
        got = {r.p: r.value for r in metrics.nearest_percentiles(df, "x", (0, 50, 95, 100)).collect()}
        ordered = sorted(values)
        assert got == {p: ordered[metrics.place_of(len(ordered), p)] for p in (0, 50, 95, 100)}
    assert metrics.place_of(360, 50) == 180 and metrics.place_of(360, 95) == 341
    empty = metrics.nearest_percentiles(spark.createDataFrame([], "x double"), "x", (50,)).collect()
    assert [(r.p, r.value) for r in empty] == [(50.0, 0.0)]


def test_latency_of_queries(index):
    from lexshard.operators.boolean import boolean_search

    out = metrics.benchmark_latency(["java", "python"], lambda q: boolean_search(index, q), warmup=1)
    assert out["n"] == 2 and 0 < out["p50_ms"] <= out["p95_ms"]
    assert metrics.benchmark_latency([], lambda q: None) == {"p50_ms": 0.0, "p95_ms": 0.0, "mean_ms": 0.0, "n": 0}
