import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from lexshard.functions.analyzer import DEFAULT, RAW, UNSTEMMED
from lexshard.operators import boolean, rank
from lexshard.operators.boolean import QuerySyntaxError, boolean_search, by_operators, parse
from lexshard.operators.index import build_index
from lexshard.operators.phrase import phrase_batch, phrase_by_anchors, phrase_search
from lexshard.operators.rank import BM25, TfIdf, batch_search, query_terms, ranked_search, scores, table_scores, term_weights, top_k


def ids(df):
    return [r.doc_id for r in df.collect()]


@pytest.mark.parametrize(
    "query, expected",
    [
        ("python AND java", [2, 5]), ("search OR java", [0, 1, 2, 3, 4, 5]), ("python NOT java", [0, 4]), ("python AND (search OR index) NOT java", [0, 4]), ("NOT java", [0, 3, 4]),
        ("python java", [0, 2, 4, 5]), ("python and java", [0, 2, 4, 5]), ("python NOT NOT java", [2, 5]), ("(python AND java", [2, 5]), ("java-python", [1, 2, 5]), ("NOT !!", [0, 1, 2, 3, 4, 5]), ("!! OR java", [1, 2, 5]),
        ("AND java", []), ("ANDROID OR java", [1, 2, 5]), ("x-AND OR java", [1, 2, 5]), (") java", []), ("NOT (python OR java)", [3]), ("unknown", []), ("NOT unknown", [0, 1, 2, 3, 4, 5]),
    ],
)
def test_boolean(index, query, expected):
    assert ids(boolean_search(index, query)) == expected
    assert sorted(ids(by_operators(index, parse(query, index.analyzer.terms)))) == expected


@pytest.mark.parametrize("query", ["", "python AND", "NOT", "(", "python OR NOT"])
def test_boolean_without_an_operand(index, query):
    with pytest.raises(QuerySyntaxError):
        boolean_search(index, query)


def test_random_boolean_trees_against_sets(index):
    has = {t: {r.doc_id for r in index.get(t).collect()} for t in ("python", "java", "search", "index", "zzz")}
    everything, pick = set(range(6)), random.Random(3)

    def tree(depth):
        if depth == 0 or pick.random() < 0.2:
            t = pick.choice(sorted(has))
            return t, has[t]
        (a, x), (b, y) = tree(depth - 1), tree(depth - 1)
        return pick.choice([(f"({a} AND {b})", x & y), (f"({a} OR {b})", x | y), (f"({a} NOT {b})", x - y), (f"(NOT {a})", everything - x)])

    for _ in range(12):
        text, expected = tree(3)
        assert ids(boolean_search(index, text)) == sorted(expected), text


def test_set_algebra(spark):
    pick = random.Random(1)
    for _ in range(5):
        a, b = (set(pick.sample(range(300), pick.randint(0, 60))) for _ in range(2))
        x, y = (spark.createDataFrame([(i,) for i in s], "doc_id long") for s in (a, b))
        assert set(ids(boolean.intersect(x, y))) == a & b
        assert sorted(ids(boolean.union(x, y))) == sorted(a | b)
        assert set(ids(boolean.difference(x, y))) == a - b


@pytest.mark.parametrize("query, expected", [("python search", [0, 4]), ("search index", [3, 4, 5]), ("engine python", []), ("python", [0, 2, 4, 5]), ("", []), ("java search index", [5]), ("python unknown", [])])
def test_phrases(index, query, expected):
    assert ids(phrase_search(index, query)) == expected
    assert ids(phrase_by_anchors(index, query)) == expected


def test_phrase_closes_the_gap_of_its_stop_words(spark):
    docs = spark.createDataFrame([(0, "", "", "bank of england"), (1, "", "", "bank england"), (2, "", "", "a b a")], "doc_id long, title string, url string, body string")
    index = build_index(docs, UNSTEMMED)
    assert ids(phrase_search(index, "bank of england")) == [1]
    assert ids(phrase_search(index, "bank of england", strict_gaps=True)) == [0]
    raw = build_index(docs, RAW)
    assert ids(phrase_search(raw, "a b a")) == [2] and ids(phrase_search(raw, "a a")) == []


@pytest.mark.parametrize(
    "ranker, query, expected",
    [
        (BM25(), "python search", [(0, 0.925304), (4, 0.810702), (5, 0.810702), (2, 0.462652), (3, 0.462652)]),
        (BM25(1.2, 0.0), "java index", [(1, 1.134980), (5, 1.134980), (2, 0.693147), (3, 0.441833), (4, 0.441833)]),
        (TfIdf(), "python search", [(0, 0.468191), (4, 0.405465), (5, 0.405465), (2, 0.234095), (3, 0.234095)]),
    ],
)
def test_ranked(index, ranker, query, expected):
    rows = ranked_search(index, query, ranker).collect()
    assert [(r.doc_id, round(r.score, 6)) for r in rows] == expected
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1)) and rows[0].title == f"t{rows[0].doc_id}"


def test_ranked_edges(index, spark):
    assert ranked_search(index, "unknown").count() == 0 and ranked_search(index, "").count() == 0
    assert query_terms(index, [(1, "java python java")]) == [(1, 0, "java"), (1, 1, "python")]
    same = build_index(spark.createDataFrame([(i, "", "", "x") for i in range(3)], "doc_id long, title string, url string, body string"), RAW)
    assert [(r.doc_id, r.score) for r in ranked_search(same, "x", TfIdf(), 5).collect()] == [(0, 0.0), (1, 0.0), (2, 0.0)]
    with pytest.raises(ValueError):
        ranked_search(index, "java", k=0)
    both = batch_search(index, [(1, "python"), (2, "java")], k=2)
    assert {(r.query_id, r["rank"]) for r in both.collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}
    top = {r.term: r.max_score for r in term_weights(index, BM25()).collect()}
    assert math.isclose(top["java"], math.log(3.5 / 3.5 + 1) * 2.5)


def by_heap(scores, k):
    """What a heap of k leaves that sees documents by id and takes only better ones."""
    heap = []
    for doc, s in sorted(scores):
        if len(heap) < k:
            heapq.heappush(heap, (s, doc))
        elif s > heap[0][0]:
            heapq.heapreplace(heap, (s, doc))
    return sorted(heap, key=lambda x: (-x[0], x[1]))


def test_ties_at_the_boundary(spark):
    pick, rows, cases = random.Random(9), [], {}
    for q in range(300):
        scores = [(d, float(pick.randint(0, 3))) for d in pick.sample(range(50), pick.randint(1, 12))]
        cases[q] = scores
        rows += [(q, d, s) for d, s in scores]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, score double").persist()
    for k in (1, 2, 5):
        assert all([(s, d) for _, d, s in rank._best(sorted(c, key=lambda x: (-x[1], x[0]))[: 2 * k], k)] == by_heap(c, k) for c in cases.values())
        got = {}
        for r in top_k(df, k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.score, r.doc_id))
        assert got == {q: by_heap(s, k) for q, s in cases.items()}
    df.unpersist()


def test_default_analyzer_serves_both_sides(spark):
    index = build_index(spark.createDataFrame([(0, "", "", "Bridges were painted"), (1, "", "", "a bridge")], "doc_id long, title string, url string, body string"), DEFAULT)
    assert ids(boolean_search(index, "bridge AND painting")) == [0] and ids(phrase_search(index, "BRIDGED")) == [0, 1]
    assert index.postings.where(F.col("term") == "bridg").count() == 2


def test_batches_find_what_single_queries_find(index):
    texts = ["python AND java", "search OR java", "python NOT java", "python AND (search OR index) NOT java", "NOT java", "NOT !!", "unknown", "NOT (python OR unknown)", "java AND python", "!!"]
    got = {}
    for r in boolean.boolean_batch(index, list(enumerate(texts))).collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert {q: sorted(d) for q, d in got.items()} == {q: d for q, t in enumerate(texts) if (d := ids(boolean_search(index, t)))}
    phrases = ["python search", "search index", "engine python", "python", "", "java search index", "python unknown", "python search index fast"]
    got = {}
    for r in phrase_batch(index, list(enumerate(phrases))).collect():
        got.setdefault(r.query_id, []).append(r.doc_id)
    assert {q: sorted(d) for q, d in got.items()} == {q: d for q, t in enumerate(phrases) if (d := ids(phrase_search(index, t)))}
    with pytest.raises(QuerySyntaxError):
        boolean.boolean_batch(index, [(0, "python AND")])
    assert boolean.boolean_batch(index, []).count() == 0 and phrase_batch(index, []).count() == 0


def test_phrase_batch_with_repeated_terms(spark):
    docs = spark.createDataFrame([(0, "", "", "a b a"), (1, "", "", "a a b a a"), (2, "", "", "b b")], "doc_id long, title string, url string, body string")
    raw = build_index(docs, RAW)
    got = sorted((r.query_id, r.doc_id) for r in phrase_batch(raw, [(1, "a b a"), (2, "a a"), (3, "b b"), (4, "a a b a a")]).collect())
    assert got == [(1, 0), (1, 1), (2, 1), (3, 2), (4, 1)]
    for q, text in ((1, "a b a"), (2, "a a"), (3, "b b"), (4, "a a b a a")):
        assert ids(phrase_search(raw, text)) == [d for i, d in got if i == q]


def test_queries_of_a_table(index, spark):
    listed = [(1, "python search"), (2, "java index java"), (3, "unknown"), (5, "index")]
    rows = spark.createDataFrame([*listed, (4, None), (None, "python")], "query_id long, text string")
    for ranker in (BM25(), TfIdf()):
        a = {(r.query_id, r.doc_id): r.score for r in scores(index, listed, ranker).collect()}
        assert a == {(r.query_id, r.doc_id): r.score for r in table_scores(index, rows, ranker).collect()} and len(a) > 10


def test_many_results_are_cut_in_each_task(spark, monkeypatch):
    """Beyond what Spark pushes down, and with little room to gather: as a heap, with ties and null groups."""
    monkeypatch.setattr(rank, "GATHERED", 50)
    pick, rows, cases = random.Random(2), [], {}
    for q in (None, 1, 2):
        cases[q] = [(d, float(pick.randint(0, 40))) for d in pick.sample(range(5000), 1800)]
        rows += [(q, d, s) for d, s in cases[q]]
    pick.shuffle(rows)
    df = spark.createDataFrame(rows, "query_id long, doc_id long, score double").repartition(3)
    monkeypatch.setattr(rank, "PUSHED", 100)
    for k in (60, 700):
        got = {}
        for r in top_k(df, k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.score, r.doc_id))
        assert got == {q: by_heap(s, k) for q, s in cases.items()}
    assert top_k(df.limit(0), 60).count() == 0


def test_large_results_are_cut_before_the_shuffle(spark):
    plan = top_k(spark.range(10).selectExpr("id % 2 as query_id", "id as doc_id", "1.0D as score"), 1000)._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("MapInArrow") > plan.rindex("Exchange hashpartitioning")
