import datetime

import pytest
from pyspark.sql import functions as F

from lexshard.operators.eager import eager_join, heavy, key_states, rolled_up
from lexshard.operators.postings import clean_dictionary, clean_docstats, clean_postings
from lexshard.plans import heavy_keys

POSTINGS = "term string, doc_id long, tf int, positions array<int>, block_no int, flushed_at timestamp"
NOW = datetime.datetime(2024, 1, 1)


def test_cleaning(spark):
    rows = [
        ("Ärger ", 1, 2, [1, 5], 0, NOW), ("arger", 1, 2, None, 3, None), ("arger", 2, None, [4], 0, NOW), ("x", 2, None, None, 0, NOW),
        (None, 2, 1, [0], 0, NOW), ("y", None, 1, [0], 0, NOW), ("—", 2, 1, [0], 0, NOW), ("", 2, 1, [0], 0, NOW),
    ]
    df = spark.createDataFrame(rows, POSTINGS).withColumn("n", F.lit(1)).withColumn("key_kind", F.lit("z"))
    assert sorted(tuple(r) for r in clean_postings(df).collect()) == [("arger", 1, 2), ("arger", 2, 1), ("x", 2, 0)]
    listed = spark.createDataFrame([(0, "A ", 3), (0, "a", 2), (1, "a", None), (None, "b", 1), (0, None, 1)], "block_no int, term string, df long")
    assert sorted((tuple(r) for r in clean_dictionary(listed).collect()), key=str) == [("a", 0, 3), ("a", 1, None), ("b", None, 1)]
    pages = spark.createDataFrame([(1, None), (1, 5), (2, None), (None, 3)], "doc_id long, length int")
    assert sorted((tuple(r) for r in clean_docstats(pages).collect()), key=str) == [(1, 5), (2, None)]


def test_eager_join_equals_the_plain_join(spark):
    left = spark.createDataFrame([("h", i) for i in range(300)] + [("a", 1), ("a", None), (None, 9), ("l", 4)], "k string, v long").withColumn("w", F.lit("clash"))
    right = spark.createDataFrame([("h", i, i % 3) for i in range(200)] + [("a", 5, 0), (None, 8, 0), ("r", 2, 1)], "k string, v long, g long").withColumn("w", F.lit(1))
    plain = left.alias("l").join(right.alias("r"), "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("l.v").alias("a"), F.sum("r.v").alias("b"))
    states = eager_join(left, right, ["k"], {"v": "v"}, {"v": "v"})
    got = {r.k: (r.joined_rows, r.joined_left_v, r.joined_right_v) for r in states.collect() if r.joined_rows}
    assert got == {r.k: (r.n, r.a, r.b) for r in plain.collect()}
    sides = sorted(((r.k, r.left_rows, r.right_rows) for r in states.collect()), key=str)
    assert sides == sorted([("h", 300, 200), ("a", 2, 1), (None, 1, 0), (None, 0, 1), ("l", 1, 0), ("r", 0, 1)], key=str)
    by_g = rolled_up(eager_join(left, right, ["k"], {"v": "v"}, {"v": "v"}, "right", right_by=["g"]), ["g"], ["joined_rows", "joined_left_v"])
    expected = right.join(left.select("k", F.col("v").alias("lv")), "k", "left").groupBy("g").agg(F.count("lv").alias("n"), F.sum("lv").alias("s"))
    plain_rows = left.alias("l").join(right.alias("r"), "k").groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("l.v").alias("s"))
    assert {r.g: r.joined_rows for r in by_g.collect() if r.joined_rows} == {r.g: r.n for r in plain_rows.collect()}
    assert expected.count() == by_g.count()


def test_heavy_keys_and_ties(spark):
    states = key_states(spark.createDataFrame([("a",)] * 5 + [("b",)] * 5 + [("c",)], "k string"), ["k"], {}, "left")
    assert sorted(r.k for r in heavy(states, "left_rows", 2).collect()) == []
    assert sorted(r.k for r in heavy(states, "left_rows", 3).collect()) == ["a", "b"]
    assert heavy(states.limit(0), "left_rows", 3).count() == 0


def test_products_beyond_a_long(spark):
    """2^62 on one side, two rows on the other; and row counts whose product with the share no long holds."""
    big = spark.createDataFrame([("a", 10**13)], "k string, v long")
    joined = eager_join(big.withColumn("one", F.lit(2**62)), big.unionAll(big), ["k"], {"one": "one"}, {"v": "v"}).first()
    assert joined.joined_left_one == 2**63 and joined.joined_right_v == 2 * 10**13
    assert [r.k for r in heavy(spark.createDataFrame([("a", 10**17), ("b", 10**14)], "k string, left_rows long"), "left_rows", 220).collect()] == ["a"]


@pytest.fixture
def tables(spark, tmp_path):
    def write(postings, dictionary, docstats):
        for name, rows, schema in (("postings", postings, POSTINGS), ("dictionary", dictionary, "block_no int, term string, df long, byte_offset long, byte_length int"), ("docstats", docstats, "doc_id long, title string, url string, length int")):
            spark.createDataFrame(rows, schema).withColumn("joined_rows", F.lit(0)).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_queries_on_small_tables(spark, tables):
    rows = [("the", d, 1, [0], 0, NOW) for d in range(300)] + [(f"w{i}", 7, 2, [i, i + 1], 0, NOW) for i in range(299)] + [("The", 3, 1, [0], 1, None), (None, None, None, None, None, None)]
    data = tables(rows, [(0, "the", 200, 0, 0), (1, "the", 100, 0, 0), (None, None, None, None, None)], [(7, None, None, 600), (None, None, None, None)])
    assert sorted(tuple(r) for r in heavy_keys.p4_found(spark, data).collect()) == [("doc_id", "7"), ("term", "the")]
    totals = {(r.key_kind, r.key_value): (r.postings, r.total_tf, r.listed, r.listed_amount, r.joined_rows, r.joined_tf) for r in heavy_keys.p4_totals(spark, data).collect()}
    assert totals[("term", "the")] == (300, 300, 2, 300, 600, 600) and totals[("doc_id", "7")] == (300, 599, 1, 600, 300, 599) and len(totals) == 600
    assert {r.block_no: (r.terms, r.sum_df, r.postings, r.sum_tf) for r in heavy_keys.p4_block_totals(spark, data).collect()} == {0: (1, 200, 300, 300), 1: (1, 100, 300, 300)}


def test_queries_on_empty_tables(spark, tables):
    data = tables([], [], [])
    for f in heavy_keys.QUERIES.values():
        assert f(spark, data).count() == 0
