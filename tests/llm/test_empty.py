from lexshard.llm.queries import QUERIES


def test_every_query_on_empty_tables(spark, tables):
    data = tables()
    for name, f in QUERIES.items():
        assert f(spark, data).count() == 0, name


def test_every_query_on_rows_of_nulls_and_blanks(spark, tables):
    data = tables(
        wiki=[(None,), ("1",), ("2", None, None, ""), ("3", "t", None, " \n"), ("x", "a", "b", "c"), ("4", None, None, "one")], docstats=[(None,), (1,), (4, None, None, 1)],
        postings=[(None,), ("a",), (None, 1), ("one", 4), ("one", 4)], dictionary=[(None,), (0, "a")], documents=[(None,), (1,), (2, None, None, ""), (3, None, None, " "), (None, None, None, "text é")],
        eval_items=[(None,), (1,), (2, ""), (None, "a b c d e f g h i j k")],
    )
    rows = {name: f(spark, data).collect() for name, f in QUERIES.items()}
    assert [tuple(r) for r in rows["p1_found"]] == [("one", "rare"), ("one", "common")]
    assert rows["p2_found"] == [] and rows["p3_found"] == [] and rows["p5_found"] == [] and rows["p7_found"] == [] and rows["p8_found"] == []
    assert sorted((tuple(r) for r in rows["p6_ids"]), key=str) == sorted([(None, []), (1, []), (2, []), (3, [220]), (None, [5239, 38251])], key=str)
