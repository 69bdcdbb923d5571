import random

import pytest
from pyspark.sql import functions as F

from lexshard.functions.analyzer import DEFAULT, FOLDED, RAW, UNSTEMMED
from lexshard.functions.text import fold_tables, normal_term, tokens, words_of


def test_words_equal_the_definition_on_every_kind_of_character(spark):
    source, _, gone, longer = fold_tables()
    pick = random.Random(5)
    special = source[::7] + gone[::9] + "".join(longer) + "İıſKÅßøłŁÑéﬁ½™№²①𝐚🄀日本語  ​­·’“—"
    texts = ["".join(pick.choice(special + "abz AZ09.-'") for _ in range(60)) for _ in range(300)]
    texts += ["", " ", "Don't STOP café", "x™y", "straße", "éa", "ﬁne ½ ①2", "a" * 50_000 + " é" * 1000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.w for r in df.select("i", tokens(F.col("t")).alias("w")).collect()}
    assert [got[i] for i in range(len(texts))] == [words_of(t) for t in texts]
    raw = {r.i: r.w for r in df.select("i", tokens(F.col("t"), False).alias("w")).collect()}
    assert [raw[i] for i in range(len(texts))] == [words_of(t, False) for t in texts]


def test_null_text_has_no_words(spark):
    assert spark.createDataFrame([(None,)], "t string").select(tokens(F.col("t")).alias("w")).first().w == []


def test_normal_terms(spark):
    df = spark.createDataFrame([("  Ärger\t",), ("abc",), ("",), ("—",), (None,), ("104  ",)], "t string")
    assert [r.n for r in df.select(normal_term(F.col("t")).alias("n")).collect()] == ["arger", "abc", None, None, None, "104"]


@pytest.mark.parametrize(
    "text, analyzer, expected",
    [
        ("Don't STOP café", FOLDED, [("don", 0), ("t", 1), ("stop", 2), ("cafe", 3)]),
        ("bank of england", UNSTEMMED, [("bank", 0), ("england", 2)]),
        ("straße", FOLDED, [("stra", 0), ("e", 1)]),
        ("café", RAW, [("caf", 0)]),
        ("x™y", FOLDED, [("x", 0), ("y", 1)]),
        ("The ponies were relational", DEFAULT, [("poni", 1), ("relat", 3)]),
        (None, DEFAULT, []),
    ],
)
def test_analysis_on_the_driver_and_in_columns(spark, text, analyzer, expected):
    assert analyzer.analyze(text) == expected
    df = spark.createDataFrame([(text,)], "t string").select(analyzer.occurrences(F.col("t")).alias("o"))
    row = df.select(analyzer.terms_of(F.col("o")).alias("t"), F.col("o.pos").alias("p")).first()
    assert list(zip(row.t, row.p)) == expected
