import pytest
from pyspark.sql import functions as F

from lexshard.functions.porter import measure, stem, stem_array, stem_word

PAIRS = """caresses caress, ponies poni, ties ti, cats cat, feed feed, agreed agre, plastered plaster, hopping hop, falling fall, fizzed fizz, filing file,
sized size, happy happi, sky sky, relational relat, conditional condit, digitizer digit, vietnamization vietnam, triplicate triplic, formative form, goodness good,
revival reviv, replacement replac, adoption adopt, homologous homolog, probate probat, rate rate, cease ceas, controll control, roll roll, a a, be be, the the, of of, is is,
analogies analog, possibly possibl, y y, ies i, eed eed, bled bled, 2nd 2nd"""


@pytest.mark.parametrize("word, expected", [p.split() for p in PAIRS.replace("\n", " ").split(",")])
def test_published_pairs(word, expected):
    assert stem(word) == expected


def test_measure():
    assert [measure(w) for w in ("tr", "ee", "tree", "y", "by", "trouble", "oats", "trees", "ivy", "troubles", "private", "oaten")] == [0, 0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2]


def test_columns(spark):
    df = spark.createDataFrame([(["ponies", "cats", "cats"], "ponies"), ([], None), (None, "roll")], "ws array<string>, w string")
    rows = df.select(stem_array("ws").alias("a"), stem_word("w").alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(["poni", "cat", "cat"], "poni"), ([], None), (None, "roll")]
    assert df.select(F.size(stem_array(F.array(F.lit("x")))).alias("n")).first().n == 1
