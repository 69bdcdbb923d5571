import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lexshard.functions import codec

KNOWN = {0: "80", 5: "85", 127: "ff", 128: "0180", 16383: "7fff", 16384: "010080", 2097151: "7f7fff", 2097152: "01000080", 10**9: "035c6b1480"}


def test_known_codes(spark):
    df = spark.createDataFrame([(n,) for n in KNOWN], "n long")
    rows = df.select("n", codec.vbyte_hex(F.col("n")).alias("h"), codec.vbyte_length(F.col("n")).alias("l")).collect()
    assert {r.n: r.h for r in rows} == KNOWN and all(len(r.h) == 2 * r.l for r in rows)
    with pytest.raises(PySparkException):
        spark.createDataFrame([(-1,)], "n long").select(codec.vbyte_hex(F.col("n"))).collect()


def test_round_trips(spark):
    pick = random.Random(2)
    lists = [[pick.randint(0, 5_000_000) for _ in range(pick.randint(0, 40))] for _ in range(400)] + [[], [(1 << 62)], [x for s in (7, 14, 21, 28, 56) for x in ((1 << s) - 1, 1 << s, (1 << s) + 1)]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "i int, xs array<long>")
    rows = df.select("xs", codec.vbyte_decode(codec.vbyte_encode(F.col("xs"))).alias("ys")).collect()
    assert all(r.xs == r.ys for r in rows)
    ordered = spark.createDataFrame([(sorted(pick.sample(range(200_000), pick.randint(0, 50))),) for _ in range(300)] + [([5, 12, 13, 40, 999],)], "xs array<long>")
    rows = ordered.select("xs", codec.gap_encode(F.col("xs")).alias("g"), codec.gap_decode(codec.vbyte_decode(codec.vbyte_encode(codec.gap_encode(F.col("xs"))))).alias("ys")).collect()
    assert all(r.xs == r.ys for r in rows)
    assert [r.g for r in rows if r.xs == [5, 12, 13, 40, 999]] == [[5, 7, 1, 27, 959]]


def test_streams(spark):
    data = bytes.fromhex("830182" + "00c6a9"[2:])
    first, second = [3, 130, 9001], [0, 1, 2, 7_000_000]
    packed = [bytes(spark.createDataFrame([(x,)], "xs array<long>").select(codec.vbyte_encode(F.col("xs")).alias("b")).first().b) for x in (first, second)]
    got, at = codec.decode_stream(b"".join(packed), 0, 3)
    assert got == first and at == len(packed[0])
    assert codec.decode_stream(b"".join(packed), at, 4) == (second, sum(map(len, packed)))
    assert codec.decode_stream(data, 1, 0) == ([], 1)
    with pytest.raises(IndexError):
        codec.decode_stream(packed[0], 0, 4)
    assert codec.vbyte_decode is not None and spark.createDataFrame([(b"\x81\x01",)], "b binary").select(codec.vbyte_decode("b").alias("x")).first().x == [1]


def test_document_gaps_over_ranges(spark):
    pick = random.Random(4)
    rows = [(t, d) for t in "ab" for d in sorted(pick.sample(range(400_000), 60))] + [("c", 7)]
    df = spark.createDataFrame(rows, "term string, doc_id long")
    gaps = codec.doc_gaps(df)
    got = {}
    for r in gaps.orderBy("term", "doc_id").collect():
        got.setdefault(r.term, []).append(r.gap)
    for t in "abc":
        ids = sorted(d for x, d in rows if x == t)
        assert got[t] == [b - a for a, b in zip([0, *ids], ids)]
    assert codec.docs_from_gaps(gaps).where(F.col("decoded") != F.col("doc_id")).count() == 0


def test_posting_lists_to_bytes_and_back(spark):
    rows = [("a", 3, 2, [0, 200]), ("a", 70_000, 1, [5]), ("a", 70_001, 3, [1, 2, 40_000]), ("b", 65_535, 1, [0]), ("b", 65_536, 1, [9])]
    postings = spark.createDataFrame(rows, "term string, doc_id long, tf int, positions array<int>")
    lists = codec.encoded_postings(postings)
    got = {(r.term, r.range): (r.base, r.n, bytes(r.code)) for r in lists.collect()}
    assert got["a", 0] == (0, 1, bytes([0x83, 0x82, 0x82, 0x80, 0x01, 0xC8])) and {k: v[:2] for k, v in got.items()} == {("a", 0): (0, 1), ("a", 1): (3, 2), ("b", 0): (0, 1), ("b", 1): (65_535, 1)}
    assert sorted(tuple(r) for r in codec.decoded_postings(lists).collect()) == sorted(rows)
    whole = codec.encoded_postings_bytes(postings).first()[0]
    assert whole == sum(len(c) for _, _, c in got.values()) + 2  # and one byte for each term's df
    assert codec.decoded_postings(codec.encoded_postings(postings.limit(0))).count() == 0


def test_stream_decoding_of_columns(spark):
    code = bytes([0x85, 0x01, 0x80, 0x87])
    df = spark.createDataFrame([(code, 0, 2), (code, 1, 2), (code, 0, 0), (None, 0, 1)], "data binary, pos int, count int")
    got = [r.x and (r.x.numbers, r.x.next) for r in df.select(codec.vbyte_decode_stream("data", "pos", "count").alias("x")).collect()]
    assert got == [([5, 128], 3), ([128, 7], 4), ([], 0), None]
