import os

from lexshard import session
from lexshard.functions.analyzer import DEFAULT, RAW
from lexshard.operators.index import build_index, build_meta, build_saved, corpus_stats, open_index, stored_bytes

SCHEMA = "doc_id long, title string, url string, body string"


# Three documents and their postings.
def golden(spark):
    return spark.createDataFrame([(0, "t0", "u0", "alpha beta alpha"), (1, "t1", "u1", "beta gamma"), (2, "t2", "u2", "alpha gamma gamma")], SCHEMA)


def postings(index):
    return {(r.term, r.doc_id): (r.tf, r.positions) for r in index.postings.collect()}


EXPECTED = {
    ("alpha", 0): (2, [0, 2]), ("alpha", 2): (1, [0]), ("beta", 0): (1, [1]), ("beta", 1): (1, [0]), ("gamma", 1): (1, [1]), ("gamma", 2): (2, [1, 2]),
}


def test_postings_and_statistics(spark):
    index = build_index(golden(spark), RAW)
    assert postings(index) == EXPECTED
    assert (index.n_docs, index.vocab_size(), index.avgdl) == (3, 3, 8 / 3)
    assert index.df("gamma") == 2 and index.df("delta") == 0 and index.get("delta").count() == 0
    assert {r.term: (r.df, r.cf) for r in index.dictionary.collect()} == {"alpha": (2, 3), "beta": (2, 2), "gamma": (2, 3)}


def test_saved_and_opened(spark, tmp_path):
    build_index(golden(spark), DEFAULT).save(str(tmp_path))
    index = open_index(spark, str(tmp_path))
    assert index.analyzer == DEFAULT
    assert {k: v for k, v in postings(index).items()} == EXPECTED
    # per term: df, then per posting the gap of doc_id, tf, number of positions and their gaps, one byte each
    assert index.meta["postings_bytes"] == 3 * 1 + 6 * 3 + 8
    assert index.n_docs == 3


def test_blank_null_and_stopword_only_documents(spark):
    rows = [(0, None, None, None), (1, None, "u", "  \n"), (2, None, None, "the of"), (3, "t", None, "solar the solar")]
    index = build_index(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r.doc_id, r.title, r.url, r.length) for r in index.docstats.collect()) == [(2, "", "", 0), (3, "t", "", 2)]
    assert postings(index) == {("solar", 3): (2, [0, 2])}
    assert index.avgdl == 1.0


def test_empty_corpus(spark):
    index = build_index(spark.createDataFrame([], SCHEMA))
    assert index.n_docs == 0 and index.avgdl == 0.0 and index.postings.count() == 0
    assert corpus_stats(index.docstats).first().avgdl == 0.0
    assert build_meta(index).first().postings_bytes == 0


def test_long_document(spark):
    index = build_index(spark.createDataFrame([(7, "t", "u", "abc xyz " * 60_000)], SCHEMA), RAW)
    got = postings(index)
    assert got[("abc", 7)] == (60_000, list(range(0, 120_000, 2))) and got[("xyz", 7)][0] == 60_000


def test_what_is_settled_can_be_removed(spark, tmp_path):
    kept = build_index(golden(spark), RAW, keep=True)
    assert postings(kept) == EXPECTED and kept.n_docs == 3 and session._SETTLED
    before = set(session._SETTLED)
    index = build_saved(golden(spark), str(tmp_path / "x"), RAW)
    assert set(session._SETTLED) == before and postings(index) == EXPECTED
    assert stored_bytes(spark, str(tmp_path / "x")) == sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / "x") for f in fs if not f.endswith(".crc"))
    paths = [p.removeprefix("file://") for p in session._SETTLED]
    session.clear_settled(spark)
    assert not session._SETTLED and not any(os.path.exists(p) for p in paths)
