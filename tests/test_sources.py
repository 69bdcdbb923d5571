import bisect
import json

from pyspark.sql import functions as F

from lexshard import cli
from lexshard.functions.analyzer import RAW
from lexshard.operators.index import build_index
from lexshard.sources import corpus
from lexshard.streaming.ingest import ingest, open_stream_index, read_lines

LINES = ['{"id": "9", "title": "A", "url": "u", "text": "solar eclipse"}', "", "   ", '{"title": "B", "text": "\\u00a0 \\n"}', '{"text": "lunar\\nlanding"}', '{"title": null, "url": null, "text": "solar wind"}', "no object", '{"title": "C", "text": null}']


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(LINES))
    rows = corpus.load_jsonl(spark, str(tmp_path / "a.jsonl")).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(0, "A", "u", "solar eclipse"), (1, "", "", "lunar\nlanding"), (2, "", "", "solar wind")]
    assert corpus.load_jsonl(spark, str(tmp_path / "a.jsonl"), 2).count() == 2 and corpus.load_jsonl(spark, str(tmp_path / "a.jsonl"), 0).count() == 3
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps({"text": f"doc {i}"}) for i in range(500)))
    both = corpus.load_jsonl(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r.doc_id for r in both] == list(range(503)) and [r.body for r in both[3:]] == [f"doc {i}" for i in range(500)]


def test_synthetic_corpus(spark):
    df = corpus.synthetic_corpus(spark, n_docs=200, n_spam=5, spam_len=900)
    rows = df.orderBy("doc_id").collect()
    assert rows == corpus.synthetic_corpus(spark, n_docs=200, n_spam=5, spam_len=900).repartition(3).orderBy("doc_id").collect()
    assert rows != corpus.synthetic_corpus(spark, n_docs=200, n_spam=5, spam_len=900, seed=8).orderBy("doc_id").collect()
    assert len(rows) == 205 and {r.topic for r in rows[:200]} == set(corpus.TOPICS) and {r.topic for r in rows[200:]} == {"spam"}
    sizes = [len(r.body.split()) for r in rows]
    assert min(sizes[:200]) >= 60 and max(sizes[:200]) <= 260 and set(sizes[200:]) == {900}
    own = [sum(w in corpus.topic_vocabulary(corpus.TOPICS.index(r.topic)) for w in r.body.split()) / len(r.body.split()) for r in rows[:200]]
    connectors = [sum(w in corpus.CONNECTORS for w in r.body.split()) / len(r.body.split()) for r in rows[:200]]
    assert 0.25 < sum(own) / 200 < 0.31 and 0.37 < sum(connectors) / 200 < 0.43
    vocabulary = corpus.background_vocabulary()
    assert len(vocabulary) > 3500 and vocabulary == sorted(set(vocabulary))
    weights = corpus.zipf_cumulative(4)
    assert weights[-1] == 1.0 and abs(weights[0] - 12 / 25) < 1e-12
    assert len(corpus.topic_queries()) == 12 and corpus.topic_qrels(df).count() == 200


def test_zipf_draws_every_word_by_its_weight(spark):
    words, steps = corpus.background_vocabulary(), 1 << 16
    weights = corpus.zipf_cumulative(len(words))
    edges = [x for a, b in zip([0.0, *weights], weights) for x in (a, (a + b) / 2)]
    us = [i / steps for i in range(steps)] + edges
    rows = spark.createDataFrame([(u,) for u in us], "u double").select("u", corpus._zipf(words, F.col("u")).alias("w")).collect()
    assert {r.w for r in rows} == set(words)
    assert all(r.w == words[bisect.bisect_right(weights, r.u)] for r in rows)


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "w.jsonl").write_text("\n".join(LINES))
    out = str(tmp_path / "index")
    cli.main(["build", "--wiki", str(tmp_path / "w.jsonl"), "--out", out, "--mem-cap", "5"])
    assert "n_docs: 3" in capsys.readouterr().out
    cli.main(["search", "solar eclipse", "--index", out])
    assert capsys.readouterr().out.startswith(" 1. [ 1.")
    cli.main(["search", "solar", "--index", out, "--tfidf", "--k", "1"])
    assert len(capsys.readouterr().out.splitlines()) == 1
    cli.main(["search", "solar NOT eclipse", "--index", out, "--bool", "--phrase"])
    assert capsys.readouterr().out == " 1.   ()\n"
    cli.main(["search", "solar eclipse", "--index", out, "--phrase"])
    assert capsys.readouterr().out == " 1. A  (u)\n"
    cli.main(["search", "eclipse solar", "--index", out, "--phrase"])
    assert capsys.readouterr().out == "(no matches)\n"
    cli.main(["search", "unknown", "--index", out])
    assert capsys.readouterr().out == ""
    cli.main(["build", "--synthetic", "30", "--out", out])
    assert "n_docs: 280" in capsys.readouterr().out


def test_streamed_batches_equal_one_build(spark, tmp_path):
    source, path, checkpoint = tmp_path / "in", str(tmp_path / "index"), str(tmp_path / "checkpoint")
    source.mkdir()
    docs = [{"doc_id": i, "title": f"t{i}", "text": f"alpha w{i % 3} beta"} for i in range(9)]
    for part in range(2):
        (source / f"{part}.json").write_text("\n".join(json.dumps(d) for d in docs[part * 5 : part * 5 + 5]) + "\nbroken\n")
        ingest(read_lines(spark, str(source), 1), path, checkpoint, RAW).awaitTermination()
    index = open_stream_index(spark, path, RAW)
    whole = build_index(spark.createDataFrame([(d["doc_id"], d["title"], None, d["text"]) for d in docs], "doc_id long, title string, url string, body string"), RAW)
    for a, b in ((index.postings, whole.postings), (index.dictionary, whole.dictionary), (index.docstats, whole.docstats)):
        assert a.select(b.columns).exceptAll(b).count() == 0 and a.count() == b.count()
    assert index.n_docs == 9 and index.postings.where(F.col("term") == "alpha").count() == 9
