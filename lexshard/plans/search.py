"""Registered queries of the retrieval engine, each over the whole documents table, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshard.functions import codec
from lexshard.functions.analyzer import DEFAULT, FOLDED, RAW, STOPWORDS, UNSTEMMED, Analyzer
from lexshard.functions.porter import stem_word
from lexshard.functions.text import tokens
from lexshard.operators import boolean, metrics, phrase, rank
from lexshard.operators.index import Index, build_index, build_meta, build_saved, corpus_stats, open_index
from lexshard.plans.porter_sql import porter_sql
from lexshard.plans.sql import quoted, words_sql
from lexshard.session import shared_path, table
from lexshard.sources import corpus

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _index(spark: SparkSession, data_dir: str, analyzer: Analyzer = UNSTEMMED, keep: bool = False) -> Index:
    return build_index(corpus.documents(spark, data_dir), analyzer, keep)


def _kept(spark: SparkSession, data_dir: str, analyzer: Analyzer = UNSTEMMED) -> Index:
    """For several jobs over one index."""
    return _index(spark, data_dir, analyzer, True)


def query(sql: str | None = None):
    """Registers a function of (spark, data_dir) under its name."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# ---- SQL of the index

_DOCS = """docs AS (SELECT doc_id, coalesce(title, '') AS title, coalesce(url, '') AS url, text AS body FROM documents
    WHERE doc_id IS NOT NULL AND regexp_matches(text, '[^\\t-\\r\\x{85}\\p{Z}]'))"""
_STOP = "(" + ", ".join(map(quoted, STOPWORDS)) + ")"


def _toks(fold: bool = True, stop: bool = True) -> str:
    return f"""{_DOCS}, split AS (SELECT doc_id, {words_sql('body', fold)} AS ws FROM docs),
    alltoks AS (SELECT doc_id, unnest(ws) AS tok, generate_subscripts(ws, 1) - 1 AS pos FROM split),
    toks AS (SELECT * FROM alltoks {f'WHERE tok NOT IN {_STOP}' if stop else ''})"""


_INDEX = """post AS (SELECT tok AS term, doc_id, count(*)::INTEGER AS tf, list(pos::BIGINT ORDER BY pos) AS positions FROM toks GROUP BY ALL),
    dict AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY term),
    stats AS (SELECT docs.doc_id, title, url, count(tok)::INTEGER AS length FROM docs LEFT JOIN toks ON toks.doc_id = docs.doc_id GROUP BY ALL),
    corpus AS (SELECT count(*) AS n_docs, coalesce(sum(length), 0)::BIGINT AS total_length, coalesce(avg(length), 0) AS avgdl FROM stats)"""
_PLAIN = f"WITH {_toks()}, {_INDEX}"
_STEMMED = f"""WITH {_DOCS}, split AS (SELECT doc_id, {words_sql('body')} AS ws FROM docs),
    alltoks AS (SELECT doc_id, unnest(ws) AS tok0, generate_subscripts(ws, 1) - 1 AS pos FROM split),
    words AS (SELECT DISTINCT tok0 AS tok FROM alltoks WHERE tok0 NOT IN {_STOP}), {porter_sql('words')},
    toks AS (SELECT doc_id, term AS tok, pos FROM alltoks JOIN vocab ON tok0 = vocab.tok), {_INDEX}"""


# ---- analysis


@query(f"WITH {_toks(fold=False, stop=False)} SELECT doc_id, tok AS term, pos::INTEGER AS pos FROM toks")
def tokenize_positions(spark: SparkSession, data_dir: str) -> DataFrame:
    """Raw words with positions: lower case, no folding, no stop words, no stems."""
    return corpus.documents(spark, data_dir).where(F.col("body").rlike("(?U)\\S")).select("doc_id", F.explode(RAW.occurrences(F.col("body"))).alias("o")).select("doc_id", "o.term", "o.pos")


@query(f"WITH {_toks(stop=False)} SELECT tok AS term, count(*) AS n FROM toks GROUP BY tok")
def fold_accents_tokens(spark: SparkSession, data_dir: str) -> DataFrame:
    return corpus.documents(spark, data_dir).where(F.col("body").rlike("(?U)\\S")).select(F.explode(tokens(F.col("body"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_toks()} SELECT doc_id, tok AS term, pos::INTEGER AS pos FROM toks")
def stopword_filter(spark: SparkSession, data_dir: str) -> DataFrame:
    """Stop words leave gaps in the positions."""
    return corpus.documents(spark, data_dir).where(F.col("body").rlike("(?U)\\S")).select("doc_id", F.explode(UNSTEMMED.occurrences(F.col("body"))).alias("o")).select("doc_id", "o.term", "o.pos")


@query(f"WITH {_toks(stop=False)}, words AS (SELECT DISTINCT tok FROM toks), {porter_sql('words')} SELECT tok AS word, term AS stem FROM vocab")
def porter_vocab(spark: SparkSession, data_dir: str) -> DataFrame:
    words = fold_accents_tokens(spark, data_dir).select(F.col("term").alias("word"))
    return words.withColumn("stem", stem_word("word"))


@query("SELECT doc_id, coalesce(array_to_string(list_transform(string_split(replace(coalesce(title, ''), '_', ' '), ' '), lambda w: upper(left(w, 1)) || lower(w[2:])), ' '), '') AS title FROM documents WHERE doc_id IS NOT NULL")
def title_format(spark: SparkSession, data_dir: str) -> DataFrame:
    return corpus.documents(spark, data_dir).select("doc_id", F.initcap(F.replace(F.coalesce("title", F.lit("")), F.lit("_"), F.lit(" "))).alias("title"))


# ---- index


def _joined(positions) -> "F.Column":
    return F.array_join(positions.cast("array<string>"), " ")


@query(f"{_PLAIN} SELECT term, doc_id, tf, array_to_string(positions, ' ') AS positions FROM post")
def postings_build(spark: SparkSession, data_dir: str) -> DataFrame:
    return _index(spark, data_dir).postings.drop("length").withColumn("positions", _joined(F.col("positions")))


@query(f"{_STEMMED} SELECT term, doc_id, tf, array_to_string(positions, ' ') AS positions FROM post")
def postings_build_stemmed(spark: SparkSession, data_dir: str) -> DataFrame:
    return _index(spark, data_dir, DEFAULT).postings.drop("length").withColumn("positions", _joined(F.col("positions")))


@query(f"{_PLAIN} SELECT term, df, cf FROM dict")
def dictionary_df_cf(spark: SparkSession, data_dir: str) -> DataFrame:
    return _index(spark, data_dir).dictionary


@query(f"{_PLAIN} SELECT doc_id, title, url, length FROM stats")
def doc_lengths(spark: SparkSession, data_dir: str) -> DataFrame:
    return _index(spark, data_dir).docstats


@query(f"{_PLAIN} SELECT n_docs, total_length, round(avgdl, 6) AS avgdl FROM corpus")
def corpus_statistics(spark: SparkSession, data_dir: str) -> DataFrame:
    return corpus_stats(_index(spark, data_dir).docstats).withColumn("avgdl", F.round("avgdl", 6))


@query(f"{_PLAIN} SELECT count(*) AS n_terms FROM dict")
def vocab_size(spark: SparkSession, data_dir: str) -> DataFrame:
    return _index(spark, data_dir).dictionary.agg(F.count(F.lit(1)).alias("n_terms"))


@query(f"{_PLAIN} SELECT doc_id, tf, array_to_string(positions, ' ') AS positions FROM post WHERE term = 'harbour'")
def term_lookup(spark: SparkSession, data_dir: str) -> DataFrame:
    return _index(spark, data_dir).get("harbour").select("doc_id", "tf", _joined(F.col("positions")).alias("positions"))


@query(f"{_PLAIN} SELECT doc_id FROM docs")
def all_doc_ids(spark: SparkSession, data_dir: str) -> DataFrame:
    return _index(spark, data_dir).all_doc_ids()


# ---- boolean


def _has(term: str) -> str:
    return f"doc_id IN (SELECT doc_id FROM post WHERE term = '{term}')"


def _boolean(name: str, text: str, condition: str, analyzer: Analyzer = UNSTEMMED, prefix: str = _PLAIN) -> None:
    QUERIES[name] = lambda spark, data_dir: boolean.boolean_search(_index(spark, data_dir, analyzer), text)
    SQL[name] = f"{prefix} SELECT doc_id FROM docs WHERE {condition}"


_boolean("bool_and", "wooden AND village", f"{_has('wooden')} AND {_has('village')}")
_boolean("bool_or", "harbour OR chime", f"{_has('harbour')} OR {_has('chime')}")
_boolean("bool_not_infix", "wooden NOT village", f"{_has('wooden')} AND NOT {_has('village')}")
_boolean("bool_not_unary", "NOT wooden", f"NOT {_has('wooden')}")
_boolean("bool_not_not", "wooden NOT NOT village", f"{_has('wooden')} AND {_has('village')}")
_boolean("bool_nested_precedence", "wooden AND (harbour OR village) NOT summer OR chime", f"({_has('wooden')} AND ({_has('harbour')} OR {_has('village')}) AND NOT {_has('summer')}) OR {_has('chime')}")
_boolean("bool_trailing_ignored", "wooden village", _has("wooden"))
_boolean("bool_unclosed", "(wooden AND village", f"{_has('wooden')} AND {_has('village')}")
_boolean("bool_multi_term_atom", "wooden-village AND harbour", f"{_has('wooden')} AND {_has('harbour')}")
_boolean("bool_stopword_atom", "NOT the", "true")
_boolean("bool_stemmed", "bridges AND painted", f"{_has('bridg')} AND {_has('paint')}", DEFAULT, _STEMMED)


@query(f"{_PLAIN} SELECT doc_id FROM docs WHERE ({_has('wooden')} OR {_has('harbour')}) AND {_has('village')} AND NOT {_has('summer')}")
def bool_by_operators(spark: SparkSession, data_dir: str) -> DataFrame:
    """Set by set with joins: union, intersection, difference, complement."""
    index = _index(spark, data_dir)
    return boolean.by_operators(index, boolean.parse("(wooden OR harbour) AND village AND NOT summer", index.analyzer.terms))


_BOTH = [(1, "wooden AND village"), (2, "harbour OR chime"), (3, "NOT wooden"), (4, "wooden AND (harbour OR village) NOT summer"), (5, "summer AND village"), (6, "one AND old"), (7, "unknownword AND old"), (8, "la AND esta")]
_BOTH_SQL = [
    f"{_has('wooden')} AND {_has('village')}", f"{_has('harbour')} OR {_has('chime')}", f"NOT {_has('wooden')}", f"{_has('wooden')} AND ({_has('harbour')} OR {_has('village')}) AND NOT {_has('summer')}",
    f"{_has('summer')} AND {_has('village')}", f"{_has('one')} AND {_has('old')}", "false", f"{_has('la')} AND {_has('esta')}",
]


@query(f"{_PLAIN} " + " UNION ALL ".join(f"SELECT {q}::BIGINT AS query_id, doc_id FROM docs WHERE {c}" for (q, _), c in zip(_BOTH, _BOTH_SQL)))
def boolean_batch(spark: SparkSession, data_dir: str) -> DataFrame:
    """Several boolean queries in one job."""
    return boolean.boolean_batch(_index(spark, data_dir), _BOTH)


# ---- phrases


def _phrase_sql(terms: list[str], prefix: str = _PLAIN) -> str:
    if len(terms) == 1:
        return f"{prefix} SELECT DISTINCT doc_id FROM toks WHERE tok = '{terms[0]}'"
    joins = " ".join(f"JOIN toks t{i} ON t{i}.doc_id = t0.doc_id AND t{i}.tok = '{t}' AND t{i}.pos = t0.pos + {i}" for i, t in enumerate(terms) if i)
    return f"{prefix} SELECT DISTINCT t0.doc_id FROM toks t0 {joins} WHERE t0.tok = '{terms[0]}'"


def _phrase(name: str, text: str, terms: list[str], search=phrase.phrase_search, analyzer: Analyzer = UNSTEMMED, prefix: str = _PLAIN) -> None:
    QUERIES[name] = lambda spark, data_dir: search(_index(spark, data_dir, analyzer), text)
    SQL[name] = _phrase_sql(terms, prefix)


_FOLDED_SQL = f"WITH {_toks(stop=False)}, {_INDEX}"
_phrase("phrase_1", "harbour", ["harbour"])
_phrase("phrase_2", "lost near", ["lost", "near"])
_phrase("phrase_3", "dürfen nicht fehlen", ["durfen", "nicht", "fehlen"])
_phrase("phrase_4_raw", "is the name of", ["is", "the", "name", "of"], analyzer=FOLDED, prefix=_FOLDED_SQL)
_phrase("phrase_anchors", "is the name of a", ["is", "the", "name", "of", "a"], phrase.phrase_by_anchors, FOLDED, _FOLDED_SQL)
_phrase("phrase_repeated_term", "called it a cliché and a", ["called", "it", "a", "cliche", "and", "a"], analyzer=FOLDED, prefix=_FOLDED_SQL)
_phrase("phrase_stopword_gap", "lost and the near", ["lost", "near"])
_phrase("phrase_stopword_gap_in_text", "esta na", ["esta", "na"])  # some documents have a stop word between the two
_phrase("phrase_stemmed", "visitor remembering", ["visitor", "rememb"], analyzer=DEFAULT, prefix=_STEMMED)


_PHRASES = [(1, "lost near"), (2, "esta na"), (3, "harbour"), (4, "one late"), (5, "near lost"), (6, "lost and the near"), (7, "la unica"), (8, "unknownword near")]


def _phrases_sql() -> str:
    parts = []
    for q, text in _PHRASES:
        parts.append(f"SELECT {q}::BIGINT AS query_id, doc_id FROM ({_phrase_sql(UNSTEMMED.terms(text), '')})")
    return f"{_PLAIN} " + " UNION ALL ".join(parts)


@query(_phrases_sql())
def phrase_batch(spark: SparkSession, data_dir: str) -> DataFrame:
    """Several phrases in one job."""
    return phrase.phrase_batch(_index(spark, data_dir), _PHRASES)


# ---- ranking

_QUERIES = [(1, "wooden harbour"), (2, "village chime tower"), (3, "escapement balance chime"), (4, "hull anchor landing"), (5, "pollen drone queen"), (6, "parapet pier arch")]
_BM25 = "ln((n_docs - df + 0.5) / (df + 0.5) + 1) * (tf * ({k1} + 1)) / (tf + {k1} * (1 - {b} + {b} * length / CASE WHEN avgdl = 0 THEN 1 ELSE avgdl END))"
_TFIDF = "(1 + ln(tf)) * ln(n_docs / df) / sqrt(greatest(length, 1))"
_TOP = """limits AS (SELECT {by}, min(score) AS t FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, doc_id) AS r FROM scored) WHERE r <= {k} GROUP BY {by}),
    c AS (SELECT s.*, t, row_number() OVER (PARTITION BY {sby} ORDER BY s.doc_id) AS rn FROM scored s JOIN limits l USING ({by}) WHERE score >= t),
    kept AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, doc_id DESC) AS r FROM c WHERE score > t OR rn <= {k}),
    top AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, doc_id)::INTEGER AS rank FROM kept WHERE r <= {k})"""


def _scored_sql(queries, formula: str, prefix: str = _PLAIN, analyzer: Analyzer = UNSTEMMED, extra: str = "") -> str:
    values = ", ".join(f"({q}, '{t}')" for q, text in queries for t in dict.fromkeys(analyzer.terms(text)))
    by = "query_id, doc_id" + (", k1, b" if extra else "")
    return f"""{prefix}, q(query_id, term) AS (VALUES {values}),
    scored AS (SELECT {by}, round(sum({formula}), 9) AS score FROM q JOIN post USING (term) JOIN dict USING (term) JOIN stats USING (doc_id), corpus{extra} GROUP BY ALL)"""


def _top_sql(k: int = 10, by: str = "query_id") -> str:
    return _TOP.format(k=k, by=by, sby=", ".join(f"s.{c.strip()}" for c in by.split(",")))


def _scores(index: Index, queries, ranker=None, variants=()) -> DataFrame:
    """Scores to nine places, so that both engines see the same ties."""
    return rank.scores(index, queries, ranker, variants).withColumn("score", F.round("score", 9))


def _top(index: Index, queries, ranker=None, k: int = 10) -> DataFrame:
    best = rank.top_k(_scores(index, queries, ranker), k)
    return rank.with_titles(index, best, k * len(queries)).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"), "title", "url")


def _top_select(queries, formula: str, k: int = 10, **kw) -> str:
    return f"{_scored_sql(queries, formula, **kw)}, {_top_sql(k)} SELECT query_id::BIGINT AS query_id, rank, doc_id, round(score, 6) AS score, title, url FROM top JOIN stats USING (doc_id)"


_DEFAULT_BM25 = _BM25.format(k1=1.5, b=0.75)


@query(_top_select(_QUERIES[:1], _DEFAULT_BM25))
def bm25_top10(spark: SparkSession, data_dir: str) -> DataFrame:
    return _top(_kept(spark, data_dir), _QUERIES[:1])


@query(_top_select(_QUERIES[1:2], _BM25.format(k1=1.2, b=0.0), 25))
def bm25_params_k1_b(spark: SparkSession, data_dir: str) -> DataFrame:
    """Without length normalisation scores tie often, also at the boundary."""
    return _top(_kept(spark, data_dir), _QUERIES[1:2], rank.BM25(1.2, 0.0), 25)


@query(_top_select(_QUERIES, _BM25.format(k1=1.2, b=0.0), 7))
def bm25_tie_boundary(spark: SparkSession, data_dir: str) -> DataFrame:
    return _top(_kept(spark, data_dir), _QUERIES, rank.BM25(1.2, 0.0), 7)


@query(_top_select(_QUERIES, _DEFAULT_BM25))
def bm25_batch(spark: SparkSession, data_dir: str) -> DataFrame:
    return _top(_kept(spark, data_dir), _QUERIES)


@query(_top_select(_QUERIES, _DEFAULT_BM25, prefix=_STEMMED, analyzer=DEFAULT))
def bm25_stemmed(spark: SparkSession, data_dir: str) -> DataFrame:
    return _top(_kept(spark, data_dir, DEFAULT), _QUERIES)


@query(_top_select(_QUERIES, _TFIDF))
def tfidf_top10(spark: SparkSession, data_dir: str) -> DataFrame:
    return _top(_kept(spark, data_dir), _QUERIES, rank.TfIdf())


@query(_top_select(_QUERIES, _DEFAULT_BM25, 600))
def bm25_top600(spark: SparkSession, data_dir: str) -> DataFrame:
    """More results a query than Spark's own limit of a window is made for."""
    return _top(_kept(spark, data_dir), _QUERIES, k=600)


_TITLES = f"""{_PLAIN}, tw AS (SELECT doc_id AS query_id, {words_sql('title')} AS ws FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL),
    tu AS (SELECT query_id, unnest(ws) AS term FROM tw), q AS (SELECT DISTINCT query_id, term FROM tu WHERE term NOT IN {_STOP}),
    scored AS (SELECT query_id, doc_id, round(sum({_DEFAULT_BM25}), 9) AS score FROM q JOIN post USING (term) JOIN dict USING (term) JOIN stats USING (doc_id), corpus GROUP BY ALL)"""


@query(f"{_TITLES}, {_top_sql()} SELECT query_id, rank, doc_id, round(score, 6) AS score FROM top")
def bm25_by_titles(spark: SparkSession, data_dir: str) -> DataFrame:
    """The best ten for the title of every document whose id is divisible by 20, against all documents."""
    titles = table(spark, data_dir, "documents").where(F.col("doc_id") % 20 == 0).select(F.col("doc_id").alias("query_id"), F.col("title").alias("text"))
    scored = rank.table_scores(_kept(spark, data_dir), titles).withColumn("score", F.round("score", 9))
    return rank.top_k(scored, 10).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query(f"{_scored_sql(_QUERIES, _DEFAULT_BM25)} SELECT query_id::BIGINT AS query_id, doc_id, round(score, 6) AS score FROM scored")
def bm25_all_scores(spark: SparkSession, data_dir: str) -> DataFrame:
    return _scores(_kept(spark, data_dir), _QUERIES).withColumn("score", F.round("score", 6))


@query(f"{_PLAIN} SELECT term, df, round(ln((n_docs - df + 0.5) / (df + 0.5) + 1), 6) AS bm25_idf, round(ln(n_docs / df), 6) AS tfidf_idf FROM dict, corpus")
def idf_table(spark: SparkSession, data_dir: str) -> DataFrame:
    index = _kept(spark, data_dir)
    idf = lambda r: F.round(r.idf(F.col("df"), F.lit(index.n_docs)), 6)
    return index.dictionary.select("term", "df", idf(rank.BM25()).alias("bm25_idf"), idf(rank.TfIdf()).alias("tfidf_idf"))


@query(f"{_PLAIN} SELECT term, round(ln((n_docs - df + 0.5) / (df + 0.5) + 1) * 2.5, 6) AS bm25_max, round(ln(n_docs / df) * 10, 6) AS tfidf_max FROM dict, corpus")
def max_term_score(spark: SparkSession, data_dir: str) -> DataFrame:
    index = _kept(spark, data_dir)
    best = lambda r: F.round(r.max_score(r.idf(F.col("df"), F.lit(index.n_docs))), 6)
    return index.dictionary.select("term", best(rank.BM25()).alias("bm25_max"), best(rank.TfIdf()).alias("tfidf_max"))


@query(f"{_PLAIN} SELECT doc_id, title, url FROM stats WHERE {_has('harbour')}")
def doc_meta_join(spark: SparkSession, data_dir: str) -> DataFrame:
    index = _kept(spark, data_dir)
    return boolean.boolean_search(index, "harbour").join(index.docstats, "doc_id").select("doc_id", "title", "url")


# ---- codes


@query(f"{_PLAIN} SELECT term, doc_id, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS gap FROM post")
def gap_encode(spark: SparkSession, data_dir: str) -> DataFrame:
    return codec.doc_gaps(_index(spark, data_dir).postings.select("term", "doc_id")).select("term", "doc_id", "gap")


@query(f"{_PLAIN} SELECT term, doc_id, doc_id AS decoded FROM post")
def gap_decode(spark: SparkSession, data_dir: str) -> DataFrame:
    return codec.docs_from_gaps(codec.doc_gaps(_index(spark, data_dir).postings.select("term", "doc_id"))).select("term", "doc_id", F.col("decoded").cast("long").alias("decoded"))


_POSITION_GAPS = "list_transform(positions, lambda p, i: p - CASE WHEN i > 1 THEN positions[i - 1] ELSE 0 END)"
_SPLIT7 = "CASE WHEN n < 128 THEN printf('%02x', n + 128) WHEN n < 16384 THEN printf('%02x%02x', n // 128, n % 128 + 128) ELSE printf('%02x%02x%02x', n // 16384, n // 128 % 128, n % 128 + 128) END"


@query(f"{_PLAIN} SELECT term, doc_id, array_to_string({_POSITION_GAPS}, ' ') AS gaps FROM post")
def position_gaps(spark: SparkSession, data_dir: str) -> DataFrame:
    return _index(spark, data_dir).postings.select("term", "doc_id", _joined(codec.gap_encode(F.col("positions"))).alias("gaps"))


@query(f"{_PLAIN} SELECT term, doc_id, array_to_string(list_transform({_POSITION_GAPS}, lambda n: {_SPLIT7}), '') AS code FROM post")
def vbyte_hex(spark: SparkSession, data_dir: str) -> DataFrame:
    """Gaps of positions in variable-byte code."""
    return _index(spark, data_dir).postings.select("term", "doc_id", F.lower(F.hex(codec.vbyte_encode(codec.gap_encode(F.col("positions"))))).alias("code"))


@query(f"{_PLAIN} SELECT term, doc_id, array_to_string(positions, ' ') AS positions FROM post")
def vbyte_roundtrip(spark: SparkSession, data_dir: str) -> DataFrame:
    code = codec.vbyte_encode(codec.gap_encode(F.col("positions")))
    return _index(spark, data_dir).postings.select("term", "doc_id", _joined(codec.gap_decode(codec.vbyte_decode(code))).alias("positions"))


def _hex_sql(number: str) -> str:
    return _SPLIT7.replace("WHEN n <", f"WHEN {number} <").replace(", n ", f", {number} ").replace(", n)", f", {number})")


@query(
    f"""{_PLAIN}, g AS (SELECT *, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS gap FROM post),
    c AS (SELECT term, doc_id, gap, doc_id // {codec.RANGE} AS range, {_hex_sql('gap')} || {_hex_sql('tf')} || {_hex_sql('len(positions)')} || array_to_string(list_transform({_POSITION_GAPS}, lambda n: {_SPLIT7}), '') AS code FROM g)
    SELECT term, range, min(doc_id) - arg_min(gap, doc_id) AS base, count(*) AS n, string_agg(code, '' ORDER BY doc_id) AS code FROM c GROUP BY term, range"""
)
def postings_encoded(spark: SparkSession, data_dir: str) -> DataFrame:
    """The posting lists in bytes."""
    return codec.encoded_postings(_kept(spark, data_dir).postings).withColumn("code", F.lower(F.hex("code")))


@query(f"{_PLAIN} SELECT term, doc_id, tf, array_to_string(positions, ' ') AS positions FROM post")
def postings_decoded(spark: SparkSession, data_dir: str) -> DataFrame:
    """And back."""
    return codec.decoded_postings(codec.encoded_postings(_kept(spark, data_dir).postings)).withColumn("positions", _joined(F.col("positions")))


@query(f"{_PLAIN} SELECT term, doc_id, CASE WHEN tf > 1 THEN positions[2] - positions[1] END AS second, length(array_to_string(list_transform({_POSITION_GAPS}[:least(tf, 2)], lambda n: {_SPLIT7}), ''))::INTEGER // 2 AS next FROM post")
def vbyte_stream(spark: SparkSession, data_dir: str) -> DataFrame:
    """The first two numbers of each code, and where the third would begin."""
    rows = _index(spark, data_dir).postings.withColumn("code", codec.vbyte_encode(codec.gap_encode(F.col("positions"))))
    read = codec.vbyte_decode_stream("code", F.lit(0), F.least("tf", F.lit(2)))
    return rows.select("term", "doc_id", read.alias("r")).select("term", "doc_id", F.get("r.numbers", 1).alias("second"), "r.next")


_BYTES = "CASE WHEN {0} < 128 THEN 1 WHEN {0} < 16384 THEN 2 WHEN {0} < 2097152 THEN 3 WHEN {0} < 268435456 THEN 4 ELSE 5 END"


@query(
    f"""{_PLAIN}, g AS (SELECT *, doc_id - lag(doc_id, 1, 0) OVER (PARTITION BY term ORDER BY doc_id) AS gap FROM post),
    t AS (SELECT term, count(*) AS n, sum({_BYTES.format('gap')} + {_BYTES.format('tf')} + {_BYTES.format('len(positions)')}
        + list_sum(list_transform({_POSITION_GAPS}, lambda n: {_BYTES.format('n')}))) AS s FROM g GROUP BY term)
    SELECT (SELECT n_docs FROM corpus) AS n_docs, count(*) AS n_terms, (SELECT round(avgdl, 6) FROM corpus) AS avgdl, coalesce(sum(s + {_BYTES.format('n')}), 0)::BIGINT AS postings_bytes,
        (SELECT coalesce(sum(12 + 4 * len(positions)), 0)::BIGINT FROM post) AS uncompressed_bytes FROM t"""
)
def build_meta_sizes(spark: SparkSession, data_dir: str) -> DataFrame:
    index = _index(spark, data_dir)
    return build_meta(index).withColumn("avgdl", F.round("avgdl", 6)).withColumn("uncompressed_bytes", codec.uncompressed_bytes(index.postings).scalar())


# ---- quality: the topic queries over the wiki pages, judged by qrels

_WIKI = f"""p AS (SELECT try_cast(id AS BIGINT) AS doc_id, arg_max(struct_pack(t := coalesce(title, ''), u := coalesce(url, ''), b := coalesce(text, '')), fetched_at) AS x FROM wiki GROUP BY ALL),
    docs AS (SELECT doc_id, x.t AS title, x.u AS url, x.b AS body FROM p WHERE doc_id IS NOT NULL AND regexp_matches(x.b, '[^\\t-\\r\\x{{85}}\\p{{Z}}]')),
    split AS (SELECT doc_id, {words_sql('body')} AS ws FROM docs),
    alltoks AS (SELECT doc_id, unnest(ws) AS tok, generate_subscripts(ws, 1) - 1 AS pos FROM split), toks AS (SELECT * FROM alltoks WHERE tok NOT IN {_STOP}), {_INDEX},
    q AS (SELECT DISTINCT query_id, unnest({words_sql('query_text')}) AS term FROM topic_queries), good AS (SELECT DISTINCT query_id, doc_id FROM qrels WHERE query_id IS NOT NULL AND doc_id IS NOT NULL)"""
_MEASURES = """j AS (SELECT top.*, (g.doc_id IS NOT NULL)::INTEGER AS hit FROM top LEFT JOIN good g USING (query_id, doc_id)), n AS (SELECT query_id, count(*) AS relevant FROM good GROUP BY query_id),
    h AS (SELECT *, sum(hit) OVER (PARTITION BY {by} ORDER BY rank) AS hits FROM j),
    m AS (SELECT {by}, sum(hit) / least(10, count(*)) AS p_at_k, sum(CASE WHEN hit = 1 THEN hits / rank ELSE 0 END) AS s, sum(hit / log2(rank + 1)) AS dcg FROM h WHERE rank <= 10 GROUP BY ALL),
    e AS (SELECT m.*, coalesce(relevant, 0) AS relevant FROM m LEFT JOIN n USING (query_id)),
    judged AS (SELECT {by}, round(p_at_k, 6) AS p_at_k, round(CASE WHEN relevant > 0 THEN s / relevant ELSE 0 END, 6) AS ap,
        round(CASE WHEN relevant > 0 THEN dcg / list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg_at_k FROM e)"""


def _wiki_index(spark: SparkSession, data_dir: str) -> Index:
    pages = table(spark, data_dir, "wiki").select(F.expr("try_cast(id AS bigint)").alias("doc_id"), "title", "url", "text", "fetched_at").where(F.col("doc_id").isNotNull())
    last = pages.groupBy("doc_id").agg(F.max_by(F.struct("title", "url", "text"), "fetched_at").alias("x"))
    return build_index(last.select("doc_id", "x.title", "x.url", F.col("x.text").alias("body")), UNSTEMMED, keep=True)


def _topics(spark: SparkSession, data_dir: str) -> list[tuple[int, str]]:
    """The topic queries: a fixed table of a few rows."""
    return [(r.query_id, r.query_text) for r in table(spark, data_dir, "topic_queries").where(F.col("query_id").isNotNull()).collect()]


def _wiki_scored(formula: str, extra: str = "") -> str:
    return f"WITH {_WIKI}, scored AS (SELECT query_id, doc_id{', k1, b' if extra else ''}, round(sum({formula}), 9) AS score FROM q JOIN post USING (term) JOIN dict USING (term) JOIN stats USING (doc_id), corpus{extra} GROUP BY ALL)"


def _quality(spark: SparkSession, data_dir: str, ranker) -> DataFrame:
    best = rank.top_k(_scores(_wiki_index(spark, data_dir), _topics(spark, data_dir), ranker), 10)
    rows = metrics.judged(best, table(spark, data_dir, "qrels"), 10)
    return rows.select("query_id", *(F.round(c, 6).alias(c) for c in ("p_at_k", "ap", "ndcg_at_k")))


@query(f"{_wiki_scored(_DEFAULT_BM25)}, {_top_sql()}, {_MEASURES.format(by='query_id')} SELECT * FROM judged")
def topic_quality_bm25(spark: SparkSession, data_dir: str) -> DataFrame:
    """P@10, AP and nDCG@10 of each topic query."""
    return _quality(spark, data_dir, rank.BM25())


@query(f"{_wiki_scored(_TFIDF)}, {_top_sql()}, {_MEASURES.format(by='query_id')} SELECT * FROM judged")
def topic_quality_tfidf(spark: SparkSession, data_dir: str) -> DataFrame:
    return _quality(spark, data_dir, rank.TfIdf())


@query(
    f"""{_wiki_scored(_DEFAULT_BM25)}, {_top_sql()}, {_MEASURES.format(by='query_id')}, a AS (SELECT DISTINCT query_id FROM topic_queries WHERE query_id IS NOT NULL)
    SELECT round(avg(coalesce(p_at_k, 0)), 5) AS p_at_k, round(avg(coalesce(ap, 0)), 5) AS map, round(avg(coalesce(ndcg_at_k, 0)), 5) AS ndcg_at_k, count(*) AS n_queries FROM a LEFT JOIN judged USING (query_id)"""
)
def quality_means(spark: SparkSession, data_dir: str) -> DataFrame:
    best = rank.top_k(_scores(_wiki_index(spark, data_dir), _topics(spark, data_dir)), 10)
    queries = table(spark, data_dir, "topic_queries").where(F.col("query_id").isNotNull())
    return metrics.evaluate(best, table(spark, data_dir, "qrels"), queries).select(*(F.round(c, 5).alias(c) for c in ("p_at_k", "map", "ndcg_at_k")), "n_queries")


GRID = [(k1, b) for k1 in (1.2, 1.5, 2.0) for b in (0.0, 0.5, 0.75, 1.0)]
_GRID_SQL = ", (VALUES " + ", ".join(f"({k}::DOUBLE, {b}::DOUBLE)" for k, b in GRID) + ") v(k1, b)"


@query(
    f"""{_wiki_scored(_BM25.format(k1='k1', b='v.b'), _GRID_SQL)}, {_top_sql(by='query_id, k1, b')}, {_MEASURES.format(by='query_id, k1, b')}
    SELECT k1, b, round(avg(ndcg_at_k), 5) AS ndcg_at_k FROM judged GROUP BY ALL"""
)
def k1_b_sweep(spark: SparkSession, data_dir: str) -> DataFrame:
    """nDCG@10 for twelve settings of BM25, in one job."""
    best = rank.top_k(_scores(_wiki_index(spark, data_dir), _topics(spark, data_dir), variants=GRID), 10, ("query_id", "k1", "b"))
    rows = metrics.judged(best, table(spark, data_dir, "qrels"), 10, ("query_id", "k1", "b"))
    return rows.groupBy("k1", "b").agg(F.round(F.avg(F.round("ndcg_at_k", 6)), 5).alias("ndcg_at_k"))


@query("""WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS place, count(*) OVER () AS n FROM events WHERE value IS NOT NULL)
    SELECT p::DOUBLE AS p, value FROM s, (VALUES (50), (95), (99)) v(p) WHERE place = least(n - 1, round_even(p / 100 * (n - 1), 0)::BIGINT)""")
def latency_percentile(spark: SparkSession, data_dir: str) -> DataFrame:
    """Nearest-rank percentiles, halves to even."""
    return metrics.nearest_percentiles(table(spark, data_dir, "events"), "value", (50, 95, 99))


# ---- a saved index, opened again


def _saved(spark: SparkSession, data_dir: str, analyzer: Analyzer = UNSTEMMED) -> Index:
    path = shared_path(spark)
    build_saved(corpus.documents(spark, data_dir), path, analyzer)
    return open_index(spark, path)


@query(f"{_PLAIN} SELECT 'post' AS kind, doc_id, tf AS n FROM post WHERE term = 'harbour' UNION ALL SELECT 'df', 0, df::INTEGER FROM dict WHERE term = 'harbour' UNION ALL SELECT 'docs', 0, n_docs::INTEGER FROM corpus")
def saved_index_lookup(spark: SparkSession, data_dir: str) -> DataFrame:
    """Built, saved and opened: a term's postings and df, and the number of documents."""
    index = _saved(spark, data_dir)
    rows = index.get("harbour").select(F.lit("post").alias("kind"), "doc_id", F.col("tf").alias("n"))
    df = index.dictionary.where(F.col("term") == "harbour").select(F.lit("df"), F.lit(0).cast("long"), F.col("df").cast("int"))
    return rows.unionAll(df).unionAll(index.docstats.agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit("docs"), F.lit(0).cast("long"), "n"))


@query(_top_select(_QUERIES, _DEFAULT_BM25, prefix=_STEMMED, analyzer=DEFAULT))
def saved_index_bm25(spark: SparkSession, data_dir: str) -> DataFrame:
    """Searched with the analyzer that the saved index names."""
    return _top(_saved(spark, data_dir, DEFAULT), _QUERIES)


# ---- sources


@query(f"WITH {_DOCS} SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_id, title, url, body FROM docs")
def jsonl_loader(spark: SparkSession, data_dir: str) -> DataFrame:
    """The documents written as JSON lines in order of their ids and loaded again: ids are dense, blank texts are skipped."""
    path = shared_path(spark)
    rows = corpus.documents(spark, data_dir).select("doc_id", "title", "url", F.col("body").alias("text"))
    rows.orderBy("doc_id").drop("doc_id").write.option("ignoreNullFields", "true").json(path)
    return corpus.load_jsonl(spark, path)


@query()
def synthetic_corpus(spark: SparkSession, data_dir: str) -> DataFrame:
    return corpus.synthetic_corpus(spark)


@query()
def synthetic_quality(spark: SparkSession, data_dir: str) -> DataFrame:
    """The topic queries over a synthetic corpus: nDCG@10 needs length normalisation to keep the spam out."""
    docs = corpus.synthetic_corpus(spark)
    index = build_index(docs, UNSTEMMED, keep=True)
    best = rank.top_k(rank.scores(index, corpus.topic_queries(), variants=[(1.5, 0.0), (1.5, 0.75)]), 10, ("query_id", "k1", "b"))
    return metrics.judged(best, corpus.topic_qrels(docs), 10, ("query_id", "k1", "b")).groupBy("k1", "b").agg(F.avg("ndcg_at_k").alias("ndcg_at_k"))
