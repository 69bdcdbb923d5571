"""The positional inverted index as DataFrames: build, statistics, save and open."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshard.functions.analyzer import DEFAULT, STOPWORDS, Analyzer
from lexshard.functions.porter import stems
from lexshard.functions.words import coded, pieces, split_words
from lexshard.session import settled, spread, unsettled

#: Terms whose document frequencies a handle remembers.
REMEMBERED = 200_000
_POSTINGS = "array<struct<term string, tf int, positions array<int>>>"


def analysed(texts: pa.Array, analyzer: Analyzer) -> tuple[pa.ListArray, np.ndarray]:
    """(postings of each text: terms with their positions, lengths). All of a document is in one row, so nothing is shuffled.

    Stop words and stems are found once per different word of a batch; positions are those of the raw words.
    """
    words = split_words(texts, analyzer.do_fold_accents)
    ends, code, names = coded(words)
    n = len(texts)
    of = np.repeat(np.arange(n), np.diff(ends))
    pos = np.arange(len(code)) - ends[of]
    listed = names.to_pylist()
    if analyzer.remove_stopwords:
        kept = ~np.isin(code, [i for i, w in enumerate(listed) if w in _STOP])
        of, pos, code = of[kept], pos[kept], code[kept]
    lengths = np.bincount(of, minlength=n)
    if analyzer.do_stem:
        merged = pa.array(stems(listed), pa.string()).dictionary_encode()
        code, names = merged.indices.to_numpy().astype(np.int64)[code], merged.dictionary
    keys = of * max(len(names), 1) + code
    order = np.argsort(keys, kind="stable")  # positions stay in order
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    row = of[order[starts]]
    bounds = np.append(starts, len(keys)).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(pos[order].astype(np.int32)))
    parts = [names.take(pa.array(code[order[starts]])), pa.array(np.diff(bounds)), lists]
    rows = pa.StructArray.from_arrays(parts, fields=[pa.field("term", pa.string()), pa.field("tf", pa.int32()), pa.field("positions", pa.list_(pa.int32()))])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), rows), lengths


_STOP = frozenset(STOPWORDS)


def analyzed(documents: DataFrame, analyzer: Analyzer = DEFAULT) -> DataFrame:
    """(doc_id, title, url, length, postings) from (doc_id, title, url, body).

    Bodies that are null or blank form no document; null titles and urls become empty.
    """
    rows = documents.where(F.col("body").rlike("(?U)\\S")).select(F.col("doc_id").cast("long"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("url", F.lit("")).alias("url"), "body")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "body"):
                found, lengths = analysed(part.column("body"), analyzer)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(lengths.astype(np.int32)), found], ["doc_id", "title", "url", "length", "postings"])

    return spread(rows).mapInArrow(run, f"doc_id long, title string, url string, length int, postings {_POSTINGS}")


def postings_of(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, positions, length) from analyzed documents; one row per term and document, ids being unique.

    length is the document's: scores need it, and so no join with docstats.
    """
    return docs.select("doc_id", "length", F.explode("postings").alias("p")).select("p.term", "doc_id", "p.tf", "p.positions", "length")


@dataclass
class Index:
    """Handle of an index: postings (term, doc_id, tf, positions, length), dictionary (term, df, cf), docstats (doc_id, title, url, length)."""

    postings: DataFrame
    dictionary: DataFrame
    docstats: DataFrame
    analyzer: Analyzer = DEFAULT
    meta: dict = field(default_factory=dict)
    looked_up: dict[str, int] = field(default_factory=dict, repr=False)

    @cached_property
    def _stats(self) -> tuple[int, int]:
        row = corpus_stats(self.docstats).first()
        return row.n_docs, row.total_length

    @property
    def n_docs(self) -> int:
        return self._stats[0]

    @property
    def avgdl(self) -> float:
        """Over all documents, empty ones included; 0.0 without documents."""
        n, total = self._stats
        return total / n if n else 0.0

    def get(self, term: str) -> DataFrame:
        """The postings of a term; none for an unknown one. The filter reaches the files, which are ordered by term."""
        return self.postings.where(F.col("term") == term)

    def df(self, term: str) -> int:
        return self.dfs([term])[term]

    def dfs(self, terms: list[str]) -> dict[str, int]:
        """The document frequencies of given terms, 0 if unknown. They are remembered, as many as REMEMBERED."""
        new = [t for t in terms if t not in self.looked_up]
        if new:
            if len(self.looked_up) + len(new) > REMEMBERED:
                self.looked_up.clear()
                new = terms
            self.looked_up.update(dict.fromkeys(new, 0))
            self.looked_up.update((r.term, r.df) for r in self.dictionary.where(F.col("term").isin(new)).select("term", "df").collect())
        return {t: self.looked_up[t] for t in terms}

    def vocab_size(self) -> int:
        return self.dictionary.count()

    def all_doc_ids(self) -> DataFrame:
        return self.docstats.select("doc_id")

    def save(self, path: str) -> None:
        """Postings are written in term order, so a term's rows lie in one or few row groups of one or few files."""
        self.postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").option("parquet.bloom.filter.enabled#term", "true").parquet(f"{path}/postings")
        saved = self.postings.sparkSession.read.parquet(f"{path}/postings")
        dictionary_of(saved).write.mode("overwrite").parquet(f"{path}/dictionary")
        self.docstats.write.mode("overwrite").parquet(f"{path}/docstats")
        meta = build_meta(Index(saved, dictionary_of(saved), self.docstats, self.analyzer)).withColumn("analyzer", F.lit(self.analyzer.to_json()))
        meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def dictionary_of(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("cf"))


def corpus_stats(docstats: DataFrame) -> DataFrame:
    return docstats.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("total_length"), F.coalesce(F.avg("length"), F.lit(0.0)).alias("avgdl"))


def _index_of(docs: DataFrame, analyzer: Analyzer) -> Index:
    postings = postings_of(docs)
    return Index(postings, dictionary_of(postings), docs.select("doc_id", "title", "url", "length"), analyzer)


def build_index(documents: DataFrame, analyzer: Analyzer = DEFAULT, keep: bool = False) -> Index:
    """The index of (doc_id, title, url, body), lazily; its parts share nothing but the scan.

    For more than one job over it, keep writes the analyzed documents to the shared folder, so texts are analyzed once.
    """
    docs = analyzed(documents, analyzer)
    return _index_of(settled(docs) if keep else docs, analyzer)


def build_saved(documents: DataFrame, path: str, analyzer: Analyzer = DEFAULT) -> Index:
    """Builds, saves and opens: the texts are analyzed once, and what comes of them is read for postings and docstats."""
    docs = settled(analyzed(documents, analyzer))
    _index_of(docs, analyzer).save(path)
    unsettled(docs)
    return open_index(documents.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> Index:
    """A saved index, with the analyzer it was built with."""
    meta = spark.read.json(f"{path}/meta").first().asDict()
    parts = (spark.read.parquet(f"{path}/{p}") for p in ("postings", "dictionary", "docstats"))
    return Index(*parts, analyzer=Analyzer.from_json(meta["analyzer"]), meta=meta)


def build_meta(index: Index) -> DataFrame:
    """One row: n_docs, n_terms, avgdl, and the bytes that gap and variable-byte coding of the postings would take."""
    from lexshard.functions.codec import encoded_postings_bytes

    stats = corpus_stats(index.docstats)
    size = encoded_postings_bytes(index.postings)
    terms = index.dictionary.agg(F.count(F.lit(1)))
    return stats.select("n_docs", terms.scalar().alias("n_terms"), "avgdl", size.scalar().alias("postings_bytes"))


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Of all files of a folder, at any depth."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
