"""An index that grows from a stream of JSON lines: each micro-batch adds postings of documents of its own ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexshard.functions.analyzer import DEFAULT, Analyzer
from lexshard.operators.index import Index, analyzed, dictionary_of, postings_of

_JSON = "doc_id long, title string, url string, text string"


def read_lines(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """A streaming (doc_id, title, url, body) from a folder; lines without an id or text are skipped."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return lines.select(F.from_json("value", _JSON).alias("j")).select("j.doc_id", "j.title", "j.url", F.col("j.text").alias("body")).where(F.col("doc_id").isNotNull() & F.col("body").isNotNull())


def ingest(documents: DataFrame, path: str, checkpoint: str, analyzer: Analyzer = DEFAULT, available_now: bool = True) -> StreamingQuery:
    """Appends the postings and docstats of every micro-batch under path, each batch in a folder of its own.

    A batch that is run again after a failure overwrites its folder, so nothing is counted twice. Batches must bring
    new ids, as a document's postings are never changed.
    """

    def add(batch: DataFrame, number: int) -> None:
        docs = analyzed(batch, analyzer).persist()
        try:
            postings_of(docs).sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
            docs.select("doc_id", "title", "url", "length").write.mode("overwrite").parquet(f"{path}/docstats/batch={number}")
        finally:
            docs.unpersist()

    writer = documents.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def open_stream_index(spark: SparkSession, path: str, analyzer: Analyzer = DEFAULT) -> Index:
    """What has been ingested so far; the dictionary is counted from the postings."""
    postings = spark.read.parquet(f"{path}/postings").drop("batch")
    return Index(postings, dictionary_of(postings), spark.read.parquet(f"{path}/docstats").drop("batch"), analyzer)
