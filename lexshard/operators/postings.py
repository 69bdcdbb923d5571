"""Cleaning of delivered index tables: postings, dictionary and page metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshard.functions.text import normal_term


def clean_postings(postings: DataFrame) -> DataFrame:
    """(term, doc_id, tf): one row per posting, its term in normal form.

    A posting may come several times, in several spellings: it is counted once. Where tf is null it is the
    number of positions; a posting with neither counts with tf 0. Rows without a term (null, or without any
    word) or without doc_id are dropped. Other columns are ignored. An empty table gives no rows.
    The shuffle is keyed by (term, doc_id), so neither a hot term nor a hot page meets in one task.
    """
    size = F.when(F.col("positions").isNotNull(), F.size("positions"))
    return (
        postings.where(F.col("doc_id").isNotNull() & F.col("term").isNotNull())
        .select(normal_term(F.col("term")).alias("term"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("tf", size, F.lit(0)).cast("long").alias("tf"))
        .where(F.col("term").isNotNull())
        .groupBy("term", "doc_id")
        .agg(F.max("tf").alias("tf"))
    )


def clean_dictionary(dictionary: DataFrame) -> DataFrame:
    """(term, block_no, df): one row per term and block, the largest df delivered (null only if all are).

    Rows without a term are dropped; a null block_no is a block of its own.
    """
    return (
        dictionary.where(F.col("term").isNotNull())
        .select(normal_term(F.col("term")).alias("term"), F.col("block_no").cast("int").alias("block_no"), F.col("df").cast("long").alias("df"))
        .where(F.col("term").isNotNull())
        .groupBy("term", "block_no")
        .agg(F.max("df").alias("df"))
    )


def clean_docstats(docstats: DataFrame) -> DataFrame:
    """(doc_id, length): one row per page, the largest length delivered (null only if all are); no null ids."""
    return (
        docstats.where(F.col("doc_id").isNotNull())
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("length").cast("long").alias("length"))
        .groupBy("doc_id")
        .agg(F.max("length").alias("length"))
    )
