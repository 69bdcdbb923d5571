"""Problem 1: how often every distinct term occurs, in how many pages, and which are too rare or too common."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshard.operators.postings import clean_dictionary, clean_docstats, clean_postings
from lexshard.plans.sql import CLEAN_DICTIONARY, CLEAN_DOCSTATS, CLEAN_POSTINGS
from lexshard.session import table

#: A term held by at most so many pages is rare; one held by more than 1/COMMON_SHARE of all pages is common.
RARE_PAGES, COMMON_SHARE = 2, 10


def term_frequencies(counts: DataFrame) -> DataFrame:
    """(term, total_tf, pages) from per-record counts (term, doc_id, tf), one row per term and record.

    Summed within each map task before the shuffle, so a term that holds a third of all rows sends one row per
    task. Null terms form no row. Nothing in, nothing out.
    """
    return counts.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("tf").cast("long").alias("total_tf"), F.count(F.lit(1)).alias("pages"))


def marks(pages: Column, all_pages: Column) -> Column:
    """The marks of a term, as an array: in a small collection a term may be rare and common at once."""
    none = F.lit(None).cast("string")
    return F.array_compact(F.array(F.when(pages <= RARE_PAGES, "rare").otherwise(none), F.when(pages * COMMON_SHARE > all_pages, "common").otherwise(none)))


def marked_terms(spark: SparkSession, data_dir: str) -> DataFrame:
    everything = clean_docstats(table(spark, data_dir, "docstats")).agg(F.count(F.lit(1))).scalar()
    return term_frequencies(clean_postings(table(spark, data_dir, "postings"))).withColumn("marks", marks(F.col("pages"), everything))


def p1_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """(term, mark): the terms in at most 2 pages, and those in more than a tenth of the pages of docstats."""
    return marked_terms(spark, data_dir).select("term", F.explode("marks").alias("mark"))


def p1_frequencies(spark: SparkSession, data_dir: str) -> DataFrame:
    """Every distinct term of postings or dictionary, with its total tf, its pages, what dictionary lists, its marks.

    listed_pages sums the listed df over the blocks and is null where dictionary has none; a term that only
    dictionary knows has 0 occurrences and no marks.
    """
    listed = clean_dictionary(table(spark, data_dir, "dictionary")).groupBy("term").agg(F.sum("df").alias("listed_pages"))
    joined = marked_terms(spark, data_dir).join(listed, "term", "full")
    return joined.select("term", F.coalesce("total_tf", F.lit(0)).alias("total_tf"), F.coalesce("pages", F.lit(0)).alias("pages"), "listed_pages", F.array_join(F.coalesce("marks", F.array().cast("array<string>")), ",").alias("marks"))


QUERIES = {"p1_found": p1_found, "p1_frequencies": p1_frequencies}

_COUNTS = f"""{CLEAN_POSTINGS}, {CLEAN_DOCSTATS},
    counts AS (SELECT term, sum(tf)::BIGINT AS total_tf, count(*) AS pages FROM clean GROUP BY term),
    marked AS (SELECT *, pages <= {RARE_PAGES} AS rare, pages * {COMMON_SHARE} > (SELECT count(*) FROM pages) AS common FROM counts)"""

SQL = {
    "p1_found": f"WITH {_COUNTS} SELECT term, 'rare' AS mark FROM marked WHERE rare UNION ALL SELECT term, 'common' FROM marked WHERE common",
    "p1_frequencies": f"""WITH {_COUNTS}, {CLEAN_DICTIONARY}, l AS (SELECT term, sum(df)::BIGINT AS listed_pages FROM listed GROUP BY term)
        SELECT term, coalesce(total_tf, 0)::BIGINT AS total_tf, coalesce(pages, 0)::BIGINT AS pages, listed_pages,
            coalesce(concat_ws(',', CASE WHEN rare THEN 'rare' END, CASE WHEN common THEN 'common' END), '') AS marks
        FROM marked FULL JOIN l USING (term)""",
}
