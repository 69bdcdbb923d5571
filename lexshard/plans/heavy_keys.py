"""Problem 4: totals per page and per term although a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexshard.operators.eager import eager_join, heavy, key_states, rolled_up
from lexshard.operators.postings import clean_dictionary, clean_docstats, clean_postings
from lexshard.plans.sql import CLEAN_DICTIONARY, CLEAN_DOCSTATS, CLEAN_POSTINGS
from lexshard.session import table

#: A key is heavy that holds at least one in so many of the clean postings.
HEAVY_SHARE = 220


def keyed_postings(clean: DataFrame) -> DataFrame:
    """Every clean posting under both of its keys, the term and the page: (key_kind, key_value, tf)."""
    keys = F.array(
        F.struct(F.lit("term").alias("kind"), F.col("term").alias("value")),
        F.struct(F.lit("doc_id").alias("kind"), F.col("doc_id").cast("string").alias("value")),
    )
    return clean.select(F.explode(keys).alias("k"), "tf").select(F.col("k.kind").alias("key_kind"), F.col("k.value").alias("key_value"), "tf")


def key_totals(spark: SparkSession, data_dir: str) -> DataFrame:
    """Per term and per page: postings, their tf, what dictionary and docstats say, and the sums over the join."""
    listed = clean_dictionary(table(spark, data_dir, "dictionary"))
    pages = clean_docstats(table(spark, data_dir, "docstats"))
    known = listed.select(F.lit("term").alias("key_kind"), F.col("term").alias("key_value"), F.col("df").alias("amount")).unionAll(
        pages.select(F.lit("doc_id").alias("key_kind"), F.col("doc_id").cast("string").alias("key_value"), F.col("length").alias("amount"))
    )
    return eager_join(keyed_postings(clean_postings(table(spark, data_dir, "postings"))), known, ["key_kind", "key_value"], {"tf": "tf"}, {"amount": "amount"})


def p4_totals(spark: SparkSession, data_dir: str) -> DataFrame:
    return key_totals(spark, data_dir).select(
        "key_kind", "key_value", F.col("left_rows").alias("postings"), F.col("left_tf").alias("total_tf"),
        F.col("right_rows").alias("listed"), F.col("right_amount").alias("listed_amount"), F.col("joined_rows").cast("long").alias("joined_rows"), F.col("joined_left_tf").cast("long").alias("joined_tf"),
    )


def p4_found(spark: SparkSession, data_dir: str) -> DataFrame:
    """The keys holding at least 1/220 of all clean postings. Every posting is counted once under each kind."""
    states = key_totals(spark, data_dir)
    keyed = keyed_postings(clean_postings(table(spark, data_dir, "postings")))
    # The same states before the join, so that Spark reuses their shuffle; each posting is in two of them.
    whole = key_states(keyed, ["key_kind", "key_value"], {"tf": "tf"}, "left").agg(F.expr("sum(left_rows) div 2"))
    return heavy(states, "left_rows", HEAVY_SHARE, whole).select("key_kind", "key_value")


def p4_block_totals(spark: SparkSession, data_dir: str) -> DataFrame:
    """Per block of the dictionary, the sum of df, and postings and tf of the terms it lists, over the join by term."""
    states = eager_join(
        clean_postings(table(spark, data_dir, "postings")), clean_dictionary(table(spark, data_dir, "dictionary")), ["term"], {"tf": "tf"}, {"df": "df"}, how="right", right_by=["block_no"]
    )
    return rolled_up(states, ["block_no"], ["right_rows", "right_df", "joined_rows", "joined_left_tf"]).select(
        "block_no", F.col("right_rows").alias("terms"), F.col("right_df").alias("sum_df"), F.col("joined_rows").cast("long").alias("postings"), F.col("joined_left_tf").cast("long").alias("sum_tf")
    )


_STATES = f"""
    p AS (SELECT 'term' AS key_kind, term AS key_value, tf FROM clean UNION ALL SELECT 'doc_id', doc_id::VARCHAR, tf FROM clean),
    l AS (SELECT 'term' AS key_kind, term AS key_value, df AS amount FROM listed UNION ALL SELECT 'doc_id', doc_id::VARCHAR, length FROM pages),
    ps AS (SELECT key_kind, key_value, count(*) AS n, sum(tf) AS s FROM p GROUP BY ALL),
    ls AS (SELECT key_kind, key_value, count(*) AS n, sum(amount) AS s FROM l GROUP BY ALL)"""

QUERIES = {"p4_found": p4_found, "p4_totals": p4_totals, "p4_block_totals": p4_block_totals}

SQL = {
    "p4_found": f"""WITH {CLEAN_POSTINGS}, keys AS (SELECT 'term' AS key_kind, term AS key_value, count(*) AS n FROM clean GROUP BY ALL
        UNION ALL SELECT 'doc_id', doc_id::VARCHAR, count(*) FROM clean GROUP BY ALL)
        SELECT key_kind, key_value FROM keys WHERE n * {HEAVY_SHARE} >= (SELECT count(*) FROM clean)""",
    "p4_totals": f"""WITH {CLEAN_POSTINGS}, {CLEAN_DICTIONARY}, {CLEAN_DOCSTATS}, {_STATES}
        SELECT key_kind, key_value, coalesce(ps.n, 0)::BIGINT AS postings, coalesce(ps.s, 0)::BIGINT AS total_tf, coalesce(ls.n, 0)::BIGINT AS listed,
            coalesce(ls.s, 0)::BIGINT AS listed_amount, coalesce(ps.n * ls.n, 0)::BIGINT AS joined_rows, coalesce(ps.s * ls.n, 0)::BIGINT AS joined_tf
        FROM ps FULL JOIN ls USING (key_kind, key_value)""",
    "p4_block_totals": f"""WITH {CLEAN_POSTINGS}, {CLEAN_DICTIONARY}
        SELECT block_no, count(DISTINCT l.term)::BIGINT AS terms, (SELECT coalesce(sum(df), 0) FROM listed x WHERE x.block_no IS NOT DISTINCT FROM l.block_no)::BIGINT AS sum_df,
            count(c.term)::BIGINT AS postings, coalesce(sum(c.tf), 0)::BIGINT AS sum_tf
        FROM listed l LEFT JOIN clean c ON c.term = l.term GROUP BY block_no""",
}
