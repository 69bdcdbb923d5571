import datetime

import pytest
from pyspark.sql import functions as F

NOW = datetime.datetime(2024, 1, 1)
SCHEMAS = {
    "wiki": "id string, title string, url string, text string, fetched_at timestamp",
    "docstats": "doc_id long, title string, url string, length int",
    "postings": "term string, doc_id long, tf int, positions array<int>, block_no int, flushed_at timestamp",
    "dictionary": "block_no int, term string, df long, byte_offset long, byte_length int",
    "documents": "doc_id long, title string, url string, text string, lang string, source string, n_chars long, fetched_at timestamp, loaded_at timestamp",
    "eval_items": "item_id long, text string, lang string",
}


@pytest.fixture
def tables(spark, tmp_path):
    """Writes the given rows (short ones are filled with nulls) and empty tables for the rest; extra columns clash."""

    def write(**rows):
        for name, schema in SCHEMAS.items():
            width = len(schema.split(", "))
            filled = [tuple(r) + (None,) * (width - len(r)) for r in rows.get(name, [])]
            df = spark.createDataFrame(filled, schema)
            for extra in ("words", "key", "class", "term_", "tf_", "w", "ids_", "marks", "model"):
                if extra not in df.columns:
                    df = df.withColumn(extra, F.lit("clash"))
            df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write
