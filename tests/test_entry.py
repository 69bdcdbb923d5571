import os

import pytest

from tests.oracle import DATA, connection, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
NAMES = ["fold_accents_tokens", "porter_vocab", "postings_build", "bool_nested_precedence", "phrase_repeated_term", "bm25_tie_boundary", "tfidf_top10", "topic_quality_bm25", "k1_b_sweep", "vbyte_hex", "gap_encode", "latency_percentile", "p4_found", "p4_totals"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    from lexshard.plans import registry

    same(spark, connection(), registry.QUERIES[name], registry.SQL[name])


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
