"""Pieces of DuckDB SQL that say the same as the Columns of lexshard.functions and lexshard.operators."""

from __future__ import annotations

from lexshard.functions.text import fold_tables


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fold_sql(expr: str) -> str:
    source, image, gone, longer = fold_tables()
    out = f"translate({expr}, {quoted(source + gone)}, {quoted(image)})"
    keys, values = (f"string_split({quoted('|'.join(x))}, '|')" for x in (longer, longer.values()))
    many = f"list_aggregate(list_transform(string_split({out}, ''), lambda c: coalesce(map({keys}, {values})[c], c)), 'string_agg', '')"
    return f"CASE WHEN regexp_matches({expr}, '[^\\x00-\\x7F]') THEN CASE WHEN regexp_matches({out}, {quoted('[' + ''.join(longer) + ']')}) THEN {many} ELSE {out} END ELSE {expr} END"


def words_sql(expr: str, fold: bool = True) -> str:
    low = f"lower({expr})"
    return f"coalesce(regexp_extract_all({fold_sql(low) if fold else low}, '[a-z0-9]+'), [])"


def term_sql(expr: str) -> str:
    return f"nullif(regexp_extract({fold_sql(f'lower({expr})')}, '[a-z0-9]+'), '')"


CLEAN_POSTINGS = f"""
    clean AS (SELECT term, doc_id, max(tf) AS tf FROM (
        SELECT {term_sql('term')} AS term, doc_id, coalesce(tf, len(positions), 0)::BIGINT AS tf FROM postings WHERE doc_id IS NOT NULL
    ) WHERE term IS NOT NULL GROUP BY ALL)"""

CLEAN_DICTIONARY = f"""
    listed AS (SELECT term, block_no, max(df) AS df FROM (SELECT {term_sql('term')} AS term, block_no, df FROM dictionary) WHERE term IS NOT NULL GROUP BY ALL)"""

CLEAN_DOCSTATS = """
    pages AS (SELECT doc_id, max(length)::BIGINT AS length FROM docstats WHERE doc_id IS NOT NULL GROUP BY ALL)"""
