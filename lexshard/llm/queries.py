"""All registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from lexshard.llm import bpe, elite, frequency, leakage, mojibake, neardup, repetition

_MODULES = (frequency, elite, neardup, repetition, bpe, leakage, mojibake)
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
SQL = {k: q for m in _MODULES for k, q in m.SQL.items()}
