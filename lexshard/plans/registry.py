"""All registered queries of the core and their SQL."""

from __future__ import annotations

from lexshard.plans import heavy_keys, search

QUERIES = {**search.QUERIES, **heavy_keys.QUERIES}
SQL = {**search.SQL, **heavy_keys.SQL}
