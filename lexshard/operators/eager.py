"""Per-key results over joins whose keys are badly skewed, by eager aggregation.

Joining two tables row by row on a key that holds a third of both makes that key's product meet in one task.
Sums and counts over the join don't need the product: with n, s of the left rows of a key and m, t of its right
rows, the join has n*m rows, sums s*m over a left column and n*t over a right one. So both sides are reduced to
one compact state per key (partially on the map side: a hot key sends one row per map task), the states are
joined one to one, and the sums are put together by multiplication and then rolled up.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_states(rows: DataFrame, keys: Sequence[str], sums: Mapping[str, Column | str], prefix: str) -> DataFrame:
    """One state per key: ``{prefix}_rows`` and ``{prefix}_{name}`` for each sum. Sums skip nulls; none left is 0."""
    cols = {n: (F.col(c) if isinstance(c, str) else c) for n, c in sums.items()}
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias(f"{prefix}_rows"),
        *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"{prefix}_{n}") for n, c in cols.items()),
    )


def eager_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_sums: Mapping[str, Column | str], right_sums: Mapping[str, Column | str], how: str = "full",
    left_by: Sequence[str] = (), right_by: Sequence[str] = (),
) -> DataFrame:
    """States of both sides per key (and further grouping columns of a side), and the sums over their join.

    Columns: on, left_by, right_by, left_rows, left_<sum>..., right_rows, right_<sum>..., joined_rows,
    joined_left_<sum>, joined_right_<sum>. Keys of one side only have 0 rows on the other (how = full, left or
    right) or are left out (inner). Null keys equal nothing: they stay as unmatched states, as in SQL. The columns
    named in left_sums and right_sums may carry the same names on both sides. Products are decimal(38, 0): those of two
    longs may be beyond a long.
    """
    a = key_states(left, [*on, *left_by], left_sums, "left")
    b = key_states(right, [*on, *right_by], right_sums, "right")
    out = a.join(b, list(on), how)
    counts = [c for c in out.columns if c.startswith(("left_", "right_")) and c not in {*left_by, *right_by}]
    out = out.select(*on, *left_by, *right_by, *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    product = lambda a, b: (wide(a) * wide(b)).cast("decimal(38,0)")
    return out.select(
        "*",
        product("left_rows", "right_rows").alias("joined_rows"),
        *(product(f"left_{n}", "right_rows").alias(f"joined_left_{n}") for n in left_sums),
        *(product(f"right_{n}", "left_rows").alias(f"joined_right_{n}") for n in right_sums),
    )


def rolled_up(states: DataFrame, by: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """The states summed up to coarser keys; longs stay longs, products decimals."""
    kinds = dict(states.dtypes)
    return states.groupBy(*by).agg(*(F.sum(c).cast(kinds[c]).alias(c) for c in sums))


def heavy(states: DataFrame, rows: str, share: int, total: DataFrame | None = None) -> DataFrame:
    """The keys that hold at least 1/share of all rows; total: one row, one column, else the sum over all states.

    Compared in whole numbers. No rows at all: no heavy keys.
    """
    whole = (total if total is not None else states.agg(F.sum(rows))).scalar()
    return states.where((F.col(rows) > 0) & (F.col(rows).cast("decimal(19,0)") * share >= whole))
