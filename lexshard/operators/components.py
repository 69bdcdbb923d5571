"""Connected components of a graph given as links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexshard.session import settled, single


def _both_ways(links: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    return links.select(F.explode(ends).alias("e")).select("e.u", "e.v")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the smallest node reached.

    Each round lets every node link all its larger neighbours, then all its smaller ones, to the least of them;
    the number of rounds grows with the logarithm of the longest path. A hub's neighbours are never gathered:
    only the least of each neighbourhood is aggregated and joined back. Every round is written to the shared
    folder, which ends its lineage. Null ends and loops are ignored; no links give no rows.
    """
    now = settled(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = _both_ways(now)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        small = large.where(F.col("a") != F.col("b"))
        least = small.groupBy("a").agg(F.min("b").alias("m"))
        joined = small.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        now = settled(joined.where(F.col("a") != F.col("b")).distinct())
        mark = single(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))))
        if mark == before:
            break
        before = mark
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
