"""Connected components of an edge table, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from siftline.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges (a, b)``: ``root`` is the smallest node that can be reached.

    Large-star and small-star rounds: every node sends its larger, then its smaller neighbours to the smallest one, until
    nothing changes. Minima are combined before the shuffle and joined back, so that no node's neighbours are gathered in
    one place, and each round is written to the shared folder. Count and sum of a round come with its write, and the joins
    ask for no broadcast, because every job and every broadcast table takes memory of the driver.
    """
    pairs, now = _written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    # Stars all of whose centres are smallest stay as they are; the sums tell a change.
    while now != before:
        before = now
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lower.hint("merge"), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        pairs, now = _written(moved.select("e.u", "e.v").filter("u <> v").distinct())
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _written(pairs: DataFrame) -> tuple[DataFrame, dict[str, object]]:
    """``pairs (u, v)`` as a table, and the count and sum that were taken while it was written."""
    seen = Observation()
    table = cut(pairs.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
    return table, seen.get
