"""Connected components of a large edge list, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import join_groups, stored, tidy


def connected_components(spark: SparkSession, edges: DataFrame, files: int | None = None, most_rounds: int = 60, rows_a_file: int = 500_000) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a``, ``b``, long); the root is the least node.

    Each round links the larger neighbours of every node, then the smaller
    ones, to its least neighbour.  Minima are aggregated before the shuffle;
    where they are joined back, the links of a node with many are dealt over
    several tasks, so the centre of a large star is never gathered in one.
    Self loops and nulls are left out.  Each round's links are written as a
    table, which keeps the plan short, in files of ``rows_a_file`` links;
    ``files`` is the number for the first table.
    """
    links = stored(spark, edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", files)
    n, before = links.count(), None
    for _ in range(most_rounds):
        tidy(spark)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_groups(both, least, "u", "n", ["v"], 2 * n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_groups(large, low, "u", "n", ["v"], 2 * n).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        files = max(1, -(-n // rows_a_file))
        links = stored(spark, small.filter("u != v").distinct(), "edges", files)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            break
        n, before = now[0], now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
