"""Connected components of a link table, all on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.llm.common import forget, keep, scratch
from cohortry.operators.relational import join_heavy


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, root)`` of every node of ``edges(a, b)``; the root is the smallest node reachable.

    Alternates the two star operations of Kiveris et al. (2014) until no edge changes, each
    round a table in the shared folder. A node's neighbours are only ever reduced to their
    minimum, before the shuffle already, and the edges of a node with very many neighbours are
    spread over tasks.
    Null ends and loops are ignored.
    """
    spark = edges.sparkSession
    at = scratch(spark, name)
    links = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = keep(links, f"{at}/0")

    def with_least(pairs: DataFrame, total: int) -> DataFrame:
        low = pairs.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        return join_heavy(pairs, low, "a", "n", "b", total)

    def star_round(pairs: DataFrame) -> DataFrame:
        total = 2 * pairs.count()
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = with_least(both, total).where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b"))
        ends = F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))
        return with_least(large, total).select(F.inline(ends)).where("a != b").distinct()

    def done(pairs: DataFrame) -> bool:
        """Whether every node but the roots has one edge, and that to a root."""
        ends = pairs.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("root"))
        ends = ends.union(pairs.select(F.col("b").alias("node"), F.lit(0), F.lit(1)))
        seen = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("root").alias("root"))
        return seen.where("out > 1 or out + root > 1").isEmpty()

    n = 0
    while not done(links):
        n += 1
        links = keep(star_round(links), f"{at}/{n}")
        forget(spark, f"{at}/{n - 1}")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
