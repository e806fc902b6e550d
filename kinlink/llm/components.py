"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..storage import materialize, remove


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node reachable.

    ``edges`` has two columns of one orderable type; loops, repeats and both directions are allowed,
    rows with a null are ignored. Each step is two aggregations and two joins over the edges, and the
    number of steps grows with the logarithm of the longest path. Nothing is collected.
    """
    spark = edges.sparkSession
    a, b = edges.columns
    now = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(F.col("u") != F.col("v")).distinct()

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        """The table, and its number of rows and sum of hashes, which are taken while it is written."""
        seen = Observation()
        marks = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        table = materialize(df.observe(seen, *marks), "edges")
        return table, (seen.get["n"], seen.get["h"])

    now, before = written(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every larger neighbour goes to the smallest of the neighbourhood
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter(F.col("u") != F.col("v")).distinct()
        # small star: all smaller neighbours, and the node itself, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
        small = small.select(F.col("e.u").alias("u"), F.col("e.m").alias("v")).filter(F.col("u") != F.col("v")).distinct()
        path = now.inputFiles()[0].rpartition("/")[0] if now.inputFiles() else None
        now, after = written(small)
        if path:
            remove(spark, path)
        if after == before:
            break
        before = after
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
