"""Connected components by alternating stars, as joins over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WRITTEN, discard, table


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a, b), a > b: each node's neighbours are tied to the least of them and itself.

    The large star moves greater neighbours, the small star the others; minima are combined before the shuffle.
    """
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    tied = both.join(least, "u")
    if large:  # one edge an edge, so repeats wait for the small star
        return tied.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")
    moved = tied.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.filter("a <> b").distinct()


def settled(edges: DataFrame) -> bool:
    """Whether each node that is tied is tied to one other, which isn't tied itself."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the least node that each node of edges (a, b) can reach; nodes that are roots are left out."""
    spark, mark = edges.sparkSession, len(WRITTEN)
    now = table(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        if settled(now):
            break
        now = table(star(star(now, True), False), "stars")
        discard(spark, mark, WRITTEN[-1])
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
