"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, table

WEIGHTS = (5, 2, 1)
CAP = 3
#: A document's hash has LEVELS times BITS bits; each level's histogram has 2 ** BITS buckets a source at most.
LEVELS, BITS = 4, 12


def targets(sizes: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source_key, source, source_size) with weight and target; one row a source, so small beside the documents.

    Sources in code point order, null last, take the weights in turn. Targets share the total by weight; a target over
    ``cap`` times its source's size stops there and the excess is shared again: the fixed point has one level
    ``x`` with target = min(x * weight, cap * size), found from running sums in order of cap * size / weight.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("weight", w.cast("bigint"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    run = ranked.select("*", F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("s0"), F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("w0"), F.sum("source_size").over(whole).alias("s1"), F.sum("weight").over(whole).alias("w1"))
    run = run.withColumn("x", (F.col("s1") - cap * F.col("s0")).cast("double") / (F.col("w1") - F.col("w0")).cast("double"))
    # The first source, in that order, that its share doesn't fill to the cap sets the level for it and all after it.
    run = run.withColumn("place", F.row_number().over(order))
    fits = cap * F.col("source_size") >= F.col("x") * F.col("weight")
    run = run.withColumn("level", F.max(F.when(fits, F.struct((-F.col("place")).alias("k"), "x"))).over(whole)["x"])
    target = F.least(F.col("level") * F.col("weight"), (cap * F.col("source_size")).cast("double"))
    return run.select("source_key", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def source_key(source_col: str):
    return F.when(F.col(source_col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))


def size_of(text_col: str):
    return F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")


def place_of(id_col: str):
    """The document's hash."""
    digest = F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, LEVELS * BITS // 4), 16, 10).cast("bigint")


def thresholds(rows: DataFrame, weights, cap: int) -> DataFrame:
    """By source of (source_key, size, h): source_size, target, times each document is taken whole, and the bucket ``at``
    below which it is taken once more, with the size ``base`` of those below and ``own`` of the bucket."""
    sizes = rows.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    sizes = sizes.withColumn("source", F.when(F.col("source_key") != "n", F.expr("substring(source_key, 2)")))
    goal = targets(sizes, weights, cap)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    edge = table(goal.withColumn("whole", whole).withColumn("budget", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))), "mix-goal")
    # base: size under the boundary bucket; at: the bucket's prefix.
    edge = edge.withColumns({"base": F.lit(0).cast("bigint"), "at": F.lit(0).cast("bigint"), "own": F.col("source_size")})
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = rows.join(edge.select("source_key", "at"), "source_key").filter(F.shiftright("h", shift + BITS) == F.col("at"))
        bucket = inside.groupBy("source_key", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("own"))
        upto = Window.partitionBy("source_key").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        run = bucket.withColumn("le", F.sum("own").over(upto)).join(edge.select("source_key", "base", "budget"), "source_key")
        over = run.filter(F.col("base") + F.col("le") > F.col("budget")).groupBy("source_key").agg(F.min(F.struct("b", "le", "own")).alias("m"))
        edge = table(edge.drop("own").join(over, "source_key", "left").select("source_key", "source_size", "target", "whole", "budget", (F.col("base") + F.coalesce(F.col("m.le") - F.col("m.own"), F.lit(0))).alias("base"), F.coalesce(F.col("m.b"), F.shiftleft("at", BITS)).alias("at"), F.coalesce(F.col("m.own"), F.lit(0)).alias("own")), f"mix-edge{level}")
    return edge


def times(h, edge):
    """How often a document with hash ``h`` is taken, by the column ``edge`` of its source's thresholds."""
    near = 2 * edge["base"] + edge["own"] <= 2 * edge["budget"]
    return edge["whole"] + ((h < edge["at"]) | ((h == edge["at"]) & near)).cast("bigint")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken.

    A document is taken floor(target / source_size) times whole, and once more if its hash lies under its source's
    threshold. Thresholds come from histograms of size by hash bucket: the bucket that crosses the remaining budget is
    the only one refined, until single hashes; the one at the boundary is taken if that ends nearer the target.
    Nothing is sorted. Rows of a source with one identifier share a hash, and so a fate.

    Null text has size 0; null source is a source of its own, the last; empty tables and sources of size 0 take nothing.
    """
    rows = table(docs.select(F.col(id_col).alias("doc_id"), source_key(source_col).alias("source_key"), size_of(text_col).alias("size"), place_of(id_col).alias("h")), "mix-rows")
    edge = thresholds(rows, weights, cap)
    edge = edge.select("source_key", "source_size", "target", F.struct(*edge.columns).alias("edge"))
    return rows.join(edge, "source_key").select("doc_id", "size", "source_size", "target", (F.col("size") * times(F.col("h"), F.col("edge"))).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of ``docs`` that the mix takes, all columns kept, each repeated as often as it is taken.

    Each row goes by its own source and size, whatever rows share its identifier; null ones are one identifier. A
    document without words can't count towards a target; it stays once. An empty table stays empty.
    """
    rows = table(docs.select(source_key(source_col).alias("source_key"), size_of(text_col).alias("size"), place_of(id_col).alias("h")), "mix-rows")
    edge = thresholds(rows, weights, cap)
    edge = edge.select(F.col("source_key").alias("__key"), F.struct(*edge.columns).alias("__edge"))
    copies = F.when(size_of(text_col) > 0, times(place_of(id_col), F.col("__edge"))).otherwise(F.lit(1)).cast("int")
    every = docs.join(edge, source_key(source_col) == F.col("__key"))
    return every.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)
