"""Aggregates of scored rows. Each is a sum over rows, so that it is combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean(x: Column) -> Column:
    """Average as a double, 0 over nothing."""
    return F.coalesce(F.avg(x.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, gold: str, pred: str, keys: tuple = ()) -> DataFrame:
    """(keys, label, gold_n, pred_n, tp) over labels seen on either side.

    Label pairs are counted first, so only as many rows as there are pairs of labels are turned into two each.
    """
    pairs = df.groupBy(*keys, F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = F.explode(F.array(F.struct(F.col("g").alias("label"), F.col("n").alias("gold_n"), F.lit(0).cast("bigint").alias("pred_n"), F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("p").alias("label"), F.lit(0).cast("bigint").alias("gold_n"), F.col("n").alias("pred_n"), F.lit(0).cast("bigint").alias("tp"))))
    return pairs.select(*keys, sides.alias("s")).select(*keys, "s.*").groupBy(*keys, "label").agg(F.sum("gold_n").alias("gold_n"), F.sum("pred_n").alias("pred_n"), F.sum("tp").alias("tp"))


def f1_macro(df: DataFrame, gold: str, pred: str, keys: tuple = ()) -> DataFrame:
    """Mean F1 over the labels seen in gold or predicted values."""
    return confusion(df, gold, pred, keys).groupBy(*keys).agg(F.avg(2.0 * F.col("tp") / (F.col("gold_n") + F.col("pred_n"))).alias("f1_macro"))


def mcc(df: DataFrame, gold: str, pred: str, keys: tuple = ()) -> DataFrame:
    """Matthews correlation for any number of labels; 0 if one side has a single label."""
    d = lambda c: F.col(c).cast("double")
    sums = confusion(df, gold, pred, keys).groupBy(*keys).agg(F.sum(d("tp")).alias("c"), F.sum(d("gold_n")).alias("s"), F.sum(d("pred_n") * d("gold_n")).alias("pt"), F.sum(d("pred_n") * d("pred_n")).alias("pp"), F.sum(d("gold_n") * d("gold_n")).alias("tt"))
    bottom = F.sqrt((F.col("s") * F.col("s") - F.col("pp")) * (F.col("s") * F.col("s") - F.col("tt")))
    return sums.select(*keys, F.when(bottom == 0, 0.0).otherwise((F.col("c") * F.col("s") - F.col("pt")) / F.when(bottom != 0, bottom)).alias("mcc"))


def paired_accuracy(df: DataFrame, val: str, pair: str, keys: tuple = ()) -> DataFrame:
    """Share of pairs of which all rows are right."""
    return df.groupBy(*keys, pair).agg(F.min(F.col(val).cast("int")).alias("v")).groupBy(*keys).agg(F.avg("v").alias("acc"))


def mean_of_means(df: DataFrame, val: str, subject: str, category: str) -> DataFrame:
    """Mean over categories of the mean over subjects of the mean over rows."""
    by_subject = df.groupBy(category, subject).agg(F.avg(val).alias("v"))
    return by_subject.groupBy(category).agg(F.avg("v").alias("v")).agg(F.avg("v").alias("acc"))


def bucket_mean(df: DataFrame, val: str, bucket: str, digits: int = 3) -> DataFrame:
    """(bucket, size, mean), where a bucket like 4k has its size as a number."""
    return df.groupBy(bucket).agg(F.round(F.avg(val), digits).alias("mean")).withColumn("size", F.regexp_extract(bucket, r"(\d+)", 1).cast("int"))


def variant_sum(df: DataFrame, score: str, variant: str, most: int = 34) -> DataFrame:
    """Mean over variants of their points over the most that one can have."""
    return df.groupBy(variant).agg(F.sum(score).alias("s")).agg(F.avg(F.col("s") / most).alias("grade_norm"))


def multiset_counts(gold: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tp, fn, fp) of two frames of rows as multisets over ``keys``: one shuffle of both, combined before it."""
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    return counted(gold.select(*keys, one.alias("g"), none.alias("p")).unionByName(pred.select(*keys, none.alias("g"), one.alias("p"))), keys)


def counted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, tp, fn, fp) of rows that each add ``g`` and ``p`` to a key's gold and predicted counts."""
    both = rows.groupBy(*keys).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    return both.select(*keys, F.least("g", "p").alias("tp"), F.greatest(F.col("g") - F.col("p"), F.lit(0)).alias("fn"), F.greatest(F.col("p") - F.col("g"), F.lit(0)).alias("fp"))


def multiset(a: DataFrame, b: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Union (greatest count), intersection, difference or sum of two multisets of rows, as (keys, n)."""
    x = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("x"))
    y = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("y"))
    p, q = F.coalesce("x", F.lit(0)), F.coalesce("y", F.lit(0))
    n = {"union": F.greatest(p, q), "intersect": F.least(p, q), "subtract": F.greatest(p - q, F.lit(0)), "add": p + q}[how]
    return x.join(y, keys, "full").select(*keys, n.alias("n")).filter("n > 0")


def tag_f1(counts: DataFrame, tags: list[str], tag: str = "tag") -> DataFrame:
    """(tag, f1) over a fixed list of tags; a tag that never occurs has 0."""
    sums = counts.groupBy(tag).agg(*[F.sum(c).alias(c) for c in ("tp", "fn", "fp")])
    all_tags = counts.sparkSession.createDataFrame([(t,) for t in tags], f"{tag} string")
    f1 = F.try_divide(2.0 * F.col("tp"), 2.0 * F.col("tp") + F.col("fn") + F.col("fp"))
    return all_tags.join(sums, tag, "left").select(tag, F.coalesce(f1, F.lit(0.0)).alias("f1"))


def r_precision(df: DataFrame, group: str, label: str, score: str, order: str) -> DataFrame:
    """Mean over groups of the share of relevant rows among the R best, R being how many are relevant.

    Groups without any relevant row have no value.
    """
    from pyspark.sql.window import Window

    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col(score).desc(), order))).withColumn("r", F.sum(label).over(Window.partitionBy(group)))
    each = ranked.groupBy(group).agg(F.sum(F.when(F.col("rank") <= F.col("r"), F.col(label)).otherwise(0)).alias("hits"), F.max("r").alias("r"))
    return each.agg(F.avg(F.try_divide(F.col("hits"), F.col("r"))).alias("r_precision"))


def common_scores(df: DataFrame, group: str, scores: str) -> DataFrame:
    """Score arrays cut to the least length in their group, and averaged."""
    from pyspark.sql.window import Window

    n = F.min(F.size(scores)).over(Window.partitionBy(group))
    return df.withColumn("n", n).withColumn("score", F.aggregate(F.slice(F.col(scores), F.lit(1), F.col("n")), F.lit(0.0), lambda a, x: a + x) / F.col("n")).drop("n")


def instruction_accuracy(df: DataFrame, followed: str = "followed") -> DataFrame:
    """Accuracy over all instructions, by category and by instruction, in one pass."""
    return df.groupingSets([[], [F.col("category")], [F.col("category"), F.col("instruction_id")]], "category", "instruction_id").agg(mean(F.col(followed)).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def prompt_accuracy(df: DataFrame, sample: str, followed: str = "followed") -> DataFrame:
    """Share of samples that follow all their instructions."""
    return df.groupBy(sample).agg(F.min(F.col(followed).cast("int")).alias("v")).agg(mean(F.col("v")).alias("prompt_level"))


def opinion_prf(sums: DataFrame, eps: float = 1e-16) -> DataFrame:
    """Weighted precision, recall and F1 from sums (wp, np, wr, nr)."""
    p, r = F.col("wp") / (F.col("np") + eps), F.col("wr") / (F.col("nr") + eps)
    return sums.select(p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r + eps)).alias("f1"))


def violations(a: DataFrame, b: DataFrame, key: str, field: str) -> DataFrame:
    """How many keys one side lacks, and for how many the field differs."""
    x, y = a.select(key, F.col(field).alias("x"), F.lit(1).alias("in_a")), b.select(key, F.col(field).alias("y"), F.lit(1).alias("in_b"))
    n = lambda c: F.count(F.when(c, 1))
    return x.join(y, key, "full").agg(n(F.col("in_b").isNull()).alias("missing_b"), n(F.col("in_a").isNull()).alias("missing_a"), n(F.col("in_a").isNotNull() & F.col("in_b").isNotNull() & ~F.col("x").eqNullSafe(F.col("y"))).alias("differ"))
