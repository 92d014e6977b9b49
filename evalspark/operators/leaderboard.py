"""Leaderboards: task scores, means with propagated deviations, categories, and tables for reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def task_scores(metrics: DataFrame, main: DataFrame | None = None) -> DataFrame:
    """(model, task, score): the mean of a task's metrics, or the one that ``main`` (task, metric) names."""
    if main is None:
        return metrics.groupBy("model", "task").agg(F.avg("value").alias("score"))
    named = metrics.join(F.broadcast(main.withColumnRenamed("metric", "main")), "task", "left").filter(F.col("main").isNull() | (F.col("main") == F.col("metric")))
    return named.groupBy("model", "task").agg(F.avg("value").alias("score"))


def spread(std: str) -> Column:
    """Deviation of a mean of independent scores."""
    return F.sqrt(F.sum(F.col(std) * F.col(std))) / F.count(F.lit(1))


def mean_over_tasks(scores: DataFrame) -> DataFrame:
    """(model, mean, std, n) over tasks, with the tasks' deviations propagated."""
    return scores.groupBy("model").agg(F.avg("score").alias("mean"), spread("std").alias("std"), F.count(F.lit(1)).alias("n"))


def by_category(scores: DataFrame, categories: DataFrame) -> DataFrame:
    """(model, category, mean, std); tasks without a category are under Other."""
    named = scores.join(categories, "task", "left").withColumn("category", F.coalesce("category", F.lit("Other")))
    return named.groupBy("model", "category").agg(F.avg("score").alias("mean"), spread("std").alias("std"))


def overall(categories: DataFrame) -> DataFrame:
    return categories.groupBy("model").agg(F.avg("mean").alias("mean"), spread("std").alias("std"))


def shown(mean: Column, std: Column | None = None, digits: int = 3) -> Column:
    """``m ± s``, or a dash for a missing score."""
    one = F.format_string(f"%.{digits}f", mean)
    both = one if std is None else F.when(std.isNull(), one).otherwise(F.concat(one, F.lit(" ± "), F.format_string(f"%.{digits}f", std)))
    return F.when(mean.isNull(), "—").otherwise(both)


def table(scores: DataFrame, columns: list[str], by: str = "task") -> DataFrame:
    """One row a model, best mean first, with a column of shown scores for each of the given tasks or categories."""
    wide = scores.groupBy("model").pivot(by, sorted(columns)).agg(F.first(shown(F.col("score"), F.col("std"))))
    means = mean_over_tasks(scores)
    out = means.join(wide, "model")
    return out.select("model", shown(F.col("mean"), F.col("std")).alias("mean"), *[F.coalesce(F.col(f"`{c}`"), F.lit("—")).alias(c) for c in sorted(columns)], F.col("mean").alias("__m")).orderBy(F.col("__m").desc_nulls_last(), "model").drop("__m")


def times(scores: DataFrame) -> DataFrame:
    """(model, time): seconds over all tasks, null where a task's is unknown."""
    known = F.count("time") == F.count(F.lit(1))
    return scores.groupBy("model").agg(F.when(known, F.sum("time")).alias("time"))


def category_table(scores: DataFrame, categories: DataFrame, columns: list[str], with_times: bool = False) -> DataFrame:
    """As :func:`table`, by category: each is the mean of its tasks, and the mean is over categories."""
    c = by_category(scores, categories)
    out = table(c.select("model", F.col("category").alias("task"), F.col("mean").alias("score"), "std"), columns)
    if not with_times:
        return out
    # A leaderboard has as many rows as models, so its order can be made again after the join.
    seconds = times(scores).withColumn("time", F.when(F.col("time").isNull(), "—").otherwise(F.format_string("%.0f", "time")))
    means = overall(c).select("model", F.col("mean").alias("__m"))
    return out.join(seconds, "model").join(means, "model").orderBy(F.col("__m").desc_nulls_last(), "model").drop("__m")


def markdown(shown_table: DataFrame) -> str:
    """A table of models as Markdown; a leaderboard has as many rows as there are models."""
    names = shown_table.columns
    rows = [[str(v) for v in r] for r in shown_table.collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [names, ["---"] * len(names), *rows])


def report(metrics: DataFrame, model: str) -> str:
    """Tab-separated: mean first, then the tasks by name, with three decimals."""
    rows = sorted((r["task"], r["score"]) for r in task_scores(metrics.filter(F.col("model") == model)).collect())
    values = [s for _, s in rows]
    mean = sum(values) / len(values) if values else 0.0
    return "\t".join(["mean", *[t for t, _ in rows]]) + "\n" + "\t".join(f"{v:.3f}" for v in [mean, *values])


def with_ratings(table: DataFrame, ratings: DataFrame, name: str = "arena", digits: int = 0) -> DataFrame:
    """A table by model with a judge's ratings (model, rating, std) as a column of its own; a dash for models without."""
    column = ratings.select("model", shown(F.col("rating"), F.col("std"), digits).alias(name))
    return table.join(column, "model", "left").withColumn(name, F.coalesce(F.col(name), F.lit("—")))
