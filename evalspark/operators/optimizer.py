"""Bookkeeping of an evolutionary prompt optimiser."""

from __future__ import annotations

import re
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SOLUTIONS = "id bigint, parent_id bigint, iter int, score double, prompt string, feedback string"


class Mutator(Protocol):
    def __call__(self, prompt: str, feedback: str) -> str: ...


class Scorer(Protocol):
    def __call__(self, prompt: str) -> DataFrame: ...


def sample_score(kind: Column, gold: Column, pred: Column, tp: Column, fn: Column, fp: Column, value: Column) -> Column:
    """A sample's score by kind of metric: equality of labels, F1 of counts, or the number itself."""
    return F.when(kind == "pair", (gold == pred).cast("double")).when(kind == "counts", F.coalesce(F.try_divide(2.0 * tp, 2.0 * tp + fn + fp), F.lit(0.0))).otherwise(value)


def rank_weights(df: DataFrame, score: str, key: str, alpha: float = 1.0, compat: bool = False) -> DataFrame:
    """Adds weight (rank to the power -alpha, best first, summing to 1) and its running sum; equal ones with ``compat``."""
    order = Window.orderBy(F.col(score).desc(), key)
    raw = F.lit(1.0) if compat else F.pow(F.col("rank").cast("double"), F.lit(-alpha))
    rows = df.withColumn("rank", F.row_number().over(order)).withColumn("__w", raw)
    rows = rows.withColumn("weight", F.col("__w") / F.sum("__w").over(Window.partitionBy(F.lit(1)))).drop("__w")
    return rows.withColumn("upto", F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def draws(df: DataFrame, weight: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows drawn without replacement, by weight, with ``turn``, the order in which they are drawn.

    Each row's key is an exponential time whose rate is its weight, from a hash of key and seed: the rows that come first
    are distributed as draws one after another. Tasks keep n rows each, and reruns agree. Rows without a positive weight
    or with a null key are never drawn; fewer than n rows are all drawn.
    """
    from .sampling import P, draw

    chance = (draw(F.col(key), F.lit(seed), P) + 0.5) / P
    first = df.filter((F.col(weight) > 0) & F.col(key).isNotNull()).withColumn("__at", -F.ln(chance) / F.col(weight)).orderBy("__at", key).limit(n)
    return first.withColumn("turn", F.row_number().over(Window.orderBy("__at", key)) - 1).drop("__at")


def power_law_draws(df: DataFrame, score: str, key: str, n: int, alpha: float = 1.0, seed: int = 0, compat: bool = False) -> DataFrame:
    """Draws of solutions by their rank's power: the sampler of a population, best first the likeliest."""
    return draws(rank_weights(df, score, key, alpha, compat), "weight", key, n, seed)


def worst_samples(df: DataFrame, sample: str, score: str, pred: str, n: int) -> DataFrame:
    """The n samples of least mean score (to six digits, so that equal ones tie), each with its worst prediction."""
    return df.groupBy(sample).agg(F.round(F.avg(score), 6).alias("mean_score"), F.min(F.struct(F.col(score).alias("s"), F.col(pred).alias("p")))["p"].alias("worst")).orderBy("mean_score", sample).limit(n)


def feedback_text(worst: DataFrame, sample: str) -> DataFrame:
    """The worst samples as one text, worst first; as many rows as were asked for."""
    rows = F.array_sort(F.collect_list(F.struct("mean_score", F.col(sample).alias("sample"), "worst")))
    return worst.agg(F.array_join(F.transform(rows, lambda r: F.concat(r["sample"].cast("string"), F.lit(": "), r["worst"])), "\n").alias("feedback"))


def evolution(df: DataFrame, model: str, iteration: str, score: str, iterations: list) -> DataFrame:
    """Mean score by model and iteration, with an Average row over models."""
    by = df.groupBy(model, iteration).agg(F.avg(score).alias("s"))
    wide = by.groupBy(model).pivot(iteration, iterations).agg(F.first("s"))
    average = wide.agg(F.lit("Average").alias(model), *[F.avg(F.col(f"`{i}`")).alias(str(i)) for i in iterations])
    return wide.unionByName(average)


def lineage(spark: SparkSession, solutions: DataFrame, of: int) -> DataFrame:
    """A solution and its ancestors, nearest first."""
    solutions.createOrReplaceTempView("__solutions")
    return spark.sql(f"""WITH RECURSIVE up(id, parent_id, score, depth) AS (
        SELECT id, parent_id, score, 0 FROM __solutions WHERE id = {int(of)}
        UNION ALL SELECT s.id, s.parent_id, s.score, up.depth + 1 FROM __solutions s JOIN up ON s.id = up.parent_id)
        SELECT * FROM up ORDER BY depth""")


def parse_prompt(text: str) -> list[dict] | None:
    """Messages from ``[user]`` and ``[assistant]`` blocks; None without any."""
    found = re.findall(r"\[(user|assistant|system)\]:?\s*\n?(.*?)(?=\n\[(?:user|assistant|system)\]|\Z)", text, re.S)
    return [{"role": r, "content": c.strip()} for r, c in found] or None


#: What a mutation that doesn't parse is reminded of.
REMINDER = "\n\nAnswer with messages only, each after a line [user]: or [assistant]:."


def gradient(prompt: str, feedback: str, template: str = "A prompt had these worst results.\n{feedback}\n\nSay what to change in it.\n{prompt}") -> str:
    """The question to a model what is wrong with a prompt; the names in braces are filled."""
    return template.replace("{prompt}", prompt).replace("{feedback}", feedback)


def run_all(questions: DataFrame, texts: DataFrame, models: dict, question: str = "question") -> DataFrame:
    """Answers of all models to all questions under all prompts: ``texts`` (prompt_id, template) is a small table whose
    templates have {question}; ``models`` are factories by name, each of which runs over the whole product."""
    from functools import reduce

    from .predict import generate
    from .sampling import crossed

    asked = crossed(questions, texts).withColumn("prompt", F.replace("template", F.lit("{question}"), F.col(question))).drop("template")
    return reduce(DataFrame.unionByName, [generate(asked, "prompt", make).withColumn("model", F.lit(name)) for name, make in models.items()])


def optimise(spark: SparkSession, start: str, mutate: Mutator, score: Scorer, iterations: int, target: float = 1.0, retries: int = 5) -> DataFrame:
    """Mutates the best prompt so far, scores it over all samples, and keeps the tree of solutions.

    ``score`` gives rows (sample, score, pred) for a prompt. A mutation that doesn't parse is asked again.
    """
    rows = []
    add = lambda parent, it, prompt: rows.append((len(rows), parent, it, *_scored(score(prompt)), prompt))
    add(None, 0, start)
    for it in range(1, iterations + 1):
        best = max(rows, key=lambda r: (r[3], r[0]))
        if best[3] >= target:
            break
        for attempt in range(retries):
            text = mutate(best[5], best[4] + REMINDER * (attempt > 0))
            if parse_prompt(text):
                add(best[0], it, text)
                break
    return spark.createDataFrame([(i, p, it, s, t, f) for i, p, it, s, f, t in rows], SOLUTIONS)


def _scored(df: DataFrame) -> tuple[float, str]:
    df = df.cache()
    mean = df.agg(F.avg("score")).first()[0] or 0.0
    text = feedback_text(worst_samples(df, "sample", "score", "pred", 3), "sample").first()[0]
    df.unpersist()
    return mean, text
