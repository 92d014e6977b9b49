"""Writers of logs, totals and reports."""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample_log(scored: DataFrame, path: str, form: str = "json") -> None:
    """One row a sample (metric, predict, sample, prompt, info), by model and task; image columns aren't written."""
    kept = scored.drop("image", "image_url")
    kept.write.mode("overwrite").partitionBy("model", "task").format(form).save(path)


def totals(metrics: DataFrame, path: str) -> None:
    """One row a (model, task) with its metrics as a map and their mean."""
    rows = metrics.groupBy("model", "task").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("results"), F.avg("value").alias("leaderboard_result"))
    rows.write.mode("overwrite").partitionBy("model", "task").json(path)


def details(scored: DataFrame, path: str, keys: tuple = ("model", "task")) -> None:
    """Beside the totals, what each aggregate was made of: count, mean, deviation and extremes of each numeric metric."""
    numeric = [f.name for f in scored.schema.fields if f.name not in keys and f.dataType.typeName() in ("double", "float", "integer", "long", "boolean")]
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numeric]))
    rows = scored.select(*keys, each.alias("m")).select(*keys, "m.*").groupBy(*keys, "metric")
    rows.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("least"), F.max("value").alias("greatest")).write.mode("overwrite").partitionBy(*keys).json(path)


def params(settings: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(settings, f, ensure_ascii=False, indent=4)


def battles(log: DataFrame, path: str) -> None:
    """Battles of a sample log, whose metric holds one as its score."""
    log.select("metric.score.*").write.mode("overwrite").json(path)


def answers(df: DataFrame, path: str, dataset: str) -> None:
    """Answers for an arena: instruction, output, generator, dataset, generated_tokens, datasplit."""
    df.select("instruction", "output", "generator", F.lit(dataset).alias("dataset"), "generated_tokens", F.lit("eval").alias("datasplit")).write.mode("overwrite").json(path)


def arena_table(ratings: DataFrame) -> str:
    """Ratings as Markdown, best first; as many rows as models."""
    rows = ratings.orderBy(F.col("rating").desc(), "model").collect()
    lines = ["| model | rating | std | 95% CI | median length |", "| --- | --- | --- | --- | --- |"]
    for r in rows:
        d = r.asDict()
        lines.append(f"| {d['model']} | {d['rating']:.0f} | {d['std']:.0f} | [{d['ci_lower']:.0f}, {d['ci_upper']:.0f}] | {d.get('median_length', '')} |")
    return "\n".join(lines)


def optimiser_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("iter").json(path)


def evolution_board(evolution) -> str:
    """An evolution table (a row a model, a column an iteration) as Markdown, with three digits."""
    names = evolution.columns
    rows = [["—" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v) for v in r] for r in evolution.collect()]
    return "\n".join("| " + " | ".join(r) + " |" for r in [names, ["---"] * len(names), *rows])


def log_to(path: str, name: str = "evalspark") -> logging.Logger:
    """A logger to the console and a file, with one handler of each."""
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    for h in list(log.handlers):
        log.removeHandler(h)
    for h in (logging.StreamHandler(), logging.FileHandler(path, encoding="utf-8")):
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(h)
    return log


def finished(spark, path: str, model: str, task: str) -> bool:
    """Whether a task's total is there, so that a run can go on where one stopped."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/model={model}/task={task}")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
