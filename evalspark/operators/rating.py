"""Bradley-Terry ratings of models from judged battles, on the Elo scale."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base of the scale, its width and the anchor's rating.
ALPHA, WIDTH, ANCHOR = math.log(10.0), 400.0, 1000.0
CODES = {"model_wins": 0, "reference_wins": 1, "tie": 2}


def coded(outcome: Column) -> Column:
    """The code of an outcome; null for an invalid one."""
    return F.coalesce(*[F.when(outcome == k, v) for k, v in CODES.items()])


def agreed(*codes: Column) -> Column:
    """:func:`consolidate` of a battle whose judgements' codes, two at least, are columns of one row: no task holds other
    battles beside it. Null where none is valid."""
    low, high = F.least(*codes), F.greatest(*codes)
    return F.when(low == high, low).when(low.isNotNull(), 2)


def consolidate(battles: DataFrame) -> DataFrame:
    """One row for (id, model, reference): the outcome that all judgements share, or else a tie.

    ``battles`` has id, model, reference, outcome, seq; invalid outcomes go. The first judgement by seq gives the rest.
    """
    rows = battles.withColumn("code", coded(F.col("outcome"))).filter("code is not null")
    return rows.groupBy("id", "model", "reference").agg(F.when(F.min("code") == F.max("code"), F.min("code")).otherwise(2).alias("winner"), F.min("seq").alias("seq"))


def style_features(df: DataFrame, pairs: list[tuple[str, str]], compat: bool = False) -> DataFrame:
    """Adds z0, z1, ...: (a - b) / (a + b) of each style count, standardised over all battles.

    With ``compat`` every count is set against the reference's first one. 0 where both are 0 or nothing varies.
    """
    first = pairs[0][1]
    raw = df
    for k, (a, b) in enumerate(pairs):
        x, y = F.col(a).cast("double"), F.col(first if compat else b).cast("double")
        raw = raw.withColumn(f"z{k}", F.coalesce(F.try_divide(x - y, x + y), F.lit(0.0)))
    stats = raw.agg(*[f(f"z{k}").alias(f"{n}{k}") for k in range(len(pairs)) for f, n in ((F.avg, "m"), (F.stddev_pop, "s"))])
    out = raw.crossJoin(F.broadcast(stats))
    out = out.withColumns({f"z{k}": F.coalesce(F.try_divide(F.col(f"z{k}") - F.col(f"m{k}"), F.when(F.col(f"s{k}") > 1e-12, F.col(f"s{k}"))), F.lit(0.0)) for k in range(len(pairs))})
    return out.drop(*[f"{n}{k}" for n in "ms" for k in range(len(pairs))])


def fit(a: np.ndarray, b: np.ndarray, wins: np.ndarray, losses: np.ndarray, n: int, reg: float = 0.5, steps: int = 50) -> np.ndarray:
    """Ratings by Newton's method on counts of decisive battles of pairs (a, b), with a squared penalty.

    The chance of a tie doesn't depend on the ratings, so ties take no part.
    """
    r = np.zeros(n)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-ALPHA * (r[a] - r[b])))
        g = ALPHA * (wins - (wins + losses) * p)
        grad = np.bincount(a, g, n) - np.bincount(b, g, n) - reg * r
        h = ALPHA**2 * (wins + losses) * p * (1 - p)
        hess = np.zeros((n, n))
        np.add.at(hess, (a, a), h), np.add.at(hess, (b, b), h), np.add.at(hess, (a, b), -h), np.add.at(hess, (b, a), -h)
        step = np.linalg.solve(hess + reg * np.eye(n), grad)
        r += step
        if np.abs(step).max() < 1e-12:
            break
    return r


def tie_share(ties: int, decisive: int, reg: float = 0.5) -> float:
    """The tie parameter: a penalised Bernoulli fit by Newton's method."""
    t = 0.0
    for _ in range(60):
        p = 1 / (1 + math.exp(-t))
        t -= ((ties + decisive) * p - ties + reg * t) / ((ties + decisive) * p * (1 - p) + reg)
    return t


def elo(ratings: np.ndarray, names: list[str], baseline: str | None) -> np.ndarray:
    out = WIDTH * ratings + ANCHOR
    return out + (ANCHOR - out[names.index(baseline)]) if baseline in names else out


def arena_scale(rating, baseline: float = 50.0):
    """50 (1 + r), shifted to a baseline of 50."""
    return 50.0 * (1 + rating) - 50.0 + baseline


def pair_counts(battles: DataFrame, keys: tuple = ()) -> DataFrame:
    """(keys, model, reference, wins, losses, ties), from (model, reference, winner[, weight])."""
    w = F.col("weight") if "weight" in battles.columns else F.lit(1)
    n = lambda code: F.sum(F.when(F.col("winner") == code, w).otherwise(0)).cast("double")
    return battles.groupBy(*keys, "model", "reference").agg(n(0).alias("wins"), n(1).alias("losses"), n(2).alias("ties"))


def fit_counts(counts: pd.DataFrame, names: list[str], baseline: str | None) -> np.ndarray:
    place = {m: i for i, m in enumerate(names)}
    a, b = (counts[c].map(place).to_numpy() for c in ("model", "reference"))
    return elo(fit(a, b, counts["wins"].to_numpy(), counts["losses"].to_numpy(), len(names)), names, baseline)


def ratings(battles: DataFrame, baseline: str | None = None) -> DataFrame:
    """(model, rating) from consolidated battles.

    Battles become counts of pairs of models first; what is fitted in one task has models squared rows at most.
    """
    counts = pair_counts(battles)

    def one(group: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*group["model"], *group["reference"]})
        return pd.DataFrame({"model": names, "rating": fit_counts(group, names, baseline)})

    return counts.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(one, "model string, rating double")


def model_ids(battles: DataFrame, order: str) -> DataFrame:
    """(model, number): models numbered by where they first appear, as a model before as a reference; as many rows as models."""
    from pyspark.sql.window import Window

    sides = battles.select(order, F.posexplode(F.array("model", "reference")).alias("__side", "__m"))
    first = sides.groupBy(F.col("__m").alias("model")).agg(F.min(F.struct("__side", order)).alias("__first"))
    return first.select("model", (F.row_number().over(Window.orderBy("__first", "model")) - 1).alias("number"))


def ratings_with_ties(battles: DataFrame, baseline: str | None = None) -> DataFrame:
    """:func:`ratings` with the tie parameter, one number for all models, beside them."""
    n = battles.agg(F.count(F.when(F.col("winner") == 2, 1)).alias("ties"), F.count(F.when(F.col("winner") < 2, 1)).alias("decisive")).first()
    return ratings(battles, baseline).withColumn("tie", F.lit(float(tie_share(n["ties"], n["decisive"]))))


def bootstrap_ratings(battles: DataFrame, bags: int = 100, baseline: str | None = None, level: float = 0.95, exact: bool = False) -> DataFrame:
    """(model, rating, std, ci_lower, ci_upper): ratings with the spread over bags of battles.

    A bag is as many draws as there are battles with ``exact``; else each battle has a Poisson weight from a hash, whose
    spread is the same and which makes no rows. Bags are counts of pairs before they are fitted, one task a bag.
    """
    from .bootstrap import percentiles, resample, weighted
    from .sampling import numbered

    if exact:
        placed = numbered(battles.select("id", "model", "reference", "winner"), "id", "model", "reference")
        drawn = resample(placed, "pos", placed.count(), bags)
    else:
        drawn = weighted(battles, ("id", "model", "reference"), bags)
    counts = pair_counts(drawn, ("bag",))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*group["model"], *group["reference"]})
        return pd.DataFrame({"model": names, "value": fit_counts(group, names, baseline)})

    by_bag = counts.groupBy("bag").applyInPandas(one, "model string, value double")
    return ratings(battles, baseline).join(percentiles(by_bag, ("model",), level=level), "model", "left").select("model", F.round("rating").alias("rating"), F.round("std").alias("std"), F.round("ci_lower").alias("ci_lower"), F.round("ci_upper").alias("ci_upper"))


#: Poisson(1) by a uniform number: the chances of at most 0, 1, 2, ...
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])


def bag_weights(keys: np.ndarray, bag: int) -> np.ndarray:
    """How often rows with these 64-bit hashes are in a bag; bag 0 has each of them once."""
    if not bag:
        return np.ones(len(keys))
    x = keys.astype(np.uint64) + np.uint64(bag * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(POISSON, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53, "right").astype(float)


def slopes(theta: np.ndarray, n: int, i: np.ndarray, j: np.ndarray, won: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Gradient and Hessian, as one array, of battles' log-likelihood at ratings and weights of features."""
    r, beta = theta[:n], theta[n:]
    p = 1 / (1 + np.exp(-(ALPHA * (r[i] - r[j]) + x @ beta)))
    e, h = w * (won - p), w * p * (1 - p)
    g = np.concatenate([ALPHA * (np.bincount(i, e, n) - np.bincount(j, e, n)), x.T @ e])
    hess, hx = np.zeros((len(theta), len(theta))), ALPHA * h[:, None] * x
    for a, b, sign in ((i, i, 1), (j, j, 1), (i, j, -1), (j, i, -1)):
        hess[:n, :n] += sign * ALPHA**2 * np.bincount(a * n + b, h, n * n).reshape(n, n)
    for k in range(len(beta)):
        hess[:n, n + k] = np.bincount(i, hx[:, k], n) - np.bincount(j, hx[:, k], n)
    hess[n:, :n] = hess[:n, n:].T
    hess[n:, n:] = x.T @ (h[:, None] * x)
    return np.concatenate([g, hess.ravel()])


def fit_style(battles: DataFrame, features: list[str], names: list[str], reg: float = 0.5, bags: int = 0, keys: tuple = ("id", "model", "reference"), steps: int = 30) -> np.ndarray:
    """Parameters (bags + 1, models + features) of ratings with style features, by Newton's method over all battles.

    Each step is one scan: tasks add up gradients and Hessians of their battles, for all bags at once, and these sums, whose
    size is that of the models, meet in a tree. Ties take no part. Battles are written once, as numbers.
    """
    from ..sources.shared import written

    n, d, spark = len(names), len(names) + len(features), battles.sparkSession
    place = F.create_map(*[F.lit(x) for i, m in enumerate(names) for x in (m, i)])
    key = F.xxhash64(*keys) if bags else F.lit(0).cast("bigint")
    rows = battles.filter("winner < 2 and model is not null and reference is not null").select(place[F.col("model")].alias("i"), place[F.col("reference")].alias("j"), (1 - F.col("winner")).cast("double").alias("won"), key.alias("key"), F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]).cast("array<double>").alias("x"))
    rows = written(rows, "battles")
    theta = np.zeros((bags + 1, d))
    for _ in range(steps):
        sent = spark.sparkContext.broadcast(theta)

        def part(batches, sent=sent):
            at, total = sent.value, np.zeros((bags + 1, d + d * d))
            for batch in batches:
                i, j, won, key = (batch.column(k).to_numpy() for k in range(4))
                x = batch.column(4).flatten().to_numpy().reshape(len(i), len(features))
                for bag in range(bags + 1):
                    total[bag] += slopes(at[bag], n, i, j, won, x, bag_weights(key.view(np.uint64), bag))
            yield pa.RecordBatch.from_pydict({"sums": [total.tobytes()]})

        sums = rows.mapInArrow(part, "sums binary").rdd.map(lambda r: np.frombuffer(r.sums)).treeReduce(np.add).reshape(bags + 1, d + d * d)
        step = np.stack([np.linalg.solve(s[d:].reshape(d, d) + reg * np.eye(d), s[:d] - reg * t) for s, t in zip(sums, theta)])
        theta = theta + step
        if np.abs(step).max() < 1e-10:
            break
    return theta


def model_names(battles: DataFrame, most: int = 2000) -> list[str]:
    """The models of all battles, in order; their number bounds what a fit holds, so more than ``most`` are an error."""
    rows = battles.select(F.explode(F.array("model", "reference")).alias("m")).filter("m is not null").distinct().orderBy("m").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} models")
    return [r.m for r in rows]


def ratings_with_style(battles: DataFrame, features: list[str], names: list[str], baseline: str | None = None, reg: float = 0.5) -> dict[str, float]:
    """Ratings with style features beside the models."""
    return dict(zip(names, elo(fit_style(battles, features, names, reg)[0, : len(names)], names, baseline).tolist()))


def style_ratings(battles: DataFrame, features: list[str], baseline: str | None = None, bags: int = 0, level: float = 0.95, reg: float = 0.5) -> DataFrame:
    """(kind, name, value, std, ci_lower, ci_upper, tie): a model's rating, or a feature's weight, with its spread over bags.

    The chance of a tie doesn't depend on ratings or style, so ties take part in ``tie`` alone, one number for all. Bags
    are Poisson weights from a hash of the battle; without any there is no spread. No battles give no rows.
    """
    spark, names = battles.sparkSession, model_names(battles)
    schema = "kind string, name string, value double, std double, ci_lower double, ci_upper double, tie double"
    if not names:
        return spark.createDataFrame([], schema)
    theta = fit_style(battles, features, names, reg, bags)
    n = battles.agg(F.count_if(F.col("winner") == 2).alias("ties"), F.count_if(F.col("winner") < 2).alias("decisive")).first()
    values = np.stack([np.concatenate([elo(t[: len(names)], names, baseline), t[len(names) :]]) for t in theta])
    spread = (values[1:].std(0), *np.quantile(values[1:], [(1 - level) / 2, (1 + level) / 2], axis=0)) if bags else (None,) * 3
    of = lambda k: [None if s is None else float(s[k]) for s in spread]
    tie = float(tie_share(n["ties"], n["decisive"], reg))
    kinds = [("model", m) for m in names] + [("feature", f) for f in features]
    return spark.createDataFrame([(kind, name, float(values[0, k]), *of(k), tie) for k, (kind, name) in enumerate(kinds)], schema)


def median_lengths(answers: DataFrame, model: str = "model", text: str = "text") -> DataFrame:
    """(model, median length) of answers, without invalid ones and ones that start by thinking."""
    kept = answers.filter(~F.col(text).startswith("<think>\n"))
    return kept.groupBy(model).agg(F.median(F.length(text)).cast("int").alias("median_length"))


__all__ = ["agreed", "arena_scale", "bootstrap_ratings", "consolidate", "elo", "fit", "median_lengths", "pair_counts", "ratings", "ratings_with_style", "style_features", "style_ratings", "tie_share"]
