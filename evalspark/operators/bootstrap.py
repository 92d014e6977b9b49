"""Bootstrap of metrics, with draws from plain arithmetic so that reruns and other engines agree."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .sampling import draw

#: The Poisson(1) distribution function, as far as a double tells it from 1.
STEPS = tuple(itertools.takewhile(lambda x: x < 1, itertools.accumulate(math.exp(-1) / math.factorial(k) for k in range(30))))


def resample(df: DataFrame, key: str, n: int, bags: int, size: int | None = None) -> DataFrame:
    """Rows of each bag: (bag, draw) pairs joined to rows by their place ``key`` in 0 .. n - 1.

    Bags and draws are made by two ranges, not by a product of tables. For large n, :func:`weighted` avoids the rows.
    """
    spark = df.sparkSession
    size = size or n
    draws = spark.range(bags * size).select((F.col("id") / size).cast("bigint").alias("bag"), (F.col("id") % size).alias("draw"))
    return draws.withColumn(key, draw(F.col("bag"), F.col("draw"), n)).join(df, key)


def weighted(df: DataFrame, key: str | tuple[str, ...], bags: int) -> DataFrame:
    """Approximate bags: each row with a Poisson(1) weight a bag, from a hash of bag and key; rows of weight 0 go.

    ``key`` names the columns that tell rows apart. The hash isn't folded, so rows have one weight only if all its bits agree.
    """
    keys = (key,) if isinstance(key, str) else key
    # The upper 53 bits, which a double holds exactly.
    u = F.shiftrightunsigned(F.xxhash64(F.col("bag").cast("bigint"), *keys), 11).cast("double") / F.lit(2.0**53)
    weight = sum((u >= s).cast("int") for s in STEPS)
    return df.withColumn("bag", F.explode(F.sequence(F.lit(0), F.lit(bags - 1)))).withColumn("weight", weight).filter("weight > 0")


def summary(by_bag: DataFrame, value: str = "value", keys: tuple = ()) -> DataFrame:
    """Mean over bags, population deviation, and the mean less and plus it."""
    m, s = F.avg(value), F.stddev_pop(value)
    return by_bag.groupBy(*keys).agg(m.alias("mean"), s.alias("std"), (m - s).alias("lower"), (m + s).alias("upper"))


def percentiles(by_bag: DataFrame, keys: tuple, value: str = "value", level: float = 0.95) -> DataFrame:
    """Deviation and the two-sided interval, by linear interpolation."""
    low = (1 - level) / 2
    return by_bag.groupBy(*keys).agg(F.stddev_pop(value).alias("std"), F.percentile(value, F.lit(low)).alias("ci_lower"), F.percentile(value, F.lit(1 - low)).alias("ci_upper"))
