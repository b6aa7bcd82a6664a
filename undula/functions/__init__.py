"""Helper functions over series and columns."""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import check, haloed, is_exact, own

#: At or below this deviation ``znorm`` only subtracts the mean.
FLAT = 0.01


def moments(series: DataFrame) -> DataFrame:
    """series_id, n, mean, sd (population) of the whole series; of whole numbers from exact sums, or from doubles if even
    decimals of 38 digits overflow."""
    v = F.col("value")
    if is_exact(series):
        wide = v.cast("decimal(19,0)")
        sums = series.groupBy("series_id").agg(F.count(v).alias("n"), F.sum(wide).cast("decimal(38,0)").alias("s"), F.try_sum(F.try_multiply(wide, wide)).cast("decimal(38,0)").alias("q"), F.stddev_pop(v.cast("double")).alias("about"))
        n = "CAST(n AS DECIMAL(20,0))"
        spread = f"try_subtract(try_multiply({n}, q), try_multiply(s, s))"
        return sums.select("series_id", "n", (F.col("s").cast("double") / F.col("n")).alias("mean"), F.coalesce(F.sqrt(F.expr(f"CAST({spread} AS DOUBLE) / CAST({n} * {n} AS DOUBLE)")), "about").alias("sd"))
    return series.groupBy("series_id").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"))


def znorm(series: DataFrame) -> DataFrame:
    """Series with mean 0 and population deviation 1; a nearly flat series only loses its mean."""
    series = check(series)
    moved = F.col("value") - F.col("mean")
    rows = series.join(moments(series), "series_id")
    return rows.select("series_id", "pos", F.when(F.col("sd") <= FLAT, moved).otherwise(moved / F.when(F.col("sd") > FLAT, F.col("sd"))).alias("value"))


def std(series: DataFrame, na_rm: bool = False) -> DataFrame:
    """Population deviation by series; null if a value is missing, unless ``na_rm``."""
    series = check(series)
    v = F.when(F.isnan(F.col("value").cast("double")), None).otherwise(F.col("value"))
    rows = series.withColumn("value", v)
    out = moments(rows)
    if na_rm:
        return out.select("series_id", F.col("sd").alias("std"))
    full = rows.groupBy("series_id").agg(F.count("*").alias("all"))
    return out.join(full, "series_id").select("series_id", F.when(F.col("n") == F.col("all"), F.col("sd")).alias("std"))


def normalize(series: DataFrame, min_lim: float = 0.0, max_lim: float = 1.0) -> DataFrame:
    """Values moved and scaled to [min_lim, max_lim] and clamped; a constant series gives null."""
    series = check(series)
    low_high = series.groupBy("series_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    scaled = F.expr(f"{float(min_lim)}D + {float(max_lim) - float(min_lim)}D * try_divide(CAST(value - low AS DOUBLE), CAST(high - low AS DOUBLE))")
    clamped = F.when(scaled.isNotNull(), F.least(F.greatest(scaled, F.lit(float(min_lim))), F.lit(float(max_lim))))
    return series.join(low_high, "series_id").select("series_id", "pos", clamped.alias("value"))


def complexity(series: DataFrame) -> DataFrame:
    """Root of the summed squares of the steps, by series."""
    series = check(series)
    step = F.col("value") - F.lag("value").over(Window.partitionBy("series_id", "block").orderBy("pos"))
    d = F.col("d").cast("decimal(19,0)" if is_exact(series) else "double")
    steps = haloed(series, 0, 1).select("series_id", "pos", "block", step.alias("d")).filter(own())
    return steps.groupBy("series_id").agg(F.sqrt(F.coalesce(F.sum(d * d).cast("double"), F.lit(0.0))).alias("complexity"))


def mode(series: DataFrame) -> DataFrame:
    """Most frequent value, truncated to a whole number; of equally frequent ones that seen first."""
    counts = check(series).filter("value IS NOT NULL").groupBy("series_id", F.col("value").cast("bigint").alias("x")).agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    return counts.groupBy("series_id").agg(F.max_by("x", F.struct("n", -F.col("first"))).alias("mode"))


def ed_corr(distance: Column, window: int) -> Column:
    """Correlation of two windows at a z-normalised Euclidean distance."""
    return (F.lit(2.0 * window) - distance * distance) / F.lit(2.0 * window)


def corr_ed(rho: Column, window: int) -> Column:
    """z-normalised Euclidean distance of two windows of a correlation."""
    return F.when(rho.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.lit(2.0 * window) * (F.lit(1.0) - F.least(rho, F.lit(1.0))))))


def folded(u: np.ndarray, a: float, start: float) -> np.ndarray:
    """The recursive sums ``s = a * s + u`` from ``start`` on, by a triangular matrix product for each 256 values."""
    n, size = len(u), 256
    lag = np.arange(size)[:, None] - np.arange(size)[None]
    part = np.zeros((-(-n // size), size))
    part.ravel()[:n] = u
    part = part @ np.where(lag >= 0, a ** np.maximum(lag, 0), 0.0).T
    power = a ** np.arange(1, size + 1)
    for row in part:
        row += power * start
        start = row[-1]
    return part.ravel()[:n]


def split_order(n: int) -> list[int]:
    """1, then the middles of [2, n] halved again and again, level by level."""
    out, spans = [1], deque([(2, n)] if n > 1 else [])
    while spans:
        low, high = spans.popleft()
        middle = (low + high) // 2
        out.append(middle)
        if low < middle:
            spans.append((low, middle - 1))
        if middle < high:
            spans.append((middle + 1, high))
    return out


def binary_split(spark: SparkSession, n: int) -> DataFrame:
    """pos and index of ``split_order``."""
    return spark.createDataFrame(list(enumerate(split_order(n), 1)), "pos long, idx long")
