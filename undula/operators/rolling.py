"""Rolling statistics.

Entry ``pos`` covers the values ``pos .. pos + w - 1``; only whole windows give rows. Sums of whole numbers are exact: mean,
variance and deviation come from them by one division, so they do not drift. Other values use sliding frames, which
aggregate each window anew.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import folded, moments
from .. import sources
from ..sources import check, haloed, is_exact, own

KINDS = ("ogita", "normal", "weighted", "fading")


def _guard(window: int, kind: str = "ogita") -> None:
    if window < 2:
        raise ValueError("a window holds two values at least")
    if kind not in KINDS:
        raise ValueError(f"type is one of {KINDS}")


def _frame(window: int):
    return Window.partitionBy("series_id", "block").orderBy("pos").rowsBetween(0, window - 1)


def statistics(series: DataFrame, window: int, **wanted: Column) -> DataFrame:
    """series_id, pos and the wanted expressions over n, s, q, low, high, avg, var (population) of each whole window.

    Of whole numbers, avg and var come from exact sums where these can't overflow, and from doubles otherwise.
    """
    series, f = check(series), _frame(window)
    v, d = F.col("value"), F.col("value").cast("double")
    exact = is_exact(series)
    total = [F.sum(v).over(f).alias("s")] if not exact or "mov_sum" in wanted else [F.try_sum(v).over(f).alias("s")]
    square = F.try_sum(F.try_multiply(v, v)) if exact else F.sum(v * v)
    rows = haloed(series, window - 1).select("series_id", "pos", "block", F.count(F.lit(1)).over(f).alias("n"), *total, square.over(f).alias("q"), F.min(v).over(f).alias("low"), F.max(v).over(f).alias("high"), F.avg(d).over(f).alias("avg"), F.var_pop(d).over(f).alias("var"), *([F.sum(d * d).over(f).alias("qd")] if exact else []))
    if exact:
        small = f"low > -{2**31 // window} AND high < {2**31 // window}"
        rows = rows.withColumn("avg", F.expr("coalesce(CAST(s AS DOUBLE) / n, avg)")).withColumn("var", F.expr(f"IF({small}, CAST(n * q - s * s AS DOUBLE) / CAST(n * n AS DOUBLE), var)"))
        rows = rows.withColumn("q", F.expr(f"IF({small}, CAST(q AS DOUBLE), qd)"))
    return rows.filter(own() & (F.col("n") == window)).select("series_id", "pos", *(e.alias(k) for k, e in wanted.items()))


def mov_sum(series: DataFrame, window: int, type: str = "ogita", eps: float = 0.90) -> DataFrame:
    _guard(window, type)
    return _folded(series, window, type, eps, "mov_sum") if type in KINDS[2:] else statistics(series, window, mov_sum=F.col("s"))


def mov_mean(series: DataFrame, window: int, type: str = "ogita", eps: float = 0.90) -> DataFrame:
    _guard(window, type)
    return _folded(series, window, type, eps, "mov_mean") if type in KINDS[2:] else statistics(series, window, mov_mean=F.col("avg"))


def mov_var(series: DataFrame, window: int, type: str = "ogita", eps: float = 0.90) -> DataFrame:
    """Population variance."""
    _guard(window, type)
    return _folded(series, window, type, eps, "mov_var") if type in KINDS[2:] else statistics(series, window, mov_var=F.col("var"))


def mov_std(series: DataFrame, window: int) -> DataFrame:
    """Population deviation."""
    _guard(window)
    return statistics(series, window, mov_std=F.sqrt("var"))


def mov_min(series: DataFrame, window: int) -> DataFrame:
    """Smallest value, null if that is +Infinity; a window longer than the series covers all of it."""
    return _extreme(series, window, "low", "mov_min", "Infinity")


def mov_max(series: DataFrame, window: int) -> DataFrame:
    """Largest value, null if that is -Infinity; a window longer than the series covers all of it."""
    return _extreme(series, window, "high", "mov_max", "-Infinity")


def _extreme(series: DataFrame, window: int, what: str, name: str, none: str) -> DataFrame:
    _guard(window)
    series, f = check(series), _frame(window)
    one = (F.min if what == "low" else F.max)("value").over(f)
    sizes = series.groupBy("series_id").agg(F.count("*").alias("all"))
    rows = haloed(series, window - 1).select("series_id", "pos", "block", one.alias(name), F.count(F.lit(1)).over(f).alias("n")).filter(own())
    rows = rows.join(sizes, "series_id").filter(F.col("n") == F.least(F.lit(window), "all"))
    return rows.select("series_id", "pos", name if is_exact(series) else F.nullif(F.col(name), F.lit(float(none))).alias(name))


def movmean_std(series: DataFrame, window: int) -> DataFrame:
    """avg, sd, sig (1 / (sd * sqrt(w)), null for a flat window), sum (null if whole numbers overflow it), sqrsum."""
    _guard(window)
    return statistics(series, window, avg=F.col("avg"), sd=F.sqrt("var"), sig=F.expr(f"sqrt(try_divide(1D, var * {window}))"), sum=F.col("s"), sqrsum=F.col("q"))


def muinvn(series: DataFrame, window: int) -> DataFrame:
    """avg and sig."""
    _guard(window)
    return statistics(series, window, avg=F.col("avg"), sig=F.expr(f"sqrt(try_divide(1D, var * {window}))"))


def zero_crossing(series: DataFrame, window: int) -> DataFrame:
    """Sign changes of the z-normalised series between neighbours ``pos + 1 .. pos + w - 2``: the last pair isn't counted."""
    series = check(series)
    by = Window.partitionBy("series_id", "block").orderBy("pos")
    side = F.signum(F.col("value") - F.col("mean"))
    rows = haloed(series.join(moments(series), "series_id").select("series_id", "pos", side.alias("side")), window - 1, 1)
    rows = rows.withColumn("flag", (F.col("side") * F.lag("side").over(by) < 0).cast("int"))
    pairs = F.sum("flag").over(by.rowsBetween(1, window - 2)) if window > 2 else F.lit(0)
    rows = rows.select("series_id", "pos", "block", F.coalesce(pairs, F.lit(0)).cast("int").alias("zero_crossing"), F.count(F.lit(1)).over(_frame(window)).alias("n"))
    return rows.filter(own() & (F.col("n") == window)).select("series_id", "pos", "zero_crossing")


def _folded(series: DataFrame, window: int, kind: str, eps: float, name: str) -> DataFrame:
    """Recursive sums ``s = a * s + u`` with ``a = eps ** (1 / w)``.

    fading: u is the value. weighted: from the (w + 1)-th value on, ``a ** (w - 1)`` times the value w places before is taken
    off. A series is cut into blocks that are folded from 0; a block's start is then the sum of what earlier blocks leave,
    which decays by a power of ``a`` from block to block.
    """
    series, a = check(series), eps ** (1 / window)
    drop = a ** (window - 1) if kind == "weighted" else 0.0
    by = Window.partitionBy("series_id", "block").orderBy("pos")
    rows = haloed(series, 0, window).select("series_id", "pos", "block", F.col("value").cast("double").alias("x"), F.lag(F.col("value").cast("double"), window).over(by).alias("old")).filter(own())

    def fold(u: np.ndarray) -> np.ndarray:
        return folded(u, a, 0.0)

    def local(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        x, old = part["x"].to_numpy(), part["old"].to_numpy()
        late = part["pos"].to_numpy() > window
        old = np.where(late, old, 0.0)
        return pd.DataFrame({"series_id": part["series_id"], "pos": part["pos"], "block": part["block"], "sx": fold(x - drop * old), "sq": fold(x * x - drop * old * old), "s1": fold(1.0 - drop * late)})

    parts = rows.groupBy("series_id", "block").applyInPandas(local, "series_id string, pos long, block int, sx double, sq double, s1 double")

    def carry(ends: pd.DataFrame) -> pd.DataFrame:
        ends = ends.sort_values("block")
        out, state = [], np.zeros(3)
        for row in ends.itertuples():
            out.append(state)
            state = state * a**row.size + np.array([row.sx, row.sq, row.s1])
        c = np.array(out).reshape(-1, 3)
        return pd.DataFrame({"series_id": ends["series_id"], "block": ends["block"], "cx": c[:, 0], "cq": c[:, 1], "c1": c[:, 2]})

    ends = parts.groupBy("series_id", "block").agg(F.count("*").alias("size"), *(F.max_by(c, "pos").alias(c) for c in ("sx", "sq", "s1")))
    starts = ends.groupBy("series_id").applyInPandas(carry, "series_id string, block int, cx double, cq double, c1 double")
    decay = F.pow(F.lit(a), (F.col("pos") - F.col("block").cast("bigint") * sources.BLOCK).cast("double"))
    whole = parts.join(starts, ["series_id", "block"]).select("series_id", "pos", *((F.col(f"s{k}") + decay * F.col(f"c{k}")).alias(k) for k in ("x", "q", "1")))
    mean = F.col("x") / F.col("1")
    value = {"mov_sum": F.col("x"), "mov_mean": mean, "mov_var": F.col("q") / F.col("1") - mean * mean}[name]
    return whole.filter(F.col("pos") >= window).select("series_id", (F.col("pos") - window + 1).alias("pos"), value.alias(name))
