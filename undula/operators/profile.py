"""Profiles: the nearest neighbour of each window, in the same series or in another one.

``stamp``, ``stomp``, ``scrimp`` and ``mpx`` are one operator. They differ in what a share of the work (``s_size``) visits and
in the columns that they return. All positions count from 1. Windows that are flat or hold a missing or non-finite value are
nobody's neighbour; a window without one has distance +Infinity (correlation null) and index -1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import corr_ed
from ..plans.tiles import TILE, Sample, cross_best, self_best
from ..sources import check, zone


def _guard(window: int) -> None:
    if window < 2:
        raise ValueError("a window holds two values at least")


def _every(series: DataFrame, window: int) -> DataFrame:
    """One row for each window; a series of less than twice the window's length fails the query."""
    n = series.groupBy("series_id").agg(F.count("*").alias("n"))
    wrong = F.raise_error(F.concat(F.lit(f"window {window} is more than half of series "), "series_id")).cast("bigint")
    last = F.when(F.ceil(F.col("n") / 2) < window, wrong).otherwise(F.col("n") - window + 1)
    return n.select("series_id", F.explode(F.sequence(F.lit(1).cast("bigint"), last)).alias("pos"))


def _measure(rho: Column, window: int, distance: str) -> Column:
    if distance == "pearson":
        return F.when(rho.isNotNull(), F.least(rho, F.lit(1.0)))
    return F.coalesce(corr_ed(rho, window), F.lit(float("inf")))


def _share(s_size: float) -> float:
    if not 0 < s_size <= 1:
        raise ValueError("s_size is more than 0 and at most 1")
    return s_size


def _columns(series: DataFrame, window: int, distance: str, idxs: bool = True, **best: DataFrame) -> DataFrame:
    """Profile and index columns for each named table of (series_id, pos, rho, idx)."""
    out = _every(series, window)
    for name, rows in best.items():
        profile, index = name.split("__")
        got = rows.select("series_id", "pos", F.col("rho").alias("_r"), F.col("idx").alias("_i"))
        out = out.join(got, ["series_id", "pos"], "left").withColumn(profile, _measure(F.col("_r"), window, distance))
        out = out.withColumn(index, F.coalesce("_i", F.lit(-1).cast("bigint"))) if idxs else out
        out = out.drop("_r", "_i")
    return out


def _sides(best: DataFrame, window: int, distance: str, idxs: bool = True, *names: str) -> DataFrame:
    """Profile and index columns of ``self_best``: of each side, or (the name "") the better of both, of equal ones the left, which lies lower."""
    left = F.coalesce(F.col("left_rho") >= F.col("right_rho"), F.col("left_rho").isNotNull())
    out = []
    for name in names:
        rho, idx = (F.col(f"{name}{c}") if name else F.when(left, F.col(f"left_{c}")).otherwise(F.col(f"right_{c}")) for c in ("rho", "idx"))
        out.append(_measure(rho, window, distance).alias(f"{name}matrix_profile"))
        out += [F.coalesce(idx, F.lit(-1).cast("bigint")).alias(f"{name}profile_index")] if idxs else []
    return best.select("series_id", "pos", *out)


def _self(data: DataFrame, window: int, exclusion_zone: float, sample: Sample, distance: str = "euclidean", idxs: bool = True, sides: bool = False, tile: int = TILE) -> DataFrame:
    data = check(data)
    _guard(window)
    best = self_best(data, window, zone(window, exclusion_zone) + 1, sample, tile)
    rows = _sides(best, window, distance, idxs, *(("", "left_", "right_") if sides else ("",)))
    return rows.withColumn("partial", F.lit(sample.kind != "all")).withColumn("ez", F.lit(float(exclusion_zone)))


def _cross(data: DataFrame, query: DataFrame, window: int, distance: str = "euclidean", idxs: bool = True, both: bool = True, tile: int = TILE) -> DataFrame | tuple[DataFrame, DataFrame]:
    data, query = check(data), check(query)
    _guard(window)
    best = cross_best(data, query, window, tile)
    done = lambda rows: rows.withColumn("partial", F.lit(False)).withColumn("ez", F.lit(0.0))
    one = done(_columns(data, window, distance, idxs, matrix_profile__profile_index=best.filter("side = 'data'")))
    if not both:
        return one
    return one, done(_columns(query, window, distance, idxs, mpb__pib=best.filter("side = 'query'")))


def stamp(data: DataFrame, window: int, query: DataFrame | None = None, exclusion_zone: float = 0.5, s_size: float = 1.0, tile: int = TILE) -> DataFrame:
    """``s_size`` visits a share of the query windows in shuffled order. With ``query``: profile of the data side."""
    if query is not None:
        return _cross(data, query, window, both=False, tile=tile)
    return _self(data, window, exclusion_zone, Sample("queries", _share(s_size)), tile=tile)


def stomp(data: DataFrame, window: int, query: DataFrame | None = None, exclusion_zone: float = 0.5, left_right_profile: bool = False, tile: int = TILE) -> DataFrame:
    """``left_right_profile`` adds the best neighbours before and after each window. With ``query``: the data side."""
    if query is not None:
        return _cross(data, query, window, both=False, tile=tile)
    return _self(data, window, exclusion_zone, Sample(), sides=left_right_profile, tile=tile)


def scrimp(data: DataFrame, window: int, query: DataFrame | None = None, exclusion_zone: float = 0.5, s_size: float = 1.0, pre_scrimp: float = 0.25, tile: int = TILE) -> DataFrame | tuple[DataFrame, DataFrame]:
    """``s_size`` visits a share of the lags, smallest first, and all pairs of every ``floor(w * pre_scrimp)``-th window.

    With ``query``: profiles of the data side and of the query side.
    """
    if query is not None:
        return _cross(data, query, window, tile=tile)
    return _self(data, window, exclusion_zone, Sample("small lags", _share(s_size), int(window * pre_scrimp)), tile=tile)


def mpx(data: DataFrame, window: int, query: DataFrame | None = None, exclusion_zone: float = 0.5, s_size: float = 1.0, idxs: bool = True, distance: str = "euclidean", tile: int = TILE) -> DataFrame | tuple[DataFrame, DataFrame]:
    """``s_size`` visits a share of the lags in shuffled order; ``distance`` may be pearson, for correlations.

    With ``query``: profiles of the data side (matrix_profile, profile_index) and of the query side (mpb, pib).
    """
    if distance not in ("euclidean", "pearson"):
        raise ValueError("distance is euclidean or pearson")
    if query is not None:
        return _cross(data, query, window, distance, idxs, tile=tile)
    return _self(data, window, exclusion_zone, Sample("random lags", _share(s_size)), distance, idxs, tile=tile)


def mpx_right(data: DataFrame, window: int, exclusion_zone: float = 0.5, time_constraint: int | None = None, tile: int = TILE) -> DataFrame:
    """Left and right profile as correlations; ``time_constraint`` is the largest distance of two windows."""
    data = check(data)
    _guard(window)
    best = self_best(data, window, zone(window, exclusion_zone) + 1, None, tile, time_constraint)
    return _sides(best, window, "pearson", True, "left_", "right_")
