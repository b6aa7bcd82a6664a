"""Contrast profile: what is common within positive series and missing from negative ones."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tiles import TILE
from ..sources import check
from .profile import mpx


def contrast_profile(negative: DataFrame, positive: DataFrame, window: int, positive_matrix: DataFrame | None = None, exclusion_zone: float = 0.5, distance: str = "euclidean", tile: int = TILE) -> DataFrame:
    """series_id, pos, contrast_profile, nn_idx of each positive window, for equal series_id in both tables.

    ``positive_matrix`` is a self profile of ``positive`` with matrix_profile and profile_index; it is made if not given.
    """
    far, _ = mpx(positive, window, negative, distance=distance, tile=tile)
    near = positive_matrix if positive_matrix is not None else mpx(positive, window, exclusion_zone=exclusion_zone, distance=distance, tile=tile)
    rows = near.select("series_id", "pos", F.col("matrix_profile").alias("aa"), F.col("profile_index").alias("nn_idx")).join(far.select("series_id", "pos", F.col("matrix_profile").alias("ab")), ["series_id", "pos"])
    if distance == "pearson":
        value = F.greatest(F.lit(0.0), F.greatest(F.coalesce("aa", F.lit(0.0)), F.lit(0.0)) - F.greatest(F.coalesce("ab", F.lit(0.0)), F.lit(0.0)))
    else:
        top = F.lit(math.sqrt(2.0 * window))
        value = F.greatest(F.lit(0.0), (F.least("ab", top) - F.least("aa", top)) / top)
    return rows.select("series_id", "pos", value.alias("contrast_profile"), "nn_idx")


def contrast(negative: DataFrame, positive: DataFrame, window: int, positive_matrix: DataFrame | None = None, exclusion_zone: float = 0.5, distance: str = "euclidean", tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """The profile and, by series, plato_idx (its first maximum), plato_nn_idx, and the windows plato and plato_nn."""
    profile = contrast_profile(negative, positive, window, positive_matrix, exclusion_zone, distance, tile)
    top = profile.groupBy("series_id").agg(F.max_by(F.struct("pos", "nn_idx"), F.struct("contrast_profile", -F.col("pos"))).alias("t"))
    top = top.select("series_id", F.col("t.pos").alias("plato_idx"), F.nullif(F.col("t.nn_idx"), F.lit(-1)).alias("plato_nn_idx"))
    values = check(positive)

    def cut(at: str, name: str) -> DataFrame:
        rows = values.join(top.select("series_id", at), "series_id").filter(f"pos BETWEEN {at} AND {at} + {window - 1}")
        return rows.groupBy("series_id").agg(F.expr("transform(array_sort(collect_list(struct(pos, value))), x -> CAST(x.value AS DOUBLE))").alias(name))

    full = top.join(cut("plato_idx", "plato"), "series_id", "left").join(cut("plato_nn_idx", "plato_nn"), "series_id", "left")
    return profile, full.withColumn("w", F.lit(window)).withColumn("ez", F.lit(float(exclusion_zone))).withColumn("euclidean", F.lit(distance == "euclidean"))
