"""Distance profiles: one query window against all windows of a series. Distances are squared and not below 0."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tiles import EPSILON, EXACT, blocks
from ..sources import check, haloed, is_exact, own
from .rolling import movmean_std, statistics

#: Windows of a block.
BLOCK = 1024
KINDS = ("normalized", "non_normalized", "absolute", "weighted")


def mass_pre(data: DataFrame, window: int, query: DataFrame | None = None, type: str = "normalized", weights: Sequence[float] | None = None) -> DataFrame:
    """Rolling statistics by side ('data', 'query'), series_id and pos, as ``mass`` uses them.

    normalized: avg, sd. absolute: sqrsum. weighted and non_normalized: avg, sd and, of data, pre (the weighted sum of the
    squared z-normalised window; weights are 1 for non_normalized).
    """
    weights = _weights(window, type, weights)
    sides = {"data": data, "query": data if query is None else query}

    def one(name: str, series: DataFrame) -> DataFrame:
        if type == "absolute":
            rows = statistics(series, window, sqrsum=F.col("q").cast("double"))
        else:
            rows = movmean_std(series, window).select("series_id", "pos", "avg", "sd")
            if type != "normalized" and name == "data":
                over = Window.partitionBy("series_id", "block").orderBy("pos").rowsBetween(0, window - 1)
                window_ = haloed(check(series), window - 1).select("series_id", "pos", "block", F.collect_list(F.col("value").cast("double")).over(over).alias("x")).filter(own()).drop("block")
                weigh = F.array(*(F.lit(float(w)) for w in weights))
                pre = F.expr("aggregate(zip_with(x, weigh, (a, b) -> b * power(try_divide(a - avg, sd), 2)), 0D, (s, v) -> s + v)")
                rows = rows.join(window_, ["series_id", "pos"]).withColumn("weigh", weigh).withColumn("pre", pre).drop("x", "weigh")
            elif type != "normalized":
                rows = rows.withColumn("pre", F.lit(None).cast("double"))
        return rows.withColumn("side", F.lit(name))

    return one("data", sides["data"]).unionByName(one("query", sides["query"]))


def _weights(window: int, type: str, weights: Sequence[float] | None) -> list[float]:
    if type not in KINDS:
        raise ValueError(f"type is one of {KINDS}")
    if type != "weighted":
        return [1.0] * window
    if weights is None or len(weights) != window:
        raise ValueError("type weighted needs one weight for each value of a window")
    return [float(w) for w in weights]


def mass(data: DataFrame, query: DataFrame, window: int, index: int = 1, type: str = "normalized", weights: Sequence[float] | None = None, version: str = "v3", tile: int = BLOCK) -> DataFrame:
    """series_id, pos, distance_profile, last_product of the window of ``query`` (one series) at ``index``.

    normalized: both windows z-normalised; non_normalized: the data window only; absolute: none; weighted: both, with weights
    on the squares. A flat window to be z-normalised is infinitely far. ``version`` names ways to the same result.
    """
    if version not in ("v2", "v3"):
        raise ValueError("version is v2 or v3")
    weigh, data, query = np.array(_weights(window, type, weights)), check(data), check(query)
    got = sorted((r["pos"], r["value"]) for r in query.filter(F.col("pos").between(index, index + window - 1)).select("pos", "value").collect())  # one window
    if index < 1 or len(got) != window:
        raise ValueError(f"query has no window at {index}")
    q, exact = np.array([v for _, v in got], float), is_exact(data) and is_exact(query) and not (weigh % 1).any()
    sq, sqq, wqq, wq, w1 = q.sum(), (q * q).sum(), (weigh * q * q).sum(), (weigh * q).sum(), weigh.sum()
    spread_q = window * sqq - sq * sq
    zq = (q - q.mean()) / max(q.std(), EPSILON)

    def whole(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From sums of whole numbers, without rounding up to the last steps."""
        dot, s, ss = x @ q, x.sum(1), (x * x).sum(1)
        if type == "absolute":
            return ss - 2 * dot + sqq, dot
        spread = window * ss - s * s
        if type == "normalized":
            return 2 * window * (1 - (window * dot - s * sq) / np.sqrt(spread * spread_q)), dot
        mean, sd = s / window, np.sqrt(spread) / window
        if type == "non_normalized":
            return window - 2 * ((dot - mean * sq) / sd) + sqq, dot
        mean_q, sd_q = sq / window, np.sqrt(spread_q) / window
        wx, wxx, wxq = x @ weigh, (x * x) @ weigh, x @ (weigh * q)
        own = (wxx - 2 * mean * wx + mean * mean * w1) / (sd * sd)
        other = (wqq - 2 * mean_q * wq + mean_q * mean_q * w1) / (sd_q * sd_q)
        cross = (wxq - mean * wq - mean_q * wx + mean * mean_q * w1) / (sd * sd_q)
        return own - 2 * cross + other, (wxq - mean_q * wx) / sd_q

    def any_(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        moved = x - x.mean(1, keepdims=True)
        z = moved / np.sqrt((moved * moved).mean(1))[:, None]
        if type == "absolute":
            return ((x - q) ** 2).sum(1), x @ q
        if type == "non_normalized":
            return ((z - q) ** 2).sum(1), x @ q
        return ((z - zq) ** 2) @ weigh, x @ (weigh * zq) if type == "weighted" else x @ q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                x = sliding_window_view(b.column(2)[r].values.to_numpy(zero_copy_only=False), window)[:tile]
                with np.errstate(all="ignore"):
                    top = max(np.nanmax(np.abs(x), initial=1.0), np.abs(q).max(), 1.0)
                    far, dot = (whole if exact and window * weigh.sum() * top * top < EXACT else any_)(x)
                flat = x.max(1) == x.min(1)
                bad = ~np.isfinite(far) if type == "absolute" else ~np.isfinite(far) | flat
                if type in ("normalized", "weighted") and q.max() == q.min():
                    bad[:] = True
                far = np.where(bad, np.inf, np.maximum(far, 0))
                n = len(x)
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[r].as_py()] * n, pa.string()), pa.array(np.arange(n) + b.column(1)[r].as_py() * tile + 1), pa.array(far), pa.array(np.asarray(dot, float))], ["series_id", "pos", "distance_profile", "last_product"])

    return blocks(data, window, tile, near_zero=False).select("series_id", "block", "values").mapInArrow(run, "series_id string, pos long, distance_profile double, last_product double")
