"""Profiles over streams.

``right_profile`` keeps, per series, the last ``history`` values and the right profile of their windows: for each window the
best partner that came later. ``fading`` keeps the sums of the recursive rolling statistics. Both give the same rows however
the stream is cut into micro-batches; rows arrive in order of ``pos`` and ones that lie before the last one taken in are
dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import folded
from ..plans.tiles import STEP, Groups, Windows, apart, gathered, is_small, numbered, runs, screened, shapes, squares
from ..sources import zone

_PROFILE = "series_id string, pos long, right_matrix_profile double, right_profile_index long"
_PACKS = "series_id string, pos binary, value binary"
#: Positions of a series whose last rows one task picks at once.
SPAN = 65_536


def _repeats(values: np.ndarray, best: np.ndarray, partner: np.ndarray, offset: int, old: int, window: int, low: int, threshold: float) -> None:
    """Take windows from ``old`` on in, for whole numbers of which many windows come again.

    A window whose shape comes again has correlation 1 there, which no later one exceeds. The others are compared with one of each set
    of new windows that differ by a constant; a partner is then the first of its set that is far enough.
    """
    count, before = len(best), best.copy()
    still = np.flatnonzero((best < 1) | (np.arange(count) >= old))  # others have their best partner
    valid, same, shape = shapes(values, window, still)
    known = valid[still]
    at, same, shape = still[known], same[known], numbered(shape[known])
    fresh = at >= old
    new, same = at[fresh], same[fresh]
    nearest = Groups(shape[fresh], new, count).next(shape, at + low)  # one held before would have been found before
    again = nearest < count
    best[at[again]], partner[at[again]] = 1.0, offset + nearest[again] + 1
    rest = at[best[at] < 1]
    group = numbered(same)
    sets = Groups(group, new, count)
    last = np.full(group.max(initial=-1) + 1, -1, np.int64)
    np.maximum.at(last, group, new)
    group = np.argsort(last)
    last = last[group]
    known = values[np.isfinite(values)]
    near_zero = values - np.rint(known.mean() if len(known) else 0.0)
    for r in range(0, len(rest), STEP):
        i = rest[r : r + STEP]
        x = Windows(near_zero, window, STEP, True, i)
        for c in range(0, len(last), STEP):
            j, of = last[c : c + STEP], group[c : c + STEP]
            if j[-1] < i[0] + low:
                continue
            far = j[None] < i[:, None] + low if j[0] < i[-1] + low else None
            rows, got, row, column = screened(x, Windows(near_zero, window, STEP, True, j), np.maximum(best[i], threshold), far)
            mine = i[rows]
            found = (got >= threshold) & (got > -np.inf) & ((got > best[mine]) | (got == best[mine]) & (best[mine] > before[mine]))
            row, column = row[found[row]], column[found[row]]
            place = np.full(len(rows), count)
            np.minimum.at(place, row, sets.next(of[column], mine[row] + low))
            mine, got, place = mine[found], got[found], place[found]
            partner[mine] = np.where(got > best[mine], offset + place + 1, np.minimum(partner[mine], offset + place + 1))
            best[mine] = got


def extend(values: np.ndarray, best: np.ndarray, partner: np.ndarray, offset: int, new: np.ndarray, window: int, low: int, history: int, high: int | None, exact: bool, threshold: float = -1.0):
    """State after ``new`` values, and the windows whose right profile changed (positions from 1, correlation, partner).

    ``offset`` counts the values before the first one held. Only windows of the new values are compared with those held, one
    square of STEP windows a side after the other; of whole numbers, windows that come again are compared once.
    """
    old = max(len(values) - window + 1, 0)
    values = np.concatenate((values, new))
    count = max(len(values) - window + 1, 0)
    best = np.concatenate((best, np.full(count - len(best), -np.inf)))
    partner = np.concatenate((partner, np.full(count - len(partner), -1, np.int64)))
    before = best.copy(), partner.copy()
    if count > old and exact and high is None and threshold <= 1 and is_small(values, window):
        _repeats(values, best, partner, offset, old, window, low, threshold)
    elif count > old:
        start = max(0, old - high) if high else 0
        for x in squares(values[start:], window, count - start, exact, start):
            for at in range(old, count, STEP):
                fresh = min(STEP, count - at)
                if at + fresh - 1 - x.first < low or high and at - (x.first + len(x) - 1) > high:
                    continue
                y = Windows(values[at : at + fresh + window - 1], window, fresh, exact)
                y.first = at
                rho = x.rho(y)
                apart(rho, x, y, low, high)
                rho[rho < threshold] = -np.inf
                nearest = rho.argmax(1)
                got = rho[np.arange(len(rho)), nearest]
                better = got > best[x.first : x.first + len(x)]
                rows = np.flatnonzero(better) + x.first
                best[rows], partner[rows] = got[better], offset + at + nearest[better] + 1
    changed = np.flatnonzero((best != before[0]) | (np.arange(count) >= old))
    out = (offset + changed + 1, best[changed], partner[changed])
    drop = max(len(values) - history, 0)
    return values[drop:], best[drop:], partner[drop:], offset + drop, out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each series and batch of rows. Spark hands a group's state over again with each 10,000 rows of it."""
    for rows in batches:
        packs = []
        for name, _, at, batch in runs(rows, 2**62):
            pos, value = (batch.column(k)[at.start : at.stop].to_numpy(zero_copy_only=False).astype(kind) for k, kind in ((1, "<i8"), (2, "<f8")))
            packs.append((name, pos.tobytes(), value.tobytes(), int(pos[0]), int(pos[-1])))
        if packs:
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*packs), (pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))], ["series_id", "pos", "value", "first", "last"])


def _packs(rows: DataFrame) -> DataFrame:
    """Rows (series_id, pos, value) packed, with the first and last position of each pack."""
    if dict(rows.dtypes)["pos"] == "binary":
        return rows
    return rows.selectExpr("series_id", "CAST(pos AS BIGINT) AS pos", "CAST(value AS DOUBLE) AS value").filter("pos IS NOT NULL").mapInArrow(_packed, f"{_PACKS}, first long, last long")


def _arrays(batches: Iterator[pa.RecordBatch], *kinds: str) -> Iterator[list]:
    """Rows of a name, arrays of these kinds as bytes, and more columns."""
    for batch in batches:
        for r in range(batch.num_rows):
            name, *rest = (batch.column(k)[r].as_py() for k in range(batch.num_columns))
            yield [name, *(np.frombuffer(x, kind) for x, kind in zip(rest, kinds)), *rest[len(kinds) :]]


def _profiles(name: str | None, pos: np.ndarray, best: np.ndarray, partner: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(pos.astype(np.int64)), pa.array(best, mask=partner < 0), pa.array(partner.astype(np.int64))]
    return pa.RecordBatch.from_arrays([pa.array([name] * len(pos), pa.string()), *columns], ["series_id", "pos", "right_matrix_profile", "right_profile_index"])


def right_profile(stream: DataFrame, window: int, history: int, exclusion_zone: float = 0.5, time_constraint: int | None = None, threshold: float = -1.0, exact: bool = False, packed: bool = False) -> DataFrame:
    """Update-mode rows (series_id, pos, right_matrix_profile, right_profile_index) of a stream of (series_id, pos, value).

    The profile is a correlation, null with index -1 while there is no partner. ``exact``: values are whole numbers.
    ``time_constraint`` limits how far apart partners are, ``threshold`` which correlations count. A window's last row holds.
    ``packed``: a row for each series and micro-batch, of arrays as bytes, for ``latest``.
    """
    if history < 2 * window:
        raise ValueError("history holds two windows at least")
    low = zone(window, exclusion_zone) + 1

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, offset, *held = state.get if state.exists else (0, 0, b"", b"", b"")
        packs = pd.concat(list(parts))  # of few rows
        pos, value = (np.concatenate([np.frombuffer(x, kind) for x in packs[c]]) for c, kind in (("pos", "<i8"), ("value", "<f8")))
        pos, first = np.unique(pos, return_index=True)
        pos, value = pos[pos > last], value[first[pos > last]]
        if not len(pos):
            return
        held = (np.frombuffer(bytes(x), kind) for x, kind in zip(held, ("<f8", "<f8", "<i8")))
        values, best, partner, offset, out = extend(*held, offset, value, window, low, history, time_constraint, exact, threshold)
        state.update((int(pos[-1]), int(offset), *(x.astype(kind).tobytes() for x, kind in ((values, "<f8"), (best, "<f8"), (partner, "<i8")))))
        best = np.minimum(out[1], 1.0)
        yield pd.DataFrame([(key[0], *(x.astype(kind).tobytes() for x, kind in ((out[0], "<i8"), (best, "<f8"), (out[2], "<i8"))))], columns=["series_id", "pos", "right_matrix_profile", "right_profile_index"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, *columns in _arrays(batches, "<i8", "<f8", "<i8"):
            yield _profiles(name, *columns)

    kept = "last long, offset long, values binary, best binary, partner binary"
    arrays = "series_id string, pos binary, right_matrix_profile binary, right_profile_index binary"
    rows = _packs(stream).select("series_id", "pos", "value").groupBy("series_id").applyInPandasWithState(step, arrays, kept, "update", GroupStateTimeout.NoTimeout)
    return rows if packed else rows.mapInArrow(unpack, _PROFILE)


def latest(rows: DataFrame) -> DataFrame:
    """The last row of each window of what ``replay`` returned for a packed ``right_profile``."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, pos, best, partner, batch in _arrays(batches, "<i8", "<f8", "<i8"):
            ends = np.searchsorted(pos, np.arange((pos[-1] - 1) // SPAN + 2) * SPAN, "right")
            parts = [(name, k, batch, *(x[a:b].tobytes() for x in (pos, best, partner))) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])) if b > a]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*parts), kinds)], ["series_id", "span", "batch", "pos", "best", "partner"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, span, parts in ([c[r].as_py() for c in x.columns] for x in batches for r in range(x.num_rows)):
            best, partner = np.zeros(SPAN), np.full(SPAN, -1, np.int64)
            seen = np.zeros(SPAN, bool)
            for part in sorted(parts, key=lambda p: p["batch"]):
                at = np.frombuffer(part["pos"], "<i8") - 1 - span * SPAN
                seen[at], best[at], partner[at] = True, np.frombuffer(part["best"], "<f8"), np.frombuffer(part["partner"], "<i8")
            at = np.flatnonzero(seen)
            yield _profiles(name, at + 1 + span * SPAN, best[at], partner[at])

    spans = rows.select("series_id", "pos", "right_matrix_profile", "right_profile_index", "batch").mapInArrow(split, "series_id string, span int, batch long, pos binary, best binary, partner binary")
    return gathered(spans, "series_id", "span").mapInArrow(merge, _PROFILE)


def fading(stream: DataFrame, window: int, eps: float = 0.90) -> DataFrame:
    """Append-mode rows (series_id, pos, mov_sum, mov_mean, mov_var) of the fading statistics; state is three sums."""
    a = eps ** (1 / window)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, sx, sq, s1 = state.get if state.exists else (0, 0.0, 0.0, 0.0)
        rows = pd.concat(list(parts)).drop_duplicates("pos").sort_values("pos")
        rows = rows[rows["pos"] > last]
        if not len(rows):
            return
        pos, x = rows["pos"].to_numpy(), rows["value"].to_numpy(float)
        sx, sq, s1 = (folded(u, a, start) for u, start in ((x, sx), (x * x, sq), (np.ones(len(x)), s1)))
        state.update((int(pos[-1]), float(sx[-1]), float(sq[-1]), float(s1[-1])))
        mean = sx / s1
        out = pd.DataFrame({"series_id": key[0], "pos": pos - window + 1, "mov_sum": sx, "mov_mean": mean, "mov_var": sq / s1 - mean * mean})
        yield out[pos >= window]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, pos, value, *_ in _arrays(batches, "<i8", "<f8"):
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(pos), pa.string()), pa.array(pos), pa.array(value)], ["series_id", "pos", "value"])

    rows = stream.mapInArrow(unpack, "series_id string, pos long, value double") if dict(stream.dtypes)["pos"] == "binary" else stream.selectExpr("series_id", "pos", "CAST(value AS DOUBLE) AS value")
    return rows.groupBy("series_id").applyInPandasWithState(step, "series_id string, pos long, mov_sum double, mov_mean double, mov_var double", "last long, sx double, sq double, s1 double", "append", GroupStateTimeout.NoTimeout)


def replay(series: DataFrame, folder: str, batches: int, run) -> DataFrame:
    """Run ``run(stream)`` over a series cut into micro-batches by position, and return all rows it emitted with ``batch``.

    ``folder`` must be one that every executor reaches.
    """
    spark = series.sparkSession
    _packs(series).write.parquet(f"{folder}/series")  # made once, a row for each 10,000 or so
    packs = spark.read.schema(f"{_PACKS}, first long, last long").parquet(f"{folder}/series")
    top = packs.agg(F.max("last")).first()[0] or 0
    size = max(1, -(-top // batches))

    def part(low: int):
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for name, pos, value, *_ in _arrays(rows, "<i8", "<f8"):
                a, b = np.searchsorted(pos, (low, low + size), "right")
                if b > a:
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([pos[a:b].tobytes()]), pa.array([value[a:b].tobytes()])], ["series_id", "pos", "value"])

        return run

    for k in range(batches):
        packs.filter(f"last > {k * size} AND first <= {(k + 1) * size}").mapInArrow(part(k * size), _PACKS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(_PACKS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")

    def keep(rows: DataFrame, batch: int) -> None:
        rows.selectExpr("*", f"{batch}L AS batch").write.mode("overwrite").parquet(f"{folder}/out/n={batch}")

    out = run(stream)
    mode = "update" if "right_matrix_profile" in out.columns else "append"
    out.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out").drop("n")
