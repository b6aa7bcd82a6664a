"""All pairs of windows by tiles.

A series is cut into blocks of ``tile`` windows, each with the values they cover (``window - 1`` more than windows). A pair of
blocks is one row, dealt by its numbers over a fixed count of partitions, so a single long series uses every core. Within
a row the blocks meet in squares of at most STEP windows: the correlations of a square are one matrix product, and the best partner
of each window on either side leaves the task. Correlations don't change when a constant is taken off a side, so whole numbers
are first moved near 0; where sums of their products stay below 2**53 they are multiplied as they are, which is exact, and
otherwise z-normalised before the product, as other values are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import is_exact, tasks

TILE = 4096
#: Windows of a side of one matrix product.
STEP = 1024
#: Sums up to here are exact in double precision.
EXACT = 2.0**53
#: Deviation below which a window is flat and has no partner.
EPSILON = float(np.finfo(np.float64).eps)
_SCHEMA = "series_id string, side string, pos long, rho double, idx long"


def gathered(packs: DataFrame, *by: str) -> DataFrame:
    """Packed rows of equal ``by`` (series_id and a number) in one row, as ``parts``."""
    parts = F.collect_list(F.struct(*(c for c in packs.columns if c not in by))).alias("parts")
    return packs.repartition(tasks(packs.sparkSession), *by).groupBy(*by).agg(parts)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield [batch.column(k)[r] for k in range(batch.num_columns)]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _numbers(part: pa.Scalar, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(part.as_buffer() if part.is_valid else b"", kind)


def runs(batch: pa.RecordBatch, tile: int) -> Iterator[tuple[str | None, int, slice, pa.RecordBatch]]:
    """Rows (series_id, pos, ..) in order, as slices of one series and block each."""
    names = batch.column(0).dictionary_encode()
    code = names.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    pos = batch.column(1).to_numpy(zero_copy_only=False)
    if (np.diff(code) != 0).any() or (np.diff(pos) <= 0).any():
        order = np.lexsort((pos, code))
        batch, code, pos = batch.take(pa.array(order)), code[order], pos[order]
    block = (pos - 1) // tile
    at = np.flatnonzero((np.diff(code) != 0) | (np.diff(block) != 0)) + 1
    for start, end in zip([0, *at], [*at, len(pos)]):
        if end > start:
            yield (None if code[start] < 0 else names.dictionary[int(code[start])].as_py()), int(block[start]), slice(int(start), int(end)), batch


def blocks(series: DataFrame, window: int, tile: int = TILE, near_zero: bool = True) -> DataFrame:
    """series_id, block, length (of the series), small (whole numbers whose products are summed exactly) and the block's values
    in order, missing ones as NaN.

    With ``near_zero``, the least value of a block of whole numbers is taken off all of them before they become doubles. Rows
    travel packed, a chunk of a block each.
    """
    exact, reach = is_exact(series), (window - 2) // tile + 1
    kind = "<i8" if exact else "<f8"
    packed = pa.schema([("series_id", pa.string()), ("block", pa.int32()), ("own", pa.int64()), ("pos", pa.binary()), ("value", pa.binary()), ("gone", pa.binary())])
    whole = pa.schema([("series_id", pa.string()), ("block", pa.int32()), ("own", pa.int64()), ("least", pa.float64()), ("most", pa.float64()), ("values", pa.list_(pa.float64()))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out, last = [], None
            for name, block, at, batch in runs(rows, tile):
                if batch is not last:
                    last, value = batch, batch.column(2)
                    pos = batch.column(1).to_numpy(zero_copy_only=False).astype("<i8")
                    gone = value.is_null().to_numpy(zero_copy_only=False)
                    number = value.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
                for b in range(max(block - reach, 0), block + 1):
                    end = at.start + int(np.searchsorted(pos[at], b * tile + tile + window - 1, "right"))
                    if end > at.start:
                        part = slice(at.start, end)
                        out.append((name, b, (at.stop - at.start) if b == block else 0, pos[part].tobytes(), number[part].tobytes(), gone[part].tobytes() if gone[part].any() else b""))
            if out:
                yield _table(out, packed)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block, parts in _rows(batches):
            parts = parts.values
            own, *parts = (parts.field(k) for k in range(4))
            pos, value = (np.concatenate([_numbers(x, k) for x in part]) for part, k in zip(parts, ("<i8", kind)))
            gone = np.concatenate([_numbers(x, "?") if len(x.as_buffer()) else np.zeros(len(p.as_buffer()) // 8, bool) for x, p in zip(parts[2], parts[0])])
            order = np.argsort(pos, kind="stable")
            value, gone = value[order], gone[order]
            known = value[~gone] if exact else value[~gone & np.isfinite(value)]
            least, most = (int(known.min()), int(known.max())) if exact and len(known) else (0, 0)
            if exact and near_zero and most - least < 2**63:
                value = value - least
            out = value.astype(float)
            if exact and near_zero and most - least >= 2**63:
                out -= float(least)
            out[gone] = np.nan
            none = None if not exact or not len(known) else 0
            yield _table([(name.as_py(), block.as_py(), int(own.to_numpy().sum()), none if none is None else float(least), none if none is None else float(most), out)], whole)

    packs = series.select("series_id", "pos", F.col("value").cast("bigint" if exact else "double").alias("value")).mapInArrow(pack, "series_id string, block int, own long, pos binary, value binary, gone binary")
    rows = gathered(packs, "series_id", "block").mapInArrow(join, "series_id string, block int, own long, least double, most double, values array<double>")
    small = F.lit(False) if not exact else F.expr(f"coalesce(pow({window} * greatest(max(most) - min(least), 1D), 2) < {EXACT}D, false)")
    lengths = rows.groupBy("series_id").agg(F.sum("own").alias("length"), small.alias("small"))
    rows = rows.filter(F.size("values") >= window).join(F.broadcast(lengths), "series_id")
    return rows.select("series_id", "block", "length", "small", "values")


class Windows:
    """The windows of a block, ready for correlation. ``exact``: the values are whole numbers."""

    def __init__(self, values: np.ndarray, window: int, tile: int, exact: bool, picked: np.ndarray | None = None):
        if exact and picked is None:
            known = values[np.isfinite(values)]
            values = values - np.rint(known.mean() if len(known) else 0.0)
            top = float(np.abs(known - np.rint(known.mean())).max()) if len(known) else 0.0
            exact = (window * max(top, 1.0)) ** 2 < EXACT
        view = sliding_window_view(values, window)
        view = view[:tile] if picked is None else view[picked]  # picked ones are of values near 0 already
        finite = np.isfinite(view).all(1)
        self.view = view if finite.all() else np.where(finite[:, None], view, 0.0)
        self.exact, self.w, self.first, self._z, self._short = exact, window, 0, None, None
        if exact:
            self.s = self.view.sum(1)
            self.spread = window * np.einsum("ij,ij->i", self.view, self.view) - self.s * self.s
            self.valid = finite & (self.spread > 0)
        else:
            sd = self.view.std(1)
            self.valid = finite & (sd >= EPSILON)

    def __len__(self) -> int:
        return len(self.view)

    def taken(self, places: np.ndarray) -> Windows:
        """The windows at these places of the series (from 0), ascending."""
        part = Windows.__new__(Windows)
        part.__dict__ |= self.__dict__
        at = places[(places >= self.first) & (places < self.first + len(self))] - self.first
        part.at = at + self.first
        part.view, part.valid, part._z = self.view[at], self.valid[at], None if self._z is None else self._z[at]
        part._short = None if self._short is None else self._short[at]
        if self.exact:
            part.s, part.spread = self.s[at], self.spread[at]
        return part

    def z(self) -> np.ndarray:
        """Windows of mean 0 and length 1."""
        if self._z is None:
            moved = self.view - self.view.mean(1, keepdims=True)
            sd = np.sqrt((moved * moved).mean(1))
            self._z = moved / (np.where(self.valid, sd, 1.0) * np.sqrt(self.w))[:, None]
        return self._z

    def roughly(self, other: Windows) -> np.ndarray:
        """Correlations in single precision, at most ``slack`` off: a third of the time of exact ones."""
        for part in (self, other):
            if part._short is None:
                part._short, part._z = part.z().astype(np.float32), None
        return self._short @ other._short.T

    def slack(self) -> float:
        """A bound of the rounding of ``roughly``: less than w + 2 roundings of 2**-24 of products whose sizes sum to 1 at most."""
        return (self.w + 8) * 2.0**-23

    def pairs(self, other: Windows, row: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Some cells of ``rho``, of whole numbers."""
        cross = self.w * np.einsum("ij,ij->i", self.view[row], other.view[column]) - self.s[row] * other.s[column]
        return cross / np.sqrt(self.spread[row] * other.spread[column])

    def rho(self, other: Windows) -> np.ndarray:
        if self.exact and other.exact:
            cross = np.hstack((self.w * self.view, -self.s[:, None])) @ np.hstack((other.view, other.s[:, None])).T
            with np.errstate(all="ignore"):
                scale = np.multiply.outer(self.spread, other.spread)
                np.sqrt(scale, out=scale)
                cross /= scale
        else:
            cross = self.z() @ other.z().T
        if not self.valid.all():
            cross[~self.valid] = -np.inf
        if not other.valid.all():
            cross[:, ~other.valid] = -np.inf
        return cross


def screened(x: Windows, y: Windows, floor: np.ndarray, far: np.ndarray | None = None, rough: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``x`` that have a correlation of ``floor`` or more in ``y``, the highest, and its cells as (place in rows, column).

    For exact windows. ``far``: cells to leave out. Correlations in single precision (``rough``) tell which cells may be highest; only those
    are computed exactly.
    """
    rough = x.roughly(y) if rough is None else rough
    if far is not None or not (x.valid.all() and y.valid.all()):
        out = ~x.valid[:, None] | ~y.valid[None]
        out = out if far is None else out | far
        rough = np.where(out, np.float32(-4), rough)
    top = rough.max(1).astype(float)
    rows = np.flatnonzero((top >= floor - x.slack()) & (top > -2))
    row, column = np.nonzero(rough[rows] >= (top[rows, None] - 2.5 * x.slack()).astype(np.float32))
    if 64 * len(row) > rough.size:  # many are alike
        rho = x.rho(y)[rows]
        if far is not None:
            rho[far[rows]] = -np.inf
        got = rho.max(1)
        row, column = np.nonzero(rho == got[:, None])
    else:
        rho, got = x.pairs(y, rows[row], column), np.full(len(rows), -np.inf)
        np.maximum.at(got, row, rho)
        best = rho == got[row]
        row, column = row[best], column[best]
    return rows, got, row, column


def spans(values: np.ndarray, width: int, join: np.ufunc) -> np.ndarray:
    """``join`` over each ``width`` values in a row, for one that may meet a value twice."""
    size = 1
    while 2 * size <= width:
        values, size = join(values[:-size], values[size:]), 2 * size
    return join(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def shapes(values: np.ndarray, window: int, open_: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each window of whole numbers has a partner at all (known and not flat), and 128-bit hashes of its steps and of its shape.

    With ``open_``, hashes are only of the windows at these places, ascending.
    Windows of equal steps differ by a constant, so they correlate alike, to the last bit, with any other. Those of one shape, steps
    divided by their greatest common divisor, correlate with 1 exactly.
    """
    known = np.isfinite(values)
    steps = np.diff(np.where(known, values, 0.0).astype(np.int64))
    common = spans(steps, window - 1, np.gcd)
    valid = spans(known, window, np.logical_and) & (common > 0)
    by = np.random.default_rng(11).integers(0, 2**63, (window - 1, 2), np.uint64) * np.uint64(2) + np.uint64(1)
    same = np.stack([np.correlate(steps.view(np.uint64), by[:, h], "valid") for h in range(2)], 1)
    if open_ is not None:
        same, common = same[open_], common[open_]
    shape, view = same.copy(), sliding_window_view(steps, window - 1)
    multiple = np.flatnonzero(common > 1)  # few in most series
    for k in range(0, len(multiple), STEP):
        at = multiple[k : k + STEP]
        rows = view[at if open_ is None else open_[at]] // common[at, None]
        shape[at] = rows.view(np.uint64) @ by
    return valid, same, shape


def numbered(keys: np.ndarray) -> np.ndarray:
    """Whole numbers from 0, equal for equal rows of ``keys``."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    new = (keys[order[1:]] != keys[order[:-1]]).any(1)
    out = np.empty(len(keys), np.int64)
    out[order] = np.concatenate((np.zeros(min(len(keys), 1), np.int64), np.cumsum(new)))
    return out


class Groups:
    """Members of groups in order: which is the first at or after a place."""

    def __init__(self, group: np.ndarray, at: np.ndarray, end: int):
        self.end, self.code = end, np.sort(group * end + at)

    def next(self, group: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The place of the first member, ``end`` where there is none."""
        k = np.searchsorted(self.code, group * self.end + np.minimum(place, self.end))
        found = self.code[np.minimum(k, len(self.code) - 1)] if len(self.code) else np.full(len(k), -1)
        return np.where((k < len(self.code)) & (found // self.end == group) & (place < self.end), found % self.end, self.end)


def is_small(values: np.ndarray, window: int) -> bool:
    """Whether products of any two windows of whole numbers are summed exactly, once moved near 0."""
    known = values[np.isfinite(values)]
    return not len(known) or (window * max(float(known.max() - known.min()), 1.0)) ** 2 < EXACT


def squares(values: np.ndarray, window: int, tile: int, exact: bool, first: int = 0) -> Iterator[Windows]:
    """The windows of a block whose first one is at ``first`` (from 0), STEP at a time."""
    for at in range(0, min(tile, len(values) - window + 1), STEP):
        part = Windows(values[at : at + STEP + window - 1], window, min(STEP, tile - at), exact)
        part.first = first + at
        yield part


def apart(rho: np.ndarray, x: Windows, y: Windows, low: int, high: int | None) -> None:
    """Strike out pairs of windows less than ``low`` or more than ``high`` positions from ``x`` on to ``y``."""
    if y.first - (x.first + len(x) - 1) < low or high is not None and y.first + len(y) - 1 - x.first > high:
        lag = (np.arange(len(y)) + y.first)[None] - (np.arange(len(x)) + x.first)[:, None]
        rho[(lag < low) if high is None else (lag < low) | (lag > high)] = -np.inf


def _dealt(pairs: DataFrame, *by: str) -> DataFrame:
    """Pairs of blocks over the session's partitions."""
    return pairs.repartition(tasks(pairs.sparkSession), "series_id", *by)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A fixed shuffle of whole numbers, for sampling."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _chosen(n: int, share: float) -> np.ndarray:
    keep = np.zeros(n, bool)
    keep[np.argsort(_mixed(np.arange(n)), kind="stable")[: int(n * share + 0.5)]] = True
    return keep


class Sample:
    """Which pairs a partial computation visits: all; a share of the lags, random or smallest; a share of the queries."""

    def __init__(self, kind: str = "all", share: float = 1.0, step: int = 0):
        self.kind, self.share, self.step = ("all" if share >= 1 else kind), share, step

    def mask(self, i: np.ndarray, j: np.ndarray, low: int, n: int) -> np.ndarray | None:
        """For windows ``i`` and their partners ``j`` (from 0), of lags from ``low`` on in a series of ``n`` windows."""
        if self.kind == "all":
            return None
        if self.kind == "queries":
            return np.broadcast_to(_chosen(n, self.share)[j], (len(i), len(j)))
        lag = np.abs(j[None] - i[:, None])
        many = max(n - low, 0)
        if self.kind == "random lags":
            keep = np.zeros(n + 1, bool)
            keep[low : low + many] = _chosen(many, self.share)
            return keep[lag]
        small = lag < low + int(many * self.share + 0.5)
        if self.step:
            small |= (i % self.step == 0)[:, None] | (j % self.step == 0)[None]
        return small


def _highest(rho: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The highest correlation of each row, and its position."""
    at = rho.argmax(1)  # the first of equal ones
    return rho[np.arange(len(rho)), at], first + at + 1


def _best(rho: np.ndarray, first: int, keys: np.ndarray, side: str, name: str, out: list) -> None:
    best, at = _highest(rho, first)
    ok = np.isfinite(best)
    if ok.any():
        out.append((name, side, keys[ok], best[ok], at[ok]))


def _batch(out: list) -> pa.RecordBatch:
    name, side, pos, rho, idx = zip(*out)
    n = [len(p) for p in pos]
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(name, object), n), pa.string()), pa.array(np.repeat(np.array(side, object), n), pa.string()), pa.array(np.concatenate(pos)), pa.array(np.concatenate(rho)), pa.array(np.concatenate(idx))], ["series_id", "side", "pos", "rho", "idx"])


def _known(cut: DataFrame, window: int, low: int, tile: int) -> DataFrame:
    """series_id, block and numbers (pos from 0, left, right) of its windows that have partners at all, packed in parts.

    Left and right are, of the windows of that shape, the lowest at most ``pos - low`` and at least ``pos + low``, or -1. Those
    correlate with 1, which is the most. In series of values too large for exact sums each has a shape of its own. Windows meet those
    of their shape in buckets by hash.
    """
    hashed = pa.schema([("series_id", pa.string()), ("bucket", pa.int64()), ("block", pa.int32()), ("keys", pa.binary())])
    found = pa.schema([("series_id", pa.string()), ("block", pa.int32()), ("numbers", pa.binary())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block, length, small, values in _rows(batches):
            name, b = name.as_py(), block.as_py()
            valid, _, shape = shapes(values.values.to_numpy(zero_copy_only=False), window)
            at = np.flatnonzero(valid[:tile])
            pos = at + b * tile
            keys = np.column_stack((pos, shape[at].view(np.int64) if small.as_py() else np.column_stack((pos, pos))))
            count = 8 + (length.as_py() >> 20)
            bucket = keys[:, 1] % count
            yield _table([(name, k, b, keys[bucket == k].astype("<i8").tobytes()) for k in range(count) if k == 0 or (bucket == k).any()], hashed)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, parts in _rows(batches):
            every, keys = np.unique(parts.values.field(0).to_numpy()), np.concatenate([_numbers(x) for x in parts.values.field(1)]).reshape(-1, 3)
            keys = keys[np.lexsort(keys.T)]
            pos = keys[:, 0]
            new = np.concatenate(([True], (keys[1:, 1:] != keys[:-1, 1:]).any(1)))[: len(keys)]
            group = np.cumsum(new)
            lowest = pos[np.flatnonzero(new)][group - 1] if len(pos) else pos
            end = int(pos.max(initial=0)) + low + 1
            code = group * end + pos
            k = np.minimum(np.searchsorted(code, code + low), len(code) - 1)
            right = np.where((code[k] >= code + low) & (group[k] == group), pos[k], -1) if len(pos) else pos
            numbers = np.column_stack((pos, np.where(lowest <= pos - low, lowest, -1), right))[np.argsort(pos)]
            at = np.searchsorted(numbers[:, 0], np.append(every, every[-1] + 1).astype(np.int64) * tile)
            yield _table([(name.as_py(), int(b), numbers[x:y].astype("<i8").tobytes()) for b, x, y in zip(every, at, [*at[1:]])], found)

    marked = cut.select("series_id", "block", "length", "small", "values").mapInArrow(mark, "series_id string, bucket long, block int, keys binary")
    return gathered(marked, "series_id", "bucket").mapInArrow(meet, "series_id string, block int, numbers binary")


def _again(series: DataFrame, cut: DataFrame, window: int, low: int, tile: int) -> DataFrame:
    """The rows of ``_known``: series_id, pos, left, right (null where there is none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, part in _rows(batches):
            x = _numbers(part).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(x), pa.string()), *(pa.array(x[:, k], mask=x[:, k] < 0) for k in range(3))], ["series_id", "pos", "left", "right"])

    return _known(cut, window, low, tile).mapInArrow(run, "series_id string, pos long, left long, right long")


class _Best:
    """The best partner so far of each window of a block: the highest correlation, then the lowest position."""

    def __init__(self, first: int, count: int):
        self.first, self.rho, self.idx = first, np.full(count, -np.inf), np.full(count, -1, np.int64)

    def take(self, at: np.ndarray, rho: np.ndarray, idx: np.ndarray) -> None:
        """``at``: places of windows in the series, each once."""
        at = at - self.first
        better = (rho > self.rho[at]) | (rho == self.rho[at]) & (rho > -np.inf) & (idx < self.idx[at])
        at = at[better]
        self.rho[at], self.idx[at] = rho[better], idx[better]

    def join(self, mine: Windows, at: np.ndarray, other: Windows, far: np.ndarray | None, rough: np.ndarray | None = None) -> None:
        """Take windows ``mine``, which lie at ``at``, against ``other``."""
        rows, got, row, column = screened(mine, other, self.rho[at - self.first], far, rough)
        if len(rows):
            lowest = np.full(len(rows), len(other))
            np.minimum.at(lowest, row, column)
            self.take(at[rows], got, other.first + lowest + 1)

    def packed(self) -> tuple[bytes, bytes, bytes]:
        at = np.flatnonzero(self.idx > 0)
        return (at + self.first).astype("<i8").tobytes(), self.rho[at].astype("<f8").tobytes(), self.idx[at].astype("<i8").tobytes()


def self_best(series: DataFrame, window: int, low: int, sample: Sample | None = None, tile: int = TILE, high: int | None = None) -> DataFrame:
    """series_id, pos and the best partner of each window before it (left_rho, left_idx) and after it (right_), ``low`` to ``high`` positions away.

    Of equally good partners the one at the lowest position; null where there is none. A series of less than twice the window's
    length fails the query.
    """
    exact, sample = is_exact(series), sample or Sample()
    cut = blocks(series, window, tile)
    each = cut.withColumns({"ask_left": F.lit(None).cast("array<long>"), "ask_right": F.lit(None).cast("array<long>")})
    known = _known(cut, window, low, tile) if exact and sample.kind == "all" and not high else None

    def open_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("series_id", pa.string()), ("block", pa.int32()), ("ask_left", pa.list_(pa.int64())), ("ask_right", pa.list_(pa.int64()))])
        for name, block, parts in _rows(batches):
            x = np.concatenate([_numbers(p) for p in parts.values.field(0)]).reshape(-1, 3)
            yield _table([(name.as_py(), block.as_py(), *(np.sort(x[x[:, k] < 0, 0]) for k in (1, 2)))], schema)

    if known is not None:  # windows whose shape doesn't come again ask all others
        asks = gathered(known, "series_id", "block").mapInArrow(open_, "series_id string, block int, ask_left array<long>, ask_right array<long>")
        each = cut.join(asks, ["series_id", "block"])
    asked = each.select("series_id", "block", F.expr("coalesce(size(ask_left) > 0, true)").alias("to_left"), F.expr("coalesce(size(ask_right) > 0, true)").alias("to_right"))
    wanted = asked.select("series_id", F.col("block").alias("b"), "to_left").join(asked.select("series_id", F.col("block").alias("a"), "to_right"), "series_id").filter("a <= b AND (to_left OR to_right)")
    pairs = wanted.select("series_id", "a", "b").join(each.select("series_id", F.col("block").alias("b"), "length", F.col("values").alias("later"), "ask_left"), ["series_id", "b"])
    pairs = pairs.join(each.select("series_id", F.col("block").alias("a"), F.col("values").alias("earlier"), "ask_right"), ["series_id", "a"])
    packed = pa.schema([("series_id", pa.string()), ("block", pa.int32()), ("side", pa.int32()), ("pos", pa.binary()), ("rho", pa.binary()), ("idx", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                name, a, b, n = (batch.column(k)[r].as_py() for k in range(4))
                n -= window - 1
                if b * tile - (a + 1) * tile + 1 > (high or n):
                    continue
                earlier, later = (list(squares(batch.column(k)[r].values.to_numpy(zero_copy_only=False), window, tile, exact, c * tile)) for k, c in ((4, a), (5, b)))
                to_right, to_left = (batch.column(k)[r].values.to_numpy(zero_copy_only=False) if batch.column(k)[r].is_valid else None for k in (6, 7))
                left, right = _Best(b * tile, tile), _Best(a * tile, tile)
                for x in earlier:
                    for y in later:
                        if y.first < x.first or y.first - (x.first + len(x) - 1) > (high or n):
                            continue
                        if to_right is not None:
                            some_x, some_y = x.taken(to_right), y.taken(to_left)
                            if len(some_x) + len(some_y) < (len(x) + len(y)) // 2:
                                for mine, other, into in ((some_x, y, right), (some_y, x, left)):
                                    if not len(mine):
                                        continue
                                    far = ((np.arange(len(other)) + other.first)[None] - mine.at[:, None]) * (1 if into is right else -1) < low if y.first - (x.first + len(x) - 1) < low else None
                                    if mine.exact and other.exact:
                                        into.join(mine, mine.at, other, far)
                                    else:
                                        rho = mine.rho(other)
                                        if far is not None:
                                            rho[far] = -np.inf
                                        into.take(mine.at, *_highest(rho, other.first))
                                continue
                        i, j = np.arange(len(x)) + x.first, np.arange(len(y)) + y.first
                        if x.exact and y.exact and sample.kind == "all" and not high:
                            far, rough = j[None] - i[:, None] < low if y.first - i[-1] < low else None, x.roughly(y)
                            right.join(x, i, y, far, rough)
                            left.join(y, j, x, None if far is None else far.T, rough.T)
                            continue
                        rho = x.rho(y)
                        apart(rho, x, y, low, high)
                        forth, back = rho, rho.T
                        if sample.kind != "all":
                            forth = np.where(sample.mask(i, j, low, n), rho, -np.inf)
                            back = np.where(sample.mask(j, i, low, n), rho.T, -np.inf)
                        right.take(i, *_highest(forth, y.first))
                        left.take(j, *_highest(back, x.first))
                yield _table([(name, b, 0, *left.packed()), (name, a, 1, *right.packed())], packed)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, block, parts in _rows(batches):
            first, parts = block.as_py() * tile, parts.values
            sides = parts.field(0).to_numpy()
            count = -int(sides.min())
            both = _Best(first, count), _Best(first, count)
            for k in np.flatnonzero(sides >= 0):
                pos, rho, idx = (_numbers(parts.field(c)[k], kind) for c, kind in ((1, "<i8"), (2, "<f8"), (3, "<i8")))
                if sides[k] == 2:
                    pos, *partner = pos.reshape(-1, 3).T
                    for side, of in zip(both, partner):
                        side.take(pos[of >= 0], np.ones((of >= 0).sum()), of[of >= 0] + 1)
                else:
                    both[sides[k]].take(pos, rho, idx)
            columns = [pa.array(x, mask=side.idx < 0) for side in both for x in (side.rho, side.idx)]
            yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * count, pa.string()), pa.array(np.arange(first + 1, first + count + 1)), *columns], ["series_id", "pos", "left_rho", "left_idx", "right_rho", "right_idx"])

    found = _dealt(pairs, "a", "b").select("series_id", "a", "b", "length", "earlier", "later", "ask_right", "ask_left").mapInArrow(run, "series_id string, block int, side int, pos binary, rho binary, idx binary")
    n = series.groupBy("series_id").agg(F.count("*").alias("n"))
    wrong = F.raise_error(F.concat(F.lit(f"window {window} is more than half of series "), "series_id")).cast("bigint")
    n = n.select("series_id", F.when(F.ceil(F.col("n") / 2) < window, wrong).otherwise(F.col("n") - window + 1).alias("n"))
    counts = n.select("series_id", "n", F.explode(F.expr(f"sequence(0, CAST((n - 1) DIV {tile} AS INT))")).alias("block"))
    empty = F.lit(b"")  # sides: 0 left, 1 right, 2 both as known, and minus the number of windows
    every = counts.select("series_id", "block", F.expr(f"CAST(-least(n - CAST(block AS BIGINT) * {tile}, {tile}) AS INT)").alias("side"), *(empty.alias(c) for c in ("pos", "rho", "idx")))
    found = found.unionByName(every)
    if known is not None:
        found = found.unionByName(known.select("series_id", "block", F.lit(2).alias("side"), F.col("numbers").alias("pos"), empty.alias("rho"), empty.alias("idx")))
    return gathered(found, "series_id", "block").mapInArrow(finish, "series_id string, pos long, left_rho double, left_idx long, right_rho double, right_idx long")


def cross_best(data: DataFrame, query: DataFrame, window: int, tile: int = TILE) -> DataFrame:
    """Best partner in the query of each data window (side 'data') and the reverse ('query'), for equal series_id."""
    exact = is_exact(data) and is_exact(query)
    left = blocks(data, window, tile).select("series_id", F.col("block").alias("a"), F.col("values").alias("x"))
    right = blocks(query, window, tile)
    counts = right.groupBy("series_id").agg(F.max("block").alias("last"))
    pairs = left.join(counts, "series_id").withColumn("b", F.explode(F.expr("sequence(0, last)")))
    pairs = pairs.join(right.select("series_id", F.col("block").alias("b"), F.col("values").alias("y")), ["series_id", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                name, a, b = (batch.column(k)[r].as_py() for k in range(3))
                xs, ys = (list(squares(batch.column(k)[r].values.to_numpy(zero_copy_only=False), window, tile, exact, c * tile)) for k, c in ((3, a), (4, b)))
                for x in xs:
                    for y in ys:
                        rho, out = x.rho(y), []
                        _best(rho, y.first, np.arange(len(x)) + x.first + 1, "data", name, out)
                        _best(rho.T, x.first, np.arange(len(y)) + y.first + 1, "query", name, out)
                        if out:
                            yield _batch(out)

    return _reduced(_dealt(pairs, "a", "b").select("series_id", "a", "b", "x", "y").mapInArrow(run, _SCHEMA))


def _reduced(found: DataFrame) -> DataFrame:
    best = found.groupBy("series_id", "side", "pos").agg(F.max("rho").alias("rho"), F.max_by("idx", F.struct("rho", -F.col("idx"))).alias("idx"))
    return best
