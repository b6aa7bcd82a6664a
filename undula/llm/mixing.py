"""Mixing sources to target weights by Pfair scheduling.

The rows of a source form blocks. Block i (from 1) of a source of weight w is released at slot ``floor((i - 1) / w)`` and due
at ``ceil(i / w)``; each slot takes the released block that is due first. So after every slot each source is less than one
block away from its share. Weights are taken as given, as exact fractions: the driver plans a slot for each block (8 bytes),
or one period where the weights' common period is shorter than that, and a block finds its slot from its number. Once a
source runs out, a new phase starts in which the others keep their proportions; every row gets a place.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added
from .packing import ranked

#: Rows of a block, and the power of a source's size that gives its default weight.
BLOCK, TEMPER = 16, 0.7


def whole_weights(weights: Mapping[str, float], period: int) -> dict[str, int]:
    """Weights rounded to a period of about ``period`` slots."""
    total = sum(weights.values())
    return {s: max(1, round(period * w / total)) for s, w in weights.items()}


def exact_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """The smallest whole numbers in exactly the proportions of ``weights``."""
    if bad := {s: w for s, w in weights.items() if not 0 <= w < math.inf}:
        raise ValueError(f"weights have to be finite and not negative: {bad}")
    parts = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*(w.denominator for w in parts.values()))
    whole = {s: int(w * unit) for s, w in parts.items()}
    common = math.gcd(*whole.values()) or 1
    return {s: w // common for s, w in whole.items()}


def one_period(weights: Mapping[str, int], blocks: Mapping[str, int] | None = None) -> dict[str, np.ndarray]:
    """Slots, within one period, of each source's blocks; only up to the slot that takes the last of a source's ``blocks``."""
    total = sum(weights.values())
    out: dict[str, list[int]] = {s: [] for s in weights}
    waiting = [(0, -(-total // w), s, 1) for s, w in sorted(weights.items())]  # release, deadline, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    slot = 0
    while slot < total:
        while waiting and waiting[0][0] <= slot:
            _, due, s, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due, s, i))
        _, s, i = heapq.heappop(ready)
        out[s].append(slot)
        slot += 1
        if blocks and i == blocks[s]:
            break
        if i < weights[s]:
            heapq.heappush(waiting, (i * total // weights[s], -(-(i + 1) * total // weights[s]), s, i + 1))
    return {s: np.array(v, np.int64) for s, v in out.items()}


def phases(blocks: Mapping[str, int], weights: Mapping[str, int]) -> list[dict]:
    """For each phase its first slot, period and, by source, blocks placed before and slots in a period."""
    left, placed, slot, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        active = {s: weights[s] for s in left if weights[s]} or dict.fromkeys(left, 1)  # sources of no weight come last
        if len(active) == 1:
            active = dict.fromkeys(active, 1)
        table = one_period(active, left)
        period = slots = sum(map(len, table.values()))
        if not any(len(table[s]) == left[s] for s in active):  # a whole period, which repeats
            last = lambda s, n: (n - 1) // active[s] * period + int(table[s][(n - 1) % active[s]])
            slots = min(last(s, left[s]) for s in active) + 1  # up to the slot in which the first source ends
        out.append({"slot": slot, "period": period, "table": table, "before": {s: placed[s] for s in active}})
        for s in active:
            n = slots // period * len(table[s]) + int(np.searchsorted(table[s], slots % period))
            placed[s] += n
            left[s] -= n
            if left[s] <= 0:
                del left[s]
        slot += slots
    return out


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, block: int = BLOCK, period: int | None = None, temper: float = TEMPER) -> DataFrame:
    """``docs`` with source_block, slot and position (by which to order); no row is dropped or repeated.

    ``weights`` names target weights by source (missing ones: the smallest given); without it a source of n rows weighs
    ``n ** temper``. A source of weight zero comes after all others. With ``period`` the weights are rounded to whole numbers
    of about so many slots, otherwise each source stays less than a block away from its share by the weights as given, and
    the driver plans all blocks. Columns of ``docs`` with these three names are replaced. Null is a source of its own; repeated rows
    and null ids keep a place each; null or empty texts make no difference; an empty table gives an empty result. The driver
    sees one row per source.
    """
    names = [c for c in docs.columns if c not in ("source_block", "slot", "position")]
    docs = docs.select(*names)
    counts = {r["source"]: r["count"] for r in docs.groupBy("source").count().collect()}
    key = lambda s: "\0" if s is None else "=" + s
    if weights is None:
        share = {key(s): float(n) ** temper for s, n in counts.items()}
    else:
        share = {key(s): float(weights.get(s, min(weights.values()))) for s in counts}
    plan = phases({key(s): -(-n // block) for s, n in counts.items()}, (whole_weights(share, period) if period else exact_weights(share)) if share else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False).astype(np.int64)
            source = b.column(b.schema.get_field_index("source")).dictionary_encode()
            code = source.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            number, slot = rank // block, np.zeros(b.num_rows, np.int64)
            for c in np.unique(code):
                rows, s = np.flatnonzero(code == c), key(None if c < 0 else source.dictionary[int(c)].as_py())
                own = [p for p in plan if s in p["before"]]
                before = np.array([p["before"][s] for p in own], np.int64)
                at = np.searchsorted(before, number[rows], "right") - 1
                for i in np.unique(at):
                    some = rows[at == i]
                    turn, nth = np.divmod(number[some] - before[i], len(own[i]["table"][s]))
                    slot[some] = own[i]["slot"] + turn * own[i]["period"] + own[i]["table"][s][nth]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(number), pa.array(slot), pa.array(slot * block + rank % block)], [*names, "source_block", "slot", "position"])

    out = added(docs, source_block="long", slot="long", position="long")
    return ranked(docs, "source", ["doc_id"], [c for c in ("doc_id", "text") if c in names]).select(*names, "__rank").mapInArrow(run, out)
