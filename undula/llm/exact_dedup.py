"""Exact deduplication by content sort.

Sampled splitters range-partition the normalised bytes (by a prefix, a hash and the id, so a text that fills a third of the
table spreads over as many partitions as its share), an external sort places equal texts side by side, neighbours are compared in
full, and of each run of equal texts the row with the smallest id stays. Only runs that touch a border of a partition
can go on in another one: these, two a partition at most, are joined by their digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, text_or_empty

#: Characters of a text that splitters hold, beside its hash and id: they are sampled to the driver.
PREFIX = 32
_FRAGMENTS = "doc_id long, place long, digest binary, pid int, fragment long, least long, rows long, border boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("digest", pa.binary()), ("pid", pa.int32()), ("fragment", pa.int64()), ("least", pa.int64()), ("rows", pa.int64()), ("border", pa.bool_())])


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal texts in a sorted partition. Of a run only ids are held until its end is known.

    A run may go on in another partition if its key (the prefix and hash that partitions are cut by) is the first or last
    one here, so runs are held until the key changes.
    """
    pid, held, last, fragment, key, first_key, waiting = TaskContext.get().partitionId(), [], None, 0, None, None, []

    def run(ids: list, text: bytes, number: int, border: bool) -> pa.RecordBatch:
        ids = pa.chunked_array(ids).combine_chunks() if len(ids) > 1 else ids[0]
        n = len(ids)
        same = lambda v, t: pa.array([v] * n, t) if n < 64 else pa.repeat(pa.scalar(v, t), n)
        return pa.RecordBatch.from_arrays([ids, pa.array(np.arange(n)), same(hashlib.sha256(text).digest(), pa.binary()), same(pid, pa.int32()), same(number, pa.int64()), same(ids[0].as_py(), pa.int64()), same(n, pa.int64()), same(border, pa.bool_())], schema=_ARROW)

    for b in batches:
        if not b.num_rows:
            continue
        ids, texts, keys = b.column(0), b.column(1).cast(pa.binary()), b.column(2)
        cut = [0, *(np.flatnonzero(pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)) + 1), b.num_rows]
        out = []
        for k, (i, j) in enumerate(zip(cut, cut[1:])):
            if k or last is None or texts[0].as_py() != last:
                if last is not None:
                    waiting.append((held, last, fragment))
                    fragment += 1
                now = keys[i].as_py()
                first_key = now if last is None else first_key
                if now != key:
                    out += [run(*w, border=key == first_key) for w in waiting]
                    key, waiting = now, []
                held, last = [], texts[i].as_py()
            held.append(ids.slice(i, j - i))
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    if last is not None:
        for w in [*waiting, (held, last, fragment)]:
            yield run(*w, border=True)


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they agree after each run of ``[\\x20\\x09-\\x0D]`` is replaced by one space; a null text counts
    as empty. A null doc_id sorts after every number. Where rows of a group share the smallest doc_id, exactly one of
    them is kept. Columns other than doc_id and text are not looked at; an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_replace(text_or_empty(), "[\\x20\\x09-\\x0D]+", " ").alias("norm"))
    texts = texts.withColumn("start", F.substring("norm", 1, PREFIX)).withColumn("key", F.xxhash64("norm"))
    last = F.col("doc_id").asc_nulls_last()
    ordered = texts.repartitionByRange(F.col("start"), F.col("key"), last).sortWithinPartitions(F.col("start"), F.col("key"), F.col("norm"), last)
    rows = durable(ordered.select("doc_id", "norm", "key").mapInArrow(_fragments, _FRAGMENTS), "exact")
    ends = rows.filter("border").groupBy("pid", "digest").agg(F.min("least").alias("least"), F.max("rows").alias("rows"))
    joined = ends.groupBy("digest").agg(F.min("least").alias("all_least"), F.sum("rows").alias("all_rows"), F.min("pid").alias("first_pid"))
    found = rows.join(F.broadcast(joined.withColumn("border", F.lit(True))), ["digest", "border"], "left")  # two rows a partition at most
    return found.select(
        "doc_id",
        F.when(F.col("first_pid").isNull(), F.col("least")).otherwise(F.col("all_least")).alias("keep_id"),
        F.coalesce("all_rows", "rows").alias("group_size"),
        ((F.col("place") == 0) & (F.col("first_pid").isNull() | (F.col("first_pid") == F.col("pid")))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
