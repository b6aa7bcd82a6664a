"""Best-fit packing by minimum bin slack.

Lengths are whole numbers up to the capacity, so the multiset of all pieces is a histogram of at most ``capacity`` counts,
whatever the corpus. The plan is made on it: for the longest length left, a bitset subset-sum over the available lengths
finds the fullest combination that still fits; the combination is removed as often as all its lengths last. Each removal
uses up at least one length, so the plan has at most ``capacity`` patterns. Pieces then find their place by their rank
among the pieces of their length: no step sees the pieces together.

Where an order is given, the bins of all patterns are spread evenly over it and numbered in that order, and pieces of a length
fill their places by their rank in the order. So the sequences run through the order as the pieces of each length do.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, text_or_empty
from .textkit import release

CAPACITY = 2048
#: Words whose ids a worker keeps (about 250 bytes each); only speed depends on it. Bins that are placed at a time.
REMEMBER, BINS = 300_000, 128
_workers: dict = {}


# Fixed values of the vocabulary's scheme, over Latin-1: its word pattern, lower case, and the characters that stand for bytes.
_WORD = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\x09-\x0d\x20\x85\xa0a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A or 0xC0 <= c <= 0xDE and c != 0xD7 else c for c in range(256))
_SHOWN = [c for c in range(256) if 0x21 <= c <= 0x7E or 0xA1 <= c <= 0xAC or c >= 0xAE]
_HIDDEN = [c for c in range(256) if c not in _SHOWN]
_BYTES = {c: chr(c) for c in _SHOWN} | {c: chr(256 + i) for i, c in enumerate(_HIDDEN)}


class WordEncoder:
    """Ids of whole texts. The vocabulary merges within words only, so in a text of Latin-1 characters each new word goes
    through the merges once and its ids are kept. Any other text, or one with a special token's mark, is encoded as it is."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.last: set[bytes] = set()

    def forget(self) -> None:
        """Keep the words of the last batch only."""
        self.known, self.last = {w: self.known[w] for w in self.last}, set()

    def _learn(self, words: set[bytes]) -> None:
        merge = self.tokenizer.model.tokenize
        for w in words:
            shown = w.decode() if w.isalpha() else "".join(map(_BYTES.__getitem__, w.decode("latin-1").encode()))
            self.known[w] = array("I", [t.id for t in merge(shown)]).tobytes()

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of each text."""
        split: list = []
        for t in texts:
            try:
                if b"<|" in t:
                    raise ValueError
                split.append(_WORD.findall((t if t.isascii() else t.decode().encode("latin-1")).translate(_LOWER)))
            except ValueError:
                split.append(None)
        words = set().union(*(s for s in split if s is not None))
        if len(self.known) + len(words - self.known.keys()) > REMEMBER:  # most words come once; those of this batch are likelier to come again
            self.known = {w: self.known[w] for w in words & self.known.keys()}
        self._learn(words - self.known.keys())
        self.last = words
        get = self.known.__getitem__
        for t, s in zip(texts, split):
            yield b"".join(map(get, s)) if s is not None else np.array(self.tokenizer.encode(t.decode(), add_special_tokens=False).ids, "<u4").tobytes()


def _encoder(path: str) -> WordEncoder:
    if path not in _workers:
        _workers[path] = WordEncoder(path)
    return _workers[path]


def _texts(column: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    at, some, n = 0, [], 0
    for i, t in enumerate(column.cast(pa.binary())):
        t = t.as_py() or b""
        some.append(t)
        n += len(t)
        if n >= size:
            yield at, some
            at, some, n = i + 1, [], 0
    if some:
        yield at, some


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, order: tuple[str, ...] = ()) -> DataFrame:
    """Tokenise and cut: doc_id, piece, start, length, ids_crc32, one row per piece of at most ``capacity`` tokens.

    A document is its ids and then id 0; only a longer one is cut, and only its last piece may be shorter than the
    capacity. Null text counts as empty (one token, the 0). Columns of ``order`` are kept.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, width = _encoder(tokenizer), b"\0\0\0\0", capacity * 4
        for b in batches:
            for at, some in _texts(b.column(1)):
                row, piece, length, crc = [], [], [], []
                for i, ids in enumerate(encoder.encode(some)):
                    ids += end
                    for k in range(0, len(ids), width):
                        part = ids[k : k + width]
                        row.append(at + i)
                        piece.append(k // width)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                piece = np.array(piece, np.int32)
                row = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).take(row), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), *(b.column(k).take(row) for k in range(2, b.num_columns))], ["doc_id", "piece", "start", "length", "ids_crc32", *order])
            release()
        encoder.forget()  # the worker lives on and may wait beside other stages
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *order)
    more = "".join(f", {k} {rows.schema[k].dataType.simpleString()}" for k in order)
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + more)


def fullest(left: dict[int, int], room: int) -> list[int]:
    """Lengths, each at most as often as ``left`` has it, whose sum is the largest that fits ``room``; long ones first."""
    reach, steps, full = 1, [], (1 << room + 1) - 1
    for length in sorted((x for x in left if x <= room), reverse=True):
        count, take = min(left[length], room // length), 1
        while count > 0:  # binary splitting of the multiplicity
            k = min(take, count)
            steps.append((length, k, reach))
            reach |= reach << length * k & full
            count -= k
            take *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, []
    for length, k, before in reversed(steps):
        if not before >> at & 1:
            out += [length] * k
            at -= length * k
    return out


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths of a bin, number of such bins), by minimum bin slack with the longest piece left fixed in each bin."""
    left, out = {k: v for k, v in histogram.items() if v > 0}, []
    while left:
        longest = max(left)
        rest = left | {longest: left[longest] - 1}
        lengths = [longest, *fullest({k: v for k, v in rest.items() if v}, capacity - longest)]
        need = Counter(lengths)
        times = min(left[k] // n for k, n in need.items())
        for k, n in need.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((lengths, times))
    return out


def slots(planned: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """The plan by length: pieces of ``length`` with ranks from ``rank`` on fill bins from ``bin`` on, ``each`` a bin, the
    first of them at ``offset``. Sorted by length, then rank."""
    used: Counter = Counter()
    rows, first = [], 0
    for lengths, times in planned:
        offset = 0
        for length, each in Counter(lengths).items():
            rows.append((length, used[length], first, each, offset))
            used[length] += each * times
            offset += each * length
        first += times
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "bin", "each", "offset"), a.T.copy()))


def ranked(rows: DataFrame, key: str, deal: list[str], order: list[str], per_bucket: int = 50_000, bucket: str | None = None) -> DataFrame:
    """``rows`` with ``__rank``, numbers from 0 within each value of ``key``.

    A key is dealt over buckets by a hash of ``deal``, and ranks start at the sum of the buckets before, so a key that holds
    most rows is numbered by many tasks. With ``bucket``, a column that ``order`` begins with, its values are the buckets, and
    ranks follow ``order`` throughout. ``rows`` is read twice and has to come from a stable source.
    """
    if bucket:
        rows = rows.withColumn("__bucket", F.col(bucket))
    else:
        n = min(1 << 14, max(16, -(-rows.count() // per_bucket)))
        rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(*deal), F.lit(n)).cast("int"))
    before = Window.partitionBy(key).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(key, "__bucket").agg(F.count("*").alias("__n")).withColumn("__first", F.coalesce(F.sum("__n").over(before), F.lit(0))).select(F.col(key).alias("__key"), F.col("__bucket").alias("__of"), "__first")
    within = Window.partitionBy(key, "__bucket").orderBy(*order)
    numbered = rows.withColumn("__place", F.row_number().over(within) - 1)
    joined = numbered.join(starts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__bucket") == F.col("__of")))
    return joined.withColumn("__rank", F.col("__place") + F.col("__first")).drop("__key", "__of", "__bucket", "__place", "__first")


def spread(planned: list[tuple[list[int], int]], bins: np.ndarray) -> tuple[np.ndarray, ...]:
    """length, rank, sequence_id and offset of each place in the ``bins`` (numbers in the order of the plan, ascending).

    Bin k of a pattern of n bins stands at (k + 1/2) / n of the order, patterns in turn where that is equal. sequence_id counts
    the bins before it, rank the places for the same length in these.
    """
    times = np.array([n for _, n in planned], np.int64)
    first = np.cumsum(times) - times
    column = {length: i for i, length in enumerate(sorted({x for lengths, _ in planned for x in lengths}))}
    each = np.zeros((len(column), len(planned)))
    for q, (lengths, _) in enumerate(planned):
        for length, n in Counter(lengths).items():
            each[column[length], q] = n
    out, of = [], np.searchsorted(first, bins, "right") - 1
    for a in range(0, len(bins), BINS):
        p = of[a : a + BINS]
        ahead = (2 * (bins[a : a + BINS] - first[p]) + 1)[:, None] * times - times[p][:, None]
        full = 2 * times[p][:, None]
        ahead += full - (np.arange(len(times)) >= p[:, None])  # earlier patterns come first where the place is equal
        before = ahead // full  # each pattern's bins before
        number = before.sum(1)
        before = before.astype(np.float64)
        for q in np.unique(p):
            some, offset = np.flatnonzero(p == q), 0
            for length, n in Counter(planned[q][0]).items():
                rank = (before[some] @ each[column[length]]).astype(np.int64)
                nth = np.arange(n)
                out.append((np.full(len(some) * n, length), (rank[:, None] + nth).ravel(), np.repeat(number[some], n), np.tile(offset + nth * length, len(some))))
                offset += n * length
    return tuple(np.concatenate(x).astype(np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 4


def place(cut: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ()) -> DataFrame:
    """``cut`` (durable rows of ``pieces``) with sequence_id and offset. An empty table gives an empty result."""
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    planned = plan(histogram, capacity)
    if order:
        return _place_in_order(cut, planned, order)
    at = slots(planned)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = 1 << 45
        keys = at["length"] * span + at["rank"]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("length", "__rank"))
            i = np.searchsorted(keys, length * span + rank, "right") - 1
            bins, nth = np.divmod(rank - at["rank"][i], at["each"][i])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.array(at["bin"][i] + bins), pa.array(at["offset"][i] + nth * length)], [*names, "sequence_id", "offset"])

    return ranked(cut, "length", ["doc_id", "piece"], ["doc_id", "piece", "ids_crc32"]).select(*names, "__rank").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def _place_in_order(cut: DataFrame, planned: list[tuple[list[int], int]], order: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _workers.clear()  # this worker may have cut pieces before, and its words aren't needed any more
        release()
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in spread(planned, b.column(0).to_numpy())], ["length", "__rank", "sequence_id", "offset"])

    total = sum(n for _, n in planned)
    places = cut.sparkSession.range(0, total, 1, max(1, -(-total // 20_000))).mapInArrow(run, "length long, __rank long, sequence_id long, offset long")
    rows = ranked(cut, "length", [], [*order, "doc_id", "piece", "ids_crc32"], bucket=order[0])
    return rows.join(places, ["length", "__rank"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, order: tuple[str, ...] = ()) -> DataFrame:
    """Pack all documents into as few sequences of at most ``capacity`` tokens as the plan finds.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; within a sequence the offsets follow
    one another without gaps from 0. Null and empty texts are pieces of one token; a null doc_id is kept; repeated rows are
    packed as often as they occur; columns other than doc_id and text are ignored; an empty table gives an empty result.
    Sequence ids follow the columns of ``order``, if any; the first one deals the rows and should have many values.
    """
    return place(durable(pieces(docs, tokenizer, capacity, order), "pieces"), capacity, order)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array of int), from documents with unique ids and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for b in batches:
            for at, some in _texts(b.column(1)):
                n = len(some)
                ids = [pa.array(np.frombuffer(x + b"\0\0\0\0", "<u4").astype(np.int32)) for x in encoder.encode(some)]
                off = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.ListArray.from_arrays(pa.array(off), pa.concat_arrays(ids))], ["doc_id", "all_ids"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, all_ids array<int>")
    parts = placed.join(ids, "doc_id").select("sequence_id", F.struct("offset", F.expr("slice(all_ids, CAST(start + 1 AS INT), CAST(length AS INT))").alias("ids")).alias("part"))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list("part")), lambda x: x["ids"])).alias("ids"))  # at most ``capacity`` ids
