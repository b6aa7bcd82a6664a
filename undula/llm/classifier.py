"""Quality classifier by importance resampling.

Two bag-of-n-grams models over hashed buckets are learnt: one of target text (documents labelled good) and one of all raw
text. A document's weight is the ratio of the two likelihoods; adding Gumbel noise to its logarithm and keeping the k largest
draws k documents without replacement in proportion to their weights.

Tokens are runs of letters and digits or runs of other marks, lower-cased; n-grams are the tokens and their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import added, durable, text_or_empty
from .textkit import SPACE, buffers, mix, release, slices, word_hashes

#: Hashed n-grams; labelled rows used at most (those with the smallest hashed ids); pseudo-count of a bucket.
BUCKETS, LABELLED, PSEUDO = 1 << 16, 50_000, 1.0
_CLASS = np.where(SPACE, 0, 2).astype(np.int8)
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1


def ngrams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all texts' n-grams (tokens first, then pairs) and the text each belongs to."""
    kind = _CLASS[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    cut[1:-1] |= kind[1:] != kind[:-1]
    edge = np.flatnonzero(cut)
    start, end = edge[:-1], edge[1:]
    full = kind[start] > 0
    start, end = start[full], end[full]
    h = word_hashes(data, start, end)
    text = np.searchsorted(off, start, "right") - 1
    pair = np.flatnonzero(text[1:] == text[:-1])
    two = mix(h[pair] * np.uint64(0x9FB21C651E98DF25) + h[pair + 1])
    both = (np.concatenate((h, two)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    return both, np.concatenate((text, text[pair]))


def _parts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, off = buffers(texts)
    for a, b in slices(off):
        part = data[off[a] : off[b]]
        yield (a, b, *(ngrams(part, off[a : b + 1] - off[a]) if len(part) else (np.zeros(0, np.int64), np.zeros(0, np.int64))))
    release()


def learn(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> np.ndarray:
    """Log ratio of the target model to the raw model by bucket. The raw model counts all documents."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).filter("quality = 1").select("doc_id", F.lit(True).alias("target"))
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(known), "doc_id", "left").select(F.coalesce("target", F.lit(False)).alias("target"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            good = b.column(0).to_numpy(zero_copy_only=False)
            for at, _, gram, text in _parts(b.column(1)):
                raw += np.bincount(gram, minlength=BUCKETS)
                target += np.bincount(gram[good[at + text]], minlength=BUCKETS)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, raw[some], target[some])], ["bucket", "raw", "target"])

    raw, target = np.full(BUCKETS, PSEUDO), np.full(BUCKETS, PSEUDO)
    for r in rows.mapInArrow(run, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():  # one row a bucket
        raw[r[0]] += r[1]
        target[r[0]] += r[2]
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def log_weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``docs`` with log_weight, the log ratio of the likelihoods of its n-grams (0 for a text without any), and n_grams."""
    schema = added(docs, log_weight="double", n_grams="long")
    names, at_text = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, count = np.zeros(b.num_rows), np.zeros(b.num_rows, np.int64)
            for a, z, gram, text in _parts(b.column(at_text)):
                total[a:z] = np.bincount(text, ratio[gram], minlength=z - a)
                count[a:z] = np.bincount(text, minlength=z - a)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(total), pa.array(count)], [*names, "log_weight", "n_grams"])

    return docs.mapInArrow(run, schema)


def gumbel(seed: int = 11) -> Column:
    """Standard Gumbel noise from the row's id, the same in each run."""
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def kth_largest(scores: DataFrame, column: str, k: int) -> tuple[float, int] | None:
    """The k-th largest value and how many rows equal to it belong to the k largest. Four counts of 16 bits each."""
    if k <= 0:
        return None
    bits = scores.select(F.expr(f"CAST({column} AS DOUBLE)").alias("v"))

    def code(batches):
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.where(v < 0, ~(v & np.int64(2**63 - 1)), v) if len(v) else v)], ["v"])

    ordered, prefix = bits.mapInArrow(code, "v long"), None
    for shift in (48, 32, 16, 0):
        part = ordered if prefix is None else ordered.filter(F.expr(f"shiftright(v, {shift + 16})") == prefix)
        counts = part.groupBy(F.expr(f"shiftright(v, {shift})").alias("p")).count().collect()  # 65,536 rows at most
        for p, n in sorted(((r["p"], r["count"]) for r in counts), reverse=True):
            if k <= n:
                prefix = p
                break
            k -= n
        else:
            return None
    v = np.int64(prefix)
    back = np.array([v if v >= 0 else ~v | np.int64(-(2**63))], np.int64).view(np.float64)[0]
    return float(back), k


def keep_share(scored: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> float:
    """Share of rows to keep: that above the cut which tells the labelled rows apart best (by balanced accuracy)."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    seen = [(r["score"], r["quality"]) for r in scored.join(F.broadcast(known), "doc_id").select("score", "quality").limit(labelled).collect()]
    good, bad = sum(q == 1 for _, q in seen), sum(q != 1 for _, q in seen)
    if not good or not bad:
        return 1.0
    seen.sort()
    s, q = np.array([x for x, _ in seen]), np.array([x == 1 for _, x in seen])
    cut = np.arange(len(s) + 1)
    kept_good = good - np.concatenate(([0], np.cumsum(q)))
    cut_bad = np.concatenate(([0], np.cumsum(~q)))
    value = kept_good / good + cut_bad / bad
    best = cut[value == value.max()]
    at = int(best[len(best) // 2])
    level = s[0] - 1 if at == 0 else s[-1] + 1 if at == len(s) else (s[at - 1] + s[at]) / 2
    n = scored.agg(F.count("*").alias("n"), F.count_if(F.col("score") > float(level)).alias("k")).first()
    return n["k"] / n["n"] if n["n"] else 1.0


def _scored(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    return log_weights(docs, ratio).withColumn("score", F.col("log_weight") + gumbel())


def _decision(scored: DataFrame, labels: DataFrame, k: int | None) -> Column:
    """Which rows are among the ``k`` largest of ``scored``, a durable table of doc_id and score."""
    total = scored.count()
    k = round(total * keep_share(scored, labels)) if k is None else min(k, total)
    border = kth_largest(scored, "score", k)
    if border is None:
        return F.lit(False)
    value, ties = border
    tied = scored.filter(F.col("score") == value).orderBy(F.col("doc_id").asc_nulls_last()).select("doc_id").limit(ties).agg(F.max("doc_id").alias("last"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    allowed = F.coalesce(F.col("doc_id") <= tied["last"], F.lit(bool(tied["nulls"]))) if tied["last"] is not None else F.lit(True)
    return (F.col("score") > value) | ((F.col("score") == value) & (F.lit(bool(tied["nulls"])) | allowed))


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """doc_id, log_weight, n_grams, score (log_weight and Gumbel noise), kept: ``k`` rows are kept, the rest is rejected.

    Without ``k`` it follows from the labelled rows (``keep_share``); without labels all are kept. Null text counts as
    empty; a text without n-grams has weight 1. A text of any length costs in proportion to it. Ties at the border go to the
    smaller doc_id, a null doc_id last; rows repeated with their id are decided alike. An empty table gives an empty result;
    other columns are ignored, whatever their names.
    """
    scored = durable(_scored(docs.select("doc_id", "text"), learn(docs, labels)).drop("text"), "scores")
    return scored.withColumn("kept", _decision(scored, labels, k))


def resampled_documents(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The rows of ``docs`` that ``resample`` keeps, with all their columns. Texts are scored twice rather than shuffled."""
    ratio = learn(docs, labels)
    slim = durable(_scored(docs.select("doc_id", "text"), ratio).select("doc_id", "score"), "scores")
    kept = _decision(slim, labels, k)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    row = [F.struct(*(F.col(f"`{c}`") for c in rest)).alias("row")] if rest else []
    rows = _scored(docs.select("doc_id", "text", *row), ratio).filter(kept)
    return rows.select(*(F.col("row").getField(c).alias(c) if c in rest else F.col(c) for c in docs.columns))
