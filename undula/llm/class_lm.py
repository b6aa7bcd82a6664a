"""Scores of a class-based bigram language model (Brown classes by exchange clustering).

``P(w | v) = P(class(w) | class(v)) * P(w | class(w))``. All words of the training texts get a class:

1. texts become chunks of word numbers with the chunk's own vocabulary; all words are counted;
2. the bigrams of the CORE most frequent words are counted over all training texts, and exchange clustering moves these words
   between CLASSES classes while the likelihood grows (a table of fixed size, on the driver);
3. every other word is put, by the same likelihood, into the class that suits the classes left and right of all its
   occurrences; counts and classes go back to the chunks as aligned arrays, so no vocabulary is ever broadcast;
4. class transitions are counted over all training texts, smoothed with the class frequencies.

Words unseen in training have a class of their own: its transitions are those of words seen once, and it spreads its mass
over as many words as were seen once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, durable
from .textkit import binary, buffers, hashed, slices

#: Classes, words that exchange moves, its sweeps, and the weight of class frequencies in the transitions.
CLASSES, CORE, SWEEPS, BACKOFF = 64, 2048, 8, 20.0
END, UNSEEN = CLASSES, CLASSES + 1
_ROWS = CLASSES + 2
_CHUNK = 16 << 20
_ONCE = 128  # flag of a word seen once in training


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplane(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pid, k = TaskContext.get().partitionId(), 0
    for b in batches:
        _, off = buffers(b.column(2))
        for a, z in slices(off, _CHUNK):
            words, first = hashed(b.column(2).slice(a, z - a))
            train = ~b.column(1).slice(a, z - a).to_numpy(zero_copy_only=False)
            vocab, word = np.unique(words, return_inverse=True)
            n = np.bincount(word, minlength=len(vocab))
            order = np.argsort(-n, kind="stable")  # frequent words get small numbers
            number = np.empty(len(vocab), np.int64)
            number[order] = np.arange(len(vocab))
            word = number[word]
            counts = np.bincount(word[np.repeat(train, np.diff(first))], minlength=len(vocab))
            ids = b.column(0).slice(a, z - a)
            yield pa.RecordBatch.from_arrays([pa.array([pid << 32 | k], pa.int64()), pa.ListArray.from_arrays(pa.array([0, z - a], pa.int32()), ids), binary([train.astype(np.uint8)]), binary([first.astype(np.int64)]), binary([_planes(word)]), binary([vocab[order]]), binary([counts.astype(np.uint32)])], ["chunk", "ids", "train", "first", "words", "vocab", "counts"])
            k += 1


def _bucket(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _by_bucket(h: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """Order of the hashes by value, and (bucket, from, to) in that order: buckets are ranges of hashes."""
    order = np.argsort(h)
    b = _bucket(h[order], parts)
    cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
    return order, [(int(b[i]), int(i), int(j)) for i, j in zip(cut, np.append(cut[1:], len(b)))]


def _count(chunks: DataFrame, parts: int, core: int) -> tuple[DataFrame, DataFrame]:
    """Of each bucket of words its number of words, tokens and words seen once; in 16 rows, the most frequent words."""

    def deal(batches):
        for b in batches:
            for i in range(b.num_rows):
                h, n = np.frombuffer(b.column(0)[i].as_py(), np.uint64), np.frombuffer(b.column(1)[i].as_py(), np.uint32)
                h, n = h[n > 0], n[n > 0]
                order, cut = _by_bucket(h, parts)
                h, n = h[order], n[order]
                yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cut], pa.int32()), binary([h[x:y] for _, x, y in cut]), binary([n[x:y] for _, x, y in cut])], ["bucket", "h", "n"])

    def total(t: pa.Table) -> pa.Table:
        h, back = np.unique(np.frombuffer(b"".join(t["h"].to_pylist()), np.uint64), return_inverse=True)
        n = np.bincount(back, np.frombuffer(b"".join(t["n"].to_pylist()), np.uint32)).astype(np.int64)
        return pa.table({"bucket": t["bucket"][:1], **most(h, n), "words": [len(h)], "tokens": [int(n.sum())], "once": [int((n == 1).sum())]})

    def most(h: np.ndarray, n: np.ndarray) -> dict:
        top = np.lexsort((h, -n))[:core]
        return {"top": binary([h[top]]), "top_n": binary([n[top]])}

    def merge(t: pa.Table) -> pa.Table:
        return pa.table(most(*(np.frombuffer(b"".join(t[c].to_pylist()), d) for c, d in (("top", np.uint64), ("top_n", np.int64)))))

    counted = durable(chunks.select("vocab", "counts").mapInArrow(deal, "bucket int, h binary, n binary").groupBy("bucket").applyInArrow(total, "bucket int, top binary, top_n binary, words long, tokens long, once long"), "counted")
    return counted, counted.groupBy(F.pmod("bucket", F.lit(16))).applyInArrow(merge, "top binary, top_n binary")


def _sequence(code: np.ndarray, first: np.ndarray, keep: np.ndarray, end: int) -> np.ndarray:
    """Codes of the kept texts one after the other, each with its end, and an end before all."""
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), size)
    code, doc = code[keep[doc]], (np.cumsum(keep) - 1)[doc[keep[doc]]]
    out = np.full(len(code) + int(keep.sum()) + 1, end, np.int64)
    out[np.arange(len(code)) + doc + 1] = code
    return out


def _core_numbers(vocab: np.ndarray, core: np.ndarray, other: int) -> np.ndarray:
    if not len(core):
        return np.full(len(vocab), other)
    at = np.minimum(np.searchsorted(core, vocab), len(core) - 1)
    return np.where(core[at] == vocab, at, other)


def _core_bigrams(chunks: DataFrame, core: np.ndarray) -> np.ndarray:
    k = len(core) + 2  # core words by hash, any other word, end

    def pairs(batches):
        total = np.zeros(k * k, np.int64)
        for b in batches:
            for i in range(b.num_rows):
                train, first, words, vocab = (b.column(j)[i].as_py() for j in range(4))
                number = _core_numbers(np.frombuffer(vocab, np.uint64), core, k - 2)
                s = _sequence(number[_unplane(words)], np.frombuffer(first, np.int64), np.frombuffer(train, np.uint8) > 0, k - 1)
                total += np.bincount(s[:-1] * k + s[1:], minlength=k * k)
        some = np.flatnonzero(total)
        block = some // (64 * k)
        cut = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(some) else []
        at = list(zip(cut, np.append(cut[1:], len(some)).astype(int))) if len(some) else []
        yield pa.RecordBatch.from_arrays([pa.array([int(block[i]) for i, _ in at], pa.int32()), binary([some[i:j].astype(np.uint32) for i, j in at]), binary([total[some[i:j]] for i, j in at])], ["block", "pair", "n"])

    def add(t: pa.Table) -> pa.Table:
        p, back = np.unique(np.frombuffer(b"".join(t["pair"].to_pylist()), np.uint32), return_inverse=True)
        n = np.bincount(back, np.frombuffer(b"".join(t["n"].to_pylist()), np.int64)).astype(np.int64)
        return pa.table({"pair": binary([p]), "n": binary([n])})

    out = np.zeros(k * k)
    found = chunks.select("train", "first", "words", "vocab").mapInArrow(pairs, "block int, pair binary, n binary").groupBy("block").applyInArrow(add, "pair binary, n binary")
    for r in found.toLocalIterator():  # at most (CORE + 2) ** 2 counts
        out[np.frombuffer(r["pair"], np.uint32)] = np.frombuffer(r["n"], np.int64)
    return out.reshape(k, k)


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(pairs: np.ndarray, counts: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray]:
    """Class of each core word, and the bigram counts of classes, other words (row ``classes``) and end (the last row).

    ``pairs``: bigram counts of core words, other words, end. Each word in turn goes to the class in which the likelihood of
    the class bigrams is largest, until a sweep moves none.
    """
    n, g = len(pairs) - 2, classes + 2
    own = np.empty(n + 2, np.int64)
    own[np.argsort(-counts, kind="stable")] = np.arange(n) % classes
    own[n:] = (classes, classes + 1)
    one = np.zeros((n + 2, g))
    one[np.arange(n + 2), own] = 1
    right, left = pairs @ one, pairs.T @ one
    table = one.T @ right
    for _ in range(sweeps):
        moved = 0
        for w in np.argsort(-counts, kind="stable"):
            a, same = own[w], pairs[w, w]
            r, l = right[w].copy(), left[w].copy()
            table[a] -= r
            table[:, a] -= l
            table[a, a] += same
            r[a] -= same
            l[a] -= same
            size = table.sum(1)
            m = r.sum() + same
            old, d = _f(table), np.arange(classes)
            row = (_f(table[:classes] + r) - old[:classes]).sum(1) - (_f(table[d, d] + r[d]) - old[d, d])
            col = (_f(table[:, :classes] + l[:, None]) - old[:, :classes]).sum(0) - (_f(table[d, d] + l[d]) - old[d, d])
            gain = row + col + _f(table[d, d] + r[d] + l[d] + same) - old[d, d] - 2 * (_f(size[:classes] + m) - _f(size[:classes]))
            b = int(gain.argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += r
            table[:, b] += l
            table[b, b] += same
            if b != a:
                own[w] = b
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
                left[:, a] -= pairs[w]
                left[:, b] += pairs[w]
                moved += 1
        if not moved:
            break
    return own[:n], table


def _assign(chunks: DataFrame, core: np.ndarray, own: np.ndarray, table: np.ndarray, parts: int) -> DataFrame:
    """For each chunk and bucket the training count and class of its words, in the order of their hashes."""
    k, g = len(core), len(table)
    size = table.sum(1)
    t = np.log(table[:, :CLASSES] + 0.1) - np.log(size[:CLASSES] + 1)  # left neighbour g, class c
    u = np.log(table[:CLASSES].T + 0.1) - np.log(size[:CLASSES] + 1)  # right neighbour g, class c
    weigh = np.vstack((t, u)).astype(np.float32)
    group = np.append(own, (CLASSES, CLASSES + 1)).astype(np.int64)

    def deal(batches):
        for b in batches:
            for i in range(b.num_rows):
                chunk, train, first, words, vocab, counts = (b.column(j)[i].as_py() for j in range(6))
                h, n = np.frombuffer(vocab, np.uint64), np.frombuffer(counts, np.uint32)
                first, keep = np.frombuffer(first, np.int64), np.frombuffer(train, np.uint8) > 0
                word, number = _unplane(words), _core_numbers(h, core, k)
                around = _sequence(group[number[word]], first, keep, CLASSES + 1)
                which = _sequence(word, first, keep, len(h))
                mid = np.flatnonzero(which[1:] < len(h)) + 1
                mid = mid[number[which[mid]] == k]  # core words have their class
                order, cut = _by_bucket(h, parts)
                place = np.empty(len(h), np.int64)
                place[order] = np.arange(len(h))
                at = np.concatenate((place[which[mid]],) * 2)
                event = np.concatenate((around[mid - 1], around[mid + 1] + g)).astype(np.uint8)
                sort = np.argsort(at.astype(np.uint32), kind="stable")
                event, much = event[sort], np.bincount(at, minlength=len(h))
                begin = np.concatenate(([0], np.cumsum(much)))
                h, n, much = h[order], n[order], much.astype(np.uint32)
                yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cut], pa.int32()), pa.array([chunk] * len(cut), pa.int64()), binary([h[x:y] for _, x, y in cut]), binary([n[x:y] for _, x, y in cut]), binary([much[x:y] for _, x, y in cut]), binary([event[begin[x] : begin[y]] for _, x, y in cut])], ["bucket", "chunk", "h", "n", "much", "event"])

    def give(rows: pa.Table) -> pa.Table:
        hs = [np.frombuffer(x, np.uint64) for x in rows["h"].to_pylist()]
        h, back = np.unique(np.concatenate(hs), return_inverse=True)
        n = np.bincount(back, np.frombuffer(b"".join(rows["n"].to_pylist()), np.uint32)).astype(np.int64)
        much = np.frombuffer(b"".join(rows["much"].to_pylist()), np.uint32)
        event = np.frombuffer(b"".join(rows["event"].to_pylist()), np.uint8)
        of = np.repeat(back, much)
        order = np.argsort(of.astype(np.uint32), kind="stable")
        of, event = of[order], event[order]
        cls = np.full(len(h), UNSEEN, np.uint8)
        for s in range(0, len(h), 20_000):
            m = min(20_000, len(h) - s)
            i, j = np.searchsorted(of, (s, s + m))
            dense = np.bincount((of[i:j] - s) * (2 * g) + event[i:j], minlength=m * 2 * g).reshape(m, 2 * g).astype(np.float32)
            cls[s : s + m] = (dense @ weigh).argmax(1)
        number = _core_numbers(h, core, k)
        cls[number < k] = own[number[number < k]]
        cls[n == 0] = UNSEEN
        cut = np.cumsum([len(x) for x in hs])[:-1]
        return pa.table({"chunk": rows["chunk"], "bucket": rows["bucket"], "n": binary([n[x] for x in np.split(back, cut)]), "cls": binary([cls[x] for x in np.split(back, cut)])})

    sent = chunks.select("chunk", "train", "first", "words", "vocab", "counts").mapInArrow(deal, "bucket int, chunk long, h binary, n binary, much binary, event binary")
    return sent.groupBy("bucket").applyInArrow(give, "chunk long, bucket int, n binary, cls binary")


_DOC = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emit double, classes binary"


def _classed(chunks: DataFrame, given: DataFrame, tokens: int, words: int, ends: int) -> DataFrame:
    """Of each document its counts, base score, sum of log10 counts of known words, and the class of each token."""
    all_ = np.log10(tokens + 0.1 * (words + 1))

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        row = {c: left[c][0].as_py() for c in ("train", "first", "words", "vocab")}
        h, word, first = np.frombuffer(row["vocab"], np.uint64), _unplane(row["words"]).astype(np.int64), np.frombuffer(row["first"], np.int64)
        right = right.sort_by("bucket")
        n, cls = np.empty(len(h)), np.empty(len(h), np.uint8)
        order = np.argsort(h)
        n[order] = np.frombuffer(b"".join(right["n"].to_pylist()), np.int64)
        cls[order] = np.frombuffer(b"".join(right["cls"].to_pylist()), np.uint8)
        cls |= np.where(n == 1, _ONCE, 0).astype(np.uint8)
        docs = len(first) - 1
        total = lambda v, last: np.diff(np.concatenate(([0.0], np.cumsum(v)))[first]) + last
        base = total((np.log10(n + 0.1) - all_)[word], np.log10(ends + 0.1) - all_)
        emit = total(np.where(n > 0, np.log10(np.maximum(n, 1)), 0)[word], 0)
        known = total((n > 0)[word].astype(np.float64), float(ends > 0)).astype(np.int64)
        end = cls[word]
        return pa.table({"doc_id": left["ids"].combine_chunks().flatten(), "held_out": np.frombuffer(row["train"], np.uint8) == 0, "n_tokens": np.diff(first) + 1, "n_known": known, "base_score": base, "emit": emit, "classes": binary([end[first[i] : first[i + 1]].tobytes() + bytes([END]) for i in range(docs)])})

    return chunks.select("chunk", "ids", "train", "first", "words", "vocab").groupBy("chunk").cogroup(given.groupBy("chunk")).applyInArrow(join, _DOC)


def _moves(classes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes (with flags) of all tokens of all rows, those before them (END at a start), and offsets of the rows."""
    off = np.frombuffer(classes.buffers()[1], np.int32)[classes.offset : classes.offset + len(classes) + 1].astype(np.int64)
    now = np.frombuffer(classes.buffers()[2], np.uint8)[off[0] : off[-1]]
    before = np.empty_like(now)
    before[1:] = now[:-1]
    before[:1] = END
    return now, before, off - off[0]


def _transitions(docs: DataFrame) -> np.ndarray:
    """Counts (class before, class), once more in row UNSEEN after words seen once, and in column UNSEEN of such words."""
    wide = 2 * _ONCE

    def run(batches):
        total = np.zeros(wide * wide, np.int64)
        for b in batches:
            now, before, _ = _moves(b.column(0))
            total += np.bincount(before.astype(np.int64) * wide + now, minlength=wide * wide)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["at", "n"])

    raw = np.zeros(wide * wide)
    for r in docs.filter("NOT held_out").select("classes").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n")).toLocalIterator():  # a few thousand
        raw[r[0]] = r[1]
    raw = raw.reshape(2, _ONCE, 2, _ONCE)[:, :_ROWS, :, :_ROWS]  # (seen once before?, before, seen once?, class)
    out = raw.sum((0, 2))
    out[UNSEEN] += raw[1].sum((0, 1))
    out[:, UNSEEN] = raw.sum(0)[:, 1].sum(1)
    out[UNSEEN, UNSEEN] = raw[1, :, 1].sum()
    return out


def transition_logs(counts: np.ndarray, backoff: float = BACKOFF) -> np.ndarray:
    """log10 P(class | class before); each row, UNSEEN included, sums to 1."""
    known = np.arange(_ROWS) != UNSEEN
    seen = counts[:, known]
    size = seen.sum(1)
    often = seen[known].sum(0)
    often = (often + 1e-3) / (often + 1e-3).sum()
    unseen = np.minimum((counts[:, UNSEEN] + 0.5) / (size + 1), 0.5)
    p = np.empty((_ROWS, _ROWS))
    p[:, known] = (1 - unseen)[:, None] * (seen + backoff * often) / (size + backoff)[:, None]
    p[:, UNSEEN] = unseen
    return np.log10(p)


def score_documents(docs: DataFrame, held_out: str = "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 10 = 0") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Learns from the rows that are not held out; a null doc_id is not. Words are A-Z lower-cased runs outside white space,
    and each text ends with one token more; null and blank texts have that one only. Scores are log10 probabilities. With
    nothing to learn from, score is base_score. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.expr(held_out), F.lit(False)).alias("held_out"), "text")
    chunks = durable(rows.mapInArrow(_chunks, "chunk long, ids array<long>, train binary, first binary, words binary, vocab binary, counts binary"), "chunks")
    facts = chunks.agg(F.count("*").alias("n"), F.sum(F.expr("length(regexp_replace(hex(train), '00', '')) / 2")).cast("long").alias("ends")).first()
    parts, ends = buckets_for(spark, facts["n"], 1), facts["ends"] or 0
    counted, tops = _count(chunks, parts, CORE)
    sums = counted.agg(F.sum("words"), F.sum("tokens"), F.sum("once")).first()
    words, tokens, once = (x or 0 for x in sums)
    words, tokens = words + (ends > 0), tokens + ends
    top = tops.collect()  # 16 rows
    core, n = (np.frombuffer(b"".join(r[c] for r in top), d) for c, d in (("top", np.uint64), ("top_n", np.int64)))
    most = np.lexsort((core, -n))[:CORE]
    core, n = core[most], n[most].astype(np.float64)
    n, core = n[np.argsort(core)], np.sort(core)
    own, table = exchange(_core_bigrams(chunks, core), n)
    given = _assign(chunks, core, own, table, parts)
    classed = durable(_classed(chunks, given, tokens, words, ends), "classed")
    counts = _transitions(classed)
    logs = transition_logs(counts)
    size = counts[np.arange(_ROWS) != UNSEEN].sum(0)
    size[UNSEEN] = max(once, 1)
    size[END] = 1  # the only token of its class
    cost = np.log10(np.maximum(size, 1))

    def final(batches):
        for b in batches:
            now, before, off = _moves(b.column(6))
            now, before = now & (_ONCE - 1), before & (_ONCE - 1)
            s = np.concatenate(([0.0], np.cumsum(logs[before, now] - cost[now])))
            base = b.column(4).to_numpy()
            score = s[off[1:]] - s[off[:-1]] + b.column(5).to_numpy() if tokens else base
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(np.full(b.num_rows, tokens, np.int64)), b.column(4), pa.array(score), pa.array(10 ** (-score / b.column(2).to_numpy()))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return classed.mapInArrow(final, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
