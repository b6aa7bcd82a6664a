"""N-gram Jaccard join: near-duplicate documents by their sets of five-word shingles.

Texts with equal sets form a class. A class can link to another only if at least ``t * n`` of its n shingles occur in another
class, so a first pass counts, over all shingles of all documents, which occur in one class only, and drops the classes that
cannot link. What is left meets in tiles, one for each (shingle, band of sizes): a set goes to the tiles of its prefix, the
``n - ceil(t * n) + 1`` shingles that come first when frequent ones are put last, and sizes of linked sets differ by at most
one band. In a tile, hashed bitmap signatures bound the overlap from above (bits of one that the other lacks are shingles
that it lacks); pairs that pass are intersected exactly as sorted arrays.

Families of near copies are joined up first: in a few rounds, sets with the same smallest shingle (then second smallest and so
on, dealt over parts of a bounded size) grow components from a seed, each compared only with those not yet reached. In the tiles, pairs of one component are then left
out, and tiles of one component altogether; so a large family costs no square of its size, while every link between
different components is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, durable
from .components import components
from .textkit import binary, buffers, hashed, release, shingles, slices

#: Words of a shingle and least similarity in per cent; text bytes hashed at a time; sets of a part at most; a shingle of
#: more than one in FREQUENT classes counts as frequent (so there are at most FREQUENT times the mean set size of them); rounds
#: that join up families.
WORDS, PERCENT, SLICE, PART, FREQUENT, ROUNDS = 5, 80, 2 << 20, 2000, 2000, 4
_BLOOM = 1 << 23
_SIGNATURE = 2048


def need(n, percent: int = PERCENT):
    """Least overlap of a set of ``n`` with any set it links to."""
    return -(-n * percent // 100)


def _sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    _, off = buffers(texts)
    for a, b in slices(off, SLICE):
        words, first = hashed(texts.slice(a, b - a))
        yield (a, b, *shingles(words, first, WORDS))
    release()


def _print(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _short(prints: np.ndarray) -> np.ndarray:
    return (prints & np.uint64(0x7FFFFFFF)).astype(np.uint32)


def shingle_stats(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and print (a digest of the set, empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, s, at in _sets(b.column(1)):
                prints = [_print(s[at[i] : at[i + 1]]) if at[i + 1] > at[i] else b"" for i in range(z - a)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(np.diff(at)), pa.array(prints, pa.binary())], ["doc_id", "n_shingles", "print"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, print binary")


def _shared(docs: DataFrame, parts: int, lots: int, frequent: int) -> tuple[DataFrame, np.ndarray]:
    """short, with_others: how many shingles the classes with this short print share with others; and frequent shingles.

    Classes are told apart by 64 bits of their prints; counts are added up under 31 of these. Shingles are folded to a bucket
    and 32 bits. Both foldings can only make more of them shared. A shingle that many texts of a slice hold is sent once
    with its count.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, z, s, at in _sets(b.column(1)):
                print_ = np.array([int.from_bytes(_print(s[at[i] : at[i + 1]])[:8], "little") for i in range(z - a)], np.uint64)
                short = _short(print_)
                _, one = np.unique(print_, return_index=True)  # one of each class in the slice
                keep = np.zeros(z - a, bool)
                keep[one] = True
                doc = np.repeat(np.arange(z - a), np.diff(at))
                take = keep[doc]
                s, doc = s[take], doc[take]
                if not len(s):
                    continue
                order = np.argsort(s)
                t = s[order]
                new = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
                size = np.diff(np.append(new, len(t)))
                many = size > 16
                local = np.zeros(z - a, np.int64)
                send = np.ones(len(s), bool)
                for i, n in zip(new[many], size[many]):
                    rows = order[i : i + n]
                    send[rows] = False
                    local[doc[rows]] += 1
                heavy, heavy_n = t[new[many]], size[many]
                s, doc = s[send], doc[send]
                to = ((s >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
                order = np.argsort(to.astype(np.uint16) if parts < 65536 else to, kind="stable")
                to, low, of = to[order], (s[order] & np.uint64(0xFFFFFFFF)).astype(np.uint32), doc[order]
                heavy_to = ((heavy >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)
                cut = np.flatnonzero(np.concatenate(([True], (to[1:] != to[:-1]) | (of[1:] != of[:-1]))))
                run_to, run_of, run_n = to[cut], print_[of[cut]], np.diff(np.append(cut, len(to))).astype(np.uint32)
                got = np.flatnonzero(local)
                rows = {k: [] for k in ("bucket", "tokens", "prints", "runs", "heavy", "heavy_n", "own", "own_n")}
                some = np.union1d(np.unique(run_to), np.unique(heavy_to)) if len(run_to) or len(heavy_to) else []
                for k, p in enumerate(some):
                    i, j = np.searchsorted(to, (p, p + 1))
                    u, v = np.searchsorted(run_to, (p, p + 1))
                    h = heavy_to == p
                    for name, x in (("tokens", low[i:j]), ("prints", run_of[u:v]), ("runs", run_n[u:v]), ("heavy", (heavy[h] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), ("heavy_n", heavy_n[h].astype(np.uint32)), ("own", short[got] if not k else short[:0]), ("own_n", local[got].astype(np.uint32) if not k else run_n[:0])):
                        rows[name].append(x)
                    rows["bucket"].append(int(p))
                yield pa.RecordBatch.from_arrays([pa.array(rows["bucket"], pa.int32()), *(binary(rows[k]) for k in list(rows)[1:])], list(rows))

    def count(t: pa.Table) -> pa.Table:
        get = lambda k, of=np.uint32: np.frombuffer(b"".join(t[k].to_pylist()), of)
        prints, which = np.unique(get("prints", np.uint64), return_inverse=True)
        key = np.unique(get("tokens").astype(np.uint64) << np.uint64(32) | np.repeat(which.astype(np.uint32), get("runs")))
        token, class_ = (key >> np.uint64(32)).astype(np.uint32), (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        new = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
        size = np.diff(np.append(new, len(token)))
        heavy, back = np.unique(get("heavy"), return_inverse=True)
        heavy_n = np.bincount(back, get("heavy_n"), minlength=len(heavy)).astype(np.int64)
        both = np.isin(token[new], heavy)
        multi = np.repeat((size > 1) | both, size)
        own, n = np.unique(class_[multi], return_counts=True)
        ids = _short(prints[own])
        df = np.bincount(np.searchsorted(heavy, token[new][both]), size[both], minlength=len(heavy)).astype(np.int64) + heavy_n if len(heavy) else heavy_n
        tokens, df = np.concatenate((token[new][~both], heavy)), np.concatenate((size[~both], df))
        tokens, df = tokens[df > frequent], df[df > frequent].astype(np.int64)
        ids, n = np.concatenate((ids, get("own"))), np.concatenate((n, get("own_n")))
        to = ids % lots
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(lots + 1))
        some = [i for i in range(lots) if cut[i] < cut[i + 1]]
        rows = {"lot": some, "short": [ids[order[cut[i] : cut[i + 1]]].astype(np.uint32) for i in some], "n": [n[order[cut[i] : cut[i + 1]]].astype(np.uint32) for i in some]}
        if len(tokens):
            bucket = t["bucket"][0].as_py()
            rows["lot"].append(-1)
            rows["short"].append(bucket << 32 | tokens.astype(np.int64))
            rows["n"].append(df)
        return pa.table({"lot": pa.array(rows["lot"], pa.int32()), "short": binary(rows["short"]), "n": binary(rows["n"])})

    def add(t: pa.Table) -> pa.Table:
        short, back = np.unique(np.frombuffer(b"".join(t["short"].to_pylist()), np.uint32), return_inverse=True)
        n = np.bincount(back, np.frombuffer(b"".join(t["n"].to_pylist()), np.uint32), minlength=len(short))
        return pa.table({"short": short.astype(np.int64), "with_others": n.astype(np.int64)})

    sent = docs.select("doc_id", "text").mapInArrow(deal, "bucket int, tokens binary, prints binary, runs binary, heavy binary, heavy_n binary, own binary, own_n binary")
    counted = durable(sent.groupBy("bucket").applyInArrow(count, "lot int, short binary, n binary"), "shared")
    tokens = [np.frombuffer(r["short"], np.int64) for r in counted.filter("lot = -1").select("short").toLocalIterator()]  # bounded, see FREQUENT
    shared = counted.filter("lot >= 0").groupBy("lot").applyInArrow(add, "short long, with_others long")
    return shared, np.sort(np.concatenate(tokens)) if tokens else np.zeros(0, np.int64)


def _bits(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(41)).astype(np.int64), (x >> np.uint64(18) & np.uint64(_BLOOM - 1)).astype(np.int64)


def _bloom(ids: DataFrame) -> np.ndarray:
    """A bit array of fixed size with two bits of each id; whatever passes it by chance is dropped by a join later."""

    def at(batches):
        for b in batches:
            p = np.concatenate(_bits(b.column(0).to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([pa.array(p >> 5), pa.array(np.int64(1) << (p & 31))], ["word", "bit"])

    out = np.zeros(_BLOOM >> 5, np.int64)
    for r in ids.mapInArrow(at, "word long, bit long").groupBy("word").agg(F.expr("bit_or(bit)")).toLocalIterator():
        out[r[0]] = r[1]
    return out


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate((a, b))
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Exact intersection of sorted arrays."""
    both = _overlap(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(sets: list[np.ndarray], bits: int = _SIGNATURE) -> np.ndarray:
    out = np.zeros((len(sets), bits // 8), np.uint8)
    for row, s in zip(out, sets):
        flags = np.zeros(bits, bool)
        flags[(s & np.uint64(bits - 1)).astype(np.int64)] = True
        row[:] = np.packbits(flags)
    return out.view(np.uint64)


def _possible(sig_a, n_a, sig_b, n_b, percent: int) -> np.ndarray:
    """Which pairs (rows of a x rows of b) can still link by their sizes and bit counts."""
    lack_a = np.bitwise_count(sig_a[:, None] & ~sig_b[None]).sum(2, dtype=np.int64)
    lack_b = np.bitwise_count(~sig_a[:, None] & sig_b[None]).sum(2, dtype=np.int64)
    most = np.minimum(n_a[:, None] - lack_a, n_b[None] - lack_b)
    return 100 * most >= percent * (n_a[:, None] + n_b[None] - most)


def grow(ids: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Smallest id of each set's component among these sets."""
    n, sig = np.array([len(s) for s in sets], np.int64), signatures(sets)
    label, open_ = np.full(len(ids), -1, np.int64), np.argsort(ids, kind="stable")
    while len(open_):
        seed, queue = ids[open_[0]], [open_[0]]
        label[open_[0]], open_ = seed, open_[1:]
        while queue and len(open_):
            i = queue.pop()
            maybe = open_[_possible(sig[i : i + 1], n[i : i + 1], sig[open_], n[open_], percent)[0]]
            hit = np.array([j for j in maybe if linked(sets[i], sets[j], percent)], np.int64)
            if len(hit):
                label[hit] = seed
                queue += hit.tolist()
                open_ = open_[~np.isin(open_, hit)]
    return label


def _grown(sets: DataFrame, nth: int, percent: int) -> DataFrame:
    """rep, label: links found inside tiles of one shingle, the ``nth`` smallest of each set."""

    def key(batches):
        for b in batches:
            s = [np.frombuffer(x.as_py(), np.uint64) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.array([x[min(nth, len(x) - 1)] for x in s], np.uint64).view(np.int64))], ["rep", "hashes", "tile"])

    tiles = sets.select("rep", "n", "hashes").mapInArrow(key, "rep long, hashes binary, tile long")
    counted = tiles.join(tiles.groupBy("tile").count(), "tile").withColumn("part", F.pmod(F.xxhash64("rep", F.lit(nth)), F.ceil(F.col("count") / PART)))
    def one(t: pa.Table) -> pa.Table:
        ids = t["rep"].to_numpy().astype(np.int64)
        return pa.table({"rep": ids, "label": grow(ids, [np.frombuffer(x, np.uint64) for x in t["hashes"].to_pylist()], percent)})

    return counted.filter("count > 1").select("tile", "part", "rep", "hashes").groupBy("tile", "part").applyInArrow(one, "rep long, label long").filter("rep != label")


def _band(n: np.ndarray, percent: int) -> np.ndarray:
    return np.floor(np.log(n) / -np.log(percent / 100) + 1e-9).astype(np.int32)


def _postings(sets: DataFrame, frequent: np.ndarray, parts: int, percent: int) -> DataFrame:
    """One row for each shingle of a set's prefix and each band it meets: its own (role 0) and the next (role 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            token, row, at, n = [], [], [], []
            for i, x in enumerate(b.column(1)):
                s = np.frombuffer(x.as_py(), np.uint64)
                fold = ((s >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)) << np.uint64(32) | s & np.uint64(0xFFFFFFFF)
                late = np.isin(fold.astype(np.int64), frequent) if len(frequent) else np.zeros(len(s), bool)
                first = np.concatenate((s[~late], s[late]))[: len(s) - need(len(s), percent) + 1]
                token.append(first.view(np.int64))
                row.append(np.full(len(first), i))
                at.append(np.arange(len(first), dtype=np.int32))
                n.append(len(s))
            if not row:
                continue
            token, row, at, n = np.concatenate(token), np.concatenate(row), np.concatenate(at), np.array(n, np.int64)
            reps, comps, band = b.column(0).to_numpy(zero_copy_only=False)[row], b.column(2).to_numpy(zero_copy_only=False)[row], _band(n, percent)[row]
            for role in (0, 1):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token, band + role, np.full(len(row), role, np.int32), reps, comps, n[row], at)], ["token", "band", "role", "rep", "comp", "n", "at"])

    return sets.select("rep", "hashes", "comp").mapInArrow(run, "token long, band int, role int, rep long, comp long, n long, at int")


def _signed(sets: DataFrame) -> DataFrame:
    """rep and sig, the bitmap signature of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), binary(list(signatures([np.frombuffer(x.as_py(), np.uint64) for x in b.column(1)])))], ["rep", "sig"])

    return sets.select("rep", "hashes").mapInArrow(run, "rep long, sig binary")


def _candidates(t: pa.Table, percent: int) -> pa.Table:
    """Pairs, within the tiles of one lot, that lie in different components and can link by sizes, places and bit counts.

    Members of a tile (role 0) are paired with the later members and with the visitors (role 1).
    """
    col = {c: t[c].to_numpy().astype(np.int64) for c in ("token", "band", "role", "rep", "comp", "n", "at")}
    sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint64).reshape(t.num_rows, -1)
    order = np.lexsort((col["rep"], col["role"], col["band"], col["token"]))
    col, sig = {k: v[order] for k, v in col.items()}, sig[order]
    start = np.flatnonzero(np.concatenate(([True], (np.diff(col["token"]) != 0) | (np.diff(col["band"]) != 0))))
    end = np.repeat(np.append(start[1:], t.num_rows), np.diff(np.append(start, t.num_rows)))
    own = np.flatnonzero(col["role"] == 0)
    much = end[own] - own - 1  # those after it in the tile
    total, at, out = np.cumsum(much), 0, [np.zeros((0, 2), np.int64)]
    while at < len(own):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 500_000, "right")))
        i = np.repeat(own[at:to], much[at:to])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(much[at:to]) - much[at:to], much[at:to])
        at = to
        n_i, n_j = col["n"][i], col["n"][j]
        room = np.minimum(n_i - col["at"][i], n_j - col["at"][j])  # from their first common shingle on, no more can be common
        fine = (col["comp"][i] != col["comp"][j]) & (100 * np.minimum(n_i, n_j) >= percent * np.maximum(n_i, n_j)) & (100 * room >= percent * (n_i + n_j - room))
        i, j, n_i, n_j = i[fine], j[fine], n_i[fine], n_j[fine]
        a, b = sig[i], sig[j]
        most = np.minimum(n_i - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), n_j - np.bitwise_count(~a & b).sum(1, dtype=np.int64))
        fine = 100 * most >= percent * (n_i + n_j - most)
        x, y = col["rep"][i[fine]], col["rep"][j[fine]]
        out.append(np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), 1), axis=0))
    pairs = np.unique(np.concatenate(out), axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def ngram_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Shingles are of five words, A-Z lower-cased; a text of fewer words is one shingle; null, empty and blank texts have
    none and link with nothing. Two documents link when ``100 * |A & B| >= percent * |A | B|``; component_id is the smallest
    doc_id that links reach. Ids should be unique: rows that share one may come out linked. A row without an id gets the
    component of equal sets (null if there is none) and starts no links. An empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    stats = durable(shingle_stats(docs), "stats")
    classes = durable(stats.filter("n_shingles > 0").groupBy("print").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n")).filter("rep IS NOT NULL"), "classes")
    totals = classes.agg(F.count("*").alias("n"), F.sum("n").alias("shingles")).first()
    parts = min(1 << 20, buckets_for(spark, totals["shingles"] or 0, 2_000_000))
    frequent = max(64, totals["n"] // FREQUENT)
    counts, tokens = _shared(docs, parts, max(16, totals["n"] // 500_000), frequent)
    short = F.expr("CAST(conv(concat(substr(hex(print), 7, 2), substr(hex(print), 5, 2), substr(hex(print), 3, 2), substr(hex(print), 1, 2)), 16, 10) AS LONG) & 2147483647")
    able = durable(classes.withColumn("short", short).join(counts, "short").filter(F.col("with_others") >= F.ceil(F.col("n") * percent / 100)).select("rep", "print", "n"), "able")
    bloom = _bloom(able.select("rep"))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            p, q = _bits(ids)
            some = np.flatnonzero((bloom[p >> 5] >> (p & 31) & 1 == 1) & (bloom[q >> 5] >> (q & 31) & 1 == 1))
            if not len(some):
                continue
            texts, ids = b.column(1).take(pa.array(some)), b.column(0).take(pa.array(some))
            for a, z, s, at in _sets(texts):
                sets_ = [s[at[i] : at[i + 1]] for i in range(z - a)]
                yield pa.RecordBatch.from_arrays([ids.slice(a, z - a), pa.array([_print(x) for x in sets_], pa.binary()), binary(sets_)], ["rep", "print", "hashes"])

    sets = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").mapInArrow(gather, "rep long, print binary, hashes binary")
    sets = durable(sets.join(able, ["rep", "print"]).dropDuplicates(["rep", "print"]).select("rep", "n", "hashes"), "sets")
    links = durable(reduce(DataFrame.unionByName, (_grown(sets, k, percent) for k in range(ROUNDS))).distinct(), "links")
    grown = durable(components(links.toDF("a", "b")), "grown")
    comps = sets.select("rep").join(grown.toDF("rep", "comp"), "rep", "left").select("rep", F.coalesce("comp", "rep").alias("comp"))
    known = durable(sets.join(comps, "rep"), "known")
    posts = _postings(known, tokens, parts, percent)
    mixed = durable(posts.groupBy("token", "band").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("role").alias("r")).filter("x < y AND r = 0").select("token", "band"), "tiles")
    lot = F.pmod(F.xxhash64("token", "band"), F.lit(parts))
    met = posts.join(mixed, ["token", "band"], "left_semi").join(durable(_signed(known), "signed"), "rep")
    pairs = met.groupBy(lot.alias("lot")).applyInArrow(lambda t: _candidates(t, percent), "a long, b long").distinct()
    pairs = durable(pairs, "pairs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([np.frombuffer(v.as_py(), np.uint64) for v in b.column(k)] for k in (2, 3))
            yield b.select([0, 1]).filter(pa.array([linked(u, v, percent) for u, v in zip(x, y)], pa.bool_()))

    side = lambda k: known.select(F.col("rep").alias(k), F.col("hashes").alias(f"h{k}"), F.col("comp").alias(f"c{k}"))
    edges = pairs.join(side("a"), "a").join(side("b"), "b").select("ca", "cb", "ha", "hb").mapInArrow(verify, "ca long, cb long").toDF("a", "b")
    joined = components(edges)
    final = comps.join(joined.withColumnRenamed("node", "comp"), "comp", "left").select("rep", F.coalesce("component", "comp").alias("component"))
    named = classes.join(final, "rep", "left").select("print", F.coalesce("component", "rep").alias("component_id"))
    return stats.join(named, "print", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
