"""Line deduplication by an exact set-similarity join, in DataFrame operations only.

A line is the set of its lower-cased words; of two lines whose sets have a Jaccard similarity of at least ``percent`` %, the
later one (by doc_id, then line number) is removed. Words become numbers that sort rare words first. A line posts the prefix
in which any similar line must share an entry; lines that share one become candidates if their sizes and the parities of
their hashed words still allow the similarity, and candidates are compared as sets of words.

An entry of the prefix is a rare word, or two words that follow one another in the order. Let x miss at most e words of y, and y
at most f of x. If x has more than e rare words, its first e + 1 words hold one that they share. Otherwise the two may share
no rare word; then all r rare words of x are among those missed, and of the pairs of neighbours among its other words at most
2 (e - r) + f are broken, two by a word missed and one by a word put in between. So the first 2 e + f - 2 r + 1 pairs hold
a shared one. Rare words have short lists and pairs are rare, so what is compared does not grow with the square of the corpus.

The positions of a shared entry bound the overlap as well: before the first one, all rare words are missed, and all pairs
are broken, in both lines. With 3 for each rare word before an entry and 1 for each pair, both together make at most 3 (e + f).
Two lines that share an entry among the few just before are paired off there, where both positions are lower, so a pair comes up
about once for each run of shared entries.

Equal sets are merged before (an aggregation with map-side combine), so a line repeated a million times is one line here.
Families of near copies are settled at linear cost: under a few keys of neighbouring words, each line is compared with the
earliest line or one just before it, whichever looks nearest. Lines that are not removed by that are compared with all earlier ones
that share an entry, the nearest first.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, join_counted, release

#: Least similarity in per cent; bits of the table of word counts; most occurrences of a rare word; keys that settle families;
#: how many lines before are tried under each, and how many pairs of a line first; how many entries back a shared one is sought.
PERCENT, COUNT_BITS, RARE, KEYS, NEAR, BACK = 80, 17, 1000, 3, 3, 3
_BLANK = "[\\\\x20\\\\x09-\\\\x0D]+"


def words_of(line: str) -> str:
    """SQL for the lower-cased words of a line, maybe with empty ones. Splitting at single spaces is faster than at a pattern."""
    return f"IF({line} RLIKE '[\\\\x09\\\\x0B-\\\\x0D]', split(lower({line}), '{_BLANK}'), split(lower({line}), ' '))"


def _level(count: str) -> str:
    return f"CAST(2 * log2(1 + {count}) AS INT)"


def _rarity(docs: DataFrame) -> str:
    """SQL for an array that has, for each hashed slot of words, a level that grows with the words counted in it.

    The table is of fixed size and counts all words of all documents; it orders words and tells rare ones, so words that
    share a slot cost speed, not results.
    """
    words = docs.select(F.explode(F.expr(words_of("replace(text, '\\n', ' ')"))).alias("w")).filter("w != ''")
    counts = words.groupBy(F.expr(f"shiftrightunsigned(xxhash64(w), {64 - COUNT_BITS})").alias("slot")).count()
    every = docs.sparkSession.range(1 << COUNT_BITS).withColumnRenamed("id", "slot")
    levels = every.join(counts, "slot", "left").select("slot", F.expr(_level("coalesce(count, 0)")).alias("level"))
    return "CAST(split('" + levels.agg(F.expr("array_join(transform(array_sort(collect_list(struct(slot, level))), x -> x.level), ',')")).first()[0] + "', ',') AS array<tinyint>)"


def _flips(half: int) -> str:
    """SQL for an array of what a word flips in one half of 128 parities, by 7 of its bits."""
    flips = [1 << k if k < 63 else -(1 << 63) for k in range(64)]
    return f"CAST(split('{','.join(map(str, flips + [0] * 64 if half else [0] * 64 + flips))}', ',') AS array<bigint>)"


def _lines(docs: DataFrame, percent: int) -> DataFrame:
    """doc, mark, line, n, r (rare words among the first e + 1), set_a and set_b (hashes of the set), even and more (parities of the words hashed to 128 bits), keys (that
    settle families) and prefix of all lines with words."""
    levels = _rarity(docs)
    rows = docs.select("doc", "mark", F.posexplode(F.split("text", "\n")).alias("line", "t")).filter("t RLIKE '[^\\\\x20\\\\x09-\\\\x0D]'")
    code = f"coalesce(shiftleft(CAST({levels}[shiftrightunsigned(h, {64 - COUNT_BITS})] AS BIGINT), 56), 0L) | shiftrightunsigned(h, 8)"
    hashed = f"array_except(transform({words_of('t')}, w -> xxhash64(w)), array(xxhash64('')))"
    rows = rows.select("doc", "mark", "line", F.expr(f"sort_array(transform({hashed}, h -> {code}))").alias("codes"))
    even, more = (f"aggregate(codes, 0L, (a, x) -> a ^ {_flips(half)}[x & 127])" for half in (0, 1))
    rows = rows.withColumn("even", F.expr(even)).withColumn("more", F.expr(more))
    rows = rows.withColumn("n", F.size("codes")).withColumn("e", F.expr(f"n * (100 - {percent}) DIV 100"))  # words that the other lacks, at most
    limit = f"shiftleft(CAST({_level(RARE)} AS BIGINT), 56)"
    rows = rows.withColumn("r", F.expr(f"size(filter(slice(codes, 1, e + 1), c -> c < {limit}))"))
    pairs = f"2 * n * (100 - {percent}) DIV 100 - 2 * r + 1"  # of so many pairs of neighbours, one is shared
    pairs = f"zip_with(slice(codes, r + 1, CAST(least(n - r - 1, {pairs}) AS INT)), slice(codes, r + 2, CAST(least(n - r - 1, {pairs}) AS INT)), (x, y) -> xxhash64(x, y))"
    small, none = f"n * (100 - {percent}) < {percent}", "CAST(array() AS array<bigint>)"  # of a size that only equal sets are similar to
    prefix = f"CASE WHEN {small} THEN {none} WHEN r > e THEN slice(codes, 1, CAST(e + 1 AS INT)) ELSE concat(slice(codes, 1, r), {pairs}) END"
    keys = f"IF({small}, {none}, array({', '.join(f'xxhash64(codes[{i}], get(codes, {i + 1}))' for i in range(KEYS))}))"
    return rows.select("doc", "mark", "line", "n", "r", F.xxhash64("codes").alias("set_a"), F.hash("codes").alias("set_b"), "even", "more", F.expr(keys).alias("keys"), F.expr(prefix).alias("prefix"))


_AWAY = "bit_count({a}.even ^ {b}.even) + bit_count({a}.more ^ {b}.more)"


def _can_be_similar(a: str, b: str, percent: int) -> str:
    """SQL that is false of lines that can't be: words that one has and the other lacks flip one parity each at most.
    Sizes of settled lines are negative."""
    away, n = _AWAY.format(a=a, b=b), f"(abs({a}.n) + abs({b}.n))"
    return f"{100 + percent} * least(abs({a}.n), abs({b}.n)) >= {percent} * {n} AND {100 + percent} * ({away}) <= {100 - percent} * {n}"


def _nearest(pairs: DataFrame, most: int = 1) -> DataFrame:
    """Of each line's pairs (doc, line, doc_0, line_0, away) the ``most`` of most agreeing parities."""
    place = F.row_number().over(Window.partitionBy("doc", "line").orderBy("away", "doc_0", "line_0"))
    return pairs.withColumn("place", place).filter(F.col("place") <= most).select("doc", "line", "doc_0", "line_0").distinct()


def _words(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """doc, mark, line and text of the lines of the durable ``pairs``."""
    ends = pairs.select("doc", "line").unionByName(pairs.select(F.col("doc_0").alias("doc"), F.col("line_0").alias("line")))
    asked = durable(ends.distinct(), "asked")
    near = join_counted(docs, durable(asked.select("doc").distinct(), "asked"), ["doc"], "left_semi")
    lines = join_counted(near.select("doc", "mark", F.posexplode(F.split("text", "\n")).alias("line", "t")), asked, ["doc", "line"])
    return durable(lines.select("doc", "mark", "line", "t"), "words")


def _compared(words: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Later lines (doc, mark, line) of those pairs (doc, line, doc_0, line_0) whose sets of words are similar."""
    old = words.select(F.col("doc").alias("doc_0"), F.col("line").alias("line_0"), F.col("t").alias("t_0"))
    both = pairs.join(words, ["doc", "line"]).join(old, ["doc_0", "line_0"])
    sets = ", ".join(f"array_remove(array_distinct({words_of(t)}), '') AS {x}" for t, x in (("t", "x"), ("t_0", "y")))
    alike = "100 * size(array_intersect(p.x, p.y)) >= {0} * (size(p.x) + size(p.y) - size(array_intersect(p.x, p.y)))".format(percent)
    return both.filter(f"transform(array(struct({sets})), p -> {alike})[0]").select("doc", "mark", "line").distinct()  # each set is made once


def later_lines(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc, mark and line of all lines to remove; ``docs`` has doc (long), mark (that tells rows of one doc apart) and text (not null)."""
    if not 75 <= percent <= 100:
        raise ValueError("percent is 75 to 100")  # below, short lines have too few pairs of words
    lines = durable(_lines(docs, percent), "lines")
    again = lines.groupBy("set_a", "set_b", "n").agg(F.min(F.struct("doc", "line")).alias("e"), F.count("*").alias("copies")).filter("copies > 1")
    again = durable(again.select("set_a", "set_b", "n", F.col("e.doc").alias("doc_0"), F.col("e.line").alias("line_0")), "again")
    known = join_counted(lines, again, ["set_a", "set_b", "n"], "left")
    copies = durable(known.filter("doc != doc_0 OR line != line_0").select("doc", "mark", "line"), "copies")
    sets = known.filter("doc_0 IS NULL OR (doc = doc_0 AND line = line_0)").select("doc", "line", "n", "r", "even", "more", "keys", "prefix")

    # families: the earliest line of a key, and those just before
    slim = ["doc", "line", "n", "even", "more"]
    by, one = Window.partitionBy("code").orderBy("doc", "line"), F.struct(*slim)
    ends = sets.select(*slim, F.explode("keys").alias("code")).select(F.hash("code").alias("code"), *slim)  # 32 bits, here and below: this can only add candidates
    ends = ends.select(one.alias("b"), F.array(F.first(one).over(by), *(F.lag(one, k).over(by) for k in range(1, NEAR + 1))).alias("a"))
    ends = ends.filter("a[1] IS NOT NULL").select("b", F.explode("a").alias("a")).filter("a IS NOT NULL")
    found = ["b.doc AS doc", "CAST(b.line AS INT) AS line", "a.doc AS doc_0", "CAST(a.line AS INT) AS line_0", f"{_AWAY.format(a='a', b='b')} AS away"]
    earlier = "(a.doc < b.doc OR (a.doc = b.doc AND a.line < b.line))"
    families = ends.filter(f"{_can_be_similar('a', 'b', percent)} AND {earlier}").selectExpr(*found)
    families = durable(_nearest(families.distinct()), "families")
    gone = durable(_compared(_words(docs, families), families, percent), "removed")

    # what is left against all; naming a column of both sides keeps the condition in the join, so one shuffle serves both
    settled = durable(gone.select("doc", "line", F.lit(True).alias("done")).distinct(), "settled")
    posts = join_counted(sets.drop("keys"), settled, ["doc", "line"], "left").withColumn("n", F.expr("IF(done, -n, n)"))
    posts = posts.select(*slim, "r", "prefix", F.posexplode("prefix").alias("k", "code"))
    back = [f"IF(k >= {i}, CAST(hash(get(prefix, k - {i})) AS BIGINT), 0L)" for i in range(1, BACK + 1)]  # 0: none
    low = 2**32 - 1  # few columns make short rows: line and place, two entries before, the third and n
    posts = posts.selectExpr("hash(code) AS code", *(f"coalesce({c}, 0L) AS {c}" for c in ("doc", "even", "more")), "shiftleft(coalesce(CAST(line AS BIGINT), 0L), 8) | coalesce(least(3 * least(k, r) + greatest(k - r, 0), 255), 0) AS at", f"shiftleft({back[0]}, 32) | ({back[1]} & {low}) AS back", f"shiftleft({back[2]}, 32) | (coalesce(CAST(n AS BIGINT), 0L) & {low}) AS more_back")
    unpacked = {"line": "shiftright({}.at, 8)", "place": "({}.at & 255)", "n": "shiftright(shiftleft({}.more_back, 32), 32)", "back_1": "shiftright({}.back, 32)", "back_2": "shiftright(shiftleft({}.back, 32), 32)", "back_3": "shiftright({}.more_back, 32)"}
    wide = lambda e: re.sub(r"\b([ab])\.(\w+)", lambda m: unpacked.get(m[2], f"{{}}.{m[2]}").format(m[1]), e)
    again = " OR ".join(f"(a.back_{i} = b.back_{j} AND a.back_{i} != 0)" for i in range(1, BACK + 1) for j in range(1, BACK + 1))
    places = f"{100 + percent} * (a.place + b.place) <= {3 * (100 - percent)} * (abs(a.n) + abs(b.n))"
    pairs = posts.alias("a").join(posts.alias("b"), F.expr(wide(f"a.code = b.code AND {earlier} AND (b.n > 0 OR a.line < 0) AND {_can_be_similar('a', 'b', percent)} AND {places} AND NOT ({again})")))
    pairs = durable(pairs.selectExpr(*map(wide, found)).distinct(), "pairs")
    release(lines)
    words = _words(docs, pairs)
    near = durable(_nearest(pairs, NEAR), "pairs")
    last = durable(_compared(words, near, percent), "removed")
    open_ = join_counted(pairs.drop("away"), durable(last.select("doc", "line").distinct(), "settled"), ["doc", "line"], "left_anti")
    rest = open_.join(near, ["doc", "line", "doc_0", "line_0"], "left_anti")
    return copies.unionByName(gone).unionByName(last).unionByName(_compared(words, rest, percent))


def line_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the later ones of similar lines, and n_lines (before) and n_removed; no row is dropped.

    Lines end with ``\\n``. A line without words is similar to none and stays; so do null and empty texts. A row without an id
    comes after all others, by a hash of its text. Ids should be unique: rows repeated with id and text count as one row
    and come out alike, and of rows that share an id only, lines of one number are not compared. Columns named n_lines or n_removed
    are replaced; others pass through, whatever their names. A text of any length costs in proportion to its words. An empty
    table gives an empty result.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    text = F.coalesce("text", F.lit(""))
    late = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(text), 2)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.coalesce(F.col("doc_id").cast("long"), late).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"))
    gone = durable(later_lines(rows.select("doc", "mark", "text"), percent).groupBy("doc", "mark").agg(F.collect_set("line").alias("gone")), "gone")  # of one document
    rows = join_counted(rows.withColumn("parts", F.split("text", "\n")), gone, ["doc", "mark"], "left")
    kept = "array_join(transform(array_except(sequence(0, size(parts) - 1), gone), i -> parts[i]), '\\n')"
    done = rows.select("row", F.expr(f"CASE WHEN gone IS NULL THEN row.text ELSE {kept} END").alias("text"), F.expr("IF(row.text IS NULL, 0L, CAST(size(parts) AS BIGINT))").alias("n_lines"), F.expr("CAST(coalesce(size(gone), 0) AS BIGINT)").alias("n_removed"))
    return done.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in names), "n_lines", "n_removed")
