"""Secret scan with multipart credential linking.

Base findings stand on their own: assignments of secrets, access identifiers and long hexadecimal runs. Weak candidates
(a bare 40-character secret, a service endpoint, a short value beside a credential's name) say little alone; they are
reported only when an interval join finds complementary parts in one scope: an access identifier with a bare secret, or an
endpoint with an identifier or a secret, be it a short one.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{24,}")
_NAMED = re.compile(r"(?i:passw|secret|token|api_?key)", re.ASCII)
#: Weak parts. An equals sign before a secret ends its name (KEY=VALUE), after it it is padding.
BARE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/]*[0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", re.ASCII)
ENDPOINT = re.compile(r"(?:https?|postgres(?:ql)?|mysql|redis|mongodb|amqp|s3)://[^\s\"'<>]{4,}", re.ASCII)
KINDS = ("assign", "access", "hex", "bare", "endpoint", "short")
#: An assigned value of fewer characters is a weak part.
LEAST = 6
#: Code points between two parts of one credential, at most.
SCOPE = 400

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    out = []
    if _NAMED.search(text):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # a run of 24 or more is what is left of the maximal runs once shorter ones are dropped
    out += [(m.start(), m.end(), "hex") for m in _LONG_HEX.finditer(text)]
    return out


def weak_spans(text: str) -> list[Span]:
    out = [(m.start(), m.end(), "bare") for m in BARE.finditer(text)]
    if "://" in text:
        out += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
        if _NAMED.search(text):  # only an endpoint links short values
            out += [(m.start(), m.end(), "short") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) < LEAST]
    return out


def link(text: str, base: list[Span], weak: list[Span], scope: int = SCOPE) -> list[Span]:
    """The weak spans that have a complementary part in their scope: at most ``scope`` code points away, in one paragraph.

    Both sides are sorted by start and joined as intervals: of the parts that start before the scope's end, the furthest end
    has to reach its beginning. So a text with n parts costs O(n log n) and no pair is listed.
    """
    if not weak:
        return []
    breaks = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    beside = {"bare": ("access", "endpoint"), "endpoint": ("access", "assign", "bare", "hex", "short"), "short": ("endpoint",)}
    sides = {k: sorted((s, e) for s, e, kind in base + weak if kind in kinds) for k, kinds in beside.items()}
    starts = {k: [s for s, _ in v] for k, v in sides.items()}
    furthest = {k: list(accumulate((e for _, e in v), max)) for k, v in sides.items()}
    taken = [(s, e) for s, e, _ in base]
    out = []
    for s, e, kind in weak:
        if any(a < e and s < b for a, b in taken):  # a base span already covers it
            continue
        at = bisect_right(breaks, s)
        # parts hold no line break, so one that ends after a paragraph's first place lies in it
        low, high = (breaks[at - 1] if at else 0) + 1, (breaks[at] if at < len(breaks) else len(text))
        low, high = max(low, s - scope), min(high, e + scope)
        i = bisect_right(starts[kind], high)
        if i and furthest[kind][i - 1] >= low:
            out.append((s, e, kind))
    return out


def scan(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and linked weak spans of one text, sorted by start, then kind as listed."""
    text = text or ""
    key = lambda x: (x[0], KINDS.index(x[2]))
    base = sorted(base_spans(text), key=key)
    if not any(kind in ("access", "assign", "hex") for _, _, kind in base) and "://" not in text:
        return base, []  # a weak part needs one of these beside it
    return base, sorted(link(text, base, weak_spans(text)), key=key)


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{s}:{e}" for s, e, kind in spans)


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id and ``found``, an array of (kind, start, end, weak, value); code points, end exclusive.

    Null text counts as empty and has no findings. Every row of a repeated document is scanned; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("weak", pa.bool_()), ("value", pa.string())])
        for b in batches:
            found = []
            for t in b.column(1):
                t = t.as_py() or ""
                base, more = scan(t)
                found.append([{"kind": k, "start": s, "end": e, "weak": weak, "value": t[s:e]} for part, weak in ((base, False), (more, True)) for s, e, k in part])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(item))], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, found array<struct<kind:string,start:long,end:long,weak:boolean,value:string>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts and listings of ``secret_spans``: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked."""
    order = "array_sort(found, (a, b) -> CASE WHEN a.start != b.start THEN CAST(sign(a.start - b.start) AS INT) ELSE CAST(sign(array_position(array('assign','access','hex','bare','endpoint'), a.kind) - array_position(array('assign','access','hex','bare','endpoint'), b.kind)) AS INT) END)"
    text = lambda a: f"array_join(transform({a}, x -> concat_ws(':', x.kind, x.start, x.end)), ',')"
    count = lambda k: F.expr(f"CAST(size(filter(found, x -> x.kind = '{k}')) AS LONG)").alias(f"n_{k}")
    return found.withColumn("found", F.expr(order)).select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(F.expr(text("filter(found, x -> NOT x.weak)")), 256).alias("base_sha256"), F.expr(text("found")).alias("spans"),
        F.expr("CAST(size(filter(found, x -> x.weak)) AS LONG)").alias("n_linked"),
    )
