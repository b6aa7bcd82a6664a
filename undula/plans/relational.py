"""All pairs of windows as SQL: the text of the plan for small series of whole numbers, for Spark and other engines."""

from __future__ import annotations


def self_pairs(source: str, window: int, low: int, where: str = "TRUE") -> str:
    """CTEs ``st`` (window sums) and ``pairs`` (series_id, i, j, rho; i < j) over ``source`` (series_id, pos, value).

    For each lag the products of values that far apart are summed over a sliding frame; sums of whole numbers are exact.
    """
    return f"""
    s AS (SELECT series_id, pos, CAST(value AS BIGINT) AS v FROM {source}),
    st AS (SELECT * FROM (SELECT series_id, pos, CAST(SUM(v) OVER f AS BIGINT) AS sx, CAST(SUM(v * v) OVER f AS BIGINT) AS sxx, COUNT(*) OVER f AS c
                          FROM s WINDOW f AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING)) WHERE c = {window}),
    pr AS (SELECT a.series_id, b.pos - a.pos AS d, a.pos AS i, a.v * b.v AS p FROM s a JOIN s b ON a.series_id = b.series_id AND b.pos - a.pos >= {low}),
    qt AS (SELECT * FROM (SELECT series_id, d, i, CAST(SUM(p) OVER g AS BIGINT) AS sxy, COUNT(*) OVER g AS c
                          FROM pr WINDOW g AS (PARTITION BY series_id, d ORDER BY i ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING)) WHERE c = {window}),
    pairs AS (SELECT q.series_id, q.i, q.i + q.d AS j, {_rho(window)} AS rho
              FROM qt q JOIN st a ON a.series_id = q.series_id AND a.pos = q.i JOIN st b ON b.series_id = q.series_id AND b.pos = q.i + q.d
              WHERE {window} * a.sxx - a.sx * a.sx > 0 AND {window} * b.sxx - b.sx * b.sx > 0 AND {where})"""


def cross_pairs(data: str, query: str, window: int, name: str = "x") -> str:
    """CTE ``{name}_pairs`` (i of data, j of query, rho) for one series on each side."""
    stats = lambda t, src: f"""{name}_{t} AS (SELECT pos, CAST(value AS BIGINT) AS v, CAST(SUM(CAST(value AS BIGINT)) OVER f AS BIGINT) AS sx, CAST(SUM(CAST(value AS BIGINT) * CAST(value AS BIGINT)) OVER f AS BIGINT) AS sxx, COUNT(*) OVER f AS c
        FROM {src} WINDOW f AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING))"""  # noqa: E731
    return f"""
    {stats("a", data)}, {stats("b", query)},
    {name}_qt AS (SELECT * FROM (SELECT b.pos - a.pos AS d, a.pos AS i, CAST(SUM(a.v * b.v) OVER g AS BIGINT) AS sxy, COUNT(*) OVER g AS c
               FROM {name}_a a CROSS JOIN {name}_b b WINDOW g AS (PARTITION BY b.pos - a.pos ORDER BY a.pos ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING)) WHERE c = {window}),
    {name}_pairs AS (SELECT q.i, q.i + q.d AS j, {_rho(window)} AS rho
              FROM {name}_qt q JOIN {name}_a a ON a.pos = q.i JOIN {name}_b b ON b.pos = q.i + q.d
              WHERE {window} * a.sxx - a.sx * a.sx > 0 AND {window} * b.sxx - b.sx * b.sx > 0)"""


def _rho(w: int) -> str:
    return f"CAST({w} * q.sxy - a.sx * b.sx AS DOUBLE) / sqrt(CAST({w} * a.sxx - a.sx * a.sx AS DOUBLE) * CAST({w} * b.sxx - b.sx * b.sx AS DOUBLE))"


def best(pairs: str, key: str = "series_id, i") -> str:
    """Best partner by ``key`` of pairs (.., i, j, rho): highest rho, then lowest j."""
    return f"SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {key} ORDER BY rho DESC, j) AS rn FROM {pairs}) WHERE rn = 1"


def distance(rho: str, window: int) -> str:
    return f"CASE WHEN {rho} IS NOT NULL THEN sqrt(greatest(CAST(0 AS DOUBLE), {2.0 * window} * (1.0 - least({rho}, 1.0)))) END"


def correlation(rho: str) -> str:
    return f"CASE WHEN {rho} IS NOT NULL THEN least({rho}, 1.0) END"
