"""The registered queries over the driver's tables, each with the SQL that gives the same rows.

QTY: daily sum of lineitem.l_quantity. ORD: orders a day. EVT: events.value in cents, one series for each event type. All are
whole numbers, so sums are exact and results agree to the last bit with any engine that divides and takes roots alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from .operators import contrast as ct
from .operators import mass as ms
from .operators import profile as pf
from .operators import rolling as ro
from .plans import relational as sql
from .sources import as_series, daily, read_table, zone

Query = Callable[[SparkSession, str], DataFrame]
W, LONG, FAR = 30, 50, 64
LOW = zone(W, 0.5) + 1


def qty(spark: SparkSession, folder: str) -> DataFrame:
    return daily(read_table(spark, folder, "lineitem"), "l_shipdate", F.col("l_quantity"))


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return daily(read_table(spark, folder, "orders"), "o_orderdate")


def events(spark: SparkSession, folder: str) -> DataFrame:
    return as_series(read_table(spark, folder, "events"), F.round(F.col("value") * 100).cast("bigint"), "event_id", "event_type")


def halves(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """QTY before 1998 and from 1998 on."""
    rows = read_table(spark, folder, "lineitem")
    late = F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp")
    return tuple(daily(rows.filter(c), "l_shipdate", F.col("l_quantity")) for c in (~late, late))


def _days(name: str, table: str, day: str, total: str, where: str = "TRUE") -> str:
    return f"""{name}_d AS (SELECT CAST({day} AS DATE) AS day, CAST({total} AS BIGINT) AS value FROM {table} WHERE {where} GROUP BY 1),
    {name}_r AS (SELECT min(day) AS a, max(day) AS b FROM {name}_d),
    {name} AS (SELECT 'all' AS series_id, datediff('day', a, CAST(g AS DATE)) + 1 AS pos, CAST(coalesce(value, 0) AS BIGINT) AS value
        FROM {name}_r, LATERAL (SELECT unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS g) LEFT JOIN {name}_d ON day = CAST(g AS DATE))"""


QTY = _days("qty", "lineitem", "l_shipdate", "sum(l_quantity)")
ORD = _days("ord", "orders", "o_orderdate", "count(*)")
NEG = _days("neg", "lineitem", "l_shipdate", "sum(l_quantity)", "l_shipdate < TIMESTAMP '1998-01-01'")
POS = _days("posi", "lineitem", "l_shipdate", "sum(l_quantity)", "l_shipdate >= TIMESTAMP '1998-01-01'")
EVT = "evt AS (SELECT event_type AS series_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS pos, CAST(round(value * 100) AS BIGINT) AS value FROM events)"

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Query, oracle: str | None = None) -> None:
    QUERIES[name] = query
    if oracle:
        ORACLES[name] = oracle


# Rolling statistics over EVT.

_ROLL = f"""WITH {EVT}, r AS (SELECT series_id, pos, CAST(sum(value) OVER f AS BIGINT) AS s, CAST(sum(value * value) OVER f AS BIGINT) AS q, min(value) OVER f AS low, max(value) OVER f AS high, count(*) OVER f AS n
    FROM evt WINDOW f AS (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {LONG - 1} FOLLOWING)),
    m AS (SELECT *, CAST(s AS DOUBLE) / n AS avg, CAST(n * q - s * s AS DOUBLE) / CAST(n * n AS DOUBLE) AS var FROM r WHERE n = {LONG})
    SELECT series_id, pos, """
_SIG = f"CASE WHEN var > 0 THEN sqrt(1.0 / (var * {LONG})) END AS sig"
for _name, _value in (("mov_sum", "s"), ("mov_mean", "avg"), ("mov_var", "var")):
    for _kind in ("ogita", "normal"):
        add(_name + ("_normal" if _kind == "normal" else ""), lambda s, d, f=getattr(ro, _name), k=_kind: f(events(s, d), LONG, k), f"{_ROLL} {_value} AS {_name} FROM m")
add("mov_std", lambda s, d: ro.mov_std(events(s, d), LONG), f"{_ROLL} sqrt(var) AS mov_std FROM m")
add("mov_min", lambda s, d: ro.mov_min(events(s, d), LONG), f"{_ROLL} low AS mov_min FROM m")
add("mov_max", lambda s, d: ro.mov_max(events(s, d), LONG), f"{_ROLL} high AS mov_max FROM m")
add("movmean_std", lambda s, d: ro.movmean_std(events(s, d), LONG), f"{_ROLL} avg, sqrt(var) AS sd, {_SIG}, s AS sum, CAST(q AS DOUBLE) AS sqrsum FROM m")
add("muinvn", lambda s, d: ro.muinvn(events(s, d), LONG), f"{_ROLL} avg, {_SIG} FROM m")
_MOMENTS = f"{EVT}, mo AS (SELECT series_id, count(*) AS n, CAST(sum(value) AS BIGINT) AS s, CAST(sum(value * value) AS BIGINT) AS q FROM evt GROUP BY 1), me AS (SELECT *, CAST(s AS DOUBLE) / n AS mean, sqrt(CAST(n * q - s * s AS DOUBLE) / CAST(n * n AS DOUBLE)) AS sd FROM mo)"
add(
    "zero_crossing",
    lambda s, d: ro.zero_crossing(events(s, d), LONG),
    f"""WITH {_MOMENTS}, z AS (SELECT e.series_id, e.pos, sign(e.value - m.mean) AS side FROM evt e JOIN me m USING (series_id)),
    y AS (SELECT *, CAST(side * lag(side) OVER (PARTITION BY series_id ORDER BY pos) < 0 AS INTEGER) AS flag FROM z),
    x AS (SELECT series_id, pos, CAST(coalesce(sum(flag) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {LONG - 2} FOLLOWING), 0) AS INTEGER) AS zero_crossing,
          count(*) OVER (PARTITION BY series_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {LONG - 1} FOLLOWING) AS n FROM y)
    SELECT series_id, pos, zero_crossing FROM x WHERE n = {LONG}""",
)

# Recursive rolling statistics over QTY, rounded as engines add in different orders.

for _kind in ("fading", "weighted"):
    _weight = f"pow(0.9e0, k / {W}.0e0)" + ("" if _kind == "fading" else f" - CASE WHEN k >= {W} THEN pow(0.9e0, (k - 1) / {W}.0e0) ELSE 0 END")
    _fold = f"""WITH {QTY}, j AS (SELECT a.pos AS i, a.pos - b.pos AS k, CAST(b.value AS DOUBLE) AS x FROM qty a JOIN qty b ON b.pos <= a.pos WHERE a.pos >= {W}),
    t AS (SELECT i, sum(({_weight}) * x) AS sx, sum(({_weight}) * x * x) AS sq, sum({_weight}) AS s1 FROM j GROUP BY i)
    SELECT 'all' AS series_id, i - {W - 1} AS pos, """
    for _name, _value in (("mov_sum", "sx"), ("mov_mean", "sx / s1"), ("mov_var", "sq / s1 - (sx / s1) * (sx / s1)")):
        add(f"{_name}_{_kind}", lambda s, d, f=getattr(ro, _name), k=_kind, n=_name: f(qty(s, d), W, k).withColumn(n, F.round(n, 4)), f"{_fold} round({_value}, 4) AS {_name} FROM t")

# Helper functions.

add("znorm", lambda s, d: fn.znorm(events(s, d)), f"WITH {_MOMENTS} SELECT series_id, pos, CASE WHEN sd <= 0.01 THEN value - mean ELSE (value - mean) / sd END AS value FROM evt JOIN me USING (series_id)")
add("std", lambda s, d: fn.std(events(s, d)), f"WITH {_MOMENTS} SELECT series_id, sd AS std FROM me")
add(
    "normalize",
    lambda s, d: fn.normalize(events(s, d), 1, 5),
    f"WITH {EVT}, r AS (SELECT series_id, min(value) AS low, max(value) AS high FROM evt GROUP BY 1) SELECT series_id, pos, CASE WHEN high > low THEN least(greatest(1e0 + 4e0 * (CAST(value - low AS DOUBLE) / CAST(high - low AS DOUBLE)), 1e0), 5e0) END AS value FROM evt JOIN r USING (series_id)",
)
add("complexity", lambda s, d: fn.complexity(events(s, d)), f"WITH {EVT}, l AS (SELECT series_id, value - lag(value) OVER (PARTITION BY series_id ORDER BY pos) AS d FROM evt) SELECT series_id, sqrt(CAST(coalesce(sum(d * d), 0) AS DOUBLE)) AS complexity FROM l GROUP BY 1")
add(
    "mode",
    lambda s, d: fn.mode(events(s, d)),
    f"WITH {EVT}, c AS (SELECT series_id, value, count(*) AS n, min(pos) AS f FROM evt GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY n DESC, f) AS r FROM c) SELECT series_id, value AS mode FROM o WHERE r = 1",
)
add(
    "binary_split",
    lambda s, d: fn.binary_split(s, 50),
    """WITH RECURSIVE sp(lvl, k, low, high) AS (SELECT 1, CAST(0 AS BIGINT), 2, 50 UNION ALL
        SELECT lvl + 1, 2 * k + c, CASE WHEN c = 0 THEN low ELSE (low + high) // 2 + 1 END, CASE WHEN c = 0 THEN (low + high) // 2 - 1 ELSE high END
        FROM sp, (VALUES (0), (1)) v(c) WHERE (c = 0 AND low < (low + high) // 2) OR (c = 1 AND (low + high) // 2 < high))
    SELECT row_number() OVER (ORDER BY lvl, k) AS pos, idx FROM (SELECT 0 AS lvl, CAST(0 AS BIGINT) AS k, 1 AS idx UNION ALL SELECT lvl, k, (low + high) // 2 FROM sp)""",
)

# Distance profiles over QTY: its window at 100 against all.

_WEIGHTS = list(range(1, W + 1))
_MASS = f"""WITH {QTY}, q AS (SELECT pos - 100 AS k, value AS qv, pos - 99 AS wt FROM qty WHERE pos BETWEEN 100 AND {99 + W}),
    qs AS (SELECT CAST(sum(qv) AS BIGINT) AS sq, CAST(sum(qv * qv) AS BIGINT) AS sqq, CAST(sum(wt * qv) AS BIGINT) AS wq, CAST(sum(wt * qv * qv) AS BIGINT) AS wqq, CAST(sum(wt) AS BIGINT) AS w1 FROM q),
    x AS (SELECT d.pos - k AS pos, CAST(sum(value * qv) AS BIGINT) AS dot, CAST(sum(value) AS BIGINT) AS s, CAST(sum(value * value) AS BIGINT) AS ss, CAST(sum(wt * value) AS BIGINT) AS wx,
          CAST(sum(wt * value * value) AS BIGINT) AS wxx, CAST(sum(wt * value * qv) AS BIGINT) AS wxq FROM qty d, q WHERE d.pos - k >= 1 GROUP BY 1 HAVING count(*) = {W}),
    y AS (SELECT *, CAST({W} * ss - s * s AS DOUBLE) AS spread, CAST({W} * sqq - sq * sq AS DOUBLE) AS spread_q, s / {W}.0e0 AS mean, sq / {W}.0e0 AS mean_q FROM x, qs),
    z AS (SELECT *, sqrt(spread) / {W}.0e0 AS sd, sqrt(spread_q) / {W}.0e0 AS sd_q FROM y WHERE spread > 0)
    SELECT 'all' AS series_id, pos, """
_PROFILES = {
    "normalized": (f"greatest(0e0, {2 * W}.0e0 * (1e0 - CAST({W} * dot - s * sq AS DOUBLE) / sqrt(spread * spread_q)))", "CAST(dot AS DOUBLE)"),
    "non_normalized": (f"greatest(0e0, {W}.0e0 - 2e0 * ((dot - mean * sq) / sd) + sqq)", "CAST(dot AS DOUBLE)"),
    "absolute": ("CAST(ss - 2 * dot + sqq AS DOUBLE)", "CAST(dot AS DOUBLE)"),
    "weighted": (
        "greatest(0e0, (wxx - 2 * mean * wx + mean * mean * w1) / (sd * sd) - 2 * ((wxq - mean * wq - mean_q * wx + mean * mean_q * w1) / (sd * sd_q)) + (wqq - 2 * mean_q * wq + mean_q * mean_q * w1) / (sd_q * sd_q))",
        "(wxq - mean_q * wx) / sd_q",
    ),
}
for _kind, (_far, _dot) in _PROFILES.items():
    add(f"mass_{_kind}", lambda s, d, k=_kind: ms.mass(q := qty(s, d), q, W, 100, k, _WEIGHTS if k == "weighted" else None), f"{_MASS} {_far} AS distance_profile, {_dot} AS last_product FROM z")
add("mass_v2", lambda s, d: ms.mass(q := qty(s, d), q, W, 100, version="v2"), ORACLES["mass_normalized"])
_PRE = f"""WITH {QTY}, r AS (SELECT series_id, pos, CAST(sum(value) OVER f AS BIGINT) AS s, CAST(sum(value * value) OVER f AS BIGINT) AS q, count(*) OVER f AS n FROM qty WINDOW f AS (ORDER BY pos ROWS BETWEEN CURRENT ROW AND {W - 1} FOLLOWING)),
    m AS (SELECT series_id, pos, CAST(s AS DOUBLE) / n AS avg, sqrt(CAST(n * q - s * s AS DOUBLE) / CAST(n * n AS DOUBLE)) AS sd, CAST(q AS DOUBLE) AS sqrsum FROM r WHERE n = {W}),
    sides AS (SELECT 'data' AS side UNION ALL SELECT 'query')"""
add("mass_pre", lambda s, d: ms.mass_pre(qty(s, d), W), f"{_PRE} SELECT series_id, pos, avg, sd, side FROM m, sides")
add("mass_pre_absolute", lambda s, d: ms.mass_pre(qty(s, d), W, type="absolute"), f"{_PRE} SELECT series_id, pos, sqrsum, side FROM m, sides")
add(
    "mass_pre_weighted",
    lambda s, d: ms.mass_pre(qty(s, d), W, type="weighted", weights=_WEIGHTS).withColumn("pre", F.round("pre", 6)),
    f"""{_PRE}, p AS (SELECT m.pos, round(sum((x.pos - m.pos + 1) * pow((x.value - m.avg) / m.sd, 2)), 6) AS pre FROM m JOIN qty x ON x.pos BETWEEN m.pos AND m.pos + {W - 1} GROUP BY 1)
    SELECT series_id, pos, avg, sd, CASE WHEN side = 'data' THEN pre END AS pre, side FROM m JOIN p USING (pos), sides""",
)

# Profiles of one series.


def _self_sql(where: str = "TRUE", source: str = "qty", cte: str = QTY, w: int = W, low: int = LOW) -> str:
    return f"WITH {cte}, {sql.self_pairs(source, w, low, where)}, two AS (SELECT series_id, i, j, rho FROM pairs UNION ALL SELECT series_id, j, i, rho FROM pairs), b AS ({sql.best('two')})"


def _profile_sql(pearson: bool = False, w: int = W, partial: str = "false") -> str:
    value = sql.correlation("b.rho") if pearson else f"coalesce({sql.distance('b.rho', w)}, 'Infinity'::DOUBLE)"
    return f" SELECT st.series_id, st.pos, {value} AS matrix_profile, coalesce(b.j, -1) AS profile_index, {partial} AS partial, CAST(0.5 AS DOUBLE) AS ez FROM st LEFT JOIN b ON b.series_id = st.series_id AND b.i = st.pos"


_PLAIN = _self_sql() + _profile_sql()
add("mpx_self", lambda s, d: pf.mpx(qty(s, d), W), _PLAIN)
add("stamp_self", lambda s, d: pf.stamp(qty(s, d), W), _PLAIN)
add("stomp_self", lambda s, d: pf.stomp(qty(s, d), W), _PLAIN)
add("scrimp_self", lambda s, d: pf.scrimp(qty(s, d), W), _PLAIN)
add("mpx_no_index", lambda s, d: pf.mpx(qty(s, d), W, idxs=False), f"SELECT series_id, pos, matrix_profile, partial, ez FROM ({_PLAIN})")
add("mpx_pearson", lambda s, d: pf.mpx(qty(s, d), W, distance="pearson"), _self_sql() + _profile_sql(pearson=True))
_SIDES = f", lb AS ({sql.best('(SELECT series_id, j AS i, i AS j, rho FROM pairs)')}), rb AS ({sql.best('pairs')})"
_SIDE = lambda t, n: f"coalesce({sql.distance(f'{t}.rho', W)}, 'Infinity'::DOUBLE) AS {n}_matrix_profile, coalesce({t}.j, -1) AS {n}_profile_index"
add(
    "stomp_left_right",
    lambda s, d: pf.stomp(qty(s, d), W, left_right_profile=True),
    _self_sql() + _SIDES + f" SELECT p.*, {_SIDE('lb', 'left')}, {_SIDE('rb', 'right')} FROM ({_profile_sql()}) p LEFT JOIN lb ON lb.i = p.pos LEFT JOIN rb ON rb.i = p.pos",
)
_LAGS = f"(q.d < {LOW} + floor(0.25 * ((SELECT max(pos) FROM st) - {LOW}) + 0.5) OR (q.i - 1) % 7 = 0 OR (q.i + q.d - 1) % 7 = 0)"
add("scrimp_partial", lambda s, d: pf.scrimp(qty(s, d), W, s_size=0.25), _self_sql(_LAGS) + _profile_sql(partial="true"))
add("stamp_partial", lambda s, d: pf.stamp(qty(s, d), W, s_size=0.25))
add("mpx_partial", lambda s, d: pf.mpx(qty(s, d), W, s_size=0.25))
_EVT_LOW = zone(FAR, 0.5) + 1
add("mpx_tiled", lambda s, d: pf.mpx(events(s, d), FAR), _self_sql(source="evt", cte=EVT, w=FAR, low=_EVT_LOW) + _profile_sql(w=FAR))
add("mpx_right", lambda s, d: pf.mpx_right(qty(s, d), W, time_constraint=365).drop("left_matrix_profile", "left_profile_index"), f"{_self_sql('q.d <= 365')}, rb AS ({sql.best('pairs')}) SELECT st.series_id, st.pos, {sql.correlation('rb.rho')} AS right_matrix_profile, coalesce(rb.j, -1) AS right_profile_index FROM st LEFT JOIN rb ON rb.i = st.pos")
add("mpx_left", lambda s, d: pf.mpx_right(qty(s, d), W, time_constraint=365).drop("right_matrix_profile", "right_profile_index"), f"{_self_sql('q.d <= 365')}, lb AS ({sql.best('(SELECT series_id, j AS i, i AS j, rho FROM pairs)')}) SELECT st.series_id, st.pos, {sql.correlation('lb.rho')} AS left_matrix_profile, coalesce(lb.j, -1) AS left_profile_index FROM st LEFT JOIN lb ON lb.i = st.pos")


def top_motif(spark: SparkSession, folder: str) -> DataFrame:
    """The closest pair of windows."""
    return pf.mpx(qty(spark, folder), W).orderBy("matrix_profile", "pos").limit(1).select("series_id", "pos", "profile_index", "matrix_profile")


def top_discord(spark: SparkSession, folder: str) -> DataFrame:
    """The window that is farthest from its nearest neighbour."""
    found = pf.mpx(qty(spark, folder), W).filter("profile_index > 0")
    return found.orderBy(F.desc("matrix_profile"), "pos").limit(1).select("series_id", "pos", "profile_index", "matrix_profile")


add("top_motif", top_motif, f"SELECT series_id, pos, profile_index, matrix_profile FROM ({_PLAIN}) ORDER BY matrix_profile, pos LIMIT 1")
add("top_discord", top_discord, f"SELECT series_id, pos, profile_index, matrix_profile FROM ({_PLAIN}) WHERE profile_index > 0 ORDER BY matrix_profile DESC, pos LIMIT 1")

# Profiles of two series.

_CROSS = f"WITH {QTY}, {ORD}, {sql.cross_pairs('qty', 'ord', W)}, da AS ({sql.best('x_pairs', 'i')}), db AS ({sql.best('(SELECT j AS i, i AS j, rho FROM x_pairs)', 'i')})"
_SIDE_SQL = lambda t, b, mp, pi: f"SELECT 'all' AS series_id, s.pos, coalesce({sql.distance(f'{b}.rho', W)}, 'Infinity'::DOUBLE) AS {mp}, coalesce({b}.j, -1) AS {pi}, false AS partial, CAST(0 AS DOUBLE) AS ez FROM {t} s LEFT JOIN {b} ON {b}.i = s.pos WHERE s.c = {W}"
_ONE = f"{_CROSS} {_SIDE_SQL('x_a', 'da', 'matrix_profile', 'profile_index')}"
_BOTH = f"{_CROSS} SELECT 'data' AS side, * FROM ({_SIDE_SQL('x_a', 'da', 'profile', 'idx')}) UNION ALL SELECT 'query' AS side, * FROM ({_SIDE_SQL('x_b', 'db', 'profile', 'idx')})"


def _two(pair: tuple[DataFrame, DataFrame]) -> DataFrame:
    one, two = (p.select(F.lit(side).alias("side"), "series_id", "pos", F.col(mp).alias("profile"), F.col(pi).alias("idx"), "partial", "ez") for p, side, mp, pi in zip(pair, ("data", "query"), ("matrix_profile", "mpb"), ("profile_index", "pib")))
    return one.unionByName(two)


add("mpx_ab", lambda s, d: _two(pf.mpx(qty(s, d), W, orders(s, d))), _BOTH)
add("scrimp_ab", lambda s, d: _two(pf.scrimp(qty(s, d), W, orders(s, d))), _BOTH)
add("stamp_ab", lambda s, d: pf.stamp(qty(s, d), W, orders(s, d)), _ONE)
add("stomp_ab", lambda s, d: pf.stomp(qty(s, d), W, orders(s, d)), _ONE)

# Contrast.

_TOP = "sqrt(60e0)"


def _contrast_sql(pearson: bool) -> str:
    ab = f"greatest(coalesce({sql.correlation('da.rho')}, 0e0), 0e0)" if pearson else f"least(coalesce({sql.distance('da.rho', W)}, 'Infinity'::DOUBLE), {_TOP})"
    aa = f"greatest(coalesce({sql.correlation('b.rho')}, 0e0), 0e0)" if pearson else f"least(coalesce({sql.distance('b.rho', W)}, 'Infinity'::DOUBLE), {_TOP})"
    value = f"greatest(0e0, {aa} - {ab})" if pearson else f"greatest(0e0, ({ab} - {aa}) / {_TOP})"
    return f"""{_self_sql(source="posi", cte=f"{NEG}, {POS}")}, {sql.cross_pairs("posi", "neg", W)}, da AS ({sql.best("x_pairs", "i")}),
    cp AS (SELECT st.series_id, st.pos, {value} AS contrast_profile, coalesce(b.j, -1) AS nn_idx FROM st LEFT JOIN b ON b.i = st.pos LEFT JOIN da ON da.i = st.pos)"""


for _kind in ("euclidean", "pearson"):
    add("contrast" if _kind == "euclidean" else "contrast_pearson", lambda s, d, k=_kind: ct.contrast_profile(*halves(s, d), W, distance=k), f"{_contrast_sql(_kind == 'pearson')} SELECT * FROM cp")
add(
    "contrast_plato",
    lambda s, d: ct.contrast(*halves(s, d), W)[1].select("series_id", "plato_idx", "plato_nn_idx", F.array_join("plato", ",").alias("plato"), F.array_join("plato_nn", ",").alias("plato_nn"), "w", "ez", "euclidean"),
    f"""{_contrast_sql(False)}, t AS (SELECT * FROM cp ORDER BY contrast_profile DESC, pos LIMIT 1),
    v AS (SELECT t.pos AS p, t.nn_idx AS q, x.pos, CAST(CAST(x.value AS DOUBLE) AS VARCHAR) AS value FROM t, posi x)
    SELECT 'all' AS series_id, p AS plato_idx, q AS plato_nn_idx, string_agg(value, ',' ORDER BY pos) FILTER (WHERE pos BETWEEN p AND p + {W - 1}) AS plato,
           string_agg(value, ',' ORDER BY pos) FILTER (WHERE pos BETWEEN q AND q + {W - 1}) AS plato_nn, {W} AS w, CAST(0.5 AS DOUBLE) AS ez, true AS euclidean FROM v GROUP BY p, q""",
)

# Profiles of distances and correlations turned into each other.

add("ed_corr", lambda s, d: pf.mpx(qty(s, d), W).select("series_id", "pos", fn.ed_corr(F.col("matrix_profile"), W).alias("rho")), f"SELECT series_id, pos, ({2 * W}e0 - matrix_profile * matrix_profile) / {2 * W}e0 AS rho FROM ({_PLAIN})")
add("corr_ed", lambda s, d: pf.mpx(qty(s, d), W, distance="pearson").select("series_id", "pos", fn.corr_ed(F.col("matrix_profile"), W).alias("distance")), f"SELECT series_id, pos, {sql.distance('matrix_profile', W)} AS distance FROM ({_self_sql() + _profile_sql(pearson=True)})")

# Streams: EVT replayed in micro-batches.


def _folder(spark: SparkSession) -> str:
    import tempfile
    import uuid

    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="undula-")  # a local session, as in tests
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/replay-{uuid.uuid4().hex}"


def stream_right_profile(spark: SparkSession, folder: str, threshold: float = -1.0) -> DataFrame:
    from .streaming import latest, replay, right_profile

    series = events(spark, folder)
    longest = series.groupBy("series_id").count().agg(F.max("count")).first()[0] or 0  # nothing is dropped, as in the SQL
    rows = replay(series, _folder(spark), 4, lambda stream: right_profile(stream, LONG, history=max(longest, 2 * LONG), threshold=threshold, exact=True, packed=True))
    return latest(rows)


def stream_fading(spark: SparkSession, folder: str) -> DataFrame:
    from .streaming import fading, replay

    rows = replay(qty(spark, folder), _folder(spark), 4, lambda stream: fading(stream, W))
    return rows.select("series_id", "pos", *(F.round(c, 4).alias(c) for c in ("mov_sum", "mov_mean", "mov_var")))


_STREAM_LOW = zone(LONG, 0.5) + 1
_STREAM = lambda found: f"WITH {EVT}, {sql.self_pairs('evt', LONG, _STREAM_LOW)}, rb AS ({sql.best(found)}) SELECT st.series_id, st.pos, {sql.correlation('rb.rho')} AS right_matrix_profile, coalesce(rb.j, -1) AS right_profile_index FROM st LEFT JOIN rb ON rb.series_id = st.series_id AND rb.i = st.pos"
add("stream_right_profile", stream_right_profile, _STREAM("pairs"))
add("stream_threshold", lambda s, d: stream_right_profile(s, d, 0.45), _STREAM("(SELECT * FROM pairs WHERE rho >= 0.45)"))
add("stream_fading", stream_fading, f"SELECT series_id, pos, mov_sum, m.mov_mean, v.mov_var FROM ({ORACLES['mov_sum_fading']}) s JOIN ({ORACLES['mov_mean_fading']}) m USING (series_id, pos) JOIN ({ORACLES['mov_var_fading']}) v USING (series_id, pos)")
