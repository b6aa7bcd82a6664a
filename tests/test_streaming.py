import numpy as np
import pytest

from undula.operators.profile import mpx_right
from undula.streaming import extend, fading, replay, right_profile

X = np.random.default_rng(3).normal(size=150).cumsum()


@pytest.mark.parametrize("cuts", [[150], [40, 41, 42, 120, 150], list(range(7, 151, 7)) + [150]])
def test_any_cut_gives_the_same_profile(cuts):
    state, start, last = (np.zeros(0), np.zeros(0), np.zeros(0, np.int64), 0), 0, {}
    for to in cuts:
        *state, out = extend(*state, X[start:to], 8, 5, 10_000, None, False)
        last |= {p: (b, i) for p, b, i in zip(*out)}
        start = to
    v = np.lib.stride_tricks.sliding_window_view(X, 8)
    z = (v - v.mean(1, keepdims=True)) / v.std(1, keepdims=True)
    rho = z @ z.T / 8
    n = np.arange(len(rho))
    rho[n[None] - n[:, None] < 5] = -np.inf
    assert len(last) == len(rho)
    for i in range(len(rho) - 5):
        assert np.isclose(last[i + 1][0], rho[i].max()) and last[i + 1][1] == rho[i].argmax() + 1


def test_history_forgets():
    state = (np.zeros(0), np.zeros(0), np.zeros(0, np.int64), 0)
    for k in range(0, 150, 10):
        *state, out = extend(*state, X[k : k + 10], 8, 5, 40, None, False)
        assert len(state[0]) <= 40 and (out[0] > max(0, k + 10 - 50)).all()
    assert state[3] == 110


def test_stream_is_batch(spark, tmp_path):
    series = spark.createDataFrame([(s, i + 1, float(x)) for s in "ab" for i, x in enumerate(X)], "series_id string, pos long, value double")
    rows = replay(series, f"file://{tmp_path}", 3, lambda stream: right_profile(stream, 8, 1000)).toPandas()
    got = rows.sort_values("batch").groupby(["series_id", "pos"]).last()
    batch = mpx_right(series, 8).toPandas().set_index(["series_id", "pos"]).loc[got.index]
    assert (got.right_profile_index == batch.right_profile_index).all()
    assert np.allclose(got.right_matrix_profile, batch.right_matrix_profile.astype(float), equal_nan=True)


def test_fading_stream(spark, tmp_path):
    from undula.operators.rolling import mov_mean

    series = spark.createDataFrame([("a", i + 1, float(x)) for i, x in enumerate(X)], "series_id string, pos long, value double")
    got = replay(series, f"file://{tmp_path}", 4, lambda stream: fading(stream, 9)).orderBy("pos").toPandas()
    assert np.allclose(got.mov_mean, mov_mean(series, 9, "fading").orderBy("pos").toPandas().mov_mean)


def test_query_holds_the_longest_series(spark, monkeypatch):
    from undula import queries, streaming

    held = []

    def profile(stream, window, history, **more):
        held.append(history)
        return stream.selectExpr("series_id", "pos", "0D AS right_matrix_profile", "1L AS right_profile_index", "0L AS batch")

    monkeypatch.setattr(streaming, "right_profile", profile)
    monkeypatch.setattr(streaming, "replay", lambda series, folder, n, plan: plan(series))
    for n in (1_200_000, 0):
        monkeypatch.setattr(queries, "events", lambda spark, folder: spark.range(n).selectExpr("'a' AS series_id", "id + 1 AS pos", "1L AS value"))
        queries.stream_right_profile(spark, "")
    assert held == [1_200_000, 2 * queries.LONG]


@pytest.mark.parametrize("kind", range(4))
@pytest.mark.parametrize("threshold", [-1.0, 0.8])
def test_windows_that_come_again(kind, threshold):
    """Whole numbers with copies, multiples and ties: the best later partner of each window and the lowest of equal ones."""
    rng, w, low = np.random.default_rng(kind), 5, 4
    base = [rng.integers(0, 3, 60), rng.integers(0, 1000, 60), rng.integers(0, 2, 60) * rng.integers(1, 5, 60), 2 * np.arange(60)][kind]
    x = np.concatenate([base] * 3 + [rng.integers(0, 4, 40), 2 * base[:30]]).astype(float)
    v = np.lib.stride_tricks.sliding_window_view(x, w)
    cross = w * (v @ v.T) - np.outer(v.sum(1), v.sum(1))
    spread = np.diag(cross)
    with np.errstate(all="ignore"):
        rho = cross / np.sqrt(np.outer(spread, spread))
    n = np.arange(len(v))
    rho[(spread == 0)[:, None] | (spread == 0)[None] | (n[None] - n[:, None] < low) | (rho < threshold)] = -np.inf
    state, start, last = (np.zeros(0), np.zeros(0), np.zeros(0, np.int64), 0), 0, {}
    for to in (3, 50, 140, 141, len(x)):
        *state, out = extend(*state, x[start:to], w, low, 10_000, None, True, threshold)
        last |= {p: (b, i) for p, b, i in zip(*out)}
        start = to
    best = rho.max(1)
    assert [last[i + 1] for i in n] == list(zip(best, np.where(best > -np.inf, rho.argmax(1) + 1, -1)))


def test_windows_that_come_again_are_compared_once(monkeypatch):
    from undula import streaming

    compared, rho = [], streaming.Windows.rho
    monkeypatch.setattr(streaming.Windows, "rho", lambda a, b: compared.append(len(a) * len(b)) or rho(a, b))
    x = np.tile(np.random.default_rng(2).integers(0, 10_000, 500), 20).astype(float)
    extend(np.zeros(0), np.zeros(0), np.zeros(0, np.int64), 0, x, 8, 5, 100_000, None, True)
    assert sum(compared) < 2 * 500**2


def test_windows_with_their_best_partner_are_left_alone(monkeypatch):
    from undula import streaming

    hashed, shapes = [], streaming.shapes
    monkeypatch.setattr(streaming, "shapes", lambda *args: hashed.append(len((out := shapes(*args))[2])) or out)
    x = np.tile(np.random.default_rng(2).integers(0, 10_000, 500), 20).astype(float)
    state = (np.zeros(0), np.zeros(0), np.zeros(0, np.int64), 0)
    for k in range(0, len(x), 1000):
        *state, out = extend(*state, x[k : k + 1000], 8, 5, 100_000, None, True)
    assert len(hashed) == 10 and max(hashed) < 1000 + 2 * 500


def test_replay_makes_the_series_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    def count(parts):
        for rows in parts:
            made.add(len(rows))
            yield rows

    series = spark.range(1, 41).selectExpr("IF(id % 2 = 0, NULL, 'a') AS series_id", "(id + 1) DIV 2 AS pos", "CAST(id * id % 7 AS DOUBLE) AS value").mapInPandas(count, "series_id string, pos long, value double")
    rows = replay(series, f"file://{tmp_path}", 4, lambda stream: right_profile(stream, 4, 100)).toPandas()
    assert made.value == 40 and rows.groupby(["series_id", "pos"], dropna=False).ngroups == 2 * 17


def test_rows_travel_packed(spark, tmp_path):
    """Micro-batches hold packs of rows; of packed profiles ``latest`` finds the last row of each window, over spans of positions."""
    from undula.streaming import latest

    x = np.tile(np.random.default_rng(7).integers(0, 1000, 400), 3)
    series = spark.createDataFrame([(s, i + 1, int(v)) for s in ("a", None) for i, v in enumerate(x)], "series_id string, pos long, value long")
    rows = replay(series, f"file://{tmp_path}", 3, lambda stream: right_profile(stream, 8, 2000, exact=True, packed=True))
    assert spark.read.parquet(f"file://{tmp_path}/in").count() < 100 and rows.count() == 6
    got = latest(rows).toPandas()
    *_, out = extend(np.zeros(0), np.zeros(0), np.zeros(0, np.int64), 0, x.astype(float), 8, 5, 2000, None, True)
    for mine in (got[got.series_id == "a"], got[got.series_id.isna()]):
        mine = mine.sort_values("pos")
        assert (mine.pos == out[0]).all() and (mine.right_profile_index == out[2]).all()
        assert np.array_equal(mine.right_matrix_profile.fillna(-np.inf), out[1])


@pytest.mark.parametrize("top", [2, 5, 10_000])
def test_only_pairs_that_may_be_best_are_exact(top):
    """What single precision leaves out is not the best; many ties are computed as a whole."""
    from undula.plans.tiles import Windows, screened

    rng, w = np.random.default_rng(top), 12
    x, y = (Windows(np.concatenate((rng.integers(0, top, 300), np.full(20, 3))).astype(float), w, 400, True) for _ in range(2))
    far = rng.random((len(x), len(y))) < 0.3
    want = x.rho(y)
    want[far] = -np.inf
    floor = np.where(rng.random(len(x)) < 0.5, -np.inf, 0.8)
    rows, got, row, column = screened(x, y, floor, far)
    assert set(np.flatnonzero((want.max(1) >= floor) & (want.max(1) > -np.inf))) <= set(rows)
    assert (got == want.max(1)[rows]).all()
    at = got[row] > -np.inf
    some = np.argwhere((want == want.max(1)[:, None]) & (want > -np.inf) & np.isin(np.arange(len(x)), rows)[:, None])
    assert sorted(zip(rows[row[at]], column[at])) == sorted(map(tuple, some))


def test_streams_compare_few_pairs_exactly(monkeypatch):
    from undula.plans.tiles import Windows

    exact, pairs = [], Windows.pairs
    monkeypatch.setattr(Windows, "pairs", lambda a, b, i, j: exact.append(len(i)) or pairs(a, b, i, j))
    monkeypatch.setattr(Windows, "rho", lambda a, b: exact.append(len(a) * len(b)) or 1 / 0)
    x = np.random.default_rng(2).integers(0, 10_000, 3000).astype(float)
    extend(np.zeros(0), np.zeros(0), np.zeros(0, np.int64), 0, x, 16, 9, 100_000, None, True)
    assert 0 < sum(exact) < 20 * 3000


def test_windows_below_the_threshold_are_not_computed_exactly(monkeypatch):
    from undula.plans.tiles import Windows

    monkeypatch.setattr(Windows, "rho", lambda *args: 1 / 0)
    monkeypatch.setattr(Windows, "pairs", lambda a, b, i, j: np.zeros(0) if not len(i) else 1 / 0)
    x = np.random.default_rng(3).integers(0, 10_000, 2000).astype(float)
    *_, out = extend(np.zeros(0), np.zeros(0), np.zeros(0, np.int64), 0, x, 50, 26, 10_000, None, True, 0.95)
    assert len(out[0]) == 1951 and (out[2] == -1).all()
