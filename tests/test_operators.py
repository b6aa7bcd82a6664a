"""Operators over values that are not whole numbers, against brute force, and edge cases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from undula import functions as fn
from undula.operators import contrast as ct
from undula.operators import mass as ms
from undula.operators import profile as pf
from undula.operators import rolling as ro
from undula import sources
from undula.sources import as_series, zone

RNG = np.random.default_rng(5)
X, Y = RNG.normal(size=120).cumsum(), RNG.normal(size=90).cumsum()


def frame(spark, *values, ids=None, kind="double"):
    rows = [(str(ids[k]) if ids else f"s{k}", i + 1, None if x is None else int(x) if kind == "long" else float(x)) for k, v in enumerate(values) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, f"series_id string, pos long, value {kind}")


def column(df, name, series="s0"):
    return df.filter(F.col("series_id") == series).orderBy("pos").toPandas()[name].to_numpy()


def windows(x, w):
    return np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), w)


def correlations(x, y, w):
    a, b = windows(x, w), windows(y, w)
    with np.errstate(all="ignore"):
        a = (a - a.mean(1, keepdims=True)) / a.std(1, keepdims=True)
        b = (b - b.mean(1, keepdims=True)) / b.std(1, keepdims=True)
        return a @ b.T / w


def brute_self(x, w, ez):
    rho = correlations(x, x, w)
    i = np.arange(len(rho))
    rho[np.abs(i[:, None] - i) <= ez] = -np.inf
    rho[~np.isfinite(rho)] = -np.inf
    return rho


def as_distance(best, w):
    return np.where(np.isfinite(best), np.sqrt(np.maximum(0, 2 * w * (1 - np.minimum(best, 1)))), np.inf)


@pytest.mark.parametrize("block", [5, 16, 65_536])
@pytest.mark.parametrize("kind", ["ogita", "normal"])
def test_rolling(spark, kind, block, monkeypatch):
    monkeypatch.setattr(sources, "BLOCK", block)
    s, v = frame(spark, X, Y), windows(X, 7)
    assert np.allclose(column(ro.mov_sum(s, 7, kind), "mov_sum"), v.sum(1))
    assert np.allclose(column(ro.mov_mean(s, 7, kind), "mov_mean"), v.mean(1))
    assert np.allclose(column(ro.mov_var(s, 7, kind), "mov_var"), v.var(1))
    assert np.allclose(column(ro.mov_std(s, 7), "mov_std", "s1"), windows(Y, 7).std(1))
    assert np.allclose(column(ro.mov_min(s, 7), "mov_min"), v.min(1))
    assert np.allclose(column(ro.mov_max(s, 7), "mov_max"), v.max(1))
    assert np.allclose(column(ro.muinvn(s, 7), "sig"), 1 / (v.std(1) * np.sqrt(7)))


@pytest.mark.parametrize("kind", ["fading", "weighted"])
def test_folds_in_blocks(spark, kind, monkeypatch):
    a, s, w = 0.9 ** (1 / 10), 0.0, 10
    expected = []
    for i, x in enumerate(X):
        s = a * s + x - (a ** (w - 1) * X[i - w] if kind == "weighted" and i >= w else 0)
        expected.append(s)
    for block in (17, 1000):
        monkeypatch.setattr(sources, "BLOCK", block)
        assert np.allclose(column(ro.mov_sum(frame(spark, X), w, kind), "mov_sum"), expected[w - 1 :], atol=1e-9)


def test_rolling_guards(spark):
    with pytest.raises(ValueError):
        ro.mov_sum(frame(spark, X), 1)
    with pytest.raises(ValueError):
        ro.mov_mean(frame(spark, X), 5, "other")
    assert ro.mov_sum(frame(spark, [1.0, 2.0]), 5).count() == 0
    assert column(ro.mov_max(frame(spark, [1.0, 2.0]), 5), "mov_max").tolist() == [2.0]
    assert pd.isna(column(ro.mov_min(frame(spark, [float("inf")] * 4), 2), "mov_min")).all()


@pytest.mark.parametrize("block", [4, 65_536])
def test_zero_crossing_leaves_out_the_last_pair(spark, block, monkeypatch):
    monkeypatch.setattr(sources, "BLOCK", block)
    s = frame(spark, [1.0, -1.0] * 10)
    assert fn.complexity(s).first()["complexity"] == np.sqrt(19 * 4)
    assert (column(ro.zero_crossing(s, 6), "zero_crossing") == 4).all()
    assert (column(ro.zero_crossing(s, 2), "zero_crossing") == 0).all()


@pytest.mark.parametrize("tile", [16, 1024])
def test_self_profile(spark, tile):
    rho = brute_self(X, 10, 5)
    got = pf.mpx(frame(spark, X, Y), 10, tile=tile)
    assert np.allclose(column(got, "matrix_profile"), as_distance(rho.max(1), 10))
    assert (column(got, "profile_index") == rho.argmax(1) + 1).all()
    assert np.allclose(column(pf.mpx(frame(spark, X), 10, distance="pearson", tile=tile), "matrix_profile"), rho.max(1))


def test_left_and_right(spark):
    got = pf.stomp(frame(spark, X), 10, left_right_profile=True, tile=32).toPandas()
    assert (got[["left_matrix_profile", "right_matrix_profile"]].min(axis=1) == got["matrix_profile"]).all()
    known = got[got.left_profile_index > 0]
    assert (known.left_profile_index < known.pos).all()
    assert (got[got.right_profile_index > 0].right_profile_index > got[got.right_profile_index > 0].pos).all()


@pytest.mark.parametrize("a, b", [(X, Y), (Y, X)])
def test_cross_profile_of_unequal_lengths(spark, a, b):
    rho = correlations(a, b, 8)
    one, two = pf.mpx(frame(spark, a), 8, frame(spark, b), tile=20)
    assert np.allclose(column(one, "matrix_profile"), as_distance(rho.max(1), 8))
    assert (column(one, "profile_index") == rho.argmax(1) + 1).all()
    assert np.allclose(column(two, "mpb"), as_distance(rho.max(0), 8))
    assert (column(two, "pib") == rho.argmax(0) + 1).all()


def test_missing_and_flat_windows_have_no_partner(spark):
    x = X.copy()
    x[20], x[50:65], x[90] = np.nan, 3.0, np.inf
    rho = brute_self(np.where(np.isinf(x), np.nan, x), 6, 3)
    got = pf.mpx(frame(spark, [None if np.isnan(v) else float(v) for v in x]), 6, tile=25)
    assert np.allclose(column(got, "matrix_profile"), as_distance(rho.max(1), 6))
    index = column(got, "profile_index")
    assert (index[~np.isfinite(rho.max(1))] == -1).all() and (index[50:59] == -1).all()


def test_edges_of_the_profile(spark):
    flat = pf.mpx(frame(spark, [2.0] * 30), 5)
    assert np.isinf(column(flat, "matrix_profile")).all() and (column(flat, "profile_index") == -1).all()
    wide = pf.mpx(frame(spark, X[:20]), 10, exclusion_zone=2.0)
    assert np.isinf(column(wide, "matrix_profile")).all()
    with pytest.raises(Exception, match="more than half of series s0"):  # known only when the query runs
        pf.mpx(frame(spark, X[:18]), 10).collect()
    with pytest.raises(ValueError):
        pf.mpx(frame(spark, X), 1)
    with pytest.raises(ValueError):
        pf.stamp(frame(spark, X), 10, s_size=0)
    assert zone(5, 0.5) == 3 and zone(151, 0.5) == 76
    repeated = frame(spark, [1, 5, 2, 8] * 10, kind="long")
    assert (column(pf.mpx(repeated, 4), "profile_index")[8:12] == [1, 2, 3, 4]).all()


def test_large_offset_does_not_cancel(spark):
    got = column(pf.mpx(frame(spark, 1e6 + X), 10), "matrix_profile")
    assert np.allclose(got, as_distance(brute_self(X, 10, 5).max(1), 10), atol=1e-5)


@pytest.mark.parametrize("offset", [10**6, 10**8, 10**9, 4 * 10**9, 1_700_000_000_000_000_000])
def test_whole_numbers_of_any_offset(spark, offset):
    x = np.random.default_rng(3).integers(0, 50, 200)
    s, w = frame(spark, [offset + int(v) for v in x], kind="long"), 10
    for tile in (64, 4096):
        got = pf.mpx(s, w, tile=tile)
        best = brute_self(x.astype(float), w, 5)
        assert np.allclose(column(got, "matrix_profile"), as_distance(best.max(1), w), atol=1e-7)
        assert (best[np.arange(len(best)), column(got, "profile_index").astype(int) - 1] >= best.max(1) - 1e-12).all()
    if offset < 2**53:
        assert np.allclose(column(ro.mov_var(s, w), "mov_var"), windows(x, w).var(1), rtol=1e-6)
        assert np.allclose(column(ro.mov_mean(s, w), "mov_mean") - offset, windows(x, w).mean(1), atol=1e-5)
        assert np.isclose(fn.std(s).first()["std"], x.std(), rtol=1e-9)
        assert np.allclose(column(ms.mass(s, s, w, 7), "distance_profile"), column(ms.mass(frame(spark, x.astype(float)), frame(spark, x.astype(float)), w, 7), "distance_profile"), atol=1e-4)
    assert np.isclose(fn.complexity(s).first()["complexity"], np.sqrt((np.diff(x) ** 2.0).sum()))


def test_large_and_small_values_in_one_series(spark):
    x = np.random.default_rng(4).integers(0, 50, 120)
    x[60] = 2**40
    best = brute_self(x.astype(float), 6, 3)
    got = pf.mpx(frame(spark, [int(v) for v in x], kind="long"), 6, tile=16)
    assert np.allclose(column(got, "matrix_profile"), as_distance(best.max(1), 6), atol=1e-3)


@pytest.mark.parametrize(("n", "w"), [(3, 2), (4, 2), (19, 10), (20, 10)])
def test_smallest_series(spark, n, w):
    got = pf.mpx(frame(spark, X[:n]), w, exclusion_zone=0.0)
    best = brute_self(X[:n], w, 0)
    assert np.allclose(column(got, "matrix_profile"), as_distance(best.max(1), w), atol=1e-6)


def test_contrast_of_a_given_profile(spark):
    one, two = frame(spark, X), frame(spark, X[::-1] + np.sin(np.arange(len(X))))
    own = pf.mpx(two, 10)
    a, b = ct.contrast_profile(one, two, 10), ct.contrast_profile(one, two, 10, positive_matrix=own)
    assert np.allclose(column(a, "contrast_profile"), column(b, "contrast_profile")) and (column(a, "nn_idx") == column(b, "nn_idx")).all()


def test_recursive_sums_in_blocks():
    u = np.random.default_rng(5).normal(size=1000)
    s, want = 2.0, []
    for v in u:
        s = 0.97 * s + v
        want.append(s)
    assert np.allclose(fn.folded(u, 0.97, 2.0), want)


def test_samples(spark):
    s = frame(spark, X)
    full = column(pf.mpx(s, 10), "matrix_profile")
    for f in (pf.mpx, pf.stamp, pf.scrimp):
        got = column(f(s, 10, s_size=0.3, tile=40), "matrix_profile")
        assert (got >= full - 1e-12).all() and (got > full).any()
        assert np.array_equal(got, column(f(s, 10, s_size=0.3, tile=1000), "matrix_profile"))


@pytest.mark.parametrize("kind", ms.KINDS)
def test_mass(spark, kind):
    q, v, weigh = X[30:40], windows(Y, 10), np.arange(1, 11) + 0.5
    z, zq = (v - v.mean(1, keepdims=True)) / v.std(1, keepdims=True), (q - q.mean()) / q.std()
    far = {"normalized": ((z - zq) ** 2).sum(1), "non_normalized": ((z - q) ** 2).sum(1), "absolute": ((v - q) ** 2).sum(1), "weighted": ((z - zq) ** 2) @ weigh}[kind]
    dot = v @ (weigh * zq) if kind == "weighted" else v @ q
    got = ms.mass(frame(spark, Y), frame(spark, X), 10, 31, kind, weigh if kind == "weighted" else None, tile=33)
    assert np.allclose(column(got, "distance_profile"), far) and np.allclose(column(got, "last_product"), dot)


def test_mass_guards(spark):
    with pytest.raises(ValueError):
        ms.mass(frame(spark, X), frame(spark, X), 10, 112)
    with pytest.raises(ValueError):
        ms.mass(frame(spark, X), frame(spark, X), 10, type="weighted")
    flat = ms.mass(frame(spark, [1.0] * 30), frame(spark, X), 10)
    assert np.isinf(column(flat, "distance_profile")).all()


def test_contrast(spark):
    neg, pos, w = X[:60], Y, 8
    ab = as_distance(correlations(pos, neg, w).max(1), w)
    self_ = brute_self(pos, w, 4)
    aa, top = as_distance(self_.max(1), w), np.sqrt(2 * w)
    cp = np.maximum(0, (np.minimum(ab, top) - np.minimum(aa, top)) / top)
    profile, plato = ct.contrast(frame(spark, neg), frame(spark, pos), w)
    assert np.allclose(column(profile, "contrast_profile"), cp)
    one = plato.toPandas().iloc[0]
    at = int(cp.argmax())
    assert one.plato_idx == at + 1 and np.allclose(one.plato, pos[at : at + w])
    near = int(self_[at].argmax())
    assert one.plato_nn_idx == near + 1 and np.allclose(one.plato_nn, pos[near : near + w])


def test_helpers(spark):
    s = frame(spark, X)
    assert np.allclose(column(fn.znorm(s), "value"), (X - X.mean()) / X.std())
    assert np.allclose(column(fn.znorm(frame(spark, [1.0, 1.001])), "value"), [-0.0005, 0.0005])
    assert np.allclose(fn.std(s).first()["std"], X.std())
    assert fn.std(frame(spark, [1.0, None, 3.0])).first()["std"] is None
    assert fn.std(frame(spark, [1.0, None, 3.0]), na_rm=True).first()["std"] == 1.0
    assert np.allclose(column(fn.normalize(s, 1, 5), "value"), 1 + 4 * (X - X.min()) / (X.max() - X.min()))
    assert fn.normalize(frame(spark, [2.0, 2.0])).first()["value"] is None
    assert np.allclose(fn.complexity(s).first()["complexity"], np.sqrt((np.diff(X) ** 2).sum()))
    assert fn.mode(frame(spark, [3.2, 1.0, 1.5, 3.9, 7.0])).first()["mode"] == 3
    assert fn.split_order(50)[:8] == [1, 26, 13, 38, 7, 19, 32, 44] and sorted(fn.split_order(50)) == list(range(1, 51)) and fn.split_order(1) == [1]
    rho = spark.createDataFrame([(float(r),) for r in RNG.uniform(-1, 1, 50)], "r double")
    back = rho.select("r", fn.ed_corr(fn.corr_ed(F.col("r"), 100), 100).alias("b")).toPandas()
    assert np.allclose(back.r, back.b)


def test_series_from_a_table(spark):
    rows = spark.createDataFrame([("a", 3, 1.0), ("a", 1, 2.0), ("b", 2, 5.0)], "k string, t int, v double")
    got = sorted(map(tuple, as_series(rows, "v", "t", "k").collect()))
    assert got == [("a", 1, 2.0), ("a", 2, 1.0), ("b", 1, 5.0)]
    long = spark.range(5000).selectExpr("id % 2 AS k", "hash(id) AS t", "id AS v")
    plain, spread = (sorted(map(tuple, as_series(long, "v", ["t", "v"], "k", spread=x).collect())) for x in (False, True))
    assert plain == spread
    with pytest.raises(ValueError):
        ro.mov_sum(rows, 3)
    empty = frame(spark, [])
    assert pf.mpx(empty, 4).count() == 0 and ro.mov_sum(empty, 4).count() == 0


@pytest.mark.parametrize("tile", [40, 4096])
def test_mpx_of_windows_that_come_again(spark, tile):
    """Copies, multiples, ties and gaps: left and right neighbours are those of brute force."""
    rng, w = np.random.default_rng(4), 5
    parts = [np.concatenate([np.tile(rng.integers(0, top, 60), 3), rng.integers(0, 4, 40)]) for top in (3, 1000)] + [2 * np.arange(60), np.tile(rng.integers(0, 2**40, 30), 3)]
    rows = [(str(k), i + 1, int(x)) for k, part in enumerate(parts) for i, x in enumerate(part)]
    got = pf.stomp(spark.createDataFrame(rows, "series_id string, pos long, value long"), w, left_right_profile=True, tile=tile).toPandas()
    for k, x in enumerate(parts[:3]):
        v = np.lib.stride_tricks.sliding_window_view(x, w)
        cross = w * (v @ v.T) - np.outer(v.sum(1), v.sum(1))
        spread, n = np.diag(cross), np.arange(len(v))
        with np.errstate(all="ignore"):
            rho = np.where(np.outer(spread, spread) > 0, cross / np.sqrt(np.outer(spread, spread)), -np.inf)
        mine = got[got.series_id == str(k)].sort_values("pos")
        for name, lag in (("left", n[:, None] - n[None]), ("right", n[None] - n[:, None]), ("profile", np.abs(n[None] - n[:, None]))):
            far = np.where(lag < 4, -np.inf, rho)
            idx = mine["profile_index" if name == "profile" else f"{name}_profile_index"].to_numpy()
            assert (idx == np.where(far.max(1) > -np.inf, far.argmax(1) + 1, -1)).all()
    large = got[got.series_id == "3"].sort_values("pos")
    assert np.allclose(large.matrix_profile[:50], 0, atol=1e-3)


def test_only_windows_that_do_not_come_again_ask(spark):
    from undula.plans import tiles

    x = np.tile(np.random.default_rng(6).integers(0, 10_000, 200), 10)
    series = spark.createDataFrame([("a", i + 1, int(v)) for i, v in enumerate(x)], "series_id string, pos long, value long")
    got = tiles._again(series, tiles.blocks(series, 8, 512), 8, 5, 512).toPandas().sort_values("pos")
    assert len(got) == 1993 and got["left"].isna().sum() == got["right"].isna().sum() == 200
    assert (got["left"].dropna() == got.pos[200:] % 200).all() and (got["right"].dropna() == got.pos[:-200] + 200).all()


def test_profiles_move_blocks_not_rows(spark):
    """Whole series of any order, with gaps, large values and no name; rows are shuffled packed, not one for each window."""
    rng, w = np.random.default_rng(8), 4
    x = [int(v) + 2**62 for v in rng.integers(0, 50, 90)]
    rows = [("a", i + 1, None if i == 40 else v) for i, v in enumerate(x)] + [(None, i + 1, v) for i, v in enumerate(x)]
    series = spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "series_id string, pos long, value long")
    frame = pf.mpx(series, w, tile=16)
    assert not [s for s in frame._jdf.queryExecution().executedPlan().toString().split("Exchange ")[1:] if "pos#" in s.split("\n")[0]]
    got = frame.toPandas()
    v = np.lib.stride_tricks.sliding_window_view(np.array([np.nan if k == 40 else u - 2**62 for k, u in enumerate(x)]), w)
    with np.errstate(all="ignore"):
        rho = np.corrcoef(v)
    n = np.arange(len(v))
    rho[np.isnan(rho) | (np.abs(n[:, None] - n[None]) < 3)] = -np.inf
    mine, nameless = got[got.series_id == "a"].sort_values("pos"), got[got.series_id.isna()]
    assert np.allclose(mine.matrix_profile, np.sqrt(np.maximum(0, 2 * w * (1 - rho.max(1)))), atol=1e-6) and ((mine.profile_index == -1) == (rho.max(1) == -np.inf)).all()
    assert len(nameless) == 87 and (nameless.profile_index == -1).all() and np.isinf(nameless.matrix_profile).all()
