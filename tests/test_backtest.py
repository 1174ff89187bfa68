import numpy as np
import pytest

from hindcast.operators import controls as C
from hindcast.operators import models as M
from hindcast.operators import retrieval as R
from hindcast.operators import topology as T
from hindcast.plans import backtest as B
from tests.test_engine import make

RNG = np.random.default_rng(9)
SMALL = T.Topology(tau=1, dimension=2, points=16, steps=120)


def plain(f, t, c):
    return np.abs(f[c, 0] - f[t, 0])


def test_names_state_models():
    assert [B.parse(n).model for n in ("rolling_hs_w250", "gap_hs_w250_r125", "regime_hs_bins4", "fhs_ewma_l094", "garch_t_w1500_r20", "s_mahalanobis_k500", "wz_dtw_l250_k250", "topology_l250_k100")] == ["rolling_hs", "gap_hs", "regime_hs", "fhs_ewma", "garch_t", "state", "window", "topology"]
    assert B.parse("wz_fpca_l60_k5").family == B.parse("wz_fpca_l60_k9").family != B.parse("w_fpca_l60_k9").family
    with pytest.raises(ValueError):
        B.parse("w_cosine_l20_k5")


def test_grid_names():
    assert B.grid("w_dtw_l{size}_k{k}", size=[60, 125], k=[50, 100]) == ["w_dtw_l60_k50", "w_dtw_l60_k100", "w_dtw_l125_k50", "w_dtw_l125_k100"]


def test_backtest_accounts_for_every_day_and_matches_models(spark):
    p = make(spark).selectExpr("*", "date_add(DATE '2000-01-01', int(pos)) AS date")
    names = ["rolling_hs_w10", "w_euclidean_l5_k3", "w_euclidean_l5_k6"]
    made, skipped = B.run_backtest(p, names)
    assert made.count() + skipped.count() == 59 * len(names)
    for k in (3, 6):
        want = {r.t: r["var"] for r in M.risk(M.window_knn(p, 5, k)).collect()}
        got = {r.t: r["var"] for r in made.where(f"configuration = 'w_euclidean_l5_k{k}'").collect()}
        assert got and all(want[t] == v for t, v in got.items())
    assert {r.t for r in skipped.where("configuration = 'w_euclidean_l5_k3'").collect()} == set(range(5))


def test_permuted_control_takes_dates_and_breaks_ties_at_random():
    f, c = np.ones((9, 1)), np.arange(8)
    first = np.zeros(8)
    for draw in range(800):
        first[R.top(C.permuted(plain, 1, draw)(f, 8, c), 1)] += 1
    assert first.min() > 60 and first.max() < 145
    one = C.permuted(plain, 1, 3)
    assert (one(f, 8, c) == one(f, 8, c)).all()


def test_permuted_control_ranks_dealt_distances():
    f, c = RNG.normal(size=(7, 1)), np.arange(6)
    rank = C.permuted(plain, 2, 5)(f, 6, c)
    dealt = plain(f, 6, c)[np.random.default_rng((2, 5, 6)).permutation(6)]
    assert (np.argsort(rank) == np.argsort(dealt)).all()


def test_sign_flip():
    low, high, both = C.sign_flip(np.full(12, 1.0), 2000)
    assert high < 0.01 and low == 1.0 and both == pytest.approx(2 * high)
    assert C.sign_flip(np.zeros(5), 100) == (1.0, 1.0, 1.0)
    x = RNG.normal(size=30)
    assert C.sign_flip(x, 500, batch=60) == C.sign_flip(x, 500)
    assert all(np.isnan(p) for p in C.sign_flip(np.zeros(0), 500))


def test_blend_scales_states_by_days_without_a_feature():
    f = RNG.normal(size=(12, 4))
    f[:3, 2:] = np.nan
    c = np.arange(3, 9)
    got = T.blended(2, 0.25, 2)(f, 11, c)
    state, topo = R.scaled_euclidean(f[:, :2], 11, np.arange(9)), R.scaled_euclidean(f[:, 2:], 11, c)
    assert got == pytest.approx(0.25 * state[3:] + 0.75 * topo)
    assert T.blended(2, 0.0, 2)(f, 11, c) == pytest.approx(topo)


def test_placebo_deals_whole_features_to_the_same_days():
    f = np.arange(12.0).reshape(6, 2)
    f[1] = np.nan
    got = T.placebo(lambda s: s["f"], 4)({"f": f})
    assert np.isnan(got[1]).all() and sorted(map(tuple, got[[0, 2, 3, 4, 5]])) == sorted(map(tuple, f[[0, 2, 3, 4, 5]]))
    assert (f[0] == [0, 1]).all()


def test_features_of_several_columns():
    w = RNG.normal(size=(40, 3))
    assert T.window_feature(w, SMALL).shape == (120,) and T.window_feature(w[:, 0], SMALL).any()
    assert not np.array_equal(T.window_feature(w, SMALL), T.window_feature(w[:, 0], SMALL))
    assert np.array_equal(T.window_feature(w[:, 0], SMALL), T.window_feature(w[:, :1], SMALL))


def test_topology_control_and_shuffles(spark):
    p = make(spark)
    found = T.topology_knn(p, 12, 4, queries="pos >= 50", t=SMALL, state=("a", "b"), control_seed=1, draws=3)
    rows = found.collect()
    assert sorted((r.t, r.draw) for r in rows) == [(t, d) for t in range(50, 60) for d in range(3)]
    assert all(11 <= s < r.t for r in rows for s in r.neighbours) and all(len(set(r.neighbours)) == 4 for r in rows)
    one, two = (sorted(T.shuffle_test(p, 12, 5, 4, t=SMALL).collect()) for _ in range(2))
    assert one == two and [r.pos for r in one] == [11, 23, 35, 47, 59] and all(0 <= r.central_share <= 1 for r in one)


def test_embedding_choice_needs_enough_days(spark):
    p = make(spark, 240)
    got = T.embedding_choice(p).first()
    r = np.array([x.ret for x in p.orderBy("pos").collect()])
    assert got.dimension == T.choose_dimension(R.standardise(r[None])[0], got.tau)
    assert T.embedding_choice(p, "pos < 100").count() == 0
