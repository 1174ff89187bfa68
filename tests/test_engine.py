import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindcast.functions import scores as S
from hindcast.operators import inference as I
from hindcast.operators import models as M
from hindcast.operators import retrieval as R
from hindcast.operators import topology as T

RNG = np.random.default_rng(3)
SCHEMA = "series string, pos long, ret double, loss double, next_loss double, rv20 double, a double, b double"


def make(spark, n=60, change=None):
    r = np.random.default_rng(1).normal(0, 0.01, n)
    if change is not None:
        r[change:] += 10_000
    rows = [("x", i, float(r[i]), float(-r[i]), float(-r[i + 1]) if i + 1 < n else None, float(i % 7) + 0.5, float(i), float(i * i % 11)) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_eligible_bounds():
    assert (R.eligible(200, 300, 0), R.eligible(200, 300, 125), R.eligible(3, 300, 125)) == (200, 75, 0)
    with pytest.raises(ValueError):
        R.eligible(1, 1, -1)


@pytest.mark.parametrize("build", [
    lambda p: M.window_knn(p, 5, 4, queries="pos = 40"), lambda p: M.window_knn(p, 5, 4, queries="pos = 40", metric=R.dtw(3), z=True),
    lambda p: M.window_knn(p, 5, 4, queries="pos = 40", metric=R.fpca(2)), lambda p: M.state_knn(p, 4, queries="pos = 40", columns=("a", "b")),
    lambda p: M.state_knn(p, 4, queries="pos = 40", metric=R.mahalanobis, columns=("a", "b")), lambda p: M.regime_hs(p, 2).where("t = 40"), lambda p: M.rolling_hs(p, 10).where("t = 40"), lambda p: M.fhs_ewma(p, 0.94).where("t = 40"),
])
def test_rows_after_the_day_change_nothing(spark, build):
    one, two = (M.risk(build(make(spark, change=c))).collect() for c in (None, 41))
    assert one and one == two


def test_neighbours_and_next_day_losses(spark):
    p = make(spark)
    r = np.array([x.ret for x in p.orderBy("pos").collect()])
    w = R.windows(r, 5)
    got = M.window_knn(p, 5, 3, radius=2, queries="pos = 30").first()
    d = np.sqrt(((w[4:28] - w[30]) ** 2).sum(1))
    want = (np.argsort(d, kind="stable")[:3] + 4).tolist()
    assert got.neighbours == want
    assert got.losses == pytest.approx([-r[s + 1] for s in want])


def test_gap_hs_ends_before_the_gap(spark):
    p = make(spark)
    got = M.rolling_hs(p, 3, radius=5).where("t = 20").first().losses
    assert got == [x.loss for x in p.where("pos between 12 and 14").orderBy("pos").collect()]


def test_quantile_and_tail(spark):
    x = RNG.normal(size=37).tolist()
    row = spark.createDataFrame([(x + [None, float("nan")],), ([],)], "x array<double>").select(S.array_quantile(F.col("x"), 0.9).alias("q"), S.tail_mean(F.col("x"), 0.9).alias("m")).collect()
    q = np.quantile(x, 0.9)
    assert row[0].q == pytest.approx(q, abs=1e-15) and row[0].m == pytest.approx(np.mean([v for v in x if v >= q]))
    assert row[1].q is None and row[1].m is None


def test_scores(spark):
    d = spark.createDataFrame([(0.01, 0.02, 0.04), (0.03, 0.02, 0.04), (0.02, 0.02, 0.0)], "y double, q double, e double")
    got = d.select(S.pinball("y", "q").alias("p"), S.fz0("y", "q", "e").alias("f")).collect()
    assert [g.p for g in got] == pytest.approx([0.0001, 0.0099, 0.0])
    assert got[1].f > got[0].f and got[2].f is None


def test_standardised_windows(spark):
    d = spark.createDataFrame([([1.0, 2.0, 4.0, 8.0],), ([1.0] * 4,)], "x array<double>").select(S.standardised(F.col("x")).alias("z")).collect()
    v = np.array([1.0, 2, 4, 8])
    assert d[0].z == pytest.approx(((v - v.mean()) / v.std()).tolist()) and d[1].z == [0.0] * 4


def test_warping_band_one_is_euclidean_and_matches_plain_recursion():
    f = RNG.normal(size=(5, 6))
    c = np.arange(4)
    assert R.dtw(1)(f, 4, c) == pytest.approx(R.euclidean(f, 4, c))
    for s in c:
        best = {(0, 0): 0.0}
        for i, j in itertools.product(range(1, 7), range(1, 7)):
            if abs(i - j) < 3:
                best[i, j] = (f[4][i - 1] - f[s][j - 1]) ** 2 + min(best.get(k, math.inf) for k in ((i - 1, j - 1), (i - 1, j), (i, j - 1)))
        assert R.dtw(3)(f, 4, c)[s] == pytest.approx(math.sqrt(best[6, 6]))


def test_known_shapes():
    _, h1 = T.persistence(np.array([[0, 0], [1, 0], [1, 1], [0, 1]], float))
    assert h1.ravel() == pytest.approx([1, math.sqrt(2)])
    assert len(T.persistence(np.array([[0, 0], [1, 0], [0, 1]], float))[1]) == 0
    grid = np.linspace(0, 3, 200)
    assert T.landscape(np.array([[1.0, 2.0]]), grid, (1.0, 0.5, 0.25)).max() == pytest.approx(0.5 / 1.75, abs=0.01)


def test_coverage_matches_plain_formulas(spark):
    x = (RNG.random(400) < 0.04).astype(float)
    d = spark.createDataFrame([("m", i, float(v)) for i, v in enumerate(x)], "model string, i long, hit double")
    got = I.coverage(d, ["model"], "i", 0.95).first()
    k, n = x.sum(), len(x)
    assert got.uc == pytest.approx(-2 * ((n - k) * math.log(0.95) + k * math.log(0.05) - (n - k) * math.log(1 - k / n) - k * math.log(k / n)))
    assert got.cc == pytest.approx(got.uc + got.ind) and got.cc_p == pytest.approx(math.exp(-got.cc / 2))
    gaps = np.diff(np.flatnonzero(x))
    ll = lambda p: len(gaps) * math.log(p) + (gaps.sum() - len(gaps)) * math.log(1 - p)
    assert got.duration == pytest.approx(2 * (ll(len(gaps) / gaps.sum()) - ll(0.05)))
    assert got.uc_p == pytest.approx(math.erfc(math.sqrt(got.uc / 2)), abs=1e-6)


def test_erfc_is_that_of_double_precision(spark):
    xs = [*np.linspace(0, 6, 121).tolist(), 1e-300, 0.46875, 0.468751, 4.0, 4.0001, 12.0, 26.0, 30.0, math.inf]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", I.erfc(F.col("x")).alias("y")).collect()
    assert all(r.y == pytest.approx(math.erfc(r.x), rel=1e-12, abs=1e-300) for r in got)
    assert spark.sql("SELECT CAST(NULL AS double) AS x").select(I.erfc(F.col("x"))).first()[0] is None


def test_long_run_variance_and_holm(spark):
    x = RNG.normal(size=150)
    d = spark.createDataFrame([("m", i, float(v)) for i, v in enumerate(x)], "model string, i long, d double")
    got = I.dm(d, ["model"], "i").first()
    e = x - x.mean()
    width = max(1, math.floor(4 * 1.5 ** (2 / 9)))
    assert got.variance == pytest.approx((e @ e + 2 * sum((1 - h / (width + 1)) * (e[h:] @ e[:-h]) for h in range(1, width + 1))) / 150)
    p = spark.createDataFrame([(0, 0.01), (0, 0.04), (0, 0.03), (0, None)], "g int, p double")
    assert sorted((r.p or 9, r.holm) for r in I.holm(p, ["g"]).collect())[:3] == [(0.01, pytest.approx(0.03)), (0.03, pytest.approx(0.06)), (0.04, pytest.approx(0.06))]


def test_confidence_set_is_deterministic_and_drops_a_bad_model():
    x = RNG.normal(size=(300, 3)) * 0.1 + np.array([0.0, 0.0, 1.0])
    one = I.confidence_set(x)
    assert one == I.confidence_set(x) and one[0][0] == 2 and not one[0][2]


def test_stream_of_events_matches_batch(spark):
    from hindcast.streaming.hourly import event_stream, hourly

    q = hourly(event_stream(spark, "/root/testdata/sf0.001")).writeStream.format("memory").queryName("hours").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("hours").agg(F.sum("n")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
