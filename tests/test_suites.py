import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from hindcast.operators import checks as C
from hindcast.operators import controls, demo
from hindcast.operators import diagnostics as D
from hindcast.operators import inference as I
from hindcast.operators import models as M
from hindcast.operators import topology as T
from hindcast.plans import suites
from hindcast.sources import files
from tests.test_engine import make

RNG = np.random.default_rng(21)
DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["validation_folds", "validation_finalists", "selection_stability", "evaluation_summary", "neighbour_profile", "verification", "synthetic_series", "hourly_panel"])
def test_rows_equal_those_of_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    rel, df = con.sql(entry.oracle_sql()[name]), entry.queries()[name](spark, DIR)
    assert sorted(df.columns) == sorted(rel.columns)
    tidy = lambda rows: sorted([tuple(round(v, 7) + 0.0 if isinstance(v, float) else v for v in r) for r in rows], key=repr)
    assert tidy(df.select(*(f"`{c}`" for c in rel.columns)).collect()) == tidy(rel.fetchall())


def plain_h1(x):
    """Bars of dimension 1 by reduction of the whole boundary matrix."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    simplices = [(0.0, 0, (i,)) for i in range(n)] + [(d[e], 1, e) for e in itertools.combinations(range(n), 2)]
    simplices += [(max(d[a, b], d[a, c], d[b, c]), 2, (a, b, c)) for a, b, c in itertools.combinations(range(n), 3)]
    simplices.sort()
    at = {s: i for i, (_, _, s) in enumerate(simplices)}
    low, bars = {}, []
    for i, (size, dim, s) in enumerate(simplices):
        column = {at[f] for f in itertools.combinations(s, dim)} if dim else set()
        while column and max(column) in low:
            column ^= low[max(column)]
        if column:
            low[max(column)] = column
            born, kind, _ = simplices[max(column)]
            if kind == 1 and size > born + 1e-12:
                bars.append((born, size))
    return sorted(bars)


def test_persistence_is_that_of_the_boundary_matrix():
    for n in (5, 9, 14):
        x = RNG.normal(size=(n, 3))
        got, want = T.persistence(x)[1], np.array(plain_h1(x)).reshape(-1, 2)
        assert got.shape == want.shape and got[np.lexsort(got.T[::-1])] == pytest.approx(want)
    ring = np.array([[np.cos(a), np.sin(a)] for a in np.arange(12) * np.pi / 6])
    assert len(T.persistence(ring)[1]) == 1 and T.persistence(np.zeros((4, 2)))[1].shape == (0, 2)


def test_whole_clouds_are_looked_at():
    w = RNG.normal(size=60)
    assert not np.array_equal(T.window_feature(w), T.window_feature(w, T.Topology(points=30)))


def test_registry_and_forms(tmp_path):
    rows = suites.registry()
    assert [suites.form(r) for r in rows] == [r["configuration_id"] for r in rows]
    head = ",".join(suites.FIELDS)
    (tmp_path / "a.csv").write_text(f"{head}\na,RollingHS,,5,,,,x\na,RollingHS,,6,,,,x\n")
    with pytest.raises(files.SchemaError):
        suites.registry(str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_text(f"{head}\nrolling_hs_w7,RollingHS,,5,,,,x\n")
    with pytest.raises(ValueError):
        suites.form(suites.registry(str(tmp_path / "b.csv"))[0])
    assert suites.number("") is None and suites.number("0.5", float) == 0.5


def test_range_set_keeps_equal_models_and_is_deterministic():
    x = RNG.normal(size=(200, 4)) * 0.1
    x[:, 2] += 1
    got = I.range_set(x, draws=200)
    assert got == I.range_set(x, draws=200) and [g[3] for g in got] == [True, True, False, True]
    plain = lambda y: max(abs(y[:, j].mean() - y.mean(0).mean()) / np.sqrt(y[:, j].var(ddof=1) / len(y)) for j in range(y.shape[1]))
    assert I.range_statistic(x) == pytest.approx(plain(x))


def test_shortfall_bootstrap():
    y, q, e = RNG.normal(size=300), np.full(300, 1.9), np.full(300, 2.3)
    n, stat, p, mean = I.shortfall_bootstrap(y, q, e, draws=300)
    x = y * (y > q) / (0.025 * 2.3) - 1
    assert n == 300 and mean == pytest.approx(x.mean()) and stat == pytest.approx(np.sqrt(300) * x.mean() / x.std(ddof=1)) and 0 < p <= 1
    assert I.shortfall_bootstrap(y, q, e * 0)[0] == 0


def test_block_intervals_hold_the_mean(spark):
    d = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(RNG.normal(size=80))], "model string, i long, d double")
    row = I.paired_tables(d, ["model"], ["model"], "i", draws=200).first()
    assert row.low < row["mean"] < row.high and row.holm == pytest.approx(row.p)


def test_garch_finds_the_optimum_near_the_process():
    found = []
    for seed in (4, 5, 6):  # one sample's alpha has a standard error of some 0.02
        rng, r, v = np.random.default_rng(seed), [], 1.0
        for _ in range(3000):
            r.append(np.sqrt(v) * rng.standard_t(8) * np.sqrt(6 / 8))
            v = 0.05 + 0.08 * r[-1] ** 2 + 0.87 * v
        theta = M.garch_fit(np.array(r))
        best = M.garch_likelihood(theta, np.array(r))
        near = theta * (1 + rng.normal(size=(60, 5)) * [0.3, 0.05, 0.05, 0.02, 0.05])
        assert best <= min(M.garch_likelihood(x, np.array(r)) for x in [*near, np.array([0, 0.05, 0.08, 0.87, 8.0])]) + 1e-3
        found.append(theta)
    assert np.mean(found, axis=0)[2:4] == pytest.approx([0.08, 0.87], abs=0.06)
    e = np.array([1.0, -2.0])
    mu, sigma, nu = M.garch_ahead(np.array([0.0, 1.0, 0.2, 0.3, 1.0]), e)
    start = max(e.var(), 1 / 0.5)
    assert sigma**2 == pytest.approx(1 + 0.2 * 4 + 0.3 * (1 + 0.2 * 1 + 0.3 * start)) and nu == 2.1


def test_null_controls_use_the_past_and_count_ages(spark):
    p = make(spark)
    rows = D.drawn(p, 4, 3, radius=2, queries="pos between 20 and 22").collect()
    assert len(rows) == 9 and all(max(r.neighbours) <= r.t - 3 and len(set(r.neighbours)) == 4 for r in rows)
    first = np.bincount([s for r in D.drawn(p, 1, 2000, queries="pos = 10").collect() for s in r.neighbours], minlength=10)
    assert len(first) == 10 and first.min() > 140 and first.max() < 265
    found = M.window_knn(p, 5, 6, queries="pos = 50")
    ages = lambda n: sorted(int(np.searchsorted(D.AGES, 50 - s, "left")) for s in n)
    want = ages(found.first().neighbours)
    assert all(ages(r.neighbours) == want and len(r.losses) == 6 for r in D.recency_matched(found, p, 5).collect())


def test_null_draws_prefixes_and_checksums(spark):
    p = make(spark).selectExpr("*", "date_add(DATE '2000-01-01', int(pos)) AS date")
    one, two = (sorted(suites.null_draws(p, 5, 3, (0, 2), "pos >= 40", (2,)).collect()) for _ in range(2))
    assert one == two and len(one) == 12 and len({r.checksum for r in one}) == 12 and {r.k for r in one} == {2, 5}


def test_binomial_tail():
    assert controls.binomial_tail(0, 5) == 1.0 and controls.binomial_tail(5, 5) == pytest.approx(1 / 32) and controls.binomial_tail(4, 5) == pytest.approx(6 / 32)


def test_checks(spark):
    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "k int, v string")
    got = {r["check"]: (r["holds"], r["bad"]) for r in C.report(C.unique(d, "u", "k"), C.holds(d, "h", "v is not null"), C.same_members(d.select("k"), d.where("k = 1").select("k"), "s"), C.group_counts(d, "g", ["k"]), C.has_columns(d, "c", ["k", "z"])).collect()}
    assert got == {"u": (False, 1), "h": (False, 1), "s": (False, 1), "g": (False, 1), "c": (False, 1)}


def test_files(spark, tmp_path):
    d = spark.createDataFrame([("2020-01-01", 1.0), ("2020-01-02", None)], "date string, x double").selectExpr("date(date) AS date", "x")
    files.write_csv(d, str(tmp_path / "c"))
    back = files.read_panel_csv(spark, str(tmp_path / "c"), ["x"], ["x"]).orderBy("pos").collect()
    assert [(r.pos, r.x, r.valid_state) for r in back] == [(0, 1.0, True), (1, None, False)]
    files.write_by(d.withColumn("r", F.lit(0)), str(tmp_path / "p"), "r")
    assert files.read_many(spark, [str(tmp_path / "p")], ["x"]).count() == 2
    files.write_metadata(d, str(tmp_path / "m.json"), kind="t")
    assert files.read_json(spark, str(tmp_path / "m.json")).first().asDict() == {"first": "2020-01-01", "last": "2020-01-02", "rows": 2, "kind": "t"}
    hashes = files.content_hashes(spark, str(tmp_path / "m.json"))
    want = spark.createDataFrame([("m.json", hashes.first().sha256), ("n.json", "0")], "file string, sha256 string")
    assert C.manifest(hashes, want, "m").first()["bad"] == 1
    with pytest.raises(files.SchemaError):
        files.require(d, ["z"])
    log = files.log_to(str(tmp_path / "log"))
    log.info("one"), log.info("two")
    assert len((tmp_path / "log").read_text().splitlines()) == 2


def test_demo_shows_one_query_of_two_regions(spark):
    from hindcast.sources import synthetic

    rows = demo.retrieval(synthetic.regions(spark), first=900, last=904).collect()
    assert len(rows) == 5 and sum(r.shown for r in rows) == 1 and all(max(r.dtw_start, r.topology_start) <= 780 for r in rows)
    assert synthetic.stylised_window(spark).count() == 60
