"""The registered queries, each over the whole tables of a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.config import SPLITS, STATE
from hindcast.functions import scores as S
from hindcast.operators import checks as C
from hindcast.operators import demo
from hindcast.operators import diagnostics as D
from hindcast.operators import inference as I
from hindcast.operators import models as M
from hindcast.operators import retrieval as R
from hindcast.operators import topology as T
from hindcast.plans import backtest as B
from hindcast.plans import suites
from hindcast.sources import panel as P
from hindcast.sources import synthetic
from hindcast.sources.files import stored

Query = Callable[[SparkSession, str], DataFrame]
SIZE, K = 20, 50
TEST = f"date >= DATE '{SPLITS.test}'"
NULL_DRAWS, GARCH_DRAWS, RESAMPLES = 500, 20_000, 2_000
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.daily_panel(spark, sf_dir)


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.state_panel(_panel(spark, sf_dir))


def _out(forecasts: DataFrame, panel: DataFrame) -> DataFrame:
    return rounded(M.scored(forecasts, panel).drop("series"))


@query
def daily_panel(spark, sf_dir):
    return rounded(_panel(spark, sf_dir).select("pos", "date", "px_a", "px_b", "n_orders", "ret", "loss", "next_loss"))


@query
def hourly_panel(spark, sf_dir):
    return rounded(P.hourly_panel(spark, sf_dir).withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH")), 6)


@query
def state_panel(spark, sf_dir):
    return rounded(_state(spark, sf_dir).select("pos", *STATE))


@query
def expanding_zscores(spark, sf_dir):
    return rounded(P.expanding_zscores(_state(spark, sf_dir)).select("pos", *(f"z_{c}" for c in STATE)), 6)


@query
def splits(spark, sf_dir):
    p = _panel(spark, sf_dir).withColumn("split", P.split())
    return rounded(p.groupBy("split").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.avg("ret").alias("mean_ret"), F.stddev_samp("ret").alias("sd_ret")))


@query
def window_knn_var(spark, sf_dir):
    """Nearest earlier return windows, their next-day losses as scenarios, risk, and its score by year."""
    p = _panel(spark, sf_dir)
    s = M.scored(M.risk(M.window_knn(p, SIZE, K, queries=TEST)), p)
    return rounded(s.groupBy(F.year("date").cast("long").alias("year")).agg(F.count("*").alias("n"), F.avg("var").alias("mean_var"), F.avg("es").alias("mean_es"), F.avg("pinball").alias("mean_pinball"), F.avg("hit").alias("hit_rate")))


def _knn(name: str, **how) -> None:
    def f(spark, sf_dir):
        p = _panel(spark, sf_dir)
        return _out(M.risk(M.window_knn(p, SIZE, K, queries=TEST, **how)), p)

    QUERIES[name] = f


_knn("window_knn_forecasts")
_knn("window_knn_radius125", radius=125)
_knn("zwindow_knn_forecasts", z=True)
_knn("dtw_forecasts", metric=R.dtw(10))
_knn("zdtw_forecasts", metric=R.dtw(10), z=True)
_knn("fpca_forecasts", metric=R.fpca(5))
_knn("zfpca_forecasts", metric=R.fpca(5), z=True)


def _topology(p: DataFrame, size: int, k: int, **how) -> DataFrame:
    """Retrieval by landscapes that are computed once for each panel, whatever asks for them."""
    return T.topology_knn(p, size, k, features=lambda: stored(p.sparkSession, f"landscapes-{size}", P.version(p), lambda: T.landscapes(p, size)), **how)


def _state_knn(name: str, make) -> None:
    def f(spark, sf_dir):
        p = _state(spark, sf_dir)
        return _out(M.risk(make(p)), p)

    QUERIES[name] = f


_state_knn("state_knn_forecasts", lambda p: M.state_knn(p, K, queries=TEST))
_state_knn("state_knn_radius125", lambda p: M.state_knn(p, K, radius=125, queries=TEST))
_state_knn("mahalanobis_forecasts", lambda p: M.state_knn(p, K, queries=TEST, metric=R.mahalanobis))
_state_knn("random_knn_forecasts", lambda p: M.random_knn(p, K, queries=TEST))
_state_knn("topology_forecasts", lambda p: _topology(p, 60, K, queries=TEST))


_state_knn("rolling_hs_forecasts", lambda p: M.rolling_hs(p, 250, queries=TEST))
_state_knn("gap_hs_forecasts", lambda p: M.rolling_hs(p, 250, radius=125, queries=TEST))
_state_knn("regime_hs_forecasts", lambda p: M.regime_hs(p, 4, queries=TEST))
_state_knn("fhs_ewma_forecasts", lambda p: M.fhs_ewma(p, 0.94, queries=TEST))


@query
def garch_forecasts(spark, sf_dir):
    p = _panel(spark, sf_dir)
    return _out(M.garch_t(p, draws=GARCH_DRAWS, queries=TEST), p)


def _models(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Scores of four models on the test days, and the panel."""
    p = _state(spark, sf_dir)
    made = {"rolling_hs": M.rolling_hs(p, 250, queries=TEST), "gap_hs": M.rolling_hs(p, 250, radius=125, queries=TEST), "fhs_ewma": M.fhs_ewma(p, 0.94, queries=TEST), "window_knn": M.window_knn(p, SIZE, K, queries=TEST)}
    out = None
    for name, f in made.items():
        s = M.scored(M.risk(f), p).withColumn("model", F.lit(name))
        out = s if out is None else out.unionByName(s)
    return out, p


@query
def model_summary(spark, sf_dir):
    return rounded(D.summary(_models(spark, sf_dir)[0], "model"))


@query
def model_winners(spark, sf_dir):
    return rounded(D.winners(_models(spark, sf_dir)[0], F.quarter("date").cast("long")))


@query
def coverage_tests(spark, sf_dir):
    c = I.coverage(_models(spark, sf_dir)[0], ["model"], "date", level=0.95)
    return rounded(c.select("model", "n", "hits", "uc", "ind", "cc", "duration", F.exp(-F.col("cc") / 2).alias("cc_p")), 6)


@query
def shortfall_test(spark, sf_dir):
    return rounded(I.z2(_models(spark, sf_dir)[0], ["model"]).drop("p"), 6)


def _paired(spark, sf_dir) -> DataFrame:
    s, _ = _models(spark, sf_dir)
    mine = s.where("model = 'window_knn'").select("date", F.col("pinball").alias("own"))
    return s.where("model <> 'window_knn'").join(mine, "date").select("model", "date", (F.col("own") - F.col("pinball")).alias("d"))


@query
def paired_comparison(spark, sf_dir):
    return rounded(I.dm(_paired(spark, sf_dir), ["model"], "date").select("model", "n", "mean", F.col("variance").cast("double").alias("variance"), "dm"), 6)


@query
def paired_holm(spark, sf_dir):
    out = I.dm(_paired(spark, sf_dir), ["model"], "date").withColumn("all", F.lit(0))
    out = I.holm(out, ["all"]).withColumn("variance", F.col("variance").cast("double"))
    return rounded(out.select("model", "n", "mean", "variance", "dm", F.round("p", 5).alias("p"), F.round("holm", 5).alias("holm")), 6)


@query
def block_intervals(spark, sf_dir):
    return I.bootstrap_intervals(_paired(spark, sf_dir), ["model"], "date", draws=RESAMPLES)


@query
def confidence_set(spark, sf_dir):
    return I.model_confidence_sets(_models(spark, sf_dir)[0].withColumn("family", F.lit("pinball")), ["family"], "date", "model", "pinball", draws=RESAMPLES)


@query
def neighbour_ages(spark, sf_dir):
    p = _panel(spark, sf_dir)
    return rounded(D.neighbour_ages(M.window_knn(p, SIZE, K, queries=TEST), "series"))


@query
def age_shares(spark, sf_dir):
    p = _panel(spark, sf_dir)
    return D.age_shares(M.window_knn(p, SIZE, K, queries=TEST), "series")


@query
def neighbour_overlap(spark, sf_dir):
    p = _panel(spark, sf_dir)
    o = D.overlap(M.window_knn(p, SIZE, K, queries=TEST), M.window_knn(p, SIZE, K, queries=TEST, z=True))
    return rounded(o.agg(F.count("*").alias("n"), F.avg("jaccard").alias("mean_jaccard"), F.percentile("jaccard", 0.5).alias("median_jaccard")))


@query
def neighbour_lists(spark, sf_dir):
    p = _panel(spark, sf_dir)
    return M.window_knn(p, SIZE, 5, queries=TEST).select("t", S.joined(F.col("neighbours")).alias("neighbours"))


@query
def cutoff_ties(spark, sf_dir):
    p = _panel(spark, sf_dir)
    return rounded(D.ties(M.window_knn(p, SIZE, K + 1, queries=TEST), K), 6)


@query
def exclusion_comparison(spark, sf_dir):
    p = _panel(spark, sf_dir)
    score = lambda r: M.scored(M.risk(M.window_knn(p, SIZE, K, radius=r, queries=TEST)), p).select("t", F.col("pinball").alias(f"p{r}"), F.col("var").alias(f"v{r}"))
    j = score(0).join(score(125), "t")
    return rounded(j.agg(F.count("*").alias("n"), F.avg("p0").alias("near"), F.avg("p125").alias("far"), F.avg(F.col("p125") - F.col("p0")).alias("difference"), F.avg(F.col("v125") - F.col("v0")).alias("var_difference")))


@query
def skipped_forecasts(spark, sf_dir):
    p = _panel(spark, sf_dir)
    found = M.window_knn(p, SIZE, K, radius=125)
    return R.skipped(p, found).groupBy("reason").agg(F.count("*").alias("n"), F.max("t").alias("last"))


@query
def mutual_information(spark, sf_dir):
    return rounded(T.mutual_information(_panel(spark, sf_dir)).drop("series"))


@query
def chosen_delay(spark, sf_dir):
    return T.first_minimum(T.mutual_information(_panel(spark, sf_dir)))


@query
def landscapes(spark, sf_dir):
    return T.landscapes(_panel(spark, sf_dir), 60)


@query
def random_control(spark, sf_dir):
    p = _panel(spark, sf_dir)
    return D.null_scores(D.drawn(p, K, NULL_DRAWS, queries=TEST), p)


@query
def recency_control(spark, sf_dir):
    p = _panel(spark, sf_dir)
    return D.null_scores(D.recency_matched(M.window_knn(p, SIZE, K, queries=TEST), p, NULL_DRAWS), p)


@query
def randomisation_test(spark, sf_dir):
    p = _panel(spark, sf_dir)
    real = M.scored(M.risk(M.window_knn(p, SIZE, K, queries=TEST)), p).groupBy("series").agg(F.avg("pinball").alias("mean_pinball"))
    return D.randomisation_p(D.null_scores(D.drawn(p, K, NULL_DRAWS, queries=TEST), p), real)


_state_knn("topology_blend_forecasts", lambda p: _topology(p, 60, K, queries=TEST, alpha=0.5))
_state_knn("topology_placebo_forecasts", lambda p: _topology(p, 60, K, queries=TEST, placebo_seed=20260426))


@query
def topology_components(spark, sf_dir):
    """Landscapes of clouds whose points hold the delays of the weighted return and of both its parts."""
    return T.landscapes(_panel(spark, sf_dir), 60, columns=("ret", "ret_a", "ret_b"))


@query
def permuted_topology_control(spark, sf_dir):
    p = _state(spark, sf_dir)
    return D.null_scores(_topology(p, 60, K, queries=TEST, control_seed=1, draws=NULL_DRAWS), p)


@query
def shuffle_test(spark, sf_dir):
    return T.shuffle_test(_panel(spark, sf_dir), 60, 100, 25).drop("series")


@query
def embedding_choice(spark, sf_dir):
    return T.embedding_choice(_panel(spark, sf_dir), f"date < DATE '{SPLITS.validation}'")


@query
def score_spread(spark, sf_dir):
    return rounded(D.spread(_models(spark, sf_dir)[0], "model"))


BACKTEST = ["rolling_hs_w250", "gap_hs_w250_r125", "fhs_ewma_l094", "w_euclidean_l20_k20", "w_euclidean_l20_k50", "wz_euclidean_l20_k50"]


@query
def backtest_summary(spark, sf_dir):
    return rounded(B.summarise(B.run_backtest(_state(spark, sf_dir), BACKTEST, queries=TEST)[0]))


@query
def backtest_skips(spark, sf_dir):
    return B.summarise_skips(B.run_backtest(_state(spark, sf_dir), BACKTEST)[1])


@query
def duplicate_checks(spark, sf_dir):
    p = _panel(spark, sf_dir)
    return p.agg(F.count("*").alias("n"), F.countDistinct("date").alias("dates"), (F.max("pos") + 1).alias("positions"), F.count_if(F.col("ret").isNull()).alias("no_return"))


@query
def loss_matrix(spark, sf_dir):
    s, _ = _models(spark, sf_dir)
    names = ["fhs_ewma", "gap_hs", "rolling_hs", "window_knn"]
    return rounded(s.groupBy("date").pivot("model", names).agg(F.first("pinball")))


@query
def lineitem_rollup(spark, sf_dir):
    """Keys and attributes joined to the facts: revenue by region and year of shipping."""
    t = lambda n: P.table(spark, sf_dir, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy(F.col("r_name").alias("region"), F.year("l_shipdate").cast("long").alias("year")).agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


EVALUATED = ["rolling_hs_w250", "gap_hs_w250_r125", "w_euclidean_l20_k50"]


@query
def validation_folds(spark, sf_dir):
    """Registered candidates by year, those without a forecast being infeasible."""
    out = suites.fold_summary(_state(spark, sf_dir), suites.registry(), TEST, F.year("date"))
    return rounded(out.select("configuration", "method", "k", "window_length", "fold", "n_forecasts", "mean_pinball", "exceedance_rate", "mean_var", "mean_scenarios", "worst_pinball", "status"))


@query
def validation_finalists(spark, sf_dir):
    return rounded(suites.finalists(suites.fold_summary(_state(spark, sf_dir), suites.registry(), TEST, F.year("date"))))


@query
def selection_stability(spark, sf_dir):
    return rounded(D.selection_stability(_models(spark, sf_dir)[0], F.quarter("date")))


def _evaluation(spark, sf_dir) -> DataFrame:
    return suites.evaluation(_state(spark, sf_dir), EVALUATED, (0, 125), TEST)


@query
def evaluation_summary(spark, sf_dir):
    return rounded(D.summary(_evaluation(spark, sf_dir), "radius", "configuration"))


@query
def gap_comparison(spark, sf_dir):
    return rounded(suites.gap_comparison(_evaluation(spark, sf_dir), EVALUATED))


@query
def evaluation_matrix(spark, sf_dir):
    return rounded(suites.matrix(_evaluation(spark, sf_dir), ["radius"], EVALUATED))


@query
def inference_tables(spark, sf_dir):
    return I.backtest_tables(_models(spark, sf_dir)[0], ["model"], "date", draws=RESAMPLES)


@query
def paired_by_radius(spark, sf_dir):
    """Each radius' configurations against one of them, with intervals and Holm's p-values within the radius."""
    pairs = suites.against(_evaluation(spark, sf_dir), "w_euclidean_l20_k50", "radius")
    return I.paired_tables(pairs, ["radius", "configuration"], ["radius"], "date", draws=RESAMPLES)


@query
def range_confidence_set(spark, sf_dir):
    return I.range_confidence_set(_models(spark, sf_dir)[0], "date", "model", "pinball", draws=RESAMPLES)


@query
def null_draws(spark, sf_dir):
    return suites.null_draws(_panel(spark, sf_dir), K, NULL_DRAWS, (0, 125), TEST, (20,))


@query
def null_summary(spark, sf_dir):
    return suites.null_summary(null_draws(spark, sf_dir))


@query
def neighbour_profile(spark, sf_dir):
    p = _panel(spark, sf_dir)
    return rounded(D.profile(M.window_knn(p, SIZE, K, queries=TEST), oldest=SIZE))


@query
def verification(spark, sf_dir):
    p = _panel(spark, sf_dir)
    found = M.window_knn(p, SIZE, K, radius=125, queries=TEST)
    last = p.groupBy("series").agg(F.max("pos").alias("last"))
    return C.report(
        C.unique(p, "positions are unique", "series", "pos"), C.unique(p, "dates are unique", "series", "date"),
        C.holds(p.join(last, "series"), "only the last day lacks a next loss", "next_loss is not null or pos = last"), C.isolated(found, "neighbours keep their distance", 125),
        C.among(found, p.where(f"pos >= {SIZE}"), "neighbours have whole windows"), C.group_counts(found.select("series", "t", F.explode("neighbours")), "queries have equally many neighbours", ["series", "t"]),
    )


@query
def synthetic_series(spark, sf_dir):
    return rounded(synthetic.regions(spark), 10)


@query
def demo_retrieval(spark, sf_dir):
    """Nearest windows of a made-up series by warping and by landscapes."""
    return demo.retrieval(synthetic.regions(spark))
