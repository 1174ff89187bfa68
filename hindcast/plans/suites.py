"""Suites over registered configurations: validation by fold, evaluation by radius, null draws, inference tables and verification."""

from __future__ import annotations

import csv
import os
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.operators import diagnostics as D
from hindcast.operators import models as M
from hindcast.plans import backtest as B
from hindcast.sources.files import SchemaError, stored
from hindcast.sources.panel import version

REGISTRY = os.path.join(os.path.dirname(os.path.abspath(__file__)), "candidates.csv")
# A registry's columns.
FIELDS = ("configuration_id", "method", "k", "window_length", "lambda", "regime_bins", "exclusion_radius", "status")


def number(text: str | None, kind: type = int):
    """A number, or nothing for an empty field."""
    return kind(text) if text not in (None, "") else None


def registry(path: str = REGISTRY) -> list[dict]:
    """Rows of a registry of candidates, whose ids must be there once each."""
    with open(path, newline="") as f:
        rows = list(csv.DictReader(f))
    if rows and (missing := set(FIELDS) - set(rows[0])):
        raise SchemaError(f"missing columns: {', '.join(sorted(missing))}")
    ids = [r["configuration_id"] for r in rows]
    if not all(ids) or len(set(ids)) < len(ids):
        raise SchemaError("configuration_id is missing or repeated")
    casts = {"k": int, "window_length": int, "lambda": float, "regime_bins": int, "exclusion_radius": int}
    return [r | {c: number(r[c], t) for c, t in casts.items()} for r in rows]


def form(row: dict) -> str:
    """A registry row's configuration, from its method and parameters, which must be what its id says."""
    make = {
        "RollingHS": lambda: f"rolling_hs_w{row['window_length']}", "GapHS": lambda: f"gap_hs_w{row['window_length']}_r{row['exclusion_radius']}",
        "RegimeHS": lambda: f"regime_hs_bins{row['regime_bins']}", "FHSEWMA": lambda: f"fhs_ewma_l{row['lambda']:.2f}".replace("0.", "0"),
        "EuclideanKNN": lambda: f"s_euclidean_k{row['k']}", "MahalanobisKNN": lambda: f"s_mahalanobis_k{row['k']}", "TopologyKNN": lambda: f"topology_l{row['window_length']}_k{row['k']}",
    }
    windows = {f"{z}{m}": f"w{'z' if z else ''}_{n}_l{{window_length}}_k{{k}}" for z in ("", "Standardized") for m, n in (("WindowEuclidean", "euclidean"), ("DTWWindow", "dtw"), ("FPCAWindow", "fpca"))}
    method = row["method"]
    if method not in make and method not in windows:
        raise ValueError(f"no such method: {method}")
    name = make[method]() if method in make else windows[method].format(**row)
    B.parse(name)
    if name != row["configuration_id"]:
        raise ValueError(f"{row['configuration_id']} is registered with the parameters of {name}")
    return name


def table(spark: SparkSession, rows: list[dict]) -> DataFrame:
    return spark.createDataFrame([tuple(r[c] for c in FIELDS) for r in rows], "configuration string, method string, k int, window_length int, lambda double, regime_bins int, exclusion_radius int, status string").drop("status")


def fold_summary(panel: DataFrame, rows: list[dict], queries: Column | str, fold: Column) -> DataFrame:
    """Registry rows with their scores by fold; ``status`` is ``infeasible`` for a candidate without any."""
    spark = panel.sparkSession
    made, _ = B.run_backtest(panel, [form(r) for r in rows], queries=queries)
    folds = made.groupBy("configuration", fold.cast("string").alias("fold")).agg(
        F.count("*").alias("n_forecasts"), F.avg("pinball").alias("mean_pinball"), F.avg("hit").alias("exceedance_rate"), F.avg("var").alias("mean_var"), F.avg("n").alias("mean_scenarios"), F.max("pinball").alias("worst_pinball")
    )
    out = table(spark, rows).join(folds, "configuration", "left")
    return out.withColumn("status", F.when(F.col("n_forecasts").isNotNull(), "completed").otherwise("infeasible"))


def finalists(folds: DataFrame) -> DataFrame:
    """Of each method the configuration of the least mean score over folds; on a tie the least worst fold, then the first name."""
    whole = folds.where("status = 'completed'").groupBy("method", "configuration").agg(F.avg("mean_pinball").alias("mean_pinball"), F.max("mean_pinball").alias("worst_fold"), F.avg("exceedance_rate").alias("exceedance_rate"), F.avg("mean_scenarios").alias("mean_scenarios"), F.countDistinct("fold").alias("n_folds"))
    best = F.min_by(F.struct("configuration", "mean_pinball", "worst_fold", "exceedance_rate", "mean_scenarios", "n_folds"), F.struct("mean_pinball", "worst_fold", "configuration"))
    return whole.groupBy("method").agg(best.alias("best")).select("method", "best.*")


def evaluation(panel: DataFrame, names: list[str], radii: tuple[int, ...], queries: Column | str) -> DataFrame:
    """Scored forecasts of all configurations under each radius, those that state a radius of their own under it alone."""
    out = []
    for radius in radii:
        mine = [n for n in names if dict(B.parse(n).params).get("radius") in (None, str(radius))]
        mine = [n for n in mine if radius or B.parse(n).model != "gap_hs"]
        out.append(B.run_backtest(panel, mine, radius, queries)[0].withColumn("radius", F.lit(radius).cast("long")))
    return reduce(DataFrame.unionByName, out)


def gap_comparison(scores: DataFrame, names: list[str]) -> DataFrame:
    """Scores under each radius above 0 of a gapped model and those it is held against."""
    some = scores.where(F.col("radius") > 0).where(F.col("configuration").isin(names))
    return some.groupBy("radius", "configuration").agg(F.count("*").alias("n_dates"), F.avg("pinball").alias("mean_pinball"), F.avg("hit").alias("exceedance_rate"), F.avg("var").alias("mean_var"), F.avg("es").alias("mean_es"))


def null_draws(panel: DataFrame, k: int, draws: int, radii: tuple[int, ...], queries: Column | str, ks: tuple[int, ...] = (), seed: int = 1) -> DataFrame:
    """A row a radius, draw and k: scores of random neighbours and a checksum of them; a smaller k is a prefix of the same draw."""
    out = []
    for radius in radii:
        build = lambda r=radius: D.drawn(panel, k, draws, r, queries, seed).select("series", "t", "draw", "neighbours", "losses")
        state = version(panel)
        found = stored(panel.sparkSession, f"nulls-{k}-{draws}-{radius}-{seed}", state and f"{state}\n{queries}", build)
        for each in sorted({k, *ks}):
            mine = found.withColumns({"neighbours": F.slice("neighbours", 1, each), "losses": F.slice("losses", 1, each)})
            scores = D.null_scores(mine, panel).join(D.checksums(mine, "series", "draw"), ["series", "draw"])
            out.append(scores.withColumns({"radius": F.lit(radius).cast("long"), "k": F.lit(each).cast("long"), "seed": F.lit(seed).cast("long")}))
    return reduce(DataFrame.unionByName, out)


def null_summary(draws: DataFrame) -> DataFrame:
    return D.spread(draws, "radius", "k", value="mean_pinball")


def matrix(scores: DataFrame, keys: list[str], names: list[str], value: str = "pinball") -> DataFrame:
    """Dates by configurations; a date that lacks one of ``names`` has a null."""
    return scores.groupBy(*keys, "date").pivot("configuration", names).agg(F.first(value))


def against(scores: DataFrame, name: str, *keys: str, value: str = "pinball") -> DataFrame:
    """Differences ``d`` of configuration ``name`` from each other one, by date."""
    own = scores.where(F.col("configuration") == name).select(*keys, "date", F.col(value).alias("own"))
    return scores.where(F.col("configuration") != name).join(own, [*keys, "date"]).select(*keys, "configuration", "date", (F.col("own") - F.col(value)).alias("d"))


def risk_of(found: DataFrame, panel: DataFrame) -> DataFrame:
    return M.scored(M.risk(found), panel)
