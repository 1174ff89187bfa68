"""Configurations by name, and the backtest that runs a list of them over a panel."""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hindcast.operators import models as M
from hindcast.operators import retrieval as R
from hindcast.operators import topology as T
from hindcast.sources.panel import split

# How a configuration's name states its model and parameters.
FORMS = {
    "rolling_hs": r"rolling_hs_w(?P<window>\d+)",
    "gap_hs": r"gap_hs_w(?P<window>\d+)(?:_r(?P<radius>\d+))?",
    "regime_hs": r"regime_hs_bins(?P<bins>\d+)",
    "fhs_ewma": r"fhs_ewma_l0(?P<decay>\d+)",
    "garch_t": r"garch_t_w(?P<fit>\d+)_r(?P<refit>\d+)",
    "state": r"s_(?P<metric>euclidean|mahalanobis)_k(?P<k>\d+)",
    "window": r"w(?P<z>z?)_(?P<metric>euclidean|dtw|fpca)_l(?P<size>\d+)_k(?P<k>\d+)",
    "topology": r"topology_l(?P<size>\d+)_k(?P<k>\d+)",
}
METRICS = {"euclidean": R.euclidean, "dtw": R.dtw(10), "fpca": R.fpca(5)}


@dataclass(frozen=True)
class Configuration:
    name: str
    model: str
    params: tuple[tuple[str, str], ...]

    def __getitem__(self, key: str) -> str:
        return dict(self.params)[key]

    @property
    def family(self) -> tuple:
        """Configurations that differ in ``k`` alone share one retrieval."""
        return self.model, tuple(p for p in self.params if p[0] != "k")


def parse(name: str) -> Configuration:
    for model, form in FORMS.items():
        if m := re.fullmatch(form, name):
            return Configuration(name, model, tuple(m.groupdict().items()))
    raise ValueError(f"not a configuration: {name}")


def grid(form: str, **values: list) -> list[str]:
    """Names of all combinations, as ``grid("w_dtw_l{size}_k{k}", size=[60], k=[50, 100])``."""
    return [form.format(**dict(zip(values, v))) for v in product(*values.values())]


def _forecasts(configurations: list[Configuration], panel: DataFrame, radius: int, queries: Column | str) -> DataFrame:
    """Risk of one family's configurations."""
    c = configurations[0]
    if c.model == "garch_t":
        return M.garch_t(panel, fit=int(c["fit"]), refit=int(c["refit"]), queries=queries).withColumn("configuration", F.lit(c.name))
    if "k" in dict(c.params):
        most = max(int(x["k"]) for x in configurations)
        if c.model == "state":
            found = M.state_knn(panel, most, radius, queries, R.mahalanobis if c["metric"] == "mahalanobis" else R.scaled_euclidean)
        elif c.model == "window":
            found = M.window_knn(panel, int(c["size"]), most, radius, queries, METRICS[c["metric"]], bool(c["z"]))
        else:
            found = T.topology_knn(panel, int(c["size"]), most, radius, queries)
        each = F.explode(F.array(*(F.struct(F.lit(x.name).alias("name"), F.lit(int(x["k"])).alias("k")) for x in configurations)))
        found = found.withColumn("each", each).select("series", "t", F.col("each.name").alias("configuration"), F.slice("losses", F.lit(1), F.col("each.k")).alias("losses"))
    else:
        made = {
            "rolling_hs": lambda: M.rolling_hs(panel, int(c["window"]), queries=queries), "gap_hs": lambda: M.rolling_hs(panel, int(c["window"]), int(c["radius"] or radius), queries),
            "regime_hs": lambda: M.regime_hs(panel, int(c["bins"]), queries), "fhs_ewma": lambda: M.fhs_ewma(panel, int(c["decay"]) / 10 ** len(c["decay"]), queries),
        }
        found = made[c.model]().withColumn("configuration", F.lit(c.name))
    return M.risk(found, "configuration")


def run_backtest(panel: DataFrame, names: list[str], radius: int = 0, queries: Column | str = "true") -> tuple[DataFrame, DataFrame]:
    """Scored forecasts of all configurations, and the forecasts that couldn't be made, with a reason.

    ``panel`` holds the state columns.  A day without a next loss can't be scored, so it is in neither.
    """
    families: dict[tuple, list[Configuration]] = {}
    for name in dict.fromkeys(names):
        c = parse(name)
        families.setdefault(c.family, []).append(c)
    out = None
    for members in families.values():
        f = _forecasts(members, panel, radius, queries).select("series", "t", "configuration", "n", "var", "es")
        out = f if out is None else out.unionByName(f)
    if out is None:
        raise ValueError("no configurations")
    out = M.scored(out.where("var is not null"), panel).withColumn("split", split("date"))
    every = panel.where(queries).where("next_loss is not null").select("series", F.col("pos").alias("t"), "date", split("date").alias("split"), F.explode(F.array(*(F.lit(n) for n in dict.fromkeys(names)))).alias("configuration"))
    skipped = every.join(out.select("series", "t", "configuration"), ["series", "t", "configuration"], "left_anti")
    return out, skipped.withColumn("reason", F.lit("no features, candidates or losses"))


def summarise(scores: DataFrame) -> DataFrame:
    """Counts and means by split and configuration."""
    shortfall = (F.col("next_loss") > F.col("es")).cast("double")
    return scores.groupBy("split", "configuration").agg(
        F.count("*").alias("n"), F.avg("var").alias("mean_var"), F.avg("es").alias("mean_es"), F.avg("hit").alias("hit_rate"), F.avg(shortfall).alias("shortfall_rate"),
        F.avg("next_loss").alias("mean_loss"), F.avg("n").alias("mean_scenarios"),
    )


def summarise_skips(skipped: DataFrame) -> DataFrame:
    return skipped.groupBy("split", "configuration", "reason").agg(F.count("*").alias("n"))
