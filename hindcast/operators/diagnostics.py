"""Diagnostics of forecasts and neighbours: summaries, winners, ages, overlaps, ties, recency and null controls."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.functions.scores import jaccard
from hindcast.operators import models as M
from hindcast.operators import retrieval as R

AGES = (21, 63, 126, 252, 504)


def summary(scores: DataFrame, *keys: str) -> DataFrame:
    return scores.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("pinball").alias("mean_pinball"), F.avg("fz0").alias("mean_fz0"), F.avg("hit").alias("hit_rate"), F.avg("var").alias("mean_var"),
        F.avg("es").alias("mean_es"), F.max("pinball").alias("worst_pinball"), F.avg("n").alias("mean_scenarios"),
    )


def spread(scores: DataFrame, *keys: str, value: str = "pinball") -> DataFrame:
    """How a value is spread: distinct values, mean, sample deviation (zero for one row), 5th, 50th and 95th percentile, least and greatest."""
    q = lambda p: F.percentile(value, p)
    return scores.groupBy(*keys).agg(
        F.count("*").alias("n"), F.countDistinct(value).alias("distinct_values"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"),
        q(0.05).alias("p05"), q(0.5).alias("p50"), q(0.95).alias("p95"), F.min(value).alias("least"), F.max(value).alias("greatest"),
    )


def winners(scores: DataFrame, fold: Column, by: str = "model", value: str = "pinball") -> DataFrame:
    """Each fold's models by mean score, the mean over folds, the worst fold, and the ranks when a fold is left out."""
    f = scores.groupBy(by, fold.alias("fold")).agg(F.avg(value).alias("mean"))
    f = f.withColumn("rank", F.rank().over(Window.partitionBy("fold").orderBy("mean")).cast("long"))
    whole = f.groupBy(by).agg(F.avg("mean").alias("mean"), F.max("mean").alias("worst"), F.avg("rank").alias("mean_rank"), F.max("rank").alias("worst_rank"), F.count_if(F.col("rank") == 1).alias("fold_wins"))
    left = f.select(F.col("fold").alias("out")).distinct().join(f, F.col("out") != F.col("fold")).groupBy(by, "out").agg(F.avg("mean").alias("mean"))
    left = left.withColumn("first", F.row_number().over(Window.partitionBy("out").orderBy("mean", by)) == 1).groupBy(by).agg(F.count_if(F.col("first")).alias("left_out_wins"))
    return whole.join(left, by, "left").withColumn("winner", F.row_number().over(Window.orderBy("mean", "worst", by)) == 1)


def neighbour_ages(found: DataFrame, *keys: str) -> DataFrame:
    a = found.select(*keys, "t", F.explode("neighbours").alias("s")).withColumn("age", (F.col("t") - F.col("s")).cast("double"))
    q = lambda p: F.percentile("age", p)
    return a.groupBy(*keys).agg(F.avg("age").alias("mean_age"), q(0.5).alias("median_age"), q(0.05).alias("p05_age"), q(0.95).alias("p95_age"), F.min("age").alias("min_age"))


def age_shares(found: DataFrame, *keys: str, edges: tuple[int, ...] = AGES) -> DataFrame:
    """How many neighbours fall between ages."""
    a = found.select(*keys, "t", F.explode("neighbours").alias("s")).withColumn("age", F.col("t") - F.col("s"))
    bin_ = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        bin_ = F.when(F.col("age") <= edges[i], i).otherwise(bin_)
    return a.groupBy(*keys, bin_.cast("long").alias("age_bin")).agg(F.count("*").alias("n"))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Jaccard similarity of two retrievals' neighbours for each query."""
    return a.select("series", "t", F.col("neighbours").alias("x")).join(b.select("series", "t", F.col("neighbours").alias("y")), ["series", "t"]).select("series", "t", jaccard(F.col("x"), F.col("y")).alias("jaccard"))


def ties(found: DataFrame, k: int, near: float = 1e-12) -> DataFrame:
    """How often the k-th and the next distance are equal or as good as equal; ``found`` needs k + 1 neighbours."""
    d = found.where(F.size("distances") > k).select("series", F.element_at("distances", k).alias("a"), F.element_at("distances", k + 1).alias("b"))
    return d.groupBy("series").agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("exact"), F.count_if(F.col("b") - F.col("a") <= near * F.greatest(F.lit(1.0), F.col("b"))).alias("near"), F.min(F.col("b") - F.col("a")).alias("least_gap"))


def drawn(panel: DataFrame, k: int, draws: int, radius: int = 0, queries: Column | str = "true", seed: int = 1) -> DataFrame:
    """Null control: for each query and draw, ``k`` eligible days with a next loss at random; nothing but the past is used.

    Dealing the features of the eligible days to those days at random gives the same distribution of neighbours
    (up to ties), so this is also the fast way to ``controls.permuted``.
    """

    def redraw(draw: int, t: int, d: np.ndarray) -> np.ndarray:
        return np.random.default_rng((seed, radius, draw, t)).random(len(d))

    nothing = lambda f, t, c: np.zeros(len(c))
    return R.retrieve(panel, nothing, lambda s: np.zeros((len(s["loss"]), 1)), ("loss",), k, radius, queries, draws, redraw)


def recency_matched(found: DataFrame, panel: DataFrame, draws: int, radius: int = 0, edges: tuple[int, ...] = AGES, seed: int = 1) -> DataFrame:
    """Null control: of each age bin as many eligible days as the retrieval took from it, at random."""
    q = found.select("series", "t", "neighbours").crossJoin(F.broadcast(found.sparkSession.range(0, draws, R.DRAWS_EACH).withColumnRenamed("id", "draw")))

    def run(batches):
        for b in batches:
            for series, t, near, first in zip(*(b.column(c).to_pylist() for c in ("series", "t", "neighbours", "draw"))):
                bin_of = np.searchsorted(edges, t - np.arange(max(t - radius, 0)), "left")
                need = np.bincount(np.searchsorted(edges, t - np.array(near, int), "left"), minlength=len(edges) + 1)
                pools = [(np.flatnonzero(bin_of == i), n) for i, n in enumerate(need) if n]
                out = []
                for draw in range(first, min(first + R.DRAWS_EACH, draws)):
                    rng = np.random.default_rng((seed, radius, draw, t))
                    out.append(np.concatenate([np.zeros(0, int), *(rng.choice(p, min(n, len(p)), replace=False) for p, n in pools)]).tolist())
                yield pa.RecordBatch.from_arrays([pa.array([series] * len(out)), pa.array([t] * len(out), pa.int64()), pa.array(out, pa.list_(pa.int64())), pa.array(range(first, first + len(out)), pa.int64())], ["series", "t", "neighbours", "draw"])

    return with_losses(R.deal(q, "series", "draw", "t").mapInArrow(run, "series string, t long, neighbours array<long>, draw long"), panel)


def with_losses(found: DataFrame, panel: DataFrame) -> DataFrame:
    """Adds the next-day losses of the neighbours, from the series packed into a row each."""
    held = panel.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("pos", "next_loss"))).alias("rows"))
    held = held.select("series", F.transform("rows", lambda r: r.next_loss).alias("every"))
    return found.join(held, "series").withColumn("losses", F.transform("neighbours", lambda s: F.get("every", s.cast("int")))).drop("every")


def null_scores(found: DataFrame, panel: DataFrame) -> DataFrame:
    """Mean score of each draw."""
    f = M.risk(found.withColumn("series", F.concat_ws("/", "series", F.col("draw").cast("string"))))
    f = f.withColumn("draw", F.element_at(F.split("series", "/"), -1).cast("long")).withColumn("series", F.element_at(F.split("series", "/"), 1))
    return M.scored(f, panel).groupBy("series", "draw").agg(F.avg("pinball").alias("mean_pinball"), F.avg("hit").alias("hit_rate"))


def checksums(found: DataFrame, *keys: str) -> DataFrame:
    """A SHA-256 of all neighbours in order of query and rank, and the least and greatest query, by ``keys``."""
    line = F.concat_ws(":", F.col("t").cast("string"), F.array_join(F.transform("neighbours", lambda s: s.cast("string")), ";"))
    each = found.select(*keys, "t", F.sha2(line, 256).alias("h"))
    return each.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("t", "h"))), lambda x: x.h), ""), 256).alias("checksum"), F.count("*").alias("n_forecasts"))


def profile(found: DataFrame, oldest: int = 0, radius: int = 0, recent: tuple[int, ...] = (100, 250), cutoffs: tuple[int, ...] = (20, 60, 125, 250)) -> DataFrame:
    """Ages of neighbours and their likeness to the most recent candidates, as ``measure`` and ``value``; candidates begin at ``oldest``."""
    age = found.select(F.explode("neighbours").alias("s"), "t").select((F.col("t") - F.col("s")).cast("double").alias("age"))
    shares = [F.avg((F.col("age") <= c).cast("double")).alias(f"share_age_le_{c}") for c in cutoffs]
    ages = age.agg(F.avg("age").alias("mean_age"), *(F.percentile("age", p).alias(f"age_q{round(100 * p):02d}") for p in (0.05, 0.25, 0.5, 0.75, 0.95)), *shares)
    last = F.col("t") - radius - 1
    likeness = found.where(last >= oldest).select(*(jaccard(F.col("neighbours"), F.sequence(F.greatest(last - n + 1, F.lit(oldest).cast("long")), last)).alias(f"j{n}") for n in recent))
    likeness = likeness.agg(*(f(f"j{n}").alias(f"{name}_jaccard_recent_{n}") for n in recent for name, f in (("mean", F.avg), ("median", F.median))))
    wide = ages.crossJoin(likeness)
    return wide.unpivot([], wide.columns, "measure", "value")


def selection_stability(scores: DataFrame, fold: Column, by: str = "model", value: str = "pinball") -> DataFrame:
    """Winners by fold, over all folds and with a fold left out, and each model's ranks: ``kind``, ``fold``, model, mean and the rank's mean, greatest and deviation."""
    f = scores.groupBy(by, fold.cast("string").alias("fold")).agg(F.avg(value).alias("mean"))
    f = f.withColumn("rank", F.rank().over(Window.partitionBy("fold").orderBy("mean")).cast("double"))
    least = lambda d, kind: d.groupBy("fold").agg(F.min(F.struct("mean", by)).alias("top")).select(F.lit(kind).alias("kind"), "fold", F.col(f"top.{by}").alias(by), F.col("top.mean").alias("mean"))
    whole = f.groupBy(by).agg(F.avg("mean").alias("mean"), F.avg("rank").alias("mean_rank"), F.max("rank").alias("worst_rank"), F.stddev_samp("rank").alias("sd_rank"))
    left = f.select(F.col("fold").alias("out")).distinct().join(f, F.col("out") != F.col("fold")).groupBy("out", by).agg(F.avg("mean").alias("mean")).withColumnRenamed("out", "fold")
    out = least(f, "fold").unionByName(least(whole.withColumn("fold", F.lit("all")), "all")).unionByName(least(left, "without"))
    return out.unionByName(whole.select(F.lit("ranks").alias("kind"), F.lit("all").alias("fold"), by, "mean", "mean_rank", "worst_rank", "sd_rank"), allowMissingColumns=True)


def randomisation_p(nulls: DataFrame, real: DataFrame) -> DataFrame:
    """(1 + draws as good as the real one) / (1 + draws)."""
    return nulls.join(F.broadcast(real.select("series", F.col("mean_pinball").alias("real"))), "series").groupBy("series").agg(F.count("*").alias("draws"), ((1 + F.count_if(F.col("mean_pinball") <= F.col("real"))) / (1 + F.count("*"))).alias("p"))
