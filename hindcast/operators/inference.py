"""Coverage tests, long-run variance, forecast comparison, bootstraps and model confidence sets.

Statistics that are sums over a series are Column aggregates; only resampling runs in Python, a group
(one pair of forecasts, or one matrix of losses) at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-12


def _clip(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(TINY)), F.lit(1 - TINY))


def _ll(p: Column, yes: Column, no: Column) -> Column:
    return yes * F.log(_clip(p)) + no * F.log(1 - _clip(p))


def erfc(x: Column) -> Column:
    """Complementary error function of non-negative values (Cody's three rational forms, to some 1e-15 of the value)."""
    # Coefficients of those forms, highest power first, for up to 0.46875, up to 4 and beyond.
    a = (1.85777706184603153e-1, 3.16112374387056560, 1.13864154151050156e2, 3.77485237685302021e2, 3.20937758913846947e3)
    b = (1.0, 2.36012909523441209e1, 2.44024637934444173e2, 1.28261652607737228e3, 2.84423683343917062e3)
    c = (2.15311535474403846e-8, 5.64188496988670089e-1, 8.88314979438837594, 6.61191906371416295e1, 2.98635138197400131e2, 8.81952221241769090e2, 1.71204761263407058e3, 2.05107837782607147e3, 1.23033935479799725e3)
    d = (1.0, 1.57449261107098347e1, 1.17693950891312499e2, 5.37181101862009858e2, 1.62138957456669019e3, 3.29079923573345963e3, 4.36261909014324716e3, 3.43936767414372164e3, 1.23033935480374942e3)
    p = (1.63153871373020978e-2, 3.05326634961232344e-1, 3.60344899949804439e-1, 1.25781726111229246e-1, 1.60837851487422766e-2, 6.58749161529837803e-4)
    q = (1.0, 2.56852019228982242, 1.87295284992346725, 5.27905102951428412e-1, 6.05183413124413191e-2, 2.33520497626869185e-3)

    def poly(coefficients: tuple[float, ...], at: Column) -> Column:
        out = F.lit(coefficients[0])
        for k in coefficients[1:]:
            out = out * at + k
        return out

    square = x * x
    tail = (1 / math.sqrt(math.pi) - poly(p, 1 / square) / poly(q, 1 / square) / square) / x
    middle = F.exp(-square) * F.when(x <= 4, poly(c, x) / poly(d, x)).otherwise(tail)
    return F.when(x <= 0.46875, 1 - x * poly(a, square) / poly(b, square)).otherwise(middle)


def chi2_p(stat: Column, df: int) -> Column:
    return erfc(F.sqrt(stat / 2)) if df == 1 else F.exp(-stat / 2)


def coverage(hits: DataFrame, keys: list[str], order: str, level: float = 0.99) -> DataFrame:
    """Kupiec, Christoffersen, conditional coverage and duration statistics by ``keys``, of a 0/1 column ``hit``."""
    by = Window.partitionBy(*keys).orderBy(order)
    h = hits.withColumn("before", F.lag("hit").over(by)).withColumn("i", F.row_number().over(by))
    gap = F.when(F.col("hit") == 1, F.col("i") - F.last(F.when(F.col("hit") == 1, F.col("i")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)))
    pair = lambda a, b: F.sum(F.when((F.col("before") == a) & (F.col("hit") == b), 1.0).otherwise(0.0))
    c = h.withColumn("gap", gap).groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.sum("hit").alias("k"), *(pair(a, b).alias(f"n{a}{b}") for a in (0, 1) for b in (0, 1)), F.count("gap").cast("double").alias("gaps"), F.sum("gap").cast("double").alias("days"))
    n, k, p = F.col("n"), F.col("k"), F.lit(1 - level)
    uc = F.greatest(F.lit(0.0), -2 * ((n - k) * F.log(1 - p) + k * F.log(p) - _ll(k / n, k, n - k)))
    n00, n01, n10, n11 = (F.col(f"n{x}") for x in ("00", "01", "10", "11"))
    share = lambda a, b: a / F.greatest(a + b, F.lit(1.0))
    ind = F.greatest(F.lit(0.0), -2 * (_ll(share(n01 + n11, n00 + n10), n01 + n11, n00 + n10) - _ll(share(n01, n00), n01, n00) - _ll(share(n11, n10), n11, n10)))
    g, d = F.col("gaps"), F.col("days")
    dur = F.when(g > 0, F.greatest(F.lit(0.0), 2 * (_ll(g / d, g, d - g) - _ll(p, g, d - g))))
    out = c.select(*keys, n.cast("long").alias("n"), k.alias("hits"), uc.alias("uc"), F.when(n >= 2, ind).alias("ind"), dur.alias("duration"))
    out = out.withColumn("cc", F.col("uc") + F.col("ind"))
    return out.withColumns({"uc_p": chi2_p(F.col("uc"), 1), "ind_p": chi2_p(F.col("ind"), 1), "cc_p": chi2_p(F.col("cc"), 2), "duration_p": chi2_p(F.col("duration"), 1)})


def z2(scores: DataFrame, keys: list[str], level: float = 0.975) -> DataFrame:
    """Studentised moment test of the expected shortfall."""
    x = F.when(F.col("es") > 0, F.when(F.col("next_loss") > F.col("var"), F.col("next_loss") / ((1 - level) * F.col("es"))).otherwise(0.0) - 1)
    a = scores.withColumn("x", x).groupBy(*keys).agg(F.count("x").alias("n"), F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    stat = F.when(F.col("s") > 0, F.sqrt(F.col("n").cast("double")) * F.col("m") / F.col("s")).when(F.abs("m") < 1e-15, 0.0).otherwise(F.signum("m") * float("inf"))
    return a.where("n >= 2").select(*keys, "n", stat.alias("z2")).withColumn("p", F.when(F.abs("z2") == float("inf"), 0.0).otherwise(erfc(F.abs("z2") / math.sqrt(2))))


def dm(pairs: DataFrame, keys: list[str], order: str, difference: str = "d", bandwidth: int | None = None, horizon: int = 1, small_sample: bool = True) -> DataFrame:
    """Diebold-Mariano statistic with Bartlett weights, and a factor for small samples.

    Lagged products are summed by row: a row meets the ``bandwidth`` ones before it only.  Without one the
    usual rule is taken, which stays below 200 up to 4e9 rows.
    """
    whole = Window.partitionBy(*keys)
    c = pairs.where(F.col(difference).isNotNull()).withColumn("n", F.count("*").over(whole)).withColumn("m", F.avg(difference).over(whole))
    width = F.lit(bandwidth) if bandwidth else F.greatest(F.lit(1), F.floor(4 * F.pow(F.col("n") / 100, 2 / 9)))
    c = c.withColumn("e", F.col(difference) - F.col("m")).withColumn("bw", width.cast("int"))
    by = Window.partitionBy(*keys).orderBy(order)
    before = F.collect_list("e").over(by.rowsBetween(-(bandwidth or 200), -1))
    last = F.when(F.size(before) > F.col("bw"), F.slice(before, F.size(before) - F.col("bw") + 1, F.col("bw"))).otherwise(before)
    lagged = F.aggregate(F.sequence(F.lit(1), F.col("bw")), F.lit(0.0), lambda s, j: s + F.coalesce((1 - j / (F.col("bw") + 1)) * F.try_element_at(F.col("near"), -j), F.lit(0.0)))
    c = c.withColumn("near", last).withColumn("v", F.col("e") * F.col("e") + 2 * F.col("e") * lagged)
    a = c.groupBy(*keys).agg(F.max("n").alias("n"), F.max("m").alias("mean"), F.greatest(F.sum("v") / F.max("n"), F.lit(0.0)).alias("variance"))
    n = F.col("n").cast("double")
    factor = F.sqrt((n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n) if small_sample else F.lit(1.0)
    stat = F.when(F.col("variance") > 0, F.col("mean") / F.sqrt(F.col("variance") / n) * factor).when(F.abs("mean") < 1e-15, 0.0).otherwise(F.signum("mean") * float("inf"))
    return a.where("n >= 2").withColumn("dm", stat).withColumn("p", F.when(F.abs("dm") == float("inf"), 0.0).otherwise(erfc(F.abs("dm") / math.sqrt(2))))


def holm(df: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Adds ``holm``: p-values adjusted for how many there are in each group; null stays null."""
    some = df.where(F.col(p).isNotNull())
    by = Window.partitionBy(*keys).orderBy(p)
    step = F.col(p) * (F.count("*").over(Window.partitionBy(*keys)) - F.row_number().over(by) + 1)
    out = some.withColumn("step", step).withColumn("holm", F.least(F.lit(1.0), F.max("step").over(by.rowsBetween(Window.unboundedPreceding, 0)))).drop("step")
    return out.unionByName(df.where(F.col(p).isNull()).withColumn("holm", F.lit(None).cast("double")))


def block_starts(n: int, block: int, draws: int, rng: np.random.Generator) -> np.ndarray:
    """Rows of a circular block resample, a line a draw."""
    block = max(1, min(block, n))
    start = rng.integers(0, n, (draws, -(-n // block)))
    return ((start[:, :, None] + np.arange(block)) % n).reshape(draws, -1)[:, :n]


def block_interval(x: np.ndarray, block: int = 10, draws: int = 500, seed: int = 20260927) -> tuple[float, float]:
    x = x[np.isfinite(x)]
    if len(x) < 2:
        return math.nan, math.nan
    means = x[block_starts(len(x), block, draws, np.random.default_rng(seed))].mean(axis=1)
    return tuple(float(q) for q in np.quantile(means, (0.025, 0.975)))


def bootstrap_intervals(df: DataFrame, keys: list[str], order: str, value: str = "d", block: int = 10, draws: int = 500, seed: int = 20260927) -> DataFrame:
    """Circular block bootstrap interval of a mean, by ``keys``."""
    packed = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, value))).alias("x")).select(*keys, F.col("x")[value].alias("x"))
    kinds = {f.name: f.dataType.simpleString() for f in packed.schema if f.name in keys}

    def run(batches):
        for b in batches:
            found = [block_interval(np.array(x.values.to_numpy(zero_copy_only=False), float), block, draws, seed) for x in b.column("x")]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.float64())], [*keys, "low", "high"])

    return packed.mapInArrow(run, ", ".join(f"`{k}` {t}" for k, t in kinds.items()) + ", low double, high double")


def confidence_set(losses: np.ndarray, alpha: float = 0.1, draws: int = 500, block: int = 10, seed: int = 20260927) -> list[tuple[int, float, bool]]:
    """Models in order of leaving: place, p-value (never less than one before) and whether it stays.

    The statistic is the largest absolute t-value among pairs; while equal means are rejected the model
    worst against the others by its largest t-value leaves.
    """
    n, k = losses.shape
    rows = block_starts(n, block, draws, np.random.default_rng(seed))
    boot = losses[rows].mean(axis=1) - losses.mean(axis=0)
    gap, noise = losses.mean(axis=0)[:, None] - losses.mean(axis=0)[None], boot[:, :, None] - boot[:, None, :]
    scale = np.sqrt(np.maximum((noise**2).mean(axis=0), 1e-18))
    t, z = gap / scale, np.abs(noise) / scale
    left, out, worst_p = list(range(k)), [], 0.0
    while len(left) > 1:
        part = np.ix_(left, left)
        stat = np.abs(t[part]).max()
        worst_p = max(worst_p, float((1 + (z[:, left][:, :, left].max(axis=(1, 2)) >= stat).sum()) / (draws + 1)))
        go = left[int(t[part].max(axis=1).argmax())]
        out.append((go, worst_p, worst_p >= alpha))
        left.remove(go)
    return [*out, (left[0], 1.0, True)]


def model_confidence_sets(losses: DataFrame, keys: list[str], order: str, model: str, value: str, **how) -> DataFrame:
    """``confidence_set`` of each group's models, over the dates all of them have."""
    models = Window.partitionBy(*keys)
    whole = losses.where(F.col(value).isNotNull()).withColumn("models", F.size(F.collect_set(model).over(models)))
    whole = whole.withColumn("here", F.count("*").over(Window.partitionBy(*keys, order))).where("here = models")
    kinds = {f.name: f.dataType.simpleString() for f in losses.schema if f.name in keys}

    def run(key, rows):
        wide = rows.to_pandas().pivot(index=order, columns=model, values=value).sort_index()
        found = confidence_set(wide.to_numpy(float), **how)
        names = list(wide.columns)
        cols = {k: [v.as_py()] * len(found) for k, v in zip(keys, key)}
        return pa.table(cols | {"model": [names[i] for i, _, _ in found], "elimination_order": pa.array(range(1, len(found) + 1), pa.int64()), "p": [p for _, p, _ in found], "included": [s for _, _, s in found], "mean_loss": [float(wide.iloc[:, i].mean()) for i, _, _ in found], "n_dates": pa.array([len(wide)] * len(found), pa.int64())})

    return whole.select(*keys, order, model, value).groupBy(*keys).applyInArrow(run, ", ".join(f"`{k}` {t}" for k, t in kinds.items()) + ", model string, elimination_order long, p double, included boolean, mean_loss double, n_dates long")


def range_statistic(x: np.ndarray) -> float:
    mean = x.mean(axis=0)
    return float(np.abs((mean - mean.mean()) / np.sqrt(np.maximum(x.var(axis=0, ddof=1), 1e-18) / len(x))).max())


def range_set(losses: np.ndarray, alpha: float = 0.1, draws: int = 500, block: int = 10, seed: int = 20260927) -> list[tuple[int, float, float, bool]]:
    """Model, statistic, p-value and whether it stays, by model; those that stay have neither statistic nor p-value.

    The statistic is the largest distance of a model's mean from that of all, by its own deviation; while it is
    rejected against resamples of centred losses, the model of the largest mean goes.
    """
    left, gone, rng = list(range(losses.shape[1])), {}, np.random.default_rng(seed)
    while len(left) > 1:
        x = losses[:, left]
        seen, centred = range_statistic(x), x - x.mean(axis=0)
        null = np.array([range_statistic(centred[rows]) for rows in block_starts(len(x), block, draws, rng)])
        p = float((1 + (null >= seen).sum()) / (draws + 1))
        if p >= alpha:
            break
        gone[left.pop(int(x.mean(axis=0).argmax()))] = (seen, p)
    return [(i, *gone.get(i, (math.nan, math.nan)), i in left) for i in range(losses.shape[1])]


def range_confidence_set(losses: DataFrame, order: str, model: str, value: str, **how) -> DataFrame:
    """``range_set`` of all models over the dates that each of them has; the loss matrix is packed into one row."""
    by = Window.partitionBy(order)
    models = losses.where(F.col(value).isNotNull()).withColumn("here", F.count("*").over(by))
    packed = models.groupBy("here").agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(model).alias("m"), F.col(value).alias("v")))).alias("x"), F.countDistinct(model).alias("models")).where("here = models")
    packed = packed.select(F.col("x.m").alias("m"), F.col("x.v").alias("v"), "models").orderBy(F.desc("models")).limit(1)

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                k = b.column("models")[i].as_py()
                names, x = b.column("m")[i].as_py()[:k], b.column("v")[i].values.to_numpy().reshape(-1, k)
                rows = [{"model": names[m], "included": stays, "mean_loss": float(x[:, m].mean()), "statistic": None if stays else stat, "p": None if stays else p, "n_dates": len(x), "n_models": k} for m, stat, p, stays in range_set(x, **how)]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("model", pa.string()), ("included", pa.bool_()), ("mean_loss", pa.float64()), ("statistic", pa.float64()), ("p", pa.float64()), ("n_dates", pa.int64()), ("n_models", pa.int64())]))

    return packed.mapInArrow(run, "model string, included boolean, mean_loss double, statistic double, p double, n_dates long, n_models long")


def shortfall_bootstrap(y: np.ndarray, q: np.ndarray, e: np.ndarray, level: float = 0.975, block: int = 10, draws: int = 2_000, seed: int = 20260927) -> tuple[int, float, float, float]:
    """Forecasts used, studentised mean of the shortfall's moment, its p-value against resampled blocks, and the mean."""
    ok = np.isfinite(y) & np.isfinite(q) & np.isfinite(e) & (e > 0)
    y, q, e = y[ok], q[ok], e[ok]
    if len(y) < 2:
        return len(y), math.nan, math.nan, math.nan
    x = y * (y > q) / ((1 - level) * e) - 1

    def studentised(rows: np.ndarray) -> np.ndarray:
        sd = rows.std(axis=-1, ddof=1)
        return np.where(sd > 0, np.sqrt(rows.shape[-1]) * rows.mean(axis=-1) / np.where(sd > 0, sd, 1), 0.0)

    seen = float(studentised(x))
    null = studentised((x - x.mean())[block_starts(len(x), block, draws, np.random.default_rng(seed))])
    return len(x), seen, float((1 + (np.abs(null) >= abs(seen)).sum()) / (draws + 1)), float(x.mean())


def shortfall_bootstraps(scores: DataFrame, keys: list[str], order: str, **how) -> DataFrame:
    """``shortfall_bootstrap`` of ``next_loss``, ``var`` and ``es`` by ``keys``."""
    packed = scores.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, "next_loss", "var", "es"))).alias("x")).select(*keys, *(F.col("x")[c].alias(c) for c in ("next_loss", "var", "es")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema if f.name in keys)

    def run(batches):
        for b in batches:
            found = [shortfall_bootstrap(*(np.array(b.column(c)[i].values.to_numpy(zero_copy_only=False), float) for c in ("next_loss", "var", "es")), **how) for i in range(b.num_rows)]
            n, stat, p, mean = zip(*found) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(n, pa.int64()), *(pa.array(c, pa.float64()) for c in (stat, p, mean))], [*keys, "n_valid", "statistic", "p", "mean_moment"])

    return packed.mapInArrow(run, f"{kinds}, n_valid long, statistic double, p double, mean_moment double")


def paired_tables(pairs: DataFrame, keys: list[str], family: list[str], order: str, **how) -> DataFrame:
    """One row a pair: mean difference, its statistic and p-value, a block bootstrap interval, and Holm's p-value within ``family``."""
    tested = dm(pairs, keys, order).join(bootstrap_intervals(pairs, keys, order, **how), keys)
    return holm(tested, family)


def backtest_tables(scores: DataFrame, keys: list[str], order: str, level: float = 0.99, **how) -> DataFrame:
    """One row a group: coverage tests, mean scores with block bootstrap intervals, and the bootstrapped shortfall test."""
    mean = lambda c: bootstrap_intervals(scores.where(F.col(c).isNotNull()), keys, order, c, **how).withColumnsRenamed({"low": f"{c}_low", "high": f"{c}_high"})
    means = scores.groupBy(*keys).agg(F.avg("pinball").alias("mean_pinball"), F.avg("fz0").alias("mean_fz0"), F.count("fz0").alias("n_fz0"), F.avg("var").alias("mean_var"), F.avg("es").alias("mean_es"), F.avg("hit").alias("hit_rate"))
    es = shortfall_bootstraps(scores, keys, order, **how).withColumnsRenamed({"statistic": "es_statistic", "p": "es_p"})
    return coverage(scores, keys, order, level).join(means, keys).join(mean("pinball"), keys).join(mean("fz0"), keys, "left").join(es, keys)
