"""Forecast models: each gives ``series``, ``t`` and the loss scenarios of the next day, from which risk is read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.config import RISK, STATE, Risk
from hindcast.functions.scores import array_quantile, finite, fz0, pinball, tail_mean
from hindcast.operators import retrieval as R

RANDOM_SEED = 20260426


def risk(scenarios: DataFrame, *keys: str, risk: Risk = RISK, losses: str = "losses") -> DataFrame:
    """Value at risk, expected shortfall and how many scenarios they are from; ``keys`` stay."""
    a = F.col(losses)
    n = F.size(F.filter(a, finite)).cast("long")
    return scenarios.select("series", "t", *keys, n.alias("n"), array_quantile(a, risk.var).alias("var"), tail_mean(a, risk.es).alias("es"))


def scored(forecasts: DataFrame, panel: DataFrame) -> DataFrame:
    """Forecasts with the loss that came, its scores and exceedance."""
    came = panel.select("series", F.col("pos").alias("t"), "date", "next_loss").where("next_loss is not null")
    out = forecasts.join(came, ["series", "t"])
    return out.withColumns({"pinball": pinball("next_loss", "var"), "fz0": fz0("next_loss", "var", "es"), "hit": (F.col("next_loss") > F.col("var")).cast("double")})


def rolling_hs(panel: DataFrame, window: int, radius: int | None = None, queries="true") -> DataFrame:
    """The last ``window`` losses up to the day itself; with a ``radius``, up to ``radius + 1`` days before it."""
    gap = 0 if radius is None else radius + 1

    def make(s: dict[str, np.ndarray]):
        known = np.flatnonzero(np.isfinite(s["loss"]))
        return lambda t: s["loss"][known[max(0, (n := int(np.searchsorted(known, t - gap, "right"))) - window) : n]]

    return R.scenarios(panel, ("loss",), queries, make)


def regime_hs(panel: DataFrame, bins: int, queries="true") -> DataFrame:
    """Next-day losses after earlier days in the same volatility bin; bins are quantiles of the history before the day."""

    def make(s: dict[str, np.ndarray]):
        rv, loss, after = s["rv20"], s["loss"], s["next_loss"]

        def of(t: int) -> np.ndarray:
            past = np.flatnonzero(np.isfinite(rv[:t]))
            if len(past) and np.isfinite(rv[t]):
                edges = np.quantile(rv[past], [i / bins for i in range(1, bins)])
                like = after[past][np.searchsorted(edges, rv[past], "left") == np.searchsorted(edges, rv[t], "left")]
                like = like[np.isfinite(like)]
                if len(like):
                    return like
            every = loss[: t + 1]
            return every[np.isfinite(every)]

        return of

    return R.scenarios(panel, ("rv20", "loss", "next_loss"), queries, make)


def volatilities(r: np.ndarray, decay: float) -> np.ndarray:
    """Volatility before each return by exponential weighting, started at the deviation of the first 20 returns."""
    s = np.empty(len(r))
    now = float(r[:20].std()) or 1e-8 if len(r) else 0.0
    for i, x in enumerate(r.tolist()):
        s[i] = now
        now = float(np.sqrt(decay * now * now + (1 - decay) * x * x)) or 1e-8
    return s


def fhs_ewma(panel: DataFrame, decay: float, queries="true") -> DataFrame:
    """Past returns over their volatility, times tomorrow's: scenarios for each day from all days up to it."""

    def make(s: dict[str, np.ndarray]):
        known = np.flatnonzero(np.isfinite(s["ret"]))
        r = s["ret"][known]
        sigma = volatilities(r, decay)
        z, ahead = -r / sigma, np.sqrt(decay * sigma**2 + (1 - decay) * r**2)

        def of(t: int) -> np.ndarray | None:
            n = int(np.searchsorted(known, t, "right"))
            return z[:n] * ahead[n - 1] if n and known[n - 1] == t else None

        return of

    return R.scenarios(panel, ("ret",), queries, make)


def state_knn(panel: DataFrame, k: int, radius: int = 0, queries="true", metric: R.Metric = R.scaled_euclidean, columns: tuple[str, ...] = STATE) -> DataFrame:
    return R.retrieve(panel, metric, R.state_features(columns), columns, k, radius, queries)


def window_knn(panel: DataFrame, size: int, k: int, radius: int = 0, queries="true", metric: R.Metric = R.euclidean, z: bool = False) -> DataFrame:
    return R.retrieve(panel, metric, R.window_features(size, z), ("ret",), k, radius, queries)


def scattered(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit values, held in 64 bits, that scatters them; two rounds of shift and product."""
    mask = np.uint64(0xFFFFFFFF)
    for shift, times in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x = ((x ^ (x >> np.uint64(shift))) * np.uint64(times)) & mask
    return x ^ (x >> np.uint64(16))


def random_knn(panel: DataFrame, k: int, radius: int = 0, queries="true", seed: int = RANDOM_SEED, columns: tuple[str, ...] = STATE) -> DataFrame:
    """``k`` eligible days at random, by a hash of the query, the day and ``seed``."""

    def draw(f: np.ndarray, t: int, c: np.ndarray) -> np.ndarray:
        return scattered((c.astype(np.uint64) + np.uint64((t * 2654435761 + seed) % (1 << 32))) & np.uint64(0xFFFFFFFF)).astype(float)

    return R.retrieve(panel, draw, R.state_features(columns), columns, k, radius, queries)


def garch_variances(theta: np.ndarray, e2: np.ndarray, start: float) -> np.ndarray:
    """Variance of each day and of the day after the last, from squared errors."""
    _, omega, alpha, beta, _ = theta
    v = np.empty(len(e2) + 1)
    v[0] = last = start
    for i, a in enumerate((omega + alpha * e2).tolist()):
        last = a + beta * last
        v[i + 1] = last
    return v


def garch_likelihood(theta: np.ndarray, r: np.ndarray) -> float:
    """Negative log likelihood of a GARCH(1,1) with Student errors, started at the mean square; huge outside the bounds."""
    from math import lgamma, log, pi

    mu, omega, alpha, beta, nu = theta
    if omega <= 0 or alpha < 0 or beta < 0 or alpha + beta >= 0.9999 or not 2.05 < nu < 500:
        return 1e12
    e2 = (r - mu) ** 2
    v = garch_variances(theta, e2, max(float(e2.mean()), 1e-12))[:-1]
    c = lgamma((nu + 1) / 2) - lgamma(nu / 2) - 0.5 * log(pi * (nu - 2))
    return float(-(len(r) * c - 0.5 * np.log(v).sum() - (nu + 1) / 2 * np.log1p(e2 / (v * (nu - 2))).sum()))


def garch_fit(r: np.ndarray, steps: int = 400, near: float = 1e-4) -> np.ndarray:
    """Maximum likelihood by a downhill simplex, until its values lie within ``near``, and once more from where it ended."""
    v = max(r.var(), 1e-12)
    at = np.array([r.mean(), 0.05 * v, 0.08, 0.85, 8.0])
    size = np.array([0.1 * np.sqrt(v), 0.03 * v, 0.05, -0.08, 3.0])
    for scale in (1.0, 0.3):
        simplex = [at, *(at + d * scale for d in np.diag(size))]
        value = [garch_likelihood(p, r) for p in simplex]
        for _ in range(steps):
            order = np.argsort(value)
            simplex, value = [simplex[i] for i in order], [value[i] for i in order]
            if value[-1] - value[0] < near:
                break
            centre, worst = np.mean(simplex[:-1], axis=0), simplex[-1]
            tries = {f: centre + f * (centre - worst) for f in (1.0, 2.0, -0.5)}
            reflected = garch_likelihood(tries[1.0], r)
            f = 2.0 if reflected < value[0] else 1.0 if reflected < value[-2] else -0.5
            new = reflected if f == 1.0 else garch_likelihood(tries[f], r)
            if f == 2.0 and new >= reflected:
                f, new = 1.0, reflected
            if new < value[-1]:
                simplex[-1], value[-1] = tries[f], new
            else:
                simplex = [simplex[0]] + [(p + simplex[0]) / 2 for p in simplex[1:]]
                value = [value[0]] + [garch_likelihood(p, r) for p in simplex[1:]]
        at = simplex[int(np.argmin(value))]
    return at


def garch_ahead(theta: np.ndarray, r: np.ndarray) -> tuple[float, float, float]:
    """Mean, deviation and degrees of freedom of the next return.

    Persistence of .999 or more is scaled below it; the filter starts at the greatest of the errors' variance, 1e-6 and the
    variance the parameters tend to.
    """
    mu, omega, alpha, beta, nu = (float(x) for x in theta)
    alpha, beta = min(max(alpha, 0.0), 0.999), min(max(beta, 0.0), 0.999)
    if alpha + beta >= 0.999:
        alpha, beta = alpha * 0.999 / (alpha + beta + 1e-12), beta * 0.999 / (alpha + beta + 1e-12)
    e = r - mu
    start = max(float(e.var()), 1e-6, omega / max(1 - alpha - beta, 1e-6))
    last = garch_variances(np.array([mu, omega, alpha, beta, nu]), e**2, start)[-1]
    return mu, float(np.sqrt(max(last, 1e-12))), max(nu, 2.1)


def garch_t(panel: DataFrame, risk: Risk = RISK, draws: int = 20_000, least: int = 500, fit: int = 1500, refit: int = 20, seed: int = 20260426, queries="true") -> DataFrame:
    """Risk from simulated Student errors on a GARCH(1,1), fitted once for each ``refit`` positions, at the first that is asked."""
    held = panel.where("ret is not null").groupBy("series").agg(F.sort_array(F.collect_list(F.struct("pos", "ret"))).alias("rows"))
    chunks = panel.where(queries).groupBy("series", F.floor(F.col("pos") / refit).alias("bucket")).agg(F.sort_array(F.collect_list("pos")).alias("asked"))
    work = R.deal(chunks.join(held, "series"), "series", "bucket").select("series", "asked", F.col("rows.pos").alias("pos"), F.col("rows.ret").alias("ret"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                pos, ret = (b.column(c)[i].values.to_numpy() for c in ("pos", "ret"))
                theta, out = None, []
                for t in b.column("asked")[i].as_py():
                    r = ret[pos <= t]
                    if len(r) < least:
                        continue
                    r = r[-fit:] * 100
                    theta = garch_fit(r) if theta is None else theta
                    mu, sigma, nu = garch_ahead(theta, r)
                    loss = np.sort(-(mu + sigma * np.random.default_rng(seed + t).standard_t(nu, draws) * np.sqrt((nu - 2) / nu)) / 100)
                    q = np.quantile(loss, risk.es)
                    out.append({"series": b.column("series")[i].as_py(), "t": t, "n": draws, "var": float(np.quantile(loss, risk.var)), "es": float(loss[loss >= q].mean())})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("series", pa.string()), ("t", pa.int64()), ("n", pa.int64()), ("var", pa.float64()), ("es", pa.float64())]))

    return work.mapInArrow(run, "series string, t long, n long, var double, es double")
