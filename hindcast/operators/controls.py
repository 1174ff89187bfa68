"""Null controls that deal features at random, and sign-flip tests."""

from __future__ import annotations

import numpy as np

from hindcast.operators.retrieval import Metric


def permuted(base: Metric, seed: int, draw: int) -> Metric:
    """``base`` with the features of a query's eligible days dealt to those days at random.

    The scale of the history doesn't depend on its order, so the distances are dealt.  Neighbours
    and losses are those of the day a feature is dealt to.  Equal distances rank at random: by
    position the oldest days would win whenever features are equal.
    """

    return lambda f, t, c: dealt(seed)(draw, t, base(f, t, c))


def dealt(seed: int):
    """Distances of a query dealt to its candidates at random, as their ranks, ties at random; by draw, query and distances."""

    def run(draw: int, t: int, d: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng((seed, draw, t))
        d = d[rng.permutation(len(d))]
        rank = np.empty(len(d))
        rank[np.lexsort((rng.random(len(d)), d))] = np.arange(len(d))
        return rank

    return run


def binomial_tail(k: int, n: int, p: float = 0.5) -> float:
    """Probability of ``k`` or more of ``n``, by the exact sum."""
    from math import comb

    return float(min(1.0, sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(max(k, 0), n + 1))))


def sign_flip(x: np.ndarray, draws: int = 10_000, seed: int = 1, batch: int = 1 << 22) -> tuple[float, float, float]:
    """p-values of a mean below zero, above it and either, against random signs; NaN without values."""
    if not len(x):
        return float("nan"), float("nan"), float("nan")
    rng, seen, low, high, step = np.random.default_rng(seed), x.mean(), 0, 0, max(1, batch // len(x))
    for at in range(0, draws, step):
        mean = rng.choice((-1.0, 1.0), (min(step, draws - at), len(x))) @ x / len(x)
        low, high = low + int((mean <= seen).sum()), high + int((mean >= seen).sum())
    lower, upper = (1 + low) / (draws + 1), (1 + high) / (draws + 1)
    return lower, upper, min(1.0, 2 * min(lower, upper))
