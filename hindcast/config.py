"""Settings of the forecasting engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Risk:
    var: float = 0.99
    es: float = 0.975


@dataclass(frozen=True)
class Splits:
    """Forecast dates: before ``validation`` is warm-up, from ``test`` on is test."""

    validation: str = "1999-01-01"
    test: str = "2000-01-01"


@dataclass(frozen=True)
class Topology:
    tau: int = 3
    dimension: int = 5
    points: int = 0  # of each cloud, evenly spaced; 0: all of them
    steps: int = 200
    upper: float = 3.0
    weights: tuple[float, ...] = (1.0, 0.5, 0.25)


RISK, SPLITS, TOPOLOGY = Risk(), Splits(), Topology()
WEIGHTS = (0.6, 0.4)
STATE = ("rv20", "ret20", "level", "delta5", "ratio")
