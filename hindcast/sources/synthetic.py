"""Made-up series with labelled regions, from formulas of the position alone, so that every engine makes the same values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# First and last position, period and phase of each region's wave; a wave and its third harmonic make loops.
REGIONS = {"calm": (0, 199, 40.0, 0.0), "loop_a": (200, 379, 20.0, 0.5), "drift": (380, 559, 90.0, 1.0), "loop_b": (560, 719, 20.0, 2.0), "rough": (720, 839, 7.0, 0.0), "query": (840, 1099, 20.0, 0.6)}


def region(pos: Column) -> Column:
    """The name of the region that holds a position, or ``unknown``."""
    out = F.lit("unknown")
    for name, (low, high, _, _) in REGIONS.items():
        out = F.when(pos.between(low, high), name).otherwise(out)
    return out


def wave(pos: Column, period: float, phase: float) -> Column:
    a = pos * (2 * 3.141592653589793 / period) + phase
    return 0.01 * F.sin(a) + 0.004 * F.sin(3 * a)


def regions(spark: SparkSession) -> DataFrame:
    """``series``, ``pos``, ``region`` and ``ret``: the region's wave and small, irregular ripples."""
    pos = F.col("id").cast("double")
    ret = F.lit(0.0)
    for _, (low, high, period, phase) in REGIONS.items():
        ret = F.when(pos.between(low, high), wave(pos, period, phase)).otherwise(ret)
    ripple = 0.002 * F.sin(pos * pos * 0.7071) * F.cos(pos * 1.3)
    rows = spark.range(1 + max(high for _, high, _, _ in REGIONS.values()))
    return rows.select(F.lit("made").alias("series"), F.col("id").alias("pos"), region(F.col("id")).alias("region"), (ret + ripple).alias("ret"))


def regions_sql() -> str:
    wave_ = lambda period, phase: f"0.01::DOUBLE * sin(pos * {2 * 3.141592653589793 / period!r}::DOUBLE + {phase}::DOUBLE) + 0.004::DOUBLE * sin(3 * (pos * {2 * 3.141592653589793 / period!r}::DOUBLE + {phase}::DOUBLE))"
    name = " ".join(f"WHEN pos BETWEEN {low} AND {high} THEN '{n}'" for n, (low, high, _, _) in REGIONS.items())
    ret = " ".join(f"WHEN pos BETWEEN {low} AND {high} THEN {wave_(period, phase)}" for low, high, period, phase in REGIONS.values())
    return f"SELECT 'made' AS series, pos, CASE {name} END AS region, round((CASE {ret} END) + 0.002::DOUBLE * sin(pos::DOUBLE * pos * 0.7071::DOUBLE) * cos(pos * 1.3::DOUBLE), 10) + 0.0 AS ret FROM (SELECT unnest(range(1100))::BIGINT AS pos)"


def stylised_window(spark: SparkSession, size: int = 60) -> DataFrame:
    """One window, ``pos`` and ``value``: two waves of related periods under an envelope, with a bump."""
    t = F.col("id") / (size - 1)
    bump = 0.003 * F.exp(-((t - 0.3) * 30) * ((t - 0.3) * 30))
    return spark.range(size).select(F.col("id").alias("pos"), ((1 + 0.2 * F.sin(6.283185307179586 * t)) * wave(t * size, size / 3, 0.2) + bump).alias("value"))
