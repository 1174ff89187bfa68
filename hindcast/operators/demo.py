"""Nearest windows of a labelled series by two measures, and the query that shows best how they differ."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hindcast.operators import retrieval as R
from hindcast.operators import topology as T
from hindcast.sources.synthetic import region

SCHEMA = "query_start long, dtw_start long, topology_start long, dtw_distance double, topology_distance double, dtw_percentile double, topology_percentile double"


def standardise_rows(history: np.ndarray, current: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both by the history's moments, a deviation of 0 being taken as 1."""
    s = history.std(axis=0)
    s = np.where(s == 0, 1.0, s)
    return (history - history.mean(axis=0)) / s, (current - history.mean(axis=0)) / s


def percentile_of_least(d: np.ndarray) -> float:
    return float((d <= d.min()).mean() * 100)


def retrieval(series: DataFrame, size: int = 60, first: int = 880, last: int = 939, trained: int = 839, radius: int = 60, band: int = 10, cutoff: float = 10.0, name: Column | None = None) -> DataFrame:
    """A row a query window (by its first position): its nearest training windows more than ``radius`` away on either side by
    warping and by standardised landscapes, how they rank, their regions, and whether it is the one to show.

    Shown is, in this order, one whose neighbours lie in two regions and rank within ``cutoff`` percent, one whose
    neighbours lie in two regions, or any; the least sum of percentiles first, then the earliest.
    """
    start = F.col("pos") - (size - 1)
    starts = series.where((start >= 0) & (F.col("pos") <= trained)).select("pos").unionByName(series.where(start.between(first, last)).select("pos")).distinct()
    w = Window.partitionBy("series").orderBy("pos").rowsBetween(-(size - 1), 0)
    rows = series.withColumn("window", F.collect_list("ret").over(w)).join(starts, "pos").select("series", "pos", "window")
    rows = rows.join(T.landscapes(series, size), ["series", "pos"])
    held = rows.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("pos", "window", "feature"))).alias("rows"))
    queries = rows.where(start.between(first, last)).select("series", F.col("pos").alias("q"))
    work = R.deal(queries.join(held, "series"), "q").select("q", *(F.col(f"rows.{c}").alias(c) for c in ("pos", "window", "feature")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                q, pos = b.column("q")[i].as_py(), R.unpacked(b, i, "pos").astype(int)
                x, f = R.unpacked(b, i, "window").reshape(len(pos), -1), R.unpacked(b, i, "feature").reshape(len(pos), -1)
                at, c = int(np.flatnonzero(pos == q)[0]), np.flatnonzero((pos <= trained) & (np.abs(pos - q) > radius))
                if not len(c):
                    continue
                history, current = standardise_rows(f[c], f[at])
                d, e = R.dtw(band)(x, at, c), np.sqrt(((history - current) ** 2).sum(axis=1))
                near = [int(pos[c[k.argmin()]]) - size + 1 for k in (d, e)]
                out.append((q - size + 1, *near, float(d.min()), float(e.min()), percentile_of_least(d), percentile_of_least(e)))
            kinds = [pa.int64()] * 3 + [pa.float64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], [c.split()[0] for c in SCHEMA.split(", ")])

    found = work.mapInArrow(run, SCHEMA).withColumns({f"{m}_region": region(F.col(f"{m}_start")) for m in ("dtw", "topology")})
    differ = F.col("dtw_region") != F.col("topology_region")
    near = (F.col("dtw_percentile") <= cutoff) & (F.col("topology_percentile") <= cutoff)
    tier = F.when(differ & near, 0).when(differ, 1).otherwise(2)
    order = Window.orderBy(tier, F.col("dtw_percentile") + F.col("topology_percentile"), "query_start")  # a row a query of one series
    return found.withColumn("shown", F.row_number().over(order) == 1)
