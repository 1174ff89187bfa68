"""Retrieval: for each query position, its nearest earlier positions under a metric.

A position ``s`` is eligible for a query at ``t`` if ``s <= t - radius - 1``.  Series are packed into a row
each and joined to chunks of their queries, so a task holds one series and computes all distances of
its queries as matrix operations; what is shuffled is a series a chunk, never pairs.  Ties go to the
earlier position.  Each query gives one row with its neighbours, nearest first; any smaller k is a
prefix of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK, DRAWS_EACH = 64, 50
SCHEMA = "series string, t long, neighbours array<long>, distances array<double>, losses array<double>"
Metric = Callable[[np.ndarray, int, np.ndarray], np.ndarray]


def eligible(t: int, n: int, radius: int) -> int:
    """How many positions are eligible: those below this one."""
    if radius < 0:
        raise ValueError("the radius must not be negative")
    return max(0, min(t - radius, n))


def windows(x: np.ndarray, size: int) -> np.ndarray:
    """The last ``size`` values at each position; NaN where there are fewer."""
    if len(x) < size:
        return np.full((len(x), 1), np.nan)
    out = np.full((len(x), size), np.nan)
    if len(x) >= size:
        out[size - 1 :] = np.lib.stride_tricks.sliding_window_view(x, size)
    return out


def standardise(w: np.ndarray, tiny: float = 1e-8) -> np.ndarray:
    s = w.std(axis=1, keepdims=True)
    return (w - w.mean(axis=1, keepdims=True)) / np.where(s > tiny, s, 1.0)


def _scaled(f: np.ndarray, t: int, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """History and query by the moments of the query's eligible history alone."""
    s = f[c].std(axis=0)
    s = np.where(s > 1e-8, s, 1.0)
    return (f[c] - f[c].mean(axis=0)) / s, (f[t] - f[c].mean(axis=0)) / s


def euclidean(f: np.ndarray, t: int, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((f[c] - f[t]) ** 2).sum(axis=1))


def scaled_euclidean(f: np.ndarray, t: int, c: np.ndarray) -> np.ndarray:
    h, q = _scaled(f, t, c)
    return np.sqrt(((h - q) ** 2).sum(axis=1))


def mahalanobis(f: np.ndarray, t: int, c: np.ndarray) -> np.ndarray:
    h, q = _scaled(f, t, c)
    centred = h - h.mean(axis=0)
    inverse = np.linalg.pinv(centred.T @ centred / len(h) + 1e-6 * np.eye(h.shape[1]))
    d = h - q
    return np.sqrt(np.maximum((d @ inverse * d).sum(axis=1), 0.0))


def fpca(parts: int) -> Metric:
    """Distances between scores on the leading principal components of the eligible windows."""

    def run(f: np.ndarray, t: int, c: np.ndarray) -> np.ndarray:
        if len(c) < parts:
            raise ValueError("fewer windows than components")
        centred = f[c] - f[c].mean(axis=0)
        _, vectors = np.linalg.eigh(centred.T @ centred / len(c))
        lead = vectors[:, ::-1][:, :parts]
        return np.sqrt(((centred @ lead - (f[t] - f[c].mean(axis=0)) @ lead) ** 2).sum(axis=1))

    return run


def dtw(band: int) -> Metric:
    """Warping distance with ``|i - j| < band``: least sum of squared differences, then its root, all candidates at once."""

    def run(f: np.ndarray, t: int, c: np.ndarray) -> np.ndarray:
        q, h = f[t], f[c].T
        n = len(q)
        before = np.full((n + 1, len(c)), np.inf)
        before[0] = 0.0
        for i in range(n):
            now = np.full((n + 1, len(c)), np.inf)
            for j in range(max(0, i - band + 1), min(n, i + band)):
                now[j + 1] = (q[i] - h[j]) ** 2 + np.minimum(np.minimum(before[j], before[j + 1]), now[j])
            before = now
        return np.sqrt(before[n])

    return run


def top(distances: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` least, in order; of equal ones the first."""
    if len(distances) <= k:
        return np.argsort(distances, kind="stable")
    edge = np.partition(distances, k - 1)[k - 1]
    some = np.flatnonzero(distances <= edge)
    return some[np.argsort(distances[some], kind="stable")][:k]


def deal(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by ``keys`` over as many tasks as the session shuffles to.

    The count is stated, as adaptive execution would otherwise merge rows that are few bytes but much work.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def packed(panel: DataFrame, columns: tuple[str, ...], queries: F.Column | str, asked: DataFrame | None = None, draws: int = 1, each: int = 1) -> DataFrame:
    """A row for each chunk of a series' queries, and for each ``each`` of the ``draws``: ``asked``, ``draw`` and the series' ``pos`` and ``columns`` as arrays."""
    held = panel.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("pos", *columns))).alias("rows"))
    chunks = (panel if asked is None else asked).where(queries).groupBy("series", F.floor(F.col("pos") / CHUNK).alias("chunk")).agg(F.sort_array(F.collect_list("pos")).alias("asked"))
    chunks = chunks.crossJoin(F.broadcast(panel.sparkSession.range(0, draws, each).withColumnRenamed("id", "draw")))  # a row each few draws
    return deal(chunks.join(held, "series"), "series", "chunk", "draw").select("series", "asked", "draw", *(F.col("rows")[c].alias(c) for c in ("pos", *columns)))


def unpacked(b: pa.RecordBatch, i: int, c: str) -> np.ndarray:
    x = b.column(c)[i].values
    return np.array((x.flatten() if pa.types.is_list(x.type) else x).to_numpy(zero_copy_only=False), float)


def retrieve(
    panel: DataFrame, metric: Metric, features: Callable[[dict[str, np.ndarray]], np.ndarray], columns: tuple[str, ...], k: int, radius: int = 0, queries: F.Column | str = "true",
    draws: int | None = None, redraw: Callable[[int, int, np.ndarray], np.ndarray] | None = None, asked: DataFrame | None = None,
) -> DataFrame:
    """``SCHEMA`` rows for positions for which ``queries`` holds.

    ``features`` makes a matrix, a row a position, from a series' ``columns``; rows with a value that isn't
    finite are no candidates, and as queries they give no row, nor does a query without candidates or
    one that ``metric`` refuses (see ``skipped``).  With ``draws``, ``redraw`` makes other distances of a draw's number,
    the query and its distances, which are computed once for ``DRAWS_EACH`` draws; candidates then need a next loss, each
    query gives a row a draw, and ``draw`` comes last.  ``asked`` holds the queries' positions where ``panel`` is dear to compute.
    """
    work = packed(panel, (*columns, "next_loss"), queries, asked, draws or 1, DRAWS_EACH)
    kinds = [("series", pa.string()), ("t", pa.int64()), ("neighbours", pa.list_(pa.int64())), ("distances", pa.list_(pa.float64())), ("losses", pa.list_(pa.float64())), ("draw", pa.int64())]
    schema = pa.schema(kinds if draws else kinds[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                f, loss = features({c: unpacked(b, i, c) for c in columns}), unpacked(b, i, "next_loss")
                first = b.column("draw")[i].as_py()
                good = np.isfinite(f).all(axis=1)
                fit = good & np.isfinite(loss) if draws else good
                out = []
                for t in b.column("asked")[i].as_py():
                    c = np.flatnonzero(fit[: eligible(t, len(f), radius)])
                    if not good[t] or not len(c):
                        continue
                    try:
                        d = metric(f, t, c)
                    except ValueError:
                        continue
                    for draw in range(first, min(first + DRAWS_EACH, draws)) if draws else (0,):
                        mine = redraw(draw, t, d) if draws else d
                        best = top(mine, k)
                        out.append({"series": b.column("series")[i].as_py(), "t": t, "neighbours": c[best], "distances": mine[best], "losses": loss[c[best]], "draw": draw})
                    if len(out) >= 4096:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                yield pa.RecordBatch.from_pylist(out, schema)

    return work.mapInArrow(run, SCHEMA + (", draw long" if draws else ""))


def scenarios(panel: DataFrame, columns: tuple[str, ...], queries: F.Column | str, make: Callable[[dict[str, np.ndarray]], Callable[[int], np.ndarray | None]]) -> DataFrame:
    """``series``, ``t`` and ``losses`` for positions for which ``queries`` holds, from one pass over each series.

    ``make`` gets a series' ``columns`` and gives a function from a position to its losses; positions without losses give no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                of = make({c: unpacked(b, i, c) for c in columns})
                got = [(t, x) for t in b.column("asked")[i].as_py() if (x := of(t)) is not None and len(x)]
                offsets = pa.array(np.concatenate(([0], np.cumsum([len(x) for _, x in got]))), pa.int32())
                losses = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0), *(x for _, x in got)])))
                yield pa.RecordBatch.from_arrays([pa.array([b.column("series")[i].as_py()] * len(got), pa.string()), pa.array([t for t, _ in got], pa.int64()), losses], ["series", "t", "losses"])

    return packed(panel, columns, queries).mapInArrow(run, "series string, t long, losses array<double>")


def window_features(size: int, z: bool = False):
    return lambda s: standardise(windows(s["ret"], size)) if z else windows(s["ret"], size)


def state_features(columns: tuple[str, ...]):
    return lambda s: np.column_stack([s[c] for c in columns])


def skipped(panel: DataFrame, found: DataFrame, queries: F.Column | str = "true") -> DataFrame:
    """Queries that gave no row."""
    return panel.where(queries).select("series", F.col("pos").alias("t"), "date").join(found, ["series", "t"], "left_anti").withColumn("reason", F.lit("no features or no candidates"))
