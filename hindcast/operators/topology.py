"""Topology of windows: delay embedding, Vietoris-Rips persistence in dimensions 0 and 1, and landscapes."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.config import STATE, TOPOLOGY, Topology
from hindcast.functions.scores import finite
from hindcast.operators import controls
from hindcast.operators import retrieval as R


def embed(x: np.ndarray, tau: int, dimension: int) -> np.ndarray:
    n = len(x) - tau * (dimension - 1)
    if n < 3:
        raise ValueError("the window is too short for the embedding")
    return np.stack([x[o * tau : o * tau + n] for o in range(dimension)], axis=1)


def thin(cloud: np.ndarray, most: int) -> np.ndarray:
    """Evenly spaced points, ``most`` at most."""
    return cloud[np.unique(np.rint(np.linspace(0, len(cloud) - 1, min(most, len(cloud)))).astype(int))]


def persistence(cloud: np.ndarray, tiny: float = 1e-12) -> tuple[np.ndarray, np.ndarray]:
    """Finite intervals of dimension 0 and 1.

    Edges in order of length join components (deaths in dimension 0); each other one is born as a cycle.
    Its death is found by cohomology: from the youngest edge on, an edge's column holds the triangles on it,
    a triangle being known by its longest edge and the corner opposite, and the least one is its pivot.  Where an
    edge is the longest of its pivot, which one look at all columns tells, the cycle dies at birth and nothing is
    reduced; of the rest, columns with a pivot that an earlier one has are added to it.  Within the distance at
    which some point sees all others every cycle is dead, so nothing longer is looked at.
    """
    n = len(cloud)
    if n < 2:
        return np.zeros((0, 2)), np.zeros((0, 2))
    d = np.sqrt(((cloud[:, None] - cloud[None]) ** 2).sum(axis=2))
    i, j = np.triu_indices(n, 1)
    order = np.argsort(d[i, j], kind="stable")
    i, j = i[order], j[order]
    length, far = d[i, j], d.max(axis=1).min()
    rank = np.full((n, n), -1, np.int32 if len(i) < 1 << 30 else np.int64)
    rank[i, j] = rank[j, i] = np.arange(len(i))
    joins = spanning(rank)
    h0 = np.array([(0.0, length[e]) for e in joins if length[e] > tiny]).reshape(-1, 2)
    edges = int(np.searchsorted(length, far, "right"))
    if n < 3 or edges < 3:
        return h0, np.zeros((0, 2))

    apex = np.full(len(i), -1)
    for a in range(n - 1):  # of each edge the first corner whose other two edges are shorter
        mine = rank[a, a + 1 :]
        shorter = np.maximum(rank[a], rank[a + 1 :]) < mine[:, None]
        v = shorter.argmax(axis=1)
        apex[mine] = np.where(shorter[np.arange(len(v)), v], v, -1)
    apex = apex[:edges]
    todo = apex < 0
    todo[[e for e in joins if e < edges]] = False
    apex, ends = apex.tolist(), list(zip(i[:edges].tolist(), j[:edges].tolist()))
    corners = np.arange(n)

    def column(e: int) -> list[int]:
        """Triangles on an edge, by their longest edge and the corner opposite."""
        a, b = ends[e]
        ra, rb = rank[a], rank[b]
        most = np.maximum(np.maximum(ra, rb), e)
        corner = np.where(most == e, corners, np.where(most == ra, b, a))
        in_reach = most < edges
        in_reach[a] = in_reach[b] = False
        return (most * np.int64(n) + corner)[in_reach].tolist()

    owner: dict[int, list[int]] = {}
    bars = []
    for e in np.flatnonzero(todo)[::-1].tolist():
        heap, made = column(e), [e]
        heapq.heapify(heap)
        while heap:
            low = heapq.heappop(heap)
            if heap and heap[0] == low:  # twice is not at all
                heapq.heappop(heap)
                continue
            by, v = divmod(low, n)
            other = [by] if apex[by] == v else owner.get(low)
            if other is None:
                owner[low] = made
                if length[by] > length[e] + tiny:
                    bars.append((length[e], length[by]))
                break
            heapq.heappush(heap, low)
            made += other
            for o in other:
                for x in column(o):
                    heapq.heappush(heap, x)
    return h0, np.array(bars).reshape(-1, 2)


def spanning(rank: np.ndarray) -> list[int]:
    """The ranks of the edges that join components when edges come in order of rank, by growing a tree."""
    near, out = rank[0].copy(), []
    most = np.iinfo(rank.dtype).max
    left = np.ones(len(rank), bool)
    left[0] = False
    for _ in range(len(rank) - 1):
        v = int(np.where(left, near, most).argmin())
        out.append(int(near[v]))
        left[v] = False
        np.minimum(near, rank[v], out=near)
    return sorted(out)


def layers(bars: np.ndarray, grid: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` greatest tents at each point of the grid, greatest first."""
    tents = np.zeros((n, len(grid)))
    if len(bars):
        up = np.maximum(0, np.minimum(grid[None] - bars[:, :1], bars[:, 1:] - grid[None]))
        up = -np.sort(-up, axis=0)[:n]
        tents[: len(up)] = up
    return tents


def landscape(bars: np.ndarray, grid: np.ndarray, weights: tuple[float, ...]) -> np.ndarray:
    w = np.array(weights) / np.sum(weights)
    return w @ layers(bars, grid, len(w))


MODES = ("h1_weighted", "h0_weighted", "h0_h1_weighted", "h1_first", "h1_first_area", "h1_layers")


def window_feature(window: np.ndarray, t: Topology = TOPOLOGY, mode: str = "h1_weighted") -> np.ndarray:
    """Landscape of one window, a row a day; of several columns each is standardised, and a point holds all their delays."""
    z = R.standardise(window.reshape(len(window), -1).T)
    cloud = np.concatenate([embed(c, t.tau, t.dimension) for c in z], axis=1)
    h0, h1 = persistence(thin(cloud, t.points) if t.points else cloud)
    grid = np.linspace(0, t.upper, t.steps)
    if mode == "h1_weighted":
        return landscape(h1, grid, t.weights)
    if mode == "h0_weighted":
        return landscape(h0, grid, t.weights)
    if mode == "h0_h1_weighted":
        return np.concatenate((landscape(h0, grid, t.weights), landscape(h1, grid, t.weights)))
    if mode == "h1_first":
        return layers(h1, grid, 1)[0]
    if mode == "h1_first_area":
        first = layers(h1, grid, 1)[0]
        return np.append(first, ((first[1:] + first[:-1]) / 2 * np.diff(grid)).sum())
    if mode == "h1_layers":
        return layers(h1, grid, len(t.weights)).ravel()
    raise ValueError(f"unknown mode: {mode}")


def landscapes(panel: DataFrame, size: int, t: Topology = TOPOLOGY, mode: str = "h1_weighted", columns: tuple[str, ...] = ("ret",)) -> DataFrame:
    """A feature array for each position with a whole window of ``columns``; windows are dealt over the cluster."""
    from pyspark.sql import Window

    by = Window.partitionBy("series").orderBy("pos").rowsBetween(-(size - 1), 0)
    w = panel.select("series", "pos", F.collect_list(F.when(sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0)) == 0, F.array(*columns))).over(by).alias("window")).where(F.size("window") == size)
    w = R.deal(w, "series", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("window").flatten().flatten().to_numpy().reshape(-1, size, len(columns))
            yield pa.RecordBatch.from_arrays([b.column("series"), b.column("pos"), pa.array([window_feature(row, t, mode).tolist() for row in x], pa.list_(pa.float64()))], ["series", "pos", "feature"])

    return w.mapInArrow(run, "series string, pos long, feature array<double>")


def width(t: Topology = TOPOLOGY, mode: str = "h1_weighted") -> int:
    return {"h0_h1_weighted": 2, "h1_layers": len(t.weights)}.get(mode, 1) * t.steps + (mode == "h1_first_area")


def blended(states: int, alpha: float, radius: int) -> R.Metric:
    """``alpha`` of the distance of states, the first columns, and the rest of that of features.

    States are scaled by all eligible days with a state, features by those that have a feature too.
    """

    def run(f: np.ndarray, t: int, c: np.ndarray) -> np.ndarray:
        total = np.zeros(len(c))
        if alpha < 1:
            total += (1 - alpha) * R.scaled_euclidean(f[:, states:], t, c)
        if alpha > 0:
            known = np.flatnonzero(np.isfinite(f[: R.eligible(t, len(f), radius), :states]).all(axis=1))
            total += alpha * R.scaled_euclidean(f[:, :states], t, known)[np.searchsorted(known, c)]
        return total

    return run


def placebo(features, seed: int):
    """Features of the days that have them, dealt to those days at random: a placebo that looks ahead, for contrast only."""

    def run(s: dict[str, np.ndarray]) -> np.ndarray:
        f = features(s).copy()
        at = np.flatnonzero(np.isfinite(f).all(axis=1))
        f[at] = f[np.random.default_rng(seed).permutation(at)]
        return f

    return run


def topology_knn(panel: DataFrame, size: int, k: int, radius: int = 0, queries="true", t: Topology = TOPOLOGY, mode: str = "h1_weighted", alpha: float = 0.0, state: tuple[str, ...] = STATE, columns: tuple[str, ...] = ("ret",), placebo_seed: int | None = None, control_seed: int | None = None, draws: int | None = None, features: Callable[[], DataFrame] | None = None) -> DataFrame:
    """Retrieval by landscapes, each coordinate scaled by the query's eligible history; ``features`` gives those of ``landscapes`` where they are at hand.

    Days need all of ``state``, whatever ``alpha``.  With ``placebo_seed`` features are dealt anew over all days;
    with ``control_seed`` and ``draws`` over each query's eligible ones, once a draw.
    """
    f, n = landscapes(panel, size, t, mode, columns) if features is None else features(), width(t, mode)
    wide = panel.join(f, ["series", "pos"], "left").withColumn("feature", F.coalesce("feature", F.array_repeat(F.lit(float("nan")), n)))
    shape = lambda s: s["feature"].reshape(-1, n)
    shape = shape if placebo_seed is None else placebo(shape, placebo_seed)
    metric = blended(len(state), alpha, radius)
    return R.retrieve(wide, metric, lambda s: np.column_stack([*(s[c] for c in state), shape(s)]), (*state, "feature"), k, radius, queries, draws, controls.dealt(control_seed or 0), asked=panel)


def mutual_information(panel: DataFrame, taus: range = range(1, 6), bins: int = 16) -> DataFrame:
    """Mutual information of a return and the one ``tau`` later, on a grid of equal bins over each one's range."""
    from pyspark.sql import Window

    by = Window.partitionBy("series").orderBy("pos")
    out = None
    for tau in taus:
        p = panel.where("ret is not null").select("series", F.col("ret").alias("x"), F.lead("ret", tau).over(by).alias("y")).where("y is not null")
        whole = Window.partitionBy("series")
        cell = lambda c: F.least(F.floor((F.col(c) - F.min(c).over(whole)) / (F.max(c).over(whole) - F.min(c).over(whole)) * bins), F.lit(bins - 1))
        n = p.select("series", cell("x").alias("bx"), cell("y").alias("by")).groupBy("series", "bx", "by").agg(F.count("*").cast("double").alias("n"))
        share = lambda *keys: F.sum("n").over(Window.partitionBy("series", *keys))
        n = n.withColumns({"all": share(), "nx": share("bx"), "ny": share("by")})
        mi = n.groupBy("series").agg(F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny")))).alias("mi")).withColumn("tau", F.lit(tau).cast("long"))
        out = mi if out is None else out.unionByName(mi)
    return out.select("series", "tau", "mi")


def first_minimum(mi: DataFrame) -> DataFrame:
    """The first lag that is no more than either of its neighbours, or else the least of all."""
    from pyspark.sql import Window

    by = Window.partitionBy("series").orderBy("tau")
    dips = mi.withColumn("dip", (F.col("mi") <= F.lag("mi").over(by)) & (F.col("mi") <= F.lead("mi").over(by)))
    return dips.groupBy("series").agg(F.coalesce(F.min(F.when(F.col("dip"), F.col("tau"))), F.min_by("tau", F.struct("mi", "tau"))).alias("tau"))


def false_neighbours(x: np.ndarray, tau: int, dimension: int, ratio: float = 10.0, absolute: float = 2.0) -> float:
    """The share of points whose nearest neighbour moves far away when one coordinate is added."""
    n = len(x) - tau * dimension
    if n < 10:
        return float("inf")
    cloud, ahead = embed(x, tau, dimension)[:n], x[dimension * tau : dimension * tau + n]
    near, least = np.empty(n, int), np.empty(n)
    for lo in range(0, n, 256):  # in blocks, as all pairs at once would not fit
        d = ((cloud[lo : lo + 256, None] - cloud[None]) ** 2).sum(axis=2)
        d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
        near[lo : lo + 256] = d.argmin(axis=1)
        least[lo : lo + 256] = np.sqrt(d.min(axis=1))
    jump = np.abs(ahead - ahead[near])
    return float(((jump / np.maximum(least, 1e-8) > ratio) | (np.sqrt(least**2 + jump**2) / (x.std() + 1e-8) > absolute)).mean())


def choose_dimension(x: np.ndarray, tau: int, dimensions: range = range(2, 6), accept: float = 0.05) -> int:
    rates = {m: false_neighbours(x, tau, m) for m in dimensions}
    return next((m for m in dimensions if rates[m] <= accept), min(rates, key=lambda m: (rates[m], m)))


def embedding_choice(panel: DataFrame, train: str = "true", taus: range = range(1, 6), bins: int = 16, dimensions: range = range(2, 6), least: int = 200, columns: tuple[str, ...] = ("ret",)) -> DataFrame:
    """Delay and dimension of each series, from the returns for which ``train`` holds; series with fewer than ``least`` give no row.

    Of several ``columns`` the mean of those a day has is looked at.
    """
    from pyspark.sql import Window

    known = F.filter(F.array(*columns), finite)
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, v: s + v) / F.size(known))
    p = panel.where(train).select("series", "pos", mean.alias("ret")).where("ret is not null").withColumn("n", F.count("*").over(Window.partitionBy("series"))).where(F.col("n") >= least)
    tau = first_minimum(mutual_information(p, taus, bins))
    packed = p.groupBy("series").agg(F.sort_array(F.collect_list(F.struct("pos", "ret"))).alias("rows")).select("series", F.col("rows.ret").alias("x")).join(tau, "series")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [choose_dimension(R.standardise(x.values.to_numpy()[None])[0], lag.as_py(), dimensions) for x, lag in zip(b.column("x"), b.column("tau"))]
            yield pa.RecordBatch.from_arrays([b.column("series"), b.column("tau"), pa.array(found, pa.int64())], ["series", "tau", "dimension"])

    return packed.select("series", "tau", "x").mapInArrow(run, "series string, tau long, dimension long")


def shuffle_test(panel: DataFrame, size: int, windows: int, draws: int, seed: int = 1, t: Topology = TOPOLOGY) -> DataFrame:
    """How far landscapes of evenly spaced windows lie from those of the same days in random order.

    A row a window: mean distance of the window to its shuffles and of the shuffles to each other, their difference,
    and the share of shuffles that lie as central as the window or more.
    """
    from pyspark.sql import Window

    by, whole = Window.partitionBy("series").orderBy("pos"), Window.partitionBy("series")
    w = panel.select("series", "pos", F.collect_list("ret").over(by.rowsBetween(-(size - 1), 0)).alias("window")).where(F.size("window") == size)
    w = w.withColumn("i", F.row_number().over(by) - 1).withColumn("n", F.count("*").over(whole))
    spaced = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)), lambda j: F.rint(j * (F.col("n") - 1) / max(windows - 1, 1)))
    w = R.deal(w.where(F.array_contains(spaced, F.col("i").cast("double"))).select("series", "pos", "window"), "series", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for series, pos, x in zip(b.column("series").to_pylist(), b.column("pos").to_pylist(), b.column("window")):
                x, rng = x.values.to_numpy(), np.random.default_rng((seed, pos))
                f = np.array([window_feature(x, t), *(window_feature(rng.permutation(x), t) for _ in range(draws))])
                d = np.sqrt(np.maximum(((f[:, None] - f[None]) ** 2).sum(axis=2), 0))
                mean = d.sum(axis=1) / draws
                apart = float(d[1:, 1:].sum() / (draws * (draws - 1))) if draws > 1 else None
                out.append({"series": series, "pos": pos, "to_shuffles": float(mean[0]), "among_shuffles": apart, "difference": None if apart is None else float(mean[0]) - apart, "central_share": float((mean[1:] <= mean[0]).mean())})
            kinds = [("series", pa.string()), ("pos", pa.int64()), *((c, pa.float64()) for c in ("to_shuffles", "among_shuffles", "difference", "central_share"))]
            yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    return w.mapInArrow(run, "series string, pos long, to_shuffles double, among_shuffles double, difference double, central_share double")
