"""Approximate nearest neighbours by score-aware (anisotropic) quantisation, four-bit scans and exact reranking.

The nearest by Euclidean distance have the largest inner product of (q, s) with (x, -|x|^2 / 2s), so
vectors are searched as such pairs.  Coordinates go in twos to codebooks of 16 centres.  Codebooks
and codes minimise ``eta * |parallel residual|^2 + |orthogonal residual|^2``: only the residual along
a vector moves the large inner products.  Codebooks are fitted on a sample of ``SAMPLE`` vectors at
most; every vector is coded and scanned.

Packed blocks of queries meet packed blocks of vectors; in each such pair a table of 8-bit partial
scores a query and code gives the ``RERANK`` best, whose distances are then computed in double
precision from the original vectors.  Each other vector whose score, with the error of its code and of
the table, doesn't rule it out against the k-th of those is looked at too, first by a product.  Each
pair gives the nearest ``k`` of a query, and the nearest of those are the result, which is exact.

Vectors that are null, zero, of another length than the most common one, or that hold null or
non-finite components take no part, nor do rows with a null id.  Rows with equal ids are candidates
each but one query, and none of them is a candidate for it.  Other columns are left out.  An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.llm import blocks as B

K, SAMPLE, RERANK, THRESHOLD, ROUNDS, VECTORS, QUERIES_EACH = 10, 20_000, 96, 0.2, 3, 16_384, 1_024
RESULT = "query_id long, vec_id long, score double"


class Codebooks:
    def __init__(self, sample: np.ndarray, seed: int = 0):
        x = sample.astype(np.float64)
        self.dim, self.scale = x.shape[1], max(float(np.sqrt((x**2).sum(1).mean())), 1e-12) / 2
        t2 = THRESHOLD**2
        self.eta = max(1.0, t2 / (1 - t2) * max(self.dim - 1, 1))
        a = self.augment(x)
        rng = np.random.default_rng(seed)
        self.centres = np.stack([self._means(a[:, 2 * m : 2 * m + 2], rng) for m in range(a.shape[1] // 2)])  # (parts, 16, 2)
        fit = a[rng.permutation(len(a))[:4096]]
        for _ in range(ROUNDS):
            self._refit(fit, self.codes(fit))

    def augment(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), (self.dim + 2) // 2 * 2))
        out[:, : self.dim], out[:, self.dim] = x, -(x**2).sum(1) / (2 * self.scale)
        return out

    @staticmethod
    def _means(x: np.ndarray, rng) -> np.ndarray:
        c = x[rng.integers(0, len(x), 16)].copy()
        for _ in range(10):
            near = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
            n = np.bincount(near, minlength=16)
            for j in range(x.shape[1]):
                c[n > 0, j] = np.bincount(near, x[:, j], 16)[n > 0] / n[n > 0]
        return c

    def _refit(self, a: np.ndarray, codes: np.ndarray) -> None:
        parts = len(self.centres)
        unit = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
        z = np.zeros((len(a), parts * 32))
        rows, col = np.arange(len(a))[:, None], (np.arange(parts) * 32)[None, :] + codes * 2
        z[rows, col], z[rows, col + 1] = unit[:, 0::2], unit[:, 1::2]
        n, rhs = np.zeros(parts * 32), np.zeros(parts * 32)
        for j in (0, 1):
            np.add.at(n, col + j, 1.0)
            np.add.at(rhs, col + j, a[:, j::2])
        g = (self.eta - 1) * (z.T @ z)
        g[np.diag_indices_from(g)] += n + 1e-6
        rhs += (self.eta - 1) * (z.T @ (a * unit).sum(1)) + 1e-6 * self.centres.reshape(-1)
        self.centres = np.linalg.solve(g, rhs).reshape(parts, 16, 2)

    def codes(self, a: np.ndarray, passes: int = 2) -> np.ndarray:
        unit = a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
        parts = len(self.centres)
        out = np.empty((len(a), parts), np.uint8)
        along = np.empty((len(a), parts))
        for m in range(parts):
            r = a[:, None, 2 * m : 2 * m + 2] - self.centres[m][None]
            out[:, m] = (r**2).sum(2).argmin(1)
            along[:, m] = (r[np.arange(len(a)), out[:, m]] * unit[:, 2 * m : 2 * m + 2]).sum(1)
        total = along.sum(1)
        for _ in range(passes):
            for m in range(parts):
                r = a[:, None, 2 * m : 2 * m + 2] - self.centres[m][None]
                p = (r * unit[:, None, 2 * m : 2 * m + 2]).sum(2)
                best = ((r**2).sum(2) + (self.eta - 1) * ((total - along[:, m])[:, None] + p) ** 2).argmin(1)
                total += p[np.arange(len(a)), best] - along[:, m]
                out[:, m], along[:, m] = best, p[np.arange(len(a)), best]
        return out

    def misses(self, a: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """How far each vector is from what its codes stand for."""
        return np.linalg.norm(a - self.centres[np.arange(len(self.centres)), codes].reshape(len(a), -1), axis=1)

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """8-bit partial scores of each query, part and centre (larger is nearer), the score of zeros, the step and the query's length."""
        full = np.zeros((len(q), (self.dim + 2) // 2 * 2))
        full[:, : self.dim], full[:, self.dim] = q, self.scale
        t = np.einsum("qmd,mcd->qmc", full.reshape(len(q), -1, 2), self.centres)
        least = t.min(2, keepdims=True)
        t -= least
        step = np.maximum(t.max((1, 2)), 1e-12) / 255
        return np.rint(t / step[:, None, None]).astype(np.uint8), least.sum((1, 2)), step, np.linalg.norm(full, axis=1)


def _packed(dim: int, each: int, books: Codebooks | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, each):
                part = b.slice(i, each)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                x = np.ascontiguousarray(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], x[order]
                more = [books.codes(books.augment(x.astype(np.float64))).ravel()] if books else []
                yield pa.RecordBatch.from_arrays([pa.array([B.pack(ids, x.ravel(), *more)], pa.binary())], ["payload"])

    return run


def scan(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, q_ids: np.ndarray, q: np.ndarray, books: Codebooks, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, vector and distance of the ``k`` nearest found for each query; ``ids`` are sorted."""
    out: list[tuple] = []
    wide = x.astype(np.float64)
    norm, miss = (wide**2).sum(1), books.misses(books.augment(wide), codes)
    for lo in range(0, len(q), 32):
        mine = slice(lo, lo + 32)
        table, zero, step, length = books.tables(q[mine].astype(np.float64))
        scores = np.zeros((len(table), len(ids)), np.int32)
        for m in range(codes.shape[1]):
            scores += table[:, m, :][:, codes[:, m]]
        for i, own in enumerate(q_ids[mine]):
            s, at = np.where(ids == own, -1, scores[i]), q[lo + i].astype(np.float64)
            exact = lambda pick: np.sqrt(((wide[pick] - at) ** 2).sum(1))  # noqa: B023, E731
            if len(s) > rerank:  # of equal scores, those of smaller ids
                least = np.partition(s, len(s) - rerank)[len(s) - rerank]
                above, level = np.flatnonzero(s > least), np.flatnonzero(s == least)
                pick = np.concatenate((above, level[: rerank - len(above)]))
            else:
                pick = np.arange(len(s))
            pick = pick[s[pick] >= 0]
            d = exact(pick)
            if len(s) > rerank:
                square = at @ at
                far = np.partition(d, k - 1)[k - 1] ** 2 if len(d) >= k else np.inf
                far += 1e-12 * (len(at) + 16) * (square + norm.max())  # more than rounding
                # the nearest that the errors of the table and of the code allow
                allowed = square - 2 * (zero[i] + step[i] * (s + codes.shape[1] / 2) + length[i] * miss)
                left = np.flatnonzero((allowed <= far) & (s >= 0))
                left = [j[square - 2 * (wide[j] @ at) + norm[j] <= far] for j in (left[n : n + 4096] for n in range(0, len(left), 4096))]
                pick = np.union1d(pick, np.concatenate(left or [pick]))
                d = exact(pick)
            best = np.lexsort((ids[pick], d))[:k]
            out.append((np.full(len(best), own), ids[pick][best], d[best]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _search(dim: int, books: Codebooks, k: int, rerank: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for mine, queries in zip(b.column("payload"), b.column("queries")):
                ids, x, codes = B.unpack(mine.as_py())
                q_ids, q = B.unpack(queries.as_py())
                found = scan(ids, x.reshape(-1, dim), codes.reshape(len(ids), -1), q_ids, q.reshape(-1, dim), books, k, rerank)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, sample: int = SAMPLE, rerank: int = RERANK) -> DataFrame:
    """The ``k`` nearest found of each row for which ``queries`` holds: query_id, rank, vec_id and score."""
    spark = vectors.sparkSession
    shared, e = B.Shared(spark, "nearest"), F.col(f"`{embedding}`")
    fine = F.forall(e, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), e.alias("embedding"), queries.alias("ask")).where(F.col("vec_id").isNotNull() & e.isNotNull()).where(fine.alias("fine"))
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not common:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = common[0].n
    rows = rows.where(F.size("embedding") == dim)
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").collect()  # bounded by ``sample``
    books = Codebooks(np.array([r.embedding for r in picked], np.float64))
    coded = shared.write(rows.select("vec_id", "embedding").mapInArrow(_packed(dim, VECTORS, books), "payload binary"), "vectors")
    asking = rows.where("ask").dropDuplicates(["vec_id"]).select("vec_id", "embedding")
    asking = shared.write(asking.coalesce(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(_packed(dim, QUERIES_EACH, None), "payload binary"), "queries")
    pairs = coded.crossJoin(asking.select(F.col("payload").alias("queries")))  # blocks against blocks
    found = pairs.mapInArrow(_search(dim, books, k, rerank), RESULT)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(B.read(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 100 == 0)


QUERIES = {"op6_nearest": op6_nearest}
SQL: dict[str, str] = {}
