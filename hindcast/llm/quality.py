"""Quality and toxicity: document evidence combined with the posteriors of the document's site.

Evidence: a logistic regression on the presence of words and of runs of punctuation, over the
``FEATURES`` that tell the classes of a sample of ``SAMPLE`` labelled documents at most apart; its
log odds less those of the sample's own rate.  Prior: rates of all labels by grouped aggregation, a
host's shrunk toward the global rate, a path's (here a language within a host) toward its host's,

    rate = (positive + strength * parent's rate) / (labelled + strength)

where a level's strength is the moment estimate from the spread of its rates beyond binomial noise.
A document's probability has the log odds of its path's rate (or its host's, or the global one where
nothing is labelled) plus its evidence.

A labelled document's own label is part of its site's rates and may be in the sample; labels for which
``held`` is true are in neither, so results on them tell how good the rest is.

A null or empty text has no features; a text of any length is read whole, within one task.  A null host or path is a site named ``none``.  Labels that are
null are no labels; documents with several rows of labels count with each; a null ``doc_id`` has none.
Of rows with equal ids the least text is in the sample.  Repeated rows each give a row; other columns are left out.  Without labels of both classes the
evidence is 0 and the rate that of the labels there are, or 1/2.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm import blocks as B

SAMPLE, FEATURES, LEAST_DOCS, RIDGE, QUALITY, TOXIC = 8_000, 400, 5, 1.0, 0.5, 0.5
TARGETS = ("quality", "toxic")
_WORD = np.full(256, 32, np.uint8)
_WORD[97:123] = np.arange(97, 123)
_WORD[65:91] = np.arange(97, 123)
_WORD[128:] = np.arange(128, 256)
_MARK = np.arange(256, dtype=np.uint8)
_MARK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 32


def features(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of each distinct feature of each text."""
    docs, keys = [], []
    for lut, salt in ((_WORD, 0), (_MARK, 0x5BD1E9955BD1E995)):
        buf = lut[block.buf]
        s, e = B.spans(buf)
        docs.append(np.searchsorted(block.begin, s, "right") - 1)
        keys.append(B.hashes(buf, s, e) ^ np.uint64(salt))
    doc, key = np.concatenate(docs), np.concatenate(keys)
    _, at = np.unique(B.mix(key ^ B.mix(doc.astype(np.uint64))), return_index=True)
    return doc[at], key[at]


class Classifier:
    """Weights of sorted feature hashes and an intercept, as evidence: log odds less those of the rate it was fitted at."""

    def __init__(self, doc: np.ndarray, key: np.ndarray, label: np.ndarray):
        self.keys, self.weights, self.intercept = np.zeros(0, np.uint64), np.zeros(0), 0.0
        n, pos = len(label), int(label.sum())
        if pos in (0, n):
            return
        distinct, place, times = np.unique(key, return_inverse=True, return_counts=True)
        hit = np.bincount(place, label[doc], len(distinct))
        expect = times * pos / n
        z = (hit - expect) ** 2 / (expect * (1 - pos / n) * np.maximum(1 - times / n, 1e-9) + 1e-9)
        z[(times < LEAST_DOCS) | (z < 12)] = 0
        pick = np.sort(np.argsort(-z, kind="stable")[: min(FEATURES, int((z > 0).sum()))])
        self.keys = distinct[pick]
        col = np.full(len(distinct), -1)
        col[pick] = np.arange(len(pick))
        x = np.zeros((n, len(pick) + 1))
        x[:, -1] = 1
        ok = col[place] >= 0
        x[doc[ok], col[place[ok]]] = 1
        w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], RIDGE)
        ridge[-1] = 1e-6
        w[-1] = np.log(pos / (n - pos))
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (label - p) - ridge * w)
            w += step
            if np.abs(step).max() < 1e-6:
                break
        self.weights, self.intercept = w[:-1], w[-1] - np.log(pos / (n - pos))

    def evidence(self, doc: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.intercept)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            out += np.bincount(doc[ok], self.weights[at[ok]], n)
        return out


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for block, lo in B.within(b):
            doc, key = features(block)
            order = np.argsort(doc, kind="stable")
            cut = np.searchsorted(doc[order], np.arange(len(block) + 1))
            packed = [B.pack(key[order[i:j]]) for i, j in zip(cut[:-1], cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), b.column(2).slice(lo, len(block)), b.column(3).slice(lo, len(block))], ["features", *TARGETS])


def _score(models: list[Classifier]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, lo in B.within(b):
                doc, key = features(block)
                sites = [b.column(c).slice(lo, len(block)) for c in (2, 3)]
                yield pa.RecordBatch.from_arrays([B.ids_out(block.doc_id), *sites, *(pa.array(m.evidence(doc, key, len(block))) for m in models)], ["doc_id", "host", "path", *(f"{t}_evidence" for t in TARGETS)])

    return run


def site_rates(labelled: DataFrame, shared: B.Shared) -> DataFrame:
    """``host``, ``path`` and the shrunken rates of both, by target; null ``path``: the host as such, both null: global."""
    sums = [F.sum(t).cast("double").alias(t) for t in TARGETS] + [F.count(t).cast("double").alias(f"{t}_n") for t in TARGETS]
    paths = shared.write(labelled.groupBy("host", "path").agg(*sums), "paths", few=True)
    again = [F.sum(c).alias(c) for t in TARGETS for c in (t, f"{t}_n")]
    hosts = shared.write(paths.groupBy("host").agg(*again), "hosts", few=True)
    total = hosts.agg(*again).select(*(F.when(F.coalesce(f"{t}_n", F.lit(0.0)) > 0, F.col(t) / F.col(f"{t}_n")).otherwise(0.5).alias(f"{t}_all") for t in TARGETS))

    def strength(level: DataFrame) -> DataFrame:
        """Moments: with rates p of n labels around m, sum n (p - m)^2 is (k - 1) m (1 - m) by noise alone."""
        out = []
        for t in TARGETS:
            n, m, p = F.col(f"{t}_n"), F.col(f"{t}_all"), F.try_divide(F.col(t), F.col(f"{t}_n"))
            noise = F.max(m * (1 - m))
            k, spread, mass = F.sum(F.when(n > 0, 1.0).otherwise(0.0)), F.sum(F.when(n > 0, n * (p - m) ** 2)), F.sum(n) - F.try_divide(F.sum(n * n), F.sum(n))
            between = F.greatest(F.try_divide(spread - (k - 1) * noise, mass), noise * 1e-3)
            out.append(F.coalesce(F.when((mass > 0) & (noise > 0), F.least(F.greatest(F.try_divide(noise, between) - 1, F.lit(1.0)), F.lit(1000.0))), F.lit(1000.0)).alias(f"{t}_k"))
        return level.crossJoin(F.broadcast(total)).agg(*out)

    rate = lambda t, parent: ((F.coalesce(F.col(t), F.lit(0.0)) + F.col(f"{t}_k") * F.col(parent)) / (F.col(f"{t}_n") + F.col(f"{t}_k"))).alias(f"{t}_rate")
    one = lambda df, k: df.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(k))
    host_rates = one(hosts, strength(hosts)).select("host", *(rate(t, f"{t}_all") for t in TARGETS))
    parents = host_rates.select("host", *(F.col(f"{t}_rate").alias(f"{t}_host") for t in TARGETS))
    path_rates = one(paths, strength(paths)).join(parents, "host").select("host", "path", *(rate(t, f"{t}_host") for t in TARGETS))
    top = total.select(F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), *(F.col(f"{t}_all").alias(f"{t}_rate") for t in TARGETS))
    return path_rates.unionByName(host_rates.withColumn("path", F.lit(None).cast("string"))).unionByName(top)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", path: str = "lang", sample: int = SAMPLE, held: Column | None = None) -> DataFrame:
    """``quality`` and ``toxic`` probabilities of each document, its site's rates, and ``keep``: good enough and not toxic."""
    shared = B.Shared(docs.sparkSession, "quality")
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("none"))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), name(host).alias("host"), name(path).alias("path"))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(t).cast("int").alias(t) for t in TARGETS)).where("doc_id is not null")
    marks = marks if held is None else marks.where(~F.coalesce(held, F.lit(False)))
    ids = marks.where(" and ".join(f"{t} is not null" for t in TARGETS)).orderBy(F.xxhash64("doc_id"), "doc_id", *TARGETS).limit(sample)  # bounded by ``sample``
    texts = rows.select("doc_id", "text").join(F.broadcast(ids.select("doc_id").distinct()), "doc_id")
    one = texts.groupBy("doc_id").agg(F.min(F.struct("text")).alias("least")).select("doc_id", "least.text")
    picked = one.join(F.broadcast(ids), "doc_id").select("doc_id", "text", *TARGETS).mapInArrow(_sampled, "features binary, quality int, toxic int").collect()
    keys = [B.unpack(r.features)[0] for r in picked]
    doc, key = np.repeat(np.arange(len(keys)), [len(k) for k in keys]), np.concatenate([*keys, np.zeros(0, np.uint64)])
    models = [Classifier(doc, key, np.array([r[t] for r in picked], np.float64)) for t in TARGETS]
    labelled = rows.select("doc_id", "host", "path").join(marks, "doc_id")
    rates = shared.write(site_rates(labelled, shared), "rates", few=True)
    scored = rows.mapInArrow(_score(models), "doc_id long, host string, path string, quality_evidence double, toxic_evidence double")
    named = lambda df, to: df.select(*[c for c in ("host", "path") if c in df.columns], *(F.col(f"{t}_rate").alias(f"{t}_{to}") for t in TARGETS))
    out = scored.join(named(rates.where("path is not null"), "path"), ["host", "path"], "left")
    out = out.join(named(rates.where("host is not null and path is null").drop("path"), "host"), "host", "left")
    out = out.crossJoin(F.broadcast(named(rates.where("host is null").drop("host", "path"), "all")))
    odds = lambda p: F.log(p / (1 - p))
    for t in TARGETS:
        rate = F.least(F.greatest(F.coalesce(f"{t}_path", f"{t}_host", f"{t}_all"), F.lit(1e-6)), F.lit(1 - 1e-6))
        out = out.withColumn(f"{t}_site", rate).withColumn(t, 1 / (1 + F.exp(-(odds(rate) + F.col(f"{t}_evidence")))))
    return out.select("doc_id", *TARGETS, *(f"{t}_site" for t in TARGETS), ((F.col("quality") >= QUALITY) & (F.col("toxic") < TOXIC)).alias("keep"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = B.read(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"), B.read(spark, sf_dir, "labels", "doc_id", *TARGETS)
    return classify(docs, labels)


QUERIES = {"op7_quality": op7_quality}
SQL: dict[str, str] = {}
