"""MinHash near-dedup: BagMinHash signatures of word-shingle multisets, bands, and verified overlap.

Signature: a shingle's weight axis is cut into [0, 1), [1, 2), [2, 4), [4, 8), ... and each part has a
Poisson process of its own, with a rate of its length, the same in all documents.  A point has a
time, a register and a place on the axis; a document sees the points below the shingle's count.  The
earliest point of a register agrees between two documents with a probability of exactly their
weighted Jaccard similarity.  Points are made up to a horizon at which all registers should be full,
and further for documents where one is not.

Candidates: texts with equal words are one node.  Nodes that share a band are each compared with the
band's least node.  Where a band's nodes are not all in one component after that, they are compared
with each other in tiles of bounded size, none of which emits more links than it has components.
Similarity is computed from the whole texts.

Texts of fewer words than a shingle have one shingle of all their words.  Null texts and texts
without words are never duplicates.  A text of any length is read and compared whole, one at a time.  A
null ``doc_id`` counts as the largest; rows with equal ids are one document, each giving a row.
Contents are told apart by a 64-bit hash.  An empty table gives no rows.  ``drop_near_duplicates`` keeps
other columns, whatever their names; of rows with equal ids the least by text and then by the other
columns' hash stays, and rows with a null id all do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hindcast.llm import blocks as B
from hindcast.llm.components import components

SHINGLE, SIMILAR, BANDS, ROWS, TILE = 5, 0.8, 40, 6, 256
_KEYS = np.random.default_rng(5).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def contents(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each text's words and their places."""
    place = np.arange(len(ids)) - np.repeat(first[:-1], np.diff(first))
    each = B.mix(ids + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    return B.mix(B.per_word(each, first).view(np.uint64) + np.diff(first).astype(np.uint64))


def multisets(block: B.Block, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, shingle and count of each distinct shingle of each text, by text; and each text's content hash."""
    _, _, ids, first = block.words()
    n = np.diff(first)
    doc = np.repeat(np.arange(len(block)), n)
    left = np.repeat(first[1:], n) - np.arange(len(ids))  # words from here to the text's end
    at = np.flatnonzero((left >= size) | (left == np.repeat(n, n)))
    s = np.zeros(len(at), np.uint64)
    for j in range(size):
        there = left[at] > j
        s += np.where(there, ids[np.minimum(at + j, len(ids) - 1)], np.uint64(j)) * _KEYS[j] if len(at) else s
    s = B.mix(s)
    _, where, count = np.unique(B.mix(s ^ B.mix(doc[at].astype(np.uint64))), return_index=True, return_counts=True)
    order = np.argsort(where)
    where, count = where[order], count[order]
    return doc[at][where], s[where], count, contents(ids, first)


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """Earliest times, a row for each of ``n`` documents, each of which has a shingle."""
    sig = np.full(n * registers, np.inf)
    total = np.bincount(doc, count, n)
    horizon = registers * (np.log(registers) + 4) / np.maximum(total, 1)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        sig.reshape(n, registers)[todo] = np.inf
        mine = np.isin(doc, todo) if len(todo) < n else slice(None)
        d, s, c, shell, low, high = doc[mine], shingle[mine], count[mine], 0, 0, 1
        while len(d):
            rate, seed = float(high - low), B.mix(s + np.uint64(shell * 0xD6E8FEB86659FD93 & (2**64 - 1)))
            live, t, until, c_live = d, np.zeros(len(d)), horizon[d], c
            while len(live):
                seed = B.mix(seed + np.uint64(0x9E3779B97F4A7C15))
                t = t - np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
                on = t <= until
                live, t, until, seed, c_live = live[on], t[on], until[on], seed[on], c_live[on]
                more = B.mix(seed ^ np.uint64(0xA0761D6478BD642F))
                at = live * registers + ((more >> np.uint64(32)) % np.uint64(registers)).astype(np.int64)
                if high - low == 1:
                    np.minimum.at(sig, at, t)
                else:
                    seen = low + (more & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * rate < c_live
                    np.minimum.at(sig, at[seen], t[seen])
            shell, low, high = shell + 1, high, 2 * high
            on = c > low
            d, s, c = d[on], s[on], c[on]
        todo = todo[np.isinf(sig.reshape(n, registers)[todo]).any(axis=1)]
        horizon[todo] *= 2
    return sig.reshape(n, registers)


def bands(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), sig.shape[1] // rows, rows)
    h = np.zeros(bits.shape[:2], np.uint64) + np.arange(bits.shape[1], dtype=np.uint64)
    for r in range(rows):
        h = B.mix(h * np.uint64(0xD6E8FEB86659FD93) + bits[:, :, r])
    return h.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in B.blocks(batches, B.BLOCK_BYTES // 2):
        doc, s, c, content = multisets(block)
        n = np.bincount(doc, c, len(block)).astype(np.int64)
        some = n > 0
        h = bands(signatures((np.cumsum(some) - 1)[doc], s, c, int(some.sum())))
        flat = pa.array(h.ravel())
        ends = np.concatenate(([0], np.cumsum(some * h.shape[1]))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(block.doc_id), pa.array(content.view(np.int64), mask=~some), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "node", "bands"])


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in B.blocks(batches, B.BLOCK_BYTES // 2):
        _, _, ids, first = block.words()
        yield pa.RecordBatch.from_arrays([pa.array(block.doc_id), pa.array(contents(ids, first).view(np.int64)), pa.array([block.text(i) or b"" for i in range(len(block))], pa.binary()).cast(pa.string())], ["doc_id", "node", "text"])


def overlaps(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Weighted Jaccard similarity of texts 0 and 1, 2 and 3, and so on."""
    doc, s, c, _ = multisets(B.Block(np.arange(len(texts)), texts), size)
    two = doc // 2
    _, at, place = np.unique(B.mix(s ^ B.mix(two.astype(np.uint64) + np.uint64(1 << 40))), return_index=True, return_inverse=True)
    a, b = (np.bincount(place[doc % 2 == k], c[doc % 2 == k], len(at)) for k in (0, 1))
    n = len(texts) // 2
    return np.bincount(two[at], np.minimum(a, b), n) / np.maximum(np.bincount(two[at], np.maximum(a, b), n), 1)


def _verify(similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = (b.column(k).cast(pa.binary()) for k in (2, 3))
            for i in range(0, b.num_rows, 64):
                texts = [t for two in zip(left.slice(i, 64).to_pylist(), right.slice(i, 64).to_pylist()) for t in two]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 64), b.column(1).slice(i, 64), pa.array(overlaps(texts) >= similar)], ["a", "b", "similar"])

    return run


def forest(texts: list[bytes], labels: list[int], similar: float, size: int = SHINGLE) -> list[tuple[int, int]]:
    """Links that join what similarities of ``similar`` or more join, none within a label."""
    doc, s, c, _ = multisets(B.Block(np.arange(len(texts)), texts), size)
    n, total = len(texts), np.bincount(doc, c, len(texts))
    nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)  # the second time a shingle stands is an element of its own
    el = B.mix(np.repeat(s, c) + nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    keys, place, times = np.unique(el, return_inverse=True, return_counts=True)
    keep = times[place] > 1
    _, place = np.unique(place[keep], return_inverse=True)
    of, both = np.repeat(doc, c)[keep], np.zeros((n, n), np.float32)
    order = np.argsort(place, kind="stable")
    of, place = of[order], place[order]
    for lo in range(0, int(place.max(initial=-1)) + 1, 4096):
        i, j = np.searchsorted(place, (lo, lo + 4096))
        has = np.zeros((n, 4096), np.float32)
        has[of[i:j], place[i:j] - lo] = 1
        both += has @ has.T
    near = both >= similar * (total[:, None] + total[None, :] - both)
    lead: dict[int, int] = {}
    root, links = [lead.setdefault(x, i) for i, x in enumerate(labels)], []
    of_label = np.array(root)
    near &= of_label[:, None] != of_label[None, :]

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        if (a := top(int(i))) != (b := top(int(j))):
            root[max(a, b)] = min(a, b)
            links.append((int(i), int(j)))
    return links


def _tile(similar: float):
    def run(t: pa.Table) -> pa.Table:
        label = t.column("label").to_pylist()
        links = forest(t.column("text").cast(pa.binary()).to_pylist(), label, similar)
        return pa.table({"a": pa.array([label[i] for i, _ in links], pa.int64()), "b": pa.array([label[j] for _, j in links], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``doc_id``, ``class_id`` (the least id that similarities of ``similar`` or more link it to) and the ``class_size`` of each row."""
    spark = docs.sparkSession
    shared, texts = B.Shared(spark, "near-dedup"), B.pair(docs, doc_id, text)
    signed = shared.write(texts.mapInArrow(_sign, "doc_id long, node long, bands array<long>"), "signed")
    nodes = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"))
    shares = nodes.select("node", F.explode("bands").alias("band"))
    groups = shares.groupBy("band").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1")
    members = shared.write(shares.join(groups, "band"), "members", few=True)
    pairs = members.where("node != lead").select("node", "lead").distinct()
    wanted = members.select("node").distinct().join(nodes.select("node", F.col("least").alias("doc_id")), "node")
    own = shared.write(texts.mapInArrow(_nodes, "doc_id long, node long, text string").join(wanted, ["doc_id", "node"], "left_semi").groupBy("node").agg(F.first("text").alias("text")), "texts", few=True)
    # a lead's text goes once to each of the tasks its pairs are dealt over
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(B.SALTS)))
    leads = pairs.select("lead", "salt").distinct().join(own.select(F.col("node").alias("lead"), F.col("text").alias("b_text")), "lead")
    compared = pairs.join(own.withColumnRenamed("text", "a_text"), "node").join(leads, ["lead", "salt"])
    compared = compared.select(F.col("node").alias("a"), F.col("lead").alias("b"), "a_text", "b_text").mapInArrow(_verify(similar), "a long, b long, similar boolean")
    compared = shared.write(compared, "compared", few=True)
    labels = components(compared.where("similar").select("a", "b"), shared, "first")
    known = members.select("band", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = known.groupBy("band", "label").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("band").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("n"), F.count("*").alias("labels")).where("labels > 1")
    mixed = mixed.select("band", F.col("top.label").alias("main"), F.ceil(F.col("top.c") / TILE).alias("mains"), F.ceil((F.col("n") - F.col("top.c")) / TILE).alias("others"))
    mixed = shared.write(mixed, "mixed", few=True)
    dealt = B.meet(known, mixed, ["band"], ["node"]).withColumn("mine", F.pmod(F.xxhash64("node"), F.when(F.col("label") == F.col("main"), F.col("mains")).otherwise(F.col("others"))))
    upto = lambda c, f: F.transform(F.sequence(F.lit(0), F.col(c) - 1), lambda i: F.xxhash64("band", *f(i)))
    # the band's largest component needs no comparing with itself: its nodes go once to each tile of the others
    of_main = upto("others", lambda i: (F.lit("main"), i, "mine"))
    of_other = F.concat(upto("others", lambda i: (F.lit("other"), F.least("mine", i), F.greatest("mine", i))), upto("mains", lambda i: (F.lit("main"), "mine", i)))
    dealt = dealt.select("node", "label", F.explode(F.when(F.col("label") == F.col("main"), of_main).otherwise(of_other)).alias("tile"))
    useful = dealt.groupBy("tile").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("tile")
    inside = dealt.join(useful, "tile", "left_semi").join(own, "node").groupBy("tile").applyInArrow(_tile(similar), "a long, b long")
    over = components(inside, shared, "second").select(F.col("node").alias("label"), F.col("label").alias("to"))
    labels = labels.join(over, "label", "full").select(F.coalesce("node", "label").alias("node"), F.coalesce("to", "label").alias("label"))
    sizes = signed.where("node is not null").groupBy("node").agg(F.count("*").alias("rows"), F.min("doc_id").alias("least"))
    sizes = shared.write(sizes.join(shared.write(labels, "labels", few=True), "node", "left").where("rows > 1 or label is not null"), "sizes", few=True)
    classes = sizes.where("label is not null").groupBy("label").agg(F.min("least").alias("class_id"), F.sum("rows").alias("class_size"))
    of = B.meet(sizes, shared.write(classes, "classes", few=True), ["label"], ["node"], "left")
    of = of.select("node", F.coalesce("class_id", "least").alias("class_id"), F.coalesce("class_size", "rows").alias("class_size"))
    found = B.meet(signed.select("doc_id", "node"), shared.write(of, "of", few=True), ["node"], ["doc_id"], "left")
    real = lambda c: F.when(c != B.NO_ID, c)
    return found.select(real(F.col("doc_id")).alias("doc_id"), real(F.coalesce("class_id", "doc_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """The rows of ``docs`` whose id is that of their class, one each, and all whose id is null."""
    key, rest = F.col(f"`{doc_id}`"), [F.col(f"`{c}`") for c in docs.columns if c not in (doc_id, text)]
    found = near_duplicates(docs, doc_id, text, similar).where("doc_id is not null")
    kept = found.where("doc_id = class_id").select(F.col("doc_id").cast(docs.schema[doc_id].dataType).alias("id__")).distinct()
    rows = docs.where(key.isNotNull()).join(kept, key == F.col("id__"), "left_semi")
    first = Window.partitionBy(key).orderBy(F.col(f"`{text}`"), F.xxhash64(*rest) if rest else F.lit(0))
    rows = rows.withColumn("nth__", F.row_number().over(first)).where("nth__ = 1").drop("nth__")
    return rows.unionByName(docs.where(key.isNull()))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(B.read(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op1_near_dedup": op1_near_dedup}
SQL: dict[str, str] = {}
