"""Benchmark decontamination: word trigrams seed regions, Smith-Waterman scores them.

Words are runs of letters, digits and non-ASCII characters, in lower case (ASCII and Latin-1).  All
trigrams of an item are its seeds, however frequent.  A seed found in a document marks the stretch the item would cover there and
``PAD`` words on either side; stretches that overlap are one.  Those that hold too few words of the
item for the score are left; in others, word-level local alignment (match +2,
other word -1, word too many or too few -1) is divided by its greatest value, twice the item's words.

The benchmark goes to the workers in slices of ``SLICE`` bytes at most, one pass over the documents for
each; nothing else is sent and no documents are shuffled.

Ids are integers, here as in all operators; a string that isn't one is an error.  A text longer than a block
is a block of its own.  Null and empty texts and items match nothing, nor do items of fewer than three words.  A null
``doc_id`` or ``item_id`` stays null; repeated documents each give their rows, repeated items count once
for each id.  Other columns are left out.  Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm import blocks as B

N, PAD, SCORE, SLICE = 3, 8, 0.5, 4 << 20
SCHEMA = "doc_id long, item_id long, score double, first_word long, last_word long"
_KEYS = np.random.default_rng(8).integers(0, 2**63, N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[48:58] = np.arange(48, 58)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)
_TABLE_BITS = 20


def words(block: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each cleaned word, and where each text's words begin."""
    buf = _CLEAN[block.buf]
    upper = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
    buf[upper] += 0x20
    s, e = B.spans(buf)
    return B.hashes(buf, s, e), np.searchsorted(s, block.begin)


def _grams(ids: np.ndarray) -> np.ndarray:
    n = max(len(ids) - N + 1, 0)
    out = np.zeros(n, np.uint64)
    for j in range(N):
        out += ids[j : j + n] * _KEYS[j]
    return B.mix(out)


class Lookup:
    """Places of values among sorted ``keys``; -1 for values that aren't there."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.table = np.zeros(1 << _TABLE_BITS, bool)
        self.table[keys & np.uint64((1 << _TABLE_BITS) - 1)] = True

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which values are there, and where."""
        at = np.flatnonzero(self.table[values & np.uint64((1 << _TABLE_BITS) - 1)])
        place = np.minimum(np.searchsorted(self.keys, values[at]), max(len(self.keys) - 1, 0))
        ok = self.keys[place] == values[at] if len(self.keys) else np.zeros(len(at), bool)
        return at[ok], place[ok]


class Items:
    """The items of a slice and their seeds."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.ids = [i for i, _ in rows]
        block = B.Block(np.arange(len(rows)), [None if t is None else t.encode() for _, t in rows])
        ids, first = words(block)
        self.words = [ids[i:j] for i, j in zip(first[:-1], first[1:])]
        self.kinds = [np.unique(w) for w in self.words]
        size = np.maximum(np.diff(first) - N + 1, 0)
        self.item = np.repeat(np.arange(len(rows)), size)
        self.offset = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        keys = np.concatenate([np.zeros(0, np.uint64), *(_grams(w) for w in self.words)])
        order = np.argsort(keys, kind="stable")
        self.item, self.offset = self.item[order], self.offset[order]
        self.keys, self.begin = np.unique(keys[order], return_index=True)
        self.begin = np.append(self.begin, len(keys))


def align(item: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local score of ``item`` in each row of word hashes (0: padding), and the first and last column of its place.

    Each cell holds its score and, below it, how far from the end its alignment began, so the maximum of
    cells is that of scores, and of equal scores the one that began first.
    """
    k, width = rows.shape
    one, low = np.int64(1) << 32, (np.int64(1) << 32) - 1
    col = np.arange(width + 1, dtype=np.int64)
    fresh = low - col
    above = np.broadcast_to(fresh, (k, width + 1)).copy()
    best, last = np.zeros(k, np.int64), np.zeros(k, np.int64)
    for w in item:
        step = np.where(rows == w, 2 * one, -one)
        cell = np.empty_like(above)
        cell[:, 0] = fresh[0]
        cell[:, 1:] = np.maximum(np.maximum(above[:, :-1] + step, above[:, 1:] - one), fresh[1:])
        above = np.maximum.accumulate(cell + col * one, axis=1) - col * one
        top = above.argmax(1)
        value = above[np.arange(k), top]
        better = (value >> 32) > (best >> 32)
        best[better], last[better] = value[better], top[better] - 1
    return best >> 32, low - (best & low), last


def _hits(items: Items, lookup: Lookup, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, item and region (first word, word after the last) of each candidate, regions that overlap being one."""
    at, place = lookup.find(_grams(ids))
    doc = np.searchsorted(first, at, "right") - 1
    inside = at + N <= first[np.minimum(doc + 1, len(first) - 1)]
    at, place, doc = at[inside], place[inside], doc[inside]
    n = items.begin[place + 1] - items.begin[place]
    which = np.repeat(items.begin[place], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at, doc, item = np.repeat(at, n), np.repeat(doc, n), items.item[which]
    size = np.array([len(w) for w in items.words] or [0])[item]
    lo = np.maximum(at - items.offset[which] - PAD, first[doc])
    hi = np.minimum(at - items.offset[which] + size + PAD, first[doc + 1])
    order = np.lexsort((lo, item, doc))
    doc, item, lo, hi = doc[order], item[order], lo[order], hi[order]
    if not len(doc):
        return doc, item, lo, hi
    same = np.concatenate(([False], (doc[1:] == doc[:-1]) & (item[1:] == item[:-1])))
    group = np.cumsum(~same)
    far = np.maximum.accumulate(hi + group * (len(ids) + 1)) - group * (len(ids) + 1)
    new = ~same | (lo > np.concatenate(([0], far[:-1])))
    begins = np.flatnonzero(new)
    return doc[begins], item[begins], lo[begins], np.maximum.reduceat(hi, begins)


def matches(items: Items, lookup: Lookup, block: B.Block, score: float) -> dict[tuple[int, int], tuple[float, int, int]]:
    """Score and, negated, first and last word of the best place, by text and item."""
    ids, first = words(block)
    doc, item, lo, hi = _hits(items, lookup, ids, first)
    found: dict[tuple[int, int], tuple] = {}
    order = np.lexsort((hi - lo, item))
    i = 0
    while i < len(order):  # regions of one item side by side, similar lengths together
        it, j = item[order[i]], i + 1
        while j < len(order) and item[order[j]] == it and j - i < 256 and (j - i) * (hi - lo)[order[j]] < 1 << 17:
            j += 1
        mine = order[i:j]
        rows = np.zeros((len(mine), int((hi - lo)[mine].max())), np.uint64)
        for r, m in enumerate(mine):
            rows[r, : hi[m] - lo[m]] = ids[lo[m] : hi[m]]
        enough = np.isin(rows, items.kinds[it]).sum(1) >= score * len(items.words[it])  # words that match give 2 each at most
        i = j
        if not enough.any():
            continue
        mine, rows = mine[enough], rows[enough]
        value, begin, end = align(items.words[it], rows)
        share = value / (2.0 * len(items.words[it]))
        for r in np.flatnonzero(share >= score):
            m = mine[r]
            f = lo[m] - first[doc[m]]
            got = (float(share[r]), -int(f + begin[r]), int(f + end[r]))
            found[doc[m], it] = max(found.get((doc[m], it), got), got)
    return found


def _find(items: Items, score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(items.keys)
        for block in B.blocks(batches):
            found = matches(items, lookup, block, score)
            keys = sorted(found)
            names = pa.array([items.ids[i] for _, i in keys], pa.int64())
            yield pa.RecordBatch.from_arrays([B.ids_out(block.doc_id[np.array([d for d, _ in keys], int)]), names, *(pa.array([sign * found[k][c] for k in keys], t) for c, sign, t in ((0, 1, pa.float64()), (1, -1, pa.int64()), (2, 1, pa.int64())))], ["doc_id", "item_id", "score", "first_word", "last_word"])

    return run


def _clean(items: Items, score: float):
    """Batches without the rows that hold an item; the first two columns are for the search only and stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(items.keys)
        for b in batches:
            keep = np.ones(b.num_rows, bool)
            for block, lo in B.within(b):
                keep[[lo + d for d, _ in matches(items, lookup, block, score)]] = False
            yield b.filter(pa.array(keep))

    return run


def _slices(benchmark: DataFrame, item_id: str, item_text: str, slice_bytes: int) -> Iterator[Items]:
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    parts = max(1, -(-2 * size // slice_bytes)) if size > slice_bytes else 1
    for part in range(parts):
        yield Items([tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).distinct().collect()])


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", score: float = SCORE, slice_bytes: int = SLICE) -> DataFrame:
    """A row for each document and item whose alignment scores ``score`` or more: the score and the words it covers in the document."""
    spark, texts = docs.sparkSession, B.pair(docs, doc_id, text)
    out = spark.createDataFrame([], SCHEMA)
    for mine in _slices(benchmark, item_id, item_text, slice_bytes):
        out = out.unionByName(texts.mapInArrow(_find(mine, score), SCHEMA))
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", score: float = SCORE, slice_bytes: int = SLICE) -> DataFrame:
    """``docs`` without the rows that hold an item, whatever their ids, all slices in one pass; nothing is shuffled."""
    names = docs.columns
    rows = docs.select(F.lit(0).cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)))
    for mine in _slices(benchmark, item_id, item_text, slice_bytes):
        rows = rows.mapInArrow(_clean(mine, score), rows.schema)
    return rows.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(names)))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(B.read(spark, sf_dir, "documents", "doc_id", "text"), B.read(spark, sf_dir, "benchmark", "item_id", "text"))


QUERIES = {"op8_decontamination": op8_decontamination}
SQL: dict[str, str] = {}
