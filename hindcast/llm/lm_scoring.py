"""LM scoring: a bigram model whose quantised counts live in a log-frequency Bloom filter.

An n-gram seen c times has level ``1 + floor(log(c) / log(BASE))`` and puts its pairs (n-gram, 1) to
(n-gram, level) into the filter; its level is read back by probing until the first miss.  All
unigrams and all bigrams go in.  The filter is split by bucket, and a bucket's part has
``BITS_EACH`` bits an entry however many there are.  It stays with the bucket's owner, whom each
block asks for the levels of its distinct n-grams; nothing is broadcast.

    P(w | v) = W * min(1, c(vw) / c(v)) + (1 - W) * (c(w) + 1) / (N + V + 1)

with W = ``WEIGHT``, or 0 where v was never seen.  ``base_score`` uses exact counts instead.

Null and empty texts are the end token alone; a text longer than a block is a block of its own.  A null
``doc_id`` stays null, is not held out, and its text is not learned from; repeated rows are learned from and scored each; other columns are
left out.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm import blocks as B

BASE, BITS_EACH, PROBES, WEIGHT = 1.5, 8, 4, 0.3
LEVELS = 64
END = np.uint64(0x5851F42D4C957F2D)
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def levels(counts: np.ndarray) -> np.ndarray:
    return np.where(counts > 0, 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9), 0).astype(np.int64)


def means() -> np.ndarray:
    """The mean count of each level, 0 for level 0."""
    edge = np.ceil(BASE ** np.arange(LEVELS + 1) - 1e-9)
    return np.concatenate(([0.0], np.maximum(edge[:-1], (edge[:-1] + edge[1:] - 1) / 2)))


def pairs(seq: np.ndarray) -> np.ndarray:
    return B.mix(seq[:-1] * np.uint64(0xD6E8FEB86659FD93) + B.mix(seq[1:]))


def _places(keys: np.ndarray, level: int, bits: int) -> Iterator[np.ndarray]:
    """The bits of (key, level) among ``bits``."""
    a = B.mix(keys + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1)))
    b = B.mix(a) | np.uint64(1)
    for _ in range(PROBES):
        yield ((a >> np.uint64(32)) * np.uint64(bits)) >> np.uint64(32)
        a = a + b


def part_filter(keys: np.ndarray, level: np.ndarray, bits: int) -> np.ndarray:
    on = np.zeros(bits, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        for at in _places(keys[level >= j], j, bits):
            on[at] = True
    return np.packbits(on)


def probe(filters: np.ndarray, bits: int, buckets: int, keys: np.ndarray) -> np.ndarray:
    """The level of each key; bucket b's filter has ``bits`` bits and begins at bit ``b * bits``."""
    out, left, j = np.zeros(len(keys), np.int64), np.arange(len(keys)), 0
    base = B.bucket_of(keys, buckets) * bits
    while len(left) and j < LEVELS:
        j += 1
        own = base[left]
        ok = np.ones(len(left), bool)
        for at in _places(keys[left], j, bits):
            at = own + at.astype(np.int64)
            ok &= (filters[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        left = left[ok]
        out[left] = j
    return out


def read_back(keys: np.ndarray, n: np.ndarray, each: int) -> np.ndarray:
    """The level of each key of a bucket by a filter of those that were seen, with ``each`` bits an entry."""
    keep = n > 0
    level = levels(n[keep])
    bits = max(64, int(level.sum()) * each)
    return probe(part_filter(keys[keep], level, bits), bits, 1, keys)


def _tokens(block: B.Block, fold: int, of: int):
    """Tokens with an end token before each text and after the last, where each text's begin, and whether to learn from it."""
    crc = B.crc32(block.doc_id)
    _, _, h, first = block.words(B.LOWER)
    return np.append(np.insert(h, first[:-1], END), END), first + np.arange(len(first)), (crc >= 0) & (crc % of != fold), (crc >= 0) & (crc % of == fold)


def _unigrams(buckets: int, fold: int, of: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, block in enumerate(B.blocks(batches)):
            no = B.task_block(seq)
            tokens, first, learn, held = _tokens(block, fold, of)
            keys, place = np.unique(tokens, return_inverse=True)
            n = np.bincount(place[1:][np.repeat(learn, np.diff(first))], minlength=len(keys))
            yield B.rows_batch([(0, no, -1, B.pack(block.doc_id, held, first, keys, B.planes(place)))] + B.asks(1, no, buckets, keys, n))

    return run


def _bigrams(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for no, state in zip(b.column("block").to_pylist(), b.column("payload").to_pylist()):
                ids, held, first, keys, place = B.unpack(state)
                both, at = np.unique(pairs(keys[B.unplanes(place)]), return_inverse=True)
                learn = np.repeat((ids != B.NO_ID) & ~held, np.diff(first))
                yield B.rows_batch(B.asks(2, no, buckets, both, np.bincount(at[learn], minlength=len(both))))

    return run


def _sum(got: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    keys, place, begin = B.combine(got)
    return keys, np.bincount(place, np.concatenate([g[1] for g in got]), len(keys)).astype(np.int64), place, begin


def lm_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", fold: int = 2, of: int = 7) -> DataFrame:
    """Scores of all texts by a model of those whose crc32(id as text) modulo ``of`` is not ``fold``."""
    spark, each = docs.sparkSession, BITS_EACH
    shared, texts = B.Shared(spark, "lm-scoring"), B.pair(docs, doc_id, text)
    size = B.volume(texts)
    buckets = B.n_buckets(spark, size)
    table = shared.write(texts.mapInArrow(_unigrams(buckets, fold, of), B.BLOCK_SCHEMA), "words", ["kind"])

    def unigrams(got):
        keys, n, place, begin = _sum(got)
        mine = B.narrow(n << 7 | read_back(keys, n, each))[place]
        return [mine[i:j] for i, j in zip(begin[:-1], begin[1:])] + [np.array([n.sum(), np.count_nonzero(n)])]

    def bigrams(got):
        keys, n, place, begin = _sum(got)
        mine = B.narrow(read_back(keys, n, each))[place]
        return [mine[i:j] for i, j in zip(begin[:-1], begin[1:])]

    def totals(batches):
        for b in batches:
            for p in b.column("payload").to_pylist():
                yield pa.RecordBatch.from_pydict(dict(zip(("n", "v"), B.unpack(p)[0].reshape(2, 1))))

    answers = shared.write(B.answer(table.where("kind = 1"), unigrams, size), "unigrams", few=True)
    shared.drop("words/kind=1")
    total = answers.where("block = -1").mapInArrow(totals, "n long, v long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    n_all, v_all = total.n, total.v
    twos = B.answer(table.where("kind = 0").mapInArrow(_bigrams(buckets), B.BLOCK_SCHEMA), bigrams, size)

    def score(_: int, state: bytes, parts: list[np.ndarray]) -> pa.Table:
        ids, held, first, keys, place = B.unpack(state)
        place, first = B.unplanes(place).astype(np.int64), first.astype(np.int64)
        _, pair = np.unique(pairs(keys[place]), return_inverse=True)
        told, mean = B.joined(parts, np.int64), means()  # counts and levels of the unigrams, then levels of the bigrams
        count, one, two = told[: len(keys)] >> 7, mean[told[: len(keys)] & 127], mean[told[len(keys) :]]
        log_all = np.log10(n_all + v_all + 1)
        n = np.diff(first)
        base = B.per_word(np.log10(count + 1)[place[1:]], first) - n * log_all
        alone = np.minimum((one + 1) / (n_all + v_all + 1), 1)
        before = one[place[:-1]]
        w = np.where(before > 0, WEIGHT, 0.0)
        logs = np.log10(w * np.minimum(1, two[pair] / np.maximum(before, 1)) + (1 - w) * alone[place[1:]])
        return pa.table({
            "doc_id": B.ids_out(ids), "held_out": pa.array(held), "n_tokens": n, "n_known": B.per_word((count > 0)[place[1:]].astype(np.int64), first),
            "train_tokens": np.full(len(ids), n_all, np.int64), "base_score": base, "score": B.per_word(logs, first),
        })

    both = answers.where("block >= 0").unionByName(twos.withColumn("bucket", F.col("bucket") + buckets))
    return B.told(table.where("kind = 0"), both, score, SCHEMA, size)


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(B.read(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op9_lm_scores": op9_lm_scores}
SQL: dict[str, str] = {}
