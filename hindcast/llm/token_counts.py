"""Token counts: pieces once a distinct pre-token, joined to per-document pre-token frequencies.

A pre-token here is a word with the white space before it.  The byte-level pattern never joins a
word to what follows it, so such a unit is split and merged alike wherever it stands; the one
exception, non-ASCII white space right before ASCII white space, keeps both units in one.  No list
of ids is ever made.

Null texts count as empty, with no tokens; a text longer than a block is a block of its own.  A null ``doc_id`` stays null; repeated rows each give a
row; other columns are left out.  An empty table gives no rows.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from hindcast.llm import blocks as B

LIMIT = 1024
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
# The non-ASCII members of Unicode's White_Space, as UTF-8.
WIDE_2 = [b"\xc2\x85", b"\xc2\xa0"]
WIDE_3 = [b"\xe1\x9a\x80", *(b"\xe2\x80" + bytes([x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\xe2\x81\x9f", b"\xe3\x80\x80"]


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def pieces(path: str, texts: list[str]) -> np.ndarray:
    """How many tokens each text has by the library."""
    t, out = _tokenizer(path), []
    for i in range(0, len(texts), 8192):
        out += [len(x) for x in t.encode_batch_fast(texts[i : i + 8192], add_special_tokens=False)]
    return np.array(out, np.int64)


def units(block: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each unit, and where each text's units begin."""
    _, ends = B.spans(block.buf)
    stop = block.begin[:-1] + block.length
    text = np.searchsorted(stop, ends)  # the text of each word
    cut = ends.astype(np.int64)
    two = block.buf[np.maximum(cut - 2, 0)].astype(np.uint32) << 8 | block.buf[np.maximum(cut - 1, 0)]
    three = two | block.buf[np.maximum(cut - 3, 0)].astype(np.uint32) << 16
    wide = np.isin(two & 0xFFFF, [int.from_bytes(x, "big") for x in WIDE_2]) | np.isin(three, [int.from_bytes(x, "big") for x in WIDE_3])
    keep = ~wide | (cut == stop[text])
    # each text also ends a unit, unless its last word does
    cut = np.union1d(cut[keep], stop[block.length > 0])
    text = np.searchsorted(stop, cut)
    start = np.maximum(np.concatenate(([0], cut[:-1])), block.begin[:-1][text]) if len(cut) else cut
    return start, cut, np.searchsorted(text, np.arange(len(block) + 1))


def _frequencies(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seq, block in enumerate(B.blocks(batches)):
            no = B.task_block(seq)
            s, e, first = units(block)
            keys, at, place = np.unique(B.hashes(block.buf, s, e), return_index=True, return_inverse=True)
            data = block.buf.tobytes()
            texts = [data[i:j] for i, j in zip(s[at].tolist(), e[at].tolist())]
            bucket = B.bucket_of(keys, buckets).tolist()
            order = sorted(range(len(keys)), key=lambda i: (bucket[i], texts[i]))  # texts side by side pack well
            rank = np.empty(len(keys), np.int64)
            rank[order] = np.arange(len(keys))
            doc = np.repeat(np.arange(len(block)), np.diff(first))
            own, freq = np.unique(doc * np.int64(max(len(keys), 1)) + rank[place], return_counts=True)
            doc, rank = np.divmod(own, max(len(keys), 1))
            pairs = np.searchsorted(doc, np.arange(len(block) + 1))
            step = np.diff(rank, prepend=0)
            begins = pairs[:-1][pairs[1:] > pairs[:-1]]
            step[begins] = rank[begins]
            rows = [(0, no, -1, B.pack(block.doc_id, block.length, pairs, B.planes(step), B.narrow(freq)))]
            cut = np.searchsorted(np.array(bucket, np.int64), np.arange(buckets + 1))
            for b in range(buckets):
                if cut[b + 1] > cut[b]:
                    mine = [texts[i] for i in order[cut[b] : cut[b + 1]]]
                    rows.append((1, no, b, B.pack(B.narrow(np.array([len(t) for t in mine])), np.frombuffer(b"".join(mine), np.uint8))))
            yield B.rows_batch(rows)

    return run


def token_counts(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """Bytes and tokens of each whole text of ``docs``."""
    spark, path = docs.sparkSession, path or vocabulary()
    shared, texts = B.Shared(spark, "token-counts"), B.pair(docs, doc_id, text)
    size = B.volume(texts)
    table = shared.write(texts.mapInArrow(_frequencies(B.n_buckets(spark, size)), B.BLOCK_SCHEMA), "pairs", ["kind"])

    def count(got: list[list[np.ndarray]]) -> list[np.ndarray]:
        known: dict[bytes, int] = {}
        places = []
        for size, text in got:
            cut, text = np.concatenate(([0], np.cumsum(size, dtype=np.int64))).tolist(), text.tobytes()
            places.append(np.array([known.setdefault(text[i:j], len(known)) for i, j in zip(cut[:-1], cut[1:])], np.int64))
        n = B.narrow(pieces(path, [t.decode("utf-8", "replace") for t in known]))
        return [n[p] for p in places]

    def total(_: int, state: bytes, parts: list[np.ndarray]) -> pa.Table:
        ids, size, pairs, step, freq = B.unpack(state)
        run = np.cumsum(B.unplanes(step), dtype=np.int64)
        begins = np.repeat(pairs[:-1], np.diff(pairs))
        rank = run - np.where(begins > 0, run[begins - 1], 0) if len(run) else run
        n = B.per_word(B.joined(parts, np.int64)[rank] * freq, pairs) if len(rank) else np.zeros(len(ids), np.int64)
        return pa.table({"doc_id": B.ids_out(ids), "n_bytes": size, "n_tokens": n, "over_limit": n > limit})

    return B.told(table.where("kind = 0"), B.answer(table.where("kind = 1"), count, size), total, SCHEMA, size)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(B.read(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op10_token_counts": op10_token_counts}
SQL: dict[str, str] = {}
