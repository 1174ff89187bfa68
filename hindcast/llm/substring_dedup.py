"""Substring dedup by recompression: long passages that stand in an earlier document go.

Names are global, from a dictionary that Spark shuffles a round: each block asks the owners of its
distinct words, then of its distinct pairs, and an owner names each one that stands in two texts or
more, exactly (by the word's bytes, or the pair's two names), and calls the others alone.  Round 0 names
words; runs of one word are symbols of the word's name and their length.  Each round after it marks
every symbol as a left or a right one by its name and the round, and a left one joins the right one
that follows; symbols that are alone join nothing.  Equal strings so have equal symbols inside in all texts.

Beside each symbol stands the stretch of words it follows from, its own and its neighbours': wherever that
whole stretch stands, the symbol does too.  So a window of ``WINDOW`` words that stands in two texts holds no
stretch of a symbol that is alone.  What such stretches leave, passages of shared symbols only, is verified:
the names of each window's words, told apart by two independent 64-bit hashes, meet those of all texts.

``doc_id`` null sorts after all others; rows with equal ids count as one document for each other and
each give a row.  Null and empty texts have no words; a text longer than a block is a block of its own.
Other columns are kept as they are, but for columns named ``n_words`` or ``n_removed``, which are
replaced.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm import blocks as B

WINDOW, ROUNDS = 50, 2
_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)  # of the two hashes of windows
RUN = np.uint64(40)  # a run's length stands above its word's name


class Symbols:
    """A block's symbols: name, whether it may stand elsewhere, text, stretch (first and last word).

    A stretch that depends on a text's begin or end reaches one word beyond it.
    """

    def __init__(self, names: np.ndarray, first: np.ndarray):
        n = len(names)
        self.doc = np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first))
        self.lo, self.hi = (first[:-1] - 1).astype(np.int32), first[1:].astype(np.int32)
        self.name, self.live, self.round = names, names > 0, 0
        self.left = self.right = np.arange(n, dtype=np.int32)
        self.same = self.doc[1:] == self.doc[:-1]
        self._join(self.same & self.live[1:] & (names[1:] == names[:-1]), lambda head, k: names[head] + ((k - 1).astype(np.uint64) << RUN))

    def _join(self, glue: np.ndarray, name) -> None:
        """Symbols that are glued become one; those that live grow by their neighbours' stretches, the others stay as they were."""
        n = len(self.name)
        if not n:
            return
        head = np.flatnonzero(np.concatenate(([True], ~glue)))
        tail = np.concatenate((head[1:], [n])) - 1
        before, after = np.empty(n, np.int32), np.empty(n, np.int32)
        before[0], before[1:] = self.lo[self.doc[0]], np.where(self.same, self.left[:-1], self.lo[self.doc[1:]])
        after[-1], after[:-1] = self.hi[self.doc[-1]], np.where(self.same, self.right[1:], self.hi[self.doc[:-1]])
        live = self.live[head]
        left, right = np.where(live, before[head], self.left[head]), np.where(live, after[tail], self.right[tail])
        names = self.name[head]
        many = np.flatnonzero(tail > head)
        names[many] = name(head[many], (tail - head + 1)[many])
        self.left, self.right, self.name, self.live, self.doc = left, right, names, live, self.doc[head]
        self.same = self.doc[1:] == self.doc[:-1]

    def pairs(self) -> np.ndarray:
        """Where a left symbol begins a pair in the next round."""
        side = (B.mix(self.name ^ np.uint64((self.round + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> np.uint64(63)).astype(bool)
        return self.same & self.live[1:] & self.live[:-1] & ~side[:-1] & side[1:]

    def join(self, glue: np.ndarray, told: np.ndarray) -> None:
        """Joins the pairs of ``glue`` under the names that their owners gave, 0 for those that are alone."""
        self.round += 1
        at = np.flatnonzero(glue)
        new, heads = np.zeros(len(self.name), np.uint64), np.ones(len(self.name), bool)
        new[at] = np.where(told > 0, told << np.uint64(3) | np.uint64(self.round), 0)
        heads[at + 1] = False
        place = (np.cumsum(heads) - 1)[at]
        self._join(glue, lambda head, k: new[head])
        self.live[place[told == 0]] = False  # after the joining, for which they lived


def _ask(kind: int, no: int, buckets: int, key: np.ndarray, parts) -> list[tuple]:
    """Rows that ask the owners of the keys, which are in the order of their buckets; ``parts`` makes the arrays of a slice."""
    cut = np.searchsorted(B.bucket_of(key, buckets), np.arange(buckets + 1))
    return [(kind, no, b, B.pack(*parts(slice(i, j)))) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if j > i]


def _several(doc: np.ndarray, place: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the distinct things, the first of each being ``at``, stand in two texts of the block."""
    out = np.zeros(len(at), bool)
    out[place[doc != doc[at][place]]] = True
    return out


def ask_words(block: B.Block, no: int, buckets: int) -> tuple[bytes, list[tuple]]:
    """Each word's place among the block's distinct words, with the ids and where texts begin; and rows that ask for names."""
    s, e, h, first = block.words()
    keys, at, place = np.unique(h, return_index=True, return_inverse=True)
    data, size = block.buf.tobytes(), (e - s)[at]
    several = _several(np.repeat(np.arange(len(block)), np.diff(first)), place, at)
    texts = [data[i:j] for i, j in zip(s[at].tolist(), e[at].tolist())]
    rows = _ask(1, no, buckets, keys, lambda x: (B.narrow(size[x]), np.frombuffer(b"".join(texts[x]), np.uint8), np.packbits(several[x])))
    return B.pack(block.doc_id, first, B.planes(place)), rows


class Reader:
    """What a block knows after some rounds; asks and answers are in the order of the distinct keys."""

    def __init__(self, places: bytes, buckets: int, answers: list[np.ndarray]):
        self.doc_id, self.first, place = B.unpack(places)
        place = B.unplanes(place)
        self.buckets = buckets
        self.names = (answers[0] << np.uint64(3))[place] if len(place) else np.zeros(0, np.uint64)
        self.symbols = Symbols(self.names, self.first)
        for got in answers[1:]:
            glue, *_, place = self._pairs()
            self.symbols.join(glue, got[place])

    def _pairs(self):
        y = self.symbols
        glue = y.pairs()
        at = np.flatnonzero(glue)
        a, b = y.name[at], y.name[np.minimum(at + 1, len(y.name) - 1)]
        keys, first, place = np.unique(B.mix(a * np.uint64(0xD6E8FEB86659FD93) + B.mix(b)), return_index=True, return_inverse=True)
        return glue, keys, a, b, first, y.doc[at], place

    def ask_pairs(self, no: int) -> list[tuple]:
        _, keys, a, b, first, doc, place = self._pairs()
        several, a, b = _several(doc, place, first), a[first], b[first]
        return _ask(1, no, self.buckets, keys, lambda x: (B.planes8(a[x]), B.planes8(b[x]), np.packbits(several[x])))

    def windows(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows of shared symbols only: where they begin, two hashes and the text's number."""
        y, first, n = self.symbols, self.first, len(self.names)
        out = np.zeros(n + 1, np.int64)
        alone = ~y.live & (y.right - y.left < window)
        frm, to = np.maximum(y.right[alone] - window + 1, 0), y.left[alone]
        ok = frm <= to  # a stretch that leaves its text only rules out windows that do so too
        out += np.bincount(frm[ok], minlength=n + 1) - np.bincount(to[ok] + 1, minlength=n + 1)
        free = np.cumsum(out[:-1]) == 0
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        at, h = np.flatnonzero(free & (np.arange(n) + window <= first[1:][doc])), []
        for k, p in enumerate(_BASES):
            c = np.zeros(n + 1, np.uint64)
            np.cumsum(B.mix(self.names + np.uint64(k * 0x9E3779B97F4A7C15)) * B.powers(p, n), out=c[1:])
            h.append(B.mix((c[at + window] - c[at]) * B.powers(B.inverse(p), n)[at]))
        return at, h[0], h[1], doc[at]


def _named(hit: np.ndarray, place: np.ndarray, sizes: list[int], buckets: int, bucket: int) -> list[np.ndarray]:
    """Names of what is hit, 1 and up, no two alike in all buckets; 0 for the rest."""
    name = np.where(hit, np.cumsum(hit) * buckets + bucket - buckets + 1, 0)[place]
    cut = np.cumsum([0, *sizes])
    return [B.narrow(name[i:j]) for i, j in zip(cut[:-1], cut[1:])]


def name_words(buckets: int):
    def reply(got, bucket: int) -> list[np.ndarray]:
        known: dict[bytes, int] = {}
        places, several = [], []
        for size, text, more in got:
            cut, text = np.concatenate(([0], np.cumsum(size, dtype=np.int64))).tolist(), text.tobytes()
            places.append(np.array([known.setdefault(text[i:j], len(known)) for i, j in zip(cut[:-1], cut[1:])], np.int64))
            several.append(np.unpackbits(more, count=len(size)).astype(bool))
        place = np.concatenate(places)
        hit = (np.bincount(place, minlength=len(known)) > 1) | (np.bincount(place, np.concatenate(several), len(known)) > 0)
        return _named(hit, place, [len(p) for p in places], buckets, bucket)

    return reply


def name_pairs(buckets: int):
    def reply(got, bucket: int) -> list[np.ndarray]:
        a, b = [B.unplanes8(g[0]) for g in got], [B.unplanes8(g[1]) for g in got]
        several = np.concatenate([np.unpackbits(g[2], count=len(x)).astype(bool) for g, x in zip(got, a)])
        kinds, place = distinct_windows(np.concatenate(a), np.concatenate(b))
        hit = (np.bincount(place, minlength=len(kinds)) > 1) | (np.bincount(place, several, len(kinds)) > 0)
        return _named(hit, place, [len(x) for x in a], buckets, bucket)

    return reply


def distinct_windows(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A window of each kind, in order, and each window's kind."""
    order = np.lexsort((h2, h1))
    a, b = h1[order], h2[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(order)]
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return order[new], place


def earliest(got):
    h1, h2, d = (np.concatenate([g[i] for g in got]) for i in range(3))
    begin = np.concatenate(([0], np.cumsum([len(g[0]) for g in got])))
    kinds, place = distinct_windows(h1, h2)
    least = np.full(len(kinds), B.NO_ID, np.int64)
    np.minimum.at(least, place, d.astype(np.int64))
    return [least[place[i:j]] for i, j in zip(begin[:-1], begin[1:])]


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with the words of repeated windows taken out of ``text``, kept words joined by one space.

    Texts with nothing to take out are joined so as well.  Adds ``n_words`` and ``n_removed``.
    """
    spark = docs.sparkSession
    shared, new = B.Shared(spark, "substring-dedup"), ("n_words", "n_removed")
    carry = [c for c in docs.columns if c not in (doc_id, text, *new)]
    rows = B.pair(docs, doc_id, text, carry)
    size = B.volume(rows)
    buckets = B.n_buckets(spark, size)
    schema, names = B.paired(docs, carry, *new), None

    def states(batches):
        for seq, block in enumerate(B.blocks(batches)):
            places, asked = ask_words(block, B.task_block(seq), buckets)
            batch = B.rows_batch([(0, B.task_block(seq), -1, places), *asked])
            yield batch.append_column("texts", pa.array([block.pack()] + [None] * len(asked), pa.binary()))

    table = shared.write_dealt(rows.mapInArrow(states, B.BLOCK_SCHEMA + ", texts binary"), "texts", B.tasks(spark, size), "kind")
    texts, asked = table.where("kind = 0"), table.where("kind = 1").select("kind", "block", "bucket", "payload")
    places = texts.select("block", "payload")

    def reader(left: pa.Table, right: pa.Table, levels: int) -> tuple[int, Reader, dict[int, np.ndarray]]:
        got: dict[int, list] = {}
        for which, b, p in zip(*(right.column(c).to_pylist() for c in ("which", "bucket", "payload"))):
            got.setdefault(which, []).append((b, B.unpack(p)[0]))
        whole = {w: B.joined([x for _, x in sorted(v, key=lambda x: x[0])], np.uint64) for w, v in got.items()}
        known = [whole.get(w, np.zeros(0, np.uint64)) for w in range(levels)]
        return left.column("block")[0].as_py(), Reader(left.column("payload")[0].as_py(), buckets, known), whole

    def ask_pairs(levels: int):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            no, r, _ = reader(left, right, levels)
            return pa.Table.from_batches([B.rows_batch(r.ask_pairs(no))])

        return run

    def ask_windows(left: pa.Table, right: pa.Table) -> pa.Table:
        no, r, _ = reader(left, right, rounds + 1)
        _, h1, h2, doc = r.windows(window)
        kinds, place = distinct_windows(h1, h2)
        least = np.full(len(kinds), B.NO_ID, np.int64)
        np.minimum.at(least, place, r.doc_id[doc])
        return pa.Table.from_batches([B.rows_batch(B.asks(2, no, buckets, h1[kinds], h2[kinds], least))])

    def kept(left: pa.Table, right: pa.Table) -> pa.Table:
        _, r, whole = reader(left, right, rounds + 1)
        block, first = B.Block.unpack(left.column("texts")[0].as_py()), r.first
        at, h1, h2, doc = r.windows(window)
        _, place = distinct_windows(h1, h2)
        again = at[whole[rounds + 1].view(np.int64)[place] < block.doc_id[doc]] if len(at) else at
        cover = np.zeros(len(r.names) + 1, np.int64)
        cover += np.bincount(again, minlength=len(cover)) - np.bincount(again + window, minlength=len(cover))
        gone = np.cumsum(cover[:-1]) > 0
        removed = B.per_word(gone.astype(np.int64), first)
        out = []
        for i in range(len(block)):
            words = (block.text(i) or b"").split()
            if removed[i]:
                words = [w for w, x in zip(words, gone[first[i] : first[i + 1]].tolist()) if not x]
            out.append(b" ".join(words))
        along = {"carried": block.along(schema["carried"].dataType)} if carry else {}
        return pa.table({"doc_id": B.ids_out(block.doc_id), "text": pa.array(out, pa.binary()).cast(pa.string()), **along, "n_words": np.diff(first), "n_removed": removed})

    for level in range(rounds + 2):
        if level == 0:
            found = B.answer(asked, name_words(buckets), size, numbered=True)
        elif level <= rounds:
            found = B.answer(B.by_block(places, names, ask_pairs(level), B.BLOCK_SCHEMA, size), name_pairs(buckets), size, numbered=True)
        else:
            found = B.answer(B.by_block(places, names, ask_windows, B.BLOCK_SCHEMA, size), earliest, size)
        if level <= rounds:
            found = shared.write(found, f"names-{level}", few=True)
        found = found.withColumn("which", F.lit(level))
        names = found if names is None else names.unionByName(found)
    found = B.by_block(texts.select("block", "payload", "texts"), names, kept, schema, size)
    return B.unpair(found, docs, doc_id, text, carry, *new)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(B.read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = {"op3_substring_dedup": """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) AS h
  FROM w, LATERAL (SELECT unnest(range(1, len(words) - 48)) AS i)
), first_doc AS (SELECT h, min(doc_id) AS d FROM win GROUP BY h HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM win JOIN first_doc USING (h) WHERE d < doc_id),
gone AS (SELECT doc_id, list(i) AS g FROM hit GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN g IS NULL THEN words ELSE list_transform(list_filter(range(1, len(words) + 1), lambda x: NOT list_contains(g, x)), lambda x: words[x]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""}
QUERIES = {"op3_substring_dedup": op3_substring_dedup}
