"""Language ID: scripts narrow the languages, byte trigrams score words, Viterbi labels spans.

Words are runs of letters (Unicode categories L and M), ASCII lower-cased; digits, signs and dashes of
any alphabet stand between words.  A word's script is that of its first letter, by the ranges of code
points that Unicode names after a script.  For each language a table of smoothed log probabilities of
byte trigrams (a word with a space on each side) is learned from all of its documents, or, where it has more
than ``SAMPLE``, from the share of ids, by hash, that makes as many; of rows with equal ids the least text.  A word's scores are the sums over its trigrams, less the best, and ``FLOOR`` at
least; a language in which less than ``RARE`` of the words have the word's script is out, unless all
are.  The labels of a text's words are the best path under a penalty of ``SWITCH`` for each change of
language.

``lang_pred`` is the language of most words, those of a script that some language has before all
others (on a tie, the first by name), and ``score`` the share of the text's words that have its label
and such a script.  So a text in a script that no language has scores 0.  A null text, or one without
letters, is ``und`` with a score of 0.  A text of any length is read whole, within one task.  A null
``doc_id`` stays null, is not held out and is not learned from; repeated rows each give a row; other
columns are left out by ``identify`` and kept by ``identified``.  An empty table, or one to learn nothing
from, gives ``und`` for every row it has.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from hindcast.llm import blocks as B

SAMPLE, SWITCH, FLOOR, RARE, BITS = 4_000, 6.0, -8.0, 0.01, 16
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, spans array<struct<first_word:long,last_word:long,lang:string>>"

_CLEAN = np.full(256, 32, np.uint8)  # ASCII letters, lower-cased, and all bytes of longer characters; the rest is space
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)
LAST = 0x32400  # no letters beyond


@cache
def scripts() -> tuple[np.ndarray, list[str]]:
    """A number for each code point: 0 where it is no letter, else its script's; and the scripts' names.

    A letter's name begins with its script.  Marks, modifiers and forms of a width have that of the letter before them
    in the table, which only matters where a word begins with one.
    """
    names, out, now = ["", "LATIN"], np.zeros(LAST, np.uint16), 1
    of = {"LATIN": 1}
    for c in range(LAST):
        kind = unicodedata.category(chr(c))[0]
        if kind not in "LM":
            continue
        first = unicodedata.name(chr(c), "").split(" ")[0].split("-")[0]
        if kind == "L" and first not in ("", "MODIFIER", "FULLWIDTH", "HALFWIDTH", "FEMININE", "MASCULINE", "MICRO", "KELVIN", "ANGSTROM", "DOUBLE", "SCRIPT", "BLACK", "TURNED", "MATHEMATICAL"):
            if first not in of:
                of[first] = len(names)
                names.append(first)
            now = of[first]
        elif first in ("FEMININE", "MASCULINE", "MICRO"):
            now = 1
        out[c] = now
    return out, names


def letters(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``buf`` with all but letters as spaces, where characters beyond ASCII begin, and their scripts."""
    out, at = _CLEAN[buf], np.flatnonzero(buf >= 0xC2)
    if not len(at):
        return out, at, np.zeros(0, np.uint16)
    b = buf[at].astype(np.uint32)
    size = 2 + (b >= 0xE0) + (b >= 0xF0)
    code = b & (np.uint32(0xFF) >> (size + 1).astype(np.uint32))
    for k in range(1, 4):
        more = size > k
        code = np.where(more, code << 6 | (buf[np.minimum(at + k, len(buf) - 1)] & 0x3F), code)
    script = np.where(code < LAST, scripts()[0][np.minimum(code, LAST - 1)], 0)
    no = script == 0
    for k in range(4):
        out[(at[no & (size > k)] + k)] = 32
    return out, at, script


def trigrams(buf: np.ndarray) -> np.ndarray:
    """A table place for the trigram around each byte."""
    b = buf.astype(np.uint32)
    before, after = np.concatenate(([32], b[:-1])).astype(np.uint32), np.concatenate((b[1:], [32])).astype(np.uint32)
    return ((before << 16 | b << 8 | after) * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _words(block: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Letters, start and end of each word, its script, and where each text's words begin."""
    buf, wide, script = letters(block.buf)
    s, e = B.spans(buf)
    of = np.ones(len(s), np.uint16)
    far = np.flatnonzero(buf[s] >= 128)
    of[far] = script[np.searchsorted(wide, s[far])] if len(far) else 1
    return buf, s, e, of, np.searchsorted(s, block.begin)


class Model:
    """Languages by name, log probabilities (place, language) and, by script, which languages are candidates and if any is."""

    def __init__(self, langs: list[str], trigram_counts: np.ndarray, script_counts: np.ndarray):
        order = np.argsort(langs)
        self.langs = [langs[i] for i in order]
        c = trigram_counts[order].astype(np.float64) + 0.5
        self.log = np.ascontiguousarray(np.log(c / c.sum(1, keepdims=True)).T.astype(np.float32))
        share = script_counts[order] / np.maximum(script_counts[order].sum(1, keepdims=True), 1)
        use = (share >= RARE).T
        self.known = use.any(1)
        self.candidates = np.where(self.known[:, None], use, True)

    def scores(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray, script: np.ndarray) -> np.ndarray:
        out = np.zeros((len(s), len(self.langs)), np.float32)
        i = 0
        while i < len(s):
            j = max(i + 1, int(np.searchsorted(e, s[i] + B.SEGMENT, "right")))
            lo, hi = s[i], e[j - 1]
            at = trigrams(buf[max(lo - 1, 0) : hi + 1])[lo - max(lo - 1, 0) :][: hi - lo]
            for k in range(len(self.langs)):
                c = np.zeros(hi - lo + 1)
                np.cumsum(self.log[at, k], dtype=np.float64, out=c[1:])
                out[i:j, k] = c[e[i:j] - lo] - c[s[i:j] - lo]
            i = j
        out[~self.candidates[script]] = -np.inf
        if len(out):
            out -= out.max(1, keepdims=True)
        return np.maximum(out, FLOOR)


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word; texts go side by side, longest first."""
    n, size = scores.shape[1], np.diff(first)
    order = np.argsort(-size, kind="stable")
    longest = np.sort(-size)
    kind = np.min_scalar_type(n)
    came, best = np.zeros(scores.shape, bool), np.zeros(len(scores), kind)
    value = np.zeros((len(size), n), np.float32)
    begin = first[:-1][order]
    active = np.searchsorted(longest, -np.arange(size.max(initial=0)), "left")
    for t, k in enumerate(active.tolist()):
        at = begin[:k] + t
        v = value[:k]
        if t:
            top = v.argmax(1)
            jump = v[np.arange(k), top][:, None] - switch
            came[at] = jump > v
            best[at] = top
            v = np.maximum(v, jump)
        value[:k] = v + scores[at]
    labels, state = np.zeros(len(scores), kind), value.argmax(1).astype(kind)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = begin[:k] + t
        labels[at] = state[:k]
        state[:k] = np.where(came[at, state[:k]], best[at], state[:k])
    return labels


def label(model: Model | None, block: B.Block) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Language, score and spans of each text."""
    buf, s, e, script, first = _words(block)
    n = len(block)
    pred, score = np.full(n, "und", object), np.zeros(n)
    offsets, starts, ends, names = np.zeros(n + 1, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if model is not None and len(s):
        labels = viterbi(model.scores(buf, s, e, script), first).astype(np.int64)
        doc = np.repeat(np.arange(n), np.diff(first))
        tell = model.known[script]
        cell = doc * len(model.langs) + labels
        votes = np.bincount(cell[tell], minlength=n * len(model.langs)).reshape(n, -1)
        every = np.bincount(cell, minlength=n * len(model.langs)).reshape(n, -1)
        ok = every.sum(1) > 0
        count = np.where(votes.sum(1, keepdims=True) > 0, votes, every)
        pred[ok] = np.array(model.langs, object)[count.argmax(1)[ok]]
        score[ok] = votes.max(1)[ok] / every.sum(1)[ok]
        new = np.flatnonzero(np.concatenate(([True], (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1]))))
        starts, ends, names = (new - first[:-1][doc[new]]), (np.append(new[1:], len(s)) - 1 - first[:-1][doc[new]]), labels[new]
        offsets = np.searchsorted(doc[new], np.arange(n + 1)).astype(np.int32)
    lang = pa.array(np.array(model.langs, object)[names] if model is not None and len(names) else [], pa.string())
    spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), lang], ["first_word", "last_word", "lang"]))
    return pred, score, spans


def _label(model: Model | None, fold: int, of: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.blocks(batches):
            pred, score, spans = label(model, block)
            held = B.crc32(block.doc_id) % of == fold
            held &= block.doc_id != B.NO_ID
            yield pa.RecordBatch.from_arrays([B.ids_out(block.doc_id), pa.array(held), pa.array(pred, pa.string()), pa.array(score), spans], ["doc_id", "held_out", "lang_pred", "score", "spans"])

    return run


def _beside(model: Model | None, names: list[str], at: list[int]):
    """``at``: which column of a batch each of ``names`` is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, lo in B.within(b):
                pred, score, _ = label(model, block)
                mine = b.slice(lo, len(block))
                yield pa.RecordBatch.from_arrays([*(mine.column(c) for c in at), pa.array(pred, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return run


def _is_held(doc_id: Column, fold: int, of: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % of == fold


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", fold: int = 1, of: int = 3, sample: int = SAMPLE) -> Model | None:
    """A model of documents that have a language and whose crc32(id as text) modulo ``of`` is not ``fold``."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~_is_held(F.col("doc_id"), fold, of))
    n = rows.groupBy("lang").agg(F.count("*").alias("n__"))
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < F.lit(float(sample)) / F.col("n__") * float(1 << 31)
    rows = B.meet(rows, n, ["lang"], ["doc_id"]).where(share).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("doc_id", "text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(2).to_pylist(), object)
            for block, lo in B.within(b):
                buf, s, _, script, _ = _words(block)
                name = langs[lo : lo + len(block)]
                at, of_text = np.flatnonzero(buf != 32), trigrams(buf)
                text = np.searchsorted(block.begin, at, "right") - 1
                word = np.searchsorted(block.begin, s, "right") - 1
                for x in set(name.tolist()):
                    mine = name == x
                    got = found.setdefault(x, np.zeros((1 << BITS) + (1 << 16), np.int64))
                    got[: 1 << BITS] += np.bincount(of_text[at[mine[text]]], minlength=1 << BITS)
                    got[1 << BITS :] += np.bincount(script[mine[word]], minlength=1 << 16)
        for x, got in found.items():
            place = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(place), pa.string()), pa.array(place), pa.array(got[place])], ["lang", "place", "n"])

    # a row a language and place that was seen: bounded by the tables' size
    found = rows.mapInArrow(count, "lang string, place long, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    if not found.num_rows:
        return None
    langs, row = np.unique(np.array(found.column("lang").to_pylist(), object).astype(str), return_inverse=True)
    counts = np.zeros((len(langs), (1 << BITS) + (1 << 16)), np.int64)
    counts[row, found.column("place").to_numpy()] = found.column("n").to_numpy()
    return Model(langs.tolist(), counts[:, : 1 << BITS], counts[:, 1 << BITS :])


def identify(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text", fold: int = 1, of: int = 3) -> DataFrame:
    """Language, score and spans (first and last word, language) of each whole text."""
    return B.pair(docs, doc_id, text).mapInArrow(_label(model, fold, of), SCHEMA)


def identified(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` beside its columns; columns so named are replaced.  Nothing is shuffled.

    A text that is a string goes to the workers once, as the column that it is and as what is read.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rest = [c for c in keep if c != text or docs.schema[text].dataType != StringType()]
    at = [2 + rest.index(c) if c in rest else 1 for c in keep]
    rows = docs.select(F.lit(0).cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(rest)))
    schema = StructType([*(docs.schema[c] for c in keep), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return rows.mapInArrow(_beside(model, keep, at), schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = B.read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return identify(docs, learn(docs)).drop("spans")


QUERIES = {"op4_language_id": op4_language_id}
SQL: dict[str, str] = {}
