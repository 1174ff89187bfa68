"""Packed blocks of texts, word hashes by prefix sums, and the exchange of keys between blocks.

A block is about ``BLOCK_BYTES`` of consecutive texts of one task.  Words are hashed without making
Python objects: with ``c`` the running sum of ``table[byte] * P**i`` modulo 2**64, the bytes
``s..e`` hash to ``(c[e] - c[s]) * P**-s``.  Keys are dealt to ``n`` buckets by range, so a block's
sorted keys split into one slice a bucket, and answers come back aligned with them.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import struct
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StringType, StructField, StructType

BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 1 << 14
BUCKET_BYTES, TASK_BYTES = 64 << 20, 128 << 20
FEW_ROWS, SALTS = 200_000, 64  # a lookup of no more rows is broadcast; hot keys are dealt over so many tasks
SEGMENT = 1 << 20
NO_ID = np.iinfo(np.int64).max  # stands for a null id: after all others
BLOCK_SCHEMA = "kind int, block long, bucket int, payload binary"

try:  # give large arrays back to the system at once, so that a reused worker is no larger than its task
    ctypes.CDLL(None).mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
except (OSError, AttributeError):
    pass

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32

_TABLE = np.random.default_rng(20240611).integers(0, 2**64, 256, dtype=np.uint64)
_P = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def powers(p: int, n: int) -> np.ndarray:
    """``p**0 .. p**(n-1)`` modulo 2**64."""
    have = _POWERS.get(p)
    if have is None or len(have) < n:
        have = np.full(max(n, SEGMENT + 4096), p, np.uint64)
        have[0] = 1
        _POWERS[p] = np.multiply.accumulate(have, out=have)
    return have[:n]


def inverse(p: int) -> int:
    return pow(p, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that scatters them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def pack(*arrays: np.ndarray) -> bytes:
    parts = [struct.pack("<I", len(arrays))]
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts += [a.dtype.str.encode().ljust(8), struct.pack("<Q", a.size), a.tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    (n,), at, out = struct.unpack_from("<I", raw), 4, []
    for _ in range(n):
        kind, (size,) = np.dtype(raw[at : at + 8].decode().strip()), struct.unpack_from("<Q", raw, at + 8)
        out.append(np.frombuffer(raw, kind, size, at + 16))
        at += 16 + size * kind.itemsize
    return out


def narrow(a: np.ndarray) -> np.ndarray:
    """The same non-negative numbers in the smallest unsigned type."""
    return a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))


def hashes(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Hashes of the sorted spans ``s..e`` of ``buf``, none of which overlap."""
    out, i = np.empty(len(s), np.uint64), 0
    while i < len(s):
        j = max(i + 1, int(np.searchsorted(e, s[i] + SEGMENT, "right")))
        seg, s0, e0 = buf[s[i] : e[j - 1]], s[i:j] - s[i], e[i:j] - s[i]
        c = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(_TABLE[seg] * powers(_P, len(seg)), out=c[1:])
        out[i:j] = mix((c[e0] - c[s0]) * powers(inverse(_P), len(seg) + 1)[s0] + (e0 - s0).astype(np.uint64) * np.uint64(_P))
        i = j
    return out


def spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of ``buf``."""
    edge = np.diff(SPACE[buf].view(np.int8), prepend=np.int8(1), append=np.int8(1))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


class Block:
    """Texts of a block: ``doc_id`` (``NO_ID`` for null), ``null`` and, in ``buf``, the texts, each with a line feed after it.

    ``carried`` holds what goes along with the texts unread, an Arrow array as a stream, or nothing.
    """

    def __init__(self, doc_id: np.ndarray, texts: list[bytes | None], carried: bytes = b""):
        self.doc_id, self.null = doc_id, np.array([t is None for t in texts], bool)
        self.length = np.array([len(t or b"") for t in texts], np.int64)
        self.buf = np.frombuffer(b"\n".join([t or b"" for t in texts] + [b""]), np.uint8)
        self.begin = np.concatenate(([0], np.cumsum(self.length + 1)))
        self.carried = carried

    def __len__(self) -> int:
        return len(self.doc_id)

    def text(self, i: int) -> bytes | None:
        return None if self.null[i] else self.buf[self.begin[i] : self.begin[i] + self.length[i]].tobytes()

    def words(self, lut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of each word, and where each text's words begin (one more than texts)."""
        buf = self.buf if lut is None else lut[self.buf]
        s, e = spans(buf)
        return s, e, hashes(buf, s, e), np.searchsorted(s, self.begin)

    def pack(self) -> bytes:
        return pack(self.doc_id, self.null, self.length, self.buf, np.frombuffer(self.carried, np.uint8))

    @classmethod
    def unpack(cls, data: bytes) -> Block:
        self = cls.__new__(cls)
        self.doc_id, self.null, self.length, self.buf, along = unpack(data)
        self.begin = np.concatenate(([0], np.cumsum(self.length + 1)))
        self.carried = along.tobytes()
        return self

    def along(self, kind: DataType) -> pa.Array:
        """What was carried, a value a text, as Spark takes back that type (sessions name one time zone in several ways)."""
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.ipc.open_stream(self.carried).read_all().column(0).combine_chunks().cast(to_arrow_type(kind))


def bound_batches(spark: SparkSession) -> None:
    """From here on the session's Arrow batches end at ``BLOCK_BYTES``, unless it has a limit of its own.

    Spark's 10,000 rows may be any number of bytes; the JVM doubles a column's memory until they fit and the worker
    holds them again, neither of which is of the heap.
    """
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(limit, None) is None:
        spark.conf.set(limit, str(BLOCK_BYTES))


def stream(arrays: list[pa.Array]) -> bytes:
    """Arrays as one Arrow stream; nothing for none."""
    if not arrays:
        return b""
    batch = pa.RecordBatch.from_arrays([pa.concat_arrays(arrays)], ["carried"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES, docs: int = BLOCK_DOCS) -> Iterator[Block]:
    """Blocks of about ``size`` bytes and ``docs`` texts at most, from batches of an id, a text and, if there is a third column, what is carried.

    A text longer than ``size`` ends its block and is held whole.
    """
    ids, texts, carried, held = [], [], [], 0
    for b in batches:
        key = b.column(0).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        text, begun = b.column(1).cast(pa.binary()), 0
        for i in range(0, len(key), 256):
            for k, t in enumerate(text.slice(i, 256).to_pylist()):
                ids.append(key[i + k])
                texts.append(t)
                held += len(t or b"") + 1
                if held >= size or len(ids) >= docs:
                    if b.num_columns > 2:
                        carried.append(b.column(2).slice(begun, i + k + 1 - begun))
                    yield Block(np.array(ids, np.int64), texts, stream(carried))
                    ids, texts, carried, held, begun = [], [], [], 0, i + k + 1
        if b.num_columns > 2 and begun < len(key):
            carried.append(b.column(2).slice(begun))
    if ids:
        yield Block(np.array(ids, np.int64), texts, stream(carried))


def within(b: pa.RecordBatch) -> Iterator[tuple[Block, int]]:
    """Blocks of one batch's ``doc_id`` and ``text``, each with its first row's place, so that its other columns can stay beside."""
    at = 0
    for block in blocks(iter([b.select(["doc_id", "text"])])):
        yield block, at
        at += len(block)


def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a block, with nothing but its texts."""
    for seq, block in enumerate(blocks(batches)):
        yield rows_batch([(0, task_block(seq), -1, block.pack())])


def task_block(seq: int) -> int:
    """A block's number: its task's partition and its place there."""
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 24) + seq


def planes(a: np.ndarray) -> np.ndarray:
    """The bytes of 32-bit numbers by significance, which packs better."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).ravel()


def unplanes(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a.reshape(4, -1).T).view("<u4").ravel()


def planes8(a: np.ndarray) -> np.ndarray:
    """``planes`` of 64-bit numbers."""
    return np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8).T).ravel()


def unplanes8(a: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(a.reshape(8, -1).T).view("<u8").ravel()


def per_word(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by text, of which text i has ``first[i]`` to ``first[i + 1]``."""
    kind = np.float64 if values.dtype.kind == "f" else np.int64
    if not len(values):
        return np.zeros(len(first) - 1, kind)
    out = np.add.reduceat(np.append(values.astype(kind, copy=False), kind(0)), first[:-1].astype(np.int64))
    return np.where(first[1:] > first[:-1], out, kind(0))


def ids_out(doc_id: np.ndarray) -> pa.Array:
    return pa.array(doc_id, pa.int64(), mask=doc_id == NO_ID)


def volume(texts: DataFrame) -> int:
    """Bytes of all of ``text``."""
    return texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first().n


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_buckets(spark: SparkSession, size: int = 0) -> int:
    """Four a shuffle partition, and more where one would stand for over ``BUCKET_BYTES`` of text, as a bucket is held whole."""
    return max(4 * partitions(spark), -(-size // BUCKET_BYTES))


def slices(keys: np.ndarray, n: int) -> np.ndarray:
    """Where the keys of each of ``n`` buckets begin among the sorted ``keys`` (n + 1 places)."""
    edges = np.array([-(-(i << 32) // n) << 32 for i in range(1, n)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)])).astype(np.int64)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def asks(kind: int, block: int, n: int, keys: np.ndarray, *more: np.ndarray) -> list[tuple]:
    """Rows that ask the owner of each of the sorted distinct ``keys``; ``more`` goes along by key."""
    cut = slices(keys, n)
    return [(kind, block, b, pack(keys[i:j], *(narrow(a[i:j]) if a.dtype.kind in "iu" else a[i:j] for a in more))) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:])) if j > i]


def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["kind", "block", "bucket", "payload"])


def tasks(spark: SparkSession, size: int) -> int:
    """As many tasks as the session shuffles to, and more where one would stand for over ``TASK_BYTES`` of text."""
    return max(partitions(spark), -(-size // TASK_BYTES))


def answer(asked: DataFrame, reply: Callable[..., list[np.ndarray]], size: int = 0, numbered: bool = False) -> DataFrame:
    """Answers by block and bucket.  ``reply`` gets, of one bucket, each block's arrays and gives an array for each.

    With ``numbered`` it gets the bucket's number too.

    Arrays beyond those are about the bucket itself: they stand under block -1.
    """

    def bucket(table: pa.Table) -> pa.Table:
        got = [unpack(p) for p in table.column("payload").to_pylist()]
        out = [pack(*a) if isinstance(a, tuple) else pack(a) for a in (reply(got, table.column("bucket")[0].as_py()) if numbered else reply(got))]
        extra = [-1] * (len(out) - len(got))
        no = pa.array(table.column("block").to_pylist() + extra, pa.int64())
        return pa.table({"block": no, "bucket": pa.array([table.column("bucket")[0].as_py()] * len(out), pa.int32()), "payload": pa.array(out, pa.binary())})

    n, spark = tasks(asked.sparkSession, size), asked.sparkSession
    return (asked.repartition(n, "bucket") if n > partitions(spark) else asked).groupBy("bucket").applyInArrow(bucket, "block long, bucket int, payload binary")


def combine(got: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a bucket, each asked key's place among them, and where each block's keys begin."""
    keys = np.concatenate([g[0] for g in got])
    distinct, place = np.unique(keys, return_inverse=True)
    return distinct, place, np.concatenate(([0], np.cumsum([len(g[0]) for g in got])))


def told(states: DataFrame, answers: DataFrame, use: Callable[[int, bytes, list[np.ndarray]], pa.Table], schema: str, size: int = 0) -> DataFrame:
    """``use`` gets each block's number, its state and all answers to it, in the order of its keys."""

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right.column("bucket").to_numpy(), kind="stable")
        got = right.column("payload").to_pylist()
        return use(left.column("block")[0].as_py(), left.column("payload")[0].as_py(), [unpack(got[i])[0] for i in order])

    return by_block(states, answers, one, schema, size)


def by_block(states: DataFrame, answers: DataFrame, use: Callable[[pa.Table, pa.Table], pa.Table], schema: str | StructType, size: int) -> DataFrame:
    """``use`` of each block's state and the answers to it."""
    n, spark = tasks(states.sparkSession, size), states.sparkSession
    deal = lambda df: df.repartition(n, "block") if n > partitions(spark) else df
    return deal(states).groupBy("block").cogroup(deal(answers).groupBy("block")).applyInArrow(use, schema)


def joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate([p.astype(kind) for p in parts]) if parts else np.zeros(0, kind)


class Shared:
    """A folder below the one in ``spark.checkpoint.dir``, which all executors share.

    Where that setting is missing, a temporary folder of this machine takes its place for a local master, as in
    tests; on a cluster that is an error.  The folder goes when the driver ends, or with ``drop``.
    """

    _made: dict[str, str] = {}

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            app = spark.sparkContext.applicationId
            base = Shared._made[app] = Shared._made.get(app) or f"file://{tempfile.mkdtemp(prefix='hindcast-')}"
        self.spark, self.root = spark, f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self.drop)

    def path(self, part: str) -> str:
        return f"{self.root}/{part}"

    def write(self, df: DataFrame, part: str, by: list[str] | None = None, few: bool = False) -> DataFrame:
        """Writes and rereads.  ``few``: small results of a shuffle, in a file for some 16 of its partitions but for two a core at least."""
        if few:
            df = df.coalesce(max(2 * self.spark.sparkContext.defaultParallelism, partitions(self.spark) // 16))
        w = df.write.option("compression", "none" if "payload" in df.columns else "zstd")
        (w.partitionBy(*by) if by else w).parquet(self.path(part))
        return self.spark.read.schema(df.schema).parquet(self.path(part))

    def write_dealt(self, df: DataFrame, part: str, n: int, *by: str) -> DataFrame:
        """Writes and rereads rows dealt by ``block`` to ``n`` buckets, in folders ``by`` a column, so that later meetings by block don't shuffle them."""
        name = f"{self.root.rpartition('/')[2]}_{part}".replace("-", "_")
        out = df.repartition(n, "block").write.partitionBy(*by).bucketBy(n, "block").format("parquet").option("compression", "none")
        out.option("path", self.path(part)).saveAsTable(name)
        return self.spark.table(name)

    def drop(self, part: str = "") -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.path(part) if part else self.root)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001  the session has ended; nothing else can be done then
            pass


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def pair(df: DataFrame, key: str, text: str, carry: list[str] | None = None) -> DataFrame:
    """An integer id and a text; with ``carry`` also those columns, as they are, in a struct for ``unpair``."""
    two = [F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")]
    return df.select(*two, *([F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried")] if carry else []))


def paired(like: DataFrame, carry: list[str], *new: str) -> StructType:
    """The schema of ``pair``'s columns and the longs ``new``."""
    rest = [StructField("carried", StructType([like.schema[c] for c in carry]))] if carry else []
    return StructType([StructField("doc_id", LongType()), StructField("text", StringType()), *rest, *(StructField(c, LongType()) for c in new)])


def unpair(found: DataFrame, like: DataFrame, key: str, text: str, carry: list[str], *new: str) -> DataFrame:
    """The columns of ``like`` but for those named as in ``new``, from ``doc_id``, ``text`` and ``carried`` of ``found``, then the columns ``new``."""
    own = {key: F.col("doc_id").cast(like.schema[key].dataType), text: F.col("text")}
    return found.select(*((own[c] if c in own else F.col("carried").getField(c)).alias(c) for c in like.columns if c in own or c in carry), *new)


def meet(many: DataFrame, one: DataFrame, keys: list[str], by: list[str], how: str = "inner") -> DataFrame:
    """``many`` with the row of ``one`` for its keys, of which ``one`` has no two alike.

    ``one`` is counted: up to ``FEW_ROWS`` rows it is broadcast.  Beyond that a key's rows are dealt over ``SALTS``
    tasks by the hash of ``by``, and ``one`` goes to those tasks that ask for it.
    """
    if one.count() <= FEW_ROWS:
        return many.join(F.broadcast(one), keys, how)
    salted = many.withColumn("salt__", F.pmod(F.xxhash64(*by), F.lit(SALTS)))
    wanted = salted.select(*keys, "salt__").distinct().join(one, keys)
    return salted.join(wanted, [*keys, "salt__"], how).drop("salt__")


def crc32(doc_id: np.ndarray) -> np.ndarray:
    """crc32 of each id as text; -1 for null."""
    import zlib

    return np.array([-1 if d == NO_ID else zlib.crc32(b"%d" % d) for d in doc_id.tolist()], np.int64)
