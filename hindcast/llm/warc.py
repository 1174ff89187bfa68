"""WARC archives and a normaliser of monolithic gzip.

``write_archives`` writes records as whole-file gzip streams, as a plain compressor would.
``normalise`` inflates such a stream once, in pieces, rewrites every record as a gzip member of its
own and puts a sidecar index, a JSON line a record, beside it.  ``read_records`` then opens single
members by offset.

Payloads that are equal and ``REVISIT_BYTES`` long or longer are stored once, under the least page
id; the others are revisits, which carry the digest and length but no payload.  A null page counts
as empty, a null ``page_id`` as larger than all others; rows with equal ids and payloads are of one
type.  A null url is written as ``about:blank``.  A page is held whole while its record is written or
read, whatever its length.  Other columns are left out.  An empty table gives no archives and no rows.
Zeros after a stream's last member are padding; a stream that ends within a member is an error.

A task that runs again writes files of new names; only files named in the table that a finished job
has written are read.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm import blocks as B

REVISIT_BYTES, ARCHIVE_BYTES, PIECE = 100, 32 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"
FILES = "path string, records long, bytes long"
INDEX = "path string, offset long, length long, page_id long, record_type string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _fs(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _id(page: int | None) -> str:
    return f"<urn:x-page:{'none' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str = DATE) -> bytes:
    """One WARC record, up to and with the two line ends after its block."""
    at = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = [f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_id(page)}", f"WARC-Date: {date}", f"WARC-Target-URI: {at}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if first is None:
        block += payload
        head.append("Content-Type: application/http; msgtype=response")
    else:
        head += [f"WARC-Refers-To: {_id(first)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "Content-Type: application/http; msgtype=response"]
    return ("WARC/1.1\r\n" + "\r\n".join([*head, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def header(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _page(urn: str | None) -> int | None:
    n = (urn or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(n) if n.lstrip("-").isdigit() else None


def _name() -> str:
    from pyspark import TaskContext

    t = TaskContext.get()
    return f"part-{t.partitionId():05d}-{t.taskAttemptId()}-{uuid.uuid4().hex[:8]}"


def write_archives(root: str, size: int = ARCHIVE_BYTES):
    """Rows of page_id, url, html, digest and first to rows of ``FILES``; each file is one gzip stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _fs(root)
        fs.create_dir(folder, recursive=True)
        out, path, held, n = None, "", 0, 0

        def close():
            out.write(z.flush())
            out.close()
            return pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [held]})

        for b in batches:
            html = b.column(2).cast(pa.binary())
            for i in range(b.num_rows):
                if out is None:
                    path, held, n, z = f"{root}/{_name()}.warc.gz", 0, 0, zlib.compressobj(1, wbits=31)
                    out = fs.open_output_stream(f"{folder}/{path.rpartition('/')[2]}", compression=None)
                data = record(b.column(0)[i].as_py(), b.column(1)[i].as_py(), html[i].as_py() or b"", b.column(3)[i].as_py(), b.column(4)[i].as_py())
                out.write(z.compress(data))
                held, n = held + len(data), n + 1
                if held >= size:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and bytes of each record of an inflated archive that comes in pieces."""
    held = bytearray()
    pieces = iter(pieces)

    def more() -> bool:
        piece = next(pieces, None)
        if piece is not None:
            held.extend(piece)
        return piece is not None

    while True:
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("the archive ends within a record's header")
                return
        head = header(bytes(held[:end]))
        size = end + 4 + int(head["content-length"]) + 4
        while len(held) < size:
            if not more():
                raise ValueError("the archive ends within a record")
        yield head, bytes(held[:size])
        del held[:size]


def inflate(stream, piece: int = PIECE) -> Iterator[bytes]:
    """The contents of a gzip stream of any number of members; zeros after a member are padding."""
    z, begun = zlib.decompressobj(31), False
    while data := stream.read(piece):
        while data:
            if not begun:
                data = data.lstrip(b"\0")
                if not data:
                    break
                begun = True
            yield z.decompress(data, piece)
            while z.unconsumed_tail:
                yield z.decompress(z.unconsumed_tail, piece)
            data = z.unused_data
            if z.eof:
                z, begun = zlib.decompressobj(31), False
    if begun:
        raise ValueError("the archive ends within a gzip member")


def normalise_archives(root: str):
    """Rows with a path to rows of ``INDEX``; archive and sidecar go to ``root``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _fs(root)
        fs.create_dir(folder, recursive=True)
        for b in batches:
            for source in b.column("path").to_pylist():
                name, at, rows = _name(), 0, []
                src, inner = _fs(source)
                with src.open_input_stream(inner, compression=None) as stream, fs.open_output_stream(f"{folder}/{name}.warc.gz", compression=None) as out:
                    for head, data in split_records(inflate(stream)):
                        z = zlib.compressobj(6, wbits=31)
                        member = z.compress(data) + z.flush()
                        out.write(member)
                        rows.append({"path": f"{root}/{name}.warc.gz", "offset": at, "length": len(member), "page_id": _page(head["warc-record-id"]), "record_type": head["warc-type"]})
                        at += len(member)
                with fs.open_output_stream(f"{folder}/{name}.index.jsonl", compression=None) as side:
                    side.write("".join(json.dumps(r | {"path": f"{name}.warc.gz"}) + "\n" for r in rows).encode())
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string())]))

    return run


def read_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``INDEX`` to rows of ``RECORDS``; a response's payload must have the digest it is filed under."""
    path, file = None, None
    for b in batches:
        rows = []
        for r in b.select(["path", "offset", "length"]).to_pylist():
            if r["path"] != path:
                path = r["path"]
                fs, inner = _fs(path)
                file = fs.open_input_file(inner)
            data = zlib.decompress(file.read_at(r["length"], r["offset"]), 31)
            head, _, block = data.partition(b"\r\n\r\n")
            head = header(head)
            payload = block[: int(head["content-length"])].partition(b"\r\n\r\n")[2] if head["warc-type"] == "response" else None
            digest = head["warc-payload-digest"].partition(":")[2]
            if payload is not None and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(head["x-payload-length"])):
                raise ValueError(f"{path} at {r['offset']}: the payload is not the one its header names")
            rows.append((_page(head["warc-record-id"]), head["warc-target-uri"], int(head["x-payload-length"]), digest, head["warc-type"], _page(head.get("warc-refers-to")), payload))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = [x.split()[0] for x in RECORDS.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], names)


def archive_pages(pages: DataFrame, shared: B.Shared, page_id: str = "page_id", url: str = "url", html: str = "html", revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Writes monolithic archives of ``pages`` below ``shared``; rows of ``FILES``."""
    html_ = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), html_.alias("html"), F.sha2(html_, 256).alias("digest"))
    long = rows.where(F.octet_length("html") >= revisit_bytes)
    least = shared.write(long.groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1").drop("n"), "least", few=True)
    first = F.when(F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least")), F.col("least"))
    small = rows.where(F.octet_length("html") < revisit_bytes).withColumn("least", F.lit(None).cast("long"))  # alike or not, these meet nothing
    rows = B.meet(long, least, ["digest"], ["page_id"], "left").unionByName(small).select("page_id", "url", "html", "digest", first.alias("first"))
    return shared.write(rows.mapInArrow(write_archives(shared.path("raw")), FILES), "raw-files")


def normalise(files: DataFrame, shared: B.Shared) -> DataFrame:
    """Normalises archives, one gzip member a record, below ``shared``; rows of ``INDEX``."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = files.select("path").repartition(n, "path").mapInArrow(normalise_archives(shared.path("normal")), INDEX)
    return shared.write(out, "index", few=True)


def read_sidecars(spark: SparkSession, shared: B.Shared) -> DataFrame:
    """Rows of ``INDEX`` from the sidecars of all archives that ``normalise`` wrote below ``shared``, those of tasks that ran again included."""
    rows = spark.read.schema(INDEX).json(f"{shared.path('normal')}/*.index.jsonl")
    return rows.withColumn("path", F.concat(F.lit(f"{shared.path('normal')}/"), "path"))


def read_records(index: DataFrame) -> DataFrame:
    """Rows of ``RECORDS``, each from its own member."""
    return index.select("path", "offset", "length").mapInArrow(read_members, RECORDS)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = B.Shared(spark, "warc")
    index = normalise(archive_pages(B.read(spark, sf_dir, "pages", "page_id", "url", "html"), shared), shared)
    shared.drop("raw")
    return read_records(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op5_warc": op5_warc}
SQL = {"op5_warc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS least FROM p WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> least THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> least THEN least END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""}
