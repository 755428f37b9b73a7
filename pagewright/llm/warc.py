"""WARC archives: writing pages as records, and a sequential reader.

Every record is one gzip member. The reader takes an archive member by member with incremental decompression, frames
the block by Content-Length, and checks block and payload digests while the bytes pass; a record is never held whole
unless its payload is asked for.

Of records with equal payloads of at least `min_revisit` bytes the one with the largest id is a `response`, the others
are `revisit` records without payload that refer to it. Shorter payloads are always responses.

Defined results: a null payload is empty; a null URL leaves the header out; with a null id a row is a response unless
another row with an id has its payload; repeated rows with the largest id are all responses; other columns are
ignored; an empty table gives no archive and no rows. A digest or a frame that doesn't fit raises `WarcError`.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes that the headers of a record, or of HTTP in it, may have.
HEADERS = 1 << 20
#: An archive file is closed beyond this size, and a task goes on with another.
ROLL_BYTES = 256 << 20
CHUNK = 1 << 16
DATE = "2026-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


class WarcError(ValueError):
    """An archive that isn't framed as its headers say, or a digest that doesn't fit."""


def _label(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def record(kind: str, headers: dict[str, str], block: bytes, level: int = 6) -> bytes:
    """One record as a gzip member."""
    lines = [f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"WARC-Block-Digest: {_label(hashlib.sha1(block).digest())}", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def page_record(key: int | None, url: str | None, payload: bytes, refers: int | None, revisit: bool) -> bytes:
    """The record of one page; a revisit carries the length and digest of the payload that it doesn't repeat."""
    headers = {"WARC-Record-ID": f"<urn:x-page:{'null' if key is None else key}>", "WARC-Date": DATE, "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": _label(hashlib.sha1(payload).digest()), "X-Payload-Length": str(len(payload))}
    if url is not None:
        headers["WARC-Target-URI"] = quote(url, safe=":/?#[]@!$&'()*+,;=%~-._")
    if revisit:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:x-page:{refers}>"}
    return record("revisit" if revisit else "response", headers, _HTTP + (b"" if revisit else payload))


class Members:
    """The gzip members of a stream, decompressed piece by piece."""

    def __init__(self, stream) -> None:
        self.stream, self.raw, self.at = stream, b"", 0

    def more(self) -> bool:
        if not self.raw:
            self.raw = self.stream.read(CHUNK)
        return bool(self.raw)

    def pieces(self) -> Iterator[bytes]:
        """The content of the next member; afterwards the stream stands at the member after it."""
        d = zlib.decompressobj(31)
        while not d.eof:
            if not self.more():
                raise WarcError("the archive ends within a record")
            took = len(self.raw)
            piece = d.decompress(self.raw, CHUNK)
            self.raw = d.unused_data if d.eof else d.unconsumed_tail
            self.at += took - len(self.raw)
            if piece:
                yield piece


def _number(urn: str | None) -> int | None:
    name = (urn or "").rpartition(":")[2].rstrip(">")
    return int(name) if name.lstrip("-").isdigit() else None


def read_records(stream, payloads: bool = False) -> Iterator[dict]:
    """The records of an archive, in order, each checked against its headers. Whatever is wrong with an archive is a
    `WarcError`; the records before it have been given by then."""
    records = _records(stream, payloads)
    while True:
        try:
            record = next(records)
        except StopIteration:
            return
        except WarcError:
            raise
        except (zlib.error, KeyError, ValueError, EOFError, OverflowError) as e:
            raise WarcError(f"{type(e).__name__}: {e}") from e
        yield record


def _records(stream, payloads: bool) -> Iterator[dict]:
    members = Members(stream)
    while members.more():
        begin = members.at
        pieces = members.pieces()
        head = b""
        while b"\r\n\r\n" not in head:
            piece = next(pieces, None)
            if piece is None:
                raise WarcError("a record without end of headers")
            head += piece
            if len(head) > HEADERS and b"\r\n\r\n" not in head[: HEADERS + 4]:
                raise WarcError("headers that are too long")
        head, _, rest = head.partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8").split("\r\n")
        if not version.startswith("WARC/"):
            raise WarcError(f"not a record: {version[:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        left = int(headers["content-length"])
        if left < 0:
            raise WarcError("a length below zero")
        block, body, before, kept, size, tail = hashlib.sha1(), hashlib.sha1(), b"", [], 0, b""
        inside = not headers.get("content-type", "").startswith("application/http")  # else the payload follows the HTTP headers
        while True:
            mine, rest = rest[:left], rest[left:]
            left -= len(mine)
            tail += rest
            block.update(mine)
            if not inside:
                before += mine
                if b"\r\n\r\n" in before:
                    inside, mine = True, before.partition(b"\r\n\r\n")[2]
                elif len(before) > HEADERS:
                    raise WarcError("HTTP headers that are too long")
                else:
                    mine = b""
            body.update(mine)
            size += len(mine)
            if payloads:
                kept.append(mine)
            rest = next(pieces, None)
            if rest is None:
                break
        if left or tail != b"\r\n\r\n":
            raise WarcError("a block that isn't as long as its header says")
        if headers.get("warc-block-digest", _label(block.digest())) != _label(block.digest()):
            raise WarcError("a block digest that doesn't fit")
        kind, stated = headers.get("warc-type"), headers.get("warc-payload-digest")
        if kind != "revisit" and stated and stated != _label(body.digest()):
            raise WarcError("a payload digest that doesn't fit")
        digest = base64.b32decode(stated.removeprefix("sha1:")) if stated else body.digest()
        yield {"record_id": headers.get("warc-record-id"), "key": _number(headers.get("warc-record-id")), "record_type": kind, "target_uri": headers.get("warc-target-uri"), "payload_bytes": int(headers.get("x-payload-length", size)) if kind == "revisit" else size, "payload_digest": digest.hex(), "refers_to": _number(headers.get("warc-refers-to")), "offset": begin, "length": members.at - begin, "payload": b"".join(kept) if payloads else None}


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = 1000) -> DataFrame:
    """Write the table's rows as archives below `folder`; returns the stored list of archives (path, n_records, n_bytes).

    Only the digests of payloads that occur more than once are joined back; that table is written first, so that its
    size is known when the join is planned: it is broadcast while small, and else joined by digest. A file gets its
    name when it is whole, and counts only if the task that wrote it did, so a lost executor leaves no wrong row."""
    spark = common.ship(pages.sparkSession)
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).alias("u"), body.alias("b")).withColumn("d", F.sha1("b")).withColumn("n", F.octet_length("b"))
    repeated = rows.filter(F.col("n") >= min_revisit).groupBy("d").agg(F.max("k").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1 and first is not null").select("d", "first")
    where = common.scratch(spark, "warc-repeated")
    repeated.write.parquet(where)
    revisit = F.col("first").isNotNull() & ~F.col("k").eqNullSafe(F.col("first"))
    planned = rows.join(spark.read.parquet(where), "d", "left").select("k", "u", "b", F.when(revisit, F.col("first")).alias("r"), revisit.alias("v"))

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        out = path = None
        n = size = 0

        def close():
            out.close()
            store.move(f"{root}/.{path}", f"{root}/{path}")
            return pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([n], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

        for b in batches:
            for k, u, data, r, v in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    store.create_dir(root, recursive=True)
                    path, n, size = f"pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/.{path}", compression=None)  # the records are compressed, one by one
                n += 1
                size += out.write(page_record(k, u, data, r, v))
                if size >= ROLL_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    manifest = f"{folder.rstrip('/')}/manifest"
    planned.mapInArrow(run, "path string, n_records long, n_bytes long").write.parquet(manifest)
    common.discard(spark, where)
    return spark.read.parquet(manifest)


FIELDS = "record_id string, key long, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long, offset long, length long, payload binary, error string"


def read(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """All records of the archives that the folder's list names: one task per archive, in its order. A damaged archive
    gives the records before the damage, and one row of type `error` that names the archive and what is wrong."""
    common.ship(spark)
    listed = spark.read.parquet(f"{folder.rstrip('/')}/manifest").select("path")
    names = [x.split()[0] for x in FIELDS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in FIELDS.split(", ")])

    def run(batches):
        store, root = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{path}", compression=None) as stream:
                    part, held = [], 0
                    records = read_records(stream, payloads)
                    while True:
                        try:
                            r = next(records, None)
                        except WarcError as e:
                            part.append({"record_type": "error", "target_uri": path, "error": str(e)})
                            r = None
                        if r is None:
                            break
                        part.append(r)
                        held += len(r["payload"] or b"")
                        if len(part) >= 5000 or held >= 16 << 20:
                            yield pa.RecordBatch.from_pylist(part, schema)
                            part, held = [], 0
                    yield pa.RecordBatch.from_pylist(part, schema)

    tasks = max(1, listed.count())  # a count of archives, not of rows
    return listed.repartition(tasks).mapInArrow(run, FIELDS).select(*names)
