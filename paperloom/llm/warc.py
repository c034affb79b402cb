"""WARC archives: one gzip member a record, written and read sequentially.

Writing: each task streams its rows into archives in the shared folder and
starts a new one after ``ARCHIVE_BYTES``. An archive gets a name of its task
attempt and is moved into place when complete; the manifest of archives is
written as a table, so a retried or lost task leaves only files that nothing
names. Reading: archives are dealt to tasks by name and read in chunks through
an incremental zlib decompressor; records are framed by Content-Length, and
block and payload digests are verified.

Of records with equal payloads of at least ``REVISIT_BYTES``, that with the
largest page_id is the response, the others are revisits without payload.
Equal payloads are found by SHA-256 with pre-aggregation, so a payload that a
third of all pages share costs a row a task.

Defined cases: null html is an empty payload; a null url gives an empty target
and null page_ids stay null (they sort lowest as response); repeated rows with
the largest page_id are all responses; characters that a header line can't
hold are percent-encoded; an empty table gives no archives; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 16
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MANIFEST = "path string, records long, bytes long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class DigestError(ValueError):
    """A record whose bytes don't give the digest in its header."""


def _b32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def _line(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A whole record as one gzip member."""
    digest = hashlib.sha1(payload).digest()
    block = HTTP + (payload if refers_to is None else b"")
    name = "-" if page_id is None else str(page_id)
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {url}')}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": _line(url or ""),
        "WARC-Payload-Digest": _b32(digest),
        "WARC-Block-Digest": _b32(hashlib.sha1(block).digest()),
        "X-Page-ID": name,
        "X-Payload-Length": str(len(payload)),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "X-Refers-To-Page-ID": str(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    raw = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(raw.encode("utf-8")) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def members(stream):
    """The gzip members of a stream, each decompressed, one at a time."""
    unpack, parts, begun = zlib.decompressobj(31), [], False
    while chunk := stream.read(CHUNK):
        while chunk:
            parts.append(unpack.decompress(chunk))
            begun = True
            chunk = b""
            if unpack.eof:
                yield b"".join(parts)
                chunk, unpack, parts, begun = unpack.unused_data, zlib.decompressobj(31), [], False
    if begun:
        raise EOFError("the last gzip member is cut off")


def parsed(member: bytes) -> dict:
    """Header fields and block of one record, framed and verified."""
    head, _, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    out: dict = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(out["Content-Length"])
    block, end = rest[:n], rest[n:]
    if len(block) != n or end != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't frame the record")
    if _b32(hashlib.sha1(block).digest()) != out["WARC-Block-Digest"]:
        raise DigestError(out["WARC-Record-ID"])
    payload = block.partition(b"\r\n\r\n")[2]
    if out["WARC-Type"] == "response" and _b32(hashlib.sha1(payload).digest()) != out["WARC-Payload-Digest"]:
        raise DigestError(out["WARC-Record-ID"])
    return out | {"block": block, "payload": payload}


def with_revisits(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload and refers_to (null for responses)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    digest = F.when(F.length("payload") >= least, F.sha2("payload", 256)).alias("digest")
    shared = rows.select("page_id", digest).where("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("last"))
    shared = shared.where("n > 1").select("digest", "last")
    joined = rows.select("*", digest).join(shared, "digest", "left")
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")).alias("refers_to"))


def write(records: DataFrame, folder: str) -> DataFrame:
    """Write archives to ``folder``; the manifest, as a table."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        made, out, name, n, size = [], None, "", 0, 0

        def close():
            out.close()
            store.move(name + ".open", name)
            made.append((folder + "/" + name.rpartition("/")[2], n, size))

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, n, size = f"{path}/{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):04d}.warc.gz", 0, 0
                    out = store.open_output_stream(name + ".open", compression=None)
                data = record(row["page_id"], row["url"], row["payload"], row["refers_to"])
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], type=t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return cut(records.select("page_id", "url", "payload", "refers_to").mapInArrow(run, MANIFEST), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """Every record of the archives that a manifest names."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in RECORD.split(", ")]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                store, path = fs.FileSystem.from_uri(uri)
                rows, held = [], 0
                with store.open_input_stream(path, compression=None) as stream:
                    for member in members(stream):
                        x = parsed(member)
                        page = None if x["X-Page-ID"] == "-" else int(x["X-Page-ID"])
                        digest = base64.b32decode(x["WARC-Payload-Digest"][5:]).hex()
                        ref = int(x["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in x else None
                        rows.append((page, x["WARC-Target-URI"], int(x["X-Payload-Length"]), digest, x["WARC-Type"], ref, x["payload"]))
                        held += len(x["payload"])
                        if held > 8 << 20 or len(rows) >= 5000:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    tasks = max(1, manifest.count())
    return manifest.select("path").repartition(tasks, "path").mapInArrow(run, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """The contract's view: archives of ``pages``, written and read back."""
    folder = f"{shared_dir(pages.sparkSession)}/paperloom-{uuid.uuid4().hex}/warc"
    rows = read(write(with_revisits(pages), folder))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with p as (
  select page_id, coalesce(html, '') as html, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes from pages),
s as (
  select html, max(page_id) as last, count(*) as n from p where payload_bytes >= 1000 group by html)
select page_id, payload_bytes, sha1(p.html) as payload_digest,
       case when n > 1 and page_id <> last then 'revisit' else 'response' end as record_type,
       case when n > 1 and page_id <> last then last end as refers_to
from p left join s on p.html = s.html and p.payload_bytes >= 1000
"""
