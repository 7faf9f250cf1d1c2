"""WARC archives as chunked record tables."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, staged

CHUNK_BYTES = 1 << 16
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
CHUNKS = "path string, record long, record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string, chunk int, chunk_bytes int, bytes_so_far long, digest_so_far string, data binary"


def _bare32(hexed: str) -> str:
    return base64.b32encode(bytes.fromhex(hexed)).decode()


def record_chunks(pages: DataFrame, *, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Rows ``_id, _url, n, digest, refers_to, chunk, data``: each record cut into chunks.

    Of records with equal payloads of ``min_bytes`` or more, the one with the largest key
    keeps the payload; for the others ``refers_to`` is that key and there is one chunk
    without data. Keys that tie as largest all keep theirs; a null key never is the
    largest. A payload is UTF-8 (or binary as it is), null: empty, which is one empty
    chunk. One aggregate finds the keys; hot payloads are combined before its shuffle, and
    Spark splits their join partitions.
    """
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    facts = pages.select(F.col(key).alias("_id"), F.col(url).cast("string").alias("_url"), raw.alias("_raw"), F.sha1(raw).alias("digest"), F.octet_length(raw).cast("long").alias("n"))
    largest = facts.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.max("_id").alias("_largest"))
    known = facts.join(largest, ["digest", "n"], "left")
    known = known.withColumn("refers_to", F.when(F.coalesce(F.col("_id") != F.col("_largest"), F.col("_largest").isNotNull()), F.col("_largest")))
    last = F.when(F.col("refers_to").isNotNull(), F.lit(0)).otherwise(F.greatest(F.lit(0), F.ceil(F.col("n") / chunk_bytes).cast("int") - 1))
    cut = known.select("_id", "_url", "n", "digest", "refers_to", "_raw", F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    data = F.when(F.col("refers_to").isNull(), F.substring("_raw", F.col("chunk") * chunk_bytes + 1, F.lit(chunk_bytes)))
    return cut.select("_id", "_url", "n", "digest", "refers_to", "chunk", data.alias("data"))


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + re.sub("^file:/*", "/", path))


def write_archives(chunks: DataFrame, folder: str, *, date: str = DATE) -> DataFrame:
    """One ``.warc.gz`` a task in ``folder``, a gzip member a record; rows ``path, records``.

    Chunks stream through, and with them a running digest that must end in the header's:
    no record is whole in memory. A file's name carries the task
    attempt, so that a repeated task never touches another's file, and only the files of
    the attempts that Spark kept are in the returned manifest, which is written before it
    is returned.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        store, root = _filesystem(folder)
        running, due = hashlib.sha1(), None
        path, out, packer, n = f"{root}/part-{ctx.partitionId():05d}-{ctx.taskAttemptId()}.warc.gz", None, None, 0

        def head(row: dict) -> bytes:
            web = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
            again = row["refers_to"] is not None
            lines = [
                "WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: <urn:record:{row['_id']}>", f"WARC-Date: {date}",
                f"WARC-Target-URI: {quote(row['_url'] or 'about:blank', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{_bare32(row['digest'])}",
                f"X-Payload-Length: {row['n']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(web) + (0 if again else row['n'])}",
            ]
            if again:
                lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:record:{row['refers_to']}>"]
            return "\r\n".join(lines).encode() + b"\r\n\r\n" + web

        def ended() -> None:
            if due is not None and running.hexdigest() != due:
                raise ValueError(f"{path}: the chunks of record {n} do not add up to its payload")
            out.write(packer.compress(b"\r\n\r\n") + packer.flush())

        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(path, compression=None)
                if row["chunk"] == 0:
                    if packer:
                        ended()
                    running, due = hashlib.sha1(), row["digest"] if row["refers_to"] is None else None
                    packer, n = zlib.compressobj(4, wbits=31), n + 1
                    out.write(packer.compress(head(row)))
                running.update(row["data"] or b"")
                out.write(packer.compress(row["data"] or b""))
        if out is not None:
            ended()
            out.close()
            scheme = folder.split("://")[0] + "://" if "://" in folder else ""
            name = folder.rstrip("/") + path[len(root) :] if scheme else path
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["path", "records"])

    return staged(chunks.mapInArrow(write, "path string, records long"), "manifest")


def _inflated(stream, size: int = 1 << 16) -> Iterator[bytes]:
    """Bytes of a gzip stream of any number of members (or of a plain one)."""
    raw = stream.read(size)
    if raw[:2] != b"\x1f\x8b":
        while raw:
            yield raw
            raw = stream.read(size)
        return
    unpack = zlib.decompressobj(31)
    while raw:
        out = unpack.decompress(raw, size)
        if unpack.eof:  # what follows is another member; the tail that is not consumed says nothing now
            raw, unpack = unpack.unused_data, zlib.decompressobj(31)
        else:
            raw = unpack.unconsumed_tail
        if out:
            yield out
        raw = raw or stream.read(size)
    yield unpack.flush()


#: The part of an HTTP message before its payload is looked for in so many bytes.
HEAD_BYTES = 1 << 20


class _Reader:
    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.held = parts, b""

    def more(self) -> bool:
        part = next(self.parts, None)
        if part is None:
            return False
        self.held += part
        return True

    def until(self, mark: bytes) -> bytes | None:
        while mark not in self.held:
            if not self.more():
                return None
        head, _, self.held = self.held.partition(mark)
        return head

    def head(self, n: int) -> bytes:
        """The HTTP head at the start of a block of ``n`` bytes, with its blank line; nothing if there is none."""
        most = min(n, HEAD_BYTES)
        while b"\r\n\r\n" not in self.held[:most] and len(self.held) < most and self.more():
            pass
        at = self.held[:most].find(b"\r\n\r\n")
        if at < 0 and len(self.held) < most:
            raise EOFError("a record ends within its head")
        head, self.held = self.held[: at + 4 if at >= 0 else 0], self.held[at + 4 if at >= 0 else 0 :]
        return head

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        got, self.held = self.held[:n], self.held[n:]
        return got


def read_chunks(manifest: DataFrame, *, chunk_bytes: int = CHUNK_BYTES, with_data: bool = True) -> DataFrame:
    """The response, resource and revisit records of the archives in ``manifest.path`` as a chunk table (schema ``CHUNKS``).

    Records of other types are skipped. Names of header fields are read in any case;
    ``record_id`` is what an ``urn:record:`` id ends in, or any other id as it is. Payload
    length and digest are null where a header does not have them.

    A payload comes as rows of record and chunk number with at most ``chunk_bytes`` bytes
    each; ``bytes_so_far`` and ``digest_so_far`` (bare base32 SHA-1) run along, so the last
    chunk's are the payload's own and no reader holds a record. A revisit has one chunk of
    no bytes. ``payload_bytes`` and ``payload_digest`` are what the header says. Truncated
    records fail the read.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CHUNKS.split(", ")]
        kinds = [{"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[c.split()[1]] for c in CHUNKS.split(", ")]
        rows: list[tuple] = []
        weight = 0

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(len(names))], names=names)
            rows.clear()
            return out

        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = _filesystem(path)
                with store.open_input_stream(at, compression=None) as stream:
                    r, record = _Reader(_inflated(stream)), 0
                    while (head := r.until(b"\r\n\r\n")) is not None:
                        pairs = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n") if ":" in x)
                        field = {name.strip().lower(): value.strip() for name, _, value in pairs}
                        kind, left = field["warc-type"], int(field["content-length"])
                        if kind not in ("response", "resource", "revisit"):
                            while left > 0 and (skipped := r.take(min(left, chunk_bytes))):
                                left -= len(skipped)
                            r.take(4)
                            continue
                        if field.get("content-type", "").startswith("application/http"):
                            left -= len(r.head(left))
                        chunk, so_far, running = 0, 0, hashlib.sha1()
                        ids = [x and x.strip("<>").removeprefix("urn:record:") for x in (field["warc-record-id"], field.get("warc-refers-to"))]
                        digest = field.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        size = int(field["x-payload-length"]) if "x-payload-length" in field else None
                        while left > 0 or chunk == 0:
                            data = r.take(min(left, chunk_bytes))
                            if len(data) < min(left, chunk_bytes):
                                raise EOFError(f"{path}: record {record} ends early")
                            running.update(data)
                            left, so_far = left - len(data), so_far + len(data)
                            rows.append((path, record, ids[0], kind, ids[1], size, digest, chunk, len(data), so_far, base64.b32encode(running.digest()).decode(), data if with_data else None))
                            chunk, weight = chunk + 1, weight + 200 + len(data) * with_data
                            if weight > 1 << 22:
                                yield flush()
                                weight = 0
                        r.take(4)
                        record += 1
        if rows:
            yield flush()

    files = manifest.select("path")
    return files.repartition(max(1, files.count())).mapInArrow(read, CHUNKS)


def record_digests(chunks: DataFrame) -> DataFrame:
    """One row a record of a chunk table, with payload length and digest.

    Both come from the chunks for records with a payload, from the header for revisits.
    Repeated record ids are told apart by archive and place.
    """
    own = F.col("record_type") != "revisit"
    return (
        chunks.groupBy("path", "record", "record_id", "record_type", "refers_to", "payload_bytes", "payload_digest")
        .agg(F.max("bytes_so_far").alias("_n"), F.max_by("digest_so_far", "chunk").alias("_d"))
        .select("record_id", "record_type", "refers_to", F.when(own, F.col("_n")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(own, F.col("_d")).otherwise(F.col("payload_digest")).alias("payload_digest"))
    )


def archive_folder(spark) -> str:
    return f"{shared_dir(spark)}/scrivener/warc-{uuid.uuid4().hex}"
