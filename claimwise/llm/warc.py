"""WARC archives: written by Spark tasks, one gzip member a record, and read back
in byte ranges.

``write_warc`` makes a record of each page. Of pages with equal payloads of at least
MIN_BYTES bytes, that of the smallest key becomes a ``response``, the others become
``revisit`` records that name it and hold no payload. The archives lie below
``spark.checkpoint.dir`` or a given folder; a task writes to a name of its own and
renames it at the end, and the manifest (a table) names the files that count.

``read_warc`` cuts archives into ranges of SPLIT_BYTES. A task looks for the gzip
magic from the start of its range, takes a place as a member only if it inflates to
a WARC version line and header fields, and then goes from member to member. It owns
the records of members that start inside the range, and reads beyond its end to
finish the last. So each record is read once, whatever the ranges; bytes between
members are passed over. Payloads are hashed while they are inflated. A member that
breaks off or does not match its checksums is an error, or with ``errors="keep"`` a
row that says so. A gzip file of WARC records that lies byte by byte inside another
record's member (a stored block) can't be told from a real one by a range that
starts between the two.

A null payload is empty. A null or repeated key is a key like any other: pages that
repeat the smallest key of their payload are all responses, and a null key is larger
than any other, so that it is the response only where no page of that payload has a
key. A null url leaves out the target URI; bytes that a header can't hold are
percent-encoded. Payloads, urls and headers may have any length; a record's payload
is held whole by the task. Only the three named columns are read, so the names of others
don't matter; an empty table gives no archive and no rows."""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Any

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimwise.llm import arrow
from claimwise.llm.ship import ship
from claimwise.session import ensure_checkpoint_dir, materialize
from claimwise.sources.joins import checked_broadcast

MIN_BYTES = 100
FILE_BYTES = 1 << 30  # an archive is closed beyond this
SPLIT_BYTES = 4 << 20
READ_BYTES = 1 << 18
ROWS_BYTES = 4 << 20  # payloads sent on together
LEVEL = 6

# Marks of the two formats.
MAGIC = b"\x1f\x8b\x08"
BREAK = b"\r\n\r\n"
VERSION = b"WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("records", T.LongType())])
RECORD = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("path", "record_type", "record_id", "target_uri", "refers_to_id", "payload_digest", "error")]
    + [T.StructField(c, T.LongType()) for c in ("offset", "payload_bytes")]
    + [T.StructField("headers", T.MapType(T.StringType(), T.StringType())), T.StructField("payload", T.BinaryType())]
)


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


# ---------------------------------------------------------------- writing

def record_id(key: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{key}:{digest}').urn}>"


def _value(text: str) -> str:
    """Text as a header value: white space and control characters percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def encode_record(kind: str, fields: list[tuple[str, str | None]], block: bytes, level: int = LEVEL) -> bytes:
    """One record as a gzip member."""
    head = [VERSION.decode(), f"WARC-Type: {kind}", *(f"{n}: {v}" for n, v in fields if v is not None), f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + BREAK) + packer.compress(block) + packer.compress(BREAK) + packer.flush()


def _page_record(key: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    """A response, or where ``first`` is given a revisit of that page's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}".encode() + BREAK
    fields = [
        ("WARC-Record-ID", record_id(key, digest)), ("WARC-Date", date), ("WARC-Target-URI", None if url is None else _value(url)),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-Id", None if key is None else str(key)),
    ]
    if first is None:
        return encode_record("response", fields, http + payload)
    return encode_record("revisit", [*fields, ("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(first, digest)), ("X-Refers-To-Page-Id", str(first))], http)


class _Archive:
    """One file being written; counts only once it is closed."""

    def __init__(self, folder: str, task: int, date: str):
        self.fs, base = open_folder(folder)
        self.fs.create_dir(base, recursive=True)
        self.path = f"{base}/pages-{task:06d}-{uuid.uuid4().hex[:12]}.warc.gz"
        self.sink, self.bytes, self.records = self.fs.open_output_stream(f"{self.path}.part", compression=None), 0, 0
        info = b"software: claimwise\r\nformat: WARC File Format 1.1\r\n"
        self.add(encode_record("warcinfo", [("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], info))

    def add(self, member: bytes) -> None:
        self.sink.write(member)
        self.bytes += len(member)
        self.records += 1

    def close(self) -> dict:
        self.sink.close()
        self.fs.move(f"{self.path}.part", self.path)
        return {"path": self.path, "bytes": self.bytes, "records": self.records}


def write_warc(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", folder: str | None = None,
               date: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write archives and return their manifest: folder, path, bytes, records.

    Only payload digests are grouped, and just those of several pages are kept. They
    are broadcast if their table is small (``checked_broadcast``); else the pages meet
    them in a shuffle join, where Spark splits a digest with many pages."""
    spark = pages.sparkSession
    ship(spark)
    folder = (folder or f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}").rstrip("/")
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(url).cast("string").alias("u"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("p"))
    rows = rows.withColumn("d", F.sha2("p", 256))
    firsts = rows.where(F.octet_length("p") >= MIN_BYTES).groupBy(F.col("d").alias("same")).agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = materialize(firsts.where("n > 1 AND first IS NOT NULL").select("same", "first"))
    told = rows.join(checked_broadcast(firsts), F.col("d") == F.col("same"), "left")
    told = told.select("k", "u", "p", "d", F.when(~F.col("k").eqNullSafe(F.col("first")), F.col("first")).alias("first"))

    def run(batches):
        from pyspark import TaskContext

        task, archive = TaskContext.get().partitionId(), None
        done = []
        for b in arrow.slices(batches, "p"):
            for k, u, p, d, first in zip(*(b.column(c).to_pylist() for c in ("k", "u", "p", "d", "first"))):
                archive = archive or _Archive(folder, task, date)
                archive.add(_page_record(k, u, p, d, first, date))
                if archive.bytes >= file_bytes:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())]))

    return materialize(told.mapInArrow(run, MANIFEST)).withColumn("folder", F.lit(folder))


# ---------------------------------------------------------------- reading

class Damaged(ValueError):
    pass


class _Member:
    """The inflated bytes of the gzip member at ``at``, in order and bounded in memory."""

    def __init__(self, source: Any, at: int):
        source.seek(at)
        self.source, self.fed, self.held, self.pos = source, at, b"", 0
        self.zip, self.most = zlib.decompressobj(31), 64  # the first bytes show what it is, before any checksum

    def more(self) -> bool:
        """Inflate further; False at the member's end."""
        while not self.zip.eof:
            raw = self.zip.unconsumed_tail
            if not raw:
                raw = self.source.read(READ_BYTES)
                self.fed += len(raw)
                if not raw:
                    raise Damaged("the member breaks off")
            try:
                out = self.zip.decompress(raw, self.most)
            except zlib.error as e:
                raise Damaged(str(e)) from e
            self.most = 4 * READ_BYTES
            if out:
                self.held, self.pos = self.held[self.pos :] + out, 0
                return True
        return False

    def starts(self, mark: bytes) -> bool:
        """Whether the next bytes are ``mark`` (not passed)."""
        while len(self.held) - self.pos < len(mark) and mark.startswith(self.held[self.pos :]):
            if not self.more():
                break
        return self.held.startswith(mark, self.pos)

    def until(self, mark: bytes) -> bytes:
        """All up to ``mark``, which is passed."""
        seen = self.pos
        while (k := self.held.find(mark, seen)) < 0:
            back = max(0, len(self.held) - len(mark) + 1 - self.pos)
            if not self.more():
                raise Damaged("a header without an end")
            seen = self.pos + back
        out, self.pos = self.held[self.pos : k], k + len(mark)
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces."""
        while n:
            if self.pos == len(self.held) and not self.more():
                raise Damaged("the block breaks off")
            piece = self.held[self.pos : self.pos + n]
            self.pos += len(piece)
            n -= len(piece)
            yield piece

    def ended(self) -> bool:
        return self.pos == len(self.held) and not self.more()

    def after(self) -> int:
        """Offset of what follows the member."""
        return self.fed - len(self.zip.unused_data)


def _fields(lines: bytes) -> dict[str, str]:
    """Header lines by lower-case name; a line that starts with white space goes on with the last."""
    out, name = {}, None
    for line in lines.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and name:
            out[name] += " " + line.strip().decode("utf-8", "replace")
        else:
            n, colon, v = line.partition(b":")
            if not colon or not n.strip():
                raise Damaged("a header line without a name")
            name = n.strip().decode("utf-8", "replace").lower()
            out[name] = v.strip().decode("utf-8", "replace")
    return out


def _number(fields: dict[str, str]) -> int:
    if not (n := fields.get("content-length", "")).isdecimal():
        raise Damaged("no Content-Length")
    return int(n)


def _record(member: _Member, payloads: bool) -> dict:
    if not member.starts(b"WARC/1."):
        raise Damaged("no record starts here")
    fields = _fields(member.until(BREAK).partition(b"\r\n")[2])
    left, kind = _number(fields), fields.get("warc-type")
    if kind is None:
        raise Damaged("no WARC-Type")
    told = fields.get("warc-payload-digest", "").partition("sha256:")[2] or None
    size = None
    if fields.get("content-type", "").startswith("application/http") and left:
        before, seen = bytearray(), 0
        for piece in member.take(left):  # the HTTP header, then the payload
            before += piece
            left -= len(piece)
            if (k := before.find(BREAK, seen)) >= 0:
                break
            seen = max(0, len(before) - 3)
        else:
            raise Damaged("an HTTP header without an end")
        http, rest = _fields(bytes(before[:k]).partition(b"\r\n")[2]), bytes(before[k + 4 :])
        size = int(http["content-length"]) if http.get("content-length", "").isdecimal() else None
    else:
        rest = b""
    digest, parts, n = hashlib.sha256(rest), [rest], len(rest)
    for piece in member.take(left):
        digest.update(piece)
        n += len(piece)
        if payloads:
            parts.append(piece)
    if b"".join(member.take(4)) != BREAK:
        raise Damaged("a record of another length than its header says")
    if kind != "revisit":
        size = n
        if told and told != digest.hexdigest():
            raise Damaged("the payload differs from its digest")
        told = digest.hexdigest()
    return {
        "record_type": kind, "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"),
        "refers_to_id": fields.get("warc-refers-to"), "payload_digest": told, "payload_bytes": size, "headers": fields,
        "payload": b"".join(parts) if payloads and kind != "revisit" else None,
    }


def _next_magic(source: Any, at: int, end: int) -> int | None:
    """The first place from ``at`` on and before ``end`` with the gzip magic."""
    source.seek(at)
    held = b""
    while at < end:
        raw = source.read(READ_BYTES)
        held += raw
        k = held.find(MAGIC)
        if k >= 0:
            return at + k if at + k < end else None
        if not raw:
            return None
        at += max(0, len(held) - 2)
        held = held[-2:]
    return None


def read_range(source: Any, start: int, end: int, payloads: bool = True, errors: str = "raise") -> Iterator[dict]:
    """Records of the members that start in [start, end) of a random access file."""
    at: int | None = start
    while (at := _next_magic(source, at, end)) is not None:
        member = _Member(source, at)
        if not _is_record(member):
            at += 1  # these three bytes by chance
            continue
        more = True
        while more:  # mostly one record in a member
            try:
                yield {"offset": at, **_record(member, payloads)}
                more = not member.ended()
                after = member.after()
            except Damaged as e:
                if errors == "raise":
                    raise Damaged(f"at byte {at}: {e}") from e
                yield {"offset": at, "error": str(e)}
                more, after = False, at + 1
        at = after


def _is_record(member: _Member) -> bool:
    try:
        return member.starts(b"WARC/1.")
    except Damaged:
        return False


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """Manifest of the ``.warc.gz`` files of any folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.lit(folder).alias("folder"))


def read_warc(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True, errors: str = "raise") -> DataFrame:
    """All records of the archives of a manifest (``path``, ``bytes``, ``folder``):
    path, offset, record_type, record_id, target_uri, refers_to_id, payload_digest
    (sha256; of the full payload also for a revisit), payload_bytes (too), headers
    (lower-case names), payload (unless ``payloads`` is off; none for a revisit), error."""
    spark = manifest.sparkSession
    ship(spark)
    starts = F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes))).alias("start")
    ranges = manifest.where("bytes > 0").select("folder", "path", starts)
    ranges = ranges.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "start")
    names = RECORD.names
    kinds = {"offset": pa.int64(), "payload_bytes": pa.int64(), "headers": pa.map_(pa.string(), pa.string()), "payload": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def batch(rows: list[dict]) -> pa.RecordBatch:
        cols = [[list(r[n].items()) if n == "headers" and r.get(n) else r.get(n) for r in rows] for n in names]
        return pa.RecordBatch.from_arrays([pa.array(c, schema.field(n).type) for n, c in zip(names, cols)], schema=schema)

    def run(batches):
        rows, size = [], 0
        for b in batches:
            for r in b.to_pylist():
                fs, _ = open_folder(r["folder"])
                path = open_folder(r["path"])[1]
                with fs.open_input_file(path) as source:
                    for found in read_range(source, r["start"], r["start"] + split_bytes, payloads, errors):
                        rows.append({"path": r["path"], **found})
                        size += 500 + len(found.get("payload") or b"")
                        if size >= ROWS_BYTES:
                            yield batch(rows)
                            rows, size = [], 0
        if rows:
            yield batch(rows)

    return ranges.mapInArrow(run, RECORD)


def archived_pages(manifest: DataFrame, key: str = "page_id") -> DataFrame:
    """What the archives say of each page: key, payload_bytes, payload_digest,
    record_type, refers_to (the response's key for a revisit)."""
    records = read_warc(manifest, payloads=False).where(F.col("record_type").isin("response", "revisit"))
    return records.select(
        F.col("headers")["x-page-id"].cast("long").alias(key), "payload_bytes", "payload_digest", "record_type",
        F.col("headers")["x-refers-to-page-id"].cast("long").alias("refers_to"),
    )
