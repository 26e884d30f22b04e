"""WARC archives as a PySpark Python data source, for reading and writing.

Writing: each task writes record-at-a-time gzip files under a name of its own; each commit writes a list of the files of
the attempts that succeeded, with offsets at which a reader may begin. A lost or repeated attempt leaves a file that nothing
lists. Every gzip member says in its header (an extra field, as BGZF
does) how long it is, so a reader can step over a record without inflating it.

Reading: partitions are the ranges of all lists, or whole files of other archives (.warc and .warc.gz).
Equality, IN, prefix, suffix and contains predicates on header columns are pushed down. Of each record only
the first bytes are inflated; if the header fails a predicate, or the payload isn't asked for, the rest is
stepped over. Options: payload = "read" (default), "digest" (length and digest of the bytes found, no bytes) or
"skip" (headers only); payloads that don't match their digest are an error.

Payload columns: null payloads count as empty. Of records with equal payloads of at least min_bytes, the one with the
smallest id is the response and others revisit it; rows that repeat one id are all responses. An empty
table writes an archive without files, which reads back as no rows. A very long payload is one record, in memory
once on either side. Other columns are ignored. register() switches filter pushdown to Python sources on in the session.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from .common import scratch_path, table

SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, content_type string, payload_digest string, payload_length long, payload binary"
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "content_type": "content-type", "payload_digest": "warc-payload-digest"}
MANIFEST, RANGE, HEAD, AHEAD = "_manifest", 32 << 20, 4096, 256 << 10
OWN_FILE = re.compile("part-[0-9a-f]{32}[.]warc[.]gz")


# ---- files in any store ------------------------------------------------------------------


def store(path: str):
    """A filesystem and the path in it; local paths and file: need no library."""
    from pyarrow import fs

    parts = urlparse(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(path)


def listings(files, root: str) -> list[str]:
    """The commits' lists of an archive."""
    from pyarrow import fs

    found = files.get_file_info(fs.FileSelector(f"{root}/{MANIFEST}", allow_not_found=True))
    return sorted(x.path for x in found if x.path.endswith(".json"))


# ---- records -----------------------------------------------------------------------------


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes, level: int = 1) -> bytes:
    """A gzip member whose extra field 'SL' holds its own length."""
    body = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = body.compress(data) + body.flush()
    size = 12 + 8 + len(packed) + 8
    head = struct.pack("<4BI2BH2sHI", 0x1F, 0x8B, 8, 4, 0, 0, 255, 8, b"SL", 4, size)
    return head + packed + struct.pack("<2I", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(record_id: str, record_type: str, uri: str, payload: bytes, digest: str, length: int, refers_to: str | None = None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A response holds an HTTP message with the payload; a revisit holds none."""
    block = b""
    kind = "application/http; msgtype=response"
    if record_type == "response":
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if uri:
        lines.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {length}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"Content-Type: {kind}", f"Content-Length: {len(block)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_head(data: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields and where the block begins, or None while the header is incomplete."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    first, *lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields: dict[str, str] = {}
    for line in lines:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, end + 4


def columns_of(fields: dict[str, str]) -> dict:
    found = {c: fields.get(h) for c, h in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        if found[c] is not None:
            found[c] = found[c].removeprefix("<").removesuffix(">")
    if found["payload_digest"] is not None:
        found["payload_digest"] = found["payload_digest"].removeprefix("sha1:")
    length = fields.get("x-payload-length")
    found["payload_length"] = int(length) if length is not None else None
    return found


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    if fields.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def skip_length(head: bytes) -> int | None:
    """The member's own length, if its header says so."""
    if len(head) >= 20 and head[:2] == b"\x1f\x8b" and head[3] & 4 and head[12:14] == b"SL":
        return struct.unpack("<I", head[16:20])[0]
    return None


class Window:
    """Bytes of a file by position, read ahead in pieces, so that small records cost no request each and big ones that are
    stepped over aren't read."""

    def __init__(self, f, ahead: int = AHEAD):
        self.f, self.ahead, self.start, self.data = f, ahead, 0, b""

    def read(self, at: int, size: int) -> bytes:
        """size bytes from `at` on, fewer at the end of the file."""
        if at < self.start or at + size > self.start + len(self.data):
            have = self.data[at - self.start :] if self.start <= at <= self.start + len(self.data) else b""
            self.f.seek(at + len(have))
            self.start, self.data = at, have + self.f.read(max(size, self.ahead) - len(have))
        return self.data[at - self.start : at - self.start + size]


def scan(f, start: int, end: int | None, wanted, mode: str, ahead: int = AHEAD):
    """Rows of the records that begin in [start, end). wanted(columns) tells by the header."""
    source, at = Window(f, ahead), start
    packed = source.read(start, 2) == b"\x1f\x8b"
    while end is None or at < end:
        head = source.read(at, HEAD)
        if not head:
            return
        size, inflate = skip_length(head) if packed else None, zlib.decompressobj(31) if packed else None
        data, read, tail = b"", 0, b""

        def more(step: int, most: int = 0) -> bool:
            """More of the record's data; at most `most` inflated bytes if that isn't 0. False at the end of the member or file."""
            nonlocal data, read, tail
            if packed and inflate.eof:
                return False
            chunk = tail or source.read(at + read, min(step, size - read) if size else step)
            read += 0 if tail else len(chunk)
            if not chunk:
                return False
            data += inflate.decompress(chunk, most) if packed else chunk
            tail = inflate.unconsumed_tail if packed else b""
            return True

        while (parsed := parse_head(data)) is None:
            if not more(HEAD, HEAD):
                if not packed and not data.strip():
                    return
                raise ValueError("the archive ends inside a header")
        fields, begin = parsed
        block_length = int(fields.get("content-length", 0))
        row = columns_of(fields)
        take = wanted(row)
        need = begin + block_length if take and mode != "skip" and row["record_type"] != "revisit" else 0
        if packed:
            parts = [data]
            have, used = len(data), need
            # A member that doesn't say how long it is has to be inflated to its end.
            while (have < need or size is None) and not inflate.eof:
                data = b""
                if not more(size or 1 << 20):
                    raise ValueError("the archive ends inside a record")
                have += len(data)
                if used:
                    parts.append(data)
            data = b"".join(parts)
            at += size if size else read - len(inflate.unused_data)
        else:
            if need > len(data):
                data = source.read(at, need)
            at += begin + block_length + 4
        if not take:
            continue
        if need:
            if len(data) < need:
                raise ValueError("the archive ends inside a record")
            payload = payload_of(fields, data[begin : begin + block_length])
            digest = digest_of(payload)
            if row["payload_digest"] not in (None, digest):
                raise ValueError(f"{row['record_id']}: the payload doesn't match its digest")
            row |= {"payload_digest": digest, "payload_length": len(payload), "payload": payload if mode == "read" else None}
        yield row


# ---- the data source ---------------------------------------------------------------------


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int | None


@dataclass
class Written(WriterCommitMessage):
    files: list


TESTS = {
    EqualTo: lambda have, want: have == want,
    In: lambda have, want: have in want,
    StringStartsWith: lambda have, want: have.startswith(want),
    StringEndsWith: lambda have, want: have.endswith(want),
    StringContains: lambda have, want: want in have,
}


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.mode, self.tests = options["path"], options.get("payload", "read"), []
        if self.mode not in ("read", "digest", "skip"):
            raise ValueError("payload is read, digest or skip")

    def pushFilters(self, filters):
        for f in filters:
            if type(f) in TESTS and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.tests.append((f.attribute[0], type(f).__name__, f.value))
            else:
                yield f

    def partitions(self):
        files, root = store(self.path)
        lists = listings(files, root)
        if lists:
            listed = [x for name in lists for x in json.loads(files.open_input_stream(name).read())]
            return [Range(f"{self.path}/{name}", a, b) for name, cuts in listed for a, b in zip(cuts, [*cuts[1:], None])]
        from pyarrow import fs

        # An archive of other makers. Files of this writer that no list names come from jobs that failed.
        found = files.get_file_info(fs.FileSelector(root, recursive=True))
        names = sorted(x.path for x in found if x.is_file and x.path.endswith((".warc", ".warc.gz")) and not OWN_FILE.fullmatch(x.base_name))
        scheme = self.path[: len(self.path) - len(root)] if self.path.endswith(root) else ""
        return [Range(scheme + n, 0, None) for n in names]

    def read(self, partition):
        import pyarrow as pa

        if partition is None:  # an archive without files
            return
        by_name = {k.__name__: v for k, v in TESTS.items()}

        def wanted(row):
            return all(row[c] is not None and by_name[kind](row[c], value) for c, kind, value in self.tests)

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.int64() if n == "payload_length" else pa.binary() if n == "payload" else pa.string() for n in names]
        files, path = store(partition.path)
        with files.open_input_file(path) as f:
            rows, held = [], 0
            for row in scan(f, partition.start, partition.end, wanted, self.mode):
                rows.append(row)
                held += 500 + len(row.get("payload") or b"")
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types)], names=names)


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path, self.level = options["path"], int(options.get("level", 1))

    def write(self, iterator):
        name, out, at, cuts = f"part-{uuid.uuid4().hex}.warc.gz", None, 0, [0]
        files, root = store(self.path)
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                if at - cuts[-1] >= RANGE:
                    cuts.append(at)
                payload = row["payload"] or b""
                data = member(record(row["record_id"], row["record_type"], row["target_uri"], payload, row["payload_digest"], row["payload_length"], row["refers_to"]), self.level)
                out.write(data)
                at += len(data)
        if out is None:
            return Written([])
        out.close()
        return Written([(name, cuts)])

    def commit(self, messages):
        """One list a commit, under a name of its own, moved into place whole: appends at the same time don't meet."""
        files, root = store(self.path)
        files.create_dir(f"{root}/{MANIFEST}", recursive=True)
        name = f"{root}/{MANIFEST}/{uuid.uuid4().hex}"
        with files.open_output_stream(f"{name}.part") as f:
            f.write(json.dumps([x for m in messages if m is not None for x in m.files]).encode())
        files.move(f"{name}.part", f"{name}.json")

    def abort(self, messages):
        """The files of tasks that ended go; those of tasks that didn't stay unlisted, and nothing reads them."""
        files, root = store(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else ():
                files.delete_file(f"{root}/{name}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


# ---- pages to archive and back -----------------------------------------------------------


def records(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Rows of SCHEMA: a response or, for a payload that a smaller id has, a revisit."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(uri_col).alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("payload_length", F.octet_length("payload").cast("long"))
    # Only digests travel for the smallest ids. Grouped by the digest alone but joined with the length too, both
    # sides get an exchange of their own, so the rows of a hot payload can be split at run time.
    small = pages.select(F.col(id_col).alias("id"), payload.alias("payload")).select("id", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("payload_length"))
    first = small.where(F.col("payload_length") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first_id"), F.max("payload_length").alias("payload_length"))
    joined = rows.join(first, ["digest", "payload_length"], "left")
    again = F.col("first_id").isNotNull() & (F.col("id").isNull() | (F.col("id") != F.col("first_id")))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    return joined.select(
        urn("id").alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(again, urn("first_id")).alias("refers_to"),
        F.lit(None).cast("string").alias("content_type"),
        _base32(F.unhex("digest")).alias("payload_digest"),
        "payload_length",
        F.when(~again, F.col("payload")).alias("payload"),
    )


def _base32(data):
    """RFC 4648 base32 of a 20-byte digest: five bits at a time from the binary digits."""
    bits = F.concat(*[F.lpad(F.conv(F.substr(F.hex(data), F.lit(1 + 10 * k), F.lit(10)), 16, 2), 40, "0") for k in range(4)])
    letter = lambda i: F.substr(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), F.conv(F.substr(bits, F.lit(1 + 5 * i), F.lit(5)), 2, 10).cast("int") + 1, F.lit(1))
    return F.concat(*[letter(i) for i in range(32)])


def write(rows: DataFrame, path: str) -> None:
    rows.write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: str = "read") -> DataFrame:
    return spark.read.format("warc").option("payload", payload).load(path)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark)
    path = scratch_path(spark, "archive")
    write(records(table(spark, sf_dir, "pages")), path)
    page = lambda c: F.regexp_extract(c, "^urn:page:(-?[0-9]+)$", 1).try_cast("long")
    # Two filtered reads: responses with their payloads' own digests, revisits by their headers only.
    responses = read(spark, path, "digest").where("record_type = 'response'")
    revisits = read(spark, path, "skip").where("record_type = 'revisit'")
    return responses.union(revisits).select(
        page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
b AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS d, min(page_id) OVER (PARTITION BY h) AS f FROM p),
x AS (SELECT *, list_transform(range(0, 32), lambda i: list_sum(list_transform(range(0, 5), lambda k:
        ((instr('0123456789abcdef', d[(5 * i + k) // 4 + 1]) - 1) // CAST(pow(2, 3 - (5 * i + k) % 4) AS INT)) % 2 * CAST(pow(2, 4 - k) AS INT)))) AS v FROM b)
SELECT page_id, payload_bytes, array_to_string(list_transform(v, lambda n: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(n AS INT) + 1]), '') AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to
FROM x
"""
