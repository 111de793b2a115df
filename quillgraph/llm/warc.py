"""WARC archives: one gzip member per record, written and read back in sequence.

Paths may be any that pyarrow's file systems open (file:, hdfs:, s3: ...); all executors must reach them.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that are read from an archive at once.
READ = 1 << 18

# Fixed value: the profile of a revisit record whose payload has been stored before, as the WARC standard names it.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class BrokenArchive(ValueError):
    """An archive that isn't framed as it says, or a payload that doesn't match its digest."""


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, uri: str, record_id: str, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP header of the full payload, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {SAME_PAYLOAD}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    press = zlib.compressobj(4, zlib.DEFLATED, 31)
    return press.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + press.flush()


def members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The content of each gzip member, decompressed as it is read."""
    unpack, parts, begun = zlib.decompressobj(31), [], False
    for chunk in chunks:
        while chunk:
            begun = True
            parts.append(unpack.decompress(chunk))
            chunk = unpack.unused_data
            if unpack.eof:
                yield b"".join(parts)
                unpack, parts, begun = zlib.decompressobj(31), [], False
    if begun:
        raise BrokenArchive("the last member isn't whole")


def _fields(head: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = head.decode("utf-8").split("\r\n")
    return first, {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in rest if line)}


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC fields, HTTP fields and payload of a record, its framing and digests verified."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    version, fields = _fields(head)
    size = int(fields.get("content-length", -1))
    if not gap or not version.startswith("WARC/") or size < 0 or rest[size:] != b"\r\n\r\n":
        raise BrokenArchive(f"record {fields.get('warc-record-id')} isn't framed by its content length")
    block = rest[:size]
    if fields.get("warc-block-digest", "") != f"sha1:{sha1_base32(block)}":
        raise BrokenArchive(f"record {fields.get('warc-record-id')} has another block digest")
    http_head, _, payload = block.partition(b"\r\n\r\n")
    http = _fields(http_head)[1]
    if fields["warc-type"] == "response" and (fields.get("warc-payload-digest") != f"sha1:{sha1_base32(payload)}" or int(http.get("content-length", -1)) != len(payload)):
        raise BrokenArchive(f"record {fields.get('warc-record-id')} has another payload digest or length")
    return fields, http, payload


def _opened(path: str):
    where, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return where, name


def read_archive(path: str) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """The records of an archive in order; memory holds one record and READ bytes."""
    where, name = _opened(path)
    with where.open_input_stream(name, compression=None) as f:
        yield from map(parse, members(iter(lambda: f.read(READ), b"")))


def plan_records(pages: DataFrame, revisit_bytes: int = 0, page_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(_page, _url, _payload, _digest, _refers) per row of pages: _refers is the page whose payload is stored instead,
    null where the row's own is."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    own = pages.select(F.col(page_col).cast("long").alias("_page"), F.col(url_col).alias("_url"), payload.alias("_payload"))
    own = own.withColumn("_sha", F.sha1("_payload"))
    # The largest page of each payload: one row a payload from every task, then one in all.
    first = own.where(F.length("_payload") >= revisit_bytes).groupBy("_sha").agg(F.max("_page").alias("_first"), F.count("*").alias("_n")).where(F.col("_n") > 1).select("_sha", "_first")
    own = own.join(first, "_sha", "left")
    return own.withColumn("_refers", F.when(~F.col("_page").eqNullSafe(F.col("_first")), F.col("_first"))).drop("_first")


def write_archives(records: DataFrame, directory: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes one archive per task and returns their paths. A task writes under a name of its attempt and renames the
    whole file to that of its partition, so a task that is run again or twice leaves one."""
    fixed = date if date else datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        where, top = _opened(directory)
        where.create_dir(top, recursive=True)
        name = f"part-{task.partitionId():06d}.warc.gz"
        draft = f"{top}/.{name}.{task.taskAttemptId()}"
        n = 0
        with where.open_output_stream(draft, compression=None) as f:
            for batch in batches:
                for page, url, payload, refers in zip(*(batch.column(c) for c in ("_page", "_url", "_payload", "_refers"))):
                    page, url, payload, refers = page.as_py(), url.as_py(), payload.as_py(), refers.as_py()
                    digest = sha1_base32(payload)
                    kind = "response" if refers is None else "revisit"
                    f.write(record(kind, (url or "").replace("\r", " ").replace("\n", " "), f"<urn:page:{'' if page is None else page}>", payload, digest, None if refers is None else f"<urn:page:{refers}>", fixed))
                    n += 1
        where.move(draft, f"{top}/{name}")
        yield pa.RecordBatch.from_pydict({"path": [f"{directory}/{name}"], "records": [n]}, pa.schema([("path", pa.string()), ("records", pa.int64())]))

    return records.select("_page", "_url", "_payload", "_refers").mapInArrow(run, "path string, records long")


def _page(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read_archives(paths: DataFrame, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to and (if asked for) payload of every record in
    the archives named in `path`, each archive read in sequence by one task; a broken one raises."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                for fields, http, payload in read_archive(path):
                    row = (_page(fields["warc-record-id"]), fields["warc-target-uri"], int(http["content-length"]), fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"], _page(fields.get("warc-refers-to")))
                    rows.append((*row, payload) if payloads else row)
                    held += len(payload) * payloads + 200
                    if held > 4 << 20:
                        yield pack(rows)
                        rows, held = [], 0
                if rows:
                    yield pack(rows)

    return paths.mapInArrow(run, schema)


def round_trip(pages: DataFrame, directory: str, revisit_bytes: int = 0) -> DataFrame:
    """Writes `pages` to archives below `directory` and reads them back, a row per record.

    Of rows whose payloads are equal and at least revisit_bytes long, that with the largest page_id is the response and
    the others revisit it; shorter ones are all responses. A null html is an empty payload; a null page_id is smaller
    than any other; rows that repeat the largest page_id are all responses; an empty table writes no records; columns
    but page_id, url and html are ignored.
    """
    written = write_archives(plan_records(pages, revisit_bytes), directory).collect()  # a path per task
    paths = pages.sparkSession.createDataFrame([(r["path"],) for r in written if r["records"]], "path string")
    return read_archives(paths.repartition(max(1, len(written)), "path") if written else paths)
