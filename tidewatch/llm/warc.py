"""WARC archives in seekable Zstandard bundles.

Records are grouped into independently compressed frames; a bundle ends with a
seek table in a skippable frame (the public seekable format), and an index table
maps each record identifier to its bundle, frame and offset inside the frame.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.llm.common import scratch_path, settle, text_batches

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 32 << 20
#: Records carry a fixed date unless one is given, so that reruns write equal bytes.
DATE = "1970-01-01T00:00:00Z"
# Fixed values of the seekable format and of the revisit profile.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_SCHEMA = "page_id long, record_id string, bundle string, frame int, frame_offset long, frame_length long, record_offset long, record_length long"
RECORD_SCHEMA = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest}>"


def page_of(identifier: str) -> int | None:
    found = identifier.strip("<>").split(":")[2]
    return None if found == "null" else int(found)


def make_record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or (payload None) a revisit without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    block = http + (payload or b"")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at an offset, and the offset after it."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError(f"no WARC record at {at}")
    headers = dict(line.split(": ", 1) for line in lines)
    start, size = end + 4, int(headers["Content-Length"])
    if data[start + size : start + size + 4] != b"\r\n\r\n":
        raise ValueError(f"record at {at} is cut off")
    return headers, data[start : start + size], start + size + 4


def read_page(headers: dict[str, str], block: bytes) -> tuple | None:
    """A row of RECORD_SCHEMA, or None for records that are not pages."""
    kind = headers["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
    refers = headers.get("WARC-Refers-To")
    return (page_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), payload if kind == "response" else None, size, digest, kind, page_of(refers) if refers else None)


class Bundle:
    """Collects records; frames are compressed one by one as they fill."""

    def __init__(self, frame_bytes: int):
        import zstandard

        self.compressor, self.frame_bytes = zstandard.ZstdCompressor(level=3), frame_bytes
        self.out, self.open, self.size, self.table, self.index = io.BytesIO(), [], 0, [], []
        self.pending: list[tuple] = []

    def add(self, page_id, identifier: str | None, record: bytes) -> None:
        if self.open and self.size + len(record) > self.frame_bytes:
            self.close_frame()
        if identifier is not None:
            self.pending.append((page_id, identifier, self.size, len(record)))
        self.open.append(record)
        self.size += len(record)

    def close_frame(self) -> None:
        if not self.open:
            return
        frame, at = self.compressor.compress(b"".join(self.open)), self.out.tell()
        self.index += [(page, ident, len(self.table), at, len(frame), offset, n) for page, ident, offset, n in self.pending]
        self.table.append((len(frame), self.size))
        self.out.write(frame)
        self.open, self.pending, self.size = [], [], 0

    def finish(self) -> bytes:
        self.close_frame()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)
        return self.out.getvalue()


def seek_table(stream, size: int) -> list[tuple[int, int, int]]:
    """Offset, compressed and full size of each frame, from the end of a bundle."""
    stream.seek(size - 9)
    frames, _, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end")
    stream.seek(size - 9 - 8 * frames)
    sizes, at, out = struct.unpack(f"<{2 * frames}I", stream.read(8 * frames)), 0, []
    for packed, full in zip(sizes[::2], sizes[1::2]):
        out.append((at, packed, full))
        at += packed
    return out


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, date: str = DATE) -> DataFrame:
    """Write one record for each row of pages into bundles in `folder` (a URI that
    all executors reach), and return the settled index, a row for each record.

    The payload is the text in UTF-8, null as empty. Of rows with equal payloads
    of at least min_revisit_bytes, that with the largest id is a response (a null
    id counts as smallest; rows that repeat that id too are responses) and the
    others are revisits of it; smaller payloads are all responses. A null url
    leaves the target out. Columns but the three named ones are ignored. An empty
    table gives an empty index.

    A task names its bundles by itself and its attempt, and only what a
    successful attempt put into the index is ever read: tasks that are run twice
    or die halfway leave files that nothing points to.
    """
    text_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1(F.col("payload").cast("binary")), "size": F.octet_length("payload").cast("long")})
    heads = rows.where(F.col("size") >= min_revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("n"))
    heads = settle(heads.where("n > 1").select("digest", "head"), "warc-heads")
    marked = rows.join(heads, "digest", "left")
    revisit = F.col("head").isNotNull() & ~F.col("head").eqNullSafe(F.col("page_id"))
    marked = marked.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "size", F.when(revisit, F.col("head")).alias("refers_to"))

    def write(batches):
        import pandas as pd

        context = TaskContext.get()
        system, base = _file_system(folder)
        stem = f"{context.partitionId():06d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:12]}"
        bundle, count = None, 0

        def flush():
            name = f"bundle-{stem}-{count:05d}.warc.zst"
            system.create_dir(base, recursive=True)
            with system.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(bundle.finish())
            return pd.DataFrame([(page, ident, f"{folder}/{name}", *rest) for page, ident, *rest in bundle.index], columns=["page_id", "record_id", "bundle", "frame", "frame_offset", "frame_length", "record_offset", "record_length"]).astype({"page_id": "Int64"})

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for page, url, payload, digest, size, refers in zip(*columns):
                if bundle is None:
                    bundle = Bundle(frame_bytes)
                    info = f"software: seekable bundle {count}\r\n".encode()
                    bundle.add(None, None, f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:bundle:{stem}:{count}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")
                name = base64.b32encode(bytes.fromhex(digest)).decode()
                bundle.add(page, record_id(page, name), make_record(page, url, None if payload is None else payload.encode(), size, name, refers, date))
                if bundle.out.tell() >= bundle_bytes:
                    yield flush()
                    bundle, count = None, count + 1
        if bundle is not None:
            yield flush()

    def as_arrow(batches):
        import pyarrow as pa

        for pdf in write(batches):
            yield from pa.Table.from_pandas(pdf, schema=arrow, preserve_index=False).to_batches()

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(INDEX_SCHEMA))
    return settle(marked.mapInArrow(as_arrow, INDEX_SCHEMA), "warc-index")


def _rows_to_arrow(rows: list[tuple], names: list[str]):
    import pyarrow as pa

    types = {"page_id": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64(), "refers_to": pa.int64()}
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, columns)], names=names)


def read_archive(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Every page record of the bundles that the index names, in RECORD_SCHEMA.

    A task reads a bundle frame by frame, so it holds one frame at a time; the
    digest of each payload is checked. Revisits have no payload, but the size and
    digest of the full one. Bundles are dealt to as many tasks as there are bundles. An
    index whose rows repeat reads each bundle once; an empty one gives no records."""
    import zstandard  # noqa: F401  (fails here rather than in a task)

    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = _file_system(uri)
                with system.open_input_file(path) as f:
                    for at, packed, full in seek_table(f, f.size()):
                        f.seek(at)
                        data, offset, rows = unpack.decompress(f.read(packed), max_output_size=full), 0, []
                        while offset < len(data):
                            headers, block, offset = parse_record(data, offset)
                            row = read_page(headers, block)
                            if row:
                                rows.append(row if payloads else (*row[:2], None, *row[3:]))
                        yield _rows_to_arrow(rows, names)

    bundles = index.select("bundle").distinct()
    return bundles.repartition(max(1, bundles.count()), "bundle").mapInArrow(run, RECORD_SCHEMA)


def fetch(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records whose record_id is in `wanted`, read by offset: of each bundle
    only the frames that hold them. An id that was never written gives no row, one
    that is wanted twice gives one row for each of the index; nulls are never found, and
    an empty index or an empty table of wanted ids gives an empty result."""
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def run(batches):
        import zstandard

        unpack, last, data = zstandard.ZstdDecompressor(), None, b""
        for batch in batches:
            rows = []
            for uri, at, packed, offset in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (uri, at) != last:
                    system, path = _file_system(uri)
                    with system.open_input_file(path) as f:
                        f.seek(at)
                        data, last = unpack.decompressobj().decompress(f.read(packed)), (uri, at)
                headers, block, _ = parse_record(data, offset)
                rows.append(read_page(headers, block))
            yield _rows_to_arrow(rows, names)

    at = index.join(wanted.select("record_id").distinct(), "record_id", "left_semi").select("bundle", "frame_offset", "frame_length", "record_offset")
    return at.repartition("bundle", "frame_offset").sortWithinPartitions("bundle", "frame_offset", "record_offset").mapInArrow(run, RECORD_SCHEMA)


def op1_warc_seekable(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = write_archive(pages, scratch_path(spark, "warc-bundles"))
    return read_archive(index, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS head FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(5 * g + 1 AS INT), 5) AS BIGINT) >> CAST(s AS INT)) & 31 AS INT) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS DISTINCT FROM head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM h
"""
