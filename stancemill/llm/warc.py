"""WARC 1.1 archives as a PySpark data source, and pages stored in them.

Writing: each task writes record-per-member gzip files; every member's header has the lengths of its
compressed and plain bytes (the "sl" extra field), so readers can skip records without inflating them.
A manifest written at commit lists the files of finished tasks; files of failed tries are never read.

Reading: files are cut into byte ranges at record starts. A record's headers are inflated and parsed first;
record-type and header predicates that were pushed down are decided from them, and the payload of a record
that fails, or of all records if the option payload is false, is never decoded.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from stancemill.llm.common import shared_path, small_batches, staged

SCHEMA = "warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, content_length long, headers map<string,string>, payload binary, file string, offset long"
FIELDS = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
RANGE_BYTES = 64 << 20
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MEMBER = re.compile(rb"\x1f\x8b\x08\x04.{6}\x0c\x00sl\x08\x00", re.S)
START = re.compile(rb"\r\n\r\n(?=WARC/1\.[01]\r\n)")
#: So many records from a found start on must follow each other by their lengths, or reach the file's end, for it to be one and no quoted head in a payload.
CHAIN = 3
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a path or URI."""
    if re.match(r"^\w[\w+.-]+:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
    return fs.LocalFileSystem(), path


def one_line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), value)


def member(record: bytes) -> bytes:
    """The record as a gzip member that states its lengths."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return struct.pack("<4sIBBH2sHII", b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"sl", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record_bytes(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """Headers by lower-case name; continuation lines are joined, lines without a colon ignored."""
    out, last = {}, None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            k, _, v = line.partition(":")
            last = k.strip().lower()
            out[last] = v.strip()
    return out


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The block without its HTTP head, if it has one."""
    if block.startswith(b"HTTP/") and headers.get("warc-type") in ("response", "request", "revisit"):
        return block.partition(b"\r\n\r\n")[2]
    return block


class Range(InputPartition):
    def __init__(self, file: str, start: int, stop: int):
        self.file, self.start, self.stop = file, start, stop


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", RANGE_BYTES)))
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and len(f.attribute) == 1 and f.attribute[0] in FIELDS:
                kind = "starts" if isinstance(f, StringStartsWith) else "in"
                self.tests.append((FIELDS[f.attribute[0]], kind, tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, path = located(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.File:
            files = [info]
        else:
            found = {f.path: f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File}
            lists = [f for f in found if f.rsplit("/", 1)[-1].startswith("_manifest-")]
            if lists:
                named = [f"{path}/{n}" for m in lists for n in json.loads(store.open_input_stream(m).read())]
                files = [found[n] for n in sorted(named)]
            else:
                files = [found[n] for n in sorted(found) if n.endswith((".warc", ".warc.gz"))]
        return [Range(f.path, k, min(f.size, k + self.range_bytes)) for f in files for k in range(0, f.size, self.range_bytes)]

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no files
            return
        store, _ = located(self.path)
        rows, size = [], 0
        with store.open_input_file(partition.file) as f:
            records = self.members(f, partition) if partition.file.endswith(".gz") else self.plain(f, partition)
            for offset, headers, block in records:
                payload = payload_of(headers, block) if block is not None else None
                rows.append([*(headers.get(h) for h in FIELDS.values()), int(headers.get("content-length", 0)), list(headers.items()), payload, partition.file, offset])
                size += len(payload or b"") + 500
                if size > 4 << 20:
                    yield batch(rows)
                    rows, size = [], 0
        if rows:
            yield batch(rows)

    def wanted(self, headers: dict[str, str]) -> bool:
        for name, kind, values in self.tests:
            got = headers.get(name)
            if got is None or not (got in values if kind == "in" else got.startswith(values[0])):
                return False
        return True

    def plain(self, f, part: Range):
        """Records of an uncompressed file that start in the range; a damaged one is an error."""
        at = part.start
        if at:
            at = search(f, START, max(0, at - 4), part.stop, 4, lambda p: plain_follower(f, p))
        while at is not None and at < part.stop:
            found = plain_head(f, at)
            if found is None:
                f.seek(at)
                if not f.read(4096).strip():
                    return
                raise ValueError(f"{part.file}: no whole record head at byte {at}")
            headers, begin = found
            n = int(headers.get("content-length", 0))
            block = None
            if self.wanted(headers):
                if self.payload:
                    f.seek(begin)
                    block = f.read(n)
                    if len(block) < n:
                        raise ValueError(f"{part.file}: the record at byte {at} is cut off")
                yield at, headers, block
            at = begin + n + 4

    def members(self, f, part: Range):
        """Records of a gzip file that start in the range; a damaged one is an error. A file whose members don't state their lengths belongs to its first range."""
        at, stop = part.start, part.stop
        f.seek(0)
        if not MEMBER.match(f.read(24)):
            if at:
                return
            stop = f.size()
        if at:
            at = search(f, MEMBER, at, stop, 0, lambda p: member_follower(f, p))
        while at is not None and at < stop:
            f.seek(at)
            raw = f.read(4096)
            if not raw:
                return
            size = struct.unpack("<I", raw[16:20])[0] if MEMBER.match(raw) else None
            z, plain = zlib.decompressobj(31), bytearray()
            while b"\r\n\r\n" not in plain and raw and not z.eof:
                plain += z.decompress(raw, 4096)
                raw = z.unconsumed_tail or f.read(65536)
            end = plain.find(b"\r\n\r\n")
            if end < 0 or not plain.startswith(b"WARC/"):
                raise ValueError(f"{part.file}: no whole record head in the member at byte {at}")
            headers = parse_head(bytes(plain[:end]))
            ok = self.wanted(headers)
            if size is None or ok and self.payload:
                keep = bytearray(plain) if ok and self.payload else None
                while not z.eof and raw:
                    more = z.decompress(raw, 1 << 20)
                    if keep is not None:
                        keep += more
                    raw = z.unconsumed_tail or (b"" if z.eof else f.read(65536))
                if not z.eof:
                    raise ValueError(f"{part.file}: the member at byte {at} is cut off")
                if size is None:
                    size = f.tell() - at - len(z.unused_data)
                n = int(headers.get("content-length", 0))
                block = bytes(keep[end + 4 : end + 4 + n]) if keep is not None else None
            else:
                block = None
            if ok:
                yield at, headers, block
            at += size


def plain_head(f, at: int) -> tuple[dict[str, str], int] | None:
    """Headers of the record at a byte, and where its block begins; None if no whole head is there."""
    f.seek(at)
    head = b""
    while b"\r\n\r\n" not in head and head[:5] == b"WARC/"[: len(head)] and (more := f.read(4096)):
        head += more
    end = head.find(b"\r\n\r\n")
    if end < 0 or not head.startswith(b"WARC/"):
        return None
    return parse_head(head[:end]), at + end + 4


def plain_follower(f, at: int) -> int | None:
    """Where the record after that at a byte begins by its length; None if no record can be there."""
    found = plain_head(f, at)
    if found is None or not found[0].get("content-length", "").isdigit() or "warc-type" not in found[0]:
        return None
    return found[1] + int(found[0]["content-length"]) + 4


def member_follower(f, at: int) -> int | None:
    f.seek(at)
    raw = f.read(24)
    return at + struct.unpack("<I", raw[16:20])[0] if MEMBER.match(raw) else None


def search(f, pattern: re.Pattern, start: int, stop: int, back: int, follower) -> int | None:
    """The first record start in [start + back, stop): where a match ends (back > 0) or begins and CHAIN records follow each other."""
    total, at, tail = f.size(), start, b""
    while at < stop + 64:
        f.seek(at)
        got = f.read(1 << 20)
        if not got:
            return None
        data = tail + got
        for m in pattern.finditer(data):
            found = at - len(tail) + (m.end() if back else m.start())
            if found >= stop:
                return None
            chain = found
            for _ in range(CHAIN):
                if chain is not None and chain < total:
                    chain = follower(chain)
            if chain is not None:
                return found
        # A match that begins in what is kept is found again, with what follows it.
        tail, at = data[-64:], at + len(got)
    return None


def batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.string(), pa.int64()]
    names = [*FIELDS, "content_length", "headers", "payload", "file", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=pa.schema(list(zip(names, kinds))))


class Written(WriterCommitMessage):
    def __init__(self, file: str | None):
        self.file = file


class WarcWriter(DataSourceArrowWriter):
    """Rows: warc_type, record_id, target_uri, refers_to, payload_digest, payload_bytes, payload (null in revisits)."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, path = located(self.path)
        name, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        for rows in iterator:
            for r in rows.to_pylist():
                if out is None:
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(member(record_bytes({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "Content-Type": "application/warc-fields"}, b"software: stancemill\r\nformat: WARC File Format 1.1\r\n")))
                headers = {
                    "WARC-Type": r["warc_type"],
                    "WARC-Record-ID": r["record_id"],
                    "WARC-Date": "1970-01-01T00:00:00Z",
                    "WARC-Target-URI": one_line(r["target_uri"]) if r["target_uri"] else None,
                    "WARC-Refers-To": r["refers_to"],
                    "WARC-Profile": REVISIT if r["warc_type"] == "revisit" else None,
                    "WARC-Payload-Digest": r["payload_digest"],
                    "X-Payload-Length": str(r["payload_bytes"]),
                    "Content-Type": "application/http; msgtype=response",
                }
                out.write(member(record_bytes(headers, HEAD + (r["payload"] or b""))))
        if out is not None:
            out.close()
        return Written(name if out is not None else None)

    def commit(self, messages: list[Written | None]) -> None:
        store, path = located(self.path)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([m.file for m in messages if m and m.file]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Unlisted files are never read; nothing needs to be undone."""


class WarcDataSource(DataSource):
    """format("warc"): read with options path, payload (false: headers only) and rangeBytes; write with append."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def page_records(pages: DataFrame, least: int = 100) -> DataFrame:
    """The records of pages (page_id, url, html, ...): of equal payloads of least bytes or more, the smallest page_id is the response."""
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long")})
    again = p.filter(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("digest", "first")
    # A written table has a known size: Spark broadcasts a small one in place of shuffling payloads and can split a hot digest of a large one.
    again = staged(again, "again")
    p = p.join(again, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.concat(F.lit("none:"), "digest")), F.lit(">"))
    return p.select(
        F.when(revisit, "revisit").otherwise("response").alias("warc_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.when(revisit, urn(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.col("size").alias("payload_bytes"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def page_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Writes a record for each page and reads the archives back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to and url. Sizes and digests of
    responses are computed from the payloads read back; revisits, which hold no payload, state them in their
    headers. A null html is an empty payload; payloads under 100 bytes are never revisits; rows that repeat
    the smallest page_id of a payload are all responses; a null page_id is a revisit wherever another row
    with its payload has an id. White space and control characters in a url come back percent-encoded, an
    empty or null url as null. No pages give no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    register(spark)
    small_batches(spark)
    path = path or shared_path(spark, "warc")
    page_records(pages).write.format("warc").mode("append").save(path)
    r = spark.read.format("warc").load(path).filter(F.col("warc_type").isin("response", "revisit"))
    number = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")
    full = F.col("warc_type") == "response"
    return r.select(
        number(F.col("record_id")).alias("page_id"),
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("headers")["x-payload-length"].cast("long")).alias("payload_bytes"),
        F.when(full, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        number(F.col("refers_to")).alias("refers_to"),
        F.col("target_uri").alias("url"),
    )
