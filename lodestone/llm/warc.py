"""WARC archives: a writer and a Python data source that reads them.

``write_archives`` writes one file for each partition to a shared folder, each record a gzip
member of its own whose extra field ``sl`` names its packed and plain length, so that a
reader may pass over it. Of records with equal payloads one holds the payload (a response)
and the others refer to it (revisits).

``spark.read.format("warc").load(path)`` plans one partition for each run of files of about
``partition_bytes``. Filters on record_type, page_id, target_uri and payload_digest are
pushed down: of each record the header is unpacked and parsed first, and the payload of a
record that they refuse is neither unpacked nor decoded. Option ``payload=false`` leaves
payloads undecoded altogether. A manifest table beside the archives names the files of
finished tasks with their sizes, so the driver moves no file and lists no folder. Folders
without one, and archives by others, where members hold no ``sl`` field or are not packed,
are read as well: the payload of a record that is no HTTP message is its whole block, a
length that is no number counts as 0.

Defined cases: a very long payload is one record; a null html counts as empty; a null url is written as none and read as null,
spaces and control characters of others are percent-encoded;
rows with a null page_id revisit the largest page_id of their payload, or are responses if
it has none; repeated rows get a record each, of the same type; an empty table makes
archives without records; columns besides page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull

from lodestone.llm.common import partitions, shared_dir, staged

SCHEMA = "record_type string, record_id string, page_id long, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload string"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PAGE_URN = "urn:x-page:"
#: The table, in the folder of the archives, of the files that finished tasks wrote.
MANIFEST = "manifest.parquet"


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes, level: int = 1) -> bytes:
    """``data`` as a gzip member with its packed and plain lengths in the extra field."""
    packer = zlib.compressobj(level, zlib.DEFLATED, -zlib.MAX_WBITS)
    packed = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff"
    total = len(head) + 2 + 12 + len(packed) + 8
    extra = b"sl" + struct.pack("<HII", 8, total, len(data))
    return head + struct.pack("<H", len(extra)) + extra + packed + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """The bytes of one record; a revisit has the length and digest of the payload, but not the payload."""
    block = HTTP_HEAD + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{uuid.uuid4().urn}>",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.insert(3, f"X-Page: <{PAGE_URN}{page_id}>")
    if url is not None:
        lines.insert(3, "WARC-Target-URI: " + "".join(c if " " < c else f"%{ord(c):02X}" for c in url))
    if kind == "revisit":
        lines.insert(3, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            lines.insert(4, f"WARC-Refers-To: <{PAGE_URN}{refers_to}>")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, out: str | None = None, least: int = 0) -> str:
    """Write ``pages(page_id, url, html)`` below ``out`` and return the folder of the archives.

    Of pages with equal payloads of at least ``least`` bytes the one with the largest page_id
    becomes the response and the others revisit it; smaller payloads are all responses.
    Files of failed attempts are left out: the manifest names only those of finished tasks.
    """
    out = out or shared_dir(pages.sparkSession)
    own = uuid.uuid4().hex
    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    source = source.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    # only payloads that more than one page has; read from a table, so that the join may split a payload of many pages
    heads = source.groupBy("sha").agg(F.max("page_id").alias("head"), F.count("*").alias("copies")).where("copies > 1")
    rows = source.join(staged(heads), "sha", "left").select("page_id", "url", "html", F.when(F.octet_length("html") >= least, F.col("head")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, folder = _filesystem(out)
        where.create_dir(folder, recursive=True)
        name = f"{own}-{uuid.uuid4().hex}.warc.gz"
        n = 0
        with where.open_output_stream(f"{folder}/{name}", compression=None) as f:
            info = b"software: lodestone\r\nformat: WARC File Format 1.1\r\n"
            f.write(member(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <" + uuid.uuid4().urn.encode() + b">\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: " + str(len(info)).encode() + b"\r\n\r\n" + info + b"\r\n\r\n"))
            for b in batches:
                for page, url, html, to in zip(*b.columns, strict=True):
                    page, to = page.as_py(), to.as_py()
                    revisit = to is not None and to != page
                    f.write(member(record("revisit" if revisit else "response", page, url.as_py(), html.as_py().encode(), to if revisit else None)))
                    n += 1
            size = f.tell()
        yield pa.RecordBatch.from_pydict({"name": [name], "records": [n], "size": [size]})

    rows.mapInArrow(write, "name string, records long, size long").write.parquet(f"{out}/{MANIFEST}")
    return out


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class WarcReader(DataSourceReader):
    #: Columns whose filters can be decided from a record's header.
    HEADER = ("record_type", "record_id", "page_id", "target_uri", "payload_digest", "payload_bytes", "refers_to")

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.size = int(options.get("partition_bytes", 32 << 20))
        self.wanted: dict[str, list[set]] = {}
        self.present: set[str] = set()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            at = getattr(f, "attribute", ())
            if len(at) == 1 and at[0] in self.HEADER and isinstance(f, EqualTo | In | IsNotNull):
                if isinstance(f, IsNotNull):
                    self.present.add(at[0])
                else:
                    self.wanted.setdefault(at[0], []).append({f.value} if isinstance(f, EqualTo) else set(f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        where, folder = _filesystem(self.path)
        if where.get_file_info(f"{folder}/{MANIFEST}").type == fs.FileType.Directory:
            told = pq.read_table(f"{folder}/{MANIFEST}", filesystem=where, columns=["name", "size"])  # a row for each file
            files = [(f"{folder}/{n}", s) for n, s in zip(told.column("name").to_pylist(), told.column("size").to_pylist(), strict=True)]
        else:
            found = where.get_file_info(fs.FileSelector(folder, recursive=True))
            files = [(f.path, f.size) for f in found if f.is_file and f.base_name.endswith((".warc", ".warc.gz"))]
        runs, size = [], self.size
        for path, n in sorted(files):
            if size + n > self.size or not runs:
                runs.append([])
                size = 0
            runs[-1].append(path)
            size += n
        return [Files(names) for names in runs]

    def read(self, partition: Files) -> Iterator[tuple]:
        where, _ = _filesystem(self.path)
        for name in partition.names:
            with where.open_input_file(name) as f:
                for head, rest in _records(f):
                    row = _fields(head)
                    if row is None or any(row[k] is None for k in self.present) or any(row[k] not in v for k, sets in self.wanted.items() for v in sets):
                        continue
                    payload = None
                    if self.payload and row["record_type"] == "response":
                        payload = _payload(head, rest()).decode("utf-8", "replace")
                    yield (*(row[k] for k in self.HEADER), payload)


def _payload(head: dict[str, str], block: bytes) -> bytes:
    """What an HTTP message carries behind its own header; another block is all payload."""
    if not head.get("content-type", "").startswith("application/http"):
        return block
    _, gap, body = block.partition(b"\r\n\r\n")
    return body if gap else block


def _number(text: str | None) -> int:
    return int(text) if text and text.isascii() and text.isdigit() else 0


def _fields(head: dict[str, str]) -> dict | None:
    """The columns that a response's or revisit's header gives; None for other records."""
    if head.get("warc-type") not in ("response", "revisit"):
        return None
    page = lambda s: int(s[len(PAGE_URN) + 1 : -1]) if s and re.fullmatch(f"<{PAGE_URN}-?[0-9]+>", s) else None
    length = head.get("x-payload-length")
    return {
        "record_type": head["warc-type"],
        "record_id": head.get("warc-record-id", "").strip("<>"),
        "page_id": page(head.get("x-page")),
        "target_uri": head.get("warc-target-uri"),
        "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        "payload_bytes": _number(length) if length else None,
        "refers_to": page(head.get("warc-refers-to")),
    }


def _head(text: bytes) -> dict[str, str]:
    lines = text.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _records(f, chunk: int = 1 << 16):
    """(header, a function that returns the block) of each record of an open file; headers come first."""
    at, end = 0, f.size()
    while at < end:
        f.seek(at)
        start = f.read(min(24, end - at))
        if start[:2] == b"\x1f\x8b":
            known = struct.unpack("<II", start[16:24]) if start[3] & 4 and start[12:14] == b"sl" and len(start) == 24 else None
            f.seek(at)
            source, plain = zlib.decompressobj(31), b""
            while b"\r\n\r\n" not in plain and not source.eof:
                data = source.unconsumed_tail or f.read(4096 if known else chunk)
                plain += source.decompress(data, 4096)
                if not data:
                    break
            cut = plain.find(b"\r\n\r\n") + 4
            head = _head(plain[:cut])
            need, got = _number(head.get("content-length")), [plain[cut:]]

            def rest(source=source, got=got, need=need):
                size = len(got[0])
                while not source.eof and size < need:
                    data = source.unconsumed_tail or f.read(chunk)
                    if not data:
                        break
                    got.append(source.decompress(data))
                    size += len(got[-1])
                return b"".join(got)[:need]

            yield head, rest
            if known:
                at += known[0]
            else:  # unpack to the member's end to find the next
                while not source.eof:
                    data = source.unconsumed_tail or f.read(chunk)
                    if not data:
                        break
                    source.decompress(data, chunk)
                at = f.tell() - len(source.unused_data)
        else:
            f.seek(at)
            plain = b""
            while b"\r\n\r\n" not in plain and (data := f.read(4096)):
                plain += data
            skipped = len(plain) - len(plain.lstrip(b"\r\n"))
            cut = plain.find(b"\r\n\r\n", skipped) + 4
            if cut < 4:
                return
            head = _head(plain[skipped:cut])
            need, begin = _number(head.get("content-length")), at + cut

            def rest(begin=begin, need=need):
                f.seek(begin)
                return f.read(need)

            yield head, rest
            at = begin + need + 4


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)


BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """The SHA-1 of a binary column in base 32: of each 20 bits, five hexadecimal digits, four letters."""
    digits, letters = F.sha1(data), []
    for n in range(8):
        value = F.conv(F.substring(digits, 5 * n + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(value, k).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for k in (15, 10, 5, 0)]
    return F.concat(*letters)


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Rows (page_id, payload_bytes, payload_digest, record_type, refers_to), lengths and digests from the payloads themselves.

    Responses are read with their payloads, revisits from their headers alone, by a filter on
    the record's type that the reader decides. A revisit has the length and digest of the
    response that it refers to, which must have the digest that the revisit names.
    """
    held = read_archives(spark, path).where("record_type = 'response'")
    data = F.encode("payload", "UTF-8")
    responses = staged(held.select("page_id", F.octet_length(data).cast("long").alias("payload_bytes"), base32_sha1(data).alias("payload_digest")))
    heads = responses.where("page_id is not null").distinct().select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    revisits = read_archives(spark, path, payload=False).where("record_type = 'revisit'").select("page_id", "refers_to", "payload_digest")
    found = revisits.join(heads, ["refers_to", "payload_digest"])
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).union(
        found.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit"), "refers_to")
    )


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The response and revisit records of the archives below ``path``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
