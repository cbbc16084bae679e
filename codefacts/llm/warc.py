"""Archives: pages into legacy ARC files, ARC files into WARC files, WARC files back into rows.

ARC: a version block names the version and its header fields; each record is a header line of
5 (version 1) or 10 (version 2) fields and as many bytes as its last field declares. The converter
reads that line by the file's version and synthesises what WARC asks for: record ids from the
archive's name and the record's offset (so a repeated task writes the same ids), ISO timestamps
from 14 digits, types, block and payload digests. Records and their order are kept; of records with
equal payloads of ``least`` bytes or more, that of the largest page_id stays a response and the
others become revisits that refer to it. Records are gzip members of their own in both formats.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.llm.common import shared_path, staged
from codefacts.llm.storage import open_read, open_write
from codefacts.llm.vectors import groups

# fixed values: the header fields of the two versions
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 1


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(stream: Any) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member; ValueError if the last one is cut off."""
    at, rest = 0, b""
    while True:
        z, parts, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            rest = rest or stream.read(1 << 20)
            if not rest:
                if used:
                    raise ValueError("truncated archive")
                return
            parts.append(z.decompress(rest))
            used += len(rest) - len(z.unused_data)
            rest = z.unused_data if z.eof else b""
        yield at, b"".join(parts)
        at += used


def arc_head(line: bytes, version: int) -> dict[str, str]:
    """The fields of an ARC header line, by the version's names."""
    parts = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
    names = FIELDS[version]
    if len(parts) < len(names) or not parts[-1].isdigit():
        raise ValueError(f"not a header of version {version}: {line[:80]!r}")
    # an URL with spaces: the other fields are counted from the end
    extra = len(parts) - len(names)
    parts = [" ".join(parts[: extra + 1]), *parts[extra + 1 :]]
    return dict(zip(names, parts, strict=True))


def arc_version(block: bytes) -> int:
    """The version that a file's first block declares."""
    number = block.split(b" ", 1)[0]
    if number not in (b"1", b"2"):
        raise ValueError(f"unknown ARC version {number[:20]!r}")
    return int(number)


def arc_records(stream: Any, compressed: bool = True) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, content) of each record after the version block."""

    def each() -> Iterator[tuple[int, Any]]:
        if compressed:
            for at, data in members(stream):
                yield at, io.BytesIO(data)
        else:
            while True:
                yield stream.tell(), stream

    version = 0
    for at, f in each():
        line = f.readline()
        while line in (b"\n", b"\r\n"):
            at, line = (at if compressed else f.tell()), f.readline()
        if not line:
            return
        # the first line has the fields of its version: of version 1 where there are five
        head = arc_head(line, version or (2 if len(line.split(b" ")) >= 10 else 1))
        n = int(head["Archive-length"])
        body = f.read(n)
        if len(body) != n:
            raise ValueError("truncated ARC record")
        if not version:
            version = arc_version(body)
            continue
        yield at, head, body


def http_parts(body: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, payload) of an HTTP response."""
    at = body.find(b"\r\n\r\n")
    return (body, b"") if at < 0 else (body[: at + 4], body[at + 4 :])


def header_value(head: bytes, name: str) -> str | None:
    for line in head.split(b"\r\n"):
        key, _, value = line.partition(b":")
        if key.strip().lower() == name.lower().encode():
            return value.strip().decode("utf-8", "replace")
    return None


def arc_url(url: str | None, page_id: int | None) -> str:
    """An URL that fits a header line: white space and control characters are escaped."""
    if not url:
        return f"urn:page:{page_id}"
    return "".join("".join(f"%{b:02X}" for b in c.encode()) if c.isspace() or not c.isprintable() else c for c in url)


def write_arcs(pages: DataFrame, path: str, captured: str = "20240101000000", page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One ARC file for each partition, versions 1 and 2 in turn; the manifest (file_no, path).

    A page is an HTTP response with the html in UTF-8 (null: empty) and its page_id, where it has
    one, in a header field.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        version, name, out, at = 1 + part % 2, f"part-{part:06d}.arc.gz", None, 0
        where = f"{path}/{part:06d}-{uuid.uuid4().hex[:12]}.arc.gz"

        def line(url_: str, ip: str, kind: str, n: int) -> bytes:
            fields = [url_, ip, captured, kind, *(["200", "-", "-", str(at), name] if version == 2 else []), str(n)]
            return (" ".join(fields) + "\n").encode("utf-8", "replace")

        for batch in batches:
            for i, u, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = open_write(where)
                    block = (f"{version} 0 codefacts\n" + " ".join(FIELDS[version]) + "\n").encode()
                    at += out.write(_member(line(f"filedesc://{name}", "0.0.0.0", "text/plain", len(block)) + block + b"\n"))
                payload = (h or "").encode("utf-8", "replace")
                known = "" if i is None else f"X-Page-Id: {i}\r\n"
                body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{known}\r\n".encode() + payload
                at += out.write(_member(line(arc_url(u, i), "0.0.0.0", "text/html", len(body)) + body + b"\n"))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"file_no": part, "path": where}], schema=pa.schema([("file_no", pa.int32()), ("path", pa.string())]))

    p = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    return staged(p.mapInArrow(run, "file_no int, path string"), "arcs")


def _files(manifest: DataFrame) -> dict[int, str]:
    """The archives by number: as many rows as files."""
    return {r.file_no: r.path for r in manifest.collect()}


def _arc_name(file_no: int) -> str:
    return f"part-{file_no:06d}.arc.gz"


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def iso_date(digits: str) -> str:
    """2024-01-01T00:00:00Z of 20240101000000; what is missing at the end is the least value."""
    d = (digits + "00000101000000"[len(digits) :])[:14] if digits.isdigit() and len(digits) < 14 else digits[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(fields: dict[str, str], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


INDEX = "file_no int, offset long, page_id long, url string, captured string, payload_bytes long, payload_digest string"


def index_arcs(spark: SparkSession, arcs: DataFrame) -> DataFrame:
    """A row for each ARC record: where it is, and the length and digest of its payload."""
    paths = _files(arcs)
    numbers = sorted(paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file_no", pa.int32()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("captured", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rows = []
                with open_read(paths[numbers[k]]) as f:
                    for at, head, body in arc_records(f):
                        http, payload = http_parts(body)
                        known = header_value(http, "X-Page-Id")
                        rows.append({"file_no": numbers[k], "offset": at, "page_id": None if known is None else int(known), "url": head["URL"], "captured": iso_date(head["Archive-date"]), "payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest()})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return staged(spark.range(0, len(paths), 1, max(1, len(paths))).mapInArrow(run, INDEX), "arcindex")


def convert(spark: SparkSession, arcs: DataFrame, path: str, least: int = 1000) -> DataFrame:
    """WARC files of ARC files, one for one, below path; the manifest (file_no, path)."""
    index, paths = index_arcs(spark, arcs), _files(arcs)
    place = F.struct("page_id", "file_no", "offset")
    shared = index.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max_by(F.struct("file_no", "offset", "url", "captured"), place).alias("kept"), F.count("*").alias("n")).where("n > 1")
    shared = staged(shared.select(F.col("payload_digest").alias("same"), F.col("payload_bytes").alias("same_bytes"), "kept"), "sharedpayloads")
    other = (F.col("payload_digest") == F.col("same")) & (F.col("payload_bytes") == F.col("same_bytes"))
    # only revisits are dealt to their file; the rest of a file is read from it anyway
    each = index.where(F.col("payload_bytes") >= least).select("file_no", "offset", "payload_digest", "payload_bytes").join(shared, other)
    each = each.where((F.col("kept.file_no") != F.col("file_no")) | (F.col("kept.offset") != F.col("offset")))
    each = each.select("file_no", "offset", *[F.col(f"kept.{c}").alias(a) for c, a in (("file_no", "to_file"), ("offset", "to_offset"), ("url", "to_url"), ("captured", "to_date"))])
    every = spark.createDataFrame([(no,) for no in sorted(paths)], "file_no int").withColumns({"offset": F.lit(-1).cast("long"), "to_file": F.lit(None).cast("int"), "to_offset": F.lit(None).cast("long"), "to_url": F.lit(None).cast("string"), "to_date": F.lit(None).cast("string")})
    dealt = each.unionByName(every).repartitionByRange(max(1, len(paths)), "file_no").sortWithinPartitions("file_no", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, 1):
            no = g.column(0)[0].as_py()
            refers = {r["offset"]: r for r in g.to_pylist() if r["to_file"] is not None}
            where = f"{path}/{no:06d}-{uuid.uuid4().hex[:12]}.warc.gz"
            out = open_write(where)
            info = f"software: codefacts\r\nconverted-from: {_arc_name(no)}\r\n".encode()
            out.write(_member(warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(_arc_name(no), -1), "WARC-Date": iso_date("20240101000000"), "Content-Type": "application/warc-fields"}, info)))
            with open_read(paths[no]) as f:
                for at, head, body in arc_records(f):
                    http, payload = http_parts(body)
                    to = refers.get(at)
                    block = body if to is None else http
                    fields = {
                        "WARC-Type": "response" if to is None else "revisit",
                        "WARC-Record-ID": record_id(_arc_name(no), at),
                        "WARC-Date": iso_date(head["Archive-date"]),
                        "WARC-Target-URI": head["URL"],
                        "WARC-IP-Address": head["IP-address"],
                        "Content-Type": "application/http; msgtype=response",
                        "WARC-Payload-Digest": warc_digest(payload),
                        "WARC-Block-Digest": warc_digest(block),
                    }
                    if to is not None:
                        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(_arc_name(to["to_file"]), to["to_offset"]), "WARC-Refers-To-Target-URI": to["to_url"], "WARC-Refers-To-Date": to["to_date"]}
                    out.write(_member(warc_record(fields, block)))
            out.close()
            yield pa.RecordBatch.from_pylist([{"file_no": no, "path": where}], schema=pa.schema([("file_no", pa.int32()), ("path", pa.string())]))

    return staged(dealt.mapInArrow(run, "file_no int, path string"), "warcs")


def warc_records(stream: Any) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record; ValueError where a length, version or digest is wrong."""
    for _, data in members(stream):
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = {k: v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(fields["Content-Length"])
        block = rest[:n]
        if len(block) != n or rest[n:] != b"\r\n\r\n":
            raise ValueError("wrong WARC record length")
        if fields.get("WARC-Block-Digest", warc_digest(block)) != warc_digest(block):
            raise ValueError("wrong block digest")
        yield fields, block


RECORDS = "record_id string, record_type string, page_id long, target_uri string, captured string, payload_bytes long, payload_digest string, refers_to_id string, payload binary"


def read_warcs(spark: SparkSession, warcs: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each response or revisit record: digests in bare lower-case hex, lengths of the full payload."""
    paths = [p for _, p in sorted(_files(warcs).items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("target_uri", pa.string()), ("captured", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to_id", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rows: list[dict] = []
                size = 0
                with open_read(paths[k]) as f:
                    for fields, block in warc_records(f):
                        if fields["WARC-Type"] not in ("response", "revisit"):
                            continue
                        http, payload = http_parts(block)
                        full = fields["WARC-Type"] == "response"
                        if full and fields["WARC-Payload-Digest"] != warc_digest(payload):
                            raise ValueError("wrong payload digest")
                        known = header_value(http, "X-Page-Id")
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        rows.append({"record_id": fields["WARC-Record-ID"], "record_type": fields["WARC-Type"], "page_id": None if known is None else int(known), "target_uri": fields["WARC-Target-URI"], "captured": fields["WARC-Date"], "payload_bytes": len(payload) if full else int(header_value(http, "Content-Length") or 0), "payload_digest": digest, "refers_to_id": fields.get("WARC-Refers-To"), "payload": payload if payloads and full else None})
                        size += len(payload)
                        if size > 8_000_000:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.range(0, len(paths), 1, max(1, len(paths))).mapInArrow(run, RECORDS)


def archived(pages: DataFrame, least: int = 1000, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Pages written as ARC files, converted to WARC and read back: a row for each page.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to (page_id of the response
    that a revisit refers to). Null html is an empty payload, a null or unfit url is replaced or escaped;
    rows without page_id sort before all others; repeated rows are records of their own.
    """
    spark = pages.sparkSession
    path = shared_path(spark, "archives")
    warcs = convert(spark, write_arcs(pages, path, page_id=page_id, url=url, html=html), path, least)
    read = staged(read_warcs(spark, warcs, payloads=False).drop("payload"), "records")
    response = read.where("record_type = 'response'").select(F.col("record_id").alias("response_id"), F.col("page_id").alias("refers_to"))
    # responses refer to nothing: only revisits are joined
    own = read.where("refers_to_id IS NULL").withColumn("refers_to", F.lit(None).cast("long"))
    joined = read.where("refers_to_id IS NOT NULL").join(response, F.col("refers_to_id") == F.col("response_id"), "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return own.select(columns).unionByName(joined.select(columns))
