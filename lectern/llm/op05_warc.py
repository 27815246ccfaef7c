"""Legacy archive converter: ARC files of version 1 and 2 become WARC 1.1 files.

``read_arcs`` takes ARC files from a folder, plain or gzipped as a whole or record by record; ``arc_files`` packs pages into such files (a version
block, then records with the header line of their version). ``parse_arc`` reads them: the version block names the header fields, each record
line is parsed by its version, and the declared length alone says where a record ends. ``convert`` makes the equivalent WARC records: identifiers
(UUIDs of digest and page, so that reruns and retried tasks give the same ones), ISO timestamps, types, block and payload
digests. ``add_revisits`` decides which records repeat an equal payload; ``write_warc`` writes WARC files to a shared
folder, each record a gzip member of its own, and ``read_warc`` reads any such files back, checking each payload against its digest.

Files are written under names of their own by each attempt of a task; the commit on the driver removes those of attempts that failed.
A file is read as a whole by one task, so files are kept to ``FILE_BYTES`` of payload (one record at least), and those of others must be under 2 GB.

Equal payloads are found by SHA-1 and length over small rows (id, digest, length), aggregated on the map side, so a
group of copies of any size costs one row per task; payloads are shuffled once, by a key that is unique per page.

Nulls: a null payload is empty; a null url is written as ``urn:unknown``; a null id stays null, and never becomes the record others
refer to while another id has the same payload. Repeated ids with equal payloads are all responses if the id is the largest.
An empty table gives an empty archive and no rows. A damaged ARC line is skipped up to the next line that parses. Ids must be integers
(TypeError else).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .textkit import shared_dir, written

#: Field names of the header line in each ARC version.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
SEGMENT = 4 << 20
FILE_BYTES = 16 << 20
LEAST_BYTES = 1000
_BLANK = re.compile(r"[\x00-\x20\x7f]")
_END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _url(url: str | None) -> str:
    return _BLANK.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:unknown"


def arc_header(version: int, url: str, date: str, kind: str, size: int, ip: str = "0.0.0.0", name: str = "-", offset: int = 0, status: str = "200") -> bytes:
    values = [url, ip, date, kind] + ([status, "-", "-", str(offset), name] if version == 2 else []) + [str(size)]
    return " ".join(values).encode() + b"\n"


def arc_start(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 pages\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    return arc_header(version, f"filedesc://{name}", date, "text/plain", len(body), name=name) + body


def http_message(page_id: int | None, payload: bytes) -> bytes:
    own = f"X-Page-Id: {page_id}\r\n" if page_id is not None else ""
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode() + payload


def arc_files(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", date: str = "20000101000000") -> DataFrame:
    """ARC files of a few megabytes, one per row (name, content); version 1 and 2 by turns."""

    def run(batches):
        out, size, n = [], 0, 0
        tag = ""

        def flush():
            nonlocal out, size, n
            name, version = f"pages-{tag}-{n:05d}.arc", 1 + n % 2
            start = arc_start(version, name, date)
            parts, at = [start], len(start)
            for url, body in out:
                head = b"\n" + arc_header(version, url, date, "text/html", len(body), name=name, offset=at + 1)
                parts += [head, body]
                at += len(head) + len(body)
            out, size, n = [], 0, n + 1
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(parts)], pa.binary())], names=["name", "content"])

        for batch in batches:
            for i, url, html in zip(*(batch.column(k) for k in range(3)), strict=True):
                body = http_message(i.as_py(), html.as_buffer().to_pybytes() if html.is_valid else b"")
                tag = tag or hashlib.sha1(body).hexdigest()[:12]
                out.append((_url(url.as_py()), body))
                size += len(body)
                if size >= SEGMENT:
                    yield flush()
        if out:
            yield flush()

    if pages.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"{id_col} must be an integer column")
    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(text_col).cast("binary")).mapInArrow(run, "name string, content binary")


def members(raw: bytes, limit: int = 1 << 16) -> Iterator[bytes]:
    """The contents of gzip members that follow each other, or the bytes as they are. A cut last member is read as far as it goes."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    view, at = memoryview(raw), 0
    while at < len(raw) and raw[at : at + 2] == b"\x1f\x8b":
        engine, parts = zlib.decompressobj(31), []
        while not engine.eof and at < len(raw):
            piece = view[at : at + limit]
            parts.append(engine.decompress(piece))
            at += len(piece) - len(engine.unused_data)
        yield b"".join(parts)


def read_arcs(spark: SparkSession, path: str) -> DataFrame:
    """name and content of the .arc and .arc.gz files below a path."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{arc,arc.gz}").load(path)

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join(members(content.as_buffer().to_pybytes()))], pa.binary())], names=["name", "content"])

    return rows.select(F.regexp_extract("path", "([^/]+)$", 1), "content").mapInArrow(run, "name string, content binary")


def parse_arc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and body of each record after the version block."""
    fields, at, end = ARC_FIELDS[1], 0, len(content)
    while at < end:
        stop = content.find(b"\n", at)
        if stop < 0:
            return
        line = content[at:stop].decode("utf-8", "replace").split(" ")
        at = stop + 1
        # a URL may hold spaces: the other fields are counted from the right
        if len(line) < len(fields) and not line[0].startswith("filedesc:") or len(line) < 5 or not line[-1].isdigit() or at + int(line[-1]) > end:
            continue
        body = content[at : at + int(line[-1])]
        at += len(body)
        if line[0].startswith("filedesc:"):
            version = 2 if body[:1] == b"2" else 1
            named = body.split(b"\n", 2)[1].decode().split() if body.count(b"\n") >= 2 else []
            fields = named if len(named) >= 5 else ARC_FIELDS[version]
        else:
            rest = len(fields) - 1
            yield dict(zip(fields, [" ".join(line[:-rest]), *line[-rest:]], strict=True)), body


def sha1_base32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def iso_date(arc: str) -> str:
    d = (arc + "00000000000000")[:14] if arc.isdigit() and len(arc) >= 8 else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


_ROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()), ("kind", pa.string()), ("head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
_ID = re.compile(rb"\r\nX-Page-Id: (-?[0-9]+)\r\n")
_LENGTH = re.compile(rb"\r\nContent-Length: ([0-9]+)")


def convert(arcs: DataFrame) -> DataFrame:
    """Records of the ARC files, one per row: target, date and type as WARC has them, HTTP head, payload and its digest."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for head, body in parse_arc(content.as_buffer().to_pybytes()):
                    http = head["Content-type"] != "text/dns" and body.startswith(b"HTTP/")
                    cut = body.find(_END) + 4 if http and _END in body else 0
                    m = _ID.search(body, 0, cut)
                    payload = body[cut:]
                    rows.append((int(m[1]) if m else None, head["URL"], head["IP-address"], iso_date(head["Archive-date"]), "response" if http else "resource", body[:cut], payload, len(payload), hashlib.sha1(payload).hexdigest()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROW.types, strict=True)], schema=_ROW)

    return arcs.select("content").mapInArrow(run, "page_id long, url string, ip string, date string, kind string, head binary, payload binary, payload_bytes long, payload_digest string")


def add_revisits(records: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Adds refers_to: of equal payloads of at least ``least`` bytes, the largest page_id is kept and others refer to it."""
    small = written(records.select("page_id", "payload_digest", "payload_bytes").filter(F.col("payload_bytes") >= least), "payloads")
    groups = small.groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    plan = small.join(groups, ["payload_digest", "payload_bytes"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.coalesce("page_id", F.lit(-1)).alias("p"), F.col("page_id").isNull().alias("none"), F.col("payload_digest").alias("d"), "refers_to").distinct()
    key = (F.coalesce("page_id", F.lit(-1)) == F.col("p")) & (F.col("payload_digest") == F.col("d")) & (F.col("page_id").isNull() == F.col("none"))
    return records.join(plan, key, "left").drop("p", "d", "none")


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]).encode() + b"\r\n" + block


def warc_records(records: DataFrame) -> DataFrame:
    """The bytes of each WARC record, without the blank lines that end it; each partition begins with a warcinfo record."""

    def run(batches):
        first = True
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if first:
                    info = b"software: lectern\r\nformat: WARC File Format 1.1\r\n"
                    out.append(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(r["page_id"], "warcinfo")), ("WARC-Date", r["date"]), ("Content-Type", "application/warc-fields")], info))
                    first = False
                target, digest = r["refers_to"], "sha1:" + base64.b32encode(bytes.fromhex(r["payload_digest"])).decode()
                block = r["head"] if target is not None else r["head"] + r["payload"]
                kind = "revisit" if target is not None else r["kind"]
                head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(r["page_id"], r["payload_digest"])), ("WARC-Date", r["date"]), ("WARC-Target-URI", r["url"]), ("WARC-IP-Address", r["ip"]), ("WARC-Block-Digest", sha1_base32(block)), ("WARC-Payload-Digest", digest)]
                if target is not None:
                    head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(target, r["payload_digest"])), ("WARC-Refers-To-Page", str(target))]
                out.append(_record([*head, ("Content-Type", "application/http;msgtype=response" if r["head"] else "text/plain")], block))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return records.mapInArrow(run, "record binary")


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def _files(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path) if ":" in path else f"file://{path}")


class WarcWriter(DataSourceArrowWriter):
    """Writes the bytes of records, each as a gzip member with the blank lines that end it."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, folder = _files(self.path)
        system.create_dir(folder)
        names, out, size = [], None, 0
        for batch in batches:
            for record in batch.column(0):
                raw = record.as_buffer().to_pybytes()
                if out is not None and size + len(raw) > FILE_BYTES:
                    out.close()
                    out = None
                if out is None:
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{folder}/{names[-1]}", compression=None), 0
                out.write(gzip.compress(raw + _END, 4, mtime=0))
                size += len(raw)
        if out is not None:
            out.close()
        return Written(names)

    def commit(self, messages: list) -> None:
        system, folder = _files(self.path)
        system.create_dir(folder)
        kept = {name for m in messages if m is not None for name in m.files}
        for info in system.get_file_info(fs.FileSelector(folder)):
            if info.is_file and info.base_name.endswith(".warc.gz") and info.base_name not in kept:
                system.delete_file(info.path)
        system.open_output_stream(f"{folder}/_SUCCESS", compression=None).close()

    def abort(self, messages: list) -> None:
        system, folder = _files(self.path)
        system.delete_dir(folder)


class WarcSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lectern_warc"

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def write_warc(records: DataFrame, path: str) -> None:
    """WARC files in a new folder."""
    spark = records.sparkSession
    spark.dataSource.register(WarcSink)
    warc_records(records).write.format(WarcSink.name()).mode("append").option("path", path).save()


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        cut = data.find(_END, at)
        if cut < 0 or not data.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        head = dict(line.split(": ", 1) for line in data[at:cut].decode().split("\r\n")[1:])
        start = cut + 4
        stop = start + int(head["Content-Length"])
        if data[stop : stop + 4] != _END:
            raise ValueError(f"the record at byte {at} doesn't end after its declared length")
        yield head, data[start:stop]
        at = stop + 4


def read_warc(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """Records of WARC files: page_id, url, date, payload_bytes, payload_digest (hex), record_type, refers_to, the payload if asked for."""
    names = ["page_id", "url", "date", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * with_payload]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = []
                raw = content.as_buffer().to_pybytes()
                for head, block in (x for part in members(raw) for x in parse_warc(part)):
                    if head["WARC-Type"] not in ("response", "resource", "revisit"):
                        continue
                    if head.get("WARC-Block-Digest", sha1_base32(block)) != sha1_base32(block):
                        raise ValueError(f"{head['WARC-Record-ID']}: block digest differs")
                    cut = block.find(_END) + 4 if block.startswith(b"HTTP/") else 0
                    m = _ID.search(block, 0, cut)
                    revisit = head["WARC-Type"] == "revisit"
                    if revisit:
                        length = _LENGTH.search(block)
                        size, payload = int(length[1]) if length else None, None
                    else:
                        payload = block[cut:]
                        size = len(payload)
                        if head.get("WARC-Payload-Digest", sha1_base32(payload)) != sha1_base32(payload):
                            raise ValueError(f"{head['WARC-Record-ID']}: payload digest differs")
                    named = head.get("WARC-Payload-Digest") or (None if payload is None else sha1_base32(payload))
                    digest = named and base64.b32decode(named.removeprefix("sha1:")).hex()
                    target = int(head["WARC-Refers-To-Page"]) if "WARC-Refers-To-Page" in head else None
                    rows.append((int(m[1]) if m else None, head.get("WARC-Target-URI"), head.get("WARC-Date"), size, digest, head["WARC-Type"], target, *[payload] * with_payload))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    schema = "page_id long, url string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{warc,gz}").load(path).select("content").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages to ARC, ARC to WARC, WARC written to the shared folder and read back."""
    path = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_warc(add_revisits(convert(arc_files(pages))), path)
    return read_warc(pages.sparkSession, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with p as (select page_id, encode(coalesce(html, '')) as b, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as d from pages),
g as (select d, max(page_id) as keep from p where n >= 1000 group by d having count(*) > 1)
select page_id, n as payload_bytes, p.d as payload_digest, case when keep <> page_id then 'revisit' else 'response' end as record_type,
       case when keep <> page_id then keep end as refers_to
from p left join g on p.d = g.d and n >= 1000
"""
