"""Legacy archives to WARC: ARC records are parsed by their declared lengths and become WARC records.

`arc_block` and `arc_records` are the legacy format, `convert` makes WARC records of it, `archive` turns a
table of pages into a table of archive parts, and `read_back` reads such parts. Parts are rows
(archive, part, n_records, data) in the shared folder; `export` writes them as files and `arc_files` reads
ARC files of either version, gzipped or not.

Of records with equal payloads the one with the largest page_id is the response and the others revisit it.
Defined results: a null payload is empty; a null URL becomes a `urn:page:` name; equal rows that share the
largest page_id are all responses; a null page_id revisits any record of its payload that has one; further
columns are not read. An empty table makes no parts and no records.
"""

from __future__ import annotations

import base64
import datetime
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup, session, stored, tidy
from .words import slices

# The fields of a record's header line in the two versions of the ARC format.
FIELDS = {
    1: ("url", "ip", "date", "content_type", "length"),
    2: ("url", "ip", "date", "content_type", "result_code", "checksum", "location", "offset", "filename", "length"),
}
HEADER_LINES = {
    1: b"URL IP-address Archive-date Content-type Archive-length",
    2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEVEL = 1
EPOCH = "20200101000000"
PART_BYTES = 1 << 20


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


# --- the legacy format


def arc_head(name: str, date: str = EPOCH, version: int = 1) -> bytes:
    """The version block that opens an ARC file."""
    text = f"{version} 0 gramlode\n".encode() + HEADER_LINES[version] + b"\n"
    line = f"filedesc://{name} 0.0.0.0 {date} text/plain " + ("200 - - 0 " + f"{name} " if version == 2 else "")
    return line.encode() + str(len(text)).encode() + b"\n" + text + b"\n"


def arc_block(url: str, date: str, block: bytes, version: int = 1, name: str = "-", offset: int = 0) -> bytes:
    line = f"{url} 0.0.0.0 {date} text/html " + (f"200 {digest(block)} - {offset} {name} " if version == 2 else "")
    return line.encode() + str(len(block)).encode() + b"\n" + block + b"\n"


def arc_records(data: bytes) -> Iterator[dict]:
    """Records of one ARC file by declared length; the version block says which fields the lines have."""
    at, version = 0, 1
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            if data[at:].strip():
                raise ValueError(f"ARC: no header line at byte {at}")
            return
        line = data[at:end].rstrip(b"\r")
        if not line.strip():  # the line end that closes a record
            at = end + 1
            continue
        if line.startswith(b"filedesc:"):
            version = int(data[end + 1 : end + 3].split(b" ")[0])
            if version not in FIELDS:
                raise ValueError(f"ARC: version {version} is not known")
        fields = dict(zip(FIELDS[version], line.decode("utf-8", "replace").rsplit(" ", len(FIELDS[version]) - 1)))
        length = fields.get("length", "")
        if len(fields) != len(FIELDS[version]) or not length.isdigit() or end + 1 + int(length) > len(data):
            raise ValueError(f"ARC: a damaged header line or a short block at byte {at}")
        at = end + 1 + int(length)
        if not line.startswith(b"filedesc:"):
            yield fields | {"block": data[end + 1 : at]}


# --- WARC


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def warc_date(legacy: str) -> str:
    digits = (legacy + "00000101000000"[len(legacy) :])[:14] if legacy.isdigit() else EPOCH
    try:
        return datetime.datetime.strptime(digits, "%Y%m%d%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return warc_date(EPOCH)


def split_http(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """Header bytes, payload and header fields of an HTTP response; a block without headers is all payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block, {}
    head, gap, body = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    return head + gap, body, fields


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def convert(arc: dict, refers_to: int | None = None) -> bytes:
    """One WARC record of a legacy one: identifier, timestamp, type and digests are synthesised."""
    head, payload, http = split_http(arc["block"])
    sha, page = digest(payload), http.get("X-Page-Id", "")
    name = f"{page or arc['url'] + arc['date']} {sha}"
    fields = [("WARC-Type", "revisit" if refers_to is not None else "response" if head else "resource"), ("WARC-Record-ID", record_id(name)), ("WARC-Date", warc_date(arc["date"])), ("WARC-Target-URI", arc["url"]), ("WARC-IP-Address", arc["ip"]), ("WARC-Payload-Digest", f"sha1:{sha}")]
    block = arc["block"]
    if refers_to is not None:
        block = head
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(f"{refers_to} {sha}")), ("X-Refers-To-Page-Id", str(refers_to))]
    kind = "application/http; msgtype=response" if head else arc["content_type"]
    return warc_record([*fields, ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", kind)], block)


def warc_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"WARC: no record at byte {at}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        at = end + 4 + int(fields["Content-Length"])
        yield fields, data[end + 4 : at]
        if data[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"WARC: the block before byte {at} does not end there")
        at += 4


def members(data: bytes) -> Iterator[bytes]:
    """Uncompressed gzip members, or the data itself if it is plain."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data:
        z = zlib.decompressobj(31)
        yield z.decompress(data)
        data = z.unused_data.lstrip(b"\0")


# --- tables


def _archive(batches):
    part, data, n, size = 0, [], 0, 0
    origin = uuid.uuid4().hex

    def flush():
        return pa.RecordBatch.from_arrays([pa.array([f"{origin}.warc.gz"]), pa.array([part], pa.int64()), pa.array([n], pa.int64()), pa.array([b"".join(data)], pa.binary())], names=["archive", "part", "n_records", "data"])

    for batch in slices(batches, "html"):
        # the legacy archive of this slice, then its conversion record by record
        legacy, refers = [arc_head(f"{origin}.arc")], batch.column("refers_to").to_pylist()
        for page, url, html in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            body = (html or "").encode()
            head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page is None else page}\r\nContent-Length: {len(body)}\r\n\r\n"
            name = quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else f"urn:page:{page}"
            legacy.append(arc_block(name, EPOCH, head.encode() + body))
        for arc, to in zip(arc_records(b"".join(legacy)), refers, strict=True):
            data.append(gzip.compress(convert(arc, to), LEVEL, mtime=0))
            n, size = n + 1, size + len(data[-1])
            if size >= PART_BYTES:
                yield flush()
                part, data, n, size = part + 1, [], 0, 0
    if data:
        yield flush()


def _read(batches):
    for batch in batches:
        rows = []
        for data in batch.column("data").to_pylist():
            for member in members(data):
                for fields, block in warc_records(member):
                    head, payload, http = split_http(block)
                    sha, kind, page = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], http.get("X-Page-Id")
                    if f"sha1:{digest(block)}" != fields["WARC-Block-Digest"] or kind == "response" and digest(payload) != sha:
                        raise ValueError(f"WARC: a digest of {fields['WARC-Record-ID']} does not fit")
                    size = len(payload) if kind != "revisit" else int(http["Content-Length"])
                    to = fields.get("X-Refers-To-Page-Id")
                    rows.append((int(page) if page else None, size, sha, kind, int(to) if to else None, fields["WARC-Record-ID"], fields["WARC-Date"], fields["WARC-Target-URI"]))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
        columns = list(zip(*rows)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id", "warc_date", "target_uri"])


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, sha, refers_to) of the rows whose payload a row with a larger page_id has too."""
    html = F.coalesce(F.col("html"), F.lit(""))
    facts = stored(pages.select("page_id", F.sha1(html).alias("sha"), F.octet_length(html).alias("n_bytes")), "payloads")
    groups = facts.where(F.col("n_bytes") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n"))
    shared = stored(groups.where("n > 1 and refers_to is not null"), "shared-payloads")
    found = lookup(facts.drop("n_bytes"), shared, "sha", "n")
    return found.where("refers_to is not null and not page_id <=> refers_to").groupBy("page_id", "sha").agg(F.first("refers_to").alias("refers_to"))


def archive(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Archive parts (archive, part, n_records, data: gzip members of one record each), in the shared folder."""
    session(pages.sparkSession)
    found = revisits(pages, least_bytes).select(F.col("page_id").alias("_page"), F.col("sha").alias("_sha"), "refers_to")
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce(F.col("html"), F.lit(""))).alias("sha"))
    rows = rows.join(found, rows["page_id"].eqNullSafe(found["_page"]) & (rows["sha"] == found["_sha"]), "left")
    parts = rows.select("page_id", "url", "html", "refers_to").mapInArrow(tidy(_archive), "archive string, part long, n_records long, data binary")
    return stored(parts, "archives")


def read_back(parts: DataFrame) -> DataFrame:
    """One row per record of the parts; block digests and response payload digests are verified."""
    return parts.select("data").mapInArrow(tidy(_read), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, target_uri string")


def _convert_files(batches):
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            data = b"".join(members(content))
            records = [gzip.compress(convert(x), LEVEL, mtime=0) for x in arc_records(data)]
            yield pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2].removesuffix(".gz").removesuffix(".arc") + ".warc.gz"]), pa.array([0], pa.int64()), pa.array([len(records)], pa.int64()), pa.array([b"".join(records)], pa.binary())], names=["archive", "part", "n_records", "data"])


def arc_files(spark: SparkSession, path: str) -> DataFrame:
    """Parts converted from ARC files (versions 1 and 2, plain or gzipped), a file to a task's row."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(tidy(_convert_files), "archive string, part long, n_records long, data binary")


def export(parts: DataFrame, folder: str) -> None:
    """Write each part as a WARC file; `folder` is a URI that pyarrow.fs can open from every executor."""

    def write(rows):
        from pyarrow import fs

        target, root = fs.FileSystem.from_uri(folder)
        target.create_dir(root, recursive=True)
        for r in rows:
            name = f"{root}/{r.archive.removesuffix('.warc.gz')}-{r.part:05d}.warc.gz"
            temporary = f"{name}.{uuid.uuid4().hex}.tmp"  # a repeated task replaces the whole file
            with target.open_output_stream(temporary, compression=None) as out:
                out.write(r.data)
            target.move(temporary, name)

    parts.foreachPartition(write)
