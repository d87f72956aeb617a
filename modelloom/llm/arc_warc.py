"""Legacy ARC archives converted to WARC.

An ARC file opens with a version block that names its header fields: version 1 lines end in IP, date, type and length,
version 2 lines in IP, date, type, status, checksum, location, offset, file name and length. Lines are read from the right, so
URLs with spaces survive, and content is taken by its declared length. WARC records get identifiers made from what they
describe (the same on every run), ISO timestamps, types and SHA-1 payload digests; payloads that repeat become revisits of
the record with the largest page id.

Archives are written by Spark's text writer, committed task by task on any file system it reaches: each record is a gzip
member, which ends in a zero byte (an empty member is added to one that doesn't), and that byte is the writer's separator.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, prepare, staged

#: Fields after the URL.
FIELDS = {1: ("ip", "date", "mime", "length"), 2: ("ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length")}
NAMES = {1: "URL IP-address Archive-date Content-type Archive-length", 2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
PAGE_ID, PAYLOAD_LENGTH, REFERS_TO = "X-Page-Id", "X-Payload-Length", "X-Refers-To-Page-Id"
RECORD = "record_id string, kind string, uri string, ip string, date string, mime string, page_id long, http binary, payload binary, payload_digest string, payload_bytes long, error string"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
RECORDS_A_FILE, FILE_BYTES = 5_000, 1 << 30
#: Lengths up to which records share files; each further class ends at so many times the one before.
CLASS_BYTES, CLASSES = 1 << 20, 16


def arc_archive(name: str, version: int, pages: list[tuple[int | None, str | None, str | None]], date: str = "20240101000000") -> bytes:
    """An ARC archive of (page_id, url, html): HTTP responses whose headers carry the page id."""
    out = []

    def put(url: str, mime: str, content: bytes) -> None:
        more = ["200", "-", "-", str(sum(map(len, out))), name] if version == 2 else []
        out.append(" ".join([url, "0.0.0.0", date, mime, *more, str(len(content))]).encode("utf-8", "replace") + b"\n" + content + b"\n")

    put(f"filedesc://{name}", "text/plain", f"{version} 0 modelloom\n{NAMES[version]}\n\n".encode())
    for page, url, html in pages:
        body = (html or "").encode("utf-8", "replace")
        own = f"{PAGE_ID}: {page}\r\n" if page is not None else ""
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{own}Content-Length: {len(body)}\r\n\r\n"
        put("".join("%%%02X" % ord(c) if c in "\r\n" else c for c in url or "about:blank"), "text/html", head.encode() + body)
    return b"".join(out)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def iso(date: str) -> str:
    """A date of 4 to 14 digits as a WARC timestamp, what is missing as its first value."""
    d = "".join(c for c in date if c.isdigit())
    d = (d + "00000101000000"[len(d) :])[:14] if len(d) >= 4 else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def number(text: str | None) -> int | None:
    try:
        return int(text) if text is not None else None
    except ValueError:
        return None


def _header(line: str, version: int) -> dict | None:
    """The fields of a header line of the version; None if it isn't one."""
    names = FIELDS.get(version, ())
    values = line.rsplit(" ", len(names)) if names else []
    length = number(values[-1]) if len(values) == len(names) + 1 else None
    field = {"uri": values[0], **dict(zip(names, values[1:], strict=True)), "length": length} if length is not None and length >= 0 else {}
    return field if field.get("date", "").isdigit() else None


def arc_records(data: bytes) -> Iterator[dict]:
    """The archive's records. Bytes where no header line stands give one `unreadable` record up to the next line that reads
    as one; a length beyond the end gives a record with `error`. Identifiers are made from the archive's name, the place in
    it and what is there, so rows that repeat differ and a second reading gives the same."""
    at, version, name = 0, 0, ""
    while at < len(data):
        if data[at] in (10, 13):
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r").decode("utf-8", "replace")
        if not version and line.startswith("filedesc://"):
            version = 2 if data[end + 1 : end + 2] == b"2" else 1
        field = _header(line, version) if end >= 0 else None
        if field is None:
            start = at
            while 0 <= end < len(data) - 1:
                at, end = end + 1, data.find(b"\n", end + 1)
                if _header(data[at : end if end >= 0 else len(data)].rstrip(b"\r").decode("utf-8", "replace"), version):
                    break
            else:
                at = len(data)
            yield {"kind": "unreadable", "uri": line[:2000], "payload_bytes": at - start, "error": "not an ARC header line", "record_id": f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {start} {line}')}"}
            continue
        length = field["length"]
        content = data[end + 1 : end + 1 + length]
        uri, date = field["uri"], iso(field["date"])
        http, payload, kind = b"", content, "resource"
        if uri.startswith("filedesc://"):
            kind, name = "warcinfo", uri
        elif content.startswith(b"HTTP/"):
            head, mark, body = content.partition(b"\r\n\r\n")
            http, payload, kind = head + b"\r\n\r\n", body if mark else b"", "response"
        known = digest(payload)
        page = number(headers(http).get(PAGE_ID.lower())) if http else None
        yield {
            "record_id": f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name} {at} {uri} {date} {page} {known}')}", "kind": kind, "uri": uri, "ip": field["ip"], "date": date, "mime": field["mime"], "page_id": page,
            "http": http, "payload": payload, "payload_digest": known, "payload_bytes": len(payload), "error": None if len(content) == length else "shorter than declared",
        }
        at = end + 1 + length


def warc_record(r: dict, refers_to: dict | None) -> bytes:
    """The WARC record of an ARC record; with refers_to (record_id, uri, date, page_id), a revisit of that without the payload.
    What an archive says of itself is no list of WARC fields and stays plain text."""
    kind = r["kind"] if r["kind"] in ("response", "warcinfo") else "resource"
    revisit = refers_to is not None
    block = (r["http"] or b"") + (b"" if revisit else r["payload"] or b"")
    mime = "application/http; msgtype=response" if kind == "response" else "text/plain" if kind == "warcinfo" else r["mime"] or "application/octet-stream"
    head = [("WARC-Type", "revisit" if revisit else kind), ("WARC-Record-ID", f"<{r['record_id']}>"), ("WARC-Date", r["date"] or iso("")), ("WARC-Target-URI", r["uri"]), ("WARC-IP-Address", r["ip"]), ("Content-Type", mime), ("WARC-Payload-Digest", f"sha1:{r['payload_digest']}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), (PAYLOAD_LENGTH, r["payload_bytes"]), (PAGE_ID, r["page_id"])]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to['record_id']}>"), ("WARC-Refers-To-Target-URI", refers_to["uri"]), ("WARC-Refers-To-Date", refers_to["date"]), (REFERS_TO, refers_to["page_id"])]
    if r["error"]:
        head.append(("WARC-Truncated", "length"))
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*head, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "replace") + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A gzip member less its last byte, which is zero."""
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    if out[-1]:
        z = zlib.compressobj(3, zlib.DEFLATED, 31)
        out += z.compress(b"") + z.flush()
    return out[:-1]


def members(data: bytes) -> Iterator[bytes]:
    at, view = 0, memoryview(data)
    while at < len(data):
        z, out = zlib.decompressobj(31), []
        while not z.eof and at < len(data):
            part = view[at : at + 65536]
            out.append(z.decompress(part))
            at += len(part) - len(z.unused_data)
        if any(out):
            yield b"".join(out)


def warc_records(data: bytes) -> Iterator[dict]:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of the records of a WARC file, digests of payloads that are there checked."""
    for record in members(data):
        head, _, rest = record.partition(b"\r\n\r\n")
        h = headers(head)
        if h["warc-type"] == "warcinfo":
            continue
        block = rest[: int(h["content-length"])]
        known = h["warc-payload-digest"].partition(":")[2]
        if h["warc-type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if digest(payload) != known or len(payload) != int(h[PAYLOAD_LENGTH.lower()]):
                raise ValueError(f"the payload of {h['warc-record-id']} does not match its digest")
        yield {"page_id": number(h.get(PAGE_ID.lower())), "payload_bytes": int(h[PAYLOAD_LENGTH.lower()]), "payload_digest": known, "record_type": h["warc-type"], "refers_to": number(h.get(REFERS_TO.lower()))}


def _table(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_schema = lambda text: pa.schema([(a, _KINDS[b]) for a, b in (x.split() for x in text.split(", "))])


def pages_to_arc(pages: DataFrame, records: int = 100) -> DataFrame:
    """(name, archive) with about `records` pages an archive, versions 1 and 2 by turns. Null urls become about:blank, null html is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for i in range(0, batch.num_rows, records):
                part = batch.slice(i, records)
                name, n = f"pages-{TaskContext.get().partitionId():06d}-{n:06d}.arc", n + 1
                data = arc_archive(name, 1 + n % 2, list(zip(*(c.to_pylist() for c in part.columns), strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], ["name", "archive"])

    prepare(pages.sparkSession)
    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "name string, archive binary")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """(name, archive) of the ARC files under `path`."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), F.col("content").alias("archive"))


def arc_table(archives: DataFrame) -> DataFrame:
    """A row per record of `archives` (archive: the bytes of ARC files, gzip or not; a null one has none)."""
    schema = _schema(RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                data = b"".join(members(data)) if data and data[:2] == b"\x1f\x8b" else data or b""
                rows = []
                for r in arc_records(data):
                    rows.append(r)
                    if len(rows) == 100:
                        yield _table(rows, schema)
                        rows = []
                if rows:
                    yield _table(rows, schema)

    prepare(archives.sparkSession)
    return archives.select("archive").mapInArrow(run, RECORD)


def convert(archives: DataFrame, path: str, least: int = 0) -> None:
    """Writes the records of `archives` as WARC under `path`.

    Of records with equal payloads of at least `least` bytes, that with the largest page_id is a response and the others
    revisit it; rows that repeat both are responses all. Without any page_id among them all are responses. Records without
    HTTP headers become resources; bytes that can't be read are told by `arc_table` and not written. Archives are parsed
    again for each class of lengths (to 1 MB, 16 MB, ...), so that payloads need no shuffle unless very many repeat. Files hold
    so many records of one class that they stay under FILE_BYTES even if all were as long as its longest, for a file is read as
    one value; a long record leaves the files of others as they are. An empty table gives an empty file set.
    """
    records = arc_table(archives).where("kind <> 'unreadable'")
    keys = staged(records.select("payload_digest", "payload_bytes", "page_id", "record_id", "uri", "date", "kind"), "keys")
    # a row for each class that there is, a handful
    place = F.expr(f"CAST(ceil(log({CLASSES}, greatest(1, (payload_bytes + 4096) / {CLASS_BYTES}.0))) AS INT)")
    classes = {r["place"]: r["longest"] for r in keys.groupBy(place.alias("place")).agg(F.max("payload_bytes").alias("longest")).collect()} or {0: 0}
    several = keys.where(F.col("kind").isin("response", "resource") & (F.col("payload_bytes") >= least)).groupBy("payload_digest")
    many = several.agg(F.max_by(F.struct("record_id", "uri", "date", "page_id"), F.struct("page_id", "record_id")).alias("latest"), F.count(F.lit(1)).alias("n")).where("n > 1 AND latest.page_id IS NOT NULL").drop("n")
    many = bounded(staged(many, "repeated"))
    schema = pa.schema([("member", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 100):
                rows = batch.slice(i, 100).to_pylist()
                out = []
                for r in rows:
                    other = r["kind"] in ("response", "resource") and r["payload_bytes"] >= least and r["latest"] is not None and r["page_id"] != r["latest"]["page_id"]
                    out.append(member(warc_record(r, r["latest"] if other else None)))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], schema=schema)

    joined = records.join(many, "payload_digest", "left").select(*(x.split()[0] for x in RECORD.split(", ")), "latest")
    for i, longest in sorted(classes.items()):
        built = (joined.where(place == i) if len(classes) > 1 else joined).mapInArrow(run, "member binary").select(F.col("member").cast("string"))
        built.write.mode("append").option("lineSep", "\0").option("maxRecordsPerFile", max(1, min(RECORDS_A_FILE, FILE_BYTES // (longest + 4096)))).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record under `path`."""
    schema = _schema(RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                yield _table(list(warc_records(data.as_py())), schema)

    prepare(spark)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RESULT)
