"""Legacy web archives (ARC, versions 1 and 2) converted to WARC, duplicates as revisits.

ARC: a version block says which header fields each record's line has; the last field is the
length of what follows. WARC identifiers, dates, types and digests are made from these, so
the same archive always converts to the same records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusveil.session import new_table_path

#: Header fields by version of the version block. Fixed values of the format.
FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEY_HEADER = "X-Record-Key"
#: Bytes of an archive that this module writes, about.
ARCHIVE = 8_000_000
RECORDS = (
    "archive string, place int, record_type string, uri string, ip string, date string, content_type string,"
    " http binary, payload binary, payload_bytes bigint, payload_digest string, record_key bigint"
)


def digest(payload: bytes) -> str:
    """Upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_record(version: int, url: str, ip: str, date: str, mime: str, body: bytes, code: int = 200, offset: int = 0, name: str = "-") -> bytes:
    """One ARC record: header line and body."""
    values = {
        "URL": url, "IP-address": ip, "Archive-date": date, "Content-type": mime, "Result-code": code, "Checksum": "-", "Location": "-",
        "Offset": offset, "Filename": name, "Archive-length": len(body),
    }
    return " ".join(str(values[f]) for f in FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_version_block(version: int, name: str, date: str) -> bytes:
    body = f"{version} 0 -\n{' '.join(FIELDS[version])}\n\n".encode()
    return arc_record(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", body, name=name)


def parse_arc(content: bytes):
    """(header fields, body) of every record, the version block first. The block's own field list
    rules the lines after it; the declared length alone says where a record ends."""
    at, fields = 0, None
    while at < len(content):
        if content[at] in b"\r\n":
            at += 1
            continue
        end = content.find(b"\n", at)
        line = content[at : end if end >= 0 else len(content)].decode("utf-8", "replace").rstrip("\r").split(" ")
        if fields is None:
            fields = FIELDS[2] if len(line) >= len(FIELDS[2]) else FIELDS[1]
        if end < 0 or len(line) < len(fields) or not line[-1].isdigit():
            raise ValueError(f"no ARC header line at byte {at}: {' '.join(line)[:80]!r}")
        # a URL may hold blanks, so the fields count from the end
        extra = len(line) - len(fields)
        header = dict(zip(fields, [" ".join(line[: extra + 1]), *line[extra + 1 :]]))
        start, length = end + 1, int(line[-1])
        if start + length > len(content):
            raise ValueError(f"a record of {length} bytes at byte {at} runs over the archive's end")
        body = content[start : start + length]
        if at == 0 and header["URL"].startswith("filedesc:"):
            stated = body.decode("utf-8", "replace").split("\n")
            if len(stated) > 1 and stated[1].strip():
                fields = tuple(stated[1].split())
        yield header, body
        at = start + length


def warc_date(arc_date: str) -> str:
    """14 digits, or fewer (the rest is the earliest time), as an ISO date."""
    d = (re.sub(r"\D", "", arc_date) + "00000101000000"[min(14, len(re.sub(r"\D", "", arc_date))) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """HTTP head with its blank line, and the payload; a body without a head is all payload."""
    if body.startswith(b"HTTP/") and (end := body.find(b"\r\n\r\n")) >= 0:
        return body[: end + 4], body[end + 4 :]
    return b"", body


def _key(head: bytes) -> int | None:
    found = re.search(rb"(?im)^" + KEY_HEADER.encode() + rb": *(-?\d+)\r?$", head)
    return int(found[1]) if found else None


def _converted(batches):
    for batch in batches:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            rows = []
            for place, (header, body) in enumerate(parse_arc(content or b"")):
                head, payload = split_http(body)
                kind = "warcinfo" if header["URL"].startswith("filedesc:") else "response" if head else "resource"
                rows.append((name, place, kind, header["URL"], header["IP-address"], warc_date(header["Archive-date"]), header["Content-type"],
                             head, payload, len(payload), digest(payload), _key(head)))
            schema = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(schema), schema)]
            yield pa.RecordBatch.from_arrays(columns, re.findall(r"(\w+) \w+(?:,|$)", RECORDS))


def convert_arc(archives: DataFrame, name_col: str = "archive", content_col: str = "content") -> DataFrame:
    """The records of ARC archives (one row each) with WARC fields, version blocks as warcinfo. A
    null or empty archive has no records; a damaged header line or length is an error."""
    return archives.select(F.col(name_col).cast("string").alias("archive"), F.col(content_col).cast("binary").alias("content")).mapInArrow(_converted, RECORDS)


def arc_archives(pages: DataFrame, key_col: str, url_col: str, text_col: str) -> DataFrame:
    """(archive, content): the pages as ARC archives of about ARCHIVE bytes, versions in turn. A null
    text is an empty payload; a null url becomes one made of the key; a null key is left out
    of the record; blanks and control characters of a url are percent-encoded."""

    def body(key, payload: bytes) -> bytes:
        own = "" if key is None else f"{KEY_HEADER}: {key}\r\n"
        return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode() + payload

    def run(batches):
        for batch in batches:
            part, size, version, made = [], 0, 1, 0
            first = f"{batch.column(0)[0].as_py()}-{batch.num_rows}" if batch.num_rows else ""

            def flush():
                name = f"pages-{first}-{made}.arc"
                return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([arc_version_block(version, name, "19960101000000") + b"".join(part)], pa.binary())], ["archive", "content"])

            for key, url, text in zip(*(c.to_pylist() for c in batch.columns)):
                where = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{key}"
                stamp = (key or 0) % 86400
                date = f"19960101{stamp // 3600:02d}{stamp // 60 % 60:02d}{stamp % 60:02d}"
                record = arc_record(version, where, "192.0.2.1", date, "text/html", body(key, (text or "").encode()), offset=size)
                part.append(record)
                size += len(record)
                if size >= ARCHIVE:
                    yield flush()
                    part, size, version, made = [], 0, 3 - version, made + 1
            if part:
                yield flush()

    rows = pages.select(F.col(key_col).cast("bigint").alias("key"), F.col(url_col).cast("string").alias("url"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "archive string, content binary")


def record_id(key: Column, payload_digest: Column, uri: Column) -> Column:
    """A name-based UUID of the record's key (its address, if it has none) and digest."""
    h = F.sha1(F.concat_ws("|", F.coalesce(key.cast("string"), uri), payload_digest).cast("binary"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12))


def with_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Response records with record_id and refers_to (null for what stays a response): of equal
    payloads of at least min_bytes, the record with the largest key stays and the others
    revisit it. Records without a key revisit one that has; without any they all stay.

    Only (key, digest) pairs are compared; payloads move once, by key. records is computed twice.
    """
    slim = records.where(F.col("payload_bytes") >= min_bytes).select("record_key", "payload_digest", "uri")
    tops = slim.where(F.col("record_key").isNotNull()).groupBy("payload_digest").agg(F.max_by(F.struct("record_key", "uri"), "record_key").alias("top"), F.count(F.lit(1)).alias("_n"))
    keys = slim.groupBy("record_key", "payload_digest").agg(F.count(F.lit(1)).alias("_same"))
    others = keys.join(tops, "payload_digest").where(~F.col("record_key").eqNullSafe(F.col("top")["record_key"])).select(
        F.col("record_key").alias("_key"), F.col("payload_digest").alias("_digest"),
        record_id(F.col("top")["record_key"], F.col("payload_digest"), F.col("top")["uri"]).alias("refers_to"),
    )
    return (
        records.join(others, F.col("record_key").eqNullSafe(F.col("_key")) & (F.col("payload_digest") == F.col("_digest")), "left")
        .withColumn("record_id", record_id(F.col("record_key"), F.col("payload_digest"), F.col("uri")))
        .drop("_key", "_digest")
    )


def warc_bytes() -> Column:
    """A record without the two line ends that close it: header lines, blank line, block."""

    def line(name: str, value: Column) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")

    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.col("http")).otherwise(F.concat("http", "payload"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise(F.col("record_type"))),
        line("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.when(F.col("record_type") != "warcinfo", F.col("uri"))),
        line("WARC-Filename", F.when(F.col("record_type") == "warcinfo", F.col("archive"))),
        line("WARC-IP-Address", F.when(F.col("record_type") != "warcinfo", F.col("ip"))),
        line("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
        line("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to"), F.lit(">"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("Content-Type", F.when(F.octet_length("http") > 0, F.lit("application/http; msgtype=response")).otherwise(F.col("content_type"))),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return F.concat(head.cast("binary"), block)


def write_warc(records: DataFrame, path: str, per_file: int) -> None:
    """One gzip WARC file per task and per_file records, through Spark's text writer: a record's
    bytes, and the record end as line end."""
    (
        records.select(warc_bytes().cast("string").alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
        .option("maxRecordsPerFile", per_file).text(path)
    )


def parse_warc(content: bytes):
    """(header fields in lower case, block) of every record, by declared lengths."""
    at = 0
    while at < len(content):
        if content[at] in b"\r\n":
            at += 1
            continue
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {}
        for field in content[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = field.partition(":")
            fields[name.lower()] = value.strip()
        start, length = end + 4, int(fields["content-length"])
        if start + length > len(content):
            raise ValueError(f"a record of {length} bytes at byte {at} runs over the file's end")
        yield fields, content[start : start + length]
        at = start + length


def _read(batches):
    names = ["record_id", "record_type", "refers_to", "uri", "date", "record_key", "payload_bytes", "payload_digest"]
    kinds = [pa.string()] * 5 + [pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        for content in batch.column(0).to_pylist():
            rows = []
            for fields, block in parse_warc(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content):
                head, payload = split_http(block)
                stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                size, own = len(payload), stated
                if fields["warc-type"] == "revisit":
                    size = int(re.search(rb"(?im)^Content-Length: *(\d+)\r?$", head)[1])
                elif stated != (own := digest(payload)):
                    raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
                rows.append((fields["warc-record-id"].strip("<>"), fields["warc-type"], fields.get("warc-refers-to", "").strip("<>") or None,
                             fields.get("warc-target-uri"), fields.get("warc-date"), _key(head), size, own))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 8, kinds)], names)


def read_warc(spark, path: str) -> DataFrame:
    """All records of the WARC files under path; payload digests are checked."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(
        _read, "record_id string, record_type string, refers_to string, uri string, date string, record_key bigint, payload_bytes bigint, payload_digest string"
    )


def archive_pages(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_bytes: int = 0) -> tuple[DataFrame, str]:
    """Pages -> ARC archives -> converted WARC files in the shared folder; the records read back and
    the files' path.

    Null texts are empty payloads, null urls get an address made of the key, repeated rows give
    a record each (rows that share the largest key and the payload all stay responses), an
    empty table gives no files. Files hold some ARCHIVE bytes of payload on average.
    """
    spark = pages.sparkSession
    path = new_table_path(spark, "warc")
    records = convert_arc(arc_archives(pages, key_col, url_col, text_col)).where("record_type <> 'warcinfo'")
    size = pages.agg(F.avg(F.octet_length(F.col(text_col))).alias("bytes")).first()["bytes"] or 0
    write_warc(with_revisits(records, min_bytes), path, max(1, int(ARCHIVE / (size + 500))))
    return read_warc(spark, path), path


def page_types(read: DataFrame) -> DataFrame:
    """(record_key, payload_bytes, payload_digest, record_type, refers_to): a revisit's target as its
    key. Revisits of one record may be very many, so only their slim rows are joined."""
    responses = read.where("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.max("record_key").alias("target"))
    return read.join(responses, "refers_to", "left").select("record_key", "payload_bytes", "payload_digest", "record_type", F.col("target").alias("refers_to"))
