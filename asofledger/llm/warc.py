"""WARC archives: written from a table of pages, read back, and assembled into captures.

Method. write_archives() gives each page three records (request, response or revisit, metadata) of which the first and last name the second one by WARC-Concurrent-To. A record ends with two line ends, so Spark's text writer with
that separator writes the archives: on any file system, compressed, and committed task by task. read_records() takes lines of the archives in the order of the file (gzip files are never split) and cuts records by Content-Length alone, so whatever a
payload holds can't be taken for a record; a task holds one record and one Arrow batch. captures() assembles transactions: requests and metadata meet the response or revisit that they are concurrent to in joins on record identifiers, one nested
row a capture. resolve() gives a revisit its payload's length and the page it refers to, by the payload digest.

Of pages with equal payloads (SHA-1, of LEAST_BYTES at least) the one with the smallest page_id is a response, the others are revisits without payload; smaller payloads are all responses. Only pages whose payload repeats (by a bitmap of 16 MB) are shuffled for that.

Cases. Null html is an empty payload. Null ids: a row without id revisits a row with one, and is a response where no row of its payload has one. Rows with the smallest id of their payload are all responses. Repeated rows are captures of their own. White space and control
characters of a url are %20 in WARC-Target-URI; the metadata record has the url itself, and none if it is null. Empty tables give archives without records. Extra columns are left out. An archive that ends within a record, or has none where one
must be, raises; so does a record whose payload has another digest than it says.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, clean_text, materialize, release, shared_dir, split_by

LEAST_BYTES = 0
CRLF, END = "\r\n", "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
# The profile of a revisit with the same payload, and the digits of base 32.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD = "record_id string, record_type string, concurrent_to string, target_uri string, date string, content_type string, http_status int, fields map<string,string>, payload_bytes long, payload_digest string"
#: Payload bytes that a reading task hands on at a time, besides a single larger payload.
FLUSH = 1 << 22


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a text's bytes in base 32: every five of its 40 hexadecimal digits are four of base 32."""
    digest = F.sha1(payload)
    quads = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), DIGITS, BASE32)


def _identifier(*names: Column | str) -> Column:
    """A record identifier from a name."""
    d = F.md5(F.concat_ws("|", *[n if isinstance(n, Column) else F.lit(n) for n in names]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", F.substring(d, 1, 8), F.substring(d, 9, 4), F.substring(d, 13, 4), F.substring(d, 17, 4), F.substring(d, 21, 12)), F.lit(">"))


def _record(headers: dict[str, Column], block: Column) -> Column:
    """A record without its end; headers that are null are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in (headers | {"Content-Length": F.octet_length(block).cast("string")}).items()]
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines), F.lit(END), block)


def classified(pages: DataFrame, least_bytes: int = LEAST_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, digest, first (id and url of the row that this one revisits, null for a response) and place (what tells repeated rows apart)."""
    own = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), clean_text(f"`{html_col}`").alias("html")).withColumn("digest", base32_sha1(F.col("html")))
    sizes = own.groupBy("digest").agg(F.count("*").alias("n"), F.max(F.octet_length("html")).alias("size"), F.min(F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "url")).alias("o"))
    repeated = materialize(sizes.where("n > 1").select("digest", F.when(F.col("size") >= least_bytes, F.struct("o.page_id", "o.url")).alias("o")), "repeated")
    alone, rest = split_by(own, "digest", bitmap(repeated.select(F.col("digest").alias("key"))))
    none = repeated.schema["o"].dataType
    met = rest.join(repeated, "digest", "left").withColumn("first", F.when(~F.col("page_id").eqNullSafe(F.col("o.page_id")), F.col("o"))).withColumn("place", F.monotonically_increasing_id())
    return alone.withColumns({"first": F.lit(None).cast(none), "place": F.lit(None).cast("long")}).unionByName(met.drop("o"))


def archive_rows(pages: DataFrame, least_bytes: int = LEAST_BYTES, date: str = DATE, **columns: str) -> DataFrame:
    """The records of each page as one text: request, response or revisit, metadata. No end after the last one."""
    rows = classified(pages, least_bytes, **columns)
    again = F.col("first").isNotNull()
    name = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("page_id", "place", "digest", "url")]
    own, when = _identifier("capture", *name), F.lit(date)
    uri = lambda c: F.regexp_replace(c, r"[\x00-\x20\x7F]", "%20")
    target = uri(F.col("url"))
    path = F.coalesce(F.nullif(F.regexp_extract(target, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1), F.lit("")), F.lit("/"))
    host = F.regexp_extract(target, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    size = F.octet_length("html").cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(END))
    request = _record(
        {"WARC-Type": F.lit("request"), "WARC-Record-ID": _identifier("request", *name), "WARC-Date": when, "WARC-Target-URI": target, "WARC-Concurrent-To": own, "Content-Type": F.lit("application/http;msgtype=request")},
        F.concat(F.lit("GET "), F.coalesce(path, F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit(END)),
    )
    headers = {"WARC-Record-ID": own, "WARC-Date": when, "WARC-Target-URI": target, "WARC-Payload-Digest": F.concat(F.lit("sha1:"), "digest"), "Content-Type": F.lit("application/http;msgtype=response")}
    response = _record({"WARC-Type": F.lit("response")} | headers, F.concat(head, "html"))
    revisit = _record({"WARC-Type": F.lit("revisit"), "WARC-Profile": F.lit(PROFILE), "WARC-Refers-To-Target-URI": uri(F.col("first.url")), "WARC-Refers-To-Date": when} | headers, head)
    facts = F.concat(F.coalesce(F.concat(F.lit("page_id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")), F.lit("url: "), F.to_json(F.struct("url")), F.lit(CRLF))
    metadata = _record({"WARC-Type": F.lit("metadata"), "WARC-Record-ID": _identifier("metadata", *name), "WARC-Date": when, "WARC-Target-URI": target, "WARC-Concurrent-To": own, "Content-Type": F.lit("application/warc-fields")}, facts)
    return rows.select(F.concat(request, F.lit(END), F.when(again, revisit).otherwise(response), F.lit(END), metadata).alias("value"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = DATE, **columns: str) -> None:
    """The pages as gzip archives in a new folder."""
    archive_rows(pages, least_bytes, date, **columns).write.option("lineSep", END).option("compression", "gzip").text(path)


def header_fields(head: bytes) -> dict[str, str]:
    """Named fields of a block of lines; names in lower case, the last of equal names counts."""
    pairs = (line.partition(b":") for line in head.split(b"\r\n"))
    return {name.strip().lower().decode("utf-8", "replace"): value.strip().decode("utf-8", "replace") for name, colon, value in pairs if colon}


def cut_record(buffer: bytearray, at: int) -> tuple[dict[str, str], int, int] | None:
    """Fields, start and end of the block of the record at a place of the buffer; None if it isn't all there."""
    head = buffer.find(b"\r\n\r\n", at)
    if head < 0:
        return None
    if buffer[at : at + 5] != b"WARC/":
        raise ValueError(f"no WARC record where one must begin: {bytes(buffer[at : at + 40])!r}")
    fields = header_fields(bytes(buffer[at:head]))
    end = head + 4 + int(fields["content-length"])
    return (fields, head + 4, end) if end + 4 <= len(buffer) else None


def record_row(fields: dict[str, str], block: bytes) -> dict:
    """A record's columns, payload included."""
    kind, payload, more, status = fields.get("warc-type"), block, {}, None
    if fields.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        words = head.split(b"\r\n", 1)[0].split()
        status = int(words[1]) if kind != "request" and len(words) > 1 and words[1].isdigit() else None
    elif fields.get("content-type") == "application/warc-fields":
        more = header_fields(block)
    said = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if kind == "response" and said and said != found:
        raise ValueError(f"record {fields.get('warc-record-id')}: payload digest {found}, not {said}")
    return {
        "record_id": fields.get("warc-record-id"), "record_type": kind, "concurrent_to": fields.get("warc-concurrent-to"), "target_uri": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "content_type": fields.get("content-type"),
        "http_status": status, "fields": list(more.items()), "payload_bytes": None if kind == "revisit" else len(payload), "payload_digest": said if kind == "revisit" else found, "payload": payload,
    }


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of gzip archives: RECORD, and payload (without HTTP headers) if asked for. A revisit has no length, and the digest that it says."""
    lines = spark.read.option("lineSep", "\n").option("pathGlobFilter", "*.gz").text(path).select(F.col("value").cast("binary").alias("line"), F.xxhash64("_metadata.file_path").alias("file"))
    kinds = [("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("http_status", pa.int32()), ("fields", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())]
    kinds += [("payload", pa.binary())] if payload else []

    def made(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in kinds], names=[n for n, _ in kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, file, rows, held = bytearray(), None, [], 0
        for batch in batches:
            files = batch.column(1).to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(files)) + 1).tolist()] if len(files) else []
            for a, b in zip(starts, [*starts[1:], len(files)]):
                if files[a] != file and buffer.strip():
                    raise ValueError("an archive ends within a record")
                if files[a] != file:
                    buffer, file = bytearray(), files[a]
                buffer += b"\n".join(batch.column(0).slice(a, b - a).to_pylist()) + b"\n"
                at = 0
                while True:
                    while buffer.startswith(b"\r\n", at):
                        at += 2
                    if at >= len(buffer) or (cut := cut_record(buffer, at)) is None:
                        break
                    fields, begin, at = cut
                    rows.append(record_row(fields, bytes(buffer[begin:at])))
                    held += at - begin if payload else 0
                    if not payload:
                        rows[-1]["payload"] = None
                    if held >= FLUSH or len(rows) >= 4096:
                        yield made(rows)
                        rows, held = [], 0
                del buffer[:at]
        if buffer.strip():
            raise ValueError("an archive ends within a record")
        yield made(rows)
        release()

    return lines.mapInArrow(run, RECORD + (", payload binary" if payload else ""))


def captures(records: DataFrame) -> DataFrame:
    """One row per response or revisit: record_id, capture (its record), request and metadata (those concurrent to it, null without; of several the one with the smallest record_id)."""
    columns = records.columns
    whole = F.struct(*columns)
    main = records.where(F.col("record_type").isin("response", "revisit")).select("record_id", whole.alias("capture"))
    side = lambda kind: records.where((F.col("record_type") == kind) & F.col("concurrent_to").isNotNull()).groupBy(F.col("concurrent_to").alias("record_id")).agg(F.min_by(whole, "record_id").alias(kind))
    return main.join(side("request"), "record_id", "left").join(side("metadata"), "record_id", "left")


def resolve(found: DataFrame) -> DataFrame:
    """captures() -> page_id, url, payload_bytes, payload_digest, record_type and refers_to: for a revisit the length of the payload that it shares, and the smallest page_id among its digest's responses."""
    json_url = F.get_json_object(F.element_at("metadata.fields", "url"), "$.url")
    flat = found.select(F.element_at("metadata.fields", "page_id").cast("long").alias("page_id"), json_url.alias("url"), "capture.payload_bytes", "capture.payload_digest", "capture.record_type")
    flat = materialize(flat, "captures")
    again = flat.where("record_type = 'revisit'")
    wanted = bitmap(again.select(F.col("payload_digest").alias("key")))
    _, origins = split_by(flat.where("record_type = 'response'"), "payload_digest", wanted)
    origins = materialize(origins.groupBy("payload_digest").agg(F.max("payload_bytes").alias("size"), F.min("page_id").alias("refers_to")), "origins")
    known = again.join(origins, "payload_digest", "left").select("page_id", "url", F.col("size").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
    return flat.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(known)


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Pages written as archives in the shared folder, read back, assembled and resolved."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least_bytes)
    return resolve(captures(materialize(read_records(spark, path, payload=False), "records")))
