"""From legacy ARC archives to WARC records, and back to rows.

An ARC file begins with a version block and holds documents, each under a header line that ends in the document's length:
five fields in version 1, ten in version 2. The converter follows the declared lengths, never the contents,
synthesises what WARC asks for (identifiers from file and offset, timestamps from the 14 digits, types from the
content, digests of block and payload) and carries the documents over byte for byte.
Of records with equal payloads one is the response and the others revisit it without a payload.

Archives are written by Spark's text writer with its commit protocol, so a lost task leaves no part of a file: a task packs
its records into archives of SEGMENT bytes, one row each, and every row becomes a file (its last line break comes from
the writer). They are read whole, one a row, which SEGMENT (or one larger record) bounds.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import erase, raw, read, shared_dir, small_batches
from .groups import with_least

#: Bytes of records after which a task begins the next archive.
SEGMENT = 16 << 20
#: The least payload that is worth a revisit.
LEAST_PAYLOAD = 100

#: Fixed values of the two formats.
ARC_FIELDS = {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
ARC_WIDTH = {1: 5, 2: 10}
REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD = "WARC/1.0"
#: The header of a document's own that carries the key of the row it was made from.
KEY = "X-Row-Key"


def _put(df: DataFrame, path: str, end: str) -> None:
    """Each row one file, packed fast; `end` is what the writer adds to each."""
    df.write.option("lineSep", end).option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", 1).text(path)


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def _unpacked(content: bytes) -> bytes:
    import gzip

    return gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content


def _segments(pieces: Iterator[bytes], head: bytes, cut: int, size: int) -> Iterator[pa.RecordBatch]:
    """Pieces joined after a head, without the last `cut` bytes, in rows of about `size` bytes."""
    row = lambda: pa.RecordBatch.from_arrays([pa.array([bytes(now[: len(now) - cut])], pa.binary()).cast(pa.string())], ["value"])
    now = bytearray(head)
    for piece in pieces:
        now += piece
        if len(now) >= size:
            yield row()
            now = bytearray(head)
    if len(now) > len(head):
        yield row()


# ---- ARC ----


def arc_document(key: str | None, payload: bytes) -> bytes:
    named = b"" if key is None else f"{KEY}: {quote(key)}\r\n".encode()
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + named + b"Content-Length: %d\r\n\r\n" % len(payload) + payload


def arc_record(version: int, url: str | None, date: str, document: bytes, ip: str = "0.0.0.0", mime: str = "text/html") -> bytes:
    """A header line, the document and a line break. What may not stand in a URL there is written as %XX; none or an empty one is a dash."""
    at = quote(url, safe="".join(map(chr, range(33, 127)))) if url else "-"
    own = f"{at} {ip} {date} {mime} " + ("" if version == 1 else "200 - - 0 - ") + f"{len(document)}\n"
    return own.encode() + document + b"\n"


def arc_head(version: int) -> bytes:
    body = b"%d 0 panelyard\n" % version + ARC_FIELDS[version] + b"\n"
    own = b"filedesc://pages.arc 0.0.0.0 20000101000000 text/plain " + (b"" if version == 1 else b"200 - - 0 pages.arc ")
    return own + b"%d\n" % len(body) + body + b"\n"


def write_arcs(pages: DataFrame, path: str, key: Column, url: Column, payload: Column, date: Column, version: Column, segment: int = SEGMENT) -> None:
    """ARC archives of rows. payload: string (null: empty), date: 14 digits, version: 1 or 2; each archive is of one version."""
    small_batches(pages.sparkSession)
    rows = pages.select(key.cast("string").alias("key"), url.alias("url"), F.coalesce(payload, F.lit("")).alias("payload"), date.alias("date"), version.cast("int").alias("version"))

    def run(batches):
        open_ = {v: bytearray() for v in ARC_FIELDS}
        out = lambda v: next(_segments(iter([bytes(open_[v])]), arc_head(v), 1, 1))
        for b in batches:
            for k, u, body, d, v in zip(b.column("key").to_pylist(), b.column("url").to_pylist(), raw(b, "payload"), b.column("date").to_pylist(), b.column("version").to_pylist(), strict=True):
                open_[v] += arc_record(v, u, d, arc_document(k, body))
                if len(open_[v]) >= segment:
                    yield out(v)
                    open_[v] = bytearray()
        for v, held in open_.items():
            if held:
                yield out(v)

    _put(rows.mapInArrow(run, "value string"), path, "\n")


def parse_arc(content: bytes) -> Iterator[tuple[int, int, str, str, str, str, bytes, bool]]:
    """(offset, version, url, ip, date, mime, document, whole) of an ARC file's documents, its version block left out.

    Lengths are followed as declared; a document that ends before its length is given as not whole. A line that is no header
    (damage, more blank lines than one) is passed over up to the next that is."""
    version, at = 1, 0
    while at < len(content):
        end = content.find(b"\n", at)
        end = len(content) if end < 0 else end
        line = content[at:end].rstrip(b"\r")
        width = 10 if version == 2 else 5
        if line.startswith(b"filedesc://"):
            begin = end + 1
            found = re.match(rb"([12]) ", content[begin : begin + 2])
            version = int(found[1]) if found else 1
            length = line.rpartition(b" ")[2]
            at = begin + int(length) if length.isdigit() else begin
            continue
        fields = line.rsplit(b" ", width - 1)  # only a URL could hold blanks
        if len(fields) < width or not fields[-1].isdigit() or not re.fullmatch(rb"[0-9]{14}", fields[2]):
            at = end + 1
            continue
        length = int(fields[-1])
        document = content[end + 1 : end + 1 + length]
        url, ip, date, mime = (f.decode("utf-8", "replace") for f in fields[:4])
        yield at, version, url, ip, date, mime, document, len(document) == length
        at = end + 1 + length


def _halves(document: bytes) -> tuple[bytes, bytes]:
    """An HTTP message's head with its blank line, and its payload; all is payload where there is no such head."""
    if document.startswith(b"HTTP/"):
        cut = document.find(b"\r\n\r\n")
        if cut >= 0:
            return document[: cut + 4], document[cut + 4 :]
    return b"", document


def _field(head: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + name.encode() + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace") if found else None


def _key(head: bytes) -> str | None:
    found = _field(head, KEY)
    return found if found is None else unquote(found)


_ARC_ROWS = "file string, offset long, id string, version int, url string, ip string, date string, head binary, payload binary, whole boolean, key string, digest string, bytes long"


def _documents(file: str, content: bytes) -> Iterator[tuple]:
    """Rows of _ARC_ROWS, payloads with them."""
    for offset, version, url, ip, date, _, document, whole in parse_arc(_unpacked(content)):
        head, payload = _halves(document)
        own = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{file}#{offset}')}>"
        yield file, offset, own, version, None if url == "-" else url, ip, date, head, payload, whole, _key(head), hashlib.sha256(payload).hexdigest(), len(payload)


def read_arcs(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """A row per document of all ARC archives under path, with the identifier its record will have, its row's key and its payload's
    digest. Without `payloads`, head and payload are null."""
    small_batches(spark)

    def run(batches):
        names = [x.split()[0] for x in _ARC_ROWS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), *[pa.string()] * 3, pa.binary(), pa.binary(), pa.bool_(), pa.string(), pa.string(), pa.int64()]
        held, size = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
        for b in batches:
            for file, content in zip(b.column("file").to_pylist(), b.column("content"), strict=True):
                for row in _documents(file, content.as_buffer().to_pybytes()):
                    held.append(row if payloads else (*row[:7], None, None, *row[9:]))
                    size += 500 + (row[12] if payloads else 0)
                    if size >= 4 << 20:
                        yield batch()
                        held, size = [], 0
        if held:
            yield batch()

    return _archives(spark, path).mapInArrow(run, _ARC_ROWS)


def with_revisits(rows: DataFrame, order: Column, least: int = LEAST_PAYLOAD) -> DataFrame:
    """read_arcs' rows plus `first` (id, key, url, date of the record to revisit), null for responses: of equal payloads of `least`
    bytes and more the first by order (null last), ties by identifier, is the response."""
    rank = F.struct(order.isNull().alias("none"), order.alias("order"), "id", "key", "url", "date")
    large = rows.withColumn("digest_or_id", F.when(F.col("bytes") >= least, F.col("digest")).otherwise(F.col("id")))
    out = with_least(large, ["digest_or_id"], rank, F.col("id"), "first").drop("digest_or_id")
    return out.withColumn("first", F.when(F.col("first.id") != F.col("id"), F.struct("first.id", "first.key", "first.url", "first.date")))


# ---- WARC ----


def _iso(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """Fields without a value are left out; Content-Length comes last."""
    shown = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"{RECORD}\r\n{shown}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def _convert(row: tuple, first: dict | None) -> bytes:
    """The record of one of _documents' rows; `first`: the record it revisits."""
    _, _, own, _, url, ip, date, head, payload, whole, _, payload_digest, size = row
    block = head if first else head + payload
    kind = "revisit" if first else "response" if head else "resource"
    digest = lambda b: f"sha256:{hashlib.sha256(b).hexdigest()}"
    return warc_record(
        [
            ("WARC-Type", kind),
            ("WARC-Record-ID", own),
            ("WARC-Date", _iso(date)),
            ("WARC-Target-URI", url),
            ("WARC-IP-Address", ip),
            ("WARC-Payload-Digest", f"sha256:{payload_digest}"),
            ("WARC-Block-Digest", digest(block)),
            ("WARC-Truncated", None if whole else "unspecified"),
            ("WARC-Profile", REVISIT if first else None),
            ("WARC-Refers-To", first and first["id"]),
            ("WARC-Refers-To-Target-URI", first and first["url"]),
            ("WARC-Refers-To-Date", first and _iso(first["date"])),
            (f"{KEY}-Refers-To", first and first["key"] is not None and quote(first["key"]) or None),
            (f"{KEY}-Length", str(size) if first else None),
            ("Content-Type", "application/http; msgtype=response" if head else "application/octet-stream"),
        ],
        block,
    )


def parse_warc(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of a WARC file's records, by declared lengths."""
    at = 0
    while (at := content.find(b"WARC/1.", at)) >= 0:
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in content[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
        length = int(fields.get("content-length", "0"))
        yield fields, content[end + 4 : end + 4 + length]
        at = end + 4 + length


_WARC_ROWS = "id string, record_type string, key string, url string, date string, payload binary, payload_bytes long, payload_digest string, refers_to_id string, refers_to_key string, intact boolean"


def read_warcs(spark: SparkSession, path: str) -> DataFrame:
    """A row per response, resource and revisit record. Size and digest are of the full payload: computed where it
    is there, as declared by a revisit. intact: block (and payload, where it is there) agree with the digests declared."""
    small_batches(spark)

    def run(batches):
        names = [x.split()[0] for x in _WARC_ROWS.split(", ")]
        kinds = [pa.string()] * 5 + [pa.binary(), pa.int64()] + [pa.string()] * 3 + [pa.bool_()]
        held, size = [], 0
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], names)
        for b in batches:
            for content in b.column("content"):
                for fields, block in parse_warc(_unpacked(content.as_buffer().to_pybytes())):
                    kind = fields.get("warc-type")
                    if kind not in ("response", "resource", "revisit"):
                        continue
                    head, payload = _halves(block) if kind != "resource" else (b"", block)
                    declared = fields.get("warc-payload-digest", "").removeprefix("sha256:")
                    found = declared if kind == "revisit" else hashlib.sha256(payload).hexdigest()
                    intact = found == declared and fields.get("warc-block-digest") == f"sha256:{hashlib.sha256(block).hexdigest()}"
                    refers = fields.get(f"{KEY}-refers-to".lower())
                    length = int(fields.get(f"{KEY}-length".lower(), 0)) if kind == "revisit" else len(payload)
                    held.append((fields.get("warc-record-id"), kind, _key(head), fields.get("warc-target-uri"), fields.get("warc-date"), None if kind == "revisit" else payload, length, found, fields.get("warc-refers-to"), refers and unquote(refers), intact))
                    size += len(block)
                    if size >= 4 << 20:
                        yield batch()
                        held, size = [], 0
        if held:
            yield batch()

    return _archives(spark, path).mapInArrow(run, _WARC_ROWS)


def convert(spark: SparkSession, arcs: str, warcs: str, order: str = "key", segment: int = SEGMENT) -> None:
    """All ARC archives under one folder to WARC archives in another, each with a warcinfo record first. Equal payloads: the least `order`
    (SQL over read_arcs' columns) is the response.

    Which records are revisits is settled on digests alone; each archive then meets its own list of them, and no payload is
    shuffled by itself."""
    small_batches(spark)
    marked = with_revisits(read_arcs(spark, arcs, payloads=False), F.expr(order)).where("first is not null")
    marked = marked.groupBy("file").agg(F.collect_list(F.struct("offset", "first")).alias("revisits"))
    files = _archives(spark, arcs).join(marked, "file", "left").select("file", "content", "revisits")

    def run(batches):
        info = b"software: panelyard\r\nformat: WARC File Format 1.0\r\ndescription: converted from ARC\r\n"

        def records():
            for b in batches:
                for i in range(b.num_rows):
                    first = {r["offset"]: r["first"] for r in b.column("revisits")[i].as_py() or ()}
                    for row in _documents(b.column("file")[i].as_py(), b.column("content")[i].as_buffer().to_pybytes()):
                        yield _convert(row, first.get(row[1]))

        head = warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "2000-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], info)
        yield from _segments(records(), head, 4, segment)

    _put(files.mapInArrow(run, "value string"), warcs, "\r\n\r\n")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns. Every other page goes into a version 1 archive, the rest into version 2."""
    pages = read(spark, sf_dir, "pages")
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    date = F.date_format(F.timestamp_seconds(F.lit(946684800) + F.coalesce(F.pmod("page_id", F.lit(10**9)), F.lit(0))), "yyyyMMddHHmmss")
    write_arcs(pages, f"{folder}/arc", F.col("page_id"), F.col("url"), F.col("html"), date, 1 + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(2)))
    convert(spark, f"{folder}/arc", f"{folder}/warc", "cast(key as long)")
    erase(spark, f"{folder}/arc")
    rows = read_warcs(spark, f"{folder}/warc")
    return rows.select(F.col("key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").cast("long").alias("refers_to"))


OP12_SQL = """
WITH sized AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
least AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM sized)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM least
"""
