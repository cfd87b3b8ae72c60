"""WARC archives: writing, gzip normalisation with a sidecar offset index, reading back (operator 1).

``write_archives`` writes pages as WARC files whose records share one gzip stream each, by Spark's text sink.
``normalise`` inflates each such stream once, in pieces, and rewrites every record as a gzip member of its own. Spark has no sink for binary
files on every store, so a rewritten archive is a table of its bytes in segments of about a MB (in order of offset they are the file), each with the offsets
of its records; the sidecar offset index is a table beside it. Records are read by these offsets alone.
An archive is bounded by bytes: larger records share a file with fewer others.

Cases: null html is an empty payload; equal payloads of at least ``min_bytes`` bytes make revisits of the one with the smallest
page_id (rows that repeat that page_id are responses too); a null page_id is a response and reads back as null; a null url has no
target header; line breaks in a url become spaces; an empty table gives no archives and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Payloads below so many bytes, and how many such records an archive holds at most: a GB before compression, but for one record that is larger.
SIZES = ((1 << 16, 1 << 14), (1 << 22, 1 << 8), (1 << 62, 1))
#: Bytes that are inflated at once, and bytes of a segment.
PIECE, SEGMENT = 1 << 16, 1 << 20
END = "\r\n\r\n"
_URN = "urn:page:"
SEGMENTS = "archive string, offset long, content binary, records array<struct<offset long, length long, record_id string, record_type string>>"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"


def base32_sha1(content):
    """Upper-case base32 of the SHA-1 of a binary column: five bytes are eight digits."""
    digest = F.sha1(content)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def warc_records(pages: DataFrame, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """``value``, the record of each page without the blank lines that end it, and ``size``, the bytes of its payload.

    The first page of each payload is found on digests alone, so that a frequent payload is pre-aggregated.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), base32_sha1(html.cast("binary")).alias("digest"))
    narrow = rows.filter(F.octet_length("html") >= min_bytes).select("page_id", "digest")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    refers = narrow.join(first, "digest").filter("page_id > first").select("page_id", "digest", "first").distinct()
    rows = rows.join(refers, ["page_id", "digest"], "left")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    revisit = F.col("first").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    urn = lambda c: F.concat(F.lit(f"<{_URN}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        F.when(revisit, F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        F.concat(F.lit("WARC-Record-ID: "), urn("page_id")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]+", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), urn("first"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(head, F.lit(END), block).alias("value"), F.octet_length("html").alias("size"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """Write WARC files, each one gzip stream over all its records; pages of a class of SIZES share files."""
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    kind = F.lit(len(SIZES) - 1)
    for k in reversed(range(len(SIZES) - 1)):
        kind = F.when(size < SIZES[k][0], F.lit(k)).otherwise(kind)
    found = sorted(r.k for r in pages.select(kind.alias("k")).distinct().collect())  # a few classes
    rows = warc_records(pages, min_bytes)
    for k in found or [0]:
        own = rows.filter(F.col("size") < SIZES[k][0])
        own = own.filter(F.col("size") >= SIZES[k - 1][0]) if k else own
        out = own.select("value").write.option("lineSep", END).option("compression", "gzip")
        out.option("maxRecordsPerFile", SIZES[k][1]).text(f"{path}/{k}")


def inflate(content: memoryview) -> Iterator[bytes]:
    """What a gzip file of one or more members holds, in pieces."""
    rest = zlib.decompressobj(31)
    for at in range(0, len(content), PIECE):
        data = bytes(content[at : at + PIECE])
        while data:
            yield rest.decompress(data)
            data, rest = (rest.unused_data, zlib.decompressobj(31)) if rest.eof else (b"", rest)


def records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers (lower-case names), block, and all bytes of each record of a WARC stream."""
    buffer = bytearray()

    def fill(size: int) -> bool:
        while len(buffer) < size:
            piece = next(pieces, None)
            if piece is None:
                return False
            buffer.extend(piece)
        return True

    while True:
        while (end := buffer.find(b"\r\n\r\n")) < 0:
            if not fill(len(buffer) + 1):
                if buffer.strip():
                    raise ValueError("a WARC record is cut off")
                return
        lines = bytes(buffer[:end]).decode().split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        size = end + 4 + int(headers["content-length"])
        if not fill(size + 4):
            raise ValueError("a WARC record is cut off")
        yield headers, bytes(buffer[end + 4 : size]), bytes(buffer[: size + 4])
        del buffer[: size + 4]


def segments(spark: SparkSession, path: str, level: int = 6) -> DataFrame:
    """The archives under path, rewritten: every record is a gzip member, and a segment holds some of them one behind the other."""

    def made(name: str, offset: int, members: list[tuple]) -> pa.RecordBatch:
        at, listed = offset, []
        for member, headers in members:
            listed.append({"offset": at, "length": len(member), "record_id": headers["warc-record-id"], "record_type": headers["warc-type"]})
            at += len(member)
        kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())]))
        columns = [pa.array([name]), pa.array([offset], pa.int64()), pa.array([b"".join(m for m, _ in members)], pa.binary()), pa.array([listed], kind)]
        return pa.RecordBatch.from_arrays(columns, names=["archive", "offset", "content", "records"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, size, offset = [], 0, 0
                for headers, _, whole in records(inflate(memoryview(content.as_buffer()))):
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    held.append((packer.compress(whole) + packer.flush(), headers))
                    size += len(held[-1][0])
                    if size > SEGMENT:
                        yield made(name, offset, held)
                        held, size, offset = [], 0, offset + size
                if held:
                    yield made(name, offset, held)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"[^/]+$", 0).alias("archive"), "content").mapInArrow(run, SEGMENTS)


def normalise(spark: SparkSession, source: str, target: str, level: int = 6) -> tuple[DataFrame, DataFrame]:
    """Rewrite archives under ``target``: their segments, and the sidecar index (archive, segment, offset, length, record_id, record_type)."""
    segments(spark, source, level).write.option("compression", "none").parquet(f"{target}/archives")
    stored = spark.read.schema(SEGMENTS).parquet(f"{target}/archives")
    places = stored.select("archive", F.col("offset").alias("segment"), F.explode("records").alias("r")).select("archive", "segment", "r.*")
    places.write.parquet(f"{target}/index")
    return stored, spark.read.schema(places.schema).parquet(f"{target}/index")


def fetch(stored: DataFrame, index: DataFrame, record_ids: DataFrame) -> DataFrame:
    """The segments that hold some record ids, each with the places of these records only, found by the offset index."""
    wanted = index.join(record_ids.select("record_id").distinct(), "record_id", "left_semi")
    places = wanted.groupBy("archive", F.col("segment").alias("offset")).agg(F.collect_list(F.struct("offset", "length", "record_id", "record_type")).alias("records"))
    return stored.drop("records").join(places, ["archive", "offset"]).select("archive", "offset", "content", "records")


def read_records(stored: DataFrame) -> DataFrame:
    """Inflate the members at the offsets that the segments list and report each record; a response's digest is computed from its payload and must be the one stated."""

    def page(urn: str | None) -> int | None:
        number = (urn or "").strip("<>").removeprefix(_URN)
        return int(number) if number else None

    def report(headers: dict[str, str], block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        digest, kind, size = headers["warc-payload-digest"].removeprefix("sha1:"), headers["warc-type"], len(payload)
        if kind == "revisit":
            size = int(http.lower().rpartition(b"content-length:")[2])
        elif base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"the payload of {headers['warc-record-id']} doesn't have its digest")
        return page(headers["warc-record-id"]), size, digest, kind, page(headers.get("warc-refers-to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = [f.split()[0] for f in RECORDS.split(", ")]
        for batch in batches:
            for archive, first, content, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                data, rows = memoryview(content.as_buffer()), []
                for place in places:
                    at = place["offset"] - first
                    headers, block, _ = next(records(inflate(data[at : at + place["length"]])))
                    if headers["warc-record-id"] != place["record_id"]:
                        raise ValueError(f"the index has another record than {headers['warc-record-id']}")
                    rows.append((*report(headers, block), archive, place["offset"], place["length"]))
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return stored.select("archive", "offset", "content", "records").mapInArrow(run, RECORDS)
