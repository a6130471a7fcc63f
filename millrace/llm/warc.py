"""WARC archives as .warc.zst: a writer of one frame per record, and a validating reader.

An archive is a skippable frame that holds the dictionary, then one Zstandard frame per record. Archives are rows of
(archive, content), which is what spark.read.format("binaryFile") gives for archives of others as well; ours are written to a
table in the shared folder and read from there.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from base64 import b32decode, b32encode, b64decode, b64encode
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_folder

# Fixed values of the formats.
DICTIONARY_MAGIC, ZSTD_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Payload bytes of an archive, about; bytes of a dictionary; payloads that it is trained on at most.
ARCHIVE_BYTES, DICTIONARY_BYTES, TRAINING = 4 << 20, 16 << 10, 256
#: Parts that the pages of one payload are dealt to.
SALTS = 16
#: Smallest payload of which equal ones are revisits.
LEAST_BYTES = 1000
#: Compressed bytes that the reader hands to a frame at a time.
STEP_BYTES = 1 << 16
RECORD = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, error string"


def record_id(page_id: int | None, digest: str) -> str:
    """Of a page and its payload, since pages may share an id or have none; only rows alike in both share a record's name."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _header_text(value: str) -> str:
    """Header values stand on one line and in ASCII: controls, blanks and other letters are percent-coded, by their bytes in UTF-8."""
    return re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), value)


def write_record(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None, payload: bytes) -> bytes:
    """A resource response, or a revisit, which has no payload of its own."""
    kind = "response" if refers_to is None else "revisit"
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", "sha1:" + b32encode(bytes.fromhex(digest)).decode())]
    head += [("WARC-Target-URI", _header_text(url))] if url is not None else []
    head += [("X-Source-URL", b64encode(url.encode()).decode())] if url is not None and url != _header_text(url) else []
    head += [("X-Page-ID", str(page_id))] if page_id is not None else []
    head += [("X-Payload-Length", str(size))]
    if refers_to is not None:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))]
        payload = b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _sha1(digest: str | None) -> str | None:
    """Hexadecimal SHA-1 of a digest header in base 32 or 16; None for none or another algorithm."""
    name, _, value = (digest or "").partition(":")
    if name.lower() not in ("sha1", "sha-1"):
        return None
    return value.lower() if re.fullmatch("[0-9a-fA-F]{40}", value) else b32decode(value.upper()).hex()


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-cased name. A line that starts with a blank continues the one before; only the fields that the
    standard lets repeat may."""
    fields: dict[str, str] = {}
    name = ""
    for line in head.decode().split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        name = name.strip().lower()
        if not colon or not name or (name in fields and name != "warc-concurrent-to"):
            raise ValueError(f"bad header line {line[:40]!r}")
        fields[name] = value.strip()
    return fields


def read_record(raw: bytes) -> tuple:
    """(page_id, url, type, refers_to, payload, bytes, digest); ValueError if the headers, lengths or digests don't hold.

    The payload is what follows the HTTP header where the block is an HTTP message, else the whole block; revisits have none.
    The digest is that of the header, or taken from the payload where there is none in SHA-1. URIs are returned as they
    stand. Records of every type are read; page_id and refers_to are those that write_record() puts down, else null.
    """
    head, mark, rest = raw.partition(b"\r\n\r\n")
    if not mark or not re.match(rb"WARC/[01]\.\d+(?:\r\n|$)", head):
        raise ValueError("no WARC header")
    fields = _fields(head)
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"no {name}")
    if not re.fullmatch("[0-9]+", fields["content-length"]) or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the content length does not hold")
    block, kind = rest[:-4], fields["warc-type"].lower()
    if (told := _sha1(fields.get("warc-block-digest"))) and hashlib.sha1(block).hexdigest() != told:
        raise ValueError("the block digest does not hold")
    payload: bytes | None = block
    if fields.get("content-type", "").lower().startswith("application/http"):
        _, mark, payload = block.partition(b"\r\n\r\n")
        if not mark:
            raise ValueError("no HTTP header in the block")
    digest = _sha1(fields.get("warc-payload-digest"))
    size = _number(fields, "x-payload-length")
    size = len(payload) if size is None else size
    if kind == "revisit":
        payload = None
    else:
        own = hashlib.sha1(payload).hexdigest()
        if (digest is not None and own != digest) or len(payload) != size:
            raise ValueError("the payload digest does not hold")
        digest = own
    url = b64decode(fields["x-source-url"]).decode() if "x-source-url" in fields else fields.get("warc-target-uri")
    return _number(fields, "x-page-id"), url, kind, _number(fields, "x-refers-to-page"), payload, size, digest


def _number(fields: dict[str, str], name: str) -> int | None:
    """The field as a number of 64 bits; null where it isn't there."""
    if name not in fields:
        return None
    if not re.fullmatch("-?[0-9]{1,19}", fields[name]) or not -(1 << 63) <= int(fields[name]) < 1 << 63:
        raise ValueError(f"{name} is no number of 64 bits")
    return int(fields[name])


def write_archive(records: list[bytes]) -> bytes:
    """The dictionary, trained on some of the records, in a skippable frame; then a frame for each record."""
    out, trained = bytearray(), None
    samples = records[:: max(1, len(records) // TRAINING)]
    if len(samples) >= 16 and sum(map(len, samples)) >= 4 * DICTIONARY_BYTES:
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples)
        except zstandard.ZstdError:  # too alike or too few to train on: an archive may do without
            trained = None
    if trained is not None:
        held = trained.as_bytes()
        out += struct.pack("<II", DICTIONARY_MAGIC, len(held)) + held
    packer = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
    for record in records:
        out += packer.compress(record)
    return bytes(out)


def read_archive(content: bytes) -> Iterator[bytes]:
    """The bytes of each record. A frame that holds no whole record, or one cut short, is a ValueError."""
    at, held = 0, None
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", content, 4)[0]
        if len(content) < 8 + size:
            raise ValueError("the dictionary is cut short")
        body = content[8 : 8 + size]
        try:
            if body[:4] == ZSTD_MAGIC:
                unpack = zstandard.ZstdDecompressor().decompressobj()
                body = unpack.decompress(body)
                if not unpack.eof:
                    raise ValueError("the dictionary is cut short")
            held, at = zstandard.ZstdCompressionDict(body), 8 + size
        except zstandard.ZstdError as e:
            raise ValueError(f"bad dictionary: {e}") from None
    try:
        reader = zstandard.ZstdDecompressor(dict_data=held)
        reader.decompressobj()
    except zstandard.ZstdError as e:
        raise ValueError(f"the dictionary is refused: {e}") from None
    view = memoryview(content)
    while at < len(content):
        if len(content) >= at + 8 and 0x184D2A50 <= struct.unpack_from("<I", content, at)[0] <= 0x184D2A5F:
            at += 8 + struct.unpack_from("<I", content, at + 4)[0]
            continue
        frame, parts, first = reader.decompressobj(), [], at
        try:
            while not frame.eof and at < len(content):  # in steps: what a frame leaves over is copied
                parts.append(frame.decompress(view[at : at + STEP_BYTES]))
                at = min(at + STEP_BYTES, len(content))
        except zstandard.ZstdError as e:
            raise ValueError(f"bad frame at byte {first}: {e}") from None
        if not frame.eof:
            raise ValueError(f"the frame at byte {first} is cut short")
        at -= len(frame.unused_data)
        yield b"".join(parts)


def digests(pages: DataFrame) -> DataFrame:
    """page_id, digest, size of every payload: the html in UTF-8, a null one empty."""
    html = F.coalesce("html", F.lit("")).cast("binary")
    return pages.select("page_id", F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("size"))


def write_archives(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Archives (archive, content) with one record per row of `pages`.

    Of equal payloads of at least `least_bytes`, the one with the largest page_id is the response and others revisit it.
    Rows that share that page_id and payload are responses too; a row with a null page_id revisits the largest id there
    is, or is a response where there is none. A null html is an empty payload, a null url is left out. An empty table
    gives no archive.

    Only ids and digests are joined to find the responses: one row per task and digest goes into the count, and the
    pages meet their answer by page_id and digest, so that a payload that a third of all pages share, or one of very many
    pages without an id, stays spread out. Ids meet the answer of their digest in SALTS parts.
    """
    seen = digests(pages).where(F.col("size") >= least_bytes)
    kept = seen.groupBy("digest", "size").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1 and _last is not null")
    kept = kept.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    answers = seen.withColumn("_salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS))).join(kept, ["digest", "size", "_salt"]).where(~F.col("page_id").eqNullSafe(F.col("_last"))).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "_last").distinct()
    html = F.coalesce("html", F.lit("")).cast("binary")
    full = pages.select("page_id", "url", html.alias("payload"), F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    told = full.join(answers, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")), "left")
    told = told.select("page_id", "url", "digest", "size", F.col("_last").alias("refers_to"), F.when(F.col("_last").isNull(), F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size = [], 0

        def flush() -> pa.RecordBatch:
            content = write_archive(records)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(content).hexdigest() + ".warc.zst"]), pa.array([content], pa.binary())], names=["archive", "content"])

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, digest, length, refers, payload = (c[i].as_py() for c in batch.columns)
                records.append(write_record(page, url, digest, length, refers, payload or b""))
                size += len(records[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    records, size = [], 0
        if records:
            yield flush()

    return told.mapInArrow(run, "archive string, content binary")


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record of every archive; a record or archive that does not hold gives a row with `error` set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string()]
        names = ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest", "error"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                try:
                    for raw in read_archive(content.as_py() or b""):
                        try:
                            rows.append((*read_record(raw), None))
                        except (ValueError, OverflowError) as e:
                            rows.append((*[None] * 7, str(e)))
                        held += len(raw)
                        if held >= ARCHIVE_BYTES:
                            yield batch_of(rows)
                            rows, held = [], 0
                except ValueError as e:
                    rows.append((*[None] * 7, str(e)))
                if rows:
                    yield batch_of(rows)

    return archives.select("content").mapInArrow(run, RECORD)


def stored(archives: DataFrame) -> DataFrame:
    """`archives` written to a table of their own in the shared folder, and read from there."""
    spark = archives.sparkSession
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    archives.write.parquet(folder)
    return spark.read.schema(archives.schema).parquet(folder)


def warc_digest(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder, read these back.

    Per record: page_id, payload_bytes, payload_digest, record_type, refers_to. See write_archives() for nulls and ties; other
    columns are ignored, and an empty table gives an empty one.
    """
    records = read_archives(stored(write_archives(pages.select("page_id", "url", "html"))))
    whole = records.withColumn("page_id", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("long")).otherwise(F.col("page_id")))
    return whole.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The same in DuckDB.
DIGEST_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
d AS (SELECT page_id, n, sha1(body) AS digest FROM p),
k AS (SELECT digest, max(page_id) AS last FROM d WHERE n >= 1000 GROUP BY digest)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN k.last IS NULL OR k.last = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k.last <> d.page_id THEN k.last END AS refers_to
FROM d LEFT JOIN k ON d.digest = k.digest AND d.n >= 1000
"""
