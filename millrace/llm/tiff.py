"""TIFF columns: a writer, and a reader that emits one row per page.

The reader walks the image directories, decodes PackBits, LZW or deflate strips and tiles, undoes
horizontal-difference predictors and returns the samples of each page as bytes. It handles 8-bit
samples, either byte order, chunky planes; what else it meets is reported in the column `error`
of the file's row rather than raised, so that one bad file does not end a job. No more memory is
taken for a page than its pieces really hold.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the format: tags, types and compression schemes of TIFF 6.0 and its deflate supplement.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PREDICTOR = 273, 277, 278, 279, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
NONE, LZW, ADOBE_DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}

_RUN = re.compile(rb"(.)\1{2,127}", re.S)
#: Bytes of samples in one strip.
STRIP_BYTES = 1 << 16
#: Bytes of output that a task gathers before it hands a batch on.
BATCH_BYTES = 8 << 20


def unpack_bits(data: bytes, most: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) <= most:
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, done = bytearray(), 0

    def literal(to: int) -> None:
        for at in range(done, to, 128):
            part = data[at : min(at + 128, to)]
            out.append(len(part) - 1)
            out.extend(part)

    for run in _RUN.finditer(data):
        literal(run.start())
        done = run.end()
        out.extend((257 - (done - run.start()), data[run.start()]))
    literal(len(data))
    return bytes(out)


def unpack_lzw(data: bytes, most: int) -> bytes:
    """Codes of 9 to 12 bits, high bit first, widened one code early; 256 clears and 257 ends."""
    table = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, size, held, bits, width, last = [], 0, 0, 0, 9, None
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            del table[258:]
            width, last = 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        size += len(entry)
        if size > most:
            break
        last = entry
        width = min(12, (len(table) + 1).bit_length())
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0

    def put(code: int, width: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    codes = {bytes((i,)): i for i in range(256)}
    following, width, word = 258, 9, b""
    put(256, 9)
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in codes:
            word = longer
            continue
        put(codes[word], width)
        codes[longer] = following
        following += 1
        width = min(12, following.bit_length())
        word = data[i : i + 1]
        if following == 4094:
            put(codes[word], width)
            put(256, 12)
            codes = {bytes((k,)): k for k in range(256)}
            following, width, word = 258, 9, b""
    if word:
        put(codes[word], width)
        width = min(12, (following + 1).bit_length())
    put(257, width)
    if bits:
        put(0, 8 - bits)
    return bytes(out)


def inflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most + 1)


def inflate(data: bytes, most: int) -> bytes:
    return zlib.decompressobj().decompress(data, most + 1)


PACK = {NONE: bytes, LZW: pack_lzw, PACKBITS: pack_bits, ADOBE_DEFLATE: lambda b: zlib.compress(b, 1)}
#: Each takes the bytes of a piece, and how many it holds: a piece that holds more is cut off soon after.
UNPACK = {NONE: lambda b, most: b, LZW: unpack_lzw, PACKBITS: unpack_bits, ADOBE_DEFLATE: inflate, OLD_DEFLATE: inflate}
#: Compression, predictor and tile size (none: strips) that stored texts get in turn, by a checksum of their bytes.
LAYOUTS = ((ADOBE_DEFLATE, 2, None), (ADOBE_DEFLATE, 1, 64), (LZW, 1, None), (PACKBITS, 2, 64))


def write_tiff(pages: list[np.ndarray], compression: int = ADOBE_DEFLATE, predictor: int = 2, tile: int | None = None) -> bytes:
    """Little-endian TIFF of 2-D (grey) or 3-D (rows, columns, samples) uint8 arrays, in strips or square tiles."""
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for image in pages:
        cube = image[:, :, None] if image.ndim == 2 else image
        rows, columns, samples = cube.shape
        deep = max(1, STRIP_BYTES // max(1, columns * samples))
        if tile:
            pieces = [np.pad(p := cube[y : y + tile, x : x + tile], ((0, tile - p.shape[0]), (0, tile - p.shape[1]), (0, 0))) for y in range(0, rows, tile) for x in range(0, columns, tile)]
        else:
            pieces = [cube[y : y + deep] for y in range(0, rows, deep)]
        places = []
        for piece in pieces:
            if predictor == 2:
                piece = np.concatenate([piece[:, :1], piece[:, 1:] - piece[:, :-1]], axis=1)
            packed = PACK[compression](piece.tobytes())
            places.append((len(out), len(packed)))
            out += packed
        out += b"\0" * (len(out) % 2)
        entries = [(WIDTH, 4, [columns]), (LENGTH, 4, [rows]), (BITS, 3, [8] * samples), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1 if samples < 3 else 2]), (SAMPLES, 3, [samples]), (PREDICTOR, 3, [predictor])]
        where, sizes = [p for p, _ in places], [n for _, n in places]
        entries += [(TILE_WIDTH, 4, [tile]), (TILE_LENGTH, 4, [tile]), (TILE_OFFSETS, 4, where), (TILE_COUNTS, 4, sizes)] if tile else [(STRIP_OFFSETS, 4, where), (ROWS_PER_STRIP, 4, [deep]), (STRIP_COUNTS, 4, sizes)]
        fields = bytearray()
        for tag, kind, values in sorted(entries):
            body = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(body) > 4:
                at = len(out)
                out += body + b"\0" * (len(body) % 2)
                body = struct.pack("<I", at)
            fields += struct.pack("<HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + fields
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and entries of each image directory; a chain that turns back on itself is an error."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF header")
    order = "<" if data[:2] == b"II" else ">"
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the directories form a ring")
        seen.add(at)
        count = struct.unpack_from(order + "H", data, at)[0]
        tags = {}
        for i in range(count):
            place = at + 2 + 12 * i
            tag, kind, n = struct.unpack_from(order + "HHI", data, place)
            if kind not in TYPE_BYTES:
                continue
            place = place + 8 if n * TYPE_BYTES[kind] <= 4 else struct.unpack_from(order + "I", data, place + 8)[0]
            tags[tag] = struct.unpack_from(f"{order}{n * (1 + (kind == 5))}{'_BBHII'[kind]}", data, place)
        yield order, tags
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]


def read_page(data: bytes, tags: dict[int, tuple]) -> np.ndarray:
    """The samples of one directory: rows x columns x samples."""
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    columns, rows, samples = one(WIDTH), one(LENGTH), one(SAMPLES, 1)
    if columns is None or rows is None or set(tags.get(BITS, (1,))) != {8}:
        raise ValueError("only 8-bit samples are read")
    if one(COMPRESSION, NONE) not in UNPACK:
        raise ValueError(f"compression {one(COMPRESSION)} is not read")
    unpack, predictor, tile = UNPACK[one(COMPRESSION, NONE)], one(PREDICTOR, 1), one(TILE_WIDTH)
    wide, deep = (tile, one(TILE_LENGTH)) if tile else (columns, min(one(ROWS_PER_STRIP, rows), max(rows, 1)))
    if not deep or samples < 1:
        raise ValueError("pieces without rows or samples")
    offsets, sizes = tags[TILE_OFFSETS if tile else STRIP_OFFSETS], tags[TILE_COUNTS if tile else STRIP_COUNTS]
    across = -(-columns // wide) if columns else 0
    if len(offsets) != across * -(-rows // deep):
        raise ValueError(f"{len(offsets)} pieces instead of {across * -(-rows // deep)}")
    pieces = []
    for i, (at, n) in enumerate(zip(offsets, sizes, strict=True)):
        y, x = i // across * deep, i % across * wide
        high = deep if tile else min(deep, rows - y)
        piece = np.frombuffer(unpack(data[at : at + n], high * wide * samples), np.uint8)
        if len(piece) != high * wide * samples:
            raise ValueError(f"piece {i} has {len(piece)} bytes instead of {high * wide * samples}")
        piece = piece.reshape(high, wide, samples)
        pieces.append((y, x, np.cumsum(piece, axis=1, dtype=np.uint8) if predictor == 2 else piece))
    out = np.zeros((rows, columns, samples), np.uint8)
    for y, x, piece in pieces:
        out[y : y + len(piece), x : x + wide] = piece[: rows - y, : columns - x]
    return out


def _batches(rows: Iterator[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += size(row)
        if weight >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def pack_texts(docs: DataFrame, width: int = 64, layouts: tuple = LAYOUTS) -> DataFrame:
    """doc_id, n_bytes, media: every whole text (null: empty) as the grey samples of a one-page TIFF, `width` to a row.

    Zero bytes fill up the last row; an empty text is one row of zeros, so that no page is empty. A checksum of the bytes
    picks the layout of a text, so that equal texts are equal files.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for key, text in zip(batch[0].to_pylist(), batch[1], strict=True):
                raw = (text.as_py() or "").encode()
                padded = raw + b"\0" * (-len(raw) % width if raw else width)
                yield key, len(raw), write_tiff([np.frombuffer(padded, np.uint8).reshape(-1, width)], *layouts[zlib.crc32(raw) % len(layouts)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batches(rows(batches), schema, lambda r: len(r[2]) + 64)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_pages(media: DataFrame, keys: list[str], column: str = "media") -> DataFrame:
    """One row per page of every TIFF in `column`: the key columns, page (from 0), width, height, samples, data, error.

    A null or unreadable file gives one row whose page and data are null and whose error says why; the pages
    before a bad directory are kept.
    """
    fields = media.select(*keys).schema
    spec = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["page int", "width int", "height int", "samples int", "compression int", "data binary", "error string"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for *key, blob in zip(*(batch[i].to_pylist() if i < len(keys) else batch[i] for i in range(len(keys) + 1)), strict=True):
                page = 0
                try:
                    data = blob.as_py()
                    if data is None:
                        raise ValueError("no file")
                    for _, tags in directories(data):
                        image = read_page(data, tags)
                        yield *key, page, image.shape[1], image.shape[0], image.shape[2], tags.get(COMPRESSION, (NONE,))[0], image.tobytes(), None
                        page += 1
                    if not page:
                        raise ValueError("no directory")
                except (ValueError, TypeError, struct.error, KeyError, zlib.error, IndexError, ArithmeticError, MemoryError) as e:
                    yield *key, None, None, None, None, None, None, str(e) or type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field(i) for i in range(len(keys))] + [pa.field(n, t) for n, t in (("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("compression", pa.int32()), ("data", pa.binary()), ("error", pa.string()))])
            yield from _batches(rows(iter([batch])), schema, lambda r: len(r[-2] or b"") + 64)

    return media.select(*keys, column).mapInArrow(run, spec)


def media_digest(docs: DataFrame) -> DataFrame:
    """Store every text as a TIFF, read the stored bytes back and describe them.

    Per row of `docs`: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.
    Rows are taken one by one: a null text is an empty one, repeated rows give repeated results, an empty table
    an empty one, and columns other than doc_id and text are ignored.
    """
    stored = pack_texts(docs).withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    keys = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]
    pages = read_pages(stored, keys)
    measured = describe(pages.where("page = 0 or page is null"), keys)
    return measured.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def describe(pages: DataFrame, keys: list[str]) -> DataFrame:
    """Digest and features of each page: bytes, SHA-256, CRC-32 of the last 64 bytes, mean and rough grey histogram."""
    digest = F.sha2("data", 256)
    size = F.octet_length("data")
    tail = F.substring("data", -64, 64)

    @F.pandas_udf("string")
    def grey(data):  # type: ignore[no-untyped-def]
        def one(raw):  # type: ignore[no-untyped-def]
            if raw is None:
                return None
            samples = np.frombuffer(raw, np.uint8)
            shares = np.bincount(samples >> 5, minlength=8)
            return f"mean={samples.mean():.4f};bins={'/'.join(map(str, shares))}"

        return data.map(one, na_action=None)

    feature = F.concat_ws(";", F.format_string("%dx%dx%d", "width", "height", "samples"), grey("data"))
    return pages.select(*keys, size.cast("long").alias("payload_bytes"), digest.alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), feature.alias("feature"))


def text_sha256(text: str | None, width: int = 64) -> str:
    """What payload_sha256 must be, for tests."""
    raw = (text or "").encode()
    return hashlib.sha256(raw + b"\0" * (-len(raw) % width if raw else width)).hexdigest()
