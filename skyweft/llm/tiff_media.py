"""TIFF media columns: image directories walked, strips and tiles decoded, one row per page.

Reads classic TIFF of either byte order: uncompressed, PackBits, LZW and deflate strips or tiles,
samples of 1, 2, 4, 8, 16 or 32 bits, chunky or planar, with or without the horizontal predictor. A
page's bytes are its samples by row, those of less than 8 bits as a byte each, those of more in
little-endian order. The writer stores bytes as 8-bit grey pages of a fixed width and is lossless.

Defined cases: a null blob gives one row with page -1 and error 'null'; a blob that is no TIFF, is
cut short, repeats a directory, has a size of zero, is too short for the size it claims or holds an
unsupported form gives one row with page -1 and the reason after the pages read so far. A null text
is stored like an empty one. Repeated rows each get rows, an empty table gives none, further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweft.llm.batches import sliced

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
OLD_DEFLATE = 32946
#: Bytes of each field type, by its code; fixed by the format.
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_W, TILE_H, TILES, TILE_BYTES = 322, 323, 324, 325
#: Bytes that one byte of a segment can stand for at most, by compression: bounds what a page can hold.
EXPANSION = {NONE: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1032, OLD_DEFLATE: 1032}
PAGE_ROWS = 16_384
STRIP_ROWS = 1_024
PIXELS_A_ROW = 64


class TiffError(ValueError):
    pass


@dataclass
class Page:
    index: int
    width: int
    height: int
    samples: int
    compression: int
    predictor: int
    data: bytes


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out[:size])


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 2:
            out += bytes((257 - (j - i), data[i]))
            i = j
            continue
        j = i
        while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bit first, widened one code early."""
    table: list[bytes] = []
    out, acc, bits, width, prev = [], 0, 0, 9, b""
    got = 0
    for byte in data:
        acc = (acc << 8) | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 257 or got >= size:
            break
        if code == 256:
            table = [bytes((i,)) for i in range(256)] + [b"", b""]
            width, prev = 9, b""
            continue
        if not table:
            raise TiffError("LZW without a clear code")
        if code < len(table):
            entry = table[code]
        elif code == len(table) and prev:
            entry = prev + prev[:1]
        else:
            raise TiffError("LZW code out of range")
        out.append(entry)
        got += len(entry)
        if prev:
            table.append(prev + entry[:1])
        prev = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)[:size]


def lzw_encode(data: bytes) -> bytes:
    acc, bits, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal acc, bits
        acc, bits = (acc << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1

    table, width, word = {bytes((i,)): i for i in range(256)}, 9, b""
    put(256, width)
    nxt = 258
    for i in range(len(data)):
        c = data[i : i + 1]
        if word + c in table:
            word += c
            continue
        put(table[word], width)
        table[word + c] = nxt
        nxt += 1
        word = c
        width = 9 if nxt < 512 else 10 if nxt < 1024 else 11 if nxt < 2048 else 12
        if nxt == 4095:
            put(256, width)
            table, width, nxt = {bytes((i,)): i for i in range(256)}, 9, 258
    if word:
        put(table[word], width)
        nxt += 1
        width = 9 if nxt < 512 else 10 if nxt < 1024 else 11 if nxt < 2048 else 12
    put(257, width)
    if bits:
        out.append(acc << (8 - bits) & 255)
    return bytes(out)


def _unpack(raw: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        out = raw[:size]
    elif compression == PACKBITS:
        out = packbits_decode(raw, size)
    elif compression == LZW:
        out = lzw_decode(raw, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(raw, size)
        except zlib.error as e:
            raise TiffError(f"deflate: {e}") from e
    else:
        raise TiffError(f"compression {compression}")
    if len(out) != size:
        raise TiffError("segment is short")
    return out


def _pack(raw: bytes, compression: int) -> bytes:
    return {NONE: bytes, PACKBITS: packbits_encode, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1)}[compression](raw)


def write_tiff(payload: bytes, compression: int = DEFLATE, predictor: int = 2, tile: int | None = None, width: int = PIXELS_A_ROW, page_rows: int = PAGE_ROWS) -> bytes:
    """``payload`` (a multiple of ``width`` bytes) as grey pages of at most ``page_rows`` rows."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for lo in range(0, len(payload), width * page_rows):
        pixels = np.frombuffer(payload, np.uint8)[lo : lo + width * page_rows].reshape(-1, width)
        height = len(pixels)
        if tile:
            wide, high = -(-width // tile) * tile, -(-height // tile) * tile
            padded = np.zeros((high, wide), np.uint8)
            padded[:height, :width] = pixels
            parts = [padded[y : y + tile, x : x + tile] for y in range(0, high, tile) for x in range(0, wide, tile)]
        else:
            parts = [pixels[y : y + STRIP_ROWS] for y in range(0, height, STRIP_ROWS)]
        at, sizes = [], []
        for p in parts:
            if predictor == 2:
                p = np.concatenate([p[:, :1], np.diff(p, axis=1)], axis=1)
            seg = _pack(np.ascontiguousarray(p).tobytes(), compression)
            at.append(len(out))
            sizes.append(len(seg))
            out += seg + b"\0" * (len(seg) % 2)
        tags = {WIDTH: [width], HEIGHT: [height], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PLANAR: [1], PREDICTOR: [predictor]}
        tags |= {TILE_W: [tile], TILE_H: [tile], TILES: at, TILE_BYTES: sizes} if tile else {STRIPS: at, ROWS: [STRIP_ROWS], STRIP_BYTES: sizes}
        fields = []
        for tag, values in sorted(tags.items()):
            body = struct.pack(f"<{len(values)}I", *values)
            if len(values) > 1:
                where = len(out)
                out += body
                body = struct.pack("<I", where)
            fields.append(struct.pack("<HHI", tag, 4, len(values)) + body)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + b"".join(fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def walk_pages(data: bytes) -> Iterator[Page]:
    """The pages of a TIFF in the order of its directories."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise TiffError("no TIFF")
    at, seen, index = struct.unpack(order + "I", data[4:8])[0], set(), 0
    while at:
        if at in seen:
            raise TiffError("directories form a ring")
        seen.add(at)
        try:
            n = struct.unpack_from(order + "H", data, at)[0]
            tags = {}
            for i in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
                size = TYPE_BYTES.get(kind, 0) * count
                where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
                if kind in (1, 3, 4) and count:
                    if size > len(data):
                        raise TiffError(f"directory {index}: a field is longer than the file")
                    tags[tag] = struct.unpack_from(f"{order}{count}{'BHI'[(1, 3, 4).index(kind)]}", data, where)
            after = struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]
            page = _page(data, tags, index, order)
        except (struct.error, KeyError, IndexError, MemoryError, OverflowError) as e:
            raise TiffError(f"directory {index}: {e}") from e
        yield page
        at, index = after, index + 1


def _page(data: bytes, tags: dict, index: int, order: str) -> Page:
    one = lambda tag, default=None: tags.get(tag, (default,))[0] if default is not None else tags[tag][0]
    width, height = one(WIDTH), one(HEIGHT)
    samples, planar = one(SAMPLES, 1), one(PLANAR, 1)
    compression, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    kinds = set(tags.get(BITS, (1,)))
    bits = kinds.pop()
    if kinds or bits not in (1, 2, 4, 8, 16, 32):
        raise TiffError("samples are not of 1, 2, 4, 8, 16 or 32 bits each")
    if predictor not in (1, 2) or predictor == 2 and bits < 8:
        raise TiffError(f"predictor {predictor} with {bits} bits")
    if compression not in EXPANSION:
        raise TiffError(f"compression {compression}")
    tiled = TILES in tags
    w, h = (one(TILE_W), one(TILE_H)) if tiled else (width, min(one(ROWS, height), height))
    if min(width, height, samples, w, h) < 1:
        raise TiffError("a size is zero")
    at, sizes = (tags[TILES], tags[TILE_BYTES]) if tiled else (tags[STRIPS], tags[STRIP_BYTES])
    depth = samples if planar == 1 else 1
    planes = 1 if planar == 1 else samples
    across, down = -(-width // w), -(-height // h)
    held = sum(min(n, len(data)) for n in sizes) * EXPANSION[compression]
    row = -(-w * depth * bits // 8)
    if planes * across * (down * h if tiled else height) * row > held + 8:
        raise TiffError("segments are too short for the page")
    sample = np.dtype(f"<u{max(1, bits // 8)}")
    image = np.zeros((planes, down * h, across * w, depth), sample)
    for k in range(planes * across * down):
        plane, cell = divmod(k, across * down)
        y, x = divmod(cell, across)
        rows = h if tiled else min(h, height - y * h)
        raw = np.frombuffer(_unpack(data[at[k] : at[k] + sizes[k]], compression, rows * row), np.uint8)
        if bits < 8:
            each = np.unpackbits(raw.reshape(rows, row), axis=1).reshape(rows, -1, bits)
            part = (each @ (1 << np.arange(bits)[::-1])).astype(np.uint8)[:, : w * depth].reshape(rows, w, depth)
        else:
            part = raw.view(np.dtype(f"{order}u{bits // 8}")).reshape(rows, w, depth)
        if predictor == 2:
            part = np.cumsum(part, axis=1, dtype=sample)
        image[plane, y * h : y * h + rows, x * w : x * w + w] = part
    image = image[:, :height, :width]
    flat = image[0] if planes == 1 else np.moveaxis(image[..., 0], 0, -1)
    return Page(index, width, height, samples, compression, predictor, flat.tobytes())


PAGE_SCHEMA = "id long, page int, width int, height int, samples int, compression int, predictor int, data binary, error string"


def tiff_pages(blobs: DataFrame, id_col: str, blob_col: str) -> DataFrame:
    """One row per page of every TIFF in ``blob_col``; see the module text for what fails."""

    kinds = [pa.int64(), *[pa.int32()] * 6, pa.binary(), pa.string()]
    names = [f.split()[0] for f in PAGE_SCHEMA.split(", ")]

    def rows(i, blob):
        try:
            if blob is None:
                raise TiffError("null")
            for p in walk_pages(blob):
                yield i, p.index, p.width, p.height, p.samples, p.compression, p.predictor, p.data, None
        except TiffError as e:
            yield i, -1, None, None, None, None, None, None, str(e)

    def run(batches):
        for batch in sliced(batches):
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in rows(i, blob):  # a page at a time
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    return blobs.select(F.col(id_col).cast("long").alias("id"), F.col(blob_col).cast("binary").alias("blob")).mapInArrow(run, PAGE_SCHEMA)


def _feature(pixels: np.ndarray, pages: int) -> str:
    """Size, pages, sum of samples, sum of steps along rows, distinct values: all whole numbers."""
    rows = pixels.reshape(-1, PIXELS_A_ROW)
    steps = int(np.abs(np.diff(rows.astype(np.int16), axis=1)).sum(dtype=np.int64))
    return f"{PIXELS_A_ROW}x{len(rows)};pages={pages};sum={int(pixels.sum(dtype=np.int64))};steps={steps};values={int((np.bincount(pixels, minlength=256) > 0).sum())}"


def _media_rows(compression: int, predictor: int):
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches):
        for batch in sliced(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                media = write_tiff(raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0)), compression, predictor)
                pages = [p.data for p in walk_pages(media)]
                back = pages[0] if len(pages) == 1 else b"".join(pages)
                rows.append((doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), _feature(np.frombuffer(back, np.uint8), len(pages))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=names)

    return run


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", compression: int = DEFLATE, predictor: int = 2) -> DataFrame:
    """Each text stored as a TIFF and read back page by page: sizes, digests and a feature per row."""
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(_media_rows(compression, predictor), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def text_tiffs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", compression: int = DEFLATE, predictor: int = 2, tile: int | None = None) -> DataFrame:
    """``(id, media)``: each text as a TIFF, for :func:`tiff_pages`."""

    def run(batches):
        for batch in sliced(batches):
            media = []
            for t in batch.column(1).to_pylist():
                raw = (t or "").encode("utf-8", "surrogatepass")
                media.append(write_tiff(raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0)), compression, predictor, tile))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], names=["id", "media"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, media binary")
