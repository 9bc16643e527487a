"""FITS binary tables and images as Spark data sources (``spark.read.format("skytable").load(path)``).

Files are sequences of 2880-byte blocks: header cards of 80 characters, then data. A binary table has
rows of fixed width, big-endian. One partition reads a range of rows of one extension, so a large
table is read in parallel without reading the rest of it. The source needs paths that Python can
open on all machines; for others use :func:`tables_from_binary` over Spark's ``binaryFile``.

``df.write.format("skytable")`` writes a folder with one file a partition; ``append`` adds files to it.
A task encodes a bounded number of rows at a time and writes the header's row count last. Strings have
the width of the option ``strings`` (32), arrays that of the option ``arrays`` (1); longer ones raise.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

BLOCK, CARD = 2880, 80
#: Binary table codes (fixed by the format): numpy type and Spark type.
CODES = {"L": ("S1", "boolean"), "B": ("u1", "short"), "I": (">i2", "short"), "J": (">i4", "int"), "K": (">i8", "long"), "E": (">f4", "float"), "D": (">f8", "double")}
FROM_SPARK = {"boolean": "L", "short": "I", "smallint": "I", "int": "J", "bigint": "K", "long": "K", "float": "E", "double": "D"}


@dataclass(frozen=True)
class Column:
    name: str
    code: str
    repeat: int
    offset: int
    scale: float
    zero: float
    null: int | None

    def spark_type(self) -> str:
        if self.code == "A":
            return "string"
        kind = CODES[self.code][1] if (self.scale, self.zero) == (1.0, 0.0) else "double"
        return kind if self.repeat == 1 else f"array<{kind}>"


@dataclass(frozen=True)
class Table:
    extension: int
    data_at: int
    rows: int
    width: int
    columns: tuple[Column, ...]
    header: tuple[tuple[str, str], ...]


def _value(card: str) -> str:
    text = card[10:]
    if text.lstrip().startswith("'"):
        body = text.lstrip()[1:]
        end = body.replace("''", "\0\0").find("'")
        return body[:end].replace("''", "'").rstrip()
    return text.split("/")[0].strip()


def read_headers(f) -> Iterator[tuple[int, dict[str, str], int]]:
    """(extension, header, where its data begins) of an open file."""
    at, number = 0, 0
    while True:
        f.seek(at)
        cards: dict[str, str] = {}
        while True:
            block = f.read(BLOCK)
            if len(block) < BLOCK:
                return
            at += BLOCK
            done = False
            for i in range(0, BLOCK, CARD):
                card = block[i : i + CARD].decode("ascii", "replace")
                key = card[:8].strip()
                if key == "END":
                    done = True
                    break
                if card[8:10] == "= ":
                    cards[key] = _value(card)
            if done:
                break
        yield number, cards, at
        axes = [int(cards[f"NAXIS{i + 1}"]) for i in range(int(cards.get("NAXIS", 0)))]
        size = abs(int(cards.get("BITPIX", 8))) // 8 * (int(np.prod(axes)) if axes else 0)
        size = (size + int(cards.get("PCOUNT", 0))) * int(cards.get("GCOUNT", 1))
        at += -(-size // BLOCK) * BLOCK
        number += 1


def table_of(number: int, h: dict[str, str], at: int) -> Table:
    cols, offset = [], 0
    for i in range(1, int(h["TFIELDS"]) + 1):
        form = h[f"TFORM{i}"].strip()
        digits = len(form) - len(form.lstrip("0123456789"))
        repeat, code = int(form[:digits] or 1), form[digits : digits + 1]
        width = repeat * (1 if code == "A" else np.dtype(CODES[code][0]).itemsize)
        null = h.get(f"TNULL{i}")
        cols.append(Column(h.get(f"TTYPE{i}", f"col{i}"), code, repeat, offset, float(h.get(f"TSCAL{i}", 1)), float(h.get(f"TZERO{i}", 0)), int(null) if null is not None else None))
        offset += width
    return Table(number, at, int(h["NAXIS2"]), int(h["NAXIS1"]), tuple(cols), tuple(h.items()))


def decode_rows(table: Table, data: bytes, wanted: list[str] | None = None) -> Iterator[tuple]:
    n = len(data) // table.width
    raw = np.frombuffer(data, np.uint8).reshape(n, table.width)
    out = []
    for c in table.columns:
        if wanted is not None and c.name not in wanted:
            continue
        if c.code == "A":
            text = np.ascontiguousarray(raw[:, c.offset : c.offset + c.repeat]).view(f"S{max(1, c.repeat)}").ravel() if c.repeat else [b""] * n
            out.append([t.decode("latin-1").rstrip() for t in text])
            continue
        kind = np.dtype(CODES[c.code][0])
        v = np.ascontiguousarray(raw[:, c.offset : c.offset + c.repeat * kind.itemsize]).view(kind).reshape(n, c.repeat)
        if c.code == "L":
            v = v == b"T"
        missing = v == c.null if c.null is not None else None
        if (c.scale, c.zero) != (1.0, 0.0):
            v = c.zero + c.scale * v.astype(float)
        rows = v.tolist()
        if missing is not None and missing.any():
            rows = [[None if m else x for x, m in zip(r, ms, strict=True)] for r, ms in zip(rows, missing.tolist(), strict=True)]
        out.append([r[0] for r in rows] if c.repeat == 1 else rows)
    return zip(*out, strict=True)


class RowRange(InputPartition):
    def __init__(self, path: str, table: Table, first: int, last: int):
        self.path, self.table, self.first, self.last = path, table, first, last


#: Files up to SMALL bytes are read whole, many by a task: up to GROUP_BYTES and GROUP_FILES of them.
SMALL, GROUP_BYTES, GROUP_FILES = 4 << 20, 32 << 20, 1000


class FileGroup(InputPartition):
    """Small files that one task opens and reads whole."""

    def __init__(self, paths: list[str]):
        self.paths = paths


def grouped_files(paths: list[str]) -> tuple[list[FileGroup], list[str]]:
    """Groups of the small files, and the large ones; only the folder's entries are looked at, no file is opened."""
    groups, large, size = [], [], 0
    for p in paths:
        n = os.path.getsize(p)
        if n > SMALL:
            large.append(p)
            continue
        if not groups or size + n > GROUP_BYTES or len(groups[-1].paths) >= GROUP_FILES:
            groups.append(FileGroup([]))
            size = 0
        groups[-1].paths.append(p)
        size += n
    return groups, large


def find_table(path: str, ext: str | None) -> Table:
    """The first table of a file, or that of the extension ``ext``."""
    with open(path, "rb") as f:
        for number, h, at in read_headers(f):
            if h.get("XTENSION") == "BINTABLE" and (ext is None or int(ext) == number):
                return table_of(number, h, at)
    raise ValueError(f"{path} has no such table")


class SkyTableSource(DataSource):
    """Options: ``path`` (file, folder or pattern), ``ext`` (default: the first table), ``rows`` per partition, ``provenance``.

    Without ``rows`` large files are read by ranges of 200,000 rows and small ones many to a task; with it all are read by ranges.

    With ``provenance`` every row has the columns ``backref_file`` and ``backref_index``: its file and its 0-based number in it.
    """

    @classmethod
    def name(cls):
        return "skytable"

    def _files(self) -> list[str]:
        path = self.options["path"].removeprefix("file://")
        if os.path.isdir(path):
            path = os.path.join(path, "*.fits")
        files = sorted(glob.glob(path))
        if not files:
            raise FileNotFoundError(path)
        return files

    def _table(self, path: str) -> Table:
        return find_table(path, self.options.get("ext"))

    def schema(self):
        own = [f"`{c.name}` {c.spark_type()}" for c in self._table(self._files()[0]).columns]
        return ", ".join(own + (["backref_file string", "backref_index long"] if self._provenance() else []))

    def _provenance(self) -> bool:
        return self.options.get("provenance", "false").lower() == "true"

    def reader(self, schema):
        return SkyTableReader(self._files(), self.options.get("ext"), int(self.options.get("rows", 0)), [f.name for f in schema.fields], self._provenance())

    def writer(self, schema, overwrite):
        return SkyTableWriter(self.options["path"].removeprefix("file://"), [(f.name, f.dataType.simpleString()) for f in schema.fields], overwrite, int(self.options.get("strings", 32)), int(self.options.get("arrays", 1)))


@dataclass
class Written(WriterCommitMessage):
    path: str


class SkyTableWriter(DataSourceWriter):
    """Files are written under hidden names and get their own when all tasks have ended."""

    STEP = 10_000

    def __init__(self, folder: str, columns: list[tuple[str, str]], overwrite: bool, strings: int, arrays: int):
        self.folder, self.columns, self.overwrite, self.strings, self.arrays = folder, columns, overwrite, strings, arrays
        os.makedirs(folder, exist_ok=True)
        self.old = sorted(glob.glob(os.path.join(folder, "*.fits"))) if overwrite else []

    def write(self, rows):
        import uuid

        path = os.path.join(self.folder, f".{uuid.uuid4().hex}.fits.part")
        try:
            self._table(path, rows)
        except BaseException:
            _remove([path])
            raise
        return Written(path)

    def _table(self, path, rows):
        n, step = 0, []
        with open(path, "wb") as f:
            f.write(table_header(self.columns, self._widths(), 0))
            for row in rows:
                step.append(tuple(row))
                if len(step) == self.STEP:
                    f.write(encode_rows(self.columns, self._widths(), step))
                    n, step = n + len(step), []
            f.write(encode_rows(self.columns, self._widths(), step))
            n += len(step)
            f.write(b"\0" * (-f.tell() % BLOCK))
            f.seek(0)
            f.write(table_header(self.columns, self._widths(), n))

    def _widths(self) -> list[int]:
        return [self.strings if k == "string" else self.arrays if k.startswith("array<") else 1 for _, k in self.columns]

    def commit(self, messages):
        for m in messages:
            if m is not None:
                folder, name = os.path.split(m.path)
                os.replace(m.path, os.path.join(folder, "part-" + name[1:].removesuffix(".part")))
        for path in self.old:
            os.remove(path)

    def abort(self, messages):
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


class SkyImageSource(DataSource):
    """FITS images as rows (file, image, x, y, value), a range of image rows a partition. Options: ``path``, ``rows``."""

    @classmethod
    def name(cls):
        return "skyimage"

    def schema(self):
        return "file string, image long, x long, y long, value double"

    def reader(self, schema):
        path = self.options["path"].removeprefix("file://")
        files = sorted(glob.glob(os.path.join(path, "*.fits") if os.path.isdir(path) else path))
        if not files:
            raise FileNotFoundError(path)
        return SkyImageReader(files, int(self.options.get("rows", 256)))

    def writer(self, schema, overwrite):
        return SkyImageWriter(self.options["path"].removeprefix("file://"), schema.fieldNames(), overwrite)


class SkyImageWriter(DataSourceWriter):
    """A file an image from rows (image, x, y, value, width, height) that a task gets in the order of image, y and x; see :func:`write_images`.

    A line of pixels is held at a time; pixels without a row are NaN. Files get their names when all tasks have ended.
    """

    def __init__(self, folder: str, names: list[str], overwrite: bool):
        self.folder, self.at = folder, [names.index(c) for c in ("image", "x", "y", "value", "width", "height")]
        os.makedirs(folder, exist_ok=True)
        self.old = set(glob.glob(os.path.join(folder, "*.fits"))) if overwrite else set()

    def write(self, rows):
        import uuid
        from itertools import groupby

        out = []
        try:
            for image, pixels in groupby(([row[i] for i in self.at] for row in rows), key=lambda p: p[0]):
                final = os.path.join(self.folder, f"image-{image}.fits")
                path = os.path.join(self.folder, f".{uuid.uuid4().hex}.fits.part")
                if any(f == final for _, f in out):
                    raise ValueError(f"the rows of image {image} are not together")
                out.append((path, final))
                with open(path, "wb") as f:
                    self._image(f, pixels)
        except BaseException:
            _remove(p for p, _ in out)
            raise
        return WrittenFiles(out)

    def _image(self, f, pixels):
        line, at, width, height = None, 0, 0, 0
        for _, x, y, value, w, h in pixels:
            if line is None:
                width, height = int(w), int(h)
                f.write(image_header(width, height))
                line = np.full(width, np.nan, ">f8")
            if not at <= y < height or not 0 <= x < width:
                raise ValueError("pixels out of order or outside of the image")
            while at < y:
                f.write(line.tobytes())
                line[:] = np.nan
                at += 1
            line[x] = np.nan if value is None else value
        for at in range(at, height):  # noqa: B020
            f.write(line.tobytes())
            line[:] = np.nan
        f.write(b"\0" * (-f.tell() % BLOCK))

    def commit(self, messages):
        _commit_files(messages, self.old)

    def abort(self, messages):
        for m in messages:
            _remove(p for p, _ in (m.paths if m is not None else ()))


def write_images(pixels: DataFrame, path: str, mode: str = "append") -> None:
    """Images in long form (image, x, y, value) as files, ``image-<number>.fits`` each; an image's pixels pass through one task as a sorted stream."""
    sizes = pixels.groupBy("image").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    rows = pixels.select("image", "x", "y", F.col("value").cast("double").alias("value")).join(sizes, "image")
    rows.repartition("image").sortWithinPartitions("image", "y", "x").write.format("skyimage").mode(mode).save(path)


class SkyImageReader(DataSourceReader):
    """Two-dimensional images of all extensions, numbered file by file; BSCALE and BZERO applied, BLANK and NaN left out."""

    def __init__(self, files: list[str], rows: int):
        self.files, self.rows = files, rows

    def partitions(self):
        out, number = [], 0
        for path in self.files:
            with open(path, "rb") as f:
                for _, h, at in read_headers(f):
                    if h.get("XTENSION", "IMAGE") == "IMAGE" and int(h.get("NAXIS", 0)) == 2:
                        height = int(h["NAXIS2"])
                        for lo in range(0, height, self.rows):
                            out.append(ImageRows(path, number, h, at, lo, min(height, lo + self.rows)))
                        number += 1
        return out or [ImageRows("", 0, {}, 0, 0, 0)]

    def read(self, part):
        if part.last == part.first:
            return
        h, kind = part.header, np.dtype({8: "u1", 16: ">i2", 32: ">i4", 64: ">i8", -32: ">f4", -64: ">f8"}[int(part.header["BITPIX"])])
        width = int(h["NAXIS1"])
        scale, zero, blank = float(h.get("BSCALE", 1)), float(h.get("BZERO", 0)), h.get("BLANK")
        for y in range(part.first, part.last):
            with open(part.path, "rb") as f:
                f.seek(part.at + y * width * kind.itemsize)
                raw = np.frombuffer(f.read(width * kind.itemsize), kind)
            value = zero + scale * raw.astype(float)
            known = ~np.isnan(value) & ((raw != int(blank)) if blank is not None else True)
            for x in np.flatnonzero(known).tolist():
                yield part.path, part.number, x, y, float(value[x])


class ImageRows(InputPartition):
    def __init__(self, path: str, number: int, header: dict[str, str], at: int, first: int, last: int):
        self.path, self.number, self.header, self.at, self.first, self.last = path, number, header, at, first, last


def image_header(width: int, height: int) -> bytes:
    """The header of a file with one image of doubles."""
    card = lambda k, v: f"{k:<8}= {v:>20}".ljust(CARD)
    head = card("SIMPLE", "T") + card("BITPIX", -64) + card("NAXIS", 2) + card("NAXIS1", width) + card("NAXIS2", height) + "END".ljust(CARD)
    return head.encode("ascii").ljust(-(-len(head) // BLOCK) * BLOCK)


def encode_image(image: np.ndarray) -> bytes:
    """A file with one image of doubles."""
    body = image.astype(">f8").tobytes()
    return image_header(image.shape[1], image.shape[0]) + body + b"\0" * (-len(body) % BLOCK)


def _remove(paths) -> None:
    for path in paths:
        if os.path.exists(path):
            os.remove(path)


def _commit_files(messages, old: set[str]) -> None:
    """Gives written files their names, each of which one task may have, and removes the others of ``old``."""
    files = [f for m in messages if m is not None for f in m.paths]
    names = [final for _, final in files]
    if len(set(names)) < len(names):
        _remove(p for p, _ in files)
        raise ValueError("several rows or tasks wrote one file")
    for path, final in files:
        os.replace(path, final)
    _remove(old - set(names))


class SkyTableReader(DataSourceReader):
    """Ranges of rows of large files, whose headers are read for that; small files many to a task, which reads their headers."""

    def __init__(self, files: list[str], ext: str | None, rows: int, wanted: list[str], provenance: bool = False):
        self.files, self.ext, self.rows, self.wanted, self.provenance = files, ext, rows, wanted, provenance

    def partitions(self):
        groups, large = ([], self.files) if self.rows else grouped_files(self.files)
        rows, tables = self.rows or 200_000, [(p, find_table(p, self.ext)) for p in large]
        return [*groups, *(RowRange(p, t, lo, min(lo + rows, t.rows)) for p, t in tables for lo in range(0, t.rows, rows))] or [FileGroup([])]

    def read(self, partition):
        if isinstance(partition, RowRange):
            yield from self._rows(partition)
            return
        for path in partition.paths:
            t = find_table(path, self.ext)
            yield from self._rows(RowRange(path, t, 0, t.rows))

    def _rows(self, part: RowRange):
        t, step = part.table, 10_000
        with open(part.path, "rb") as f:
            for lo in range(part.first, part.last, step):
                f.seek(t.data_at + lo * t.width)
                data = f.read((min(lo + step, part.last) - lo) * t.width)
                if self.provenance:
                    for i, row in enumerate(decode_rows(t, data, self.wanted), lo):
                        yield (*row, part.path, i)
                else:
                    yield from decode_rows(t, data, self.wanted)


class SkyHeaderSource(DataSource):
    """Header cards as rows (file, extension, name, value), small files many to a task. Option: ``path``."""

    @classmethod
    def name(cls):
        return "skyheader"

    def schema(self):
        return "file string, extension int, name string, value string"

    def reader(self, schema):
        path = self.options["path"].removeprefix("file://")
        return SkyHeaderReader(sorted(glob.glob(os.path.join(path, "*.fits") if os.path.isdir(path) else path)))


class SkyHeaderReader(DataSourceReader):
    def __init__(self, files: list[str]):
        self.files = files

    def partitions(self):
        groups, large = grouped_files(self.files)
        return [*groups, *(FileGroup([p]) for p in large)] or [FileGroup([])]

    def read(self, partition):
        for path in partition.paths:
            with open(path, "rb") as f:
                for number, cards, _ in read_headers(f):
                    yield from ((path, number, k, v) for k, v in cards.items())


class SkyFileSink(DataSource):
    """``df.write.format("skyfiles")``: a file a row. The columns are ``name`` (of the file), ``header`` (map of cards of the first part) and,
    for each extension in order, an array of structs, written as a binary table with the column's name as EXTNAME.
    """

    @classmethod
    def name(cls):
        return "skyfiles"

    def schema(self):
        return "name string, header map<string, string>"

    def writer(self, schema, overwrite):
        tables = [(f.name, [(c.name, c.dataType.simpleString()) for c in f.dataType.elementType.fields]) for f in schema.fields if f.name not in ("name", "header")]
        return SkyFileWriter(self.options["path"].removeprefix("file://"), schema.fieldNames(), tables, overwrite)


@dataclass
class WrittenFiles(WriterCommitMessage):
    paths: list[tuple[str, str]]


class SkyFileWriter(DataSourceWriter):
    """Files are written under hidden names and get their own when all tasks have ended; a name that is there already is replaced."""

    def __init__(self, folder: str, names: list[str], tables: list[tuple[str, list[tuple[str, str]]]], overwrite: bool):
        self.folder, self.names, self.tables = folder, names, tables
        os.makedirs(folder, exist_ok=True)
        self.old = set(glob.glob(os.path.join(folder, "*.fits"))) if overwrite else set()

    def write(self, rows):
        import uuid

        out = []
        try:
            for row in rows:
                at = dict(zip(self.names, row, strict=True))
                path = os.path.join(self.folder, f".{uuid.uuid4().hex}.fits.part")
                out.append((path, os.path.join(self.folder, f"{at['name']}.fits")))
                with open(path, "wb") as f:
                    f.write(primary_header(at["header"] or {}))
                    for name, columns in self.tables:
                        f.write(encode_table(columns, [tuple(r) for r in at[name] or ()], {"EXTNAME": name})[BLOCK:])
        except BaseException:
            _remove(p for p, _ in out)
            raise
        return WrittenFiles(out)

    def commit(self, messages):
        _commit_files(messages, self.old)

    def abort(self, messages):
        for m in messages:
            _remove(p for p, _ in (m.paths if m is not None else ()))


def primary_header(cards: dict[str, str]) -> bytes:
    """The first part of a file: a header without data. Numbers and T or F stand as they are, other values in quotes."""
    def card(key: str, value: str) -> str:
        if len(key) > 8 or not key.isascii():
            raise ValueError(f"{key} is no keyword")
        try:
            float(value)
            plain = True
        except ValueError:
            plain = value in ("T", "F")
        text = f"{key:<8}= {value:>20}" if plain else f"{key:<8}= '{value.replace(chr(39), chr(39) * 2)}'"
        if len(text) > CARD:
            raise ValueError(f"the value of {key} is too long")
        return text.ljust(CARD)

    text = card("SIMPLE", "T") + card("BITPIX", "8") + card("NAXIS", "0") + card("EXTEND", "T") + "".join(card(k.upper(), v) for k, v in cards.items()) + "END".ljust(CARD)
    return text.encode("latin-1", "replace").ljust(-(-len(text) // BLOCK) * BLOCK)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SkyTableSource)
    spark.dataSource.register(SkyHeaderSource)
    spark.dataSource.register(SkyFileSink)
    spark.dataSource.register(SkyImageSource)


def table_header(columns: list[tuple[str, str]], widths: list[int], rows: int, header: dict[str, str] | None = None) -> bytes:
    """The empty first part and the header of a binary table."""
    forms = [f"{w}{'A' if k == 'string' else FROM_SPARK[k[6:-1] if k.startswith('array<') else k]}" for (_, k), w in zip(columns, widths, strict=True)]
    width = sum(int(f[:-1]) * (1 if f[-1] == "A" else np.dtype(CODES[f[-1]][0]).itemsize) for f in forms)
    card = lambda k, v: f"{k:<8}= {v:>20}".ljust(CARD)
    text = lambda k, v: f"{k:<8}= '{v}'".ljust(CARD)
    first = card("SIMPLE", "T") + card("BITPIX", 8) + card("NAXIS", 0) + card("EXTEND", "T")
    second = text("XTENSION", "BINTABLE") + card("BITPIX", 8) + card("NAXIS", 2) + card("NAXIS1", width) + card("NAXIS2", rows) + card("PCOUNT", 0) + card("GCOUNT", 1) + card("TFIELDS", len(columns))
    second += "".join(text(f"TTYPE{i}", n) + text(f"TFORM{i}", f) for i, ((n, _), f) in enumerate(zip(columns, forms, strict=True), 1))
    second += "".join(text(k, v) for k, v in (header or {}).items())
    return b"".join((h + "END".ljust(CARD)).encode("ascii").ljust(-(-(len(h) + CARD) // BLOCK) * BLOCK) for h in (first, second))


def encode_rows(columns: list[tuple[str, str]], widths: list[int], rows: list[tuple]) -> bytes:
    """Rows as the bytes of a table, none for no rows; nulls are empty texts, false, NaN or zero."""
    if not rows:
        return b""
    out = []
    for i, ((name, kind), width) in enumerate(zip(columns, widths, strict=True)):
        values = [r[i] for r in rows]
        if kind == "string":
            texts = [(v or "").encode("latin-1", "replace") for v in values]
            if any(len(t) > width for t in texts):
                raise ValueError(f"a text of {name} is longer than {width}")
            out.append(np.array(texts, f"S{width}").view(np.uint8).reshape(len(rows), width))
            continue
        base = kind[6:-1] if kind.startswith("array<") else kind
        code = FROM_SPARK[base]
        flat = values if kind.startswith("array<") else [[v] for v in values]
        flat = [list(v) if v is not None else [None] * width for v in flat]
        if any(len(v) != width for v in flat):
            raise ValueError(f"an array of {name} has not {width} entries")
        if code == "L":
            block = np.array([[b"T" if x else b"F" for x in v] for v in flat], "S1").reshape(len(rows), width)
        else:
            empty = float("nan") if code in "ED" else 0
            block = np.array([[empty if x is None else x for x in v] for v in flat]).astype(CODES[code][0]).reshape(len(rows), width)
        out.append(np.ascontiguousarray(block).view(np.uint8).reshape(len(rows), -1))
    return np.concatenate(out, axis=1).tobytes()


def encode_table(columns: list[tuple[str, str]], rows: list[tuple], header: dict[str, str] | None = None) -> bytes:
    """A small file with one binary table, as bytes; columns are (name, Spark type), strings as wide as the longest. Large ones are written by Spark."""
    widths = [max([1, *(len(r[i] or "") for r in rows)]) if k == "string" else len(rows[0][i]) if k.startswith("array<") and rows else 1 for i, (_, k) in enumerate(columns)]
    body = encode_rows(columns, widths, rows)
    return table_header(columns, widths, len(rows), header) + body + b"\0" * (-len(body) % BLOCK)


def tables_from_binary(files: DataFrame, like: bytes) -> DataFrame:
    """Rows of the first table of each file in a ``binaryFile`` table; ``like`` is a file whose columns all share."""
    import io

    def first(data: bytes) -> Table:
        return next(table_of(n, h, at) for n, h, at in read_headers(io.BytesIO(data)) if h.get("XTENSION") == "BINTABLE")

    schema = ", ".join(f"`{c.name}` {c.spark_type()}" for c in first(like).columns)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            for data in pdf["content"]:
                t = first(data)
                yield pd.DataFrame(list(decode_rows(t, data[t.data_at : t.data_at + t.rows * t.width])), columns=[c.name for c in t.columns])

    return files.select("content").mapInPandas(run, schema)
