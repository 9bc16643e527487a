"""Files of fixed-size binary records: a data source that reads ranges of records, and the layouts of packed catalogues.

``spark.read.format("skyrecords")`` reads little-endian records. Options: ``path`` (file, folder or pattern), ``fields``
(``name:code,..`` with the codes b B h H i I q f d; a name of ``_`` is skipped), ``record`` (bytes of a record, by default those of the
fields), ``records`` per partition. A file is cut at multiples of a record, so large files are read by many tasks, each of its own bytes.
The columns ``file`` and ``row`` say where a record stands. A file's last, incomplete record raises.

``df.write.format("skyrecords")`` with the same options writes a file a partition; ``append`` adds files. Nulls can't be packed and raise.

Values packed as decimal digits of a word, and scaled whole numbers, are taken apart and put together by column arithmetic.
"""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Codes: numpy type, Spark type.
CODES = {"b": ("<i1", "byte"), "B": ("<u1", "short"), "h": ("<i2", "short"), "H": ("<u2", "int"), "i": ("<i4", "int"), "I": ("<u4", "long"), "q": ("<i8", "long"), "f": ("<f4", "float"), "d": ("<f8", "double")}
ARROW = {"byte": pa.int8(), "short": pa.int16(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64()}


@dataclass(frozen=True)
class Layout:
    fields: tuple[tuple[str, str], ...]
    record: int

    @staticmethod
    def of(options) -> Layout:
        fields = tuple(tuple(f.strip().rsplit(":", 1)) for f in options["fields"].split(","))
        size = sum(np.dtype(CODES[c][0]).itemsize for _, c in fields)
        record = int(options.get("record", size))
        if record < size:
            raise ValueError(f"a record of {record} bytes can't hold {size}")
        return Layout(fields, record)

    def dtype(self) -> np.dtype:
        names, kinds, at, offsets = [], [], 0, []
        for name, code in self.fields:
            kind = np.dtype(CODES[code][0])
            if name != "_":
                names.append(name)
                kinds.append(kind)
                offsets.append(at)
            at += kind.itemsize
        return np.dtype({"names": names, "formats": kinds, "offsets": offsets, "itemsize": self.record})

    def columns(self) -> list[tuple[str, str]]:
        return [(n, CODES[c][1]) for n, c in self.fields if n != "_"]


class Records(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class SkyRecordSource(DataSource):
    @classmethod
    def name(cls):
        return "skyrecords"

    def schema(self):
        return ", ".join(["file string", "row long", *(f"`{n}` {k}" for n, k in Layout.of(self.options).columns())])

    def reader(self, schema):
        path = self.options["path"].removeprefix("file://")
        files = sorted(p for p in (glob.glob(os.path.join(path, "*")) if os.path.isdir(path) else glob.glob(path)) if os.path.isfile(p))
        if not files:
            raise FileNotFoundError(path)
        return SkyRecordReader(files, Layout.of(self.options), int(self.options.get("records", 1_000_000)))

    def writer(self, schema, overwrite):
        return SkyRecordWriter(self.options["path"].removeprefix("file://"), Layout.of(self.options), overwrite)


class SkyRecordReader(DataSourceReader):
    STEP = 50_000

    def __init__(self, files: list[str], layout: Layout, records: int):
        self.files, self.layout, self.records = files, layout, records

    def partitions(self):
        out = []
        for path in self.files:
            n, rest = divmod(os.path.getsize(path), self.layout.record)
            if rest:
                raise ValueError(f"{path} ends within a record")
            out += [Records(path, lo, min(n, lo + self.records)) for lo in range(0, n, self.records)]
        return out or [Records(self.files[0], 0, 0)]

    def read(self, part: Records) -> Iterator[pa.RecordBatch]:
        kind, columns = self.layout.dtype(), self.layout.columns()
        for lo in range(part.first, part.last, self.STEP):
            n = min(self.STEP, part.last - lo)
            with open(part.path, "rb") as f:
                f.seek(lo * self.layout.record)
                raw = np.frombuffer(f.read(n * self.layout.record), kind)
            yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), pa.array(np.arange(lo, lo + n)), *(pa.array(raw[c].astype(ARROW[k].to_pandas_dtype()), ARROW[k]) for c, k in columns)], names=["file", "row", *(c for c, _ in columns)])


@dataclass
class Written(WriterCommitMessage):
    path: str


class SkyRecordWriter(DataSourceArrowWriter):
    """Files are written under hidden names and get their own when all tasks have ended."""

    def __init__(self, folder: str, layout: Layout, overwrite: bool):
        self.folder, self.layout = folder, layout
        os.makedirs(folder, exist_ok=True)
        self.old = sorted(glob.glob(os.path.join(folder, "*"))) if overwrite else []

    def write(self, batches: Iterator[pa.RecordBatch]):
        path, kind = os.path.join(self.folder, f".{uuid.uuid4().hex}.part"), self.layout.dtype()
        try:
            self._records(path, kind, batches)
        except BaseException:
            if os.path.exists(path):
                os.remove(path)
            raise
        return Written(path)

    def _records(self, path, kind, batches):
        with open(path, "wb") as f:
            for batch in batches:
                raw = np.zeros(batch.num_rows, kind)
                for name in kind.names:
                    column = batch.column(batch.schema.get_field_index(name))
                    if column.null_count:
                        raise ValueError(f"{name} holds a null")
                    values = column.to_numpy(zero_copy_only=False)
                    raw[name] = values
                    if kind[name].kind in "iu" and not np.array_equal(raw[name].astype(np.int64), values):
                        raise ValueError(f"{name} holds a value that does not fit")
                f.write(raw.tobytes())

    def commit(self, messages):
        for m in messages:
            if m is not None:
                folder, name = os.path.split(m.path)
                os.replace(m.path, os.path.join(folder, "part-" + name[1:].removesuffix(".part") + ".dat"))
        for path in self.old:
            os.remove(path)

    def abort(self, messages):
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


def read_records(spark: SparkSession, path: str, fields: Sequence[tuple[str, str]], record: int | None = None, records: int = 1_000_000) -> DataFrame:
    spark.dataSource.register(SkyRecordSource)
    return _with(spark.read.format("skyrecords"), fields, record).option("records", records).load(path)


def write_records(df: DataFrame, path: str, fields: Sequence[tuple[str, str]], record: int | None = None, mode: str = "append") -> None:
    df.sparkSession.dataSource.register(SkyRecordSource)
    _with(df.write.format("skyrecords"), fields, record).mode(mode).save(path)


def _with(io, fields, record):
    io = io.option("fields", ",".join(f"{n}:{c}" for n, c in fields))
    return io.option("record", record) if record else io


# ---- digits and scaled numbers ---------------------------------------------------------------------


def unpack_digits(word: str, fields: Sequence[tuple[str, int]]) -> dict[str, Column]:
    """Columns of a word's decimal digits; fields are (name, digits) from the last digit on."""
    out, step = {}, 1
    for name, n in fields:
        out[name] = F.expr(f"cast({word} div {step} % {10**n} as int)")
        step *= 10**n
    return out


def pack_digits(fields: Sequence[tuple[str, int]]) -> Column:
    """The word of columns named as in ``fields``."""
    word, step = F.lit(0).cast("long"), 1
    for name, n in fields:
        word = word + F.col(name).cast("long") * step
        step *= 10**n
    return word


#: USNO-B 1.0 records: twenty words of four bytes. Digits of words, from the last one on; values fixed by the catalogue.
USNOB_FIELDS = [(f"w{i}", "I") for i in range(20)]
USNOB_MOTION = (("a_pm_ra", 4), ("a_pm_spd", 4), ("a_pm_prob", 1), ("a_moving", 1))
USNOB_ERRORS = (("b_pm_ra", 3), ("b_pm_spd", 3), ("b_fit_ra", 1), ("b_fit_spd", 1), ("b_detections", 1), ("b_spike", 1))
USNOB_EPOCH = (("c_ra", 3), ("c_spd", 3), ("c_epoch", 3), ("c_ys4", 1))
USNOB_MAGNITUDE = (("mag", 4), ("field", 3), ("survey", 1), ("star_galaxy", 2))
USNOB_RESIDUAL = (("xi", 4), ("eta", 4), ("calibration", 1))
ARCSEC = 1 / 3600


def usnob_stars(words: DataFrame) -> DataFrame:
    """USNO-B stars of the words w0 .. w19: degrees, proper motions in arc seconds a year, errors in degrees, five observations.

    Residuals of an empty observation (no field, of a star with two detections or more) are zero. ``usnob_id`` is not in a record;
    files give it by ``row``.
    """
    d = unpack_digits("w2", USNOB_MOTION) | unpack_digits("w3", USNOB_ERRORS) | unpack_digits("w4", USNOB_EPOCH)
    t = words.withColumns(d)
    obs = []
    for k in range(5):
        m, r = unpack_digits(f"w{5 + k}", USNOB_MAGNITUDE), unpack_digits(f"w{10 + k}", USNOB_RESIDUAL)
        empty = (F.col("b_detections") >= 2) & (m["field"] == 0)
        off = lambda c: F.when(empty, 0.0).otherwise((c - 5000) * (0.01 * ARCSEC))  # noqa: B023, E731
        obs.append(F.struct((m["mag"] * 0.01).alias("mag"), m["field"].alias("field"), m["survey"].alias("survey"), m["star_galaxy"].alias("star_galaxy"), off(r["xi"]).alias("xi"), off(r["eta"]).alias("eta"), r["calibration"].alias("calibration"), F.col(f"w{15 + k}").alias("scan")))
    scaled = {
        "ra": "w0 * 0.01D / 3600", "dec": "w1 * 0.01D / 3600 - 90", "pm_ra": "0.002D * (a_pm_ra - 5000)", "pm_dec": "0.002D * (a_pm_spd - 5000)", "pm_prob": "0.1D * a_pm_prob", "moving": "a_moving = 1",
        "sigma_pm_ra": "0.001D * b_pm_ra", "sigma_pm_dec": "0.001D * b_pm_spd", "sigma_ra_fit": "0.1D * b_fit_ra / 3600", "sigma_dec_fit": "0.1D * b_fit_spd / 3600", "detections": "b_detections", "spike": "b_spike = 1",
        "sigma_ra": "0.001D * c_ra / 3600", "sigma_dec": "0.001D * c_spd / 3600", "epoch": "1950 + 0.1D * c_epoch", "ys4": "c_ys4 = 1",
    }
    keep = [c for c in ("file", "row") if c in words.columns]
    return t.select(*keep, *[F.expr(e).alias(n) for n, e in scaled.items()], F.array(*obs).alias("obs"))


#: Scaled fields of UCAC records: name, code, factor, offset; in the records' order, fixed by the catalogues. Degrees, magnitudes, years.
MAS, MILLI, CENTI, TENTH_MILLI = 1 / 3_600_000, 1e-3, 1e-2, 1e-4
UCAC3 = [
    ("ra", "I", MAS, 0), ("dec", "I", MAS, -90), ("mag", "h", MILLI, 0), ("apmag", "h", MILLI, 0), ("mag_err", "h", MILLI, 0), ("objtype", "b", 1, 0), ("doublestar", "b", 1, 0), ("sigma_ra", "H", MAS, 0), ("sigma_dec", "H", MAS, 0),
    ("navail", "b", 1, 0), ("nused", "b", 1, 0), ("npm", "b", 1, 0), ("nmatch", "b", 1, 0), ("epoch_ra", "H", CENTI, 1900), ("epoch_dec", "H", CENTI, 1900), ("pm_ra", "i", TENTH_MILLI, 0), ("pm_dec", "i", TENTH_MILLI, 0),
    ("sigma_pm_ra", "H", TENTH_MILLI, 0), ("sigma_pm_dec", "H", TENTH_MILLI, 0), ("twomass_id", "I", 1, 0), ("jmag", "h", MILLI, 0), ("hmag", "h", MILLI, 0), ("kmag", "h", MILLI, 0), ("twomass_jflags", "B", 1, 0), ("twomass_hflags", "B", 1, 0),
    ("twomass_kflags", "B", 1, 0), ("jmag_err", "B", CENTI, 0), ("hmag_err", "B", CENTI, 0), ("kmag_err", "B", CENTI, 0), ("bmag", "h", MILLI, 0), ("r2mag", "h", MILLI, 0), ("imag", "h", MILLI, 0), ("clbl", "B", 1, 0), ("bquality", "B", 1, 0),
    ("r2quality", "B", 1, 0), ("iquality", "B", 1, 0), *((f"matchflag{k}", "B", 1, 0) for k in range(10)), ("yale_gflag", "B", 1, 0), ("yale_cflag", "B", 1, 0), ("leda_flag", "B", 1, 0), ("twomass_extsource_flag", "B", 1, 0), ("mpos", "I", 1, 0),
]
UCAC4 = [
    ("ra", "I", MAS, 0), ("dec", "I", MAS, -90), ("mag", "h", MILLI, 0), ("apmag", "h", MILLI, 0), ("mag_err", "B", CENTI, 0), ("objtype", "B", 1, 0), ("doublestar", "B", 1, 0), ("sigma_ra", "b", MAS, 128 * MAS), ("sigma_dec", "b", MAS, 128 * MAS),
    ("navail", "B", 1, 0), ("nused", "B", 1, 0), ("nmatch", "B", 1, 0), ("epoch_ra", "H", CENTI, 1900), ("epoch_dec", "H", CENTI, 1900), ("pm_rac", "h", TENTH_MILLI, 0), ("pm_dec", "h", TENTH_MILLI, 0),
    ("sigma_pm_ra", "B", TENTH_MILLI, 128e-4), ("sigma_pm_dec", "B", TENTH_MILLI, 128e-4), ("twomass_id", "I", 1, 0), ("jmag", "h", MILLI, 0), ("hmag", "h", MILLI, 0), ("kmag", "h", MILLI, 0), ("twomass_jflags", "B", 1, 0), ("twomass_hflags", "B", 1, 0),
    ("twomass_kflags", "B", 1, 0), ("jmag_err", "B", CENTI, 0), ("hmag_err", "B", CENTI, 0), ("kmag_err", "B", CENTI, 0), *((f"{b}mag", "h", MILLI, 0) for b in "BVgri"), *((f"{b}mag_err", "B", CENTI, 0) for b in "BVgri"),
    ("yale_gc_flag", "B", 1, 0), ("catalog_flags", "i", 1, 0), ("leda_flag", "B", 1, 0), ("twomass_extsource_flag", "B", 1, 0), ("mpos", "I", 1, 0), ("ucac2_zone", "H", 1, 0), ("ucac2_number", "I", 1, 0),
]
#: Bytes of a record.
UCAC3_RECORD, UCAC4_RECORD, USNOB_RECORD = 84, 78, 80


def layout_of(scaled: Sequence[tuple]) -> list[tuple[str, str]]:
    return [(n, c) for n, c, _, _ in scaled]


def scaled_stars(raw: DataFrame, scaled: Sequence[tuple]) -> DataFrame:
    """Records with their fields as degrees, magnitudes and years; counts and flags stay whole numbers."""
    value = lambda n, f, o: F.col(n) if (f, o) == (1, 0) else (F.col(n) * f + o).alias(n)
    return raw.select(*[c for c in ("file", "row") if c in raw.columns], *[value(n, f, o) for n, _, f, o in scaled])


def read_usnob(spark: SparkSession, path: str, records: int = 1_000_000) -> DataFrame:
    return usnob_stars(read_records(spark, path, USNOB_FIELDS, USNOB_RECORD, records))


def read_ucac3(spark: SparkSession, path: str, records: int = 1_000_000) -> DataFrame:
    return scaled_stars(read_records(spark, path, layout_of(UCAC3), UCAC3_RECORD, records), UCAC3)


def read_ucac4(spark: SparkSession, path: str, records: int = 1_000_000) -> DataFrame:
    return scaled_stars(read_records(spark, path, layout_of(UCAC4), UCAC4_RECORD, records), UCAC4)
