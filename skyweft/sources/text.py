"""Delimited text and typed-struct text files as tables."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types of the struct text format and their Spark types (fixed values).
STRUCT_TYPES = {"short": "short", "int": "int", "long": "long", "float": "float", "double": "double", "char": "string"}
_TYPEDEF = re.compile(r"typedef\s+(struct|enum)\s*\{(.*?)\}\s*(\w+)\s*;", re.S)
_MEMBER = re.compile(r"(\w+)\s+(\w+)((?:\s*[\[<]\d*[\]>])*)\s*;?")


def read_delimited(spark: SparkSession, path: str, names: list[str], separator: str | None = None, skip: int = 0, types: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(rows, dropped)``: lines of whitespace or separator delimited text, ``#`` comments off, lines of a wrong width counted in ``dropped``.

    Types not given are inferred for a column as a whole: long if all values are whole numbers (0x..
    too), else double if all are numbers, else string; that takes one pass over the file. The first
    ``skip`` lines of each file, whatever they hold, are left out.
    """
    lines = spark.read.text(path)
    if skip:
        lines = _without_head(lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at")), skip)
    lines = lines.where(~F.col("value").rlike(r"^\s*(#|$)"))
    pattern = r"\s+" if separator is None else re.escape(separator)
    cut = lines.select(F.split(F.trim("value") if separator is None else F.col("value"), pattern).alias("v"))
    good = cut.where(F.size("v") == len(names)).select(*[F.trim(F.col("v")[i]).alias(n) for i, n in enumerate(names)])
    dropped = cut.where(F.size("v") != len(names)).agg(F.count(F.lit(1)).alias("dropped"))
    known = dict(types or {})
    open_ = [n for n in names if n not in known]
    if open_:
        whole, number = r"^[+-]?([0-9]+|0[xX][0-9a-fA-F]+)$", r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^(?i:nan|[+-]?inf)$"
        r = good.agg(*[x for n in open_ for x in (F.min(F.col(n).rlike(whole)).alias(f"{n}__w"), F.min(F.col(n).rlike(number) | F.col(n).rlike(whole)).alias(f"{n}__n"))]).first()
        known |= {n: "long" if r[f"{n}__w"] else "double" if r[f"{n}__n"] else "string" for n in open_}
    as_long = lambda n: F.when(F.col(n).rlike("^[+-]?0[xX]"), F.conv(F.regexp_replace(n, "^[+-]?0[xX]", ""), 16, 10).cast("long") * F.when(F.col(n).startswith("-"), -1).otherwise(1)).otherwise(F.col(n).cast("long"))
    return good.select(*[(as_long(n) if known[n] == "long" else F.col(n).cast(known[n])).alias(n) for n in names]), dropped


def _without_head(lines: DataFrame, skip: int) -> DataFrame:
    """Lines (value, file, at) without the first ``skip`` of each file, which are in its first block (128 MB or so)."""

    def run(batches):
        seen: dict[str, int] = {}
        for batch in batches:
            keep = []
            for file, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                seen[file] = seen.get(file, 0) + (at == 0)
                keep.append(at != 0 or seen[file] > skip)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["value"])

    return lines.mapInArrow(run, "value string")


def _quoted(v):
    return F.concat(F.lit('"'), F.regexp_replace(v, '"', "'"), F.lit('"'))


def _plain(v):
    return v.cast("string")


def struct_text_lines(df: DataFrame, table: str) -> tuple[str, DataFrame]:
    """``(header, lines)``: the typedef of a table and its data lines, one row each, ready for ``write.text``."""
    names = {v: k for k, v in STRUCT_TYPES.items()} | {"bigint": "long", "smallint": "short", "tinyint": "short"}
    members, parts = [], []
    for c, kind in df.dtypes:
        array = kind.startswith("array<")
        base = kind[6:-1] if array else kind
        size = df.agg(F.max(F.size(c))).first()[0] if array else 0
        members.append(f" {names[base]} {c}{f'[{size}]' if array else ''}{'[256]' if base == 'string' else ''};")
        text = _quoted if base == "string" else _plain
        parts.append(F.concat(F.lit("{"), F.array_join(F.transform(c, text), " "), F.lit("}")) if array else text(F.col(c)))
    header = "typedef struct {\n" + "\n".join(members) + f"\n}} {table.upper()};\n"
    return header, df.select(F.concat_ws(" ", F.lit(table.upper()), *parts).alias("value"))


def write_struct_text(df: DataFrame, path: str, table: str, mode: str = "errorifexists") -> None:
    """A folder of struct text: the typedef in a file of its own, data lines in one file a partition; ``append`` adds files."""
    header, lines = struct_text_lines(df, table)
    lines.write.mode(mode).text(path)
    if mode != "append":
        df.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("append").text(path)


def struct_text_schema(text: str) -> dict[str, list[tuple[str, str, int]]]:
    """Table name -> (column, Spark type, array length or 0) of the typedefs in a struct text file."""
    enums = {name for kind, _, name in _TYPEDEF.findall(text) if kind == "enum"}
    out = {}
    for kind, body, name in _TYPEDEF.findall(text):
        if kind == "struct":
            cols = []
            for t, col, dims in _MEMBER.findall(body):
                sizes = [int(d or 0) for d in re.findall(r"[\[<](\d*)[\]>]", dims)]
                if t == "char" and sizes:
                    sizes.pop()
                cols.append((col, "string" if t in enums else STRUCT_TYPES[t], sizes[0] if sizes else 0))
            out[name.upper()] = cols
    return out


def _tokens(line: str) -> list[str]:
    """Words, quoted strings and braces of one data line."""
    return [q[1:-1] if q.startswith('"') else q for q in re.findall(r'"[^"]*"|[{}]|[^\s{}"]+', line)]


def read_struct_text(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One table of a struct text file: data lines begin with the table's name; ``\\`` joins lines, arrays stand in braces."""
    whole = spark.read.text(path, wholetext=True)
    name = re.escape(table)
    found = whole.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)typedef\s+(?:struct|enum)\s*\{.*?\}\s*\w+\s*;"), F.lit(0))).alias("value"))
    own = [r["value"] for r in found.where(F.col("value").rlike(rf"(?is)^typedef\s+struct.*\}}\s*{name}\s*;$")).distinct().limit(2).collect()]
    if not own:
        raise ValueError(f"no file defines {table}")
    enum = F.regexp_extract("value", r"(?s)^typedef\s+enum.*\}\s*(\w+)\s*;$", 1)
    used = found.select(enum.alias("name"), "value").where(F.col("name").isin(sorted({w for d in own for w in re.findall(r"\w+", d)})))
    enums = [r["value"] for r in used.groupBy("name").agg(F.min("value").alias("value")).collect()]  # no more than the words of the definition
    defined = [struct_text_schema("\n".join([*enums, d]))[table.upper()] for d in own]
    if any(d != defined[0] for d in defined):
        raise ValueError(f"files define {table} differently")
    cols = defined[0]
    schema = ", ".join(f"`{c}` {f'array<{t}>' if n else t}" for c, t, n in cols)
    cast = {"short": int, "int": int, "long": int, "float": float, "double": float, "string": str}

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for text in pdf["value"]:
                for line in re.sub(r"\\\n", " ", _TYPEDEF.sub("", text)).split("\n"):
                    words = _tokens(re.sub(r"#[^\"]*$", "", line))
                    if not words or words[0].upper() != table.upper():
                        continue
                    row, i = [], 1
                    for _, t, n in cols:
                        if n:
                            i += words[i] == "{"
                            row.append([cast[t](w) for w in words[i : i + n]])
                            i += n
                            i += i < len(words) and words[i] == "}"
                        else:
                            row.append(cast[t](words[i]))
                            i += 1
                    rows.append(row)
            yield pd.DataFrame(rows, columns=[c for c, _, _ in cols])

    return whole.mapInPandas(run, schema)


def read_pairs(spark: SparkSession, path: str, tables: list[str]) -> DataFrame:
    """Keyword lines (name, value) of a struct text file: those that begin with no table's name."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$|typedef|\}|[^ ]+;)"))
    word = F.regexp_extract("value", r"^\s*(\S+)", 1)
    return lines.where(~F.upper(word).isin([t.upper() for t in tables]) & ~F.col("value").rlike(r";\s*$")).select(word.alias("name"), F.trim(F.regexp_replace(F.regexp_extract("value", r"^\s*\S+\s*(.*)$", 1), r"#[^\"]*$", "")).alias("value"))


def read_fixed_width(spark: SparkSession, path: str, columns: dict[str, tuple[int, int, str]], null_values: tuple[str, ...] = ("", "\\N", "null")) -> DataFrame:
    """Fixed-width catalogue lines: name -> (first column from 1, length, type); named texts become null."""
    lines = spark.read.text(path)
    field = lambda a, n: F.trim(F.substring("value", a, n))
    return lines.select(*[F.when(~field(a, n).isin(list(null_values)), field(a, n)).try_cast(t).alias(c) for c, (a, n, t) in columns.items()])
