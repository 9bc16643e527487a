"""Table tools: projection, gathering, sorting, merging, column zip, masked assignment, histograms."""

from __future__ import annotations

import operator
import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweft.session import materialize, shuffle_partitions


class MissingColumns(ValueError):
    """Columns that a reader asked for and the table lacks."""


def _unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def require_columns(df: DataFrame, wanted: dict[str, str], optional: Sequence[str] = ()) -> DataFrame:
    """``wanted`` columns cast to the types given; all that are missing are named in one error, optional ones become null."""
    have = {c.lower(): c for c in df.columns}
    missing = [c for c in wanted if c.lower() not in have and c not in optional]
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return df.select(*[(F.col(have[c.lower()]) if c.lower() in have else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()])


def subtable(df: DataFrame, keep: Sequence[str], rename: dict[str, str] | None = None) -> DataFrame:
    return df.select(*[F.col(c).alias((rename or {}).get(c, c)) for c in keep])


def add_columns_from(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Columns of ``other`` that ``df`` lacks; on equal names those of ``df`` stay."""
    new = [c for c in other.columns if c not in df.columns]
    return df.join(other.select(key, *new), key, "left")


def slice_rows(df: DataFrame, row_col: str, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Rows whose number lies in a Python slice of non-negative bounds."""
    lo = start or 0
    out = df.where(F.col(row_col) >= lo)
    if stop is not None:
        out = out.where(F.col(row_col) < stop)
    return out if step == 1 else out.where((F.col(row_col) - lo) % step == 0)


def gather(df: DataFrame, row_col: str, picks: DataFrame, pick_col: str, order_col: str = "position") -> DataFrame:
    """Rows by a list of row numbers: order and repeats of the list are kept in ``order_col``."""
    return picks.select(F.col(order_col), F.col(pick_col).alias(row_col)).join(df, row_col)


def gather_list(df: DataFrame, row_col: str, rows: Sequence[int]) -> DataFrame:
    """The same for a list from the driver."""
    spark = df.sparkSession
    picks = spark.range(1).select(F.posexplode(F.lit(list(rows)).cast("array<long>")).alias("position", "pick"))
    return gather(df, row_col, F.broadcast(picks), "pick")


def assign_where(df: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """Masked assignment: ``values`` where the condition holds, the old ones elsewhere."""
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()})


def assign_rows(df: DataFrame, key: str, updates: DataFrame) -> DataFrame:
    """Rows of ``updates`` replace those of equal key, column by column."""
    cols = [c for c in updates.columns if c != key]
    old = df.select(F.col(key), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("old"))
    out = old.join(updates.select(F.col(key), F.struct(*cols).alias("new")), key, "left")
    return out.select(*[F.when(F.col("new").isNotNull(), F.col("new")[c]).otherwise(F.col("old")[c]).alias(c) if c in cols else F.col("old")[c].alias(c) for c in df.columns])


def column_zip(left: DataFrame, right: DataFrame, row_col: str, suffix: str = "_2") -> DataFrame:
    """Columns of two tables side by side by row number; repeated names get a suffix."""
    names = {c: c + suffix if c in left.columns else c for c in right.columns if c != row_col}
    return left.join(right.select(row_col, *[F.col(c).alias(n) for c, n in names.items()]), row_col)


def sort_table(df: DataFrame, by: str, tie: str, descending: bool = False) -> DataFrame:
    """Global order by a column, ``-name`` or ``descending`` from large to small, equal values by ``tie``."""
    down = descending or by.startswith("-")
    col = F.col(by.lstrip("-"))
    return df.orderBy(col.desc() if down else col.asc(), F.col(tie).asc())


def ranked(df: DataFrame, by: Sequence[Column], keys: Sequence[str] = (), rank_col: str = "rank") -> DataFrame:
    """0-based rank within ``keys`` (which should be given: without, one task ranks all rows)."""
    return df.withColumn(rank_col, F.row_number().over(Window.partitionBy(*keys).orderBy(*by)) - 1)


def head_rows(df: DataFrame, n: int, by: Sequence[Column], keys: Sequence[str]) -> DataFrame:
    """The first ``n`` rows of every extension."""
    place = _unused(df, "place")
    return ranked(df, by, keys, place).where(F.col(place) < n).drop(place)


def merge_tables(tables: Sequence[DataFrame], how: str | Sequence[str] = "strict") -> DataFrame:
    """Rows of all tables one after another.

    ``strict``: equal column sets; ``minimal``: the columns all have; ``fillzero``: all columns, zero (or
    empty) in rows of tables that lack them; a list: these columns, which all have to have.
    """
    first = tables[0].columns
    if how == "strict":
        for t in tables[1:]:
            if set(t.columns) != set(first):
                raise MissingColumns(f"column sets differ: {sorted(set(t.columns) ^ set(first))}")
        cols = first
    elif how == "minimal":
        cols = [c for c in first if all(c in t.columns for t in tables)]
    elif how == "fillzero":
        types = {f.name: f.dataType for t in reversed(tables) for f in t.schema.fields}
        cols = list(dict.fromkeys(c for t in tables for c in t.columns))
        zero = lambda c: F.lit("" if types[c].simpleString() == "string" else 0).cast(types[c])
        tables = [t.select(*[F.col(c) if c in t.columns else zero(c).alias(c) for c in cols]) for t in tables]
    else:
        cols = list(how)
        for t in tables:
            if missing := [c for c in cols if c not in t.columns]:
                raise MissingColumns(f"missing columns: {', '.join(missing)}")
    out = tables[0].select(*cols)
    for t in tables[1:]:
        out = out.unionByName(t.select(*cols))
    return out


def bin_of(value: str, low: float, size: float, bins: int, policy: str = "clamp") -> str:
    """Bin number as SQL text; ``clamp`` puts outliers in the first and last bin, ``discard`` gives null.

    Bins are closed below and open above, so a value below the low edge is an outlier however near it is.
    """
    raw = f"cast(floor(({value} - {float(low)!r}) / {float(size)!r}) as bigint)"
    if policy == "clamp":
        return f"greatest(0, least({bins - 1}, {raw}))"
    return f"CASE WHEN {raw} >= 0 AND {raw} < {bins} THEN {raw} END"


def histogram(df: DataFrame, value: str, low: float, size: float, bins: int, policy: str = "clamp") -> DataFrame:
    """``(bin, n)`` of the bins that have rows."""
    return df.where(F.col(value).isNotNull()).groupBy(F.expr(bin_of(value, low, size, bins, policy)).alias("bin")).agg(F.count(F.lit(1)).alias("n")).where("bin IS NOT NULL")


def histogram_size(low: float, high: float, bins: int) -> float:
    """Bin size of a histogram given by its number of bins: the last edge is the start of the last bin."""
    return (high - low) / (bins - 1)


def histogram_mean(hist: DataFrame, low: float, size: float) -> DataFrame:
    """Mean by left bin edges."""
    return hist.agg((F.sum(F.col("n") * F.col("bin") * size) / F.sum("n") + low).alias("mean"))


def histogram2d(df: DataFrame, x: str, y: str, x_axis: tuple[float, float, int], y_axis: tuple[float, float, int], policy: tuple[str, str] = ("clamp", "clamp")) -> DataFrame:
    """``(bx, by, n)``; each axis is (low, size, bins) with its own policy."""
    out = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.expr(bin_of(x, *x_axis, policy[0])).alias("bx"), F.expr(bin_of(y, *y_axis, policy[1])).alias("by"))
    return out.agg(F.count(F.lit(1)).alias("n")).where("bx IS NOT NULL AND by IS NOT NULL")


def header_rows(df: DataFrame) -> DataFrame:
    """A table's structure as rows (position, name, type, nullable)."""
    fields = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(fields, "position int, name string, type string, nullable boolean")


def filter_header(header: DataFrame, pattern: str, name_col: str = "name") -> DataFrame:
    re.compile(pattern)
    return header.where(F.col(name_col).rlike(pattern))


def flag_columns(df: DataFrame, flags: str, names: Sequence[str]) -> DataFrame:
    """One boolean column per bit of a bit field, lowest first."""
    return df.withColumns({n: F.getbit(F.col(flags).cast("long"), F.lit(i)) == 1 for i, n in enumerate(names)})


def edit_header(header: DataFrame, updates: dict[str, str | None], name_col: str = "name", value_col: str = "value") -> DataFrame:
    """Header rows with new values for the keywords named; None removes one, keywords not there yet are added."""
    upper = F.upper(F.col(name_col))
    gone = [k.upper() for k, v in updates.items() if v is None]
    new = {k.upper(): v for k, v in updates.items() if v is not None}
    kept = header.where(~upper.isin([*gone, *new]))
    if not new:
        return kept
    added = header.sparkSession.range(1).select(F.explode(F.create_map(*[F.lit(x) for kv in new.items() for x in kv])).alias(name_col, value_col))
    return kept.unionByName(added, allowMissingColumns=True)


def read_as(df: DataFrame, rename: dict[str, str] | None = None, lower: bool = True, columns: Sequence[str] | None = None, rows: tuple[str, Sequence[int]] | None = None) -> DataFrame:
    """A table under other names: lower-case ones if asked for, then ``rename``, some columns only, the rows numbered in a list."""
    names = {c: (rename or {}).get(c.lower() if lower else c, c.lower() if lower else c) for c in df.columns}
    out = df.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    if rows is not None:
        out = gather_list(out, rows[0], rows[1])
    return out.select(*(["position"] if rows is not None else []), *columns) if columns else out


def gather_arrays(df: DataFrame, row_col: str, picks: DataFrame, pick_col: str, array_col: str, size: int) -> DataFrame:
    """Array entries of the rows of a list, entry by entry: (position, 0, 1, .. size - 1 as columns)."""
    got = gather(df.select(row_col, array_col), row_col, picks, pick_col)
    return got.select("position", *[F.get(F.col(array_col), F.lit(i)).alias(f"v{i}") for i in range(size)])


def with_constants(tables: Sequence[DataFrame], constants: Sequence[str], how: str | Sequence[str] = "minimal") -> DataFrame:
    """Merged tables whose ``constants`` (one value a table) all take the first table's value."""
    out = merge_tables(tables, how)
    if not constants:
        return out
    first = tables[0].agg(*[F.first(c, ignorenulls=True).alias(c) for c in constants]).first()
    types = dict(out.dtypes)
    return out.withColumns({c: F.lit(first[c]).cast(types[c]) for c in constants})


def sweep_order(stars: DataFrame, sweep: str, value: str, tie: str) -> DataFrame:
    """Global order of a thinned catalogue: sweep by sweep, within one by value, then by ``tie``."""
    return stars.orderBy(sweep, value, tie)


_QUOTED = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`")


def filter_rows(df: DataFrame, expression: str) -> DataFrame:
    """Rows for which an expression over the columns holds (C-style ``&&``, ``||``, ``!``, ``==`` are read as SQL, but not inside of quotes)."""
    sql, at = [], 0
    for m in [*_QUOTED.finditer(expression), None]:
        plain = expression[at : m.start() if m else len(expression)]
        sql.append(re.sub(r"!(?!=)", " NOT ", plain.replace("&&", " AND ").replace("||", " OR ").replace("==", "=")))
        if m:
            sql.append(m[0])
            at = m.end()
    return df.where("".join(sql))


def column_statistics(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Count, minimum, maximum, mean and spread of columns, in long form (keys, column, ...)."""
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("e"))
    return long.groupBy(*keys, F.col("e.column").alias("column")).agg(F.count("e.v").alias("n"), F.min("e.v").alias("low"), F.max("e.v").alias("high"), F.avg("e.v").alias("mean"), F.stddev_pop("e.v").alias("spread"))


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, share: str) -> DataFrame:
    """``(keys, quantile)``: exact quantiles of ``value`` in each group, between two values by a straight line; ``share`` is a column, the same in a group.

    Distinct values with their counts are dealt by ranges, so that no task reads a whole group; sums per part tell in which part the
    wanted ranks lie, and only those parts are numbered. Nulls take no part, NaN comes last; a group without values has a null.
    """
    v = df.select(*keys, F.col(share).cast("double").alias("__share"), F.col(value).cast("double").alias("__v"))
    counts = v.groupBy(*keys, "__v").agg(F.max("__share").alias("__share"), F.count(F.lit(1)).alias("__n"))
    counts = materialize(counts.repartitionByRange(shuffle_partitions(df.sparkSession), *keys, "__v").withColumn("__part", F.spark_partition_id()), "quantile-counts")
    held = counts.where("__v IS NOT NULL")
    parts = held.groupBy(*keys, "__part").agg(F.sum("__n").alias("__rows"), F.max("__share").alias("__share"))
    every, upto = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumns({"__at": (F.sum("__rows").over(every) - 1) * F.col("__share"), "__before": F.sum("__rows").over(upto) - F.col("__rows")})
    parts = parts.where("__before <= ceil(__at) AND __before + __rows > floor(__at)").select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), "__at", "__before")
    same = reduce(operator.and_, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col("__part") == F.col("__p"))
    upto = Window.partitionBy(*keys, "__part").orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = held.join(parts, same).withColumn("__end", F.col("__before") + F.sum("__n").over(upto))
    at = lambda f: F.max(F.when((f("__at") < F.col("__end")) & (f("__at") >= F.col("__end") - F.col("__n")), F.col("__v")))
    ends = ranked.groupBy(*keys).agg(at(F.floor).alias("__low"), at(F.ceil).alias("__high"), F.max("__at").alias("__at"))
    between = (F.ceil("__at") - F.col("__at")) * F.col("__low") + (F.col("__at") - F.floor("__at")) * F.col("__high")
    found = ends.select(*keys, F.when(F.col("__low") == F.col("__high"), F.col("__low")).otherwise(between).alias("quantile"))
    none = counts.groupBy(*keys).agg(F.count("__v").alias("__n")).where("__n = 0").select(*keys, F.lit(None).cast("double").alias("quantile"))
    return found.unionByName(none)
