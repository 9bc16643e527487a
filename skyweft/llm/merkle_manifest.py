"""Merkle manifest of a dataset: a hash tree per group of rows, one over the groups, a proof per row.

Every row is a leaf. Leaves of a tree stand in order and every FAN consecutive nodes become the digest of
their concatenated hexadecimal texts, until one is left. Leaves are dealt into buckets of BUCKET places,
aligned with the tree, so that a bucket is a subtree of its own. A DuckDB connection in each worker runs
the level queries of one bucket (an ordered ``string_agg`` by run, then ``sha256``) on the Arrow table
that Spark hands over. Spark ranks the leaves, combines the roots of buckets level by level, makes the
tree over the groups the same way, and hands each bucket the path from its root to the top, with which
the second pass of level queries ends every row's proof.

Leaves are ranked by a range partitioning with their number as the last key, so a group that holds a third
of all rows, or one row that repeats as often, is still dealt to many tasks; places follow from counts by
partition. No bucket has more than BUCKET leaves, no run more than FAN nodes.

Defined cases: null fields are '-'; a null group is a tree of its own that comes first, a null id comes
first in its tree. Rows of equal id stand by their leaves. A tree of one leaf has it as root and adds no
sibling. An empty table gives no row. Further columns are ignored.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweft.session import discard, materialize

FAN = 16
#: Places of a bucket; a power of FAN.
BUCKET_LEVELS = 3
BUCKET = FAN**BUCKET_LEVELS
HEX = 64
PATH = "array<struct<run: string, place: int>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DOCUMENT_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field_text(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*[field_text(c) for c in fields]), 256)


def tree_key(c: Column) -> Column:
    """A group's name with nulls told apart and first in the order of bytes."""
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), c.cast("string")))


def _ranked(rows: DataFrame, order: list[str], label: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``pos``, ``bucket`` and the tree's number of leaves ``n``; and the written table behind them."""
    keys = ["tree", *order, "salt"]
    dealt = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    table = materialize(dealt.drop("salt").withColumn("at", F.monotonically_increasing_id()), label)
    part = F.shiftright("at", 33)  # the number of the partition
    spans = table.groupBy("tree", part.alias("part")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here"))
    tree = Window.partitionBy("tree")  # a row a partition
    spans = spans.select("tree", "part", (F.sum("here").over(tree.orderBy("part")) - F.col("here") - F.col("first")).alias("shift"), F.sum("here").over(tree).alias("n"))
    placed = table.withColumn("part", part).join(spans, ["tree", "part"]).withColumn("pos", F.col("at") + F.col("shift"))
    return placed.withColumn("bucket", F.expr(f"pos div {BUCKET}")).drop("part", "at", "shift"), table


# ---- level queries in the executors

_CONNECTION: list = []


def _duckdb():
    """One in-memory connection a worker, on one thread."""
    if not _CONNECTION:
        import duckdb

        _CONNECTION.append(duckdb.connect(":memory:", config={"threads": 1}))
    return _CONNECTION[0]


def _levels(n: int) -> int:
    """Levels of a bucket's subtree in a tree of ``n`` leaves."""
    k = 0
    while k < BUCKET_LEVELS and FAN**k < n:
        k += 1
    return k


def _runs(con, leaves: pa.Table) -> int:
    """Tables run1, run2, ..: the members of each run of a level, one after the other; node0, node1, ..: the digests."""
    con.register("leaves", leaves)
    con.execute("CREATE OR REPLACE TEMP TABLE node0 AS SELECT pos, leaf AS h FROM leaves").fetchall()
    levels = _levels(leaves["n"][0].as_py())
    for k in range(1, levels + 1):
        con.execute(f"CREATE OR REPLACE TEMP TABLE run{k} AS SELECT pos // {FAN} AS pos, string_agg(h, '' ORDER BY pos) AS run FROM node{k - 1} GROUP BY pos // {FAN}").fetchall()
        con.execute(f"CREATE OR REPLACE TEMP TABLE node{k} AS SELECT pos, sha256(run) AS h FROM run{k}").fetchall()
    return levels


def _bucket_root(leaves: pa.Table) -> pa.Table:
    con = _duckdb()
    root = con.execute(f"SELECT h FROM node{_runs(con, leaves)}").fetchall()[0][0]
    first = {c: leaves[c][0].as_py() for c in ("tree", "bucket", "n")}
    return pa.table({"tree": [first["tree"]], "pos": [first["bucket"]], "h": [root], "n": [-(-first["n"] // BUCKET)]})


def _steps(levels: int, fold: bool) -> str:
    """A query that walks every leaf up the levels of its bucket: its place, the siblings' digests, the folded digest or the path."""
    sql = "SELECT *, pos AS place, '' AS proof, coalesce(altered, leaf) AS fold FROM leaves" if fold else "SELECT *, pos AS place, [] :: STRUCT(run VARCHAR, place INTEGER)[] AS path FROM leaves"
    for k in range(1, levels + 1):
        if fold:
            sql = f"SELECT w.* EXCLUDE (place, proof, fold), place // {FAN} AS place, proof || {_others('run', f'place % {FAN}')} AS proof, {_folded('run', f'place % {FAN}')} AS fold FROM ({sql}) w JOIN run{k} r ON w.place // {FAN} = r.pos"
        else:
            sql = f"SELECT w.* EXCLUDE (place, path), place // {FAN} AS place, list_append(path, {{'run': run, 'place': CAST(place % {FAN} AS INTEGER)}}) AS path FROM ({sql}) w JOIN run{k} r ON w.place // {FAN} = r.pos"
    return sql


def _others(run: str, place: str) -> str:
    return f"substr({run}, 1, {HEX} * ({place})) || substr({run}, {HEX} * ({place}) + {HEX + 1})"


def _folded(run: str, place: str) -> str:
    return f"sha256(substr({run}, 1, {HEX} * ({place})) || fold || substr({run}, {HEX} * ({place}) + {HEX + 1}))"


def _leaf_digests(leaves: pa.Table, above: pa.Table) -> pa.Table:
    con = _duckdb()
    sql = _steps(_runs(con, leaves), True)
    top = above.to_pylist()[0]
    params = []
    for step in top["path"]:  # the same for all leaves of the bucket
        sql = f"SELECT * EXCLUDE (proof, fold), proof || CAST(? AS VARCHAR) AS proof, sha256(CAST(? AS VARCHAR) || fold || CAST(? AS VARCHAR)) AS fold FROM ({sql})"
        before, after = step["run"][: HEX * step["place"]], step["run"][HEX * (step["place"] + 1) :]
        params = [before + after, before, after, *params]
    sql = f"SELECT id, leaf, CAST(? AS VARCHAR) AS subroot, CAST(? AS VARCHAR) AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = CAST(? AS VARCHAR) AS verified FROM ({sql})"
    return _arrow(con.execute(sql, [top["subroot"], top["root"], top["root"], *params]))


def _leaf_paths(leaves: pa.Table, above: pa.Table) -> pa.Table:
    con = _duckdb()
    top = above.to_pylist()[0]
    found = con.execute(f"SELECT id, leaf, path FROM ({_steps(_runs(con, leaves), False)})").fetchall()
    path = pa.list_(pa.struct([("run", pa.string()), ("place", pa.int32())]))
    ids, hashes, paths = (list(c) for c in zip(*found, strict=True))
    return pa.table({"id": pa.array(ids, leaves["id"].type), "leaf": pa.array(hashes, pa.string()), "subroot": [top["subroot"]] * len(ids), "root": [top["root"]] * len(ids), "path": pa.array([[*p, *top["path"]] for p in paths], path)})


def _arrow(result) -> pa.Table:
    t = result.to_arrow_table() if hasattr(result, "to_arrow_table") else result.fetch_arrow_table()
    return t.cast(pa.schema([pa.field(f.name, pa.string() if pa.types.is_large_string(f.type) else f.type) for f in t.schema]))


# ---- levels above the buckets


def _bucket_roots(ranked: DataFrame, label: str) -> DataFrame:
    found = ranked.select("tree", "bucket", "pos", "leaf", "n").groupBy("tree", "bucket").applyInArrow(_bucket_root, "tree string, pos long, h string, n long")
    return materialize(found, label)


def _up(nodes: DataFrame) -> list[tuple[DataFrame, DataFrame | None]]:
    """Level by level ``(nodes, runs they form)``; the nodes of a level with n = 1 are roots."""
    most = nodes.agg(F.max("n").alias("n")).first()["n"] or 1
    levels = []
    while most > 1:
        runs = nodes.where("n > 1").groupBy("tree", F.expr(f"pos div {FAN}").alias("up"), "n").agg(F.sort_array(F.collect_list(F.struct("pos", "h"))).alias("m"))
        runs = runs.select("tree", "up", F.array_join(F.col("m.h"), "").alias("run"), F.ceil(F.col("n") / FAN).alias("n"))
        levels.append((nodes, runs))
        nodes, most = runs.select("tree", F.col("up").alias("pos"), F.sha2("run", 256).alias("h"), "n"), -(-most // FAN)
    return [*levels, (nodes, None)]


def _roots(levels: list) -> DataFrame:
    out = None
    for nodes, _ in levels:
        here = nodes.where("n = 1").select("tree", F.col("h").alias("subroot"))
        out = here if out is None else out.unionByName(here)
    return out


def _down(levels: list, tops: DataFrame) -> DataFrame:
    """``(tree, bucket, path, subroot, root)`` of every bucket: its path within the tree, then the path of the tree's root in ``tops``."""
    below = None
    for nodes, runs in reversed(levels):
        here = nodes.where("n = 1").select("tree", "pos").join(tops, "tree")
        if runs is not None:
            parents = runs.select("tree", "up", "run").join(below.withColumnRenamed("pos", "up"), ["tree", "up"])
            inner = nodes.where("n > 1").select("tree", "pos", F.expr(f"pos div {FAN}").alias("up")).join(parents, ["tree", "up"])
            step = F.array(F.struct(F.col("run"), F.expr(f"CAST(pos % {FAN} AS int)").alias("place")))
            here = here.unionByName(inner.select("tree", "pos", F.concat(step, "path").alias("path"), "subroot", "root"))
        below = here
    return below.withColumnRenamed("pos", "bucket")


def _with_paths(leaves: DataFrame, label: str) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The one tree over all of ``leaves`` (id, leaf): ``(id, leaf, subroot, root, path)``."""
    ranked, table = _ranked(leaves.withColumn("tree", F.lit("")), ["id", "leaf"], f"{label}-leaves")
    buckets = _bucket_roots(ranked, f"{label}-buckets")
    levels = _up(buckets)
    tops = _roots(levels).withColumn("root", F.col("subroot")).withColumn("path", F.expr(f"CAST(array() AS {PATH})"))
    kind = dict(leaves.dtypes)["id"]
    found = _both(ranked, _down(levels, tops), ["id", "leaf"], _leaf_paths, f"id {kind}, leaf string, subroot string, root string, path {PATH}")
    return found, table, buckets


def _both(ranked: DataFrame, above: DataFrame, columns: list[str], run, schema: str) -> DataFrame:
    left = ranked.select("tree", "bucket", "pos", "n", *columns).groupBy("tree", "bucket")
    return left.cogroup(above.select("tree", "bucket", "path", "subroot", "root").groupBy("tree", "bucket")).applyInArrow(run, schema)


def tree_manifest(leaves: DataFrame) -> DataFrame:
    """``(id, leaf, subroot, root, proof_sha256, folded_root, verified)`` for rows ``(tree, id, leaf, altered)``.

    ``tree`` names the group and is no null (see :func:`tree_key`); leaves of a tree stand by id. ``altered``
    is the leaf that a receiver works out from the row it holds, null where that is the same: the root is
    folded from it and the siblings of the original.
    """
    ranked, _ = _ranked(leaves, ["id", "leaf"], "merkle-leaves")
    buckets = _bucket_roots(ranked, "merkle-buckets")
    levels = _up(buckets)
    groups, groups_table, groups_buckets = _with_paths(_roots(levels).select(F.col("tree").alias("id"), F.col("subroot").alias("leaf")), "merkle-groups")
    tops = groups.select(F.col("id").alias("tree"), F.col("leaf").alias("subroot"), "root", "path")
    above = materialize(_down(levels, tops), "merkle-above")
    for done in (buckets, groups_table, groups_buckets):
        discard(done)
    kind = dict(leaves.dtypes)["id"]
    return _both(ranked, above, ["id", "leaf", "altered"], _leaf_digests, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def tree_proofs(leaves: DataFrame) -> DataFrame:
    """``(tree, root, subroot, id, leaf, path)`` for rows ``(tree, id, leaf)``: the whole proofs, as runs and the place in each."""
    ranked, _ = _ranked(leaves, ["id", "leaf"], "merkle-leaves")
    buckets = _bucket_roots(ranked, "merkle-buckets")
    levels = _up(buckets)
    groups, _, _ = _with_paths(_roots(levels).select(F.col("tree").alias("id"), F.col("subroot").alias("leaf")), "merkle-groups")
    tops = groups.select(F.col("id").alias("tree"), F.col("leaf").alias("subroot"), "root", "path")
    kind = dict(leaves.dtypes)["id"]
    return _both(ranked, _down(levels, tops), ["id", "leaf"], _leaf_paths, f"id {kind}, leaf string, subroot string, root string, path {PATH}")


def folded_root(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` and a proof of :func:`tree_proofs` lead to."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(p["run"].substr(F.lit(1), HEX * p["place"]), h, p["run"].substr(HEX * (p["place"] + 1) + 1, F.lit(FAN * HEX))), 256))


def document_leaves(docs: DataFrame, tamper_every: int | None = None) -> DataFrame:
    """Leaves of a table of documents: a tree per source. Of every ``tamper_every``-th id (by its checksum) the text is lower-cased for ``altered``."""
    fields = [F.col(c) for c in DOCUMENT_FIELDS]
    altered = F.lit(None).cast("string")
    if tamper_every:
        chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % tamper_every == 0
        altered = F.when(chosen, leaf_digest(*fields[:-1], F.translate("text", UPPER, LOWER)))
    return docs.select(tree_key(F.col("source")).alias("tree"), F.col("doc_id").cast("long").alias("id"), leaf_digest(*fields).alias("leaf"), altered.alias("altered"))


def document_manifest(docs: DataFrame, tamper_every: int | None = 5) -> DataFrame:
    """The manifest of a table of documents, with every row checked against it: see :func:`tree_manifest`."""
    leaves = materialize(document_leaves(docs, tamper_every), "merkle-digests")  # texts are read once and go no further
    return tree_manifest(leaves).withColumnRenamed("id", "doc_id")


def manifest_sql(table: str, levels: int = 5, group_levels: int = 3, tamper_every: int = 5) -> str:
    """The same result in DuckDB, for trees of up to FAN ** levels leaves and FAN ** group_levels groups."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END"
    digest = lambda text: "sha256(" + " || ".join([*(part(c) for c in DOCUMENT_FIELDS[:-1]), part(text)]) + ")"
    bits = "list_reduce(list_prepend({}, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    bytes_ = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda a, b: {bits.format('xor(a, b)')}), 4294967295)"
    sql = f"""
WITH leafed AS (
  SELECT coalesce('=' || source, '-') AS tree, doc_id, {digest('text')} AS leaf,
    CASE WHEN {crc} % {tamper_every} = 0 THEN {digest(f"translate(text, '{UPPER}', '{LOWER}')")} END AS altered FROM {table}
), w0 AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n,
    '' AS proof, coalesce(altered, leaf) AS fold FROM leafed
), a0 AS (SELECT tree, place AS pos, leaf AS h, n FROM w0)"""

    def level(k, name, rows, into):
        return f""", {name}r{k} AS (
  SELECT tree, pos // {FAN} AS pos, string_agg(h, '' ORDER BY pos) AS run, (n + {FAN - 1}) // {FAN} AS n FROM {name}{k - 1} WHERE n > 1 GROUP BY tree, pos // {FAN}, n
), {name}{k} AS (
  SELECT tree, pos, sha256(run) AS h, n FROM {name}r{k} UNION ALL SELECT tree, pos, h, n FROM {name}{k - 1} WHERE n = 1
), {into} AS (
  SELECT w.* EXCLUDE (place, proof, fold), CASE WHEN run IS NULL THEN place ELSE place // {FAN} END AS place,
    CASE WHEN run IS NULL THEN proof ELSE proof || {_others('run', f'place % {FAN}')} END AS proof,
    CASE WHEN run IS NULL THEN fold ELSE {_folded('run', f'place % {FAN}')} END AS fold
  FROM {rows} w LEFT JOIN {name}r{k} r ON {'w.tree = r.tree AND ' if name == 'a' else ''}w.place // {FAN} = r.pos)"""

    for k in range(1, levels + 1):
        sql += level(k, "a", f"w{k - 1}", f"w{k}")
    sql += f""", b0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, h, count(*) OVER () AS n, tree AS name FROM a{levels}),
v0 AS (SELECT w.* EXCLUDE (place), b0.pos AS place, b0.h AS subroot FROM w{levels} w JOIN b0 ON w.tree = b0.name)"""
    for k in range(1, group_levels + 1):
        sql += level(k, "b", f"v{k - 1}", f"v{k}")
    return sql + f"""
SELECT doc_id, leaf, subroot, b{group_levels}.h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = b{group_levels}.h AS verified
FROM v{group_levels}, b{group_levels}
"""
