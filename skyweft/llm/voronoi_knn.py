"""Exact top-k search by inner product: a k-nearest-neighbour join over Voronoi cells.

Components become floor(scale * x); a score is the integer inner product of two such vectors. One more
component, sqrt(M^2 - |v|^2) for data and 0 for queries, where M is the greatest length, turns the greatest
score into the least distance: |q - v|^2 = |q|^2 + M^2 - 2 * score.

Data and queries are assigned to their nearest pivots. Summaries of the cells are the distances of the k + 1
data rows nearest to each pivot and, for each cell of queries, their number and greatest distance to the
pivot. They bound the distance of the k-th neighbour of all queries of a cell: the triangle over both pivots
gives k + 1 rows no further than that (one of them may be the query itself). A data row is sent to a cell of
queries only where no bound excludes it: the triangle over the cell's pivot, and the plane midway between that
pivot and the row's own. Cells are packed into classes of about GROUP queries; a class of more is split in
parts, the data sent to a class in slices of about GROUP rows, and each (class, part, slice) is solved by itself
with exact arithmetic. A window then ranks what the slices found. What the driver holds is bounded: MOST_PIVOTS
pivots and k + 1 distances each; pivots are a sample and change only how much is sent.

Defined cases: vectors that are null, or hold a null or non-finite component, take no part, nor do those whose
squared length after scaling is 2**62 or more. Missing components of shorter vectors count as 0. A row with a
null id is no query and ranks last among equal scores. Rows that share an id are rows of their own: each is a
candidate for the other, and each a query. With fewer than k candidates all are returned. Further columns are
ignored, an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyweft.session import discard, materialize

K, SCALE, EVERY = 20, 64, 20
#: Bounds of the pivots' number, of their components together, and of the distances kept for them.
MOST_PIVOTS, MOST_COMPONENTS, MOST_DISTANCES = 512, 1 << 21, 1 << 18
#: Queries of a part and data rows of a slice, for vectors of up to GROUP_COMPONENTS / GROUP components.
GROUP, GROUP_COMPONENTS = 8192, 1 << 22
#: Queries scored at a time in a task, and entries of the tables that deal rows out.
BLOCK, DEALT = 512, 1 << 18
LONGEST = 2.0**62
#: Rounding errors of a distance, as a part of the greatest length.
SLACK = 1e-5


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int, queries: Column | None) -> DataFrame:
    """``(row, vec_id, e, norm2, query)``: scaled vectors that take part, numbered."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.withColumn("__query", F.lit(False) if queries is None else F.coalesce(queries, F.lit(False)))
    rows = rows.where(F.col(vector_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).alias("e"), F.col("__query").alias("query"))
    rows = rows.where(F.aggregate("e", F.lit(0.0), lambda a, x: a + x.cast("double") * x) < LONGEST)
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "e", F.aggregate("e", F.lit(0).cast("long"), lambda a, x: a + x * x).alias("norm2"), "query")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of whole numbers as rows of one matrix, short ones filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths, values = pc.list_value_length(column).to_numpy(zero_copy_only=False), column.flatten().to_numpy(zero_copy_only=False)
    if len(values) == dim * len(lengths):
        return values.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim), np.int64)
    out[np.arange(dim) < lengths[:, None]] = values
    return out


class Pivots:
    """Distances to the pivots in the space with one more component."""

    def __init__(self, points: np.ndarray, m2: int):
        self.points, self.m2, self.dim = np.unique(points, axis=0).astype(np.float64), float(m2), points.shape[1]
        self.height = np.sqrt(np.maximum(m2 - (self.points**2).sum(1), 0))
        self.apart = np.sqrt(np.maximum(self.data2(self.points, (self.points**2).sum(1)), 0))
        self.slack = SLACK * np.sqrt(self.m2)

    def data2(self, x: np.ndarray, norm2: np.ndarray) -> np.ndarray:
        height = np.sqrt(np.maximum(self.m2 - norm2, 0))
        return np.maximum(2 * self.m2 - 2 * (x @ self.points.T) - 2 * np.outer(height, self.height), 0)

    def query2(self, x: np.ndarray, norm2: np.ndarray) -> np.ndarray:
        return np.maximum(norm2[:, None] + self.m2 - 2 * (x @ self.points.T), 0)


def _assign(pivots: Pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, norm2 = _matrix(batch["e"], pivots.dim).astype(np.float64), batch["norm2"].to_numpy().astype(np.float64)
            d2, q2 = pivots.data2(x, norm2), pivots.query2(x, norm2)
            at, query = np.arange(batch.num_rows), batch["query"].to_numpy(zero_copy_only=False)
            cell, qcell = d2.argmin(1), q2.argmin(1)
            made = [pa.array(cell, pa.int32()), pa.array(np.sqrt(d2[at, cell])), pa.array(qcell, pa.int32(), mask=~query), pa.array(np.sqrt(q2[at, qcell]), mask=~query)]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("row", "vec_id", "e", "norm2")), *made], names=["row", "vec_id", "e", "norm2", "cell", "dist", "qcell", "qdist"])

    return run


class Plan:
    """Bounds of the cells of queries, and the classes they are packed into."""

    def __init__(self, pivots: Pivots, k: int, nearest: list[tuple[int, float]], cells: list[tuple[int, int, float]], group: int):
        self.pivots, self.group = pivots, group
        of = np.array([c for c, _ in nearest], np.int64)
        near = np.array([d for _, d in nearest])
        self.cells = np.array([c for c, _, _ in cells], np.int64)
        self.reach = np.array([r for _, _, r in cells])
        self.bound = np.full(len(cells), np.inf)
        if len(near) > k:
            for i, (c, r) in enumerate(zip(self.cells, self.reach, strict=True)):
                self.bound[i] = np.partition(r + pivots.apart[c, of] + near, k)[k]
        counts = {c: n for c, n, _ in cells}
        self.class_of, self.queries = self._pack(counts), []
        for i, c in enumerate(self.cells):
            if self.class_of[i] == len(self.queries):
                self.queries.append(0)
            self.queries[self.class_of[i]] += counts[c]
        self.parts = np.array([-(-n // group) for n in self.queries], np.int64)
        self.slices = np.ones(len(self.parts), np.int64)

    def _pack(self, counts: dict[int, int]) -> np.ndarray:
        """Cells in a chain of near pivots, cut into classes; they are kept in that order."""
        left, chain = set(range(len(self.cells))), []
        while left:
            nxt = min(left, key=lambda i: (self.pivots.apart[self.cells[chain[-1]], self.cells[i]], i)) if chain else min(left)
            chain.append(nxt)
            left.remove(nxt)
        self.cells, self.reach, self.bound = self.cells[chain], self.reach[chain], self.bound[chain]
        out, number, held = [], 0, 0
        for c in self.cells:
            if held and held + counts[c] > self.group:
                number, held = number + 1, 0
            held += counts[c]
            out.append(number)
        return np.array(out, np.int64)

    def needed(self, x: np.ndarray, norm2: np.ndarray) -> np.ndarray:
        """For each data row and class, whether some query of the class may have the row among its k best."""
        d2 = self.pivots.data2(x, norm2)
        own = d2.argmin(1)
        to_cells = d2[:, self.cells]
        apart = self.pivots.apart[own][:, self.cells]
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 0, (to_cells - d2[np.arange(len(x)), own][:, None]) / (2 * apart), 0)
        far = np.maximum(np.sqrt(to_cells) - self.reach, plane)
        fits = far <= self.bound + self.pivots.slack
        return np.logical_or.reduceat(fits, np.flatnonzero(np.diff(self.class_of, prepend=-1)), axis=1)


def _spread(row: np.ndarray, among: np.ndarray | int) -> np.ndarray:
    """An even and repeatable share of 0 .. among - 1 for each row number."""
    return ((row & ((1 << 33) - 1)) + (row >> 33) * 7919) % among


def _counts(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(plan.parts), np.int64)
        for batch in batches:
            total += plan.needed(_matrix(batch["e"], plan.pivots.dim).astype(np.float64), batch["norm2"].to_numpy().astype(np.float64)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["class", "sent"])

    return run


def _deal_data(plan: Plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, DEALT // max(1, int(plan.parts.sum())))
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                b = batch.slice(lo, rows)
                at, cls = np.nonzero(plan.needed(_matrix(b["e"], plan.pivots.dim).astype(np.float64), b["norm2"].to_numpy().astype(np.float64)))
                times = plan.parts[cls]
                part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                at, cls = np.repeat(at, times), np.repeat(cls, times)
                yield _dealt(b, at, cls, part, _spread(b["row"].to_numpy()[at], plan.slices[cls]))

    return run


def _deal_queries(plan: Plan):
    lookup = np.full(len(plan.pivots.points), -1, np.int64)
    lookup[plan.cells] = plan.class_of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(1, DEALT // int(plan.slices.max()))
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                b = batch.slice(lo, rows)
                cls = lookup[b["qcell"].to_numpy()]
                part, times = _spread(b["row"].to_numpy(), plan.parts[cls]), plan.slices[cls]
                piece = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                yield _dealt(b, np.repeat(np.arange(b.num_rows), times), np.repeat(cls, times), np.repeat(part, times), piece)

    return run


def _dealt(batch: pa.RecordBatch, at, cls, part, piece) -> pa.RecordBatch:
    taken = [batch[c].take(pa.array(at)) for c in ("row", "vec_id", "e")]
    return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (cls, part, piece)), *taken], names=["class", "part", "slice", "row", "vec_id", "e"])


def _solver(dim: int, m2: int, k: int):
    kind = np.float32 if m2 < 1 << 24 else np.float64 if m2 < 1 << 53 else np.int64  # all sums are exact
    least = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
    names, kinds = ["row", "query_id", "vec_id", "score"], [pa.int64()] * 4

    def best(queries: pa.Table, data: pa.Table) -> pa.Table:
        if not queries.num_rows or not data.num_rows:
            return pa.table([pa.array([], t) for t in kinds], names=names)
        data = data.take(pc.sort_indices(data, sort_keys=[("vec_id", "ascending")], null_placement="at_end"))
        y, rows = _matrix(data["e"], dim).astype(kind), data["row"].to_numpy()
        order = np.argsort(rows)
        found = []
        for lo in range(0, queries.num_rows, BLOCK):
            part = queries.slice(lo, BLOCK)
            scores = _matrix(part["e"], dim).astype(kind) @ y.T
            mine = part["row"].to_numpy()
            own = order[np.minimum(np.searchsorted(rows, mine, sorter=order), len(rows) - 1)]
            hit = np.flatnonzero(rows[own] == mine)
            scores[hit, own[hit]] = least
            cut = np.partition(scores, -k, axis=1)[:, -k] if k < len(rows) else np.full(len(scores), least)
            q, d = np.nonzero((scores >= cut[:, None]) & (scores > least))
            s = scores[q, d].astype(np.int64)
            by = np.lexsort((d, -s, q))
            q, d, s = q[by], d[by], s[by]
            keep = np.arange(len(q)) - np.searchsorted(q, q) < k
            found.append((mine[q[keep]], pc.take(part["vec_id"], pa.array(q[keep])), pc.take(data["vec_id"], pa.array(d[keep])), s[keep]))
        return pa.concat_tables([pa.table([pa.array(a), b, c, pa.array(s)], names=names) for a, b, c, s in found])

    return best


def knn_join(vectors: DataFrame, queries: Column, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", most_pivots: int = MOST_PIVOTS, group: int = GROUP) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``queries`` holds for, the ``k`` best of all other rows, ties to the smaller id."""
    whole = materialize(whole_vectors(vectors, id_col, vector_col, scale, queries), "voronoi-vectors")
    stats = whole.agg(F.max(F.size("e")).alias("dim"), F.max("norm2").alias("m2"), F.count(F.lit(1)).alias("n"), F.max("query").alias("any")).first()
    if not stats["any"] or stats["n"] < 2:
        return whole.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim, m2 = max(1, stats["dim"]), stats["m2"]
    pivots = Pivots(_sampled(whole, max(1, min(most_pivots, int(stats["n"] ** 0.5) // 2, MOST_COMPONENTS // dim, MOST_DISTANCES // (k + 1))), dim), m2)
    cells = materialize(whole.mapInArrow(_assign(pivots), "row long, vec_id long, e array<bigint>, norm2 long, cell int, dist double, qcell int, qdist double"), "voronoi-cells")
    discard(whole)
    plan = _planned(cells, pivots, k, min(group, max(64, GROUP_COMPONENTS // dim)))
    dealt = "class long, part long, slice long, row long, vec_id long, e array<bigint>"
    asked = cells.where("qcell is not null").select("row", "vec_id", "e", "qcell").mapInArrow(_deal_queries(plan), dealt)
    sent = cells.select("row", "vec_id", "e", "norm2").mapInArrow(_deal_data(plan), dealt)
    keys = ["class", "part", "slice"]
    found = asked.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_solver(dim, m2, k), "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _sampled(whole: DataFrame, most: int, dim: int) -> np.ndarray:
    """``most`` rows by a hash of their numbers: a bounded sample."""
    rows = whole.orderBy(F.xxhash64("row"), "row").limit(most).select("e").collect()
    out = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r["e"])] = r["e"]
    return out


def _planned(cells: DataFrame, pivots: Pivots, k: int, group: int) -> Plan:
    nearest = cells.select("cell", "dist").withColumn("i", F.row_number().over(Window.partitionBy("cell").orderBy("dist"))).where(F.col("i") <= k + 1)
    asked = cells.where("qcell is not null").groupBy("qcell").agg(F.count(F.lit(1)).alias("n"), F.max("qdist").alias("far"))
    plan = Plan(pivots, k, [(r["cell"], r["dist"]) for r in nearest.collect()], [(r["qcell"], r["n"], r["far"]) for r in asked.orderBy("qcell").collect()], group)
    for r in cells.select("e", "norm2").mapInArrow(_counts(plan), "class long, sent long").groupBy("class").agg(F.sum("sent").alias("sent")).collect():
        plan.slices[r["class"]] = max(1, -(-r["sent"] // group))
    return plan


def embedding_neighbours(embeddings: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """The ``k`` best other rows of each row whose id ``every`` divides."""
    return knn_join(embeddings, F.col("vec_id") % every == 0, k)


def neighbours_sql(table: str, every: int = EVERY, k: int = K, scale: int = SCALE) -> str:
    return f"""
WITH v AS (
  SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS e FROM {table}
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.i, q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.e, v.e) AS BIGINT) AS score FROM v q, v WHERE q.vec_id % {every} = 0 AND q.i <> v.i
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {k}
"""
