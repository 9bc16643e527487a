"""Equal-area sky cells: numbering, centres, neighbours and cones.

Cells of a grid of ``nside`` are numbered base * nside^2 + x * nside + y, with x growing to the
north-east and y to the north-west of each of the 12 base cells. Point to cell is SQL text; the
small per-grid tables (centres, neighbours) are numpy helpers over whole grids.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyweft.functions.sky import num


def cell_stages(nside: int, x: str = "x", y: str = "y", z: str = "z", out: str = "cell", flat: str = "2.0 / 3.0", belt: str = "(4.0 / 3.0)", turn: str | None = None) -> list[dict[str, str]]:
    """Point to cell in steps, each a set of columns made from the step before, so that no term is repeated.

    ``flat`` is the height of the caps' edge and ``belt`` the height between the caps: Spark needs doubles, as it divides decimals to six digits.
    ``turn`` is the longitude in radians, ``atan2`` if not given.
    """
    n, half = num(nside), num(math.pi / 2)
    cap = f"sqrt(greatest({num(0)}, 3.0 * (1.0 - abs({z}))))"
    clamp = lambda e: f"least({nside - 1}, greatest(0, cast(floor({e}) as int)))"
    polar = lambda north, south, middle: f"CASE WHEN {z} >= {flat} THEN {north} WHEN {z} <= -{flat} THEN {south} ELSE {middle} END"
    return [
        {"hp_u": f"({turn or f'atan2({y}, {x})'} / {half} + {num(4)}) % {num(4)}"},
        {"hp_q": "cast(floor(hp_u) as int)", "hp_t": f"hp_u % {num(1)}"},
        {"hp_e": f"(({z} + {flat}) / {belt} + hp_t) * {n}", "hp_w": f"(({z} + {flat}) / {belt} - hp_t + 1.0) * {n}", "hp_kx": f"{cap} * {n} * (1.0 - hp_t)", "hp_ky": f"{cap} * {n} * hp_t"},
        {"hp_eb": f"cast(floor(hp_e / {n}) as int)", "hp_wb": f"cast(floor(hp_w / {n}) as int)", "hp_gx": polar(f"{n} - hp_kx", "hp_ky", f"hp_e % {n}"), "hp_gy": polar(f"{n} - hp_ky", "hp_kx", f"hp_w % {n}")},
        {"hp_b": polar("hp_q", "8 + hp_q", "(hp_q + hp_eb * (1 - hp_wb)) % 4 + 4 * (2 - hp_eb - hp_wb)")},
        {out: f"cast(hp_b * {nside * nside} + {clamp('hp_gx')} * {nside} + {clamp('hp_gy')} as bigint)"},
    ]


def with_cell(df: DataFrame, nside: int, x: str = "x", y: str = "y", z: str = "z", out: str = "cell") -> DataFrame:
    """``df`` with the cell of a unit vector."""
    keep = [c for c in df.columns if c != out]
    # Spark's atan2 takes minus zero for zero: at a pole that is the other side of the sky
    turn = f"CASE WHEN {x} = 0 AND {y} = 0 AND string({x}) = '-0.0' THEN {num(math.pi)} ELSE atan2({y}, {x}) END"
    for stage in cell_stages(nside, x, y, z, out, num(2 / 3), num(4 / 3), turn):
        df = df.withColumns({c: F.expr(e) for c, e in stage.items()})
    return df.select(*keep, out)


def cell_sql(source: str, nside: int, columns: str, out: str = "cell") -> str:
    """The same as a subquery over ``source``: the columns named and the cell."""
    text = f"SELECT * FROM {source} hp0"
    made: list[str] = []
    for i, stage in enumerate(cell_stages(nside, out=out)):
        again = [c for c in stage if c in made]
        base = f"* EXCLUDE ({', '.join(again)})" if again else "*"
        text = f"SELECT {base}, {', '.join(f'{e} AS {c}' for c, e in stage.items())} FROM ({text}) hp{i + 1}"
        made += stage
    return f"(SELECT {columns}, {out} FROM ({text}) hpz)"


def cells_of(p: np.ndarray, nside: int) -> np.ndarray:
    """Cells of unit vectors (rows)."""
    x, y, z = p[:, 0], p[:, 1], p[:, 2]
    n = nside
    phi = np.arctan2(y, x)
    phi = np.where(phi < 0, phi + 2 * np.pi, phi)
    q = np.minimum(3, np.floor(phi / (np.pi / 2)).astype(int))
    t = phi - q * (np.pi / 2)
    zu, pu = (z + 2 / 3) / (4 / 3), t / (np.pi / 2)
    ex, ey = (zu + pu) * n, (zu - pu + 1) * n
    e, w = ex >= n, ey >= n
    base = np.where(e & w, q, np.where(e, (q + 1) % 4 + 4, np.where(w, q + 4, 8 + q)))
    gx, gy = np.where(e, ex - n, ex), np.where(w, ey - n, ey)
    cap = np.sqrt(np.maximum(0, 3 * (1 - np.abs(z))))
    kx, ky = cap * np.abs(n * (2 * t - np.pi) / np.pi), cap * np.abs(2 * n * t / np.pi)
    up, down = z >= 2 / 3, z <= -2 / 3
    base = np.where(up, q, np.where(down, 8 + q, base))
    gx, gy = np.where(up, n - kx, np.where(down, ky, gx)), np.where(up, n - ky, np.where(down, kx, gy))
    clamp = lambda v: np.clip(np.floor(v).astype(np.int64), 0, n - 1)
    return base.astype(np.int64) * n * n + clamp(gx) * n + clamp(gy)


def points_of(cell: np.ndarray, nside: int, dx: float | np.ndarray = 0.5, dy: float | np.ndarray = 0.5) -> np.ndarray:
    """Unit vectors of places (dx, dy) within cells."""
    cell = np.asarray(cell, np.int64)
    base, rest = cell // (nside * nside), cell % (nside * nside)
    x, y = (rest // nside + dx) / nside, (rest % nside + dy) / nside
    row, col = base // 4, base % 4
    s, d = x + y, x - y  # s runs north, d runs east
    equator = np.where(row == 0, s < 1, np.where(row == 2, s > 1, True))
    z_eq = (2 / 3) * np.where(row == 0, s, np.where(row == 1, s - 1, s - 2))
    centre = np.where(row == 1, col * (np.pi / 2), col * (np.pi / 2) + np.pi / 4)
    phi_eq = centre + d * (np.pi / 4)
    r = np.where(row == 0, 2 - s, s)  # distance from the pole, 0 at it and 1 at the edge of the cap
    z_cap = np.where(row == 0, 1.0, -1.0) * (1 - r * r / 3)
    with np.errstate(divide="ignore", invalid="ignore"):
        phi_cap = centre + np.where(r > 0, d / np.where(r > 0, r, 1), 0) * (np.pi / 4)
    z, phi = np.where(equator, z_eq, z_cap), np.where(equator, phi_eq, phi_cap)
    h = np.sqrt(np.maximum(0, 1 - z * z))
    return np.column_stack([h * np.cos(phi), h * np.sin(phi), z])


@cache
def neighbour_pairs(nside: int) -> tuple[np.ndarray, np.ndarray]:
    """All (cell, neighbour) pairs of a grid: points just outside of edges and corners, put back in cells."""
    cells = np.arange(12 * nside * nside)
    eps = 1e-5
    found = []
    for dx in (-eps, 0.5, 1 + eps):
        for dy in (-eps, 0.5, 1 + eps):
            if (dx, dy) != (0.5, 0.5):
                inner = points_of(cells, nside, np.clip(dx, eps, 1 - eps), np.clip(dy, eps, 1 - eps))
                centre = points_of(cells, nside)
                edge = points_of(cells, nside, np.clip(dx, 0, 1), np.clip(dy, 0, 1))
                out = edge + (edge - inner) * 1.0 + (edge - centre) * 1e-6
                found.append(np.column_stack([cells, cells_of(out / np.linalg.norm(out, axis=1, keepdims=True), nside)]))
    pairs = np.unique(np.concatenate(found), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    both = np.unique(np.concatenate([pairs, pairs[:, ::-1]]), axis=0)
    return both[:, 0], both[:, 1]


def cell_radius(nside: int) -> float:
    """Degrees that any point of a cell is from its centre at most, for every cell of the grid."""
    cells = np.arange(12 * nside * nside)
    centre = points_of(cells, nside)
    edge = [points_of(cells, nside, dx, dy) for dx, dy in ((0, 0), (0, 1), (1, 0), (1, 1))]
    return max(float(np.degrees(np.arccos(np.clip((centre * e).sum(1), -1, 1))).max()) for e in edge)


def cells_within(x: float, y: float, z: float, radius_deg: float, nside: int) -> list[int]:
    """Cells that may hold a point within ``radius_deg``: a superset, by centre distance."""
    centre = points_of(np.arange(12 * nside * nside), nside)
    reach = min(180.0, radius_deg + cell_radius(nside) + 1e-9)
    return np.flatnonzero(centre @ np.array([x, y, z]) >= math.cos(math.radians(reach))).tolist()


def side_arcmin(nside: int) -> float:
    """Side of a cell of mean area."""
    return math.degrees(math.sqrt(4 * math.pi / 12) / nside) * 60


def nside_of(side: float) -> int:
    """Grid whose cells have at most about this side, in arc minutes."""
    return max(1, round(side_arcmin(1) / side))


def to_nested(cell: str, nside: int) -> str:
    """Nested number of a cell (nside a power of two), as SQL text: bits of x and y interleaved."""
    k = nside.bit_length() - 1
    x, y = f"cast(floor(({cell} % {nside * nside}) / {num(nside)}) as bigint)", f"({cell} % {nside})"
    bit = lambda v, i: f"(cast(floor({v} / {num(1 << i)}) as bigint) % 2)"
    terms = [f"{bit(x, i)} * {1 << (2 * i)} + {bit(y, i)} * {1 << (2 * i + 1)}" for i in range(k)] or ["0"]
    return f"(cast(floor({cell} / {num(nside * nside)}) as bigint) * {nside * nside} + {' + '.join(terms)})"


def to_ring(cell: str, nside: int) -> str:
    """Ring number of a cell: rings from north to south, each from west to east."""
    n = nside
    base = f"cast(floor({cell} / {num(n * n)}) as bigint)"
    x, y = f"cast(floor(({cell} % {n * n}) / {num(n)}) as bigint)", f"({cell} % {n})"
    row, col = f"cast(floor({base} / {num(4)}) as bigint)", f"({base} % 4)"
    v, h = f"({x} + {y})", f"({x} - {y})"
    ring = f"(({row} + 2) * {n} - {v} - 1)"
    north = f"(2 * {ring} * ({ring} - 1) + {col} * {ring} + cast(floor(({h} + {ring} - 1) / 2.0) as bigint))"
    southern = f"(4 * {n} - {ring})"
    south = f"({12 * n * n} - 2 * {southern} * ({southern} + 1) + {col} * {southern} + cast(floor(({h} + {southern} - 1) / 2.0) as bigint))"
    shift = f"(({ring} - {n}) % 2)"
    west = f"(CASE WHEN {row} = 1 THEN 2 * {col} * {n} ELSE (2 * {col} + 1) * {n} END)"
    place = f"cast(floor(({west} + {h} + CASE WHEN {shift} = 0 THEN 0 ELSE 0 END) / 2.0) as bigint)"
    belt = f"({2 * n * (n - 1)} + ({ring} - {n}) * {4 * n} + (({place} + {4 * n}) % {4 * n}))"
    return f"(CASE WHEN {ring} < {n} THEN {north} WHEN {ring} > {3 * n} THEN {south} ELSE {belt} END)"
