"""Two-body orbits: Kepler's equation, positions and velocities from elements, and elements from those."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def eccentric_anomaly(mean: np.ndarray, e: np.ndarray, tolerance: float = 1e-13) -> np.ndarray:
    """E with E - e sin E = M for 0 <= e < 1, by Newton steps kept within [M - e, M + e]."""
    mean = np.asarray(mean, float)
    turns = np.floor((mean + np.pi) / (2 * np.pi)) * 2 * np.pi
    m = mean - turns
    x = m + e * np.sin(m)
    for _ in range(60):
        step = (x - e * np.sin(x) - m) / (1 - e * np.cos(x))
        x = np.clip(x - step, m - e, m + e)
        if np.all(np.abs(step) < tolerance):
            break
    return x + turns


def position(a, e, i, node, peri, mean) -> np.ndarray:
    """Cartesian positions (rows) from elements; angles in radians."""
    big = eccentric_anomaly(mean, e)
    p, q = a * (np.cos(big) - e), a * np.sqrt(1 - e * e) * np.sin(big)
    cn, sn, cp, sp, ci, si = np.cos(node), np.sin(node), np.cos(peri), np.sin(peri), np.cos(i), np.sin(i)
    return np.column_stack([p * (cn * cp - sn * sp * ci) - q * (cn * sp + sn * cp * ci), p * (sn * cp + cn * sp * ci) - q * (sn * sp - cn * cp * ci), p * sp * si + q * cp * si])


def with_positions(elements: DataFrame) -> DataFrame:
    """``elements`` (a, e, i, node, peri, mean) with columns px, py, pz, in place of any so named; NaN where an element is null."""

    @F.pandas_udf("px double, py double, pz double")
    def place(a: pd.Series, e: pd.Series, i: pd.Series, node: pd.Series, peri: pd.Series, mean: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(position(*(s.to_numpy(float) for s in (a, e, i, node, peri, mean))), columns=["px", "py", "pz"])

    kept = [c for c in elements.columns if c not in ("px", "py", "pz")]
    made = "_".join([*kept, "place"])  # longer than any of their names
    return elements.select(*kept, place("a", "e", "i", "node", "peri", "mean").alias(made)).select(*kept, f"{made}.*")


#: Standard gravity of the sun in AU^3 / yr^2 (fixed value).
GM_SUN = 39.4775743
#: Below this eccentricity an orbit counts as a circle: its periapsis is at the node.
CIRCLE = 1e-11
KEPLER_STEPS = 40


def with_states(elements: DataFrame, gm: float = GM_SUN) -> DataFrame:
    """``elements`` (a, e, i, node, peri, mean; radians) with position px, py, pz and velocity vx, vy, vz, by columns alone; null where an element is.

    Kepler's equation is solved by Newton steps kept within [M - e, M + e], as many for every row.
    """
    turn = "2 * pi()"
    t = elements.withColumn("m0", F.expr(f"mean - floor((mean + pi()) / ({turn})) * ({turn})"))
    step = lambda x, _: F.greatest(F.col("m0") - F.col("e"), F.least(F.col("m0") + F.col("e"), x - (x - F.col("e") * F.sin(x) - F.col("m0")) / (1 - F.col("e") * F.cos(x))))
    t = t.withColumn("big", F.when(F.col("e").isNotNull(), F.aggregate(F.sequence(F.lit(1), F.lit(KEPLER_STEPS)), F.col("m0") + F.col("e") * F.sin("m0"), step)))
    rate = f"sqrt({gm!r}D / (a * a * a)) / (1 - e * cos(big))"
    t = t.withColumns({"p": F.expr("a * (cos(big) - e)"), "q": F.expr("a * sqrt(1 - e * e) * sin(big)"), "dp": F.expr(f"-a * sin(big) * {rate}"), "dq": F.expr(f"a * sqrt(1 - e * e) * cos(big) * {rate}")})
    along = ("cos(node) * cos(peri) - sin(node) * sin(peri) * cos(i)", "sin(node) * cos(peri) + cos(node) * sin(peri) * cos(i)", "sin(peri) * sin(i)")
    ahead = ("-cos(node) * sin(peri) - sin(node) * cos(peri) * cos(i)", "-sin(node) * sin(peri) + cos(node) * cos(peri) * cos(i)", "cos(peri) * sin(i)")
    made = {f"{n}{c}": F.expr(f"{u} * ({x}) + {v} * ({y})") for n, u, v in (("p", "p", "q"), ("v", "dp", "dq")) for c, x, y in zip("xyz", along, ahead, strict=True)}
    return t.withColumns(made).select(*[c for c in elements.columns if c not in made], *made)


def elements_of(states: DataFrame, gm: float = GM_SUN) -> DataFrame:
    """``states`` (px .. vz) with the elements a, e, i, node, peri, mean in radians from 0 on; null for orbits that are not bound.

    An orbit in the reference plane has its node at 0, a circle its periapsis at the node.
    """
    dot = lambda a, b: " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True))
    cross = lambda a, b: tuple(f"({a[(k + 1) % 3]} * {b[(k + 2) % 3]} - {a[(k + 2) % 3]} * {b[(k + 1) % 3]})" for k in range(3))
    x, v, h, ev, n, w = (tuple(f"{s}{c}" for c in "xyz") for s in ("p", "v", "h_", "ecc_", "asc_", "side_"))
    steps = [
        {"r": f"sqrt({dot(x, x)})", "energy": f"0.5D * ({dot(v, v)}) - {gm!r}D / sqrt({dot(x, x)})"} | dict(zip(h, cross(x, v), strict=True)),
        {"h": f"sqrt({dot(h, h)})"} | {c: f"({k}) / {gm!r}D - {p} / r" for c, k, p in zip(ev, cross(v, h), x, strict=True)},
        {"flat": f"sqrt({h[0]} * {h[0]} + {h[1]} * {h[1]})", "e": f"sqrt({dot(ev, ev)})", "a": f"-0.5D * {gm!r}D / energy"},
        {"i": f"atan2(flat, {h[2]})", n[0]: f"CASE WHEN flat > 1e-14 * h THEN -{h[1]} / flat ELSE 1.0D END", n[1]: f"CASE WHEN flat > 1e-14 * h THEN {h[0]} / flat ELSE 0.0D END", n[2]: "0.0D"},
        dict(zip(w, (f"({k}) / h" for k in cross(h, n)), strict=True)),
        {"node": f"atan2({n[1]}, {n[0]})", "peri": f"CASE WHEN e > {CIRCLE!r}D THEN atan2({dot(ev, w)}, {dot(ev, n)}) ELSE 0.0D END"},
        {"true_anomaly": f"atan2({dot(x, w)}, {dot(x, n)}) - peri"},
        {"big": "2 * atan2(sqrt(1 - e) * sin(true_anomaly / 2), sqrt(1 + e) * cos(true_anomaly / 2))"},
        {"mean": "big - e * sin(big)"},
        {c: f"pmod({c}, 2 * pi())" for c in ("node", "peri", "mean")},
    ]
    t = states
    for step in steps:
        t = t.withColumns({c: F.expr(e) for c, e in step.items()})
    made = ("a", "e", "i", "node", "peri", "mean")
    return t.select(*[c for c in states.columns if c not in made], *[F.when(F.col("energy") < 0, F.col(c)).alias(c) for c in made])
