"""Sky coordinates, distances, frames, photometry and time as SQL expression text.

Every function takes column names or expressions as text and returns text that Spark evaluates with
``F.expr`` inside generated code. Angles are in degrees unless a name says otherwise.
"""

from __future__ import annotations

import math

#: Rotation from equatorial J2000 to galactic coordinates (fixed values of the standard).
GALACTIC = (
    (-0.0548755604, -0.8734370902, -0.4838350155),
    (0.4941094279, -0.4448296300, 0.7469822445),
    (-0.8676661490, -0.1980763734, 0.4559837762),
)
#: Obliquity of the ecliptic at J2000, degrees.
OBLIQUITY = 23.439281


def num(x: float) -> str:
    """A DOUBLE literal in either dialect."""
    return f"cast({float(x)!r} as double)"


def xyz(ra: str, dec: str) -> tuple[str, str, str]:
    """Unit vector of a position."""
    return (
        f"cos(radians({dec})) * cos(radians({ra}))",
        f"cos(radians({dec})) * sin(radians({ra}))",
        f"sin(radians({dec}))",
    )


def ra_of(x: str, y: str) -> str:
    a = f"degrees(atan2({y}, {x}))"
    return f"({a} + CASE WHEN {a} < 0 THEN 360.0 ELSE 0.0 END)"


def dec_of(z: str) -> str:
    return f"degrees(asin(greatest({num(-1)}, least({num(1)}, {z}))))"


def normal_ra(ra: str) -> str:
    return f"({ra} - 360.0 * floor({ra} / 360.0))"


def chord2_of_deg(deg: float) -> float:
    """Squared chord on the unit sphere of an angle."""
    return 2.0 * (1.0 - math.cos(math.radians(deg))) if deg > 1e-3 else math.radians(deg) ** 2


def deg_of_chord2(d2: str) -> str:
    return f"degrees(2.0 * asin(least({num(1)}, sqrt({d2}) / 2.0)))"


def dist2(a: str, b: str, cols=("x", "y", "z")) -> str:
    return " + ".join(f"({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c})" for c in cols)


def rotate(matrix, x: str, y: str, z: str) -> tuple[str, ...]:
    return tuple(f"({num(r[0])} * ({x}) + {num(r[1])} * ({y}) + {num(r[2])} * ({z}))" for r in matrix)


def galactic(ra: str, dec: str) -> tuple[str, str]:
    """(l, b) of an equatorial position."""
    x, y, z = rotate(GALACTIC, *xyz(ra, dec))
    return ra_of(x, y), dec_of(z)


def ecliptic(ra: str, dec: str) -> tuple[str, str]:
    """(longitude, latitude) of an equatorial position."""
    c, s = math.cos(math.radians(OBLIQUITY)), math.sin(math.radians(OBLIQUITY))
    x, y, z = rotate(((1, 0, 0), (0, c, s), (0, -s, c)), *xyz(ra, dec))
    return ra_of(x, y), dec_of(z)


def hammer_aitoff(ra: str, dec: str) -> tuple[str, str]:
    """Equal-area projection onto an ellipse, centre at RA 0; x in [-2, 2] sqrt 2."""
    lon = f"radians(CASE WHEN {normal_ra(ra)} > 180 THEN {normal_ra(ra)} - 360 ELSE {normal_ra(ra)} END)"
    lat = f"radians({dec})"
    d = f"sqrt(1.0 + cos({lat}) * cos({lon} / 2.0))"
    return f"(2.0 * sqrt(2.0) * cos({lat}) * sin({lon} / 2.0) / {d})", f"(sqrt(2.0) * sin({lat}) / {d})"


def mercator(ra: str, dec: str) -> tuple[str, str]:
    """x and y in [0, 1] turns, y grows to the north."""
    return f"({normal_ra(ra)} / 360.0)", f"(0.5 + ln(tan(radians(45.0 + ({dec}) / 2.0))) / (2.0 * pi()))"


def flux_of_mag(mag: str) -> str:
    return f"pow({num(10)}, -0.4 * ({mag}))"


def mag_of_flux(flux: str) -> str:
    return f"(-2.5 * log10({flux}))"


def luptitude(nmgy: str, softening: float) -> str:
    """Asinh magnitude of a flux in nanomaggies."""
    k = 2.5 / math.log(10)
    b = num(softening)
    ratio = f"(({nmgy}) * {num(1e-9)} / (2.0 * {b}))"
    return f"(-{num(k)} * (ln({ratio} + sqrt({ratio} * {ratio} + 1.0)) + ln({b})))"


def hms(ra: str, digits: int = 3) -> str:
    """HH:MM:SS.sss with carry; rounds once, in units of the last digit."""
    return _sexagesimal(f"({normal_ra(ra)} / 15.0)", digits, 2)


def dms(dec: str, digits: int = 3) -> str:
    return f"concat(CASE WHEN {dec} < 0 THEN '-' ELSE '+' END, {_sexagesimal(f'abs({dec})', digits, 2)})"


def _sexagesimal(value: str, digits: int, width: int) -> str:
    unit = 10**digits
    n = f"cast(round(({value}) * 3600.0 * {unit}) as bigint)"
    part = lambda e, w: f"lpad(cast({e} as string), {w}, '0')"
    whole = lambda k: f"cast(floor({n} / cast({k} as double)) as bigint)"
    hours, minutes, seconds = whole(3600 * unit), f"({whole(60 * unit)} % 60)", f"({whole(unit)} % 60)"
    tail = f", '.', {part(f'({n} % {unit})', digits)}" if digits else ""
    return f"concat({part(hours, width)}, ':', {part(minutes, 2)}, ':', {part(seconds, 2)}{tail})"


def from_sexagesimal(text: str, per_unit: float = 1.0) -> str:
    """Value of ``[+-]A:B:C.c`` (or with spaces) times ``per_unit``; null where the text is no such thing."""
    pattern = "^ *([+-]?)([0-9]+)[: ]([0-9]+)[: ]([0-9]+[.]?[0-9]*) *$"
    get = lambda i: f"regexp_extract({text}, '{pattern}', {i})"
    value = f"(cast({get(2)} as double) + cast({get(3)} as double) / 60.0 + cast({get(4)} as double) / 3600.0)"
    return f"CASE WHEN {get(2)} <> '' THEN CASE WHEN {get(1)} = '-' THEN -1.0 ELSE 1.0 END * {num(per_unit)} * {value} END"


def mjd_of_micros(micros: str) -> str:
    """Modified Julian date of microseconds since 1970."""
    return f"(({micros}) / {num(86400e6)} + 40587.0)"


def jd_of_mjd(mjd: str) -> str:
    return f"({mjd} + 2400000.5)"


def proper_motion(ra: str, dec: str, pm_ra: str, pm_dec: str, years: str) -> tuple[str, str]:
    """Position after ``years``; motions in mas a year, the first with cos(dec) taken in."""
    return normal_ra(f"({ra} + {pm_ra} * {years} / 3.6e6 / cos(radians({dec})))"), f"({dec} + {pm_dec} * {years} / 3.6e6)"


def polygon_area(points: str) -> str:
    """Signed area (shoelace) of ``array<struct<x,y>>``, Spark only."""
    return (
        f"aggregate(sequence(0, size({points}) - 1), cast(0.0 as double), (s, i) -> s + "
        f"({points}[i].x * {points}[(i + 1) % size({points})].y - {points}[(i + 1) % size({points})].x * {points}[i].y) / 2.0)"
    )


def in_polygon(x: str, y: str, points: str) -> str:
    """Even-odd test of a point against ``array<struct<x,y>>``, Spark only."""
    a, b = f"{points}[i]", f"{points}[(i + 1) % size({points})]"
    cross = f"(({a}.y > {y}) <> ({b}.y > {y})) AND {x} < ({b}.x - {a}.x) * ({y} - {a}.y) / ({b}.y - {a}.y) + {a}.x"
    return f"(aggregate(sequence(0, size({points}) - 1), 0, (s, i) -> s + CASE WHEN {cross} THEN 1 ELSE 0 END) % 2 = 1)"
