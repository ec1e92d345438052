"""Geodesy as formula programs: azimuths, UTM, geodesics on WGS84, display formats.

Geodesics use the auxiliary sphere (Karney 2013) with its two integrals by
Gauss-Legendre quadrature: I1 = int sqrt(1 + k^2 sin^2 s) ds gives distance, and
I3 = int (2 - f) / (1 + (1 - f) sqrt(1 + k^2 sin^2 s)) ds gives longitude.
"""

from __future__ import annotations

import numpy as np

from . import constants as k
from .program import Program, num


def norm360(x: str) -> str:
    """An angle in [0, 360)."""
    return f"({x} - 360e0 * floor(({x}) / 360e0))"


def signed_delta(a: str, b: str) -> str:
    """b - a in (-180, 180]."""
    d = f"(({b}) - ({a}))"
    return f"(180e0 - (180e0 - {d} - 360e0 * floor((180e0 - {d}) / 360e0)))"


def math_angle(azimuth: str) -> str:
    """Azimuth in degrees as a mathematical angle in radians."""
    return f"radians(90e0 - ({azimuth}))"


def valid_coordinate(lat: str, lon: str) -> str:
    return f"coalesce({lat} between -90e0 and 90e0 and {lon} between -180e0 and 180e0 and not isnan({lat}) and not isnan({lon}), false)"


def utm_zone(lon: str) -> str:
    """Zone number without regional exceptions: floor((lon + 180) / 6) mod 60 + 1."""
    return f"cast((cast(floor(({lon} + 180e0) / 6e0) as bigint) % 60) + 1 as int)"


def central_meridian(zone: str) -> str:
    return f"(6e0 * {zone} - 183e0)"


def utm_forward(lat: str = "lat", lon: str = "lon", out: str = "", zone: str | None = None, hemisphere: str | None = None) -> Program:
    """UTM by the sixth-order Krueger series; ``zone`` and ``hemisphere`` ('N' or 'S') may be forced by expressions."""
    e = float(np.sqrt(k.WGS84_E2))
    alpha = k.krueger(k.KRUEGER_ALPHA)
    p = f"_{out}"
    xi = " + ".join(f"{num(a)} * sin({2 * j}e0 * {p}x1) * cosh({2 * j}e0 * {p}y1)" for j, a in enumerate(alpha, 1))
    eta = " + ".join(f"{num(a)} * cos({2 * j}e0 * {p}x1) * sinh({2 * j}e0 * {p}y1)" for j, a in enumerate(alpha, 1))
    scale = num(k.UTM_K0 * k.RECTIFYING_RADIUS)
    south = f"case when {out}hemisphere = 'S' then {num(k.UTM_FALSE_NORTHING)} else 0e0 end"
    return Program(
        {f"{out}zone": zone or utm_zone(lon), f"{out}hemisphere": hemisphere or f"case when {lat} < 0e0 then 'S' else 'N' end"},
        {f"{p}t": f"tan(radians({lat}))", f"{p}l": f"radians({lon} - {central_meridian(out + 'zone')})"},
        {f"{p}s": f"sinh({num(e)} * atanh({num(e)} * {p}t / sqrt(1e0 + {p}t * {p}t)))"},
        {f"{p}q": f"{p}t * sqrt(1e0 + {p}s * {p}s) - {p}s * sqrt(1e0 + {p}t * {p}t)"},
        {f"{p}x1": f"atan2({p}q, cos({p}l))", f"{p}y1": f"asinh(sin({p}l) / sqrt({p}q * {p}q + cos({p}l) * cos({p}l)))"},
        {f"{p}x": f"{p}x1 + {xi}", f"{p}y": f"{p}y1 + {eta}", f"{out}utm_status": f"case when {lat} is null or {lon} is null then 'NULL' when abs({lat}) > {num(k.UTM_MAX_LAT)} then 'OUT_OF_RANGE' else 'OK' end"},
        {
            f"{out}easting": f"case when {out}utm_status = 'OK' then {num(k.UTM_FALSE_EASTING)} + {scale} * {p}y end",
            f"{out}northing": f"case when {out}utm_status = 'OK' then {scale} * {p}x + {south} end",
        },
    )


def utm_inverse(easting: str, northing: str, zone: str, hemisphere: str, out: str = "inv_") -> Program:
    """Latitude and longitude of UTM coordinates: beta series and five Newton steps for latitude."""
    e = float(np.sqrt(k.WGS84_E2))
    beta = k.krueger(k.KRUEGER_BETA)
    p = f"_{out}"
    scale = num(k.UTM_K0 * k.RECTIFYING_RADIUS)
    xi = " + ".join(f"{num(b)} * sin({2 * j}e0 * {p}x) * cosh({2 * j}e0 * {p}y)" for j, b in enumerate(beta, 1))
    eta = " + ".join(f"{num(b)} * cos({2 * j}e0 * {p}x) * sinh({2 * j}e0 * {p}y)" for j, b in enumerate(beta, 1))
    stages = [
        {f"{p}x": f"({northing} - case when {hemisphere} = 'S' then {num(k.UTM_FALSE_NORTHING)} else 0e0 end) / {scale}", f"{p}y": f"({easting} - {num(k.UTM_FALSE_EASTING)}) / {scale}"},
        {f"{p}x1": f"{p}x - ({xi})", f"{p}y1": f"{p}y - ({eta})"},
        {f"{p}q": f"sin({p}x1) / sqrt(sinh({p}y1) * sinh({p}y1) + cos({p}x1) * cos({p}x1))", f"{p}l": f"atan2(sinh({p}y1), cos({p}x1))"},
        {f"{p}t0": f"{p}q / {num(1 - k.WGS84_E2)}"},
    ]
    for i in range(5):
        t = f"{p}t{i}"
        stages += [
            {f"{p}s{i}": f"sinh({num(e)} * atanh({num(e)} * {t} / sqrt(1e0 + {t} * {t})))"},
            {f"{p}u{i}": f"{t} * sqrt(1e0 + {p}s{i} * {p}s{i}) - {p}s{i} * sqrt(1e0 + {t} * {t})"},
            {f"{p}t{i + 1}": f"{t} + ({p}q - {p}u{i}) / sqrt(1e0 + {p}u{i} * {p}u{i}) * (1e0 + {num(1 - k.WGS84_E2)} * {t} * {t}) / ({num(1 - k.WGS84_E2)} * sqrt(1e0 + {t} * {t}))"},
        ]
    return Program(*stages, {f"{out}lat": f"degrees(atan({p}t5))", f"{out}lon": f"degrees({p}l) + {central_meridian(zone)}"})


def _quadrature(f, low: str, width: str, nodes: int) -> str:
    """Gauss-Legendre rule for the integral of ``f`` over [low, low + width]."""
    x, w = np.polynomial.legendre.leggauss(nodes)
    return f"({width}) * (" + " + ".join(f"{num(float(b) / 2)} * {f(f'({low} + {num((1 + float(a)) / 2)} * {width})')}" for a, b in zip(x, w, strict=True)) + ")"


def geodesic_inverse(lat1: str, lon1: str, lat2: str, lon2: str, out: str = "geo_", nodes: int = 8, updates: int = 5) -> Program:
    """Distance in metres and azimuths in degrees. For lines up to some thousand km; nearly antipodal ones are flagged.

    Status OK, NULL, or NOT_CONVERGED (the last update moved by more than 1e-10 rad).
    """
    p, f = f"_{out}", k.WGS84_F
    stages = [
        {f"{p}b1": f"atan({num(1 - f)} * tan(radians({lat1})))", f"{p}b2": f"atan({num(1 - f)} * tan(radians({lat2})))", f"{p}l": f"radians({signed_delta(lon1, lon2)})"},
        {f"{p}s1": f"sin({p}b1)", f"{p}c1": f"cos({p}b1)", f"{p}s2": f"sin({p}b2)", f"{p}c2": f"cos({p}b2)", f"{p}d": f"sin({p}b2 - {p}b1)", f"{p}w0": f"{p}l"},
    ]
    for i in range(updates + 1):
        w = f"{p}w{i}"
        stages += [
            {f"{p}m{i}": f"{p}c2 * sin({w})", f"{p}n{i}": f"{p}d + 2e0 * {p}s1 * {p}c2 * sin({w} / 2e0) * sin({w} / 2e0)", f"{p}g{i}": f"{p}s1 * {p}s2 + {p}c1 * {p}c2 * cos({w})"},
            {f"{p}a{i}": f"atan2({p}m{i}, {p}n{i})", f"{p}z{i}": f"atan2(sqrt({p}m{i} * {p}m{i} + {p}n{i} * {p}n{i}), {p}g{i})"},
            {f"{p}o{i}": f"sin({p}a{i}) * {p}c1", f"{p}h{i}": f"atan2({p}s1, cos({p}a{i}) * {p}c1)"},
            {f"{p}k{i}": f"{num(k.WGS84_EP2)} * (1e0 - {p}o{i} * {p}o{i})"},
        ]
        if i < updates:
            inner = lambda s, i=i: f"({num(2 - f)} / (1e0 + {num(1 - f)} * sqrt(1e0 + {p}k{i} * sin{s} * sin{s})))"
            stages.append({f"{p}w{i + 1}": f"{p}l + {num(f)} * {p}o{i} * {_quadrature(inner, f'{p}h{i}', f'{p}z{i}', nodes)}"})
    u = updates
    length = lambda s: f"sqrt(1e0 + {p}k{u} * sin{s} * sin{s})"
    return Program(
        *stages,
        {
            f"{out}distance": f"{num(k.WGS84_B)} * {_quadrature(length, f'{p}h{u}', f'{p}z{u}', nodes)}",
            f"{out}azi1": norm360(f"degrees({p}a{u})"),
            f"{out}azi2": norm360(f"degrees(atan2({p}o{u}, sqrt(abs(1e0 - {p}o{u} * {p}o{u})) * cos({p}h{u} + {p}z{u})))"),
            f"{out}status": f"case when {lat1} is null or {lon1} is null or {lat2} is null or {lon2} is null then 'NULL' when abs({p}w{u} - {p}w{u - 1}) > 1e-10 then 'NOT_CONVERGED' else 'OK' end",
        },
    )


def geodesic_direct(lat: str, lon: str, azimuth: str, distance: str, out: str = "to_", nodes: int = 8, updates: int = 3) -> Program:
    """End point and final azimuth of a geodesic, by Newton steps on arc length."""
    p, f = f"_{out}", k.WGS84_F
    length = lambda s: f"sqrt(1e0 + {p}k * sin{s} * sin{s})"
    inner = lambda s: f"({num(2 - f)} / (1e0 + {num(1 - f)} * sqrt(1e0 + {p}k * sin{s} * sin{s})))"
    stages = [
        {f"{p}b": f"atan({num(1 - f)} * tan(radians({lat})))", f"{p}a": f"radians({azimuth})"},
        {f"{p}o": f"sin({p}a) * cos({p}b)", f"{p}h": f"atan2(sin({p}b), cos({p}a) * cos({p}b))"},
        {f"{p}c": f"sqrt(cos({p}a) * cos({p}a) + sin({p}a) * sin({p}a) * sin({p}b) * sin({p}b))"},
        {f"{p}k": f"{num(k.WGS84_EP2)} * {p}c * {p}c", f"{p}z0": f"({distance}) / {num(k.WGS84_B)}"},
    ]
    for i in range(updates):
        z = f"{p}z{i}"
        stages.append({f"{p}z{i + 1}": f"{z} - ({_quadrature(length, f'{p}h', z, nodes)} - ({distance}) / {num(k.WGS84_B)}) / {length(f'({p}h + {z})')}"})
    z = f"{p}z{updates}"
    return Program(
        *stages,
        {f"{p}e": f"{p}h + {z}", f"{p}i": _quadrature(inner, f"{p}h", z, nodes)},
        {f"{p}n": f"atan2({p}o * sin({p}e), cos({p}e)) - atan2({p}o * sin({p}h), cos({p}h))"},
        {f"{p}n2": f"{p}n - {num(2 * np.pi)} * round({p}n / {num(2 * np.pi)}) - {num(k.WGS84_F)} * {p}o * {p}i"},
        {
            f"{out}lat": f"degrees(atan2({p}c * sin({p}e), {num(1 - f)} * sqrt({p}o * {p}o + {p}c * {p}c * cos({p}e) * cos({p}e))))",
            f"{out}lon": f"(180e0 - (180e0 - ({lon} + degrees({p}n2)) - 360e0 * floor((180e0 - ({lon} + degrees({p}n2))) / 360e0)))",
            f"{out}azi": norm360(f"degrees(atan2({p}o, {p}c * cos({p}e)))"),
        },
    )


def tile_stem(lat: str, lon: str) -> str:
    """Name of the one-degree tile that holds a point, such as N47_00_E008."""
    a, b = f"cast(floor({lat}) as int)", f"cast(floor({lon}) as int)"
    return f"concat(case when {a} >= 0 then 'N' else 'S' end, lpad(cast(abs({a}) as string), 2, '0'), '_00_', case when {b} >= 0 then 'E' else 'W' end, lpad(cast(abs({b}) as string), 3, '0'))"


def tile_columns(lat_floor: str) -> str:
    """Columns of a one-degree tile by the band of its south-west corner."""
    a = f"abs({lat_floor})"
    # Lower edges of the bands and their column counts.
    return f"case when {a} >= 85 then 360 when {a} >= 80 then 720 when {a} >= 70 then 1200 when {a} >= 60 then 1800 when {a} >= 50 then 2400 else 3600 end"


def display(lat: str, lon: str, height: str) -> str:
    """A coordinate as text, such as 47.123400°N, 8.500000°E, 512.000m."""
    return f"concat(printf('%.6f', abs({lat})), '°', case when {lat} >= 0 then 'N' else 'S' end, ', ', printf('%.6f', abs({lon})), '°', case when {lon} >= 0 then 'E' else 'W' end, ', ', printf('%.3f', {height}), 'm')"
