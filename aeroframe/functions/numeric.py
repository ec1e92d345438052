"""Vectorised numpy counterparts for use inside group solvers."""

from __future__ import annotations

import numpy as np

from . import constants as k

_X, _W = np.polynomial.legendre.leggauss(12)


def inverse(lat1, lon1, lat2, lon2, updates: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Distances (m) and initial azimuths (degrees) of geodesics between arrays of points."""
    lat1, lon1, lat2, lon2 = np.broadcast_arrays(*(np.asarray(x, float) for x in (lat1, lon1, lat2, lon2)))
    f = k.WGS84_F
    b1, b2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
    lam = np.radians((lon2 - lon1 + 180) % 360 - 180)
    s1, c1, s2, c2, d = np.sin(b1), np.cos(b1), np.sin(b2), np.cos(b2), np.sin(b2 - b1)
    w = lam
    nodes, weights = (1 + _X) / 2, _W / 2
    for _ in range(updates):
        m, n = c2 * np.sin(w), d + 2 * s1 * c2 * np.sin(w / 2) ** 2
        a, z = np.arctan2(m, n), np.arctan2(np.hypot(m, n), s1 * s2 + c1 * c2 * np.cos(w))
        o, h = np.sin(a) * c1, np.arctan2(s1, np.cos(a) * c1)
        kk = k.WGS84_EP2 * (1 - o * o)
        root = np.sqrt(1 + kk[..., None] * np.sin(h[..., None] + nodes * z[..., None]) ** 2)
        old, w = w, lam + f * o * z * ((2 - f) / (1 + (1 - f) * root) @ weights)
        if w.size == 0 or np.abs(w - old).max() < 1e-16:  # near points settle at once
            break
    return k.WGS84_B * z * (root @ weights), np.degrees(a) % 360


def surface(lat, lon) -> np.ndarray:
    """Points of the ellipsoid as (x, y, z) metres; the chord of two is never longer than their geodesic."""
    la, lo = np.radians(lat), np.radians(lon)
    e2 = k.WGS84_F * (2 - k.WGS84_F)
    a = k.WGS84_B / (1 - k.WGS84_F)
    n = a / np.sqrt(1 - e2 * np.sin(la) ** 2)
    return np.stack([n * np.cos(la) * np.cos(lo), n * np.cos(la) * np.sin(lo), n * (1 - e2) * np.sin(la)], axis=-1)


def ground_speed(track: np.ndarray, tas: float, wind_speed: float, wind_dir: float) -> np.ndarray:
    """Ground speed on each track; nan where the wind does not allow it."""
    if wind_speed < k.CALM_WIND:
        return np.full(np.shape(track), float(tas))
    theta = np.radians(wind_dir - track)
    ratio = wind_speed / tas * np.sin(theta)
    ok = np.abs(ratio) <= 1
    gs = tas * np.cos(np.arcsin(np.where(ok, ratio, 0))) - wind_speed * np.cos(theta)
    return np.where(ok & (gs > 0), gs, np.nan)
