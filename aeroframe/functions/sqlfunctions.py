"""Geodesics and planners as functions of Spark SQL.

``geodesic_inverse`` and ``corridor_arrays`` take Arrow batches; turns and corridors, which walk along a path,
are Arrow table functions for ``lateral`` calls. A lateral call is one Python call a row: over a table, use
``lateral view inline(corridor_arrays(...))``, which has the same rows. The DataFrame operators compile
geodesics instead, which is faster where the formula is wanted for every row.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import numeric


def _inverse(lat1: pa.Array, lon1: pa.Array, lat2: pa.Array, lon2: pa.Array) -> pa.Array:
    columns = [np.asarray(x.cast(pa.float64()).fill_null(float("nan"))) for x in (lat1, lon1, lat2, lon2)]
    bad = np.isnan(columns).any(axis=0)
    metres, azimuth = numeric.inverse(*(np.where(bad, 0.0, x) for x in columns))
    return pa.StructArray.from_arrays([pa.array(metres), pa.array(azimuth)], ["distance", "azimuth"], mask=pa.array(bad))


@F.udtf(returnType="seq int, x double, y double", useArrow=True)
class TurnPoints:
    """Points of the shortest turn between two poses (angles counter-clockwise from east), without the first."""

    def eval(self, x0: float, y0: float, h0: float, x1: float, y1: float, h1: float, speed: float, bank_deg: float):
        from aeroframe.operators import solvers

        if None in (x0, y0, h0, x1, y1, h1, speed, bank_deg):
            return
        radius = speed * speed / (9.80665 * math.tan(math.radians(bank_deg)))
        word, parts, _ = solvers.dubins(x0, y0, h0, x1, y1, h1, radius)
        points = solvers.discretise(x0, y0, h0, radius, int(word), parts.reshape(3))
        points[-1] = (x1, y1)
        for k, (x, y) in enumerate(points[1:].tolist()):
            yield k, x, y


@F.udtf(returnType="pass int, wp int, x double, y double", useArrow=True)
class CorridorPoints:
    """Waypoints of corridor passes along a planar centre line, given as arrays of x and y."""

    def eval(self, xs: list, ys: list, width: float, passes: int, interval: float):
        from aeroframe.operators import solvers

        if xs is None or ys is None or len(xs) < 2 or len(xs) != len(ys) or width is None or width <= 0 or passes not in (1, 3, 5) or not interval or interval <= 0:
            return
        line = np.stack([np.asarray(xs, float), np.asarray(ys, float)], axis=1)
        line = line[np.concatenate([[True], np.hypot(*np.diff(line, axis=0).T) >= 1e-6])]
        if len(line) < 2:
            return
        for k in range(passes):
            d = 0.0 if passes == 1 else -width / 2 + k * width / (passes - 1)
            for i, (x, y) in enumerate(solvers.resample(solvers.cut_loops(solvers.offset_polyline(line, d, 2 * width)), interval).tolist()):
                yield k, i, x, y


def _offset(width, passes, k):
    """Of pass k, across the line."""
    return np.where(passes == 1, 0.0, -width / 2 + k * width / np.maximum(passes - 1, 1))


def _straight(line: np.ndarray, width: np.ndarray, passes: np.ndarray, interval: np.ndarray) -> tuple[np.ndarray, ...]:
    """All waypoints of straight centre lines (x0, y0, x1, y1): how many each line has, and pass, wp, x and y of each."""
    own = np.repeat(np.arange(len(line)), passes)
    k = np.arange(len(own)) - np.repeat(np.cumsum(passes) - passes, passes)
    step = line[:, 2:] - line[:, :2]
    normal = np.stack([-step[:, 1], step[:, 0]], axis=1) / np.hypot(step[:, 0], step[:, 1])[:, None]
    across = _offset(width[own], passes[own], k)
    side = np.where(np.abs(across) < 1e-10, 0.0, across)[:, None] * normal[own]
    a, b = line[own, :2] + side, line[own, 2:] + side
    length = np.hypot(b[:, 0] - a[:, 0], b[:, 1] - a[:, 1])
    even = np.floor(length / interval[own] + 1e-9).astype(np.int64) + 1
    n = even + 1  # and the end
    at = np.repeat(np.arange(len(own)), n)
    wp = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    gone = wp * interval[own][at]
    end = (wp == even[at]) | (gone >= length[at])
    x, y = (np.where(end, b[at, c], ((b[:, c] - a[:, c]) / length)[at] * gone + a[at, c]) for c in (0, 1))
    return np.bincount(own, n, len(line)).astype(np.int64), k[at].astype(np.int32), wp.astype(np.int32), x, y


def _corridor_arrays(xs: pa.Array, ys: pa.Array, width: pa.Array, passes: pa.Array, interval: pa.Array) -> pa.Array:
    """Lines of two vertices, which have no corners, are done together; others one by one."""
    ends = lambda v: np.asarray(pc.fill_null(pc.list_value_length(v), -1))
    number = lambda v: v.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    w, n, step = number(width), number(passes), number(interval)
    planned = (w > 0) & np.isin(n, (1, 3, 5)) & (step > 0) & np.isfinite(w) & np.isfinite(step)
    two = planned & (ends(xs) == 2) & (ends(ys) == 2)
    pick = pa.array(np.flatnonzero(two))
    line = np.concatenate([v.take(pick).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, 2) for v in (xs, ys)], axis=1)[:, [0, 2, 1, 3]]
    long = np.hypot(line[:, 2] - line[:, 0], line[:, 3] - line[:, 1])
    rows, line = np.flatnonzero(two)[(long >= 1e-6) & np.isfinite(long)], line[(long >= 1e-6) & np.isfinite(long)]
    count = np.zeros(len(xs), np.int64)
    count[rows], *columns = _straight(line, w[rows], n[rows].astype(np.int64), step[rows])
    source = np.repeat(rows, count[rows])
    others = np.flatnonzero(planned & ~two)
    if len(others):
        few = pa.array(others)
        parts = [np.array(list(CorridorPoints.func.eval(None, *row)), float).reshape(-1, 4) for row in zip(*(v.take(few).to_pylist() for v in (xs, ys, width, passes, interval)), strict=True)]
        count[others] = [len(p) for p in parts]
        more = np.concatenate(parts)
        order = np.argsort(np.concatenate([source, np.repeat(others, count[others])]), kind="stable")
        columns = [np.concatenate([c, more[:, k].astype(c.dtype)])[order] for k, c in enumerate(columns)]
    found = pa.StructArray.from_arrays([pa.array(c) for c in columns], ["pass", "wp", "x", "y"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), found)


def register(spark: SparkSession) -> None:
    """Make ``geodesic_inverse`` (null where an argument is null or nan), ``turn_points``, ``corridor_points`` and ``corridor_arrays`` known to this session's SQL."""
    spark.udf.register("geodesic_inverse", F.arrow_udf(_inverse, "struct<distance: double, azimuth: double>"))
    spark.udf.register("corridor_arrays", F.arrow_udf(_corridor_arrays, "array<struct<pass: int, wp: int, x: double, y: double>>"))
    spark.udtf.register("turn_points", TurnPoints)
    spark.udtf.register("corridor_points", CorridorPoints)
