"""Solvers at the size of whole tracks, and against the plain forms that they replace."""

import math
import time

import numpy as np
import pytest

from aeroframe.operators import solvers as s


def loops_by_restart(p):
    """Splice the first crossing pair and begin again."""
    pts = [tuple(x) for x in p.tolist()]

    def crossing():
        for i in range(len(pts) - 3):
            (ax, ay), (bx, by) = pts[i], pts[i + 1]
            for j in range(i + 2, len(pts) - 1):
                (cx, cy), (dx, dy) = pts[j], pts[j + 1]
                ux, uy, ex, ey = bx - ax, by - ay, dx - cx, dy - cy
                if abs(den := ux * ey - uy * ex) >= 1e-10:
                    t, u = ((cx - ax) * ey - (cy - ay) * ex) / den, ((cx - ax) * uy - (cy - ay) * ux) / den
                    if 1e-9 < t < 1 - 1e-9 and 1e-9 < u < 1 - 1e-9:
                        return i, j, (ax + t * ux, ay + t * uy)
        return None

    while hit := crossing():
        i, j, x = hit
        pts[i + 1 : j + 1] = [x]
    return np.array(pts)


def test_loops_are_cut_as_by_restarting():
    rng = np.random.default_rng(3)
    for k in range(120):
        n = int(rng.integers(0, 60))
        step = rng.normal(0, 1, (n, 2)) * rng.choice([1.0, 1.0, 1.0, 20.0], (n, 1))
        p = np.cumsum(step + rng.uniform(-0.5, 0.5, 2), axis=0) if k % 3 else rng.integers(0, 12, (n, 2)).astype(float)
        got, want = s.cut_loops(p), loops_by_restart(p)
        assert got.shape == want.shape and (got == want).all()


def test_loops_of_long_lines():
    rng = np.random.default_rng(4)
    walk = np.cumsum(rng.normal(0, 1, (100_000, 2)), axis=0)
    drift = np.cumsum(rng.normal(0.3, 1, (100_000, 2)), axis=0)
    flat = np.stack([np.arange(1e5), np.zeros(100_000)], axis=1)
    flat[50_000] = (50_000, 1e6)  # one segment as long as a million others
    for p in (walk, drift, flat):
        began = time.perf_counter()
        out = s.cut_loops(p)
        assert time.perf_counter() - began < 60 and (out[[0, -1]] == p[[0, -1]]).all()


def dense(values, first):
    out = np.zeros((len(values), len(values)))
    for i, (f, row) in enumerate(zip(first, values)):
        for k, v in enumerate(row):
            if 0 <= f + k < len(values):
                out[i, f + k] += v
    return out


@pytest.mark.parametrize("n", [4, 5, 6, 50, 400])
def test_banded_solve_equals_the_dense_one(n):
    rng = np.random.default_rng(n)
    points = np.stack([np.cumsum(rng.uniform(0.1, 30, n)), rng.uniform(0, 200, n)], axis=1)
    spline = s.Spline(points)
    rows = s.basis(spline.knots, spline.params)
    assert np.allclose(spline.control, np.linalg.solve(dense(*rows), points), rtol=1e-9, atol=1e-6)
    assert np.allclose(spline.at(spline.params), points, atol=1e-6)
    cut = s.lumped(*rows)
    assert np.allclose(dense(*cut).sum(axis=1), 1)
    near = s.Spline(points, lump=True)
    assert np.allclose(near.control, np.linalg.solve(dense(*cut), points), rtol=1e-9, atol=1e-6)
    assert np.allclose(near.at(np.array([0.0, 1.0])), points[[0, -1]])


def test_spline_of_a_long_track():
    n = 100_000
    x = np.arange(n) * 10.0
    points = np.stack([x, 400 + 50 * np.sin(x / 900) + np.random.default_rng(1).normal(0, 2, n)], axis=1)
    began = time.perf_counter()
    spline = s.Spline(points)
    assert np.allclose(spline.at(spline.params), points, atol=1e-6) and time.perf_counter() - began < 30


def plan(rng, n, size=0.05):
    """Ends of n lines, as a plan has them, or scattered."""
    a = rng.uniform(47, 47 + size, (n, 2)) - [0, 39]
    b = a + rng.uniform(-0.004, 0.004, (n, 2))
    entry, leave = np.empty((2 * n, 2)), np.empty((2 * n, 2))
    entry[::2], entry[1::2], leave[::2], leave[1::2] = a, b, b, a
    return entry, leave


def total(tour, legs, own):
    t = np.array(tour)
    return float(legs.price(t[:-1], t[1:]).sum() + own[t].sum())


def restarted_two_opt(tour, cost, own):
    """Every stretch re-added at every move, the first that gains taken."""
    n, better = len(tour), True
    while better:
        better = False
        for i in range(n - 2):
            for j in range(i + 2, n):
                new = [*tour[: i + 1], *(x ^ 1 for x in reversed(tour[i + 1 : j + 1])), *tour[j + 1 :]]
                value = lambda t: sum(cost[x, y] for x, y in zip(t, t[1:])) + sum(own[x] for x in t)
                if value(tour) - value(new) > s.GAIN:
                    tour, better = new, True
    return tour


def windy(m, az):
    gs = 12 + 4 * np.cos(np.radians(az))
    return np.where((az > 350) | (az < 5), s.FAR, 300.0 * m / gs)


@pytest.mark.parametrize("costs", [None, windy])
def test_routes_are_no_worse_than_by_plain_two_opt(costs):
    rng = np.random.default_rng(6)
    ratios, apart = [], []
    for _ in range(8):
        entry, leave = plan(rng, 14)
        legs = s.Legs(entry, leave, costs, 300 / 16 if costs else 1.0)
        own = np.zeros(28) if costs is None else legs._price(entry, leave)
        home = np.array([47.0, 8.0])
        start = s.nearest_order(home, legs, own)
        wide = s.Legs(entry, leave, costs, 300 / 16 if costs else 1.0, matrix=False)
        assert s.nearest_order(home, wide, own) == start  # bounds by chords change nothing
        got, plain = s.two_opt(start, legs, own), restarted_two_opt(start, legs.matrix, own)
        assert sorted(x >> 1 for x in got) == list(range(14)) and got[0] == start[0]
        assert total(restarted_two_opt(got, legs.matrix, own), legs, own) == pytest.approx(total(got, legs, own))  # no move is left
        count = lambda t: sum(legs.matrix[x, y] >= s.FAR for x, y in zip(t, t[1:])) + sum(own[x] >= s.FAR for x in t)
        assert count(got) <= count(start)
        if count(got) == count(plain) == 0:
            ratios.append(total(got, legs, own) / total(plain, legs, own))
            apart.append(total(s.two_opt(start, wide, own), wide, own) / total(plain, legs, own))
    assert np.mean(ratios) < 1.02 and np.mean(apart) < 1.05 if ratios else costs is not None


def test_route_of_many_lines():
    rng = np.random.default_rng(9)
    entry, leave = plan(rng, 5000, 0.5)
    began = time.perf_counter()
    legs = s.Legs(entry, leave)
    own = np.zeros(10_000)
    start = s.nearest_order(np.array([47.0, 8.0]), legs, own)
    tour = s.two_opt(start, legs, own)
    assert time.perf_counter() - began < 120
    assert sorted(x >> 1 for x in tour) == list(range(5000)) and math.fsum([total(tour, legs, own)]) < 0.93 * total(start, legs, own)
