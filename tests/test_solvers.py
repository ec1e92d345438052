"""Group solvers: turns, routes, corridors, trajectories, polygons."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from aeroframe.functions import geometry as geo
from aeroframe.operators import solvers as s


def test_dubins_reaches_every_target():
    rng = np.random.default_rng(1)
    n = 400
    x, y = rng.uniform(-900, 900, n), rng.uniform(-900, 900, n)
    h0, h1 = rng.uniform(0, 6.28, n), rng.uniform(0, 6.28, n)
    best, parts, total = s.dubins(np.zeros(n), np.zeros(n), h0, x, y, h1, 150.0)
    assert set(best) >= {0, 1, 2, 3}
    for k in range(n):
        pts = s.discretise(0, 0, h0[k], 150.0, int(best[k]), parts[k])
        assert math.hypot(pts[-1, 0] - x[k], pts[-1, 1] - y[k]) < 1e-6
    assert (total >= np.hypot(x, y) - 1e-6).all()


def test_dubins_straight_and_close():
    best, parts, total = s.dubins(0, 0, 0, 200, 0, 0, 50)
    assert total == pytest.approx(200)
    _, _, total = s.dubins(0, 0, 0, 0, 60, math.pi, 50)
    assert math.isfinite(float(total))


def test_ramps_report_their_miss(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 400.0, 300.0, 1.0, 100.0)], "event_id long, x0 double, y0 double, h0 double, x1 double, y1 double, h1 double, radius double")
    rows = s.turn_points(df, speed=30, bank_deg=20, roll_rate=15).collect()
    assert rows[-1].x == 400 and rows[0].closure_error_m > 0


def _lines(spark, n, plan=1):
    rows = [(plan, i, 47.0, 8.0 + 0.002 * i, 47.01, 8.0 + 0.002 * i) for i in range(n)]
    return spark.createDataFrame(rows, "plan_id long, line_index int, start_lat double, start_lon double, end_lat double, end_lon double")


def test_route_is_serpentine(spark):
    r = s.distance_route(_lines(spark, 5)).orderBy("visit_seq").collect()
    assert [x.line_index for x in r] == [0, 1, 2, 3, 4] and [x.reversed for x in r] == [False, True, False, True, False]
    assert r[0].total_m < r[0].in_order_m


def test_route_of_one_line_has_its_launch_leg(spark):
    lines = _lines(spark, 1).withColumns({"launch_lat": F.lit(46.9), "launch_lon": F.lit(8.0)})
    assert s.distance_route(lines, launch="columns").first().total_m > 10_000


def test_energy_route_prefers_tailwind(spark):
    lines = _lines(spark, 1).withColumns({"launch_lat": F.lit(47.005), "launch_lon": F.lit(8.0)})
    r = s.energy_route(lines, tas=12.0, wind_speed=6.0, wind_dir=0.0, k1=0.04, k2=900.0, launch="columns").first()
    assert r.reversed  # wind from the north: the line is flown south


def test_offsets():
    line = np.array([[0.0, 0.0], [500, 0], [500, 500]])
    left = s.offset_polyline(line, 50, 200)
    assert len(left) == 3 and left[1] == pytest.approx([450, 50])
    assert len(s.offset_polyline(np.array([[0.0, 0], [200, 0], [0, 1e-9]]), 50, 200)) == 4


def test_cut_loops_and_resample():
    cut = s.cut_loops(np.array([[0.0, 0], [10, 0], [10, 10], [5, 10], [5, -5]]))
    assert cut.tolist() == [[0, 0], [5, 0], [5, -5]]
    assert len(s.resample(np.array([[0.0, 0], [100, 0]]), 30)) == 5


def test_band_stays_above_floor_and_converges():
    x = np.arange(0, 5000, 10.0)
    h = 500 + 30 * np.sin(2 * np.pi * x / 2000)
    alt, it, ok = s.elastic_band(h, 10.0, h + 50)
    assert ok and (alt >= h + 50 - 1e-9).all()


def test_spline_goes_through_its_points():
    pts = np.stack([np.arange(12.0), np.sin(np.arange(12.0))], axis=1)
    sp = s.Spline(pts)
    dense = sp.at(np.linspace(0, 1, 5001))
    for p in pts:
        assert np.hypot(*(dense - p).T).min() < 2e-3
    steps = np.hypot(*np.diff(sp.uniform(0.5), axis=0).T)
    assert np.allclose(steps[:-1], 0.5, atol=0.01)


def test_point_in_polygon(spark):
    ring = lambda *pts: F.array(*(F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon")) for a, b in pts))
    square, hole, two = ring((0, 0), (0, 10), (10, 10), (10, 0)), F.array(ring((4, 4), (4, 6), (6, 6), (6, 4))), ring((0, 0), (1, 1))
    df = spark.createDataFrame([(5.0, 5.0), (1.0, 1.0), (11.0, 1.0)], "lat double, lon double")
    assert [r.x for r in df.select(geo.in_polygon(df.lat, df.lon, square, hole).alias("x")).collect()] == [False, True, False]
    assert not df.select(geo.in_ring(df.lat, df.lon, two).alias("x")).first().x


def test_clip_keeps_runs(spark):
    way = spark.createDataFrame([(1, 0, k, 0.5, k * 0.1, 10.0) for k in range(-3, 14)], "plan_id long, line_index int, wp_index int, lat double, lon double, alt double")
    v = lambda a, b: F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon"))
    poly = spark.range(1).select(F.lit(1).cast("long").alias("plan_id"), F.array(v(0, 0.05), v(0, 0.95), v(1, 0.95), v(1, 0.05)).alias("exterior"), F.array(F.array(v(0.4, 0.42), v(0.4, 0.58), v(0.6, 0.58), v(0.6, 0.42))).alias("holes"))
    rows = geo.clip_lines(way, poly).orderBy("clip_index", "clip_wp").collect()
    assert {r.clip_index for r in rows} == {0, 1}
    assert rows[0].border and rows[0].lon == pytest.approx(0.05, abs=1e-5)
    assert [round(r.lon, 2) for r in rows if r.clip_index == 0][-1] == 0.42


def test_plan_from_box_to_energy(spark):
    from aeroframe.plans import queries_missions as m

    sf = "/root/testdata/sf0.001"
    rows = {r.plan_id: r for r in m.box_to_energy(spark, sf).collect()}
    assert len(rows) == 25
    for k, r in rows.items():
        assert r.lines > 3 and r.turns == r.lines - 1 and r.waypoints >= 2 * r.lines
        assert r.total_j == pytest.approx(r.survey_j + r.turn_j, abs=0.2) and r.time_s > 0 and r.closure_error_m < 120
        assert r.lowest >= 600 + 10 * k  # never below the planned height
        assert r.feasible == (r.total_j <= 0.8 * 250 * 3600)


def test_routes_are_locally_best_and_near_the_best(spark):
    """By brute force over orders and directions: no route of few lines is far from the best, and none can be bettered by one reversal."""
    from itertools import permutations, product

    rng = np.random.default_rng(5)
    for plan in range(6):
        n = 5
        rows = [(plan, i, *(rng.uniform(47, 47.05, 1).tolist() + rng.uniform(8, 8.05, 1).tolist()), *(rng.uniform(47, 47.05, 1).tolist() + rng.uniform(8, 8.05, 1).tolist())) for i in range(n)]
        df = spark.createDataFrame(rows, "plan_id long, line_index int, start_lat double, start_lon double, end_lat double, end_lon double")
        got = s.distance_route(df).orderBy("visit_seq").collect()
        ends = [((r[2], r[3]), (r[4], r[5])) for r in rows]
        home = (min(r[2] for r in rows), min(r[3] for r in rows))
        from aeroframe.functions import numeric

        places = [home, *(q for e in ends for q in e)]
        d = numeric.inverse(*(np.array(v) for v in zip(*[(a[0], a[1], b[0], b[1]) for a in places for b in places], strict=True)))[0].reshape(len(places), -1)

        def cost(order, flips):
            at, total = 0, 0.0
            for i, f in zip(order, flips, strict=True):
                a, b = 1 + 2 * i, 2 + 2 * i
                total += d[at, b if f else a]
                at = a if f else b
            return total

        best = min(cost(o, f) for o in permutations(range(n)) for f in product((0, 1), repeat=n))
        order, flips = [r.line_index for r in got], [int(r.reversed) for r in got]
        mine = cost(order, flips)
        assert mine == pytest.approx(got[0].total_m, abs=1e-3) and best - 1e-6 <= mine <= 1.35 * best
        for i in range(n - 2):
            for j in range(i + 2, n):
                o = [*order[: i + 1], *order[i + 1 : j + 1][::-1], *order[j + 1 :]]
                f = [*flips[: i + 1], *(1 - x for x in flips[i + 1 : j + 1][::-1]), *flips[j + 1 :]]
                assert cost(o, f) > mine - 2e-3


def test_dubins_is_no_longer_than_any_family():
    """Against the six families written out by their textbook formulas in the unit frame."""

    def families(d, a, b):
        sa, sb, ca, cb, cab = math.sin(a), math.sin(b), math.cos(a), math.cos(b), math.cos(a - b)
        turn = lambda x: x % (2 * math.pi)
        t = math.atan2(cb - ca, d + sa - sb)
        if (p2 := 2 + d * d - 2 * cab + 2 * d * (sa - sb)) >= 0:
            yield turn(t - a) + math.sqrt(p2) + turn(b - t)  # LSL
        t = math.atan2(ca - cb, d - sa + sb)
        if (p2 := 2 + d * d - 2 * cab + 2 * d * (sb - sa)) >= 0:
            yield turn(a - t) + math.sqrt(p2) + turn(t - b)  # RSR
        if (p2 := -2 + d * d + 2 * cab + 2 * d * (sa + sb)) >= 0:
            p = math.sqrt(p2)
            t = math.atan2(-ca - cb, d + sa + sb) - math.atan2(-2, p)
            yield turn(t - a) + p + turn(t - b)  # LSR
        if (p2 := -2 + d * d + 2 * cab - 2 * d * (sa + sb)) >= 0:
            p = math.sqrt(p2)
            t = math.atan2(ca + cb, d - sa - sb) - math.atan2(2, p)
            yield turn(a - t) + p + turn(b - t)  # RSL
        if abs(c := (6 - d * d + 2 * cab + 2 * d * (sa - sb)) / 8) <= 1:
            p = 2 * math.pi - math.acos(c)
            t = turn(a - math.atan2(ca - cb, d - sa + sb) + p / 2)
            yield t + p + turn(a - b - t + p)  # RLR
        if abs(c := (6 - d * d + 2 * cab + 2 * d * (sb - sa)) / 8) <= 1:
            p = 2 * math.pi - math.acos(c)
            t = turn(math.atan2(cb - ca, d + sa - sb) - a + p / 2)
            yield t + p + turn(b - a - t + p)  # LRL

    rng = np.random.default_rng(3)
    for _ in range(600):
        x, y = rng.uniform(-900, 900, 2) * rng.choice([0.3, 1.0])
        h0, h1 = rng.uniform(0, 6.28, 2)
        _, _, total = s.dubins(0.0, 0.0, h0, x, y, h1, 120.0)
        way = math.atan2(y, x)
        best = min(families(math.hypot(x, y) / 120, (h0 - way) % (2 * math.pi), (h1 - way) % (2 * math.pi)))
        assert float(total) == pytest.approx(120 * best, abs=1e-6)


def test_offsets_of_corridors_keep_their_distance():
    rng = np.random.default_rng(2)
    for _ in range(30):
        turn = np.cumsum(rng.uniform(-0.6, 0.6, 8))
        line = np.cumsum(np.stack([np.cos(turn), np.sin(turn)], axis=1) * rng.uniform(150, 300, (8, 1)), axis=0)
        for d in (-40.0, 25.0):
            out = s.offset_polyline(line, d, 2 * 80.0)
            for (a, b), (p, q) in zip(zip(line, line[1:]), zip(out, out[1:])):
                u = (b - a) / np.hypot(*(b - a))
                left = np.array([-u[1], u[0]])
                assert (p - a) @ left == pytest.approx(d, abs=1e-6) and (q - a) @ left == pytest.approx(d, abs=1e-6)


def test_polygons_of_any_size_meet_their_points(spark):
    """From a hundredth of a degree to half the globe, against the polygon test on all pairs."""
    v = lambda a, b: F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lon"))
    boxes = [(k, -60 + 10 * k, 5 * k, 0.004 * 4**k) for k in range(9)]
    polygons = None
    for k, lat, lon, size in boxes:
        one = spark.range(1).select(F.lit(k).alias("poly_id"), F.array(v(lat, lon), v(lat, lon + size), v(lat + size, lon + size), v(lat + size, lon)).alias("exterior"), F.array().cast("array<array<struct<lat: double, lon: double>>>").alias("holes"))
        polygons = one if polygons is None else polygons.union(one)
    points = spark.range(3000).selectExpr("id as seq", "cast(id * 37 % 1700 as double) * 1e-1 - 84.98763e0 as lat", "cast(id * 91 % 3600 as double) * 1e-1 - 179.98767e0 as lon")
    near = spark.createDataFrame([(10_000 + k, lat + size / 3, lon + size / 3) for k, lat, lon, size in boxes], "seq long, lat double, lon double")
    points = points.union(near)
    got = sorted((r.seq, r.poly_id) for r in geo.points_in_polygons(points, polygons, cell=0.01).select("seq", "poly_id").collect())
    rows = points.collect()
    assert got == sorted((r.seq, k) for r in rows for k, lat, lon, size in boxes if lat < r.lat < lat + size and lon < r.lon < lon + size)


def test_band_follows_its_definition():
    """Against forces written out point by point."""
    tension, torsion, push, decay, gravity = s.SPRINGS
    rng = np.random.default_rng(6)
    floor = 550 + np.cumsum(rng.uniform(-4, 4, 40))
    alt, steps = floor.tolist(), 0
    for _ in range(500):
        forces = []
        for i in range(40):
            gap = alt[i] - floor[i]
            f = -gravity + (push / decay * math.exp(-gap / decay) if gap < 5 * decay else 0.0)
            if 0 < i < 39:
                bend = alt[i + 1] - 2 * alt[i] + alt[i - 1]
                f += tension * bend + 4 * torsion * bend / 10.0**2
            else:
                f -= tension * (alt[i] - alt[1 if i == 0 else 38])
            forces.append(f)
        moves = [0.3 * f for f in forces]
        alt = [max(a + m, b) for a, m, b in zip(alt, moves, floor, strict=True)]
        steps += 1
        if max(map(abs, moves)) < 0.01:
            break
    got, count, ok = s.elastic_band(floor - 50, 10.0, floor)
    assert count == steps and np.allclose(got, alt, atol=1e-9) and ok == (steps < 500 or max(map(abs, moves)) < 0.01)


def test_basis_follows_its_recursion():
    def value(knots, i, p, u):
        if p == 0:
            last = knots[i + 1] == knots[-1] and knots[i] < knots[i + 1]
            return 1.0 if knots[i] <= u < knots[i + 1] or (last and u == knots[-1]) else 0.0
        out = 0.0
        if knots[i + p] > knots[i]:
            out += (u - knots[i]) / (knots[i + p] - knots[i]) * value(knots, i, p - 1, u)
        if knots[i + p + 1] > knots[i + 1]:
            out += (knots[i + p + 1] - u) / (knots[i + p + 1] - knots[i + 1]) * value(knots, i + 1, p - 1, u)
        return out

    rng = np.random.default_rng(7)
    knots = np.concatenate([[0.0] * 4, np.sort(rng.uniform(0, 1, 5)), [1.0] * 4])
    u = np.concatenate([rng.uniform(0, 1, 30), [0.0, 1.0]])
    expected = [[value(knots.tolist(), i, 3, x) for i in range(len(knots) - 4)] for x in u.tolist()]
    values, first = s.basis(knots, u)
    dense = np.zeros((len(u), len(knots) - 4))
    np.put_along_axis(dense, first[:, None] + np.arange(4), values, axis=1)
    assert np.allclose(dense, expected, atol=1e-12)
    # curvature of a circle, and how far a lifted curve's control points may be too low
    t = np.linspace(0, math.pi, 60)
    circle = s.Spline(np.stack([100 * np.cos(t), 100 * np.sin(t)], axis=1))
    assert np.allclose(circle.curvature(np.linspace(0.1, 0.9, 20)), 0.01, rtol=2e-2)
    assert circle.lift(lambda x: np.full(len(x), 50.0)) > 0 and (circle.control[:, 1] >= 50).all()


def test_no_loop_is_left():
    rng = np.random.default_rng(8)

    def crossings(p):
        found = 0
        for i in range(len(p) - 1):
            for j in range(i + 2, len(p) - 1):
                d1, d2 = p[i + 1] - p[i], p[j + 1] - p[j]
                den = d1[0] * d2[1] - d1[1] * d2[0]
                if abs(den) > 1e-10:
                    w = p[j] - p[i]
                    t, u = (w[0] * d2[1] - w[1] * d2[0]) / den, (w[0] * d1[1] - w[1] * d1[0]) / den
                    found += 1e-9 < t < 1 - 1e-9 and 1e-9 < u < 1 - 1e-9
        return found

    for _ in range(25):
        p = np.cumsum(rng.uniform(-50, 60, (14, 2)), axis=0)
        out = s.cut_loops(p)
        assert crossings(out) == 0 and (out[0] == p[0]).all() and (out[-1] == p[-1]).all()
        assert crossings(p) or len(out) == len(p)


def test_whole_groups_across_batches(spark):
    """Groups stay whole and in order wherever Arrow batches end, and small results leave in few batches."""
    rows = spark.range(0, 3000).selectExpr("case when id % 7 > 0 then id % 7 end as g", "id as k", "1 as one")
    long = spark.range(0, 500).selectExpr("100L as g", "id as k", "1 as one")

    def run(batch, starts):
        key, k = batch.column("g").to_pylist(), batch.column("k").to_numpy()
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            assert (np.diff(k[a:b]) > 0).all()
            yield pa.record_batch({"g": pa.array([key[a]], pa.int64()), "n": pa.array([b - a], pa.int64())})

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 97)
    try:
        found = {r.g: r.n for r in s.whole_groups(rows.union(long), "g", "k", run, "g long, n long").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert found == {None: 429, **{g: 429 if g <= 3 else 428 for g in range(1, 7)}, 100: 500}


def _alone(h, dx, rate, threshold, most):
    """One band, step by step."""
    tension, torsion, push, decay, gravity = s.SPRINGS
    alt = floor = h + 50.0
    for it in range(1, most + 1):
        before = np.concatenate([alt[:1], alt[:-1]])
        after = np.concatenate([alt[1:], alt[-1:]])
        curve = after - 2 * alt + before
        pull = tension * curve + 4 * torsion * curve / dx**2
        pull[0], pull[-1] = -tension * (alt[0] - alt[1]), -tension * (alt[-1] - alt[-2])
        gap = alt - floor
        move = rate * (pull + np.where(gap < 5 * decay, push / decay * np.exp(-np.minimum(gap, 5 * decay) / decay), 0.0) - gravity)
        alt = np.maximum(alt + move, floor)
        if np.abs(move).max() < threshold:
            return alt, it, True
    return alt, most, False


def test_bands_of_a_batch_are_as_each_alone():
    rng = np.random.default_rng(5)
    sizes = np.array([3, 40, 1, 4, 2, 900, 7, 33, 3])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    h = np.cumsum(rng.normal(0, [3.0], starts[-1])) + 400
    h[starts[1] : starts[2]] = 10.0  # flat: it stands still long before the others
    dx = np.linspace(5, 20, len(sizes))
    for threshold, most in ((0.01, 500), (0.0, 6), (0.3, 80)):
        alt, steps, still = s.relax(dx, h + 50.0, starts, 0.3, threshold, most)
        for g, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            want = _alone(h[a:b], dx[g], 0.3, threshold, most) if b - a >= 3 else (h[a:b] + 50.0, 0, False)
            assert (steps[g], still[g]) == want[1:]
            np.testing.assert_allclose(alt[a:b], want[0], rtol=0, atol=1e-9)


def test_tracks_are_relaxed_and_smoothed_once(spark):
    """One pass of Python over whole profiles; bands and splines are not computed again for the report."""
    from aeroframe.plans.catalog import QUERIES

    plan = QUERIES["trj_06_07_track_waypoints"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("FlatMapGroupsInPandas") == 1


def test_band_waypoints_are_those_of_bands_then_splines(spark):
    rows = spark.range(600).selectExpr("concat('p', id % 7) as profile", "cast(id div 7 as int) as k", "(id div 7) * 10e0 as x", "400e0 + (id * 37) % 90 as terrain")
    rows = rows.where("profile <> 'p3' or k < 3").repartition(3)
    got = {(r.profile, r.wp): (r.x, r.alt, r.terrain) for r in s.band_waypoints(rows, 25.0, 50.0).collect()}
    bands = s.elastic_bands(rows, 50.0)
    want = {(r.profile, r.wp): (r.x, r.alt, r.terrain) for r in s.smooth_waypoints(bands.where("profile <> 'p3'"), 25.0, 50.0).collect()}
    assert got == want and {k for k, _ in got} == {f"p{k}" for k in (0, 1, 2, 4, 5, 6)}
    low = {r.profile: r.too_low for r in s.spline_reports(bands.where("profile <> 'p3'"), 50.0).collect()}
    assert {r.profile: r.below for r in s.band_waypoints(rows, 25.0, 50.0).select("profile", "below").distinct().collect()} == low
