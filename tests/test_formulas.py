"""Known answers and invariants of the formula programs."""

import math

import pytest
from pyspark.sql import functions as F

from aeroframe.functions import geodesy as g
from aeroframe.functions import numeric
from aeroframe.functions import physics as p
from aeroframe.functions.program import Program

UTM = [(0.0, 0.0, 166021.4, 0.0), (45.0, 9.0, 500000.0, 4982950.4), (51.5074, -0.1278, 699316.2, 5710163.8), (83.0, 0.0, 459200.3, 9217519.4), (-33.8688, 151.2093, 334368.6, 6250948.3)]


def test_utm_vectors_and_inverse(spark):
    df = spark.createDataFrame([(a, b) for a, b, _, _ in UTM], "lat double, lon double")
    rows = (g.utm_forward() + g.utm_inverse("easting", "northing", "zone", "hemisphere")).apply(df).collect()
    for r, (lat, lon, e, n) in zip(rows, UTM, strict=True):
        assert abs(r.easting - e) < 0.5 and abs(r.northing - n) < 0.5
        assert abs(r.inv_lat - lat) < 1e-9 and abs(r.inv_lon - lon) < 1e-9


@pytest.mark.parametrize(("lon", "zone"), [(-180.0, 1), (180.0, 1), (179.9999, 60), (6.0, 32), (-6.0, 30), (0.0, 31)])
def test_utm_zones(spark, lon, zone):
    assert spark.range(1).selectExpr(f"{g.utm_zone(f'{lon}e0')} as z").first().z == zone


def test_geodesic_known_lengths(spark):
    df = spark.createDataFrame([(40.6, -73.8, 51.6, -0.5), (0.0, 0.0, 0.0, 1.0), (10.0, 20.0, 10.0, 20.0), (10.0, 179.9, 10.0, -179.9)], "a double, b double, c double, d double")
    got = [r.geo_distance for r in g.geodesic_inverse("a", "b", "c", "d", nodes=16, updates=8).apply(df).collect()]
    assert abs(got[0] - 5551759.400) < 2e-3
    assert abs(got[1] - 111319.49079327) < 1e-6
    assert got[2] == 0
    assert 21000 < got[3] < 22000


def test_direct_undoes_inverse(spark):
    df = spark.range(500).selectExpr("cast(id % 160 as double) - 80e0 as a", "cast(id * 7 % 360 as double) - 180e0 as b", "cast(id * 13 % 360 as double) as z", "cast(100 + id * 37 as double) as s")
    ends = g.geodesic_direct("a", "b", "z", "s").apply(df)
    back = g.geodesic_inverse("a", "b", "to_lat", "to_lon").apply(ends)
    worst = back.select(F.max(F.abs(F.col("geo_distance") - F.col("s")))).first()[0]
    assert worst < 1e-6


def test_numpy_geodesic_agrees(spark):
    d, a = numeric.inverse([40.6], [-73.8], [51.6], [-0.5])
    assert abs(d[0] - 5551759.400) < 2e-3


def _wind(spark, track, tas, speed, source):
    df = spark.createDataFrame([(track, tas, speed, source)], "track double, tas double, wind_speed double, wind_dir double")
    return p.wind_triangle().apply(df).first()


def test_wind_triangle(spark):
    assert _wind(spark, 45.0, 50.0, 0.0, 10.0).heading == pytest.approx(45)
    assert _wind(spark, 0.0, 50.0, 10.0, 0.0).ground_speed == pytest.approx(40)
    assert _wind(spark, 0.0, 50.0, 10.0, 180.0).ground_speed == pytest.approx(60)
    side = _wind(spark, 0.0, 50.0, 10.0, 90.0)
    assert side.wca_deg == pytest.approx(math.degrees(math.asin(0.2)))
    assert _wind(spark, 0.0, 5.0, 10.0, 90.0).wind_status == "CROSSWIND_TOO_STRONG"
    assert _wind(spark, 0.0, 5.0, 10.0, 0.0).wind_status == "NO_PROGRESS"
    assert _wind(spark, None, 5.0, 1.0, 0.0).wind_status == "INVALID_PARAMETER"


def test_camera_known_answer(spark):
    df = spark.createDataFrame([(8.8, 13.2, 8.8, 5472, 3648, 182.4, 0.05, 30.0, 60.0, 0.0)], "focal_mm double, width_mm double, height_mm double, width_px int, height_px int, agl double, gsd double, side_pct double, end_pct double, crab_deg double")
    r = p.camera().apply(df).first()
    assert r.required_agl == pytest.approx(182.4) and r.swath_w == pytest.approx(273.6) and r.swath_h == pytest.approx(182.4)
    assert r.line_spacing == pytest.approx(191.52) and r.photo_interval == pytest.approx(72.96)


def test_lidar_known_answer(spark):
    df = spark.createDataFrame([(240000.0, 100.0, 70.0, 0.0, 100.0, 5.0, 8.0), (240000.0, 100.0, 70.0, 0.1, 100.0, 5.0, 8.0)], "prr double, scan_rate double, fov_deg double, loss double, agl double, speed double, density double")
    a, b = p.lidar().apply(df).collect()
    assert a.lidar_swath == pytest.approx(140.04, abs=0.01) and a.point_density == pytest.approx(342.75, abs=0.02)
    assert b.point_density == pytest.approx(308.5, abs=0.1) and a.required_speed == pytest.approx(214.2, abs=0.1)
    assert a.across_spacing == pytest.approx(0.0583, abs=1e-4) and a.along_spacing == pytest.approx(0.025)


def test_program_prints_and_runs(spark):
    q = Program({"_a": "x + 1e0"}, {"b": "_a * 2e0"})
    assert q.apply(spark.createDataFrame([(1.0,)], "x double")).first().b == 4.0
    assert "exclude (_a)" in q.sql("select 1e0 as x")


def test_datums_round_trip(spark):
    from aeroframe.operators.terrain import convert_datum

    df = spark.createDataFrame([(500.0, 40.0, 41.0, 300.0)], "h double, n96 double, n2008 double, terrain_ellipsoidal double")
    for a in ("EGM96", "EGM2008", "WGS84_ELLIPSOIDAL", "AGL"):
        for b in ("EGM96", "EGM2008", "WGS84_ELLIPSOIDAL", "AGL"):
            one = df.withColumn("v", F.expr(convert_datum("h", f"'{a}'", f"'{b}'")))
            assert one.withColumn("w", F.expr(convert_datum("v", f"'{b}'", f"'{a}'"))).first().w == pytest.approx(500.0, abs=1e-9)


def test_energy_known_answers(spark):
    """Written out from the definitions: hover and wing coefficients, turns, climbs, a segment."""
    row = "cast(2 as double) as mass, 1e0 as cd, 5e-2 as frontal, 7e-1 as eta, {wing} as wing_area, {wing} as wingspan, {wing} as oswald, 2e-1 as rotor_area, 3e-1 as regen"
    at = lambda wing: p.power().apply(spark.range(1).selectExpr(*[x.strip() for x in row.format(wing=wing).split(", ")]))
    w = 2 * 9.80665
    rotor, wing = at("cast(null as double)").first(), at("5e-1").first()
    assert rotor.k1 == pytest.approx(0.5 * 1.225 * 1.0 * 0.05 / 0.7) and rotor.k2 == pytest.approx(w * w / (2 * 1.225 * 0.2 * 0.7))
    assert wing.k1 == pytest.approx(0.5 * 1.225 * 0.5 * 1.0 / 0.7) and wing.k2 == pytest.approx(2 * w * w / (1.225 * math.pi * 0.25 * 0.5 * 0.7))
    out = at("cast(null as double)").selectExpr(f"{p.power_at('12e0')} as level", f"{p.turn_power_at('12e0', '30e0')} as turn", f"{p.climb_power('2e0')} as up", f"{p.climb_power('-2e0')} as down", f"{p.segment_energy('300e0', '20e0', '10e0', '12e0')} as leg", f"{p.segment_energy('0e0', '20e0', '10e0', '12e0')} as none").first()
    level = rotor.k1 * 12**3 + rotor.k2 / 12
    n = 1 / math.cos(math.radians(30))
    assert out.level == pytest.approx(level) and out.turn == pytest.approx(rotor.k1 * 12**3 + rotor.k2 * n * n / 12)
    assert out.up == pytest.approx(w * 2 / 0.7) and out.down == pytest.approx(-w * 2 * 0.3)
    assert out.leg == pytest.approx((level + w * (20 / 30) / 0.7) * 30) and out.none == 0


def test_limits_and_radii_known_answers(spark):
    df = spark.createDataFrame([(20.0, 12.0, 0.5, 30.0, 3.0, 2.0), (20.0, 12.0, 0.5, -30.0, 3.0, 2.0)], "speed double, max_pitch_deg double, accel_g double, rise_m double, climb double, descent double")
    up, down = p.limits().apply(df).collect()
    assert up.max_slope == pytest.approx(math.tan(math.radians(12))) and up.max_curvature == pytest.approx(0.5 * 9.81 / 400)
    assert up.min_lookahead == pytest.approx(200) and down.min_lookahead == pytest.approx(300)
    r = spark.range(1).selectExpr(f"{p.safe_radius('15e0', '5e0', '25e0')} as safe", f"{p.turn_radius('15e0', '25e0')} as turn", f"{p.obstacle_buffer('120e0')} as buffer").first()
    g0 = 9.80665 * math.tan(math.radians(25))
    assert r.safe == pytest.approx(400 / g0) and r.turn == pytest.approx(225 / g0) and r.buffer == 1200


def test_grid_covers_its_box(spark):
    """An east-west box at the equator: lines run north, spacing and interval are those asked for, and the box is covered."""
    from aeroframe.operators import planning

    df = spark.createDataFrame([(1, 0.0, 0.01, 10.0, 10.02, 0.0, 200.0, 100.0)], "plan_id long, min_lat double, max_lat double, min_lon double, max_lon double, azimuth double, line_spacing double, photo_interval double")
    rows = planning.area_grid(df).collect()
    lines = {r.line_index for r in rows}
    assert len(lines) == math.ceil(0.02 * 111319.4908 / 200) + 1
    one = sorted(((r.wp_index, r.lat, r.lon) for r in rows if r.line_index == 0))
    assert (one[1][1] - one[0][1]) * 110574.3 == pytest.approx(100, abs=0.1) and one[0][2] == pytest.approx(one[-1][2], abs=1e-9)
    assert min(r.lat for r in rows) <= 1e-6 and max(r.lat for r in rows) >= 0.01 - 1e-6 and min(r.lon for r in rows) <= 10 + 1e-6 and max(r.lon for r in rows) >= 10.02 - 1e-6


def test_grid_of_the_known_plan(spark):
    """A hundredth of a degree at the equator with a ground sample of 5 cm and laps of 30 and 60 %: 7 lines of 17 waypoints."""
    from aeroframe.operators import planning

    df = spark.createDataFrame([(1, 0.0, 0.01, 0.0, 0.01, 0.0, 191.52, 72.96)], "plan_id long, min_lat double, max_lat double, min_lon double, max_lon double, azimuth double, line_spacing double, photo_interval double")
    rows = planning.area_grid(df).collect()
    assert len(rows) == 7 * 17 and {r.line_index for r in rows} == set(range(7))
