"""Queries of terrain, geoid, datums, overlap and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.constants import DATUMS
from ..functions.program import Program, num
from ..operators import planning, solvers, terrain
from . import domain as d
from .queries_geometry import _GRID_SQL, grid
from .registry import query, rounded

#: Synthetic posts: 30 x 30 a tile, over the tiles the telemetry and the missions touch; some posts are void.
ROWS = 30
_H = "cast(case when (r * 31 + c * 17 + tl * 7 + tn) % 97 = 0 then -32767e0 else 300e0 + 40e0 * sin(cast(r as double) / 5e0) + 25e0 * cos(cast(c as double) / 4e0) + cast((tl * 13 + tn * 5) % 50 as double) end as float)"
_TILES = [(47, 8), *((40 + k, 2 * k) for k in range(25)), *((40 + k, 2 * k - 1) for k in range(25)), (0, 0), (-1, -1), (10, 179), (10, -180)]
_TILE_LIST = sorted(set(_TILES))


def posts(spark: SparkSession) -> DataFrame:
    tiles = spark.createDataFrame(_TILE_LIST, "tl int, tn int")
    rows = tiles.join(spark.range(ROWS * ROWS).selectExpr(f"cast(id div {ROWS} as int) as r", f"cast(id % {ROWS} as int) as c"))
    return rows.selectExpr("tl as tile_lat", "tn as tile_lon", "r as row", "c as col", f"{_H} as h")


def dem_cells(spark: SparkSession) -> DataFrame:
    return terrain.cells(posts(spark), ["tile_lat", "tile_lon"])


_POSTS_SQL = f"select tl as tile_lat, tn as tile_lon, r as row, c as col, {_H} as h from (values {', '.join(map(str, _TILE_LIST))}) as t(tl, tn), (select cast(k // {ROWS} as int) as r, cast(k % {ROWS} as int) as c from (select unnest(range({ROWS * ROWS})) as k))"
_DEM_WITH = f"posts as materialized ({_POSTS_SQL})"


def sampled_sql(points: str, lat: str = "lat", lon: str = "lon") -> str:
    """Oracle of ``terrain.sample``: four joins to posts, with the neighbours clamped at tile edges (needs ``posts``)."""
    placed = terrain.place(lat, lon, num(ROWS), num(ROWS)).sql(points)
    four = f"""select p.*, cast(a.h as double) as h00, cast(b.h as double) as h01, cast(c.h as double) as h10, cast(d.h as double) as h11, a.h is not null as tile_found from ({placed}) p
left join posts a on a.tile_lat = p.tile_lat and a.tile_lon = p.tile_lon and a.row = p.row and a.col = p.col
left join posts b on b.tile_lat = p.tile_lat and b.tile_lon = p.tile_lon and b.row = p.row and b.col = least(p.col + 1, {ROWS - 1})
left join posts c on c.tile_lat = p.tile_lat and c.tile_lon = p.tile_lon and c.row = least(p.row + 1, {ROWS - 1}) and c.col = p.col
left join posts d on d.tile_lat = p.tile_lat and d.tile_lon = p.tile_lon and d.row = least(p.row + 1, {ROWS - 1}) and d.col = least(p.col + 1, {ROWS - 1})"""
    return terrain.BILINEAR.sql(four)


_MIXED = d.View("events", {"id": "event_id", "lat": "case when event_id % 3 = 0 then 47e0 + cast((event_id * 37) % 1000 as double) * 1e-3 when event_id % 3 = 1 then cast((event_id * 7919) % 172001 as double) * 1e-3 - 86e0 else 91e0 end", "lon": "case when event_id % 3 = 0 then 8e0 + cast((event_id * 91) % 1000 as double) * 1e-3 else cast((event_id * 104729) % 360000 as double) * 1e-3 - 180e0 end"})


@query("dem_01_02_bilinear", f"with {_DEM_WITH} select id, coord_ok, tile_found, round(elevation, 4) + 0e0 as elevation from ({sampled_sql(_MIXED.sql)})")
def bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bilinear_over(spark, sf_dir, dem_cells(spark))


def bilinear_over(spark: SparkSession, sf_dir: str, cells: DataFrame) -> DataFrame:
    return terrain.sample(_MIXED.load(spark, sf_dir), cells, ROWS, ROWS).selectExpr("id", "coord_ok", "tile_found", "round(elevation, 4) + 0e0 as elevation")


# ---------------------------------------------------------------- geoid

_G96 = "17e0 + 20e0 * sin(radians(cast(r - 90 as double) * 2e0)) + 15e0 * cos(radians(cast(c as double)))"
_G08 = "17.5e0 + 20e0 * sin(radians(cast(r - 90 as double) * 2e0)) + 15e0 * cos(radians(cast(c as double)))"


def geoid_cells(spark: SparkSession, formula: str) -> DataFrame:
    """A one-degree geoid grid of a closed form: rows 0 to 180 from -90, columns 0 to 359 from -180."""
    posts = spark.range(181 * 360).selectExpr("cast(id div 360 as int) as r", "cast(id % 360 as int) as c").selectExpr("r as row", "c as col", f"{formula} as h")
    return terrain.cells(posts.withColumn("grid", F.lit(1)), ["grid"], wrap=True).drop("grid")


def undulation_sql(points: str, formula: str) -> str:
    at = lambda r, c: formula.replace("cast(r - 90 as double)", f"cast({r} - 90 as double)").replace("cast(c as double)", f"cast({c} as double)")
    cells = ", ".join(f"case when g_row is not null and g_col is not null then {at(f'(g_row + {i})', f'((g_col + {j}) % 360)')} end as n{i}{j}" for i in (0, 1) for j in (0, 1))
    placed = terrain.GEOID_PLACE.sql(points)
    valued = terrain.GEOID_VALUE.sql(f"select *, {cells} from ({placed})")
    return f"select * exclude (g_row, g_col, g_fr, g_fc, n00, n01, n10, n11) from ({valued})"


@query("geo_08_undulation", f"select id, round(undulation, 6) + 0e0 as undulation from ({undulation_sql(_MIXED.sql, _G96)})")
def undulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.undulation(_MIXED.load(spark, sf_dir), geoid_cells(spark, _G96)).selectExpr("id", "round(undulation, 6) + 0e0 as undulation")


@query("geo_09_heights", f"select id, round(h + undulation, 6) + 0e0 as ellipsoidal, round(h - undulation, 6) + 0e0 as orthometric from ({undulation_sql(d.POINTS.sql, _G08)})")
def heights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.undulation(d.POINTS.load(spark, sf_dir), geoid_cells(spark, _G08)).selectExpr("id", "round(h + undulation, 6) + 0e0 as ellipsoidal", "round(h - undulation, 6) + 0e0 as orthometric")


_REPORT_OUT = {"id": None, "elevation_source": None, "strict_status": None, "orthometric_m": 4, "geoid_n": 5, "ellipsoidal_m": 4}


@query("dem_03_04_terrain_report", f"with {_DEM_WITH} select {', '.join(rounded(_REPORT_OUT))} from ({terrain.REPORT.sql(sampled_sql(undulation_sql(_MIXED.sql, _G08)))})")
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = terrain.undulation(_MIXED.load(spark, sf_dir), geoid_cells(spark, _G08))
    return terrain.REPORT.apply(terrain.sample(points, dem_cells(spark), ROWS, ROWS)).selectExpr(*rounded(_REPORT_OUT))


_FROM = "case seq % 4 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(DATUMS)) + " end"
_TO = "case (seq // 4) % 4 " + " ".join(f"when {i} then '{x}'" for i, x in enumerate(DATUMS)) + " end"
_CONVERTED = terrain.convert_datum("alt", "source", "target")


@query(
    "geo_10_datum_conversion",
    f"""with {_DEM_WITH} select vehicle, seq, source, target, round({_CONVERTED}, 4) + 0e0 as height from (
  select *, {_FROM} as source, {_TO} as target, coalesce(elevation, 0e0) + n2008 as terrain_ellipsoidal
  from ({sampled_sql(f"select * exclude (undulation), undulation as n2008 from ({undulation_sql(f'select * exclude (undulation), undulation as n96 from ({undulation_sql(d.TELEMETRY.sql, _G96)})', _G08)})")}))""",
)
def datum_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = terrain.undulation(d.TELEMETRY.load(spark, sf_dir), geoid_cells(spark, _G96)).withColumnRenamed("undulation", "n96")
    p = terrain.undulation(p, geoid_cells(spark, _G08)).withColumnRenamed("undulation", "n2008")
    p = terrain.sample(p, dem_cells(spark), ROWS, ROWS)
    p = p.selectExpr("*", f"{_FROM} as source", f"{_TO.replace('//', 'div')} as target", "coalesce(elevation, 0e0) + n2008 as terrain_ellipsoidal")
    return p.selectExpr("vehicle", "seq", "source", "target", f"round({_CONVERTED}, 4) + 0e0 as height")


@query("dem_05_srt_01_distinct_tiles", f"select tile_lat, tile_lon, count(*) as points from (select cast(floor(lat) as int) as tile_lat, cast(floor(lon) as int) as tile_lon from ({d.POINTS.sql})) group by tile_lat, tile_lon")
def distinct_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = d.POINTS.load(spark, sf_dir).selectExpr("cast(floor(lat) as int) as tile_lat", "cast(floor(lon) as int) as tile_lon")
    return p.groupBy("tile_lat", "tile_lon").agg(F.count("*").alias("points"))


# ---------------------------------------------------------------- overlap and adjustment

_WAY = {"alt": "msl", "half_across": "90e0", "half_along": "60e0", "fov_h_rad": "12e-1", "side_pct": "30e0", "nominal_agl": "agl"}
_KEY = ["plan_id", "line_index", "wp_index"]
_WAY_SQL = f"select plan_id, line_index, wp_index, lat, lon, azimuth, line_spacing, {', '.join(f'{v} as {k}' for k, v in _WAY.items())} from ({_GRID_SQL})"
_OFFSETS_SQL = ", ".join(f"({k}, {a}e0, {b}e0)" for k, a, b in planning.FOOTPRINT)
_SAMPLES_SQL = planning.SAMPLE.sql(f"select w.*, sample, side, ahead from ({_WAY_SQL}) w, (values {_OFFSETS_SQL}) as o(sample, side, ahead)")


def waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).selectExpr("plan_id", "cast(line_index as bigint) as line_index", "cast(wp_index as bigint) as wp_index", "lat", "lon", "azimuth", "line_spacing", *(f"{v} as {k}" for k, v in _WAY.items()))


@query("dem_06_footprints", f"select plan_id, line_index, wp_index, sample, round(p_lat, 8) + 0e0 as p_lat, round(p_lon, 8) + 0e0 as p_lon from ({_SAMPLES_SQL})")
def footprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.footprints(waypoints(spark, sf_dir)).selectExpr(*_KEY, "sample", "round(p_lat, 8) + 0e0 as p_lat", "round(p_lon, 8) + 0e0 as p_lon")


_PEAK_SQL = f"select plan_id, line_index, wp_index, max(coalesce(elevation, 0e0)) as peak, count(*) filter (elevation is null) as no_terrain from ({sampled_sql(f'select plan_id, line_index, wp_index, p_lat, p_lon from ({_SAMPLES_SQL})', 'p_lat', 'p_lon')}) group by plan_id, line_index, wp_index"
_OVERLAP_SQL = terrain.OVERLAP.sql(f"select w.*, peak, no_terrain from ({_WAY_SQL}) w join ({_PEAK_SQL}) k on w.plan_id = k.plan_id and w.line_index = k.line_index and w.wp_index = k.wp_index")
_OVERLAP_OUT = dict.fromkeys(_KEY) | {"peak": 2, "no_terrain": None, "actual_agl": 2, "actual_swath": 1, "overlap_pct": 2, "violation": None}


@query("dem_07_overlap_check", f"with {_DEM_WITH} select {', '.join(rounded(_OVERLAP_OUT))} from ({_OVERLAP_SQL})")
def overlap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.overlap(waypoints(spark, sf_dir), dem_cells(spark), ROWS, ROWS, _KEY).selectExpr(*rounded(_OVERLAP_OUT))


@query("dem_08_09_terrain_adjust", f"with {_DEM_WITH} select plan_id, line_index, wp_index, round(case when no_terrain = 5 then alt else adjusted_alt end, 2) + 0e0 as alt, case when no_terrain = 5 then 'NO_TERRAIN' else 'OK' end as status, 'EGM2008' as datum from ({_OVERLAP_SQL})")
def terrain_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = terrain.overlap(waypoints(spark, sf_dir), dem_cells(spark), ROWS, ROWS, _KEY)
    return o.selectExpr(*_KEY, "round(case when no_terrain = 5 then alt else adjusted_alt end, 2) + 0e0 as alt", "case when no_terrain = 5 then 'NO_TERRAIN' else 'OK' end as status", "'EGM2008' as datum")


# ---------------------------------------------------------------- profiles

_KINDS = ("flat", "sinusoid", "step", "sawtooth")
_PROFILE_SQL = f"select profile, k, x, {terrain.synthetic_profile('profile')} as terrain from (select profile, k, cast(k as double) * 10e0 as x from (select unnest(range(501)) as k), (values {', '.join(f'({chr(39)}{x}{chr(39)})' for x in _KINDS)}) as p(profile))"


def profile(spark: SparkSession) -> DataFrame:
    from ..operators.solvers import profiles

    return profiles(spark)


@query("src_13_synthetic_profiles", f"select profile, cast(k as integer) as k, x, round(terrain, 6) + 0e0 as terrain from ({_PROFILE_SQL})")
def synthetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile(spark).selectExpr("profile", "k", "x", "round(terrain, 6) + 0e0 as terrain")


@query(
    "trj_01_floor_modes",
    f"select profile, cast(k as integer) as k, {', '.join(f'round({v}, 6) + 0e0 as {n}' for n, v in {'floor_terrain': 'terrain + 50', 'floor_mean': 'greatest(terrain + 50, avg(terrain) over w + 50)', 'floor_median': 'greatest(terrain + 50, median(terrain) over w + 50)', 'floor_fixed': 'greatest(terrain + 50, 540e0)', 'floor_max': 'max(terrain) over w + 50'}.items())} from ({_PROFILE_SQL}) window w as (partition by profile)",
)
def floor_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = terrain.floors(profile(spark), ["profile"], 50.0, 540.0)
    return f.selectExpr("profile", "k", *(f"round({n}, 6) + 0e0 as {n}" for n in ("floor_terrain", "floor_mean", "floor_median", "floor_fixed", "floor_max")))


@query(
    "dem_10_along_profile",
    f"""with p as ({_PROFILE_SQL}) select q.seq, q.profile, round(a.terrain + (u - k0) * (coalesce(b.terrain, a.terrain) - a.terrain), 6) + 0e0 as terrain
from (select *, cast(floor(u) as bigint) as k0 from (select seq, case seq % 4 when 0 then 'flat' when 1 then 'sinusoid' when 2 then 'step' else 'sawtooth' end as profile, least(greatest((cast((seq * 7) % 6000 as double) * 1e0 - 300e0) / 10e0, 0e0), 500e0) as u from ({d.TELEMETRY.sql}))) q
join p a on a.profile = q.profile and a.k = k0 left join p b on b.profile = q.profile and b.k = k0 + 1""",
)
def along_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = d.TELEMETRY.load(spark, sf_dir).selectExpr("seq", "case seq % 4 when 0 then 'flat' when 1 then 'sinusoid' when 2 then 'step' else 'sawtooth' end as profile", "cast((seq * 7) % 6000 as double) - 300e0 as x")
    return terrain.along_profile(points, profile(spark).select("profile", "k", "terrain"), 10.0, ["profile"]).selectExpr("seq", "profile", "round(terrain, 6) + 0e0 as terrain")


_PATH = Program({"alt": "terrain + 50e0 + 8e0 * sin(x / 90e0)"})
_METRICS = {"profile": None, "min_clearance_margin": 6, "max_slope": 6, "max_curvature": 8, "max_slope_jump": 6, "rms_deviation": 6, "max_deviation": 6, "pct_within_5pct": 6, "n_waypoints": None}


@query(
    "trj_08_profile_metrics",
    f"""select {', '.join(rounded(_METRICS))} from (
select profile, min(m) as min_clearance_margin, coalesce(max(abs(s)), 0e0) as max_slope, coalesce(max(kappa), 0e0) as max_curvature, coalesce(max(case when n > 2 then abs(s - s0) end), 0e0) as max_slope_jump,
  sqrt(avg(m * m)) as rms_deviation, max(abs(m)) as max_deviation, avg(case when abs(m) <= 2.5e0 then 100e0 else 0e0 end) as pct_within_5pct, count(*) as n_waypoints
from (select *, lag(s) over w as s0, 2 * abs(dx0 * dy - dy0 * dx) / nullif(sqrt(dx0 * dx0 + dy0 * dy0) * sqrt(dx * dx + dy * dy) * sqrt((dx + dx0) * (dx + dx0) + (dy + dy0) * (dy + dy0)), 0) as kappa
  from (select *, dy / dx as s from (select *, alt - terrain - 50e0 as m, x - lag(x) over w as dx, alt - lag(alt) over w as dy, lag(x) over w - lag(x, 2) over w as dx0, lag(alt) over w - lag(alt, 2) over w as dy0, row_number() over w as n
    from ({_PATH.sql(_PROFILE_SQL)}) window w as (partition by profile order by x))) window w as (partition by profile order by x)) group by profile)""",
)
def profile_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.profile_metrics(_PATH.apply(profile(spark)), ["profile"], 50.0).selectExpr(*rounded(_METRICS))


# ---------------------------------------------------------------- profiles cut from telemetry

#: A profile a vehicle: its heights as terrain, ten metres apart.
_TRACK_SQL = f"select cast(vehicle as varchar) as profile, cast(row_number() over (partition by vehicle order by seq) - 1 as integer) as k, cast(row_number() over (partition by vehicle order by seq) - 1 as double) * 10e0 as x, alt as terrain from ({d.TELEMETRY.sql})"


def track_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.TELEMETRY.load(spark, sf_dir)
    n = F.row_number().over(Window.partitionBy("vehicle").orderBy("seq")) - 1
    return rows.select(F.col("vehicle").cast("string").alias("profile"), n.cast("int").alias("k"), (n.cast("double") * 10.0).alias("x"), F.col("alt").alias("terrain"))


@query(
    "trj_01_track_floors",
    f"select profile, k, {', '.join(f'round({v}, 6) + 0e0 as {n}' for n, v in {'floor_terrain': 'terrain + 50', 'floor_mean': 'greatest(terrain + 50, avg(terrain) over w + 50)', 'floor_median': 'greatest(terrain + 50, median(terrain) over w + 50)', 'floor_fixed': 'greatest(terrain + 50, 540e0)', 'floor_max': 'max(terrain) over w + 50'}.items())} from ({_TRACK_SQL}) window w as (partition by profile)",
)
def track_floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = terrain.floors(track_profiles(spark, sf_dir), ["profile"], 50.0, 540.0)
    return f.selectExpr("profile", "k", *(f"round({n}, 6) + 0e0 as {n}" for n in ("floor_terrain", "floor_mean", "floor_median", "floor_fixed", "floor_max")))


def _relaxed(source: str, steps: int) -> str:
    """Steps of an elastic band, written out: tension and bending from the neighbours, a push near the floor, gravity."""
    tension, torsion, push, decay, gravity = solvers.SPRINGS
    rate = solvers.PLAN_RELAXATION[0]
    for _ in range(steps):
        pull = f"case when a0 is null then {-tension} * (alt - a1) when a1 is null then {-tension} * (alt - a0) else ({tension} + 4 * {torsion} / 100e0) * (a1 - 2 * alt + a0) end"
        near = f"case when alt - floor < 5 * {decay} then {push} / {decay} * exp(-(alt - floor) / {decay}) else 0e0 end"
        source = f"select profile, k, floor, greatest(alt + {rate} * ({pull} + {near} - {gravity}), floor) as alt from (select *, lag(alt) over w as a0, lead(alt) over w as a1 from ({source}) window w as (partition by profile order by k))"
    return source


@query(
    "trj_02_track_bands",
    f"select profile, k, round(alt, 6) as alt, 6 as iterations from ({_relaxed(f'select profile, k, terrain + 50e0 as floor, terrain + 50e0 as alt from ({_TRACK_SQL}) qualify count(*) over (partition by profile) >= 3', 6)})",
)
def track_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six steps of the band over each track (a threshold of zero never ends it sooner)."""
    bands = solvers.elastic_bands(track_profiles(spark, sf_dir), 50.0, threshold=0.0, most=6)
    return bands.where("iterations > 0").selectExpr("profile", "k", "round(alt, 6) as alt", "iterations")


@query("trj_03_track_splines", f"select profile, k, round(x, 4) as x, round(terrain, 4) as alt from ({_TRACK_SQL}) qualify count(*) over (partition by profile) >= 4")
def track_splines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spline through each track's heights, evaluated where it was fitted: it goes through every one."""
    rows = solvers.spline_heights(track_profiles(spark, sf_dir).withColumnRenamed("terrain", "alt"))
    return rows.selectExpr("profile", "k", "round(x, 4) as x", "round(alt, 4) as alt")


@query(
    "trj_06_07_track_waypoints",
    f"select profile, true as even, 0e0 as from_x, max(x) as to_x, 0 as below from ({_TRACK_SQL}) group by profile having count(*) >= 4",
)
def track_waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pursuit waypoints along the relaxed, smoothed and lifted tracks: evenly spaced from end to end, control points clear of the floor."""
    way = solvers.band_waypoints(track_profiles(spark, sf_dir), spacing=25.0, clearance=50.0)
    w = Window.partitionBy("profile").orderBy("wp")
    step = way.withColumns({"gone": F.hypot(F.col("x") - F.lag("x").over(w), F.col("alt") - F.lag("alt").over(w)), "last": F.lead("wp").over(w).isNull()})
    even = F.bool_and(F.col("gone").isNull() | F.col("last") | (F.col("gone") <= 25.001))
    return step.groupBy("profile").agg(even.alias("even"), (F.round(F.min_by("x", "wp"), 6) + 0.0).alias("from_x"), F.round(F.max_by("x", "wp"), 6).alias("to_x"), F.max("below").alias("below"))


@query(
    "trj_08_track_metrics",
    f"""select {', '.join(rounded(_METRICS))} from (
select profile, min(m) as min_clearance_margin, coalesce(max(abs(s)), 0e0) as max_slope, coalesce(max(kappa), 0e0) as max_curvature, coalesce(max(case when n > 2 then abs(s - s0) end), 0e0) as max_slope_jump,
  sqrt(avg(m * m)) as rms_deviation, max(abs(m)) as max_deviation, avg(case when abs(m) <= 2.5e0 then 100e0 else 0e0 end) as pct_within_5pct, count(*) as n_waypoints
from (select *, lag(s) over w as s0, 2 * abs(dx0 * dy - dy0 * dx) / nullif(sqrt(dx0 * dx0 + dy0 * dy0) * sqrt(dx * dx + dy * dy) * sqrt((dx + dx0) * (dx + dx0) + (dy + dy0) * (dy + dy0)), 0) as kappa
  from (select *, dy / dx as s from (select *, alt - terrain - 50e0 as m, x - lag(x) over w as dx, alt - lag(alt) over w as dy, lag(x) over w - lag(x, 2) over w as dx0, lag(alt) over w - lag(alt, 2) over w as dy0, row_number() over w as n
    from ({_PATH.sql(_TRACK_SQL)}) window w as (partition by profile order by x))) window w as (partition by profile order by x)) group by profile)""",
)
def track_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain.profile_metrics(_PATH.apply(track_profiles(spark, sf_dir)), ["profile"], 50.0).selectExpr(*rounded(_METRICS))
