"""Whole plans: LiDAR grids, and a camera plan from its box to its energy in one go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import physics as p
from ..functions.program import Program
from ..operators import planning, solvers, terrain, tracks
from . import domain as d
from .queries_geometry import grid, grid_sql, polygons
from .queries_terrain import ROWS, dem_cells
from .registry import query, rounded

# ---------------------------------------------------------------- LiDAR plans

#: Scanner and overlap of each mission; every other one flies at a fixed height above sea level.
_SCANNER = {"prr": "100000e0 + cast(plan_id % 5 as double) * 50000e0", "scan_rate": "100e0", "fov_deg": "60e0 + cast(plan_id % 3 as double) * 5e0", "loss": "1e-1", "speed": "8e0", "density": "50e0", "side_pct": "20e0 + cast(plan_id % 2 as double) * 10e0", "waypoint_interval": "75e0"}
#: A LiDAR plan carries a unit sensor and no ground sample distance, so all exports take it like a camera plan.
_UNIT = {"focal_mm": "1e0", "width_mm": "1e0", "height_mm": "1e0", "width_px": "1", "height_px": "1", "target_gsd": "0e0", "end_pct": "0e0"}
_SCAN = Program(_SCANNER) + p.lidar() + p.lidar_plan() + Program(_UNIT | {"datum": "case when plan_id % 2 = 0 then 'AGL' else 'EGM2008' end", "alt": "case when plan_id % 2 = 0 then agl else msl end"})
_GOOD = "lidar_status = 'OK' and lidar_line_spacing > 0e0 and lidar_interval > 0e0"


def lidar_missions(missions: DataFrame) -> DataFrame:
    """Missions with the spacing of their scanner in place of a camera's; those that cannot be planned are left out."""
    rows = _SCAN.apply(missions).where(_GOOD)
    return rows.drop("line_spacing", "photo_interval").withColumnsRenamed({"lidar_line_spacing": "line_spacing", "lidar_interval": "photo_interval"})


_LIDAR_SQL = grid_sql(f"select * exclude (line_spacing, photo_interval, lidar_line_spacing, lidar_interval), lidar_line_spacing as line_spacing, lidar_interval as photo_interval from ({_SCAN.sql(d.MISSIONS.sql)}) where {_GOOD}")
_LIDAR_OUT = {"plan_id": None, "line_index": None, "wp_index": None, "lat": 8, "lon": 8, "alt": 3, "datum": None, "line_spacing": 6, "point_density": 6, "target_gsd": 3}


@query("gen_03_lidar_plan", f"select {', '.join(rounded(_LIDAR_OUT))} from (select * replace (cast(line_index as integer) as line_index, cast(wp_index as integer) as wp_index) from ({_LIDAR_SQL}))")
def lidar_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.area_grid(lidar_missions(d.MISSIONS.load(spark, sf_dir))).selectExpr(*rounded(_LIDAR_OUT))


# ---------------------------------------------------------------- from box to energy

_KEY = ["plan_id", "line_index", "wp_index"]
#: Speed, bank and roll rate of the turns, wind, and the platform that flies.
SPEED, BANK, ROLL = 15.0, 25.0, 15.0
_AIR = {"tas": f"{SPEED}e0", "wind_speed": "4e0", "wind_dir": "cast((plan_id * 41) % 360 as double)", "mass": "1.4e0", "cd": "1e0", "frontal": "4e-2", "wing_area": "cast(null as double)", "wingspan": "cast(null as double)", "oswald": "cast(null as double)", "rotor_area": "12e-2", "eta": "65e-2", "regen": "1e-1", "battery_wh": "250e0"}


def flown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waypoints of every plan as flown: grid, cut to its border, lifted over the terrain, put in order, joined by turns."""
    cut = geo.clip_lines(grid(spark, sf_dir).withColumn("alt", F.col("msl")), polygons(spark, sf_dir))
    lines = cut.select("plan_id", F.col("clip_index").cast("int").alias("line_index"), F.col("clip_wp").cast("int").alias("wp_index"), "lat", "lon", "alt")
    camera = d.MISSIONS.load(spark, sf_dir).selectExpr("plan_id", "azimuth", "line_spacing", "agl as nominal_agl", "90e0 as half_across", "60e0 as half_along", "12e-1 as fov_h_rad", "30e0 as side_pct")
    over = terrain.overlap(lines.join(camera, "plan_id"), dem_cells(spark), ROWS, ROWS, _KEY)
    lifted = over.select(*_KEY, "lat", "lon", F.when(F.col("no_terrain") < 5, F.col("adjusted_alt")).otherwise(F.col("alt")).alias("alt"))
    ends = lifted.groupBy("plan_id", "line_index").agg(*(f(c, "wp_index").alias(f"{n}_{c}") for n, f in (("start", F.min_by), ("end", F.max_by)) for c in ("lat", "lon")))
    ordered = solvers.reorder(lifted, solvers.distance_route(ends)).select("plan_id", F.col("visit_seq").alias("line_index"), F.col("new_wp").alias("wp_index"), "lat", "lon", "alt")
    return solvers.connect_lines(ordered, SPEED, BANK, ROLL)


@query("plan_box_to_energy")
def box_to_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per plan: lines, waypoints and turns as flown, heights, and energy in the wind with its verdict."""
    path = flown(spark, sf_dir).withColumn("seq", F.col("leg_index").cast("long") * 1_000_000 + F.col("wp"))
    shape = path.groupBy("plan_id").agg(F.countDistinct(F.when(~F.col("transit"), F.col("leg_index"))).alias("lines"), F.count_if(~F.col("transit")).alias("waypoints"), F.countDistinct(F.when(F.col("transit"), F.col("leg_index"))).alias("turns"), F.min("alt").alias("lowest"), F.max("closure_error_m").alias("closure_error_m"))
    legs = tracks.geodesic_legs(path, ["plan_id"], "seq").selectExpr("*", "alt - alt0 as rise", *(f"{v} as {k}" for k, v in _AIR.items()))
    energy = tracks.mission_energy(tracks.wind_legs(legs, "tas", "wind_speed", "wind_dir"), ["plan_id"], "tas")
    out = {"plan_id": None, "lines": None, "waypoints": None, "turns": None, "lowest": 2, "closure_error_m": 3, "survey_j": 1, "turn_j": 1, "climb_j": 1, "total_j": 1, "time_s": 2, "feasible": None}
    return shape.join(energy, "plan_id").selectExpr(*rounded(out))
