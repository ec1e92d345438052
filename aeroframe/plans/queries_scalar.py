"""Queries of single-row formulas: geodesy, sensors, LiDAR, limits, wind, energy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy as g
from ..functions import physics as p
from ..functions import sqlfunctions
from ..functions.constants import PLATFORM_LIMITS, SENSOR_PRESETS
from ..functions.program import Program, num
from . import domain as d
from .registry import ORACLE_SQL, QUERIES, query, rounded


def formula(name: str, view: d.View, program: Program, out: dict[str, int | None]) -> None:
    """Register a formula program over a view."""
    QUERIES[name] = lambda spark, sf_dir: program.apply(view.load(spark, sf_dir)).selectExpr(*rounded(out))
    ORACLE_SQL[name] = f"select {', '.join(rounded(out))} from ({program.sql(view.sql)})"


formula(
    "src_01_02_05_tile_keys",
    d.POINTS,
    Program({"tile_lat": "cast(floor(lat) as int)", "tile_lon": "cast(floor(lon) as int)"}, {"stem": g.tile_stem("lat", "lon"), "tile_cols": g.tile_columns("tile_lat")}, {"file_name": "concat('DEM_', stem, '.tif')"}),
    {"id": None, "tile_lat": None, "tile_lon": None, "stem": None, "file_name": None, "tile_cols": None},
)
formula("geo_03_04_05_utm_forward", d.POINTS, g.utm_forward() + Program({"meridian": g.central_meridian("zone")}), {"id": None, "zone": None, "hemisphere": None, "meridian": 1, "easting": 4, "northing": 4, "utm_status": None})
formula("geo_06_utm_forced_zone", d.TELEMETRY, g.utm_forward(out="f_", zone="cast(33 as int)", hemisphere="'N'"), {"seq": None, "f_zone": None, "f_easting": 4, "f_northing": 4})
formula("geo_07_utm_inverse", d.POINTS, g.utm_forward() + g.utm_inverse("easting", "northing", "zone", "hemisphere"), {"id": None, "inv_lat": 9, "inv_lon": 9, "utm_status": None})
formula(
    "geo_11_12_13_angles",
    d.EXPOSURES,
    Program({"valid": g.valid_coordinate("track / 2e0", "wind_dir - 180e0"), "azimuth": g.norm360("track"), "delta": g.signed_delta("track", "wind_dir"), "math_rad": g.math_angle("track")}),
    {"id": None, "valid": None, "azimuth": 6, "delta": 6, "math_rad": 9},
)
formula(
    "geo_14_display",
    d.POINTS,
    g.utm_forward() + Program({"shown": g.display("lat", "lon", "h"), "shown_utm": "case when utm_status = 'OK' then concat(cast(zone as string), hemisphere, ' ', printf('%.0f', round(easting, 0)), 'E ', printf('%.0f', round(northing, 0)), 'N') end"}),
    {"id": None, "shown": None, "shown_utm": None},
)
formula("sen_01_10_camera", d.SENSORS, p.camera(), {"sensor_id": None} | dict.fromkeys(["pixel_pitch_mm", "fov_h_rad", "fov_v_rad", "gsd_x", "gsd_y", "gsd_worst", "swath_w", "swath_h", "effective_swath", "required_agl", "line_spacing", "photo_interval"], 9) | {"plan_status": None})
formula("lid_01_05_lidar", d.SENSORS, p.lidar() + Program({"waypoint_interval": "50e0"}) + p.lidar_plan(), {"sensor_id": None, "lidar_swath": 6, "point_density": 6, "required_speed": 6, "across_spacing": 6, "along_spacing": 6, "lidar_line_spacing": 6, "lidar_interval": 6, "lidar_status": None})
formula("lim_01_02_limits", d.PLATFORMS, Program({"speed": "tas", "rise_m": "rise"}) + p.limits() + Program({"buffer_m": p.obstacle_buffer("abs(rise)")}), {"platform_id": None, "max_slope": 9, "max_curvature": 9, "min_lookahead": 6, "buffer_m": 6})
formula("kin_01_wind_triangle", d.EXPOSURES, p.wind_triangle(), {"id": None, "track": 3, "tas": 3, "wind_speed": 4, "heading": 6, "ground_speed": 6, "wca_deg": 6, "wind_status": None})
formula("kin_02_trn_01_radii", d.PLATFORMS, Program({"r_safe": p.safe_radius("tas", "wind_speed", "bank_deg"), "r_turn": p.turn_radius("tas", "bank_deg"), "clothoid": p.clothoid_length("tas", "bank_deg", "roll_rate")}), {"platform_id": None, "r_safe": 6, "r_turn": 6, "clothoid": 6})
formula(
    "ene_01_04_08_power",
    d.PLATFORMS,
    p.power() + Program({"p_level": p.power_at("tas"), "p_turn": p.turn_power_at("tas", "bank_deg"), "p_climb": p.climb_power("vertical"), "status": p.platform_status()}),
    {"platform_id": None, "fixed_wing": None, "k1": 9, "k2": 6, "p_level": 6, "p_turn": 6, "p_climb": 6, "status": None},
)

_PRESETS = ", ".join(f"('{name}', {', '.join(num(x) for x in row[:3])}, {row[3]}, {row[4]})" for name, row in SENSOR_PRESETS.items())
_PRESET_VIEW = f"select * from (values {_PRESETS}) as presets(sensor, focal_mm, width_mm, height_mm, width_px, height_px)"


def sensor_presets(spark: SparkSession) -> DataFrame:
    """The camera presets as a dimension table (a fixed handful of rows)."""
    return spark.createDataFrame([(name, *row) for name, row in SENSOR_PRESETS.items()], "sensor string, focal_mm double, width_mm double, height_mm double, width_px int, height_px int")


def platform_limits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, *row) for name, row in PLATFORM_LIMITS.items()], "platform string, speed double, max_pitch_deg double, accel_g double, pitch_rate double, climb double, descent double")


_SEN09 = p.camera() + p.wind_triangle() + p.wind_spacing()
_SEN09_OUT = {"id": None, "sensor": None, "swath_w": 9, "wca_deg": 9, "wind_line_spacing": 9, "spacing_status": None}


@query("src_16_sen_09_wind_spacing", f"select {', '.join(rounded(_SEN09_OUT))} from ({_SEN09.sql(f'select e.*, focal_mm, width_mm, height_mm, width_px, height_px from ({d.EXPOSURES.sql}) e join ({_PRESET_VIEW}) s on e.sensor = s.sensor')})")
def wind_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    exposures = d.EXPOSURES.load(spark, sf_dir)
    return _SEN09.apply(exposures.join(F.broadcast(sensor_presets(spark)), "sensor")).selectExpr(*rounded(_SEN09_OUT))


_ENE05 = p.power() + p.wind_triangle() + Program({"energy_j": p.segment_energy("distance", "rise", "ground_speed", "tas")})
_PLATFORM = "1.4e0 as mass, 1e0 as cd, 4e-2 as frontal, cast(null as double) as wing_area, cast(null as double) as wingspan, cast(null as double) as oswald, 12e-2 as rotor_area, 65e-2 as eta, 1e-1 as regen"


@query("ene_05_segment_energy", f"select id, round(ground_speed, 6) + 0e0 as ground_speed, round(energy_j, 4) + 0e0 as energy_j, wind_status from ({_ENE05.sql(f'select *, {_PLATFORM} from ({d.EXPOSURES.sql})')})")
def segment_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ENE05.apply(d.EXPOSURES.load(spark, sf_dir).selectExpr("*", *_PLATFORM.split(", "))).selectExpr("id", "round(ground_speed, 6) + 0e0 as ground_speed", "round(energy_j, 4) + 0e0 as energy_j", "wind_status")


#: Pairs of points up to some 3 000 km apart.
_LEGS = d.View("events", d.POINTS.columns | {"lat2": "cast((event_id * 7919) % 172001 as double) * 1e-3 - 86e0 + (cast((event_id * 31) % 2000 as double) * 1e-2 - 10e0) * 4e-1", "lon2": "cast((event_id * 104729) % 360000 as double) * 1e-3 - 180e0 + cast((event_id * 53) % 2000 as double) * 1e-2 - 10e0"})
formula("geo_01_geodesic_inverse", _LEGS, g.geodesic_inverse("lat", "lon", "lat2", "lon2", nodes=12, updates=6), {"id": None, "geo_distance": 4, "geo_azi1": 5, "geo_azi2": 5, "geo_status": None})
_RAYS = d.View("events", d.POINTS.columns | {"azimuth": "cast((event_id * 17) % 3600 as double) * 1e-1", "reach": "10e0 + cast((event_id * 101) % 100000 as double)"})
formula("geo_02_geodesic_direct", _RAYS, g.geodesic_direct("lat", "lon", "azimuth", "reach"), {"id": None, "to_lat": 9, "to_lon": 8, "to_azi": 6})


@query("sen_lim_presets", f"select sensor, focal_mm, width_mm, height_mm, cast(width_px as integer) as width_px, cast(height_px as integer) as height_px from ({_PRESET_VIEW})")
def presets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sensor_presets(spark)


_SHORT = g.geodesic_inverse("lat", "lon", "lat2", "lon2", nodes=12, updates=6)


@query("geo_01_sql_inverse", f"select id, round(geo_distance, 3) + 0e0 as metres, round(geo_azi1, 5) + 0e0 as azimuth from ({_SHORT.sql(_LEGS.sql)})")
def sql_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same geodesics by the function of Spark SQL."""
    sqlfunctions.register(spark)
    _LEGS.load(spark, sf_dir).createOrReplaceTempView("aeroframe_legs")
    return spark.sql("select id, round(v.distance, 3) + 0e0 as metres, round(v.azimuth, 5) + 0e0 as azimuth from (select id, geodesic_inverse(lat, lon, lat2, lon2) as v from aeroframe_legs)")
