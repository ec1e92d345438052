"""Plan generation: area grids, footprints, corridor offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geodesy as g
from ..functions.program import Program

#: Of each corner: azimuth and distance from the centre, then offsets across and along the lines.
CORNER = Program({"c_lat": "(min_lat + max_lat) / 2e0", "c_lon": "(min_lon + max_lon) / 2e0"}) + g.geodesic_inverse("c_lat", "c_lon", "corner_lat", "corner_lon", out="c_", nodes=6, updates=5) + Program(
    {"_delta": f"radians({g.signed_delta('azimuth', 'c_azi1')})"}, {"across": "c_distance * sin(_delta)", "along": "c_distance * cos(_delta)"}
)
#: From the centre to a line's origin, its first waypoint, and each waypoint.
WALK = (
    Program({"c_lat": "(min_lat + max_lat) / 2e0", "c_lon": "(min_lon + max_lon) / 2e0"})
    + g.geodesic_direct("c_lat", "c_lon", "azimuth + 90e0", "across_min + cast(line_index as double) * line_spacing", out="o_", nodes=4)
    + g.geodesic_direct("o_lat", "o_lon", "azimuth", "along_min", out="s_", nodes=4)
    + g.geodesic_direct("s_lat", "s_lon", "azimuth", "cast(wp_index as double) * photo_interval", out="w_", nodes=4)
)


def grid_size(span: str, step: str) -> str:
    return f"case when {span} < 1e-9 then 1 else cast(ceil({span} / {step}) as int) + 1 end"


def plan_status() -> str:
    """Why a mission box cannot be planned, or OK."""
    return "case when not coalesce(min_lat < max_lat and min_lon < max_lon and min_lat >= -90e0 and max_lat <= 90e0 and min_lon >= -180e0 and max_lon <= 180e0, false) then 'BAD_BOX' when not coalesce(line_spacing > 0e0 and photo_interval > 0e0 and azimuth is not null, false) then 'INVALID_PARAMETER' else 'OK' end"


def area_grid(missions: DataFrame) -> DataFrame:
    """Waypoints (plan_id, line_index, wp_index, lat, lon) of parallel lines over each mission's box.

    All lines run the same way, from the least offset across to the greatest. A
    mission that cannot be planned has no rows here; ``plan_status`` says why.
    """
    good = missions.where(plan_status() + " = 'OK'")
    corners = F.array(*(F.struct(F.col(a).alias("corner_lat"), F.col(b).alias("corner_lon")) for a in ("min_lat", "max_lat") for b in ("min_lon", "max_lon")))
    spans = CORNER.apply(good.select("plan_id", "min_lat", "max_lat", "min_lon", "max_lon", "azimuth", F.explode(corners).alias("_c")).select("*", "_c.*"))
    spans = spans.groupBy("plan_id").agg(F.min("across").alias("across_min"), F.max("across").alias("across_max"), F.min("along").alias("along_min"), F.max("along").alias("along_max"))
    sized = good.join(spans, "plan_id").selectExpr("*", f"{grid_size('(across_max - across_min)', 'line_spacing')} as n_lines", f"{grid_size('(along_max - along_min)', 'photo_interval')} as n_wp")
    cells = sized.withColumn("line_index", F.explode(F.sequence(F.lit(0), F.col("n_lines") - 1))).withColumn("wp_index", F.explode(F.sequence(F.lit(0), F.col("n_wp") - 1)))
    walked = WALK.apply(cells)
    return walked.withColumns({"lat": F.col("w_lat"), "lon": F.col("w_lon")}).drop("c_lat", "c_lon", *(f"{p}_{x}" for p in "osw" for x in ("lat", "lon", "azi")), "across_max", "along_max")


#: Offsets of the five footprint samples: the centre and the corners.
FOOTPRINT = ((0, 0.0, 0.0), (1, 1.0, 1.0), (2, 1.0, -1.0), (3, -1.0, 1.0), (4, -1.0, -1.0))
SAMPLE = g.geodesic_direct("lat", "lon", "azimuth + 90e0", "side * half_across", out="m_", nodes=4, updates=2) + g.geodesic_direct("m_lat", "m_lon", "azimuth", "ahead * half_along", out="p_", nodes=4, updates=2)


def footprints(waypoints: DataFrame) -> DataFrame:
    """Five sample points of every waypoint's footprint; needs azimuth, half_across and half_along."""
    offsets = F.array(*(F.struct(F.lit(k).alias("sample"), F.lit(a).alias("side"), F.lit(b).alias("ahead")) for k, a, b in FOOTPRINT))
    dealt = waypoints.withColumn("_o", F.explode(offsets)).select(*waypoints.columns, "_o.*")
    return SAMPLE.apply(dealt).drop("m_lat", "m_lon", "m_azi", "p_azi", "side", "ahead")


def corridor_offsets(passes: str, width: str) -> str:
    """Array of offsets across a corridor: one pass down the middle, else evenly from side to side."""
    return f"case when {passes} = 1 then array(0e0) else transform(sequence(0, {passes} - 1), i -> -{width} / 2e0 + cast(i as double) * {width} / cast({passes} - 1 as double)) end"


def corridor_status() -> str:
    """Why a corridor cannot be planned, or OK. Needs n_vertices, width, passes, and the extremes of its centre line."""
    return "case when n_vertices < 2 then 'TOO_SHORT' when not coalesce(width > 0e0, false) then 'BAD_WIDTH' when passes not in (1, 3, 5) then 'BAD_PASSES' when min_lat < 0e0 and max_lat >= 0e0 then 'CROSSES_EQUATOR' when max_lon - min_lon > 180e0 then 'CROSSES_ANTIMERIDIAN' else 'OK' end"
