"""Plan exports: GeoJSON, ground-control plans, wayline archives, summaries.

Each export is a DataFrame of one document a plan, built from ordered waypoints by
Spark; only the caller decides whether to write it as a table, files, or collect one.
Waypoints need plan_id, line_index, wp_index, lat, lon, alt, datum and transit.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import files

# Commands, frames and defaults of ground-control plans.
WAYPOINT, TRIGGER_DISTANCE = 16, 206
FRAME_GLOBAL, FRAME_MISSION, FRAME_RELATIVE = 0, 2, 3
FIRMWARE, VEHICLE = 3, 2
CRUISE_SPEED, HOVER_SPEED = 15.0, 5.0
# Namespaces and defaults of wayline archives.
KML_NS, WPML_NS = "http://www.opengis.net/kml/2.2", "http://www.dji.com/wpmz/1.0.0"
TAKEOFF_HEIGHT, TRANSIT_SPEED, FLIGHT_SPEED = 20.0, 15.0, 10.0
# Texts that go with plans made over a surface model.
ATTRIBUTION = "Contains modified Copernicus Sentinel data {year}, processed by ESA."
DISCLAIMER = "The Copernicus DEM is provided under the Copernicus Data Space Ecosystem License. See https://dataspace.copernicus.eu/terms-and-conditions"
SURFACE_WARNING = "SAFETY WARNING: Copernicus DEM is a Digital Surface Model (DSM). Altitudes include canopy and structure tops. AGL clearance over forests may be UNDERESTIMATED by 2-8 m. Verify obstacle clearance manually before flight."


def ordered(value: Column, *keys: str) -> Column:
    """Values of a group in order of their keys."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*keys, value.alias("_v")))), lambda x: x["_v"])


def notices(used_dem: Column, year: int = 2021) -> dict[str, Column]:
    """Warning, attribution and disclaimer, where a surface model was used."""
    when = lambda text: F.when(used_dem, F.lit(text))
    return {"safety_warning": when(SURFACE_WARNING), "attribution": when(ATTRIBUTION.replace("{year}", str(year))), "disclaimer": when(DISCLAIMER)}


def geojson(waypoints: DataFrame, crab: str | None = None, used_dem: bool = False) -> DataFrame:
    """plan_id and document: a FeatureCollection with a LineString Z a line."""
    lines = waypoints.groupBy("plan_id", "line_index").agg(
        ordered(F.array("lon", "lat", "alt"), "wp_index").alias("coordinates"),
        F.min_by("datum", "wp_index").alias("datum"),
        F.min("alt").alias("low"),
        F.max("alt").alias("high"),
        *(F.max(c).alias(c) for c in ("gsd", "side_pct", "end_pct")),
        (F.max(F.abs(F.col(crab))) if crab else F.lit(None).cast("double")).alias("crab"),
    )
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("LineString").alias("type"), "coordinates").alias("geometry"),
        F.struct("line_index", F.col("datum").alias("altitude_datum"), F.col("low").alias("min_altitude_m"), F.col("high").alias("max_altitude_m"), F.col("gsd").alias("target_gsd_m"), F.col("side_pct").alias("side_lap_pct"), F.col("end_pct").alias("end_lap_pct"), F.col("crab").alias("crab_angle_deg")).alias("properties"),
    )
    plans = lines.groupBy("plan_id").agg(ordered(feature, "line_index").alias("features"), F.min_by("datum", "line_index").alias("altitude_datum"))
    texts = [v.alias(k) for k, v in notices(F.lit(used_dem)).items()]
    return plans.select("plan_id", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "altitude_datum", "features", *texts)).alias("document"))


def qgc_status(waypoints: DataFrame) -> DataFrame:
    """Per plan whether it can be exported: one datum, and that AGL or ellipsoidal."""
    one = waypoints.groupBy("plan_id").agg(F.countDistinct("datum").alias("_n"), F.min("datum").alias("datum"))
    return one.select("plan_id", "datum", F.when(F.col("_n") > 1, "MIXED_DATUM").when(~F.col("datum").isin("AGL", "WGS84_ELLIPSOIDAL"), "WRONG_DATUM").otherwise("OK").alias("status"))


def qgc_items(waypoints: DataFrame, trigger_m: float) -> DataFrame:
    """Mission items (plan_id, seq, command, frame, params): survey lines between camera on and off, transits bare."""
    good = waypoints.join(qgc_status(waypoints).where("status = 'OK'").select("plan_id", F.col("datum").alias("_d")), "plan_id")
    null = F.lit(None).cast("double")
    zero = F.lit(0.0)
    item = lambda at, command, frame, params: F.struct(at.alias("at"), F.lit(command).alias("command"), frame.alias("frame"), F.array(*params).alias("params"))
    way = item(F.lit(1), WAYPOINT, F.when(F.col("_d") == "AGL", FRAME_RELATIVE).otherwise(FRAME_GLOBAL), [zero, zero, zero, null, F.col("lat"), F.col("lon"), F.col("alt")])
    on = item(F.lit(0), TRIGGER_DISTANCE, F.lit(FRAME_MISSION), [F.lit(trigger_m), zero, F.lit(1.0), zero, zero, zero, zero])
    off = item(F.lit(2), TRIGGER_DISTANCE, F.lit(FRAME_MISSION), [zero] * 7)
    w = Window.partitionBy("plan_id", "line_index").orderBy("wp_index")
    first, last = F.lag("wp_index").over(w).isNull() & ~F.col("transit"), F.lead("wp_index").over(w).isNull() & ~F.col("transit")
    rows = good.withColumns({"_first": first, "_last": last})
    rows = rows.withColumn("_i", F.explode(F.filter(F.array(F.when(F.col("_first"), on), way, F.when(F.col("_last"), off)), lambda x: x.isNotNull()))).select("plan_id", "line_index", "wp_index", "_i.*")
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("plan_id").orderBy("line_index", "wp_index", "at"))).select("plan_id", "seq", "command", "frame", "params")


def qgc(waypoints: DataFrame, trigger_m: float, station: str = "aeroframe") -> DataFrame:
    """plan_id and document: a ground-control plan file for each plan that can be exported."""
    item = F.struct(F.lit(True).alias("autoContinue"), "command", F.col("seq").alias("doJumpId"), "frame", "params", F.lit("SimpleItem").alias("type"))
    items = qgc_items(waypoints, trigger_m).groupBy("plan_id").agg(ordered(item, "seq").alias("items"))
    home = waypoints.groupBy("plan_id").agg(F.min_by(F.array("lat", "lon", "alt"), F.struct("line_index", "wp_index")).alias("home"))
    mission = F.struct(F.lit(FIRMWARE).alias("firmwareType"), F.lit(VEHICLE).alias("vehicleType"), F.lit(CRUISE_SPEED).alias("cruiseSpeed"), F.lit(HOVER_SPEED).alias("hoverSpeed"), F.col("home").alias("plannedHomePosition"), "items")
    none = F.array().cast("array<double>")
    document = F.struct(F.lit("Plan").alias("fileType"), F.lit(1).alias("version"), F.lit(station).alias("groundStation"), mission.alias("mission"), F.struct(none.alias("circles"), none.alias("polygons"), F.lit(2).alias("version")).alias("geoFence"), F.struct(none.alias("points"), F.lit(2).alias("version")).alias("rallyPoints"))
    return items.join(home, "plan_id").select("plan_id", F.to_json(document).alias("document"))


def _tag(name: str, *content) -> Column:
    return F.concat(F.lit(f"<{name}>"), *(F.lit(x) if isinstance(x, str) else x for x in content), F.lit(f"</{name}>"))


def dji_parts(waypoints: DataFrame) -> DataFrame:
    """plan_id, template and waylines: the two XML parts for plans wholly in EGM96; action groups count survey lines only."""
    good = waypoints.groupBy("plan_id").agg(F.bool_and(F.col("datum") == "EGM96").alias("_ok")).where("_ok").select("plan_id")
    rows = waypoints.join(good, "plan_id")
    fixed = lambda x, n: F.format_string(f"%.{n}f", x)
    index = F.col("wp_index").cast("string")
    point = _tag("Placemark", _tag("Point", _tag("coordinates", fixed("lon", 9), ",", fixed("lat", 9), ",", fixed("alt", 3))), _tag("wpml:index", index))
    speed = f"{FLIGHT_SPEED:.1f}"
    way = _tag(
        "Placemark",
        _tag("Point", _tag("coordinates", fixed("lon", 9), ",", fixed("lat", 9))),
        _tag("wpml:index", index),
        _tag("wpml:executeHeight", fixed("alt", 3)),
        _tag("wpml:waypointSpeed", speed),
        _tag("wpml:waypointHeadingParam", _tag("wpml:waypointHeadingMode", "followWayline")),
        _tag("wpml:waypointTurnParam", _tag("wpml:waypointTurnMode", "coordinateTurn"), _tag("wpml:waypointTurnDampingDist", "0")),
    )
    lines = rows.groupBy("plan_id", "line_index").agg(F.array_join(ordered(point, "wp_index"), "").alias("points"), F.array_join(ordered(way, "wp_index"), "").alias("ways"), F.count("*").alias("n"), F.bool_or("transit").alias("transit"))
    w = Window.partitionBy("plan_id").orderBy("line_index")
    lines = lines.withColumn("group", F.sum(F.when(F.col("transit"), 0).otherwise(1)).over(w) - 1)
    line = F.col("line_index").cast("string")
    action = _tag(
        "wpml:actionGroup",
        _tag("wpml:actionGroupId", F.col("group").cast("string")),
        _tag("wpml:actionGroupStartIndex", "0"),
        _tag("wpml:actionGroupEndIndex", (F.col("n") - 1).cast("string")),
        _tag("wpml:actionGroupMode", "sequence"),
        _tag("wpml:actionTrigger", _tag("wpml:actionTriggerType", "reachPoint")),
        _tag("wpml:action", _tag("wpml:actionId", "0"), _tag("wpml:actionActuatorFunc", "takePhoto"), _tag("wpml:actionActuatorFuncParam", _tag("wpml:payloadPositionIndex", "0"))),
    )
    system = _tag("wpml:waylineCoordinateSysParam", _tag("wpml:coordinateMode", "WGS84"), _tag("wpml:heightMode", "EGM96"))
    folder = _tag("Folder", _tag("wpml:templateId", line), system, F.col("points"))
    wayline = _tag("Folder", _tag("wpml:templateId", line), _tag("wpml:executeHeightMode", "EGM96"), _tag("wpml:waylineId", line), _tag("wpml:autoFlightSpeed", speed), F.col("ways"), F.when(F.col("transit"), "").otherwise(action))
    plans = lines.groupBy("plan_id").agg(F.array_join(ordered(folder, "line_index"), "").alias("a"), F.array_join(ordered(wayline, "line_index"), "").alias("b"))
    config = _tag("wpml:missionConfig", _tag("wpml:flyToWaylineMode", "safely"), _tag("wpml:finishAction", "goHome"), _tag("wpml:exitOnRCLost", "executeLostAction"), _tag("wpml:takeOffSecurityHeight", f"{TAKEOFF_HEIGHT:.1f}"), _tag("wpml:globalTransitionalSpeed", f"{TRANSIT_SPEED:.1f}"), _tag("wpml:executeHeightMode", "EGM96"))
    whole = lambda *body: F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="{KML_NS}" xmlns:wpml="{WPML_NS}"><Document>'), *body, F.lit("</Document></kml>"))
    return plans.select("plan_id", whole(config, F.col("a")).alias("template"), whole(F.col("b")).alias("waylines"))


def dji_archives(waypoints: DataFrame) -> DataFrame:
    """plan_id and archive (zip bytes, the same for the same plan) of every plan in EGM96."""

    @F.pandas_udf("binary")
    def packed(template: pd.Series, waylines: pd.Series) -> pd.Series:
        return pd.Series([files.zip_bytes({"wpmz/template.kml": a, "wpmz/waylines.wpml": b}) for a, b in zip(template, waylines, strict=True)])

    return dji_parts(waypoints).select("plan_id", packed("template", "waylines").alias("archive"))


def write_documents(documents: DataFrame, folder: str, suffix: str, content: str = "document", name: str = "plan-%06d", mode: str = "overwrite") -> None:
    """Write (plan_id, document or archive) as one file a plan; tasks write, the commit renames."""
    rows = documents.select(F.format_string(f"{name}.{suffix}", "plan_id").alias("name"), F.col(content).cast("binary").alias("content"))
    files.write_files(rows, folder, mode)


def summary(waypoints: DataFrame, interval: str, spacing: str, speed: float = 12.0, turn_s: float = 30.0) -> DataFrame:
    """Planning estimate: mean points a line times interval, cross legs, and time at a speed plus a stretch a line."""
    p = waypoints.groupBy("plan_id").agg(F.countDistinct("line_index").alias("lines"), F.count("*").alias("points"), F.max(interval).alias("_i"), F.max(spacing).alias("_s"))
    distance = F.col("lines") * (F.col("points") / F.col("lines")) * F.col("_i") + (F.col("lines") - 1) * F.col("_s")
    return p.select("plan_id", "lines", "points", distance.alias("distance_m"), (distance / speed + turn_s * F.col("lines")).alias("time_s"))
