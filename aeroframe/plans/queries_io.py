"""Queries of sources, sinks and streams."""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nmea
from ..operators import boxes, terrain, tracks
from ..sources import exports, files, gpkg, raster, tiles, vector
from ..streaming import links, telemetry
from . import domain as d
from . import queries_terrain as terrain_queries
from . import queries_tracks as t
from .queries_geometry import _GRID_SQL, _edges_sql, grid, polygons
from .registry import ORACLE_SQL, query


@lru_cache(maxsize=1)
def _local() -> str:
    made = tempfile.mkdtemp(prefix="aeroframe-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return "file://" + made


def folder(spark: SparkSession) -> str:
    """A fresh folder in the one named by spark.checkpoint.dir (a temporary one where that is unset, with a local master only); removed when the driver ends."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = (found or _local()).rstrip("/") + "/aeroframe-" + uuid.uuid4().hex[:12]
    atexit.register(files.remove_folder, made)
    return made


def local_path(path: str) -> str:
    """The plain path of a folder that driver and tasks mount; SQLite cannot write anywhere else."""
    plain = re.sub(r"^file:(//)?(?=/)", "", path)
    if "://" in plain:
        raise ValueError(f"GeoPackages need a mounted folder, not {path}")
    return plain


def waypoints(spark: SparkSession, sf_dir: str, datum: str) -> DataFrame:
    return grid(spark, sf_dir).selectExpr("plan_id", "line_index", "wp_index", "lat", "lon", "msl as alt", f"'{datum}' as datum", "line_index % 3 = 2 as transit", "5e-2 as gsd", "30e0 as side_pct", "60e0 as end_pct", "photo_interval", "line_spacing")


# ---------------------------------------------------------------- GeoPackage blobs


@query(
    "snk_05_07_geometry_blobs",
    f"select plan_id, cast(line_index as integer) as line_index, cast(8 + 48 + 9 + count(*) * 24 as integer) as n_bytes, round(min(lon), 7) + 0e0 as min_x, round(max(lon), 7) + 0e0 as max_x, round(min(lat), 7) + 0e0 as min_y, round(max(lat), 7) + 0e0 as max_y, false as is_empty from ({_GRID_SQL}) group by plan_id, line_index",
)
def geometry_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    gpkg.register_functions(spark)
    rows = gpkg.encode_lines(waypoints(spark, sf_dir, "EGM2008"), ["plan_id", "line_index"])
    return rows.selectExpr("plan_id", "line_index", "length(geom) as n_bytes", "round(st_minx(geom), 7) + 0e0 as min_x", "round(st_maxx(geom), 7) + 0e0 as max_x", "round(st_miny(geom), 7) + 0e0 as min_y", "round(st_maxy(geom), 7) + 0e0 as max_y", "st_isempty(geom) as is_empty")


@query("snk_04_06_blob_bytes", "select * from (values ('empty_point', '" + gpkg.EMPTY_POINT.hex() + "'), ('line', '47500003e6100000000000000000f03f0000000000000840000000000000004000000000000010400102000000020000000000" + "00000000f03f000000000000004000000000000008400000000000001040')) as b(name, bytes)")
def blob_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([("empty_point", bytearray(gpkg.EMPTY_POINT)), ("line", bytearray(gpkg.linestring([(1.0, 2.0), (3.0, 4.0)])))], "name string, b binary").select("name", F.lower(F.hex("b")).alias("bytes"))


_NUMBERED = "plan_id * 10000 + line_index"


def package(spark: SparkSession, sf_dir: str) -> str:
    """All plans as lines of one GeoPackage, numbered by plan and line; returns its path."""
    spark.dataSource.register(gpkg.GpkgDataSource)
    path = local_path(folder(spark)) + ".gpkg"
    lines = gpkg.encode_lines(waypoints(spark, sf_dir, "EGM2008"), ["plan_id", "line_index"]).withColumn("altitude_datum", F.lit("EGM2008"))
    lines.selectExpr(f"{_NUMBERED} as line_index", "altitude_datum", "cast(line_index % 5 as double) * 15e-1 as crab_angle_deg", "geom").write.format("gpkg").mode("overwrite").save(path)
    return path


def read_lines(packages: DataFrame) -> DataFrame:
    """Lines of packages with the number, box and height of their points, batch by batch."""

    @F.arrow_udf("struct<points: bigint, min_lon: double, max_lon: double, min_lat: double, max_lat: double, alt: double>")
    def seen(blobs: pa.Array) -> pa.Array:
        count, points = gpkg.line_points(blobs)
        first = np.cumsum(count) - count
        low, high = np.minimum.reduceat(points, first), np.maximum.reduceat(points, first)
        return pa.StructArray.from_arrays([pa.array(x) for x in (count, low[:, 0], high[:, 0], low[:, 1], high[:, 1], high[:, 2])], ["points", "min_lon", "max_lon", "min_lat", "max_lat", "alt"])

    rows = gpkg.read_packages(packages).where("error is null")
    return rows.withColumn("p", seen("geom")).select("plan_id", "id", "line_index", "altitude_datum", "completion_pct", "crab_angle_deg", "p.*")


def mission_packages(spark: SparkSession, sf_dir: str) -> str:
    """A package for each plan, in a fresh folder."""
    at = folder(spark)
    lines = gpkg.encode_lines(waypoints(spark, sf_dir, "EGM2008"), ["plan_id", "line_index"])
    gpkg.write_packages(lines.selectExpr("plan_id", "line_index", "'EGM2008' as altitude_datum", "cast(line_index % 5 as double) * 15e-1 as crab_angle_deg", "geom"), at)
    return at


@query("src_10_12_snk_01_03_gpkg_round_trip", f"select {_NUMBERED} as line_index, 'EGM2008' as altitude_datum, 0e0 as completion_pct, cast(line_index % 5 as double) * 15e-1 as crab_angle_deg, count(*) as points, round(min(lon), 8) + 0e0 as min_lon, round(max(lat), 8) + 0e0 as max_lat, max(msl) as alt from ({_GRID_SQL}) group by plan_id, line_index")
def gpkg_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every plan to a package of its own and read them back, coordinates and all."""
    rows = read_lines(gpkg.package_files(spark, mission_packages(spark, sf_dir)))
    return rows.selectExpr(f"{_NUMBERED} as line_index", "altitude_datum", "completion_pct", "crab_angle_deg", "points", "round(min_lon, 8) + 0e0 as min_lon", "round(max_lat, 8) + 0e0 as max_lat", "alt")


#: Tracks of vehicles as plans, four lines each: as many packages as vehicles.
_TRACKS_SQL = f"select vehicle as plan_id, seq % 4 as line_index, seq as wp_index, lat, lon, alt from ({d.TELEMETRY.sql})"


def track_packages(spark: SparkSession, sf_dir: str) -> str:
    """A package a vehicle, written by tasks to a fresh folder."""
    at = folder(spark)
    way = d.TELEMETRY.load(spark, sf_dir).selectExpr("vehicle as plan_id", "seq % 4 as line_index", "seq as wp_index", "lat", "lon", "alt")
    gpkg.write_packages(gpkg.encode_lines(way, ["plan_id", "line_index"]).withColumn("altitude_datum", F.lit("EGM96")), at)
    return at


@query(
    "snk_01_03_08_track_packages",
    f"""with l as (select plan_id, line_index, count(*) as points, min(lon) as w, max(lon) as e, min(lat) as s, max(lat) as n from ({_TRACKS_SQL}) group by plan_id, line_index having count(*) > 1)
select plan_id, count(*) as n_rows, count(*) as rtree_rows, cast(sum(points) as bigint) as points, round(min(w), 4) as min_x, round(min(s), 4) as min_y, round(max(e), 4) as max_x, round(max(n), 4) as max_y, 'altitude_datum=EGM96' as description, '3' as schema_version from l group by plan_id""",
)
def packages_of_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vehicle's package, read back: rows, R-tree entries, points, box, description and version."""
    found = gpkg.package_summaries(gpkg.package_files(spark, track_packages(spark, sf_dir))).where("error is null")
    box = [F.round(n, 4).alias(n) for n in ("min_x", "min_y", "max_x", "max_y")]  # the R-tree keeps single precision
    return found.select("plan_id", "n_rows", "rtree_rows", "points", *box, "description", F.col("metadata")["schema_version"].alias("schema_version"))


@query(
    "snk_09_10_revised_packages",
    f"""with l as (select plan_id, line_index from ({_TRACKS_SQL}) group by plan_id, line_index having count(*) > 1)
select plan_id, line_index - count(*) filter (line_index = plan_id % 4) over (partition by plan_id order by line_index rows unbounded preceding) as line_index,
  case when line_index % 2 = 0 then 5e1 + plan_id % 50 else 0e0 end as completion_pct, 'altitude_datum=EGM96|checked' as description, 'done' as note
from l qualify line_index <> plan_id % 4""",
)
def revised_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of even lines, one line a plan deleted, metadata put and the description appended to (twice, once counts). A revision drops what it was made from."""
    at = track_packages(spark, sf_dir), folder(spark), folder(spark)
    lines = d.TELEMETRY.load(spark, sf_dir).selectExpr("vehicle as plan_id", "seq % 4 as line_index").distinct()
    changes = lines.selectExpr("plan_id", "line_index", "case when line_index % 2 = 0 then 5e1 + plan_id % 50 end as completion_pct", "line_index = plan_id % 4 as gone")
    gpkg.revise_folder(spark, at[0], at[1], changes, description="checked", values={"note": "open"}, keep=False)
    gpkg.revise_folder(spark, at[1], at[2], description="checked", values={"note": "done"}, keep=False)
    rows = gpkg.read_packages(gpkg.package_paths(spark, at[2]), told=True).where("error is null")
    return rows.select("plan_id", "line_index", "completion_pct", F.replace("description", F.lit("\n"), F.lit("|")).alias("description"), F.col("metadata")["note"].alias("note"))


@query(
    "src_11_12_snk_08_gpkg_summary",
    f"""with w as ({_GRID_SQL}), n as (select count(*) as lines from (select distinct plan_id, line_index from w))
select lines as n_rows, lines as rtree_rows, round(min_x, 4) + 0e0 as min_x, round(min_y, 4) + 0e0 as min_y, round(max_x, 4) + 0e0 as max_x, round(max_y, 4) + 0e0 as max_y, '3' as schema_version, 'altitude_datum=EGM2008' as description
from n, (select min(lon) as min_x, min(lat) as min_y, max(lon) as max_x, max(lat) as max_y from w)""",
)
def gpkg_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, box, metadata and description of the package."""
    path = package(spark, sf_dir)
    found, meta = gpkg.summary(path, "flight_lines"), gpkg.metadata(path)
    row = (found["rows"], found["rtree_rows"], *(round(x, 4) + 0.0 for x in found["box"]), meta["schema_version"], found["description"])
    return spark.createDataFrame([row], "n_rows long, rtree_rows long, min_x double, min_y double, max_x double, max_y double, schema_version string, description string")


@query(
    "snk_08_gpkg_box_search",
    f"select {_NUMBERED} as line_index from (select plan_id, line_index, min(lat) as s, max(lat) as n, min(lon) as w, max(lon) as e from ({_GRID_SQL}) group by plan_id, line_index) where n >= 44e0 and s <= 54.5e0 and e >= 7e0 and w <= 27.5e0",
)
def gpkg_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose boxes meet a box, through the R-tree."""
    path = package(spark, sf_dir)
    ids = spark.createDataFrame([(i,) for i in gpkg.search(path, "flight_lines", (7.0, 27.5, 44.0, 54.5))], "id long")
    return spark.read.format("gpkg").load(path).join(ids, "id").select("line_index")


@query(
    "snk_10_17_gpkg_completion",
    f"select {_NUMBERED} as line_index, case when line_index % 2 = 0 then 5e1 + plan_id else 0e0 end as completion_pct from (select distinct plan_id, line_index from ({_GRID_SQL}))",
)
def gpkg_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of every other line, written into the packages by the tasks that hold them."""
    at = folder(spark)
    packages = gpkg.package_files(spark, mission_packages(spark, sf_dir))
    flown = grid(spark, sf_dir).select("plan_id", "line_index").distinct().where("line_index % 2 = 0")
    files.write_files(gpkg.revise(packages, flown.selectExpr("plan_id", "line_index", "5e1 + plan_id as completion_pct", "false as gone")), at)
    return read_lines(gpkg.package_files(spark, at)).selectExpr(f"{_NUMBERED} as line_index", "completion_pct")


# ---------------------------------------------------------------- boxes

#: Boxes of lines around points of the globe, and of polygons of customers; some sides are crossed or missing.
_LINE_BOXES = d.View("events", {"line_id": "event_id", **{n: f"{at} {sign} cast(event_id % {m} as double) * 5e-2" for n, at, sign, m in (("min_x", "(cast((event_id * 104729) % 360000 as double) * 1e-3 - 180e0)", "-", 17), ("max_x", "(cast((event_id * 104729) % 360000 as double) * 1e-3 - 180e0)", "+", 17), ("min_y", "(cast((event_id * 7919) % 172001 as double) * 1e-3 - 86e0)", "-", 11), ("max_y", "(cast((event_id * 7919) % 172001 as double) * 1e-3 - 86e0)", "+", 11))}})
_AREA_BOXES = d.View("customer", {"area_id": "c_custkey", "min_x": "cast((c_custkey * 7907) % 3600 as double) * 1e-1 - 180e0", "max_x": "case when c_custkey % 101 = 0 then null when c_custkey % 103 = 0 then -999e0 else cast((c_custkey * 7907) % 3600 as double) * 1e-1 - 180e0 + cast(c_custkey % 40 as double) * 1e-1 end", "min_y": "cast((c_custkey * 6983) % 1720 as double) * 1e-1 - 86e0", "max_y": "cast((c_custkey * 6983) % 1720 as double) * 1e-1 - 86e0 + cast(c_custkey % 23 as double) * 1e-1"})


def kept(spark: SparkSession):
    """Writes a table to a fresh folder and reads it back."""

    def keep(df: DataFrame) -> DataFrame:
        at = folder(spark)
        df.write.parquet(at)
        return spark.read.schema(df.schema).parquet(at)

    return keep


@query(
    "snk_08_join_boxes_in_boxes",
    f"select line_id, area_id from ({_LINE_BOXES.sql}) l join ({_AREA_BOXES.sql}) a on l.min_x <= a.max_x and l.max_x >= a.min_x and l.min_y <= a.max_y and l.max_y >= a.min_y where a.max_x >= a.min_x",
)
def boxes_in_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a line and an area whose boxes meet, through an R-tree of the areas."""
    tree = boxes.pack(_AREA_BOXES.load(spark, sf_dir), kept(spark), fanout=16)
    return boxes.box_join(_LINE_BOXES.load(spark, sf_dir), tree, ["line_id"], ["area_id"])


# ---------------------------------------------------------------- exports


@query(
    "snk_11_18_geojson",
    f"""select plan_id, cast(line_index as integer) as line_index, cast(wp_index as integer) as wp_index, round(lon, 8) + 0e0 as lon, round(lat, 8) + 0e0 as lat, msl as alt, 'EGM2008' as datum, 5e-2 as gsd, 30e0 as side, 60e0 as ahead, msl as low, msl as high, true as warned from ({_GRID_SQL})""",
)
def geojson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every coordinate and property, read back from the documents."""
    docs = exports.geojson(waypoints(spark, sf_dir, "EGM2008"), used_dem=True)
    kind = "altitude_datum string, safety_warning string, features array<struct<geometry: struct<coordinates: array<array<double>>>, properties: struct<line_index: int, altitude_datum: string, target_gsd_m: double, side_lap_pct: double, end_lap_pct: double, min_altitude_m: double, max_altitude_m: double>>>"
    v = docs.select("plan_id", F.from_json("document", kind).alias("v")).select("plan_id", F.col("v.safety_warning").endswith("Verify obstacle clearance manually before flight.").alias("warned"), F.explode("v.features").alias("f"))
    v = v.select("plan_id", "warned", "f.properties.*", F.posexplode("f.geometry.coordinates").alias("wp_index", "p"))
    return v.select("plan_id", "line_index", "wp_index", F.round(F.col("p")[0], 8).alias("lon"), F.round(F.col("p")[1], 8).alias("lat"), F.col("p")[2].alias("alt"), F.col("altitude_datum").alias("datum"), F.col("target_gsd_m").alias("gsd"), F.col("side_lap_pct").alias("side"), F.col("end_lap_pct").alias("ahead"), F.col("min_altitude_m").alias("low"), F.col("max_altitude_m").alias("high"), "warned")


@query(
    "snk_12_qgc_items",
    f"""select plan_id, cast(row_number() over (partition by plan_id order by line_index, wp_index, pos) as integer) as seq, case pos when 1 then 16 else 206 end as command, case pos when 1 then 3 else 2 end as frame, round(case pos when 1 then lat when 0 then 25e0 else 0e0 end, 7) as value
from (select plan_id, line_index, wp_index, lat, n_wp, unnest([0, 1, 2]) as pos from ({_GRID_SQL}))
where pos = 1 or (line_index % 3 <> 2 and ((pos = 0 and wp_index = 0) or (pos = 2 and wp_index = n_wp - 1)))""",
)
def qgc_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = exports.qgc_items(waypoints(spark, sf_dir, "AGL"), 25.0)
    return items.select("plan_id", "seq", "command", "frame", F.round(F.when(F.col("command") == 16, F.col("params")[4]).otherwise(F.col("params")[0]), 7).alias("value"))


@query(
    "snk_12_qgc_plan",
    f"""select plan_id, cast(row_number() over (partition by plan_id order by line_index, wp_index) as integer) as n, round(lat, 8) + 0e0 as lat, round(lon, 8) + 0e0 as lon, msl as alt, true as parses, round(first_value(lat) over (partition by plan_id order by line_index, wp_index), 8) + 0e0 as home_lat from ({_GRID_SQL})""",
)
def qgc_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The waypoints of every plan file, in order, with its home."""
    v = F.from_json("document", "fileType string, mission struct<plannedHomePosition: array<double>, items: array<struct<command: int, params: array<double>>>>")
    rows = exports.qgc(waypoints(spark, sf_dir, "AGL"), 25.0).select("plan_id", v.alias("v"))
    way = F.filter("v.mission.items", lambda i: i["command"] == exports.WAYPOINT)
    rows = rows.select("plan_id", (F.col("v.fileType") == "Plan").alias("parses"), F.round(F.col("v.mission.plannedHomePosition")[0], 8).alias("home_lat"), F.posexplode(way).alias("n", "i"))
    at = lambda k: F.col("i.params")[k]
    return rows.select("plan_id", (F.col("n") + 1).alias("n"), F.round(at(4), 8).alias("lat"), F.round(at(5), 8).alias("lon"), at(6).alias("alt"), "parses", "home_lat")


@query("snk_12_qgc_refusals", "select cast(n_nationkey as bigint) as plan_id, case when n_nationkey % 3 = 0 then 'OK' when n_nationkey % 3 = 1 then 'WRONG_DATUM' else 'MIXED_DATUM' end as status from nation")
def qgc_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    datum = "case plan_id % 3 when 0 then 'AGL' when 1 then 'EGM2008' else case when line_index = 0 then 'AGL' else 'EGM96' end end"
    return exports.qgc_status(waypoints(spark, sf_dir, "AGL").withColumn("datum", F.expr(datum))).select("plan_id", "status")


@query(
    "snk_13_dji_parts",
    f"""select plan_id, cast(row_number() over (partition by plan_id order by line_index, wp_index) - 1 as integer) as n, cast(regexp_replace(printf('%.9f', lon), '..$', '') as double) as lon, cast(regexp_replace(printf('%.9f', lat), '..$', '') as double) as lat, msl as height, cast(count(distinct line_index) filter (line_index % 3 <> 2) over (partition by plan_id) as bigint) as action_groups from ({_GRID_SQL})""",
)
def dji(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates and heights of every placemark of the waylines, in order."""
    parts = exports.dji_parts(waypoints(spark, sf_dir, "EGM96"))
    every = lambda pattern: F.regexp_extract_all("waylines", F.lit(pattern), F.lit(1))
    zipped = F.arrays_zip(every("<coordinates>([^<]*)</coordinates>").alias("c"), every("<wpml:executeHeight>([^<]*)</wpml:executeHeight>").alias("h"))
    rows = parts.select("plan_id", F.regexp_count("waylines", F.lit("<wpml:actionGroup>")).cast("long").alias("action_groups"), F.posexplode(zipped).alias("n", "p"))
    at = lambda k: F.regexp_replace(F.split("p.c", ",")[k], "..$", "").cast("double")
    return rows.select("plan_id", "n", at(0).alias("lon"), at(1).alias("lat"), F.col("p.h").cast("double").alias("height"), "action_groups")


#: Entries of an archive that are read back: its name, and the text between two marks.
_ENTRIES = "plan_id long, entry string, placemarks long, crc_ok boolean, sum_height double"


@query(
    "snk_13_dji_archives",
    f"""select plan_id, entry, count(*) as placemarks, true as crc_ok, round(case entry when 'wpmz/waylines.wpml' then sum(msl) else 0e0 end, 3) as sum_height, true as same_bytes
from ({_GRID_SQL}), (values ('wpmz/template.kml'), ('wpmz/waylines.wpml')) as e(entry) group by plan_id, entry""",
)
def dji_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives as files written by tasks, twice: entries read back, checksums held against their content, bytes equal."""
    way = waypoints(spark, sf_dir, "EGM96")
    at = [folder(spark), folder(spark)]
    for place in at:
        exports.write_documents(exports.dji_archives(way.repartition(1 + at.index(place))), place, "kmz", "archive")

    def entries(frames):
        import io
        import re
        import zipfile
        import zlib

        for f in frames:
            for plan_id, data in zip(f.plan_id, f.content, strict=True):
                with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
                    for i in z.infolist():
                        text = z.read(i)
                        heights = sum(float(x) for x in re.findall(rb"<wpml:executeHeight>([^<]*)<", text))
                        yield pd.DataFrame({"plan_id": [plan_id], "entry": [i.filename], "placemarks": [text.count(b"<Placemark>")], "crc_ok": [i.CRC == zlib.crc32(text)], "sum_height": [round(heights, 3)]})

    read = lambda place: spark.read.format("binaryFile").load(place).select(F.regexp_extract("path", r"plan-(\d+)", 1).cast("long").alias("plan_id"), "content")
    first, second = read(at[0]), read(at[1]).select("plan_id", F.crc32("content").alias("again"))
    same = first.select("plan_id", F.crc32("content").alias("crc")).join(second, "plan_id").select("plan_id", (F.col("crc") == F.col("again")).alias("same_bytes"))
    return first.mapInPandas(entries, _ENTRIES).join(same, "plan_id")


@query(
    "snk_11_12_document_files",
    f"select plan_id, 'geojson' as kind, count(*) as points from ({_GRID_SQL}) group by plan_id union all select plan_id, 'plan', count(*) from ({_GRID_SQL}) group by plan_id",
)
def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GeoJSON documents and ground-control plans as a file each, read back with their points counted."""
    at = folder(spark), folder(spark)
    exports.write_documents(exports.geojson(waypoints(spark, sf_dir, "EGM2008")), at[0], "geojson")
    exports.write_documents(exports.qgc(waypoints(spark, sf_dir, "AGL"), 25.0), at[1], "plan")
    plan = F.regexp_extract(F.input_file_name(), r"plan-(\d+)", 1).cast("long").alias("plan_id")
    shapes = spark.read.schema("features array<struct<geometry: struct<coordinates: array<array<double>>>>>").json(at[0], multiLine=True)
    points = F.aggregate("features", F.lit(0), lambda n, f: n + F.size(f["geometry"]["coordinates"])).cast("long")
    items = spark.read.schema("mission struct<items: array<struct<command: int>>>").json(at[1], multiLine=True)
    ways = F.size(F.filter("mission.items", lambda i: i["command"] == exports.WAYPOINT)).cast("long")
    return shapes.select(plan, F.lit("geojson").alias("kind"), points.alias("points")).union(items.select(plan, F.lit("plan").alias("kind"), ways.alias("points")))


@query("snk_14_summary_estimate", f"select plan_id, lines, points, round(distance_m, 4) as distance_m, round(distance_m / 12 + 30 * lines, 4) as time_s from (select *, points * i + (lines - 1) * s as distance_m from (select plan_id, count(distinct line_index) as lines, count(*) as points, max(photo_interval) as i, max(line_spacing) as s from ({_GRID_SQL}) group by plan_id))")
def summary_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = exports.summary(waypoints(spark, sf_dir, "AGL"), "photo_interval", "line_spacing")
    return s.select("plan_id", "lines", "points", F.round("distance_m", 4).alias("distance_m"), F.round("time_s", 4).alias("time_s"))


# ---------------------------------------------------------------- vector sources


@query("src_08_09_geojson_rings", f"select plan_id, ring, ring = 1 as is_hole, count(*) as vertices, round(sum(y1), 6) as sum_lat from ({_edges_sql()}) group by plan_id, ring")
def geojson_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = lambda r: F.transform(r, lambda v: F.array(v["lon"], v["lat"]))
    shape = F.to_json(F.struct(F.lit("Polygon").alias("type"), F.concat(F.array(ring(F.col("exterior"))), F.transform("holes", ring)).alias("coordinates")))
    texts = polygons(spark, sf_dir).select("plan_id", F.concat(F.lit('{"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": ['), shape, F.lit("]}}]}")).alias("text"))
    return vector.features_of_text(texts, "text", "geojson").groupBy("plan_id", "ring", "is_hole").agg(F.count("*").alias("vertices"), F.round(F.sum("lat"), 6).alias("sum_lat"))


@query("src_06_07_kml_rings", f"select plan_id, ring, ring = 1 as is_hole, count(*) as vertices, round(sum(x1), 6) as sum_lon from ({_edges_sql()}) group by plan_id, ring")
def kml_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = lambda r: F.array_join(F.transform(r, lambda v: F.format_string("%.9f,%.9f,0", v["lon"], v["lat"])), " ")
    side = lambda name, r: F.concat(F.lit(f"<{name}><LinearRing><coordinates>"), ring(r), F.lit(f"</coordinates></LinearRing></{name}>"))
    texts = polygons(spark, sf_dir).select("plan_id", F.concat(F.lit('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><Polygon>'), side("outerBoundaryIs", F.col("exterior")), side("innerBoundaryIs", F.col("holes")[0]), F.lit("</Polygon></Placemark></Document></kml>")).alias("text"))
    return vector.features_of_text(texts, "text", "kml").groupBy("plan_id", "ring", "is_hole").agg(F.count("*").alias("vertices"), F.round(F.sum("lon"), 6).alias("sum_lon"))


def _files(spark: SparkSession, docs: DataFrame, suffix: str) -> str:
    """One file a plan in a fresh folder, written by the tasks; returns the folder. A KMZ has the document second."""

    @F.pandas_udf("binary")
    def archived(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: files.zip_bytes({"a-first.kml": "<kml/>", "doc.kml": t}))

    at = folder(spark)
    content = archived("text") if suffix == "kmz" else F.col("text")
    files.write_files(docs.select(F.format_string(f"plan-%04d.{suffix}", "plan_id").alias("name"), content.alias("content")), at)
    return at


def _read_back(rows: DataFrame) -> DataFrame:
    plan = F.regexp_extract("path", r"plan-(\d+)", 1).cast("long").alias("plan_id")
    return rows.groupBy(plan, "feature", "kind", "ring", "is_hole").agg(F.count("*").alias("vertices"), F.round(F.sum("lat"), 6).alias("sum_lat"), F.round(F.sum("lon"), 6).alias("sum_lon"))


_BOX_LINE = ("min_lat", "min_lon"), ("max_lat", "max_lon"), ("max_lat", "min_lon")
_FILES_SQL = f"""select plan_id, 0 as feature, 'Polygon' as kind, ring, ring = 1 as is_hole, count(*) as vertices, round(sum(y1), 6) as sum_lat, round(sum(x1), 6) as sum_lon from ({_edges_sql()}) group by plan_id, ring
union all select plan_id, 1, 'LineString', 0, false, 3, round(min_lat + max_lat + max_lat, 6), round(min_lon + max_lon + min_lon, 6) from ({d.MISSIONS.sql})"""


def _kml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document a plan: its border, a line, and a line of one point (which readers drop)."""
    ring = lambda r: F.array_join(F.transform(r, lambda v: F.format_string("%.9f,%.9f,0", v["lon"], v["lat"])), " ")
    side = lambda name, r: F.concat(F.lit(f"<{name}><LinearRing><coordinates>"), ring(r), F.lit(f"</coordinates></LinearRing></{name}>"))
    line = lambda points: F.concat(F.lit("<Placemark><LineString><coordinates>"), F.concat_ws(" ", *(F.format_string("%.9f,%.9f", lon, lat) for lat, lon in points)), F.lit("</coordinates></LineString></Placemark>"))
    rows = polygons(spark, sf_dir).join(d.MISSIONS.load(spark, sf_dir), "plan_id")
    return rows.select("plan_id", F.concat(F.lit('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><Polygon>'), side("outerBoundaryIs", F.col("exterior")), side("innerBoundaryIs", F.col("holes")[0]), F.lit("</Polygon></Placemark>"), line(_BOX_LINE), line(_BOX_LINE[:1]), F.lit("</Document></kml>")).alias("text"))


@query("src_06_07_kml_files", _FILES_SQL)
def kml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(vector.read_kml(spark, _files(spark, _kml(spark, sf_dir), "kml")))


@query("src_06_07_kmz_files", _FILES_SQL)
def kmz_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read_back(vector.read_kml(spark, _files(spark, _kml(spark, sf_dir), "kmz")))


@query("src_08_09_geojson_files", _FILES_SQL)
def geojson_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a nested collection: a polygon with a hole and a multi-line of one line and one point too few."""
    ring = lambda r: F.transform(r, lambda v: F.array(v["lon"], v["lat"]))
    rows = polygons(spark, sf_dir).join(d.MISSIONS.load(spark, sf_dir), "plan_id")
    shape = F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.concat(F.array(ring(F.col("exterior"))), F.transform("holes", ring))).alias("coordinates")))
    point = lambda lat, lon: F.array(lon, lat)
    lines = F.to_json(F.struct(F.lit("MultiLineString").alias("type"), F.array(F.array(*(point(a, b) for a, b in _BOX_LINE)), F.array(point(*_BOX_LINE[0]))).alias("coordinates")))
    text = F.concat(F.lit('{"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": ['), shape, F.lit(", "), lines, F.lit(']}}, {"type": "Feature", "geometry": null}]}'))
    return _read_back(vector.read_geojson(spark, _files(spark, rows.select("plan_id", text.alias("text")), "geojson")))


# ---------------------------------------------------------------- terrain tiles

#: A tile whose file is torn.
_TORN = (40, 1)


def tile_files(spark: SparkSession) -> str:
    """The synthetic terrain as tile files, one of them torn, each written by a task; returns the folder."""
    at, size, cut = folder(spark), terrain_queries.ROWS, _TORN

    def encoded(key: tuple, posts: pd.DataFrame) -> pd.DataFrame:  # a tile is small here: 900 posts
        h = posts.sort_values(["row", "col"]).h.to_numpy(np.float32).reshape(size, size)
        data = tiles.encode_tiff(h)
        return pd.DataFrame({"name": [f"DEM_{tiles.name_of_tile(*key)}.tif"], "content": [data[:40] if key == cut else data]})

    posts = terrain_queries.posts(spark)
    torn = posts.where(f"tile_lat = {terrain_queries._TILE_LIST[0][0]} and tile_lon = {terrain_queries._TILE_LIST[0][1]}").withColumns({"tile_lat": F.lit(_TORN[0]), "tile_lon": F.lit(_TORN[1])})
    files.write_files(posts.union(torn).groupBy("tile_lat", "tile_lon").applyInPandas(encoded, "name string, content binary"), at)
    return at


@query("src_04_dem_01_tiles_to_elevations", ORACLE_SQL["dem_01_02_bilinear"])
def tiles_to_elevations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bilinear samples again, over terrain that was written to tile files and decoded from them."""
    read = tiles.read_tiles(spark, tile_files(spark)).where("error is null")
    return terrain_queries.bilinear_over(spark, sf_dir, terrain.cells(read.select("tile_lat", "tile_lon", "row", "col", "h"), ["tile_lat", "tile_lon"]))


@query(
    "src_03_tile_status",
    f"""select id, tile_lat, tile_lon, case when (tile_lat, tile_lon) in ({', '.join(map(str, terrain_queries._TILE_LIST))}) then 'ok' when tile_lat = {_TORN[0]} and tile_lon = {_TORN[1]} then 'no_data' else 'tile_not_found' end as status
from (select id, cast(floor(lat) as int) as tile_lat, cast(floor(lon) as int) as tile_lon from ({d.POINTS.sql}))""",
)
def tile_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every point, whether its tile can be read, is torn, or is not there."""
    points = d.POINTS.load(spark, sf_dir).selectExpr("id", "cast(floor(lat) as int) as tile_lat", "cast(floor(lon) as int) as tile_lon")
    return tiles.tile_status(points, tiles.read_tiles(spark, tile_files(spark))).select("id", "tile_lat", "tile_lon", "status")


#: Points over tiles of 1200 x 900 and 3600 x 3600 posts, a torn tile, one that is not there, and some off the globe.
_SIZES = {(47, 7): (1200, 900), (47, 8): (3600, 3600)}
_TORN_NORTH = (48, 8)
_OVER_TILES = d.View("events", {"id": "event_id", "lat": "case when event_id % 11 = 0 then 91e0 else 47e0 + cast((event_id * 7919) % 1000003 as double) * 1e-6 + case when event_id % 7 = 0 then 1e0 else 0e0 end end", "lon": "7.2e0 + cast((event_id * 104729) % 2000003 as double) * 1e-6"})


def _height(r: str, c: str) -> str:
    """Heights that single precision holds exactly, with voids."""
    return f"case when ({r} * 31 + {c} * 17) % 97 = 0 then -32767e0 else 3e2 + cast(({r} * 7 + {c} * 13) % 1000 as double) * 125e-3 end"


def large_tiles(spark: SparkSession) -> str:
    """Tile files in a fresh folder, each encoded and written by a task."""

    def encoded(frames):
        for f in frames:
            for t in f.itertuples():
                r, c = np.indices((t.n_rows, t.n_cols), np.int64)
                h = np.where((r * 31 + c * 17) % 97 == 0, -32767.0, 300.0 + ((r * 7 + c * 13) % 1000) * 0.125)
                data = tiles.encode_tiff(h.astype(np.float32))
                yield pd.DataFrame({"name": [f"DEM_{tiles.name_of_tile(t.lat, t.lon)}.tif"], "content": [data if t.whole else data[: len(data) // 2]]})

    rows = [(*k, *n, True) for k, n in _SIZES.items()] + [(*_TORN_NORTH, 300, 300, False)]
    at = folder(spark)
    made = spark.createDataFrame(rows, "lat int, lon int, n_rows int, n_cols int, whole boolean").repartition(len(rows)).mapInPandas(encoded, "name string, content binary")
    files.write_files(made, at)
    return at


_CORNERS = ", ".join(f"{_height(f'least(r0 + {i}, n_rows - 1)', f'least(c0 + {j}, n_cols - 1)')} as h{i}{j}" for i in (0, 1) for j in (0, 1))


@query(
    "src_04_dem_05_tile_sampling",
    f"""with p as (select id, lat, lon, lat <= 90 as coord_ok, cast(floor(lat) as int) as tl, cast(floor(lon) as int) as tn from ({_OVER_TILES.sql})),
s as (select p.*, n_rows, n_cols from p left join (values {', '.join(f'({a}, {b}, {m}, {n})' for (a, b), (m, n) in _SIZES.items())}) as t(a, b, n_rows, n_cols) on coord_ok and tl = a and tn = b),
q as (select *, least(greatest((tl + 1e0 - lat) * n_rows, 0e0), n_rows - 1e0) as r, least(greatest((lon - tn) * n_cols, 0e0), n_cols - 1e0) as c from s),
f as (select *, cast(floor(r) as bigint) as r0, cast(floor(c) as bigint) as c0 from q),
h as (select *, r - r0 as fr, c - c0 as fc, {_CORNERS} from f),
e as (select *, case when n_rows is not null and least(h00, h01, h10, h11) > -32767 then cast(cast((1e0 - fr) * ((1e0 - fc) * h00 + fc * h01) + fr * ((1e0 - fc) * h10 + fc * h11) as float) as double) end as elevation from h)
select id, coord_ok, n_rows is not null as tile_found, round(elevation, 4) + 0e0 as elevation,
  case when not coord_ok then 'bad_coordinate' when tl = {_TORN_NORTH[0]} and tn = {_TORN_NORTH[1]} then 'no_data' when n_rows is null then 'tile_not_found' when elevation is null then 'no_data' else 'ok' end as status from e""",
)
def tile_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heights of all points from tile files, of which only blocks under points are decoded."""
    found = tiles.sample_tiles(_OVER_TILES.load(spark, sf_dir), large_tiles(spark))
    return found.selectExpr("id", "coord_ok", "tile_found", "round(elevation, 4) + 0e0 as elevation", "status")


# ---------------------------------------------------------------- geoid grids


def geoid_file(spark: SparkSession) -> str:
    """A one-degree geoid grid of single precision as a file; returns its address."""
    at = folder(spark)

    def encoded(posts: pd.DataFrame) -> pd.DataFrame:
        h = posts.sort_values(["row", "col"], ascending=[False, True]).h.to_numpy("<f4")  # 181 rows of 360
        return pd.DataFrame({"name": ["geoid.flt", "geoid.hdr"], "content": [h.tobytes(), raster.header_text(181, 360, -90.0, -180.0, 1.0).encode()]})

    posts = spark.range(181 * 360).selectExpr("cast(id div 360 as int) as r", "cast(id % 360 as int) as c").selectExpr("r as row", "c as col", f"cast({terrain_queries._G96} as float) as h")
    files.write_files(posts.groupBy().applyInPandas(encoded, "name string, content binary"), at)
    return at + "/geoid.flt"


@query("geo_08_geoid_file", f"select id, round(undulation, 5) + 0e0 as undulation from ({terrain_queries.undulation_sql(terrain_queries._MIXED.sql, f'cast(cast({terrain_queries._G96} as float) as double)')})")
def geoid_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undulations over a grid that was read from its file by ranges of rows, in single precision."""
    posts = raster.read_grid(spark, geoid_file(spark)).select("row", "col", F.col("h").cast("double").alias("h"))
    cells = terrain.cells(posts.withColumn("grid", F.lit(1)), ["grid"], wrap=True).drop("grid")
    return terrain.undulation(terrain_queries._MIXED.load(spark, sf_dir), cells).selectExpr("id", "round(undulation, 5) + 0e0 as undulation")


# ---------------------------------------------------------------- streams


@query("stm_01_stream_epochs", ORACLE_SQL["stm_01_epochs"])
def stream_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences as a stream of files, in one micro-batch; as many files as the shuffle has partitions for their size."""
    at = folder(spark)
    t.sentences(spark, sf_dir).select("receiver", "seq", "sentence").repartition("receiver").write.parquet(at + "/in")
    stream = spark.readStream.schema("receiver long, seq long, sentence string").parquet(at + "/in")
    telemetry.run_available(telemetry.epochs(stream), at + "/out", at + "/checkpoint")
    found = spark.read.parquet(at + "/out")
    return found.select("receiver", "seq", "kind", "utc", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "alt", "alt_datum", "fix", F.round("ground_speed", 9).alias("ground_speed"), "course", "paired")


#: A GGA and an RMC an event, four milliseconds between events; every third receiver has a poor fix nearly always.
_LINK_AT = "1700000000000 + event_id * 4 + case when event_id >= 700 then 10000 else 0 end"
_LINK_FIX = "case when user_id % 3 = 0 and event_id % 50 <> 0 then 1 else 4 end"
_LINK_SQL = f"""with s as (select user_id as receiver, event_id * 2 + k as seq, {_LINK_AT} + k as tm, k, {_LINK_FIX} as fix from events, (values (0), (1)) as t(k)),
g as (select *, coalesce(tm - lag(tm) over w > 3000, false) as back, lead(tm) over w as later, max(tm) over () as latest from s window w as (partition by receiver order by seq)),
p as (select *, sum(case when back then 1 else 0 end) over w as sess from g window w as (partition by receiver order by seq)),
r as (select *, sum(case when fix >= 4 then 1 else 0 end) over (partition by receiver, sess order by seq) as run from p where k = 1)
select 'SILENT' as event, receiver, seq, tm + 3000 as at_ms from g where later - tm > 3000 or (later is null and tm + 3000 <= latest - 1999)
union all select 'RECONNECTED', receiver, seq, tm from g where back
union all select 'ALERT', receiver, seq, tm from (select *, row_number() over (partition by receiver, sess, run order by seq) as n from r where fix < 4) where n = 20"""


@query("stm_02_09_src_14_link_events", _LINK_SQL)
def link_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silences of three seconds, reconnects, and alerts after 20 poor fixes, of a stream in three batches of many files each."""
    at = folder(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("user_id as receiver", "event_id", f"{_LINK_AT} as at_ms", f"{_LINK_FIX} as fix")
    body = "stack(2, 0, concat('GPGGA,', utc, ',4700.5,N,00800.5,E,', cast(fix as string), ',09,0.9,400.5,M,47.1,M,,'), 1, concat('GNRMC,', utc, ',A,4700.5,N,00800.5,E,10.0,90.0,010124,,')) as (k, body)"
    e = e.repartition("receiver").withColumn("utc", F.lpad(F.col("event_id").cast("string"), 9, "0")).selectExpr("receiver", "event_id", "at_ms", body)
    check = F.lpad(F.hex(nmea.checksum(F.col("body"))), 2, "0")
    sent = e.select("receiver", (F.col("event_id") * 2 + F.col("k")).alias("seq"), F.timestamp_millis(F.col("at_ms") + F.col("k")).alias("at"), F.concat(F.lit("$"), "body", F.lit("*"), check).alias("sentence"))
    for part in ("seq < 900", "seq >= 900 and seq < 9000", "seq >= 9000"):  # in this order, a batch each: what is there when the stream goes on
        sent.where(part).write.mode("append").parquet(at + "/in")
        stream = spark.readStream.schema(sent.schema).parquet(at + "/in")
        telemetry.run_available(links.link_events(stream, late="1999 milliseconds").where("event <> 'EPOCH'"), at + "/out", at + "/checkpoint", settle=part == "seq >= 9000")
    found = spark.read.parquet(at + "/out")
    return found.select("event", "receiver", "seq", F.unix_millis("at").alias("at_ms"))


@query("src_14_15_mock_telemetry", f"select value, vehicle, lat, lon from (select seq as n, vehicle, lat, lon, count(*) over () as n_all from ({d.TELEMETRY.sql})) w join (select unnest(range(2 * (select count(*) from events) + 7)) as value) t on value % n_all = n")
def mock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks for twice round all waypoints and a few more (a batch of ticks stands in for the rate stream)."""
    way = d.TELEMETRY.load(spark, sf_dir)
    n = way.count()
    way = way.selectExpr("seq as n", f"{n}L as n_all", "vehicle", "lat", "lon")
    return telemetry.mock_telemetry(spark.range(2 * n + 7).withColumnRenamed("id", "value"), way).select("value", "vehicle", "lat", "lon")


@query("snk_17_saved_progress", f"select vehicle as plan_id, cast(seq % 4 as integer) as line_index, round(max(100e0 * (seq % 50) / 49), 9) as completion_pct from ({d.TELEMETRY.sql}) group by vehicle, seq % 4")
def saved_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of a stream of positions through the log and its snapshots, as a restart would read it."""
    at = folder(spark)
    flown = d.TELEMETRY.load(spark, sf_dir).selectExpr("vehicle as plan_id", "cast(seq % 4 as int) as line_index", "cast(seq % 50 as int) as wp_index", "50 as n_wp")
    flown.repartition(15).write.parquet(at + "/in")
    stream = spark.readStream.schema(flown.schema).option("maxFilesPerTrigger", 1).parquet(at + "/in")
    telemetry.persist_progress(telemetry.line_progress(stream), at + "/progress", at + "/checkpoint", every=None).awaitTermination()
    return telemetry.saved_progress(spark, at + "/progress").select("plan_id", "line_index", F.round("completion_pct", 9).alias("completion_pct"))


@query(
    "snk_16_warnings_init_status",
    f"""select 'WARNING' as type, vehicle as receiver, seq from (select *, row_number() over (partition by vehicle, run order by seq) as n from (select *, sum(case when fix >= 4 then 1 else 0 end) over (partition by vehicle order by seq) as run from ({d.TELEMETRY.sql})) where fix < 4) where n = 3
union all select 'INIT', plan_id, count(*) from ({_GRID_SQL}) group by plan_id union all select 'STATUS', vehicle, max(seq) from ({d.TELEMETRY.sql}) group by vehicle""",
)
def other_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of plans, states of vehicles and warnings as tagged messages, parsed again."""
    flown = d.TELEMETRY.load(spark, sf_dir)
    alerts = telemetry.warnings(tracks.rtk_alerts(flown.withColumnRenamed("vehicle", "receiver"), ["receiver"], "seq", after=3))
    plans = grid(spark, sf_dir).groupBy(F.col("plan_id").alias("receiver")).agg(F.count("*").alias("seq"))
    state = tracks.last_state(flown, ["vehicle"], "seq", ["lat", "lon", "fix"]).withColumnRenamed("vehicle", "receiver")
    sent = telemetry.messages(alerts, "WARNING").union(telemetry.messages(plans, "INIT")).union(telemetry.messages(state, "STATUS"))
    v = F.from_json("value", "type string, payload struct<receiver: long, seq: long>")
    return sent.select(v["type"].alias("type"), v["payload"]["receiver"].alias("receiver"), v["payload"]["seq"].alias("seq"))


@query("stm_09_silences", "select user_id as receiver, event_id as seq, epoch_us(ts) - epoch_us(before) as silence_us from (select *, lag(ts) over (partition by user_id order by ts, event_id) as before from events) where epoch_us(ts) - epoch_us(before) > 3600000000")
def silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences that came after a silence of an hour (the live stream asks for three seconds)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return tracks.silences(e.select(F.col("user_id").alias("receiver"), F.col("event_id").alias("seq"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us")), ["receiver"], 3600.0).select("receiver", "seq", "silence_us")


def document(df: DataFrame, plan_id: int) -> dict:
    """One exported document as Python data."""
    return json.loads(df.where(F.col("plan_id") == plan_id).first().document)
