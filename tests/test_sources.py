"""GeoPackage, vector files, tiles and exports."""

import io
import json
import sqlite3
import zipfile

import numpy as np
import pyarrow as pa
import pytest

from aeroframe.sources import exports, gpkg, tiles, vector


def _plan(spark, datum="EGM2008"):
    rows = [(1, i, k, 47.0 + 0.001 * k, 8.0 + 0.001 * i, 600.0, datum, i == 1, 0.05, 30.0, 60.0) for i in range(3) for k in range(4)]
    return spark.createDataFrame(rows, "plan_id long, line_index int, wp_index int, lat double, lon double, alt double, datum string, transit boolean, gsd double, side_pct double, end_pct double")


def test_blob_round_trip():
    pts = [(8.0, 47.0, 500.0), (8.1, 47.2, 510.0)]
    b = gpkg.linestring(pts)
    assert b[:4] == b"GP\x00\x05" and gpkg.parse_linestring(b) == pts
    assert [gpkg.envelope_value(b, k) for k in range(4)] == [8.0, 8.1, 47.0, 47.2]
    assert np.isnan(gpkg.envelope_value(gpkg.EMPTY_POINT, 0)) and gpkg.EMPTY_POINT[3] & 0x10
    with pytest.raises(ValueError):
        gpkg.linestring([(1.0, 2.0)])
    blobs = [b, None, gpkg.EMPTY_POINT, b"GP", gpkg.linestring([(1.0, 2.0), (-3.0, 4.0)])]
    for k in range(4):
        got = gpkg.envelope_values(pa.array(blobs, pa.binary()).slice(1), k).to_pylist()
        assert [str(x) for x in got] == [str(gpkg.envelope_value(x, k)) for x in blobs[1:]]


def test_gpkg_file(spark, tmp_path):
    spark.dataSource.register(gpkg.GpkgDataSource)
    path = str(tmp_path / "plan.gpkg")
    gpkg.encode_lines(_plan(spark), ["line_index"]).write.format("gpkg").mode("overwrite").save(path)
    assert spark.read.format("gpkg").option("partitions", "2").load(path).count() == 3
    assert gpkg.summary(path, "flight_lines") == {"rows": 3, "rtree_rows": 3, "box": pytest.approx((8.0, 47.0, 8.002, 47.003), abs=1e-5), "description": "altitude_datum=EGM2008"}
    assert gpkg.search(path, "flight_lines", (8.0005, 8.0015, 47, 48)) == [2]
    gpkg.set_completion(path, "flight_lines", {1: 50.0})
    gpkg.delete_line(path, "flight_lines", 0)
    rows = sorted((r.line_index, r.completion_pct) for r in spark.read.format("gpkg").load(path).collect())
    assert rows == [(0, 50.0), (1, 0.0)] and gpkg.summary(path, "flight_lines")["rtree_rows"] == 2
    gpkg.put_metadata(path, {"note": "x"})
    gpkg.put_metadata(path, {"note": "y"})
    assert gpkg.metadata(path)["note"] == "y"
    for text in ("surveyed", "surveyed", "checked"):
        gpkg.append_description(path, "flight_lines", text)
    assert gpkg.summary(path, "flight_lines")["description"] == "altitude_datum=EGM2008\nsurveyed\nchecked"


def test_gpkg_versions(tmp_path):
    with pytest.raises(ValueError):
        gpkg.create(str(tmp_path / "a"), "bad name;")
    plain = tmp_path / "plain.db"
    sqlite3.connect(plain).execute("create table t (a)").connection.commit()
    with pytest.raises(ValueError):
        gpkg.open_package(str(plain))
    path = str(tmp_path / "new.gpkg")
    gpkg.create(path, "lines").close()
    gpkg.put_metadata(path, {"schema_version": "99"})
    with pytest.raises(ValueError):
        gpkg.open_package(path)


KML = '<kml xmlns="http://www.opengis.net/kml/2.2"><Placemark><Polygon><outerBoundaryIs><LinearRing><coordinates>0,0 1,0,5 1,1 0,1 0,0</coordinates></LinearRing></outerBoundaryIs><innerBoundaryIs><LinearRing><coordinates>0.2,0.2 0.4,0.2 0.4,0.4</coordinates></LinearRing></innerBoundaryIs></Polygon></Placemark><Placemark><LineString><coordinates>8,47 8.1,47.1</coordinates></LineString></Placemark><Placemark><LineString><coordinates>8,47</coordinates></LineString></Placemark></kml>'


def test_kml_and_kmz(spark, tmp_path):
    (tmp_path / "a.kml").write_text(KML)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("other.kml", "<kml/>")
        z.writestr("doc.kml", KML)
    (tmp_path / "b.kmz").write_bytes(out.getvalue())
    (tmp_path / "c.kml").write_text("<kml><Polygon><outerBoundaryIs><coordinates>x,y</coordinates></outerBoundaryIs></Polygon></kml>")
    rows = vector.read_kml(spark, str(tmp_path)).collect()
    by = lambda name: [r for r in rows if r.path.endswith(name)]
    assert len(by("a.kml")) == 10 == len(by("b.kmz"))
    assert sum(bool(r.is_hole) for r in by("a.kml")) == 3 and sum(r.kind == "LineString" for r in by("a.kml")) == 2
    assert "ValueError" in by("c.kml")[0].error


def test_geojson_nesting(spark):
    shape = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": [{"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1]]], [[[5, 5], [6, 5], [6, 6]]]]}, {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2]]]}]}}]}
    df = spark.createDataFrame([(1, json.dumps(shape)), (2, "{"), (3, None)], "id long, text string")
    rows = vector.features_of_text(df, "text", "geojson").collect()
    assert sum(r.kind == "Polygon" for r in rows) == 6 and sum(r.kind == "LineString" for r in rows) == 2
    assert {r.id for r in rows if r.error} == {2, 3}


def test_tiles(spark, tmp_path):
    grid = (np.arange(130 * 70).reshape(130, 70) / 7).astype(np.float32)
    assert (tiles.decode_tiff(tiles.encode_tiff(grid)) == grid).all()
    (tmp_path / "DEM_S01_00_W071.tif").write_bytes(tiles.encode_tiff(grid))
    rows = tiles.read_tiles(spark, str(tmp_path))
    assert rows.count() == grid.size
    r = rows.where("row = 100 and col = 3").first()
    assert (r.tile_lat, r.tile_lon, r.h) == (-1, -71, pytest.approx(float(grid[100, 3])))
    with pytest.raises(ValueError):
        tiles.decode_tiff(b"II*\0\0\0\0\0"[:4])


def test_exports(spark):
    doc = json.loads(exports.geojson(_plan(spark), used_dem=True).first().document)
    assert len(doc["features"]) == 3 and doc["features"][0]["geometry"]["coordinates"][1] == [8.0, 47.001, 600.0] and "safety_warning" in doc
    assert exports.qgc(_plan(spark), 20.0).count() == 0  # wrong datum
    plan = json.loads(exports.qgc(_plan(spark, "AGL"), 20.0).first().document)
    items = plan["mission"]["items"]
    assert len(items) == 12 + 4 and items[0]["command"] == 206 and items[1]["params"][3] is None and items[1]["frame"] == 3
    assert [i["doJumpId"] for i in items] == list(range(1, 17)) and plan["mission"]["plannedHomePosition"] == [47.0, 8.0, 600.0]
    data = exports.dji_archives(_plan(spark, "EGM96")).first().archive
    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
        way = z.read("wpmz/waylines.wpml").decode()
    assert way.count("<wpml:actionGroup>") == 2 and "<wpml:actionGroupId>1</wpml:actionGroupId>" in way and "8.000000000,47.000000000" in way


def test_packages_of_many_plans(spark, tmp_path):
    way = _plan(spark)
    for k in (2, 5):
        way = way.union(_plan(spark).selectExpr(f"{k}L as plan_id", *_plan(spark).columns[1:]))
    at = str(tmp_path / "plans")
    short = spark.createDataFrame([(2, 9, 0, 47.0, 8.0, 1.0, "EGM96", False, 0.0, 0.0, 0.0)], way.schema)  # one point: no line
    lines = gpkg.encode_lines(way.union(short), ["plan_id", "line_index"]).withColumn("altitude_datum", exports.F.lit("EGM2008"))
    gpkg.write_packages(lines.repartition(7), at)
    assert sorted(p.name for p in (tmp_path / "plans").iterdir()) == [f"plan-{k:06d}.gpkg" for k in (1, 2, 5)]
    # they are ordinary files for the single-package functions
    assert gpkg.summary(f"{at}/plan-000005.gpkg", "flight_lines")["rows"] == 3 and gpkg.search(f"{at}/plan-000005.gpkg", "flight_lines", (8.0005, 8.0015, 47, 48)) == [2]
    (tmp_path / "plans/plan-000009.gpkg").write_bytes(b"SQLite format 3\0 torn")
    packages = gpkg.package_files(spark, at)
    rows = gpkg.read_packages(packages).collect()
    assert len(rows) == 10 and [r.plan_id for r in rows if r.error] == [9]
    assert {r.plan_id: r.error is None for r in gpkg.package_summaries(packages).collect()} == {1: True, 2: True, 5: True, 9: False}
    good = packages.where("plan_id < 9")
    changes = spark.createDataFrame([(1, 0, 25.0, False), (1, 1, None, True), (1, 2, 75.0, None), (2, 0, None, True), (2, 1, None, True), (7, 0, 1.0, True)], "plan_id long, line_index long, completion_pct double, gone boolean")
    new = gpkg.revise(good, changes, description="seen", values={"a": "b"}).collect()
    assert len(new) == 3
    left = {r.name: [x[:] for x in gpkg.open_package(bytes(r.content)).execute("select line_index, completion_pct from flight_lines order by id")] for r in new}
    assert left == {"plan-000001.gpkg": [(0, 25.0), (1, 75.0)], "plan-000002.gpkg": [(0, 0.0)], "plan-000005.gpkg": [(0, 0.0), (1, 0.0), (2, 0.0)]}
    assert all(gpkg.summary(bytes(r.content), "flight_lines")["rtree_rows"] == len(left[r.name]) and gpkg.metadata(bytes(r.content))["a"] == "b" for r in new)


def test_points_of_blobs():
    lines = [[(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)], [(float(k), -float(k), 0.5) for k in range(7)]]
    count, points = gpkg.line_points(pa.array([b"", *map(gpkg.linestring, lines)], pa.binary()).slice(1))
    assert count.tolist() == [2, 7] and list(map(tuple, points)) == lines[0] + lines[1]
    assert gpkg.line_points(pa.array([], pa.binary()))[1].shape == (0, 3)
    for bad in (gpkg.linestring([(1.0, 2.0), (3.0, 4.0)]), gpkg.linestring(lines[0])[:-1], b"GP"):
        with pytest.raises(ValueError):
            gpkg.line_points(pa.array([bad], pa.binary()))


def test_packages_travel_in_small_batches(spark, tmp_path):
    """A partition of many packages reaches a task's Python a few megabytes at a time."""
    import pyarrow as pa

    from aeroframe.sources import gpkg

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    for k in range(60):
        (tmp_path / f"plan-{k:06d}.gpkg").write_bytes(bytes(300_000))
    rows = gpkg.package_files(spark, str(tmp_path)).repartition(1)
    sizes = [r.n for r in rows.mapInArrow(lambda batches: (pa.record_batch({"n": pa.array([b.column("content").nbytes])}) for b in batches), "n long").collect()]
    assert sum(sizes) >= 18_000_000 and max(sizes) <= 2 * gpkg.BATCH_BYTES


def test_packages_are_laid_out_once_a_process(monkeypatch):
    """Each starts as a copy of the empty one and is a package like any other."""
    laid = []
    create = gpkg.create
    monkeypatch.setattr(gpkg, "create", lambda *a: laid.append(a) or create(*a))
    gpkg._empty.cache_clear()
    blob = gpkg.linestring([(8.0, 47.0, 400.0), (9.0, 48.0, 500.0)])
    for k in range(5):
        db = gpkg.create_in_memory("flight_lines")
        with db:
            db.executemany(gpkg._INSERT.format("flight_lines"), [(n, "EGM96", 0.0, None, blob) for n in range(k)])
        data = db.serialize()
        assert gpkg.summary(data, "flight_lines") | {"box": None, "description": None} == {"rows": k, "rtree_rows": k, "box": None, "description": None}
        assert gpkg.metadata(data) == {"schema_version": "3"}
    assert len(laid) == 1


def test_track_packages_are_read_once(spark):
    from aeroframe.plans.catalog import QUERIES

    plan = QUERIES["snk_01_03_08_track_packages"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("binaryFile") == 1 and plan.count("MapInArrow") == 1


def _folder_of_packages(at, n):
    blob = gpkg.linestring([(8.0, 47.0, 400.0), (9.0, 48.0, 500.0)])
    at.mkdir()
    for plan in range(n):
        db = gpkg.create_in_memory("flight_lines")
        with db:
            db.executemany(gpkg._INSERT.format("flight_lines"), [(k, "EGM96", 0.0, None, blob) for k in range(3)])
            gpkg._describe(db, "flight_lines")
        (at / f"plan-{plan:06d}.gpkg").write_bytes(db.serialize())


def test_revisions_hold_packages_once_and_a_slice_twice(spark, tmp_path, monkeypatch):
    """Slices are committed one after the other and their sources go, so that a folder of any size needs little room beside it."""
    import threading

    n, slices = 60, 5
    a, b, c = (tmp_path / x for x in "abc")
    _folder_of_packages(a, n)
    monkeypatch.setattr(gpkg, "SLICE_BYTES", -(-sum(p.stat().st_size for p in a.iterdir()) // slices))
    changes = spark.range(n).selectExpr("id as plan_id", "explode(array(0L, 1L, 2L)) as line_index").selectExpr("plan_id", "line_index", "case when line_index = 2 then cast(plan_id as double) end as completion_pct", "line_index = plan_id % 2 as gone")
    gpkg.revise_folder(spark, str(a), str(b), changes, description="seen", values={"note": "x"})
    assert len(list(a.iterdir())) == len(list(b.iterdir())) == n
    plain = {r.name: bytes(r.content) for r in gpkg.revise(gpkg.package_files(spark, str(a)), changes, description="seen", values={"note": "x"}).collect()}
    lines = lambda data: gpkg.open_package(data).execute("select id, line_index, completion_pct, geom from flight_lines order by id").fetchall()
    for p in b.iterdir():
        data = p.read_bytes()
        assert lines(data) == lines(plain[p.name]) and gpkg.metadata(data) == {"schema_version": "3", "note": "x"}
        assert gpkg.summary(data, "flight_lines") == gpkg.summary(plain[p.name], "flight_lines") and gpkg.description(data, "flight_lines") == "altitude_datum=EGM96\nseen"

    seen, done = [], threading.Event()

    def watch():
        while not done.is_set():
            seen.append(sum(1 for at in (b, c) for p in at.rglob("*") if p.is_file()))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        gpkg.revise_folder(spark, str(b), str(c), description="seen", values={"note": "y"}, keep=False)
    finally:
        done.set()
        watcher.join()
    assert n <= max(seen) < 1.7 * n
    assert list(b.iterdir()) == [] and sorted(p.name for p in c.iterdir()) == [f"plan-{k:06d}.gpkg" for k in range(n)]
    rows = gpkg.read_packages(gpkg.package_paths(spark, str(c)), told=True).collect()
    assert {(r.plan_id, r.line_index, r.completion_pct, r.description, r.metadata["note"]) for r in rows} == {(k, i, float(k) if i == 1 else 0.0, "altitude_datum=EGM96\nseen", "y") for k in range(n) for i in range(2)}


def test_packages_by_path_are_read_by_tasks(spark, tmp_path):
    at = tmp_path / "with space"
    _folder_of_packages(at, 4)
    (at / "plan-000009.gpkg").write_bytes(b"SQLite format 3\0 torn")
    paths = gpkg.package_paths(spark, str(at))
    rows = gpkg.read_packages(paths, told=True).collect()
    assert sorted(r.plan_id for r in rows) == sorted([0, 1, 2, 3] * 3 + [9]) and [r.plan_id for r in rows if r.error] == [9]
    assert {r.plan_id: r.n_rows for r in gpkg.package_summaries(paths).collect()} == {0: 3, 1: 3, 2: 3, 3: 3, 9: None}
    changes = spark.createDataFrame([(1, 0, None, True)], "plan_id long, line_index long, completion_pct double, gone boolean")
    revised = gpkg.revise(paths.where("plan_id < 9"), changes)
    assert "content" not in paths._jdf.queryExecution().executedPlan().toString()
    assert {r.name: gpkg.summary(bytes(r.content), "flight_lines")["rows"] for r in revised.collect()} == {"plan-000000.gpkg": 3, "plan-000001.gpkg": 2, "plan-000002.gpkg": 3, "plan-000003.gpkg": 3}


def test_revised_tracks_are_kept_once(spark):
    """Of three writes of a package a vehicle, only the last is left."""
    from pathlib import Path

    from aeroframe.plans.catalog import QUERIES

    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    packages = lambda: {p for p in shared.rglob("plan-*.gpkg")}
    before = packages()
    rows = QUERIES["snk_09_10_revised_packages"](spark, "/root/testdata/sf0.001").collect()
    assert len(packages() - before) == len({r.plan_id for r in rows}) > 0


def test_scratch_folders_are_removed(tmp_path):
    from aeroframe.sources import files

    (tmp_path / "made").mkdir()
    (tmp_path / "made/a").write_text("a")
    files.remove_folder("file://" + str(tmp_path / "made"))
    files.remove_folder("file://" + str(tmp_path / "none"))
    assert list(tmp_path.iterdir()) == []
