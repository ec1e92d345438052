"""Files written by tasks, and tiles sampled where points lie."""

import numpy as np
import pytest

from aeroframe.operators import terrain
from aeroframe.sources import files, tiles


def listing(path):
    return sorted(p.name for p in path.iterdir())


def test_files_are_committed_whole(spark, tmp_path):
    at = tmp_path / "out"
    rows = spark.createDataFrame([(f"f{k}.txt", bytearray(f"text {k}".encode())) for k in range(20)], "name string, content binary").repartition(5)
    files.write_files(rows, str(at))
    assert listing(at) == sorted(f"f{k}.txt" for k in range(20)) and (at / "f7.txt").read_bytes() == b"text 7"
    # an overwrite leaves only its own files, an append keeps the others
    files.write_files(spark.createDataFrame([("new.txt", "é")], "name string, content string"), "file://" + str(at))
    assert listing(at) == ["new.txt"] and (at / "new.txt").read_text() == "é"
    files.write_files(rows.limit(1), str(at), "append")
    assert len(listing(at)) == 2
    files.write_files(rows.limit(0), str(tmp_path / "none"))
    assert listing(tmp_path / "none") == []


def test_failed_writes_leave_nothing(spark, tmp_path):
    at = tmp_path / "out"
    files.write_files(spark.createDataFrame([("old.txt", "old")], "name string, content string"), str(at))
    for bad in ([("a.txt", "1"), ("a.txt", "2")], [("a.txt", "1"), ("../b.txt", "2")], [("a.txt", "1"), ("b.txt", None)], [(None, "x")], [("_hidden", "x")]):
        with pytest.raises(Exception):
            files.write_files(spark.createDataFrame(bad, "name string, content string").repartition(2), str(at))
        assert listing(at) == ["old.txt"]
    with pytest.raises(Exception):
        files.write_files(spark.createDataFrame([("old.txt", "again")], "name string, content string"), str(at), "append")
    assert (at / "old.txt").read_text() == "old"


def terrain_files(tmp_path, rng):
    shapes = {(10, 20): (130, 70), (-1, -71): (40, 40), (10, 21): (64, 64)}
    grids = {k: rng.uniform(-50, 900, n).astype(np.float32) for k, n in shapes.items()}
    grids[10, 20][rng.uniform(size=(130, 70)) < 0.02] = -32767
    grids[10, 20][3, 4] = np.nan
    for k, g in grids.items():
        (tmp_path / f"DEM_{tiles.name_of_tile(*k)}.tif").write_bytes(tiles.encode_tiff(g, 16))
    (tmp_path / f"DEM_{tiles.name_of_tile(11, 20)}.tif").write_bytes(tiles.encode_tiff(grids[10, 21])[:3000])  # its blocks are torn
    (tmp_path / f"DEM_{tiles.name_of_tile(12, 20)}.tif").write_bytes(b"nothing")
    return grids


@pytest.mark.parametrize("share", [2_000_000, 7])
def test_sampling_equals_posts(spark, tmp_path, monkeypatch, share):
    """The heights of the post tables, which join every cell, whatever number of tasks shares a tile."""
    monkeypatch.setattr(tiles, "POINTS_PER_TASK", share)
    rng = np.random.default_rng(4)
    terrain_files(tmp_path, rng)
    rows = [(k, float(a), float(b), "x") for k, (a, b) in enumerate(zip(rng.uniform(9.9, 12.1, 600), rng.uniform(19.9, 22.1, 600)))]
    rows += [(k + 600, float(a), float(b), None) for k, (a, b) in enumerate(zip(rng.uniform(-1, 0, 50), rng.uniform(-71, -70, 50)))]
    rows += [(1000, 10.0, 20.0, "corner"), (1001, 10.99999999, 20.99999999, "corner"), (1002, 91.0, 20.0, "bad"), (1003, None, 20.0, "bad"), (1004, 10.5, float("nan"), "bad"), (1005, 10.5, 20.5, "twice"), (1005, 10.5, 20.5, "twice"), (1006, -0.5, 180.0, "east")]
    points = spark.createDataFrame(rows, "id long, lat double, lon double, `odd name` string").repartition(4)
    got = tiles.sample_tiles(points, str(tmp_path)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"id", "lat", "lon", "odd name", "coord_ok", "tile_found", "elevation", "status"}
    by = {r.id: r for r in got}
    posts = tiles.read_tiles(spark, str(tmp_path)).where("error is null and not (tile_lat = 11)")
    for (a, b), (m, n) in {(10, 20): (130, 70), (-1, -71): (40, 40), (10, 21): (64, 64)}.items():
        cells = terrain.cells(posts.where(f"tile_lat = {a} and tile_lon = {b}").select("tile_lat", "tile_lon", "row", "col", "h"), ["tile_lat", "tile_lon"])
        mine = terrain.sample(points.where(f"floor(lat) = {a} and floor(lon) = {b}"), cells, m, n).collect()
        assert mine
        for r in mine:
            assert by[r.id].elevation == r.elevation and by[r.id].tile_found and by[r.id].status == ("ok" if r.elevation is not None else "no_data")
    assert {by[k].status for k in (1002, 1003, 1004)} == {"bad_coordinate"} and by[1006].status == "tile_not_found"
    for r in got:
        if r.coord_ok and int(r.lat // 1) in (11, 12):
            assert r.elevation is None and r.status in (("no_data", "ok") if int(r.lon // 1) == 20 else ("tile_not_found",))
    assert tiles.sample_tiles(points.limit(0), str(tmp_path)).count() == 0


def test_only_touched_blocks_are_decoded():
    rng = np.random.default_rng(1)
    grid = rng.uniform(0, 9, (640, 50)).astype(np.float32)
    t = tiles.Tiff(tiles.encode_tiff(grid, 16))
    row, col = np.array([5, 5, 300, 5]), np.array([1, 2, 49, 1])
    assert (t.values(row, col) == grid[row, col]).all() and t.decoded == 2
    small = tiles.Tiff(tiles.encode_tiff(grid, 16), keep=4000)  # one block at a time
    every = rng.integers(0, 640, 500), rng.integers(0, 50, 500)
    assert (small.values(*every) == grid[every]).all() and len(small.blocks) == 1
    assert len(t.values(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0
