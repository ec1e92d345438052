import numpy as np
import pytest

from aeroframe.sources import raster


def test_grids_are_read_by_rows(spark, tmp_path, monkeypatch):
    grid = np.random.default_rng(1).uniform(-100, 100, (37, 11)).astype(np.float32)
    grid[3, 4] = -9999
    for order, name in (("<", "LSBFIRST"), (">", "MSBFIRST")):
        (tmp_path / f"{name}.flt").write_bytes(grid.astype(order + "f4").tobytes())
        (tmp_path / f"{name}.hdr").write_text(raster.header_text(37, 11, -2.0, 170.0, 0.25).replace("LSBFIRST", name))
        for parts in (1, 5, 100):
            rows = raster.read_grid(spark, f"file://{tmp_path}/{name}.flt", parts).collect()
            assert len(rows) == grid.size
            for r in rows:
                want = grid[36 - r.row, r.col]
                assert (r.h is None) == (want == -9999) and (r.h is None or r.h == float(want))
                assert (r.lat, r.lon) == (-2.0 + r.row * 0.25, 170.0 + r.col * 0.25)


def test_broken_grids(spark, tmp_path):
    (tmp_path / "a.flt").write_bytes(b"1234" * 5)
    (tmp_path / "a.hdr").write_text(raster.header_text(2, 3, 0, 0, 1))
    with pytest.raises(Exception, match="its header asks for 24"):
        raster.read_grid(spark, f"{tmp_path}/a.flt").count()
    for text in ("", "ncols x\nnrows 2", "ncols 2\nnrows 0\nxllcorner 0\nyllcorner 0\ncellsize 1", raster.header_text(2, 3, 0, 0, 1).replace("LSBFIRST", "middle")):
        with pytest.raises(ValueError):
            raster.header(text)
