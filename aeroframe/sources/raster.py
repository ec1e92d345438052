"""Float grids as Spark rows: ``.flt`` files of single-precision values beside a ``.hdr`` of text.

The values lie row by row from the north. A partition reads a range of rows with one
seek, so a grid of any size is read in parallel and no task holds more than a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .files import filesystem

#: Values that are read at once.
BLOCK = 1 << 20


def header(text: str) -> dict:
    """Rows, columns, south-west corner, step, void value and byte order of a header; ValueError if any is missing."""
    found = dict(line.lower().split()[:2] for line in text.splitlines() if len(line.split()) >= 2)
    try:
        out = {"rows": int(found["nrows"]), "cols": int(found["ncols"]), "south": float(found.get("yllcorner", found.get("yllcenter"))), "west": float(found.get("xllcorner", found.get("xllcenter"))), "step": float(found["cellsize"])}
    except (KeyError, TypeError, ValueError) as e:
        raise ValueError(f"not a grid header: {e!r}") from e
    if out["rows"] < 1 or out["cols"] < 1 or not out["step"] > 0:
        raise ValueError("grid without cells")
    order = {"lsbfirst": "<", "msbfirst": ">"}.get(found.get("byteorder", "lsbfirst"))
    if order is None:
        raise ValueError(f"byte order {found['byteorder']}")
    return out | {"order": order, "void": float(found.get("nodata_value", "nan"))}


def header_text(rows: int, cols: int, south: float, west: float, step: float, void: float = -9999.0) -> str:
    return f"ncols {cols}\nnrows {rows}\nxllcenter {west!r}\nyllcenter {south!r}\ncellsize {step!r}\nNODATA_value {void!r}\nbyteorder LSBFIRST\n"


class _Rows(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.parts = options["path"], int(options.get("partitions", "8"))

    def _head(self) -> dict:
        fs, at = filesystem(self.path)
        with fs.open_input_stream(at.removesuffix(".flt") + ".hdr") as f:
            head = header(f.read().decode())
        size = fs.get_file_info(at).size
        if size != 4 * head["rows"] * head["cols"]:
            raise ValueError(f"grid has {size} bytes, its header asks for {4 * head['rows'] * head['cols']}")
        return head

    def partitions(self) -> list[InputPartition]:
        rows = self._head()["rows"]
        edges = np.linspace(0, rows, min(self.parts, rows) + 1).astype(int).tolist()
        return [_Rows(a, b) for a, b in zip(edges, edges[1:])]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        head = self._head()
        cols = head["cols"]
        fs, at = filesystem(self.path)
        with fs.open_input_file(at) as f:
            step = max(1, BLOCK // cols)
            for r in range(partition.first, partition.last, step):
                n = min(step, partition.last - r)
                f.seek(4 * r * cols)
                h = np.frombuffer(f.read(4 * n * cols), head["order"] + "f4").astype(np.float32)
                from_south = head["rows"] - 1 - np.repeat(np.arange(r, r + n, dtype=np.int32), cols)
                col = np.tile(np.arange(cols, dtype=np.int32), n)
                yield pa.record_batch({
                    "row": from_south.astype(np.int32),
                    "col": col,
                    "lat": head["south"] + from_south * head["step"],
                    "lon": head["west"] + col * head["step"],
                    "h": pa.array(h, mask=(h == np.float32(head["void"])) | np.isnan(h)),
                })


class Raster(DataSource):
    """``spark.read.format("aeroframe_raster").load("grid.flt")``; row 0 is the southernmost; option ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return "aeroframe_raster"

    def schema(self) -> str:
        return "row int, col int, lat double, lon double, h float"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def read_grid(spark: SparkSession, path: str, partitions: int = 8) -> DataFrame:
    """Posts (row from the south, col from the west, lat, lon, h single precision, null where void) of a float grid."""
    spark.dataSource.register(Raster)
    return spark.read.format("aeroframe_raster").option("partitions", str(partitions)).load(path)
