"""Terrain tiles: single-precision TIFF grids, sampled where points lie, or read as rows of posts.

Sampling brings the points of a tile and the tile's bytes together and decodes the
blocks that points touch; no post becomes a row. Files are read with ``binaryFile``,
so any store that Spark reads will do. A tile that does not exist is an absent row.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.constants import DEM_VOID

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 11: 4, 12: 8, 16: 8}
# Columns of a tile of 3600 rows, below each latitude.
COLUMNS = ((50, 3600), (60, 2400), (70, 1800), (80, 1200), (85, 720), (91, 360))
_NAME = re.compile(r"([NS])(\d{2})_00_([EW])(\d{3})")


def tile_of_name(path: str) -> tuple[int, int]:
    """South-west corner of a tile by its file name."""
    m = _NAME.search(path)
    if not m:
        raise ValueError(f"no tile name in {path}")
    return int(m[2]) * (1 if m[1] == "N" else -1), int(m[4]) * (1 if m[3] == "E" else -1)


def name_of_tile(lat: int, lon: int) -> str:
    """The part of a tile's file name that says where it is."""
    return f"{'N' if lat >= 0 else 'S'}{abs(lat):02d}_00_{'E' if lon >= 0 else 'W'}{abs(lon):03d}"


class Tiff:
    """A one-band float32 TIFF whose blocks (strips or tiles, plain or deflated, predictors 1 and 3) are decoded when they are touched.

    Anything else, or a file that is cut off, raises ValueError.
    """

    def __init__(self, data: bytes, keep: int = 64 << 20) -> None:
        """``keep``: bytes of decoded blocks that stay in memory."""
        self.data, self.keep, self.blocks, self.held = data, keep, {}, 0
        self.decoded = 0
        try:
            self._head()
        except (struct.error, KeyError, IndexError) as e:
            raise ValueError(f"not a whole TIFF: {e!r}") from e

    def _head(self) -> None:
        data = self.data
        self.order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
        order = self.order
        if not order or struct.unpack_from(order + "H", data, 2)[0] != 42:
            raise ValueError("not a TIFF")
        at = struct.unpack_from(order + "I", data, 4)[0]
        tags = {}
        for k in range(struct.unpack_from(order + "H", data, at)[0]):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            size = _SIZES.get(kind, 1) * count
            where = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * k)[0]
            if kind in (3, 4):
                tags[tag] = struct.unpack_from(f"{order}{count}{'H' if kind == 3 else 'I'}", data, where)
        self.cols, self.rows = tags[256][0], tags[257][0]
        if tags.get(258, (32,))[0] != 32 or tags.get(339, (1,))[0] != 3 or tags.get(277, (1,))[0] != 1:
            raise ValueError("only one band of 32-bit floats is read")
        self.compression, self.predictor = tags.get(259, (1,))[0], tags.get(317, (1,))[0]
        if self.compression not in (1, 8, 32946) or self.predictor not in (1, 3):
            raise ValueError(f"compression {self.compression} with predictor {self.predictor} is not read")
        self.tiled = 322 in tags
        self.w, self.h = (tags[322][0], tags[323][0]) if self.tiled else (self.cols, tags.get(278, (self.rows,))[0])
        self.offsets, self.sizes = (tags[324], tags[325]) if self.tiled else (tags[273], tags[279])
        if not (self.cols and self.rows and self.w and self.h):
            raise ValueError("TIFF without pixels")
        self.across = -(-self.cols // self.w)
        if len(self.offsets) != len(self.sizes) or len(self.offsets) < self.across * -(-self.rows // self.h):
            raise ValueError("TIFF with too few blocks for its pixels")

    def block(self, k: int) -> np.ndarray:
        """Block ``k`` as (rows, columns)."""
        if k in self.blocks:
            return self.blocks[k]
        o, n = self.offsets[k], self.sizes[k]
        try:
            raw = self.data[o : o + n] if self.compression == 1 else zlib.decompress(self.data[o : o + n])
        except zlib.error as e:
            raise ValueError(f"not a whole TIFF: {e!r}") from e
        high = self.h if self.tiled else min(self.h, self.rows - k // self.across * self.h)
        if len(raw) < high * self.w * 4:
            raise ValueError("TIFF block is too short")
        if self.predictor == 3:  # bytes of equal weight lie together, and each is a difference to the one before
            planes = np.cumsum(np.frombuffer(raw, np.uint8, high * self.w * 4).reshape(high, 4 * self.w), axis=1, dtype=np.uint8).reshape(high, 4, self.w)
            out = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(">f4").reshape(high, self.w)
        else:
            out = np.frombuffer(raw, self.order + "f4", high * self.w).reshape(high, self.w)
        out = out.astype(np.float32)
        self.decoded += 1
        while self.blocks and self.held + out.nbytes > self.keep:
            self.held -= self.blocks.pop(next(iter(self.blocks))).nbytes
        self.blocks[k] = out
        self.held += out.nbytes
        return out

    def values(self, row: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Values at places, from the blocks they lie in, one block after the other."""
        number = row // self.h * self.across + col // self.w
        order = np.argsort(number, kind="stable")
        out = np.empty(len(row), np.float32)
        for mine in np.split(order, np.flatnonzero(np.diff(number[order])) + 1) if len(row) else []:
            out[mine] = self.block(int(number[mine[0]]))[row[mine] % self.h, col[mine] % self.w]
        return out

    def grid(self) -> np.ndarray:
        out = np.full((-(-self.rows // self.h) * self.h, self.across * self.w), np.nan, np.float32)
        for k in range(len(self.offsets)):
            r, c, b = k // self.across * self.h, k % self.across * self.w, self.block(k)
            out[r : r + len(b), c : c + self.w] = b
        return out[: self.rows, : self.cols]


def decode_tiff(data: bytes) -> np.ndarray:
    """All values of a TIFF as (rows, columns)."""
    return Tiff(data).grid()


def encode_tiff(grid: np.ndarray, rows_per_strip: int = 64) -> bytes:
    """A float32 grid as a deflated TIFF with predictor 3, in strips."""
    rows, cols = grid.shape
    strips = []
    for r in range(0, rows, rows_per_strip):
        part = np.ascontiguousarray(grid[r : r + rows_per_strip], ">f4")
        planes = part.view(np.uint8).reshape(len(part), cols, 4).transpose(0, 2, 1).reshape(len(part), 4 * cols)
        moved = planes.copy()
        moved[:, 1:] -= planes[:, :-1]
        strips.append(zlib.compress(moved.tobytes()))
    n = len(strips)
    entries = [(256, 4, [cols]), (257, 4, [rows]), (258, 3, [32]), (259, 3, [8]), (262, 3, [1]), (273, 4, None), (277, 3, [1]), (278, 4, [rows_per_strip]), (279, 4, [len(s) for s in strips]), (317, 3, [3]), (339, 3, [3])]
    head = 8 + 2 + 12 * len(entries) + 4
    start = head + 8 * n
    at = np.cumsum([start, *(len(s) for s in strips)])[:-1].tolist()
    body, extra = b"", b""
    for tag, kind, values in entries:
        values = at if values is None else values
        packed = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(packed) > 4:
            body += struct.pack("<HHII", tag, kind, len(values), head + len(extra))
            extra += packed
        else:
            body += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + body + struct.pack("<I", 0) + extra.ljust(8 * n, b"\0") + b"".join(strips)


def expected_columns(lat: int) -> int:
    """Columns of a one-degree tile by latitude, for 3600 rows."""
    return next(n for edge, n in COLUMNS if abs(lat) < edge)


def _posts(name: str, data: bytes) -> Iterator[dict]:
    lat, lon = tile_of_name(name)
    grid = decode_tiff(data)
    rows, cols = grid.shape
    if rows == 3600 and cols != expected_columns(lat):
        raise ValueError(f"tile has {cols} columns, {expected_columns(lat)} are due at its latitude")
    for r in range(0, rows, 256):
        part = grid[r : r + 256]
        n = part.size
        full = lambda v, n=n: pa.array(np.full(n, v, np.int32))
        yield {"tile_lat": full(lat), "tile_lon": full(lon), "n_rows": full(rows), "n_cols": full(cols), "row": np.repeat(np.arange(r, r + len(part), dtype=np.int32), cols), "col": np.tile(np.arange(cols, dtype=np.int32), len(part)), "h": part.reshape(-1), "path": pa.array([name] * n), "error": pa.nulls(n, pa.string())}


_POSTS = pa.schema([(k, pa.int32()) for k in ("tile_lat", "tile_lon", "n_rows", "n_cols", "row", "col")] + [("h", pa.float32()), ("path", pa.string()), ("error", pa.string())])


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    """Posts (tile_lat, tile_lon, n_rows, n_cols, row, col, h, path, error) of all tiles under ``path``; row 0 is the northernmost.

    A file that is not a tile gives one row with its error and no post.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    for posts in _posts(name, data):
                        yield pa.record_batch(posts).cast(_POSTS) if hasattr(pa.RecordBatch, "cast") else pa.Table.from_pydict(posts, _POSTS).to_batches()[0]
                except ValueError as e:
                    yield pa.RecordBatch.from_pylist([{"path": name, "error": str(e)}], _POSTS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(path).select("path", "content")
    return files.mapInArrow(run, "tile_lat int, tile_lon int, n_rows int, n_cols int, row int, col int, h float, path string, error string")


#: Points of one tile that one task samples, about; more of them get the tile's bytes in several tasks.
POINTS_PER_TASK = 2_000_000
#: Bytes of an Arrow batch: a tile may have tens of megabytes.
BATCH_BYTES = 64 << 20


def tile_index(spark: SparkSession, path: str) -> DataFrame:
    """(tile_lat, tile_lon, path) of the tile files under ``path``, by their names; no content is read."""
    at = lambda i: F.regexp_extract("path", _NAME.pattern, i)
    signed = lambda side, value, plus: F.when(at(side) == plus, 1).otherwise(-1) * at(value).cast("int")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").load(path).select("path").where(F.col("path").rlike(_NAME.pattern))
    return files.select(signed(1, 2, "N").alias("tile_lat"), signed(3, 4, "E").alias("tile_lon"), "path")


def _place(tile_lat: int, tile_lon: int, lat: np.ndarray, lon: np.ndarray, rows: int, cols: int) -> tuple[np.ndarray, ...]:
    r = np.minimum(np.maximum((float(tile_lat) + 1.0 - lat) * rows, 0.0), rows - 1.0)
    c = np.minimum(np.maximum((lon - float(tile_lon)) * cols, 0.0), cols - 1.0)
    row, col = np.floor(r).astype(np.int64), np.floor(c).astype(np.int64)
    return row, col, r - row, c - col


def bilinear(tiff: Tiff, tile_lat: int, tile_lon: int, lat: np.ndarray, lon: np.ndarray, void: float = DEM_VOID) -> np.ndarray:
    """Heights at points of a tile: neighbours clamped at its edges, narrowed to single precision, nan at a void."""
    row, col, fr, fc = _place(tile_lat, tile_lon, lat, lon, tiff.rows, tiff.cols)
    below, right = np.minimum(row + 1, tiff.rows - 1), np.minimum(col + 1, tiff.cols - 1)
    h = [tiff.values(r, c).astype(np.float64) for r, c in ((row, col), (row, right), (below, col), (below, right))]
    out = (1.0 - fr) * ((1.0 - fc) * h[0] + fc * h[1]) + fr * ((1.0 - fc) * h[2] + fc * h[3])
    out = out.astype(np.float32).astype(np.float64)
    out[np.logical_or.reduce([np.isnan(x) | (x <= void) for x in h])] = np.nan
    return out


def sample_tiles(points: DataFrame, path: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``points`` with ``elevation`` (null where there is none), ``coord_ok``, ``tile_found`` and ``status``.

    ``status``: ok, no_data (a void, or a file that cannot be read), tile_not_found, bad_coordinate. Only
    files of tiles that points touch are read. Each task gets a tile's bytes followed by its points, which
    stream by; it holds one tile and a bounded part of its decoded blocks. A tile with very many points is
    dealt to several tasks.
    """
    spark = points.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    ok = F.coalesce(y.between(-90, 90) & x.between(-180, 180) & ~F.isnan(y) & ~F.isnan(x), F.lit(False))
    east = F.when(x >= 180, x - 360).otherwise(x)
    placed = points.withColumns({"coord_ok": ok, "_x": F.when(ok, east), "_y": F.when(ok, y)})
    placed = placed.withColumns({"tile_lat": F.floor("_y").cast("int"), "tile_lon": F.floor("_x").cast("int")})
    # a row a tile, of the 180 x 361 there can be: how many tasks share it
    crowd = placed.where("coord_ok").groupBy("tile_lat", "tile_lon").count()
    shares = tile_index(spark, path).join(crowd, ["tile_lat", "tile_lon"]).select("path", "tile_lat", "tile_lon", F.ceil(F.col("count") / POINTS_PER_TASK).cast("int").alias("_shares"))
    known = shares.collect()
    carried = [f"`{n}`" for n in points.columns]
    empty = spark.createDataFrame([], points.schema)
    row = F.struct(*carried).alias("_point")
    place = F.broadcast(spark.createDataFrame([(r.tile_lat, r.tile_lon, r._shares) for r in known], "tile_lat int, tile_lon int, _shares int").groupBy("tile_lat", "tile_lon").agg(F.max("_shares").alias("_shares")))
    part = F.pmod(F.xxhash64(*[c for c, t in points.dtypes if not t.startswith(("map", "variant"))]), F.coalesce("_shares", F.lit(64)))
    wanted = placed.join(place, ["tile_lat", "tile_lon"], "left").select("tile_lat", "tile_lon", part.cast("int").alias("_part"), F.lit(1).alias("_kind"), F.lit(None).cast("binary").alias("_bytes"), "_x", "_y", "coord_ok", row)
    if known:
        files = spark.read.format("binaryFile").load([r.path for r in known]).select("path", F.col("content").alias("_bytes"))
        tiles_ = files.join(F.broadcast(spark.createDataFrame(known, shares.schema)), "path").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
        nothing = F.lit(None).cast(empty.select(row).schema[0].dataType).alias("_point")
        wanted = wanted.union(tiles_.select("tile_lat", "tile_lon", "_part", F.lit(0), "_bytes", F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(True), nothing))
    dealt = wanted.repartition("tile_lat", "tile_lon", "_part").sortWithinPartitions("tile_lat", "tile_lon", "_part", "_kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tiff, state = None, None, None  # the tile whose bytes came last
        for batch in batches:
            keys = list(zip(*(batch.column(n).to_pylist() for n in ("tile_lat", "tile_lon", "_part", "_kind")), strict=True))
            k = 0
            while k < len(keys):
                end = k + 1
                while end < len(keys) and keys[end] == keys[k]:
                    end += 1
                if keys[k][:3] != at:
                    at, tiff, state = keys[k][:3], None, "tile_not_found" if keys[k][0] is not None else "bad_coordinate"
                if keys[k][3] == 0:
                    for j in range(k, end):  # of several files of a tile the first that can be read counts
                        if tiff is None:
                            try:
                                tiff, state = Tiff(batch.column("_bytes")[j].as_py()), "ok"
                                if tiff.rows == 3600 and tiff.cols != expected_columns(at[0]):
                                    raise ValueError("columns")
                            except ValueError:
                                tiff, state = None, "no_data"
                else:
                    n = end - k
                    part = batch.slice(k, n)
                    height = np.full(n, np.nan)
                    if tiff is not None:
                        try:
                            height = bilinear(tiff, at[0], at[1], part.column("_y").to_numpy(), part.column("_x").to_numpy())
                        except ValueError:  # a block is torn
                            tiff, state = None, "no_data"
                    nan = np.isnan(height)
                    status = np.where(nan, "no_data", "ok") if state == "ok" else np.full(n, state)
                    yield pa.record_batch({"_point": part.column("_point"), "coord_ok": part.column("coord_ok"), "tile_found": pa.array(np.full(n, tiff is not None)), "elevation": pa.array(height, mask=nan), "status": pa.array(status.astype(object), pa.string())})
                k = end

    out = StructType([empty.select(row).schema[0], *StructType.fromDDL("coord_ok boolean, tile_found boolean, elevation double, status string").fields])
    found = dealt.mapInArrow(run, out)
    return found.select("_point.*", "coord_ok", "tile_found", "elevation", "status")


def tile_status(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """``points`` (with tile_lat and tile_lon) with ``status``: ok, no_data (the tile cannot be read) or tile_not_found."""
    known = tiles.where("row = 0 and col = 0").select("tile_lat", "tile_lon", F.lit("ok").alias("_found"))
    bad = tiles.where("error is not null").select(F.regexp_extract("path", _NAME.pattern, 0).alias("_stem")).distinct()
    tag = lambda c, plus, minus, width: F.concat(F.when(F.col(c) >= 0, plus).otherwise(minus), F.lpad(F.abs(c).cast("string"), width, "0"))
    stem = F.concat(tag("tile_lat", "N", "S", 2), F.lit("_00_"), tag("tile_lon", "E", "W", 3))
    joined = points.withColumn("_stem", stem).join(known, ["tile_lat", "tile_lon"], "left").join(bad.withColumn("_bad", F.lit(True)), "_stem", "left")
    return joined.withColumn("status", F.coalesce("_found", F.when(F.col("_bad"), "no_data"), F.lit("tile_not_found"))).drop("_found", "_bad", "_stem")
