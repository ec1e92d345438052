"""GeoPackage: geometry blobs, packages of many plans, and a data source for a single one.

A package is one SQLite file. ``write_packages`` makes one for each plan: tasks build them
in memory from streamed lines and write the finished bytes, the commit renames.
``read_packages`` and ``revise`` work on their bytes in tasks too: on a column of content, which any
store that Spark reads gives, or on paths, which tasks read themselves, so that no content is shuffled.
The format ``gpkg`` writes all rows to one file, which one commit does.
"""

from __future__ import annotations

import json
import os
import sqlite3
import struct
from collections.abc import Iterator
from contextlib import closing, contextmanager
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from . import files

# Fixed values of the format: application id, user version, geometry type codes, SRS.
APPLICATION_ID = 1196444487
USER_VERSION = 10300
LINESTRING, LINESTRING_Z = 2, 1002
SRS_ID = 4326
METADATA_TABLE = "plan_metadata"
SCHEMA_VERSION = 3
EMPTY_POINT = bytes.fromhex("47500011") + struct.pack("<i", SRS_ID) + b"\x01" + struct.pack("<I", 1) + bytes.fromhex("000000000000f87f") * 2


def linestring(coords: list[tuple], srs_id: int = SRS_ID) -> bytes:
    """Package blob of a line of (x, y) or (x, y, z): header, envelope, well-known binary."""
    if len(coords) < 2:
        raise ValueError("a line needs two points")
    n = len(coords[0])
    columns = list(zip(*coords, strict=True))
    envelope = [v for c in columns for v in (min(c), max(c))]
    head = b"GP\x00" + bytes([0x03 if n == 2 else 0x05]) + struct.pack("<i", srs_id) + struct.pack(f"<{2 * n}d", *envelope)
    body = struct.pack("<BII", 1, LINESTRING if n == 2 else LINESTRING_Z, len(coords))
    return head + body + struct.pack(f"<{n * len(coords)}d", *(v for p in coords for v in p))


def parse_linestring(blob: bytes) -> list[tuple]:
    """Coordinates of a package blob of a line, with or without z."""
    size = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(blob[3] >> 1) & 7]
    _, kind, count = struct.unpack_from("<BII", blob, 8 + size)
    if kind not in (LINESTRING, LINESTRING_Z):
        raise ValueError(f"geometry type {kind} is not a line")
    n = 3 if kind == LINESTRING_Z else 2
    flat = struct.unpack_from(f"<{n * count}d", blob, 8 + size + 9)
    return [flat[i : i + n] for i in range(0, len(flat), n)]


def envelope_value(blob: bytes | None, index: int) -> float | None:
    """Envelope entry (0 min x, 1 max x, 2 min y, 3 max y); nan where the blob has none."""
    if blob is None:
        return None
    if len(blob) < 40 or not (blob[3] >> 1) & 7:
        return float("nan")
    return struct.unpack_from("<d", blob, 8 + 8 * index)[0]


def register_functions(spark: SparkSession) -> None:
    """SQL functions st_minx, st_maxx, st_miny, st_maxy and st_isempty over blobs."""
    for k, name in enumerate(("st_minx", "st_maxx", "st_miny", "st_maxy")):
        spark.udf.register(name, _envelope(k))
    spark.udf.register("st_isempty", _is_empty())


def _envelope(k: int):
    return F.arrow_udf(lambda blobs: envelope_values(blobs, k), "double")


def _is_empty():
    def read(blobs: pa.Array) -> pa.Array:
        raw, start, length, null = _bytes_of(blobs)
        out = np.zeros(len(start), bool)
        some = np.flatnonzero(length > 3)
        out[some] = raw[start[some] + 3] & 0x10 > 0
        return pa.array(out, mask=null)

    return F.arrow_udf(read, "boolean")


def _bytes_of(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of a batch of blobs; where each begins, its length, and which are null."""
    null = blobs.is_null().to_numpy(zero_copy_only=False)
    blobs = blobs.cast(pa.large_binary())
    _, offsets, data = blobs.buffers()
    at = np.frombuffer(offsets, np.int64)[blobs.offset : blobs.offset + len(blobs) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at[:-1], np.diff(at), null


def envelope_values(blobs: pa.Array, index: int) -> pa.Array:
    """``envelope_value`` of a whole batch: the eight bytes at one place of every blob, read together."""
    raw, start, length, null = _bytes_of(blobs)
    out = np.full(len(start), np.nan)
    some = np.flatnonzero(length >= 40)
    some = some[raw[start[some] + 3] >> 1 & 7 > 0]
    if len(some):
        out[some] = raw[start[some][:, None] + 8 + 8 * index + np.arange(8)].copy().view("<f8")[:, 0]
    return pa.array(out, mask=null)


def encode_lines(waypoints: DataFrame, by: list[str], order: str = "wp_index") -> DataFrame:
    """One row per line with its blob, in point order; lines of fewer than two points have none."""
    rows = waypoints.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, "lon", "lat", "alt"))).alias("_p"))

    @F.pandas_udf("binary")
    def blob(points: pd.Series) -> pd.Series:
        return points.map(lambda ps: linestring([(p["lon"], p["lat"], p["alt"]) for p in ps]) if len(ps) > 1 else None)

    return rows.select(*by, blob("_p").alias("geom"))


def create(path: str, table: str) -> sqlite3.Connection:
    """An open package with its mandatory tables, one feature table, and an R-tree kept by triggers."""
    if not table.replace("_", "a").isalnum() or not table.isascii():
        raise ValueError(f"bad table name {table!r}")
    db = sqlite3.connect(path)
    db.executescript(
        f"""pragma page_size = 4096; pragma application_id = {APPLICATION_ID}; pragma user_version = {USER_VERSION}; pragma journal_mode = wal;
create table if not exists gpkg_spatial_ref_sys (srs_name text not null, srs_id integer not null primary key, organization text not null, organization_coordsys_id integer not null, definition text not null, description text);
create table if not exists gpkg_contents (table_name text not null primary key, data_type text not null, identifier text unique, description text default '', last_change datetime not null default (strftime('%Y-%m-%dT%H:%M:%fZ', 'now')), min_x double, min_y double, max_x double, max_y double, srs_id integer references gpkg_spatial_ref_sys(srs_id));
create table if not exists gpkg_geometry_columns (table_name text not null references gpkg_contents(table_name), column_name text not null, geometry_type_name text not null, srs_id integer not null, z tinyint not null, m tinyint not null, primary key (table_name, column_name));
create table if not exists gpkg_extensions (table_name text, column_name text, extension_name text not null, definition text not null, scope text not null, unique (table_name, column_name, extension_name));
create table if not exists {METADATA_TABLE} (key text primary key not null, value text not null);
insert or ignore into gpkg_spatial_ref_sys values ('Undefined Cartesian', -1, 'NONE', -1, 'undefined', null), ('Undefined geographic', 0, 'NONE', 0, 'undefined', null), ('WGS 84 geodetic', 4326, 'EPSG', 4326, 'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]],PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]]', 'longitude and latitude in degrees');
insert or ignore into {METADATA_TABLE} values ('schema_version', '{SCHEMA_VERSION}');
create table if not exists {table} (id integer primary key autoincrement, line_index integer not null, altitude_datum text not null default 'EGM2008', completion_pct real not null default 0.0, crab_angle_deg real, geom blob not null);
insert or ignore into gpkg_contents (table_name, data_type, identifier, srs_id) values ('{table}', 'features', '{table}', {SRS_ID});
insert or ignore into gpkg_geometry_columns values ('{table}', 'geom', 'LINESTRINGZ', {SRS_ID}, 1, 0);
insert or ignore into gpkg_extensions values ('{table}', 'geom', 'gpkg_rtree_index', 'http://www.geopackage.org/spec120/#extension_rtree', 'write-only');
create virtual table if not exists rtree_{table}_geom using rtree(id, minx, maxx, miny, maxy);"""
    )
    connect_functions(db)
    box = lambda r: f"{r}.id, st_minx({r}.geom), st_maxx({r}.geom), st_miny({r}.geom), st_maxy({r}.geom)"
    full = lambda r: f"{r}.geom notnull and not st_isempty({r}.geom)"
    tree = f"rtree_{table}_geom"
    db.executescript(
        f"""create trigger if not exists {tree}_insert after insert on {table} when {full('new')} begin insert or replace into {tree} values ({box('new')}); end;
create trigger if not exists {tree}_update after update on {table} when {full('new')} begin delete from {tree} where id = old.id; insert or replace into {tree} values ({box('new')}); end;
create trigger if not exists {tree}_update_empty after update on {table} when not ({full('new')}) begin delete from {tree} where id in (old.id, new.id); end;
create trigger if not exists {tree}_delete after delete on {table} when old.geom notnull begin delete from {tree} where id = old.id; end;"""
    )
    return db


@lru_cache(maxsize=8)
def _empty(table: str) -> bytes:
    with closing(create(":memory:", table)) as db:
        db.commit()
        return db.serialize()


def create_in_memory(table: str) -> sqlite3.Connection:
    """As ``create`` in memory, but the tables are laid out once a process; each package starts as a copy of them."""
    db = sqlite3.connect(":memory:")
    db.deserialize(_empty(table))
    connect_functions(db)
    db.execute("update gpkg_contents set last_change = strftime('%Y-%m-%dT%H:%M:%fZ', 'now')")
    return db


def connect_functions(db: sqlite3.Connection) -> None:
    """The scalar functions that the triggers call, on this connection."""
    for k, name in enumerate(("st_minx", "st_maxx", "st_miny", "st_maxy")):
        db.create_function(name, 1, lambda b, k=k: envelope_value(b, k), deterministic=True)
    db.create_function("st_isempty", 1, lambda b: bool(b[3] & 0x10) if b else True, deterministic=True)


def open_package(path: str | bytes) -> sqlite3.Connection:
    """An existing package, by its path or its bytes; raises if it is none or newer than this, and adds what an older one lacks."""
    if isinstance(path, bytes):
        db = sqlite3.connect(":memory:")
        try:
            db.deserialize(path)
            db.execute("select count(*) from sqlite_master")
        except sqlite3.DatabaseError as e:
            raise ValueError(f"not a GeoPackage: {e}") from e
    elif not os.path.exists(path):
        raise FileNotFoundError(path)
    else:
        db = sqlite3.connect(path)
    if db.execute("pragma application_id").fetchone()[0] != APPLICATION_ID:
        raise ValueError("not a GeoPackage")
    connect_functions(db)
    if db.execute("select 1 from sqlite_master where name = ?", (METADATA_TABLE,)).fetchone():
        version = int((db.execute(f"select value from {METADATA_TABLE} where key = 'schema_version'").fetchone() or ["1"])[0])
        if version > SCHEMA_VERSION:
            raise ValueError(f"schema version {version} is newer than {SCHEMA_VERSION}")
        if version <= 2:
            for (name,) in db.execute("select table_name from gpkg_contents where data_type = 'features'").fetchall():
                if "crab_angle_deg" not in [r[1] for r in db.execute(f"pragma table_info({name})")]:
                    db.execute(f"alter table {name} add column crab_angle_deg real")
            db.execute(f"update {METADATA_TABLE} set value = ? where key = 'schema_version'", (str(SCHEMA_VERSION),))
            db.commit()
    return db


_INSERT = "insert into {} (line_index, altitude_datum, completion_pct, crab_angle_deg, geom) values (?, ?, ?, ?, ?)"


def _describe(db: sqlite3.Connection, table: str) -> None:
    """Box and datum of a feature table in the contents table."""
    datum = db.execute(f"select altitude_datum from {table} order by line_index limit 1").fetchone()
    if datum:
        db.execute(f"update gpkg_contents set (min_x, max_x, min_y, max_y) = (select min(minx), max(maxx), min(miny), max(maxy) from rtree_{table}_geom), description = ? where table_name = ?", (f"altitude_datum={datum[0]}", table))


class _Message(WriterCommitMessage):
    def __init__(self, rows: list[tuple]) -> None:
        self.rows = rows


class _Writer(DataSourceWriter):
    """Tasks hand their finished lines to the one commit, which writes the file in a transaction."""

    def __init__(self, options: dict, schema: StructType) -> None:
        self.path, self.table, self.names = options["path"], options.get("table", "flight_lines"), [f.name for f in schema.fields]

    def write(self, iterator: Iterator) -> _Message:
        at = {n: i for i, n in enumerate(self.names)}
        get = lambda r, n: r[at[n]] if n in at else None
        return _Message([(get(r, "line_index"), get(r, "altitude_datum") or "EGM2008", get(r, "completion_pct") or 0.0, get(r, "crab_angle_deg"), bytes(r[at["geom"]])) for r in iterator])

    def commit(self, messages: list) -> None:
        rows = sorted((r for m in messages if m for r in m.rows), key=lambda r: r[0])
        temporary = self.path + ".writing"
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        if os.path.exists(temporary):
            os.remove(temporary)
        db = create(temporary, self.table)
        with db:
            db.executemany(_INSERT.format(self.table), rows)
            _describe(db, self.table)
        db.execute("pragma journal_mode = delete")
        db.close()
        os.replace(temporary, self.path)

    def abort(self, messages: list) -> None:
        if os.path.exists(self.path + ".writing"):
            os.remove(self.path + ".writing")


class _Part(InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    """Rows by ranges of id, one partition each."""

    def __init__(self, options: dict) -> None:
        self.path, self.table, self.parts = options["path"], options.get("table", "flight_lines"), int(options.get("partitions", "1"))

    def partitions(self) -> list[InputPartition]:
        db = open_package(self.path)
        low, high = db.execute(f"select coalesce(min(id), 0), coalesce(max(id), -1) from {self.table}").fetchone()
        db.close()
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Part(k, min(high, k + step - 1)) for k in range(low, high + 1, step)] or [_Part(0, -1)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        db = sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)
        yield from db.execute(f"select id, line_index, altitude_datum, completion_pct, crab_angle_deg, geom from {self.table} where id between ? and ?", (partition.low, partition.high))
        db.close()


class GpkgDataSource(DataSource):
    """``spark.read.format("gpkg")`` and ``df.write.format("gpkg").mode("overwrite").save(path)``; option ``table``."""

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def schema(self) -> str:
        return "id long, line_index long, altitude_datum string, completion_pct double, crab_angle_deg double, geom binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema)


# ---------------------------------------------------------------- a package for each plan


class _PlansWriter(files.StagedWriter):
    """Lines sorted by plan become one package a plan. A task holds the package that it builds."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        super().__init__(options, overwrite)
        self.table = options.get("table", "flight_lines")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        with self.staged() as out:
            plan, db = None, None

            def finish() -> None:
                if db is not None:
                    with db:
                        _describe(db, self.table)
                    out.add(f"plan-{plan:06d}.gpkg", db.serialize())
                    db.close()

            for batch in iterator:
                columns = [batch.column(n).to_pylist() for n in ("plan_id", "line_index", "altitude_datum", "completion_pct", "crab_angle_deg", "geom")]
                for key, rows in groupby(zip(*columns, strict=True), key=lambda r: r[0]):
                    if key is None:
                        raise ValueError("a line needs a plan_id")
                    if key != plan:
                        finish()
                        plan, db = key, create_in_memory(self.table)
                    with db:
                        db.executemany(_INSERT.format(self.table), ((k, datum or "EGM2008", done or 0.0, crab, geom) for _, k, datum, done, crab, geom in rows))
            finish()
            return out.message()


class GpkgPlans(DataSource):
    """``df.write.format("gpkg_plans")``: see ``write_packages``."""

    @classmethod
    def name(cls) -> str:
        return "gpkg_plans"

    def schema(self) -> str:
        return "plan_id long, line_index long, altitude_datum string, completion_pct double, crab_angle_deg double, geom binary"

    def writer(self, schema: StructType, overwrite: bool) -> files.StagedWriter:
        return _PlansWriter(self.options, schema, overwrite)


def write_packages(lines: DataFrame, folder: str, table: str = "flight_lines", mode: str = "overwrite") -> None:
    """Write lines (plan_id, line_index, altitude_datum, geom, and if there are any completion_pct and crab_angle_deg)
    as ``plan-<id>.gpkg`` files of ``folder``. Lines without a geometry (of fewer than two points) are left out."""
    spark = lines.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    spark.dataSource.register(GpkgPlans)
    optional = {n: F.col(n).cast("double") if n in lines.columns else F.lit(None).cast("double") for n in ("completion_pct", "crab_angle_deg")}
    rows = lines.where("geom is not null").select(F.col("plan_id").cast("long"), F.col("line_index").cast("long"), "altitude_datum", *(v.alias(k) for k, v in optional.items()), "geom")
    rows.repartition("plan_id").sortWithinPartitions("plan_id", "line_index").write.format("gpkg_plans").option("table", table).mode(mode).save(folder)


#: The plan of a package by its path.
_PLAN = r"plan-(\d+)\.gpkg$"


def _plan_of(path: str) -> Column:
    return F.regexp_extract(path, _PLAN, 1).try_cast("long").alias("plan_id")


def _found(spark: SparkSession, folder: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.gpkg").load(folder)


def package_files(spark: SparkSession, folder: str) -> DataFrame:
    """(plan_id, path, content) of the packages of a folder; plan_id by the file's name. Sets the session's bytes of an Arrow batch."""
    return _found(spark, folder).select(_plan_of("path"), "path", "content")


#: Bytes of packages that a task reads and, of a revision, that are there twice at a time; about.
TASK_BYTES, SLICE_BYTES = 32 << 20, 2 << 30


def package_paths(spark: SparkSession, folder: str) -> DataFrame:
    """(plan_id, path, length) of the packages of a folder, dealt to tasks by bytes. Tasks read them; a scan of content has a task for every few files."""
    found = _listed(spark, folder)
    return found.repartition(_tasks(spark, *_count_and_size(found)))


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """(plan_id, path, length) of the packages of a folder, in a few partitions."""
    few = _found(spark, folder).select("path", "length").coalesce(spark.sparkContext.defaultParallelism)
    return few.select(_plan_of("path"), "path", "length")


def _count_and_size(packages: DataFrame) -> Row:
    return packages.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()


def _tasks(spark: SparkSession, packages: int, size: int) -> int:
    return max(1, min(packages, spark.sparkContext.defaultParallelism), -(-size // TASK_BYTES))


def _contents(batch: pa.RecordBatch) -> Iterator[bytes]:
    """The packages of a batch: its content or, where it has none, what lies at its paths, one after the other."""
    if "content" in batch.schema.names:
        return iter(batch.column("content").to_pylist())
    return map(files.read_file, batch.column("path").to_pylist())


_LINES = pa.schema([("plan_id", pa.int64()), ("path", pa.string()), ("id", pa.int64()), ("line_index", pa.int64()), ("altitude_datum", pa.string()), ("completion_pct", pa.float64()), ("crab_angle_deg", pa.float64()), ("geom", pa.binary()), ("error", pa.string())])
#: Rows of a package that go out in one batch.
_ROWS = 4096
#: Bytes of the Arrow batches that packages travel in, about: by rows alone, a batch is ten thousand whole files.
BATCH_BYTES = 4 << 20


def read_packages(packages: DataFrame, table: str = "flight_lines", told: bool = False) -> DataFrame:
    """All lines of packages given as (plan_id, path, content), or without content; ``told``: with the description of the table and
    the metadata of the package at each. A file that is no package gives one row with its error."""
    more = [("description", pa.string()), ("metadata", pa.map_(pa.string(), pa.string()))] if told else []
    schema = pa.schema([*_LINES, *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for plan, path, data in zip(batch.column("plan_id").to_pylist(), batch.column("path").to_pylist(), _contents(batch), strict=True):
                try:
                    db = open_package(data)
                    same = [description(db, table), list(metadata(db).items())] if told else []
                    found = db.execute(f"select id, line_index, altitude_datum, completion_pct, crab_angle_deg, geom from {table} order by id")
                    while rows := found.fetchmany(_ROWS):
                        fixed = lambda values, types: [pa.array([v] * len(rows), t) for v, t in zip(values, types, strict=True)]
                        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(_LINES)[2:8], strict=True)]
                        yield pa.RecordBatch.from_arrays([*fixed((plan, path), (pa.int64(), pa.string())), *columns, pa.nulls(len(rows), pa.string()), *fixed(same, (t for _, t in more))], schema=schema)
                    db.close()
                except (ValueError, sqlite3.Error) as e:
                    yield pa.RecordBatch.from_pylist([{"plan_id": plan, "path": path, "error": str(e)}], schema)

    return packages.mapInArrow(run, "plan_id long, path string, id long, line_index long, altitude_datum string, completion_pct double, crab_angle_deg double, geom binary, error string" + ", description string, metadata map<string, string>" * told)


def _count_points(db: sqlite3.Connection, table: str) -> int | None:
    """Points of all lines with heights of a package; null if it has other geometries."""
    n, lines = 0, db.execute(f"select geom from {table}")
    try:
        while some := lines.fetchmany(_ROWS):
            n += int(line_points(pa.array([g for (g,) in some], pa.binary()))[0].sum())
    except ValueError:
        return None
    return n


def package_summaries(packages: DataFrame, table: str = "flight_lines") -> DataFrame:
    """Per package: plan_id, n_rows, rtree_rows, points of its lines, box, description, and its metadata; or an error. Each is opened once."""
    schema = pa.schema([("plan_id", pa.int64()), ("n_rows", pa.int64()), ("rtree_rows", pa.int64()), ("points", pa.int64()), *((n, pa.float64()) for n in ("min_x", "min_y", "max_x", "max_y")), ("description", pa.string()), ("metadata", pa.map_(pa.string(), pa.string())), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for plan, data in zip(batch.column("plan_id").to_pylist(), _contents(batch), strict=True):
                try:
                    with _opened(data) as db:
                        found, points = summary(db, table), _count_points(db, table)
                        rows.append({"plan_id": plan, "n_rows": found["rows"], "rtree_rows": found["rtree_rows"], "points": points, **dict(zip(("min_x", "min_y", "max_x", "max_y"), found["box"], strict=True)), "description": found["description"], "metadata": list(metadata(db).items())})
                except (ValueError, sqlite3.Error) as e:
                    rows.append({"plan_id": plan, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema)

    return packages.mapInArrow(run, "plan_id long, n_rows long, rtree_rows long, points long, min_x double, min_y double, max_x double, max_y double, description string, metadata map<string, string>, error string")


_CHANGES = "array<struct<line_index: bigint, completion_pct: double, gone: boolean>>"


def _with_changes(packages: DataFrame, changes: DataFrame | None) -> DataFrame:
    """Packages, by content or path, with the changes of each as an array."""
    packages = packages.select(*(n for n in ("plan_id", "path", "length", "content") if n in packages.columns))
    if changes is None:
        return packages.withColumn("changes", F.lit(None).cast(_CHANGES))
    each = F.struct(F.col("line_index").cast("long").alias("line_index"), F.col("completion_pct").cast("double").alias("completion_pct"), F.coalesce("gone", F.lit(False)).alias("gone"))
    of_plan = changes.groupBy(F.col("plan_id").cast("long").alias("plan_id")).agg(F.collect_list(each).alias("changes"))
    return packages.join(of_plan, "plan_id", "left")


def revise(packages: DataFrame, changes: DataFrame | None, table: str = "flight_lines", description: str | None = None, values: dict[str, str] | None = None) -> DataFrame:
    """Packages with their lines' progress and deletions applied, as (name, content) for ``files.write_files``.

    ``changes``: plan_id, line_index, completion_pct (null: as it was), gone (the line goes and later ones move up); None: no line changes.
    Indexes are those before any line goes. ``description`` is added to each table's description once,
    ``values`` are put into each package's metadata. Changes of one plan travel as one array: as many as its lines.
    Packages with a column content take it through that join's shuffle, those of ``package_paths`` do not.
    """
    more = dict(values or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for plan, rows, data in zip(batch.column("plan_id").to_pylist(), batch.column("changes").to_pylist(), _contents(batch), strict=True):
                content = _revised(data, rows, table, description, more)
                yield pa.record_batch({"name": pa.array([f"plan-{plan:06d}.gpkg"]), "content": pa.array([content], pa.binary())})

    return _with_changes(packages, changes).mapInArrow(run, "name string, content binary")


def _revised(data: bytes, changes: list[dict] | None, table: str, description: str | None, values: dict[str, str]) -> bytes:
    with _opened(data) as db:
        set_completion(db, table, {r["line_index"]: r["completion_pct"] for r in changes or [] if r["completion_pct"] is not None})
        for k in sorted({r["line_index"] for r in changes or [] if r["gone"]}, reverse=True):
            delete_line(db, table, k)
        if values:
            put_metadata(db, values)
        if description:
            append_description(db, table, description)
        return db.serialize()


class _RevisedWriter(files.StagedWriter):
    """Packages of (plan_id, path, changes) are read, revised and written by one task each, so that no content leaves it."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool) -> None:
        super().__init__(options, overwrite)
        self.how = json.loads(options["how"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        with self.staged() as out:
            for batch in iterator:
                for plan, changes, data in zip(batch.column("plan_id").to_pylist(), batch.column("changes").to_pylist(), _contents(batch), strict=True):
                    out.add(f"plan-{plan:06d}.gpkg", _revised(data, changes, **self.how))
            return out.message()


class GpkgRevisions(DataSource):
    """``df.write.format("gpkg_revisions")``: see ``revise_folder``."""

    @classmethod
    def name(cls) -> str:
        return "gpkg_revisions"

    def schema(self) -> str:
        return f"plan_id long, path string, changes {_CHANGES}"

    def writer(self, schema: StructType, overwrite: bool) -> files.StagedWriter:
        return _RevisedWriter(self.options, schema, overwrite)


def revise_folder(spark: SparkSession, source: str, target: str, changes: DataFrame | None = None, table: str = "flight_lines", description: str | None = None, values: dict[str, str] | None = None, keep: bool = True) -> None:
    """The packages of a folder, revised (see ``revise``), as files of another, new one.

    They go in slices of ``SLICE_BYTES``, each with a commit of its own. Unless ``keep``, the sources of a slice are removed once
    its revised packages are in place: then packages are there once, and a slice of them twice. If a slice fails, its packages
    and those of later slices are still in ``source``, the others in ``target``. Only paths and changes are shuffled.
    """
    spark.dataSource.register(GpkgRevisions)
    how = json.dumps({"table": table, "description": description, "values": values or {}})
    rows = _with_changes(_listed(spark, source), changes).coalesce(spark.sparkContext.defaultParallelism).persist()
    try:
        packages, size = _count_and_size(rows)
        slices = max(1, -(-size // SLICE_BYTES))
        for k in range(slices):
            some = rows.where(F.pmod(F.xxhash64("plan_id"), F.lit(slices)) == k)
            dealt = some.select("plan_id", "path", "changes").repartition(_tasks(spark, packages, size // slices))
            dealt.write.format("gpkg_revisions").option("how", how).mode("append").save(target)
            if not keep:
                some.select("path").mapInArrow(_remove, "removed long").agg(F.sum("removed")).first()
    finally:
        rows.unpersist()


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("path").to_pylist():
            files.remove_file(path)
        yield pa.record_batch({"removed": pa.array([batch.num_rows], pa.int64())})


def line_points(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Points of a batch of LineStringZ blobs with an XYZ envelope: how many each has, and all of them as (x, y, z) rows."""
    raw, start, length, _ = _bytes_of(blobs)
    head = 8 + 48
    if len(start) and ((length < head + 9).any() or (raw[start + 3] >> 1 & 7 != 2).any()):
        raise ValueError("not a line with heights")
    count = raw[start[:, None] + head + 5 + np.arange(4)].copy().view("<u4")[:, 0].astype(np.int64) if len(start) else np.zeros(0, np.int64)
    if (length != head + 9 + 24 * count).any():
        raise ValueError("blob has a wrong length")
    ends = np.cumsum(count)
    inside = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count, count)
    at = np.repeat(start + head + 9, count) + 24 * inside
    return count, raw[at[:, None] + np.arange(24)].copy().view("<f8").reshape(-1, 3)


# ---------------------------------------------------------------- one package


@contextmanager
def _opened(package: str | bytes | sqlite3.Connection) -> Iterator[sqlite3.Connection]:
    """An open package as it is, or one that is closed again."""
    if isinstance(package, sqlite3.Connection):
        yield package
        return
    db = open_package(package)
    try:
        yield db
    finally:
        db.close()


def metadata(package: str | bytes | sqlite3.Connection) -> dict[str, str]:
    with _opened(package) as db:
        return dict(db.execute(f"select key, value from {METADATA_TABLE}"))


def description(package: str | bytes | sqlite3.Connection, table: str) -> str | None:
    """The description of a feature table."""
    with _opened(package) as db:
        return (db.execute("select description from gpkg_contents where table_name = ?", (table,)).fetchone() or [None])[0]


def put_metadata(package: str | sqlite3.Connection, values: dict[str, str]) -> None:
    with _opened(package) as db, db:
        db.executemany(f"insert into {METADATA_TABLE} values (?, ?) on conflict (key) do update set value = excluded.value", values.items())


def append_description(package: str | sqlite3.Connection, table: str, text: str) -> None:
    """Add a line to the description of a feature table, once."""
    with _opened(package) as db, db:
        (old,) = db.execute("select coalesce(description, '') from gpkg_contents where table_name = ?", (table,)).fetchone()
        if text not in old.split("\n"):
            db.execute("update gpkg_contents set description = ? where table_name = ?", ("\n".join(x for x in (old, text) if x), table))


def set_completion(package: str | sqlite3.Connection, table: str, percent: dict[int, float]) -> None:
    """Progress of lines by index, in one transaction."""
    with _opened(package) as db, db:
        db.executemany(f"update {table} set completion_pct = ? where line_index = ?", [(v, k) for k, v in percent.items()])


def delete_line(package: str | sqlite3.Connection, table: str, index: int) -> None:
    """Remove a line and move later ones up."""
    with _opened(package) as db, db:
        db.execute(f"delete from {table} where line_index = ?", (index,))
        db.execute(f"update {table} set line_index = line_index - 1 where line_index > ?", (index,))


def search(package: str | bytes | sqlite3.Connection, table: str, box: tuple[float, float, float, float]) -> list[int]:
    """Ids of features whose envelope meets (min x, max x, min y, max y), through the R-tree."""
    with _opened(package) as db:
        return [r[0] for r in db.execute(f"select id from rtree_{table}_geom where maxx >= ? and minx <= ? and maxy >= ? and miny <= ? order by id", box)]


def summary(package: str | bytes | sqlite3.Connection, table: str) -> dict:
    """Rows, R-tree entries, and the box and description in the contents table."""
    with _opened(package) as db:
        rows = db.execute(f"select count(*) from {table}").fetchone()[0]
        tree = db.execute(f"select count(*) from rtree_{table}_geom").fetchone()[0]
        *box, description = db.execute("select min_x, min_y, max_x, max_y, description from gpkg_contents where table_name = ?", (table,)).fetchone()
    return {"rows": rows, "rtree_rows": tree, "box": tuple(box), "description": description}
