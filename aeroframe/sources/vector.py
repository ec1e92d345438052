"""KML, KMZ and GeoJSON vector sources as DataFrames of vertices.

Files are read by Spark (``binaryFile``), so any store it can reach will do, and
parsed a file a row in Arrow batches. A file that cannot be parsed gives one row
with its error; nothing is dropped silently.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SCHEMA = "path string, feature int, kind string, part int, ring int, is_hole boolean, vertex int, lat double, lon double, error string"
_FIELDS = {"feature": pa.int32(), "kind": pa.string(), "part": pa.int32(), "ring": pa.int32(), "is_hole": pa.bool_(), "vertex": pa.int32(), "lat": pa.float64(), "lon": pa.float64(), "error": pa.string()}
#: Vertices of a batch that is handed on, about.
_BATCH = 1 << 16


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def kml_text(data: bytes) -> bytes:
    """The document of a KML file or KMZ archive: doc.kml if there is one, else the first .kml."""
    if data[:2] != b"PK":
        return data
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if n.lower().endswith(".kml")]
        if not names:
            raise ValueError("archive without a .kml")
        return z.read("doc.kml" if "doc.kml" in names else names[0])


def coordinates(text: str | None) -> list[tuple[float, float]]:
    """(lat, lon) of lon,lat[,alt] tuples; tuples of fewer than two parts are skipped, bad numbers raise."""
    out = []
    for item in (text or "").split():
        parts = item.split(",")
        if len(parts) >= 2 and parts[0].strip() and parts[1].strip():
            out.append((float(parts[1]), float(parts[0])))
    return out


def kml_features(data: bytes) -> Iterator[tuple[str, list[tuple[bool, list]]]]:
    """(kind, [(is_hole, vertices)]) of polygons and line strings in document order; lines of fewer than two points are dropped."""
    root = ElementTree.fromstring(kml_text(data))
    for e in root.iter():
        if _local(e.tag) == "Polygon":
            rings = []
            for side in e:
                if (name := _local(side.tag)) in ("outerBoundaryIs", "innerBoundaryIs"):
                    rings += [(name[0] == "i", coordinates(c.text)) for c in side.iter() if _local(c.tag) == "coordinates"]
            rings = [r for r in rings if r[1]]
            if any(not hole for hole, _ in rings):
                yield "Polygon", rings
        elif _local(e.tag) == "LineString":
            for c in e.iter():
                if _local(c.tag) == "coordinates" and len(points := coordinates(c.text)) >= 2:
                    yield "LineString", [(False, points)]


def geojson_features(value: dict) -> Iterator[tuple[str, list[tuple[bool, list]]]]:
    """Polygons and lines of any GeoJSON object, through collections of any depth."""
    kind = value.get("type")
    if kind == "FeatureCollection":
        for f in value.get("features") or []:
            yield from geojson_features(f)
    elif kind == "Feature":
        if value.get("geometry"):
            yield from geojson_features(value["geometry"])
    elif kind == "GeometryCollection":
        for g in value.get("geometries") or []:
            yield from geojson_features(g)
    elif kind in ("Polygon", "MultiPolygon"):
        for polygon in [value["coordinates"]] if kind == "Polygon" else value["coordinates"]:
            if polygon:
                yield "Polygon", [(i > 0, [(float(p[1]), float(p[0])) for p in ring]) for i, ring in enumerate(polygon)]
    elif kind in ("LineString", "MultiLineString"):
        for line in [value["coordinates"]] if kind == "LineString" else value["coordinates"]:
            if len(line) >= 2:
                yield "LineString", [(False, [(float(p[1]), float(p[0])) for p in line])]
    elif kind is None:
        raise ValueError("not a GeoJSON object")


def _parsed(values: list, parse) -> Iterator[tuple[list[int], dict[str, pa.Array]]]:
    """For a list of documents: which one each row is of, and the columns of its vertices or its error."""
    owner: list[int] = []
    columns: dict[str, list] = {k: [] for k in _FIELDS}

    def put(at: int, *row) -> None:
        owner.append(at)
        for k, v in zip(columns, row, strict=True):
            columns[k].append(v)

    def out() -> tuple[list[int], dict[str, pa.Array]]:
        found = list(owner), {k: pa.array(columns[k], t) for k, t in _FIELDS.items()}
        owner.clear()
        for v in columns.values():
            v.clear()
        return found

    for at, value in enumerate(values):
        try:
            features = list(parse(value))  # an error leaves nothing of its document behind
        except (ValueError, KeyError, TypeError, IndexError, AttributeError, ElementTree.ParseError, zipfile.BadZipFile) as e:
            put(at, *[None] * 8, f"{type(e).__name__}: {e}")
            continue
        for f, (kind, rings) in enumerate(features):
            for r, (hole, points) in enumerate(rings):
                for v, (lat, lon) in enumerate(points):
                    put(at, f, kind, 0, r, hole, v, lat, lon, None)
        if len(owner) >= _BATCH:
            yield out()
    if owner:
        yield out()


def _read(spark: SparkSession, path: str, parse) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for files in batches:
            for owner, columns in _parsed(files.column("content").to_pylist(), parse):
                yield pa.record_batch({"path": files.column("path").take(pa.array(owner, pa.int64())), **columns})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def read_kml(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of all polygons and line strings of KML and KMZ files."""
    return _read(spark, path, kml_features)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, lambda data: geojson_features(json.loads(data)))


def features_of_text(df: DataFrame, text: str, kind: str) -> DataFrame:
    """The same from a column of KML or GeoJSON texts; other columns are kept."""
    parse = (lambda t: kml_features(t.encode())) if kind == "kml" else (lambda t: geojson_features(json.loads(t)))
    keep = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for owner, columns in _parsed(rows.column(rows.schema.get_field_index(text)).to_pylist(), parse):
                kept = rows.select(keep).take(pa.array(owner, pa.int64()))
                yield pa.record_batch([*kept.columns, *columns.values()], [*keep, *columns])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), SCHEMA.removeprefix("path string, ")])
    return df.mapInArrow(run, schema)
