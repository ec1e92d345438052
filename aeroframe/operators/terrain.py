"""Terrain and geoid: grids as cell tables, bilinear sampling, reports, datums, overlap.

A grid of posts becomes a table of cells with their four corner values, built once
per grid. A point then needs one equi-join on its cell: no expansion to four rows
and no aggregation back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.constants import DEM_VOID
from ..functions.program import Program, num
from . import planning


def cells(posts: DataFrame, by: list[str], row: str = "row", col: str = "col", value: str = "h", wrap: bool = False) -> DataFrame:
    """Cells of a grid: h00 (this post), h01 (next column), h10 (next row), h11. Edges repeat the last post, or wrap by column."""
    along = Window.partitionBy(*by, row).orderBy(col)
    nxt = F.lead(value).over(along)
    if wrap:
        nxt = F.coalesce(nxt, F.first(value).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    pairs = posts.withColumns({"h00": F.col(value), "h01": F.coalesce(nxt, F.col(value))})
    down = Window.partitionBy(*by, col).orderBy(row)
    return pairs.withColumns({"h10": F.coalesce(F.lead("h00").over(down), F.col("h00")), "h11": F.coalesce(F.lead("h01").over(down), F.col("h01"))}).drop(value)


def place(lat: str = "lat", lon: str = "lon", rows: str = "n_rows", cols: str = "n_cols") -> Program:
    """Tile, cell and fractions of a point; longitude 180 counts as -180. Invalid coordinates get nulls."""
    ok = f"coalesce({lat} between -90e0 and 90e0 and {lon} between -180e0 and 180e0 and not isnan({lat}) and not isnan({lon}), false)"
    return Program(
        {"coord_ok": ok, "_lon": f"case when {lon} >= 180e0 then {lon} - 360e0 else {lon} end"},
        {"tile_lat": f"case when coord_ok then cast(floor({lat}) as int) end", "tile_lon": "case when coord_ok then cast(floor(_lon) as int) end"},
        {"_r": f"least(greatest((cast(tile_lat as double) + 1e0 - {lat}) * {rows}, 0e0), {rows} - 1e0)", "_c": f"least(greatest((_lon - cast(tile_lon as double)) * {cols}, 0e0), {cols} - 1e0)"},
        {"row": "cast(floor(_r) as int)", "col": "cast(floor(_c) as int)"},
        {"fr": "_r - cast(row as double)", "fc": "_c - cast(col as double)"},
    )


_VOID = " or ".join(f"isnan({h}) or {h} <= {num(DEM_VOID)}" for h in ("h00", "h01", "h10", "h11"))
#: Bilinear height of a joined cell, narrowed to single precision; null over a void or without a tile.
BILINEAR = Program(
    {"elevation": f"case when h00 is null or {_VOID} then null else cast(cast((1e0 - fr) * ((1e0 - fc) * h00 + fc * h01) + fr * ((1e0 - fc) * h10 + fc * h11) as float) as double) end"}
)
_KEYS = ["tile_lat", "tile_lon", "row", "col"]


def sample(points: DataFrame, dem_cells: DataFrame, rows: float, cols: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Points with ``elevation`` (orthometric, null where there is none), ``coord_ok`` and ``tile_found``."""
    placed = place(lat, lon, num(rows), num(cols)).apply(points)
    values = dem_cells.select(*_KEYS, *(F.col(h).cast("double").alias(h) for h in ("h00", "h01", "h10", "h11")))
    found = BILINEAR.apply(placed.join(values, _KEYS, "left").withColumn("tile_found", F.col("h00").isNotNull()))
    return found.drop("row", "col", "fr", "fc", "h00", "h01", "h10", "h11")


#: Cell of a one-degree geoid grid whose rows run north from -90 and columns east from -180.
GEOID_PLACE = Program(
    {"_ok": "coalesce(lat between -90e0 and 90e0 and not isnan(lon), false)", "_glon": "lon - 360e0 * floor((lon + 180e0) / 360e0)"},
    {"_gr": "least(floor(lat + 90e0), 179e0)", "_gc": "floor(_glon + 180e0)"},
    {"g_row": "case when _ok then cast(_gr as int) end", "g_col": "case when _ok then cast(_gc as int) end", "g_fr": "lat + 90e0 - _gr", "g_fc": "_glon + 180e0 - _gc"},
)
GEOID_VALUE = Program({"undulation": "case when n00 is not null then (1e0 - g_fr) * ((1e0 - g_fc) * n00 + g_fc * n01) + g_fr * ((1e0 - g_fc) * n10 + g_fc * n11) end"})


def undulation(points: DataFrame, geoid_cells: DataFrame) -> DataFrame:
    """Points with ``undulation`` of a one-degree grid given as cells (row, col, h00, h01, h10, h11); null off the globe."""
    values = geoid_cells.select(F.col("row").alias("g_row"), F.col("col").alias("g_col"), *(F.col(f"h{k}").alias(f"n{k}") for k in ("00", "01", "10", "11")))
    placed = GEOID_PLACE.apply(points)
    return GEOID_VALUE.apply(placed.join(values, ["g_row", "g_col"], "left")).drop("g_row", "g_col", "g_fr", "g_fc", "n00", "n01", "n10", "n11")


#: Report of a sampled point with undulation: orthometric and ellipsoidal height and where they come from.
REPORT = Program(
    {
        "elevation_source": "case when not coord_ok then 'SeaLevelFallback' when elevation is null then 'OceanFallback' else 'CopernicusDem' end",
        "orthometric_m": "case when coord_ok then coalesce(elevation, 0e0) else 0e0 end",
        "geoid_n": "case when coord_ok then coalesce(undulation, 0e0) else 0e0 end",
    },
    {"ellipsoidal_m": "orthometric_m + geoid_n", "strict_status": "case when not coord_ok then 'BAD_COORDINATE' when not tile_found then 'TILE_NOT_FOUND' when elevation is null then 'NO_DATA' else 'OK' end"},
)


def convert_datum(height: str, source: str, target: str, n96: str = "n96", n2008: str = "n2008", terrain: str = "terrain_ellipsoidal") -> str:
    """Height in another vertical datum, by way of the ellipsoid; equal datums change nothing."""
    up = f"case {source} when 'EGM96' then {height} + {n96} when 'EGM2008' then {height} + {n2008} when 'AGL' then {height} + {terrain} when 'WGS84_ELLIPSOIDAL' then {height} end"
    return f"case when {source} = {target} then {height} else case {target} when 'EGM96' then ({up}) - {n96} when 'EGM2008' then ({up}) - {n2008} when 'AGL' then ({up}) - {terrain} when 'WGS84_ELLIPSOIDAL' then ({up}) end end"


#: Overlap of a waypoint over the highest of its samples.
OVERLAP = Program(
    {"actual_agl": "alt - peak"},
    {"actual_swath": "2e0 * actual_agl * tan(fov_h_rad / 2e0)"},
    {"overlap_pct": "(1e0 - line_spacing / nullif(actual_swath, 0)) * 100e0"},
    {"violation": "actual_agl <= 0e0 or coalesce(overlap_pct < side_pct, true)", "adjusted_alt": "greatest(alt, peak + nominal_agl)"},
)


def overlap(waypoints: DataFrame, dem_cells: DataFrame, rows: float, cols: float, key: list[str]) -> DataFrame:
    """Waypoints with terrain peak under the footprint, actual height, swath, overlap, violation, and the height that clears it.

    Samples without terrain count as sea level and are reported in ``no_terrain``.
    """
    seen = sample(planning.footprints(waypoints), dem_cells, rows, cols, "p_lat", "p_lon")
    rest = [x for x in waypoints.columns if x not in key]
    # the waypoint's own columns ride along, so nothing is joined back
    peaks = seen.groupBy(*key).agg(F.max(F.coalesce("elevation", F.lit(0.0))).alias("peak"), F.count_if(F.col("elevation").isNull()).alias("no_terrain"), *(F.any_value(x).alias(x) for x in rest))
    return OVERLAP.apply(peaks)


def floors(profile: DataFrame, by: list[str], clearance: float, fixed: float) -> DataFrame:
    """Floor heights of a profile (x, terrain) in the five modes."""
    w = Window.partitionBy(*by)
    safe = F.col("terrain") + clearance
    mid = F.median("terrain").over(w)
    return profile.withColumns(
        {
            "floor_terrain": safe,
            "floor_mean": F.greatest(safe, F.avg("terrain").over(w) + clearance),
            "floor_median": F.greatest(safe, mid + clearance),
            "floor_fixed": F.greatest(safe, F.lit(fixed)),
            "floor_max": F.max("terrain").over(w) + clearance,
        }
    )


def profile_metrics(path: DataFrame, by: list[str], clearance: float, order: str = "x") -> DataFrame:
    """Clearance, slope, curvature and deviation metrics of flown profiles (x, alt, terrain)."""
    w = Window.partitionBy(*by).orderBy(order)
    lag = lambda c, k=1: F.lag(c, k).over(w)
    p = path.withColumns({"_m": F.col("alt") - F.col("terrain") - clearance, "_dx": F.col(order) - lag(order), "_dy": F.col("alt") - lag("alt"), "_dx0": lag(order) - lag(order, 2), "_dy0": lag("alt") - lag("alt", 2)})
    p = p.withColumn("_s", F.when(F.col("_dx") > 1, F.col("_dy") / F.col("_dx")))
    before = F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.row_number().over(w)
    p = p.withColumn("_jump", F.when(F.col("_s").isNotNull() & (first > 2), F.abs(F.col("_s") - F.coalesce(before, F.lit(0.0)))))
    d1, d2 = F.hypot("_dx0", "_dy0"), F.hypot("_dx", "_dy")
    d3 = F.hypot(F.col("_dx") + F.col("_dx0"), F.col("_dy") + F.col("_dy0"))
    area = F.abs(F.col("_dx0") * F.col("_dy") - F.col("_dy0") * F.col("_dx"))
    p = p.withColumn("_k", F.when(d1 * d2 * d3 > 1e-10, 2 * area / (d1 * d2 * d3)))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return p.groupBy(*by).agg(
        F.min("_m").alias("min_clearance_margin"),
        zero(F.max(F.abs("_s"))).alias("max_slope"),
        zero(F.max("_k")).alias("max_curvature"),
        zero(F.max("_jump")).alias("max_slope_jump"),
        F.sqrt(F.avg(F.col("_m") * F.col("_m"))).alias("rms_deviation"),
        F.max(F.abs("_m")).alias("max_deviation"),
        (F.avg(F.when(F.abs("_m") <= 0.05 * clearance, 100.0).otherwise(0.0))).alias("pct_within_5pct"),
        F.count("*").alias("n_waypoints"),
    )


def synthetic_profile(kind: str, x: str = "x", base: float = 500.0) -> str:
    """Height of a synthetic terrain profile at ``x``: flat, sinusoid, step or sawtooth."""
    phase = f"({x} / 500e0 - floor({x} / 500e0))"
    return f"{num(base)} + case {kind} when 'sinusoid' then 30e0 * sin(2e0 * pi() * {x} / 2000e0) when 'step' then 50e0 * tanh(2e-2 * ({x} - 2500e0)) when 'sawtooth' then 20e0 * abs(2e0 * {phase} - 1e0) else 0e0 end"


def along_profile(points: DataFrame, profile: DataFrame, spacing: float, by: list[str]) -> DataFrame:
    """Terrain at ``x`` of points by linear interpolation on a regular profile (k, terrain); the ends hold beyond it."""
    nxt = F.lead("terrain").over(Window.partitionBy(*by).orderBy("k"))
    spans = profile.withColumn("_next", F.coalesce(nxt, F.col("terrain"))).withColumnRenamed("terrain", "_this")
    last = profile.groupBy(*by).agg(F.max("k").alias("_last"))
    placed = points.join(last, by).withColumn("_u", F.least(F.greatest(F.col("x") / spacing, F.lit(0.0)), F.col("_last").cast("double"))).withColumn("k", F.floor("_u").cast("int"))
    return placed.join(spans, [*by, "k"]).withColumn("terrain", F.col("_this") + (F.col("_u") - F.col("k")) * (F.col("_next") - F.col("_this"))).drop("_u", "_last", "_this", "_next", "k")
