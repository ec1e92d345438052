"""Plane geometry over arrays of vertices, inside whole-stage code.

A ring is an array<struct<lat: double, lon: double>>, with or without its first
vertex repeated at the end. A polygon has an exterior ring and an array of holes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def in_ring(lat: Column, lon: Column, ring: Column) -> Column:
    """Even-odd ray cast, half-open in latitude; a ring of fewer than three vertices holds nothing."""
    n = F.size(ring)

    def crosses(v: Column, i: Column) -> Column:
        u = ring[F.when(i == 0, n - 1).otherwise(i - 1)]
        spans = (v["lat"] > lat) != (u["lat"] > lat)
        at = (u["lon"] - v["lon"]) * (lat - v["lat"]) / F.nullif(u["lat"] - v["lat"], F.lit(0.0)) + v["lon"]
        return spans & (lon < at)

    return (n >= 3) & (F.size(F.filter(ring, crosses)) % 2 == 1)


def in_polygon(lat: Column, lon: Column, exterior: Column, holes: Column) -> Column:
    return in_ring(lat, lon, exterior) & ~F.exists(holes, lambda h: in_ring(lat, lon, h))


def bounds(exterior: Column) -> dict[str, Column]:
    """Bounding box of the exterior ring."""
    return {f"{f.__name__[-3:]}_{x}": f(F.transform(exterior, field)) for f in (F.array_min, F.array_max) for x, field in (("lat", lambda v: v["lat"]), ("lon", lambda v: v["lon"]))}


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float = 0.05) -> DataFrame:
    """Pairs (point row, poly_id) of points within polygons: an equi-join on grid cells, then the exact test.

    A polygon larger than ``cell`` (degrees) belongs to a coarser level, whose cells are
    2, 4, 8, ... times as wide, so it touches four cells at most whatever its size.
    Each point has one cell on every level in use, of which there are a few, and
    nothing is compared beyond a cell.
    """
    box = bounds(F.col("exterior"))
    size = F.greatest(box["max_lat"] - box["min_lat"], box["max_lon"] - box["min_lon"]) / cell
    leveled = polygons.withColumn("_level", F.when(size > 1, F.ceil(F.log2(size))).otherwise(0).cast("int"))
    levels = sorted(r[0] for r in leveled.select("_level").distinct().collect() if r[0] is not None)  # powers of two of a degree: a few
    wide = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_level"))
    span = lambda x: F.sequence(F.floor(box[f"min_{x}"] / wide), F.floor(box[f"max_{x}"] / wide))
    dealt = leveled.withColumn("_cy", F.explode(span("lat"))).withColumn("_cx", F.explode(span("lon")))
    placed = points.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    placed = placed.withColumns({"_cy": F.floor(F.col("lat") / wide), "_cx": F.floor(F.col("lon") / wide)})
    found = placed.join(dealt, ["_level", "_cy", "_cx"]).where(in_polygon(F.col("lat"), F.col("lon"), F.col("exterior"), F.col("holes")))
    return found.select(*points.columns, "poly_id")


def crossing(lat0: Column, lon0: Column, lat1: Column, lon1: Column, exterior: Column, holes: Column, steps: int = 20) -> Column:
    """Share of the way from an inner to an outer point (or the other way round) at which the border is met, by bisection."""
    start = in_polygon(lat0, lon0, exterior, holes)

    def halve(acc: Column, _: Column) -> Column:
        t = (acc["lo"] + acc["hi"]) / 2
        same = in_polygon(lat0 + t * (lat1 - lat0), lon0 + t * (lon1 - lon0), exterior, holes) == start
        return F.struct(F.when(same, t).otherwise(acc["lo"]).alias("lo"), F.when(same, acc["hi"]).otherwise(t).alias("hi"))

    begin = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), begin, halve, lambda a: (a["lo"] + a["hi"]) / 2)


def clip_lines(waypoints: DataFrame, polygons: DataFrame, by: str = "plan_id", line: str = "line_index", wp: str = "wp_index") -> DataFrame:
    """Lines cut to the polygon of their plan: runs of inner waypoints with a border point at each end.

    Columns beside position are kept from the waypoint (or the inner neighbour, for
    a border point). Lines are numbered anew in order of plan, line and run; runs of
    fewer than two points are dropped. A double crossing within one step is not seen.
    """
    w = Window.partitionBy(by, line).orderBy(wp)
    rows = waypoints.join(polygons.select(by, "exterior", "holes"), by)
    rows = rows.withColumn("inside", in_polygon(F.col("lat"), F.col("lon"), F.col("exterior"), F.col("holes")))
    rows = rows.withColumns({"_in0": F.lag("inside").over(w), "_lat0": F.lag("lat").over(w), "_lon0": F.lag("lon").over(w), "_alt0": F.lag("alt").over(w)})
    rows = rows.withColumn("run", F.sum(F.when(F.col("inside") & ~F.coalesce("_in0", F.lit(False)), 1).otherwise(0)).over(w))
    turn = F.col("_in0").isNotNull() & (F.col("inside") != F.col("_in0"))
    t = F.when(turn, crossing(F.col("_lat0"), F.col("_lon0"), F.col("lat"), F.col("lon"), F.col("exterior"), F.col("holes")))
    rows = rows.withColumn("_t", t)
    mix = lambda a, b: F.col(a) + F.col("_t") * (F.col(b) - F.col(a))
    border = F.struct((F.col(wp) - F.lit(0.5)).alias("at"), mix("_lat0", "lat").alias("lat"), mix("_lon0", "lon").alias("lon"), mix("_alt0", "alt").alias("alt"), F.lit(True).alias("border"))
    own = F.struct(F.col(wp).cast("double").alias("at"), "lat", "lon", "alt", F.lit(False).alias("border"))
    points = F.filter(F.array(F.when(turn, border), F.when(F.col("inside"), own)), lambda x: x.isNotNull())
    cut = rows.withColumn("p", F.explode(points)).select(by, line, "run", "p.*")
    cut = cut.withColumn("_n", F.count("*").over(Window.partitionBy(by, line, "run"))).where("_n >= 2").drop("_n")
    cut = cut.withColumn("clip_index", F.dense_rank().over(Window.partitionBy(by).orderBy(line, "run")) - 1)
    return cut.withColumn("clip_wp", F.row_number().over(Window.partitionBy(by, "clip_index").orderBy("at")) - 1)


def segments_meet(a: tuple[str, str], b: tuple[str, str], c: tuple[str, str], d: tuple[str, str]) -> Column:
    """Whether open segments a-b and c-d (column name pairs x, y) cross strictly inside; parallel ones never do."""
    x = lambda p: F.col(p[0])
    y = lambda p: F.col(p[1])
    denom = (x(b) - x(a)) * (y(d) - y(c)) - (y(b) - y(a)) * (x(d) - x(c))
    t = ((x(c) - x(a)) * (y(d) - y(c)) - (y(c) - y(a)) * (x(d) - x(c))) / F.nullif(denom, F.lit(0.0))
    u = ((x(c) - x(a)) * (y(b) - y(a)) - (y(c) - y(a)) * (x(b) - x(a))) / F.nullif(denom, F.lit(0.0))
    inner = lambda v: (v > 1e-9) & (v < 1 - 1e-9)
    return F.coalesce((F.abs(denom) >= 1e-10) & inner(t) & inner(u), F.lit(False))
