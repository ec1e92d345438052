"""Queries of plan generation, polygons, corridors, routes, turns and trajectories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy as g
from ..functions import geometry as geo
from ..functions import sqlfunctions
from ..operators import planning, solvers
from . import domain as d
from .registry import query, rounded

# ---------------------------------------------------------------- area grids


def grid_sql(missions: str) -> str:
    """Waypoints of the area grids of missions, as SQL."""
    corners = planning.CORNER.sql(f"select m.*, case when k < 2 then min_lat else max_lat end as corner_lat, case when k % 2 = 0 then min_lon else max_lon end as corner_lon from ({missions}) m, (select unnest([0, 1, 2, 3]) as k)")
    sized = f"""select m.*, across_min, along_min, {planning.grid_size('(across_max - across_min)', 'line_spacing')} as n_lines, {planning.grid_size('(along_max - along_min)', 'photo_interval')} as n_wp
from ({missions}) m join (select plan_id, min(across) as across_min, max(across) as across_max, min(along) as along_min, max(along) as along_max from ({corners}) group by plan_id) s on m.plan_id = s.plan_id"""
    return f"select *, w_lat as lat, w_lon as lon from ({planning.WALK.sql(f'select *, unnest(range(n_wp)) as wp_index from (select *, unnest(range(n_lines)) as line_index from ({sized}))')})"


_GRID_SQL = grid_sql(d.MISSIONS.sql)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return planning.area_grid(d.MISSIONS.load(spark, sf_dir))


_GRID_OUT = {"plan_id": None, "line_index": None, "wp_index": None, "lat": 8, "lon": 8}


@query("gen_01_area_grid", f"select plan_id, cast(line_index as integer) as line_index, cast(wp_index as integer) as wp_index, round(lat, 8) + 0e0 as lat, round(lon, 8) + 0e0 as lon from ({_GRID_SQL})")
def area_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).selectExpr(*rounded(_GRID_OUT))


_PLANS = "case when plan_id % 2 = 0 then 'AGL' else 'EGM2008' end as datum, case when plan_id % 2 = 0 then agl else msl end as alt"


@query("gen_02_03_plan_altitudes", f"select plan_id, datum, max(alt) as alt, cast(count(distinct line_index) as bigint) as lines, count(*) as waypoints from (select *, {_PLANS} from ({_GRID_SQL})) group by plan_id, datum")
def plan_altitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).selectExpr("*", *(x.strip() for x in ("case when plan_id % 2 = 0 then 'AGL' else 'EGM2008' end as datum", "case when plan_id % 2 = 0 then agl else msl end as alt"))).groupBy("plan_id", "datum").agg(F.max("alt").alias("alt"), F.countDistinct("line_index").alias("lines"), F.count("*").alias("waypoints"))


@query("gen_13_reverse_line", f"select plan_id, cast(line_index as integer) as line_index, cast(n_wp - 1 - wp_index as integer) as wp_index, round(lat, 8) + 0e0 as lat, round(lon, 8) + 0e0 as lon from ({_GRID_SQL})")
def reverse_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).withColumn("wp_index", F.col("n_wp") - 1 - F.col("wp_index")).selectExpr(*rounded(_GRID_OUT))


@query("gen_05_corridor_offsets", "select n_nationkey as id, passes, k as pass, case when passes = 1 then 0e0 else round(-width / 2e0 + k * width / (passes - 1), 9) + 0e0 end as offset_m from (select *, unnest(range(passes)) as k from (select n_nationkey, cast(1 + 2 * (n_nationkey % 3) as integer) as passes, 40e0 + n_nationkey as width from nation))")
def corridor_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").selectExpr("n_nationkey as id", "cast(1 + 2 * (n_nationkey % 3) as int) as passes", "40e0 + cast(n_nationkey as double) as width")
    return rows.select("id", "passes", F.posexplode(F.expr(planning.corridor_offsets("passes", "width"))).alias("pass", "offset_m")).selectExpr("id", "passes", "cast(pass as bigint) as pass", "round(offset_m, 9) + 0e0 as offset_m")


# ---------------------------------------------------------------- polygons

#: Per mission an L-shaped border with a hole near its middle, in shares of the box.
_SHAPE = ((0.05, 0.05), (0.95, 0.07), (0.93, 0.55), (0.52, 0.57), (0.55, 0.96), (0.06, 0.94))
_HOLE = ((0.2, 0.2), (0.41, 0.22), (0.4, 0.43), (0.21, 0.41))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    ring = lambda shape: F.array(*(F.struct((F.col("min_lat") + y * (F.col("max_lat") - F.col("min_lat"))).alias("lat"), (F.col("min_lon") + x * (F.col("max_lon") - F.col("min_lon"))).alias("lon")) for x, y in shape))
    return d.MISSIONS.load(spark, sf_dir).select("plan_id", ring(_SHAPE).alias("exterior"), F.array(ring(_HOLE)).alias("holes"))


def _edges_sql() -> str:
    rows = []
    for ring, shape in enumerate((_SHAPE, _HOLE)):
        for i, (x, y) in enumerate(shape):
            px, py = shape[i - 1]
            rows.append(f"({ring}, {x}e0, {y}e0, {px}e0, {py}e0)")
    box = lambda s, k: f"min_{s} + {k} * (max_{s} - min_{s})"
    return f"select plan_id, ring, {box('lon', 'x')} as x1, {box('lat', 'y')} as y1, {box('lon', 'px')} as x2, {box('lat', 'py')} as y2 from ({d.MISSIONS.sql}), (values {', '.join(rows)}) as e(ring, x, y, px, py)"


_PIP_SQL = f"""select plan_id, line_index, wp_index, lat, lon, n_wp, outer_hits % 2 = 1 and hole_hits % 2 = 0 as inside from (
  select g.plan_id, line_index, wp_index, any_value(g.lat) as lat, any_value(g.lon) as lon, any_value(n_wp) as n_wp,
    count(*) filter (ring = 0 and (y1 > g.lat) <> (y2 > g.lat) and g.lon < (x2 - x1) * (g.lat - y1) / nullif(y2 - y1, 0) + x1) as outer_hits,
    count(*) filter (ring = 1 and (y1 > g.lat) <> (y2 > g.lat) and g.lon < (x2 - x1) * (g.lat - y1) / nullif(y2 - y1, 0) + x1) as hole_hits
  from ({_GRID_SQL}) g join ({_edges_sql()}) e on g.plan_id = e.plan_id group by g.plan_id, line_index, wp_index)"""


@query("gen_11_12_point_in_polygon", f"select plan_id, cast(line_index as integer) as line_index, cast(wp_index as integer) as wp_index, inside from ({_PIP_SQL})")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid(spark, sf_dir).join(polygons(spark, sf_dir), "plan_id")
    return rows.select("plan_id", "line_index", "wp_index", geo.in_polygon(F.col("lat"), F.col("lon"), F.col("exterior"), F.col("holes")).alias("inside"))


@query("gen_12_polygon_bounds", f"select plan_id, round(min(y1), 9) as min_lat, round(max(y1), 9) as max_lat, round(min(x1), 9) as min_lon, round(max(x1), 9) as max_lon from ({_edges_sql()}) where ring = 0 group by plan_id")
def polygon_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons(spark, sf_dir).select("plan_id", *(F.round(v, 9).alias(k) for k, v in geo.bounds(F.col("exterior")).items()))


_CELL_POINTS = "select seq, lat - 7e0 + cast(seq % 25 as double) as lat, lon - 8e0 + cast(seq % 25 as double) * 2e0 as lon, cast(seq % 25 as bigint) as plan_id"


@query(
    "join_points_in_polygons",
    f"""select seq, poly_id from (select p.seq, e.plan_id as poly_id, count(*) filter (ring = 0 and (y1 > p.lat) <> (y2 > p.lat) and p.lon < (x2 - x1) * (p.lat - y1) / nullif(y2 - y1, 0) + x1) as o,
  count(*) filter (ring = 1 and (y1 > p.lat) <> (y2 > p.lat) and p.lon < (x2 - x1) * (p.lat - y1) / nullif(y2 - y1, 0) + x1) as h
from (select seq, 40e0 + cast(seq % 25 as double) + cast(seq % 91 as double) * 1e-4 as lat, cast(seq % 25 as double) * 2e0 + cast(seq % 83 as double) * 13e-5 as lon from ({d.TELEMETRY.sql})) p join ({_edges_sql()}) e on true group by p.seq, e.plan_id) where o % 2 = 1 and h % 2 = 0""",
)
def points_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = d.TELEMETRY.load(spark, sf_dir).selectExpr("seq", "40e0 + cast(seq % 25 as double) + cast(seq % 91 as double) * 1e-4 as lat", "cast(seq % 25 as double) * 2e0 + cast(seq % 83 as double) * 13e-5 as lon")
    return geo.points_in_polygons(points, polygons(spark, sf_dir).withColumnRenamed("plan_id", "poly_id"), cell=0.01).select("seq", "poly_id")


def clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.clip_lines(grid(spark, sf_dir).withColumn("alt", F.col("msl")), polygons(spark, sf_dir))


def _runs_sql(located: str) -> str:
    """Points of each run of inner waypoints of a line, with a border point at each end that has an outer neighbour."""
    return f"""select plan_id, clip_index, count(*) + max(before) + max(after) as points from (
  select *, cast(dense_rank() over (partition by plan_id order by line_index, run) - 1 as integer) as clip_index from (
    select *, count(*) over (partition by plan_id, line_index, run) + max(before) over (partition by plan_id, line_index, run) + max(after) over (partition by plan_id, line_index, run) as n from (
      select *, sum(case when inside and not coalesce(prev, false) then 1 else 0 end) over (partition by plan_id, line_index order by wp_index) as run,
        case when inside and wp_index > 0 and not prev then 1 else 0 end as before, case when inside and nxt is not null and not nxt then 1 else 0 end as after
      from (select *, lag(inside) over w as prev, lead(inside) over w as nxt from ({located}) window w as (partition by plan_id, line_index order by wp_index))) where inside) where n >= 2) group by plan_id, clip_index"""


@query("gen_10_clip_runs", _runs_sql(_PIP_SQL))
def clip_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clipped(spark, sf_dir).groupBy("plan_id", "clip_index").agg(F.count("*").alias("points"))


@query("gen_10_clipped_lines")
def clipped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clipped(spark, sf_dir).select("plan_id", "clip_index", "clip_wp", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), "border")


def _crossing_sql() -> str:
    """Points at which the border is met between two waypoints of a line, at the accuracy of the edges' own equations."""
    hit = "(x2 - x1) * dy - (y2 - y1) * dx"
    return f"""select plan_id, line_index, wp_index, round(lat0 + t * dy, 6) + 0e0 as lat, round(lon0 + t * dx, 6) + 0e0 as lon from (
  select g.*, ((x2 - x1) * (y1 - lat0) - (y2 - y1) * (x1 - lon0)) / ({hit}) as t, (dx * (y1 - lat0) - dy * (x1 - lon0)) / ({hit}) as u
  from (select *, lat - lat0 as dy, lon - lon0 as dx from (select *, lag(lat) over w as lat0, lag(lon) over w as lon0, lag(inside) over w as before from ({_PIP_SQL}) window w as (partition by plan_id, line_index order by wp_index)) where before <> inside) g
  join ({_edges_sql()}) e on g.plan_id = e.plan_id where {hit} <> 0) where t between 0 and 1 and u between 0 and 1"""


@query("gen_10_border_points", _crossing_sql())
def border_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where lines meet the border: found by bisection here, from the edges' equations in the SQL."""
    rows = clipped(spark, sf_dir).where("border")
    return rows.select("plan_id", "line_index", F.ceil("at").cast("int").alias("wp_index"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


_INSIDE_HOLE_SQL = _PIP_SQL.replace("outer_hits % 2 = 1 and hole_hits % 2 = 0 as inside", "hole_hits % 2 = 1 as inside")


@query("set_01_union_of_clips", f"select 0 as part, plan_id, clip_index, points from ({_runs_sql(_PIP_SQL)}) union all select 1, plan_id, clip_index, points from ({_runs_sql(_INSIDE_HOLE_SQL)})")
def union_of_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut to each of two polygons of a plan, one after the other: the border with its hole, and the hole."""
    both = polygons(spark, sf_dir)
    inner = both.select("plan_id", F.col("holes")[0].alias("exterior"), F.slice("holes", 1, 0).alias("holes"))
    parts = [geo.clip_lines(grid(spark, sf_dir).withColumn("alt", F.col("msl")), p).withColumn("part", F.lit(k)) for k, p in enumerate((both, inner))]
    return parts[0].unionByName(parts[1]).groupBy("part", "plan_id", "clip_index").agg(F.count("*").alias("points"))


@query(
    "gen_08_segments_meet",
    """select event_id, coalesce(abs(dn) >= 1e-10 and t > 1e-9 and t < 1 - 1e-9 and u > 1e-9 and u < 1 - 1e-9, false) as meet from (
select event_id, dn, ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / nullif(dn, 0) as t, ((cx - ax) * (byy - ay) - (cy - ay) * (bx - ax)) / nullif(dn, 0) as u from (
select *, (bx - ax) * (dy - cy) - (byy - ay) * (dx - cx) as dn from (select event_id, """
    + ", ".join(f"cast((event_id * {m}) % 101 as double) as {n}" for n, m in zip(("ax", "ay", "bx", "\"by\"", "cx", "cy", "dx", "dy"), (3, 7, 11, 13, 17, 19, 23, 29), strict=True)).replace('"by"', "byy")
    + " from events)))",
)
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id", *(f"cast((event_id * {m}) % 101 as double) as {n}" for n, m in zip(("ax", "ay", "bx", "byy", "cx", "cy", "dx", "dy"), (3, 7, 11, 13, 17, 19, 23, 29), strict=True)))
    return e.select("event_id", geo.segments_meet(("ax", "ay"), ("bx", "byy"), ("cx", "cy"), ("dx", "dy")).alias("meet"))


# ---------------------------------------------------------------- group solvers


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last waypoint of every grid line."""
    rows = grid(spark, sf_dir)
    return rows.groupBy("plan_id", "line_index").agg(*(f(c, "wp_index").alias(f"{n}_{c}") for n, f in (("start", F.min_by), ("end", F.max_by)) for c in ("lat", "lon")))


@query("rte_01_03_distance_route")
def distance_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solvers.distance_route(lines(spark, sf_dir), launch="min")


@query("rte_04_06_energy_route")
def energy_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solvers.energy_route(lines(spark, sf_dir), tas=12.0, wind_speed=4.0, wind_dir=250.0, k1=0.0377, k2=986.0)


@query("rte_permutation_check", f"select plan_id, count(distinct line_index) as n, cast(min(line_index) as integer) as first_line, cast(max(line_index) as integer) as last_line, true as not_longer from ({_GRID_SQL}) group by plan_id")
def route_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line once, and no longer than flying the lines in their order."""
    route = solvers.distance_route(lines(spark, sf_dir), launch="min")
    return route.groupBy("plan_id").agg(F.countDistinct("line_index").alias("n"), F.min("line_index").alias("first_line"), F.max("line_index").alias("last_line"), (F.max("total_m") <= F.max("in_order_m") + 1e-6).alias("not_longer"))


@query("rte_07_reordered_lines")
def reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solvers.reorder(grid(spark, sf_dir).withColumn("transit", F.lit(False)), solvers.distance_route(lines(spark, sf_dir), launch="min")).select("plan_id", "visit_seq", "new_wp", F.round("lat", 8).alias("lat"), F.round("lon", 8).alias("lon"), "transit")


@query("trn_02_dubins_paths")
def dubins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    pose = lambda k: [((F.col("event_id") * k) % 997).cast("double") * 1.5, ((F.col("event_id") * (k + 2)) % 991).cast("double") * 1.5, F.radians(((F.col("event_id") * (k + 4)) % 360).cast("double"))]
    names = ("x0", "y0", "h0", "x1", "y1", "h1")
    return solvers.dubins_paths(e.select("event_id", *(v.alias(n) for n, v in zip(names, [*pose(31), *pose(57)], strict=True)), F.lit(150.0).alias("radius")))


def _dubins_sql() -> str:
    """Shortest lengths by the normalised formulas of the six words, which measure all angles from the line between the poses."""
    turn = lambda a: f"(case when {a} - 2 * pi() * floor(({a}) / (2 * pi())) > 2 * pi() - 1e-9 then 0e0 else {a} - 2 * pi() * floor(({a}) / (2 * pi())) end)"
    pose = lambda k: (f"cast((event_id * {k}) % 997 as double) * 15e-1", f"cast((event_id * {k + 2}) % 991 as double) * 15e-1", f"radians(cast((event_id * {k + 4}) % 360 as double))")
    (x0, y0, h0), (x1, y1, h1) = pose(31), pose(57)
    base = f"select event_id, sqrt(dx * dx + dy * dy) / 150e0 as d, h0 - atan2(dy, dx) as a, h1 - atan2(dy, dx) as b from (select event_id, {x1} - {x0} as dx, {y1} - {y0} as dy, {h0} as h0, {h1} as h1 from events)"
    base = f"select *, sin(a) as sa, cos(a) as ca, sin(b) as sb, cos(b) as cb, cos(a - b) as cab from ({base})"
    base = f"""select *, sqrt(greatest(2 + d * d - 2 * cab + 2 * d * (sa - sb), 0)) as p_lsl, sqrt(greatest(2 + d * d - 2 * cab + 2 * d * (sb - sa), 0)) as p_rsr,
  -2 + d * d + 2 * cab + 2 * d * (sa + sb) as s_lsr, -2 + d * d + 2 * cab - 2 * d * (sa + sb) as s_rsl,
  (6 - d * d + 2 * cab + 2 * d * (sa - sb)) / 8 as c_rlr, (6 - d * d + 2 * cab + 2 * d * (sb - sa)) / 8 as c_lrl,
  atan2(cb - ca, d + sa - sb) as w_lsl, atan2(ca - cb, d - sa + sb) as w_rsr from ({base})"""
    base = f"""select *, case when s_lsr >= 0 then atan2(-ca - cb, d + sa + sb) - atan2(-2, sqrt(s_lsr)) end as w_lsr, case when s_rsl >= 0 then atan2(ca + cb, d - sa - sb) - atan2(2, sqrt(s_rsl)) end as w_rsl,
  case when abs(c_rlr) <= 1 then 2 * pi() - acos(c_rlr) end as p_rlr, case when abs(c_lrl) <= 1 then 2 * pi() - acos(c_lrl) end as p_lrl from ({base})"""
    base = f"select *, {turn('a - w_rsr + p_rlr / 2')} as t_rlr, {turn('w_lsl - a + p_lrl / 2')} as t_lrl from ({base})"
    words = [f"{turn('w_lsl - a')} + p_lsl + {turn('b - w_lsl')}", f"{turn('a - w_rsr')} + p_rsr + {turn('w_rsr - b')}", f"{turn('w_lsr - a')} + sqrt(greatest(s_lsr, 0)) + {turn('w_lsr - b')}", f"{turn('a - w_rsl')} + sqrt(greatest(s_rsl, 0)) + {turn('b - w_rsl')}", f"t_rlr + p_rlr + {turn('a - b - t_rlr + p_rlr')}", f"t_lrl + p_lrl + {turn('b - a - t_lrl + p_lrl')}"]
    return f"select event_id, round(150e0 * least({', '.join(f'coalesce({w}, 1e300)' for w in words)}), 4) + 0e0 as length_m from ({base})"


@query("trn_02_dubins_lengths", _dubins_sql())
def dubins_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dubins(spark, sf_dir).selectExpr("event_id", "round(length_m, 4) + 0e0 as length_m")


@query("trn_03_turn_points")
def turn_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    pose = e.select(F.col("s_suppkey").alias("event_id"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(0.0).alias("h0"), (F.col("s_suppkey") % 40 * 10.0).alias("x1"), F.lit(200.0).alias("y1"), F.lit(3.14159).alias("h1"), F.lit(60.0).alias("radius"))
    return solvers.turn_points(pose, speed=15.0, bank_deg=20.0, roll_rate=15.0)


@query("trn_04_connected_lines")
def connected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solvers.connect_lines(grid(spark, sf_dir).withColumn("alt", F.col("msl")).select("plan_id", "line_index", "wp_index", "lat", "lon", "alt"), speed=15.0, bank_deg=25.0, roll_rate=15.0)


@query("gen_04_06_07_09_corridors")
def corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solvers.corridors(corridor_lines(spark, sf_dir), interval=50.0)


def corridor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre lines along all the telemetry of a vehicle."""
    t = d.TELEMETRY.load(spark, sf_dir)
    return t.selectExpr("vehicle as corridor_id", "seq as vertex", "lat", "lon", "cast(1 + 2 * (vehicle % 3) as int) as passes", "40e0 + cast(vehicle % 50 as double) as width")


_C = g.utm_forward("any_lat", "any_lon")


@query(
    "gen_04_corridor_status",
    f"select vehicle as corridor_id, {planning.corridor_status()} as status from (select vehicle, count(*) as n_vertices, 40e0 + cast(vehicle % 50 as double) as width, cast(1 + 2 * (vehicle % 4) as int) as passes, min(lat) as min_lat, max(lat) as max_lat, min(lon) as min_lon, max(lon) as max_lon from ({d.TELEMETRY.sql}) group by vehicle)",
)
def corridor_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = d.TELEMETRY.load(spark, sf_dir).groupBy("vehicle").agg(F.count("*").alias("n_vertices"), *(f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lat", "lon")))
    t = t.withColumns({"width": 40.0 + (F.col("vehicle") % 50).cast("double"), "passes": (1 + 2 * (F.col("vehicle") % 4)).cast("int")})
    return t.selectExpr("vehicle as corridor_id", f"{planning.corridor_status()} as status")


#: A straight centre line an event, from the origin; pass lines are known in closed form.
_STRAIGHT = d.View("events", {"event_id": "event_id", "x1": "100e0 + cast((event_id * 37) % 900 as double)", "y1": "cast((event_id * 91) % 700 as double)", "width": "40e0 + cast(event_id % 50 as double)", "passes": "cast(1 + 2 * (event_id % 3) as int)", "step": "50e0 + cast(event_id % 70 as double)"})


@query(
    "gen_05_06_09_sql_corridors",
    f"""with s as (select *, sqrt(x1 * x1 + y1 * y1) as len from ({_STRAIGHT.sql})),
p as (select *, case when passes = 1 then 0e0 else -width / 2 + pass * width / (passes - 1) end as off from (select *, unnest(range(passes)) as pass from s)),
w as (select *, unnest(range(cast(floor(len / step + 1e-9) as bigint) + 2)) as wp from p),
g as (select *, case when wp > floor(len / step + 1e-9) then len else least(wp * step, len) end as gone from w)
select event_id, cast(pass as integer) as pass, cast(wp as integer) as wp, round((gone * x1 - off * y1) / len, 6) + 0e0 as x, round((gone * y1 + off * x1) / len, 6) + 0e0 as y from g""",
)
def sql_corridors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corridor waypoints by a function of Spark SQL over batches of a view's rows."""
    sqlfunctions.register(spark)
    _STRAIGHT.load(spark, sf_dir).createOrReplaceTempView("aeroframe_straight")
    return spark.sql("select event_id, pass, wp, round(x, 6) + 0e0 as x, round(y, 6) + 0e0 as y from aeroframe_straight lateral view inline(corridor_arrays(array(0e0, x1), array(0e0, y1), width, passes, step)) as pass, wp, x, y")


# ---------------------------------------------------------------- trajectories


@query("trj_02_elastic_band")
def elastic_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solvers.elastic_bands(solvers.profiles(spark), 50.0, *solvers.SUITE_RELAXATION)


@query("trj_03_07_smooth_waypoints")
def smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solvers.smooth_waypoints(solvers.elastic_bands(solvers.profiles(spark), 50.0, *solvers.SUITE_RELAXATION), spacing=50.0, clearance=50.0)


@query("trj_04_06_spline_reports")
def spline_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solvers.spline_reports(solvers.elastic_bands(solvers.profiles(spark), 50.0, *solvers.SUITE_RELAXATION), clearance=50.0)


@query("trj_09_sinusoid_sweep")
def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return solvers.sweep_metrics(spark, clearance=50.0)
