"""Operators on ordered tracks: legs, wind, energy, lengths, status streams in batch form."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geodesy as g
from ..functions import physics as p
from ..functions.constants import GRAVITY, RESERVE
from ..functions.program import Program


def legs(df: DataFrame, by: list[str], order: str, carry: dict[str, str]) -> DataFrame:
    """Each row with columns of the row before it in its track (null on the first)."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumns({new: F.lag(old).over(w) for new, old in carry.items()})


def geodesic_legs(df: DataFrame, by: list[str], order: str, nodes: int = 4, updates: int = 4) -> DataFrame:
    """Legs between neighbours of a track: from the earlier point, distance and azimuth on the ellipsoid. First rows are dropped."""
    df = legs(df, by, order, {"lat0": "lat", "lon0": "lon", "alt0": "alt"}).where("lat0 is not null")
    return g.geodesic_inverse("lat0", "lon0", "lat", "lon", nodes=nodes, updates=updates).apply(df)


def wind_legs(df: DataFrame, tas: str, wind_speed: str, wind_dir: str) -> DataFrame:
    """Ground speed, heading and correction angle of every leg; an infeasible leg keeps its row and says why."""
    return p.wind_triangle("geo_azi1", tas, wind_speed, wind_dir).apply(df)


def wind_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Per track: legs, legs with a correction over 20 degrees, infeasible legs, the largest correction."""
    return df.groupBy(*by).agg(
        F.count("*").alias("legs"),
        F.count_if(F.abs("wca_deg") > 20).alias("steep"),
        F.count_if(F.col("wind_status") != "OK").alias("infeasible"),
        F.max(F.abs("wca_deg")).alias("max_crab_deg"),
    )


def mission_energy(df: DataFrame, by: list[str], tas: str, battery_wh: str = "battery_wh") -> DataFrame:
    """Energy of missions from their legs (distance, rise, ground speed, transit flag) and platform columns.

    A leg without a ground speed is flown at true airspeed. 80 % of the battery is
    usable; feasible missions need no more than that.
    """
    gs = f"coalesce(ground_speed, {tas})"
    e = p.power() + Program({"leg_j": p.segment_energy("geo_distance", "rise", gs, tas), "leg_s": f"geo_distance / {gs}", "climb_j": f"case when rise > 0e0 then mass * {GRAVITY}e0 * rise / eta else 0e0 end"})
    sums = (
        e.apply(df)
        .groupBy(*by)
        .agg(
            F.sum(F.when(~F.col("transit"), F.col("leg_j")).otherwise(0.0)).alias("survey_j"),
            F.sum(F.when(F.col("transit"), F.col("leg_j")).otherwise(0.0)).alias("turn_j"),
            F.sum("climb_j").alias("climb_j"),
            F.sum("leg_j").alias("total_j"),
            F.sum("leg_s").alias("time_s"),
            F.max(battery_wh).alias("battery_wh"),
        )
    )
    usable = F.col("battery_wh") * 3600 * RESERVE
    return sums.withColumns(
        {
            "feasible": F.col("total_j") <= usable,
            "with_reserve_j": F.col("total_j") / RESERVE,
            "endurance_s": usable / F.try_divide(F.col("total_j"), F.col("time_s")),
        }
    )


def planar_length(df: DataFrame, by: list[str], order: str, x: str, y: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    return df.withColumn("_d", F.sqrt(dx * dx + dy * dy)).groupBy(*by).agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias("length_m"), F.count("*").alias("points"))


#: Bits of a limb, and the limbs that doubles reach from: below 2^-1056 nothing counts.
_LIMB, _LOWEST, _HIGHEST = 32, -31, 30


def compensated_by(df: DataFrame, by: list[str], value: str, out: str = "total") -> DataFrame:
    """Sums per group without rounding on the way: the same for any order of rows and any number of tasks.

    A double is three whole numbers of 32 bits at a multiple of 32 binary places, so partial sums are sums of
    longs, which Spark adds exactly before and after the shuffle. At the end the few limbs of a group, at most
    three for each of 62 places, are added from the largest down with their rounding errors carried along. Nulls do
    not count; nan, infinities and what is beyond 2^990 make the sum what adding doubles makes it. Good for 2^31 rows a group.
    """
    x = F.col(value).cast("double")
    finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 2.0**990)
    place = F.when(x == 0, 0).otherwise(F.greatest(F.least(F.floor(F.log2(F.abs(x)) / _LIMB), F.lit(_HIGHEST)), F.lit(_LOWEST))).cast("int")
    unit = lambda k: F.pow(F.lit(2.0), (F.col("_t") - k) * _LIMB)
    rows = df.where(x.isNotNull()).select(*by, x.alias("_x"), F.when(finite, place).alias("_t"))
    rows = rows.withColumn("_a", (F.col("_x") / unit(0)).cast("long")).withColumn("_r", F.col("_x") - F.col("_a") * unit(0))
    rows = rows.withColumn("_b", (F.col("_r") / unit(1)).cast("long")).withColumn("_c", ((F.col("_r") - F.col("_b") * unit(1)) / unit(2)).cast("long"))
    limbs = rows.groupBy(*by, "_t").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"), F.sum("_c").alias("_c"), F.sum(F.when(F.col("_t").isNull(), F.col("_x"))).alias("_odd"))
    # a sum of limbs has up to 63 bits: as two doubles it is exact
    halves = [(F.shiftright(v, 32), n, 1) for n, v in enumerate(("_a", "_b", "_c"))] + [(F.col(v).bitwiseAND(F.lit(0xFFFFFFFF)), n, 0) for n, v in enumerate(("_a", "_b", "_c"))]
    terms = F.array(*(v.cast("double") * F.pow(F.lit(2.0), F.greatest((F.col("_t") - n + up) * _LIMB, F.lit(-1074))) for v, n, up in halves))
    parts = limbs.groupBy(*by).agg(F.flatten(F.collect_list(F.when(F.col("_t").isNotNull(), terms))).alias("_v"), F.sum("_odd").alias("_odd"))
    total = two_sum(F.sort_array(F.transform("_v", lambda v: F.struct(F.abs(v).alias("size"), v.alias("v"))), asc=False))
    groups = df.select(*by).distinct()  # a group of nulls only has a sum of zero
    summed = parts.select(*by, F.coalesce("_odd", total).alias(out))
    same = [groups[c].eqNullSafe(summed[c]) for c in by]
    joined = groups.join(summed, reduce(and_, same), "left")
    return joined.select(*(groups[c] for c in by), F.coalesce(summed[out], F.lit(0.0)).alias(out))


def two_sum(values: Column) -> Column:
    """The sum of an array of (size, v) with the error of each addition carried beside it."""

    def add(acc: Column, x: Column) -> Column:
        s = acc["s"] + x["v"]
        z = s - acc["s"]
        return F.struct(s.alias("s"), (acc["e"] + ((acc["s"] - (s - z)) + (x["v"] - z))).alias("e"))

    return F.aggregate(values, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("e")), add, lambda acc: acc["s"] + acc["e"])


def rtk_alerts(df: DataFrame, by: list[str], order: str, fix: str = "fix", after: int = 20) -> DataFrame:
    """Rows at which the count of consecutive fixes below 4 reaches ``after`` (once a run)."""
    w = Window.partitionBy(*by).orderBy(order)
    runs = df.withColumn("_run", F.sum(F.when(F.col(fix) >= 4, 1).otherwise(0)).over(w)).where(F.col(fix) < 4)
    return runs.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_run").orderBy(order))).where(F.col("_n") == after).drop("_run", "_n")


def silences(df: DataFrame, by: list[str], seconds: float = 3.0, order: str = "seq", at_us: str = "at_us") -> DataFrame:
    """Rows that came more than ``seconds`` after the one before of their receiver, with the length of the silence."""
    gap = F.col(at_us) - F.lag(at_us).over(Window.partitionBy(*by).orderBy(at_us, order))
    return df.withColumn("silence_us", gap).where(F.col("silence_us") > int(seconds * 1_000_000))


#: Messages that a broadcast holds for slow consumers: telemetry, and warnings.
BROADCAST, WARNING_BROADCAST = 256, 64


def broadcast_reads(messages: DataFrame, polls: DataFrame, capacity: int = BROADCAST, start: int = 0, bucket_s: float = 3600.0) -> DataFrame:
    """What each poll of a consumer gets from a broadcast that holds the newest ``capacity`` messages.

    ``messages``: (seq, at_us) with consecutive numbers from ``start`` in order of time; ``polls``: (consumer, at_us). A consumer
    hears what is sent after its first poll. Returns consumer, at_us, newest, skipped (overwritten before they
    were read), received, and first_seq (of those received, else null). Times are dealt to buckets: a window
    inside each, and one row a bucket to carry the newest number on. Polls at one time come one after the other.
    """
    bucket = F.floor(F.col("at_us") / F.lit(int(bucket_s * 1e6))).alias("_b")
    both = messages.select("at_us", "seq", F.lit(None).cast("long").alias("consumer"), F.lit(False).alias("_poll"))
    both = both.union(polls.select("at_us", F.lit(None).cast("long"), F.col("consumer").cast("long"), F.lit(True))).select("*", bucket)
    inside = Window.partitionBy("_b").orderBy("at_us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("_b").agg(F.max("seq").alias("_last")).select("_b", F.max("_last").over(ahead).alias("_before"))
    newest = F.coalesce(F.greatest("_in", "_before"), F.lit(start - 1).cast("long"))
    seen = both.withColumn("_in", F.max("seq").over(inside)).where("_poll").join(carried, "_b").withColumn("newest", newest)
    new = F.col("newest") - F.lag("newest").over(Window.partitionBy("consumer").orderBy("at_us"))  # null at the first poll
    read = seen.withColumn("_new", F.coalesce(new, F.lit(0).cast("long")))
    read = read.withColumn("skipped", F.greatest(F.col("_new") - capacity, F.lit(0).cast("long"))).withColumn("received", F.col("_new") - F.col("skipped"))
    return read.select("consumer", "at_us", "newest", "skipped", "received", F.when(F.col("received") > 0, F.col("newest") - F.col("received") + 1).alias("first_seq"))


def last_state(df: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*(F.max_by(x, order).alias(x) for x in columns), F.max(order).alias(order))


def line_completion(df: DataFrame, by: list[str], line: str, wp: str, order: str) -> DataFrame:
    """Per line: percent flown (100 for a single point, or once another line was reached), and whether it is the active one.

    ``df`` has one row per waypoint passed and a column ``n_wp``, the waypoints of its line.
    """
    state = df.groupBy(*by, line).agg(F.max(wp).alias("_far"), F.max("n_wp").alias("_n"), F.max(order).alias("_last"))
    active = F.max("_last").over(Window.partitionBy(*by))
    pct = F.when((F.col("_last") < active) | (F.col("_n") <= 1), 100.0).otherwise(100.0 * F.col("_far") / (F.col("_n") - 1))
    return state.select(*by, line, pct.alias("completion_pct"), (F.col("_last") == active).alias("active"))


def headings(df: DataFrame, by: list[str], order: str, nodes: int = 4, updates: int = 4) -> DataFrame:
    """Azimuth to the next point of the track, else from the one before, else 0."""
    w = Window.partitionBy(*by).orderBy(order)
    df = df.withColumns({"_lat1": F.coalesce(F.lead("lat").over(w), F.col("lat")), "_lon1": F.coalesce(F.lead("lon").over(w), F.col("lon")), "_end": F.lead("lat").over(w).isNull(), "_plat": F.lag("lat").over(w), "_plon": F.lag("lon").over(w)})
    df = df.withColumns({"_a": F.when(F.col("_end") & F.col("_plat").isNotNull(), F.col("_plat")).otherwise(F.col("lat")), "_b": F.when(F.col("_end") & F.col("_plat").isNotNull(), F.col("_plon")).otherwise(F.col("lon")), "_only": F.col("_end") & F.col("_plat").isNull()})
    df = g.geodesic_inverse("_a", "_b", "_lat1", "_lon1", out="hd_", nodes=nodes, updates=updates).apply(df)
    return df.withColumn("heading", F.when(F.col("_only"), 0.0).otherwise(F.col("hd_azi1"))).drop(*[x for x in df.columns if x.startswith("_")], "hd_distance", "hd_azi1", "hd_azi2", "hd_status")


def last_triggers(df: DataFrame, by: list[str], order: str, keep: int = 10_000) -> DataFrame:
    """The newest ``keep`` triggers of each track, with the total count beside the retained one."""
    rows = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(order)))).where(F.col("_r") <= keep).drop("_r")
    totals = df.groupBy(*by).agg(F.count("*").alias("total"))
    return rows.join(totals, by).withColumn("retained", F.least("total", F.lit(keep).cast("long")))


def without_repeats(df: DataFrame, by: list[str], order: str, x: str, y: str, least: float = 1e-6) -> DataFrame:
    """Points of a track without those nearer than ``least`` to the one before."""
    w = Window.partitionBy(*by).orderBy(order)
    dx, dy = F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)
    return df.withColumn("_d", F.sqrt(dx * dx + dy * dy)).where("_d is null or _d >= " + repr(least)).drop("_d")


def delete_line(df: DataFrame, plan: str, line: str, gone: Column) -> DataFrame:
    """Rows of a plan without the lines for which ``gone`` holds; later lines move up so indexes stay without gaps."""
    return df.where(~gone).withColumn(line, (F.dense_rank().over(Window.partitionBy(plan).orderBy(line)) - 1).cast("int"))


def mission_summary(df: DataFrame, by: list[str], line: str, order: str) -> DataFrame:
    """Per mission: lines, waypoints, kilometres along lines, bounding box."""
    flown = geodesic_legs(df, [*by, line], order).groupBy(*by).agg((F.sum("geo_distance") / 1000).alias("total_km"))
    box = df.groupBy(*by).agg(F.countDistinct(line).alias("line_count"), F.count("*").alias("waypoint_count"), *(f(x).alias(f"{f.__name__}_{x}") for f in (F.min, F.max) for x in ("lat", "lon")))
    return box.join(flown, by, "left").withColumn("total_km", F.coalesce("total_km", F.lit(0.0)))
