"""Queries over tracks: legs, wind, energy, NMEA, receiver state, line status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geodesy as g
from ..functions import nmea
from ..functions import physics as p
from ..functions.constants import GRAVITY, RESERVE
from ..functions.program import Program
from ..operators import tracks
from . import domain as d
from .registry import query, rounded

_PLATFORM = {"mass": "1.4e0", "cd": "1e0", "frontal": "4e-2", "wing_area": "cast(null as double)", "wingspan": "cast(null as double)", "oswald": "cast(null as double)", "rotor_area": "12e-2", "eta": "65e-2", "regen": "1e-1", "battery_wh": "20000e0"}
_WIND = {"wind_speed": "cast(seq % 9 as double)", "wind_dir": "cast((seq * 7) % 360 as double)", "transit": "seq % 5 = 0"}
_SET = _PLATFORM | _WIND
_ADD = ", ".join(f"{v} as {k}" for k, v in _SET.items())

_LEGS = g.geodesic_inverse("lat0", "lon0", "lat", "lon", nodes=4, updates=4)
_LEGS_SQL = _LEGS.sql(f"select * from (select *, lag(lat) over w as lat0, lag(lon) over w as lon0, lag(alt) over w as alt0 from ({d.TELEMETRY.sql}) window w as (partition by vehicle order by seq)) where lat0 is not null")
_WIND_SQL = p.wind_triangle("geo_azi1", "speed", "wind_speed", "wind_dir").sql(f"select *, alt - alt0 as rise, {_ADD} from ({_LEGS_SQL})")


def _wind_legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flown = tracks.geodesic_legs(d.TELEMETRY.load(spark, sf_dir), ["vehicle"], "seq")
    return tracks.wind_legs(flown.selectExpr("*", "alt - alt0 as rise", *(f"{v} as {k}" for k, v in _SET.items())), "speed", "wind_speed", "wind_dir")


_E = p.power() + Program({"leg_j": p.segment_energy("geo_distance", "rise", "coalesce(ground_speed, speed)", "speed"), "leg_s": "geo_distance / coalesce(ground_speed, speed)", "climb_leg_j": f"case when rise > 0e0 then mass * {GRAVITY}e0 * rise / eta else 0e0 end"})
_ENERGY_SQL = f"""
select vehicle, round(survey_j, 1) + 0e0 as survey_j, round(turn_j, 1) + 0e0 as turn_j, round(climb_j, 1) + 0e0 as climb_j, round(total_j, 1) + 0e0 as total_j,
  round(time_s, 3) + 0e0 as time_s, total_j <= battery * 3600 * {RESERVE}e0 as feasible, round(total_j / {RESERVE}e0, 1) + 0e0 as with_reserve_j,
  round(battery * 3600 * {RESERVE}e0 / (total_j / time_s), 2) + 0e0 as endurance_s
from (
  select vehicle, sum(case when transit then 0e0 else leg_j end) as survey_j, sum(case when transit then leg_j else 0e0 end) as turn_j,
    sum(climb_leg_j) as climb_j, sum(leg_j) as total_j, sum(leg_s) as time_s, max(battery_wh) as battery
  from ({_E.sql(_WIND_SQL)}) group by vehicle)
"""


@query("flag_vehicle_energy", _ENERGY_SQL)
def vehicle_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ENE-06/07 and the flagship: telemetry, legs, wind, energy, feasibility per vehicle."""
    found = tracks.mission_energy(_wind_legs(spark, sf_dir), ["vehicle"], "speed")
    return found.selectExpr(*rounded({"vehicle": None, "survey_j": 1, "turn_j": 1, "climb_j": 1, "total_j": 1, "time_s": 3, "feasible": None, "with_reserve_j": 1, "endurance_s": 2}))


_KIN03 = {"vehicle": None, "seq": None, "geo_distance": 4, "geo_azi1": 5, "ground_speed": 6, "wca_deg": 6, "wind_status": None}


@query("kin_03_segment_ground_speed", f"select {', '.join(rounded(_KIN03))} from ({_WIND_SQL})")
def segment_ground_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _wind_legs(spark, sf_dir).selectExpr(*rounded(_KIN03))


@query("kin_04_wind_on_plan", f"select vehicle, count(*) as legs, count(*) filter (abs(wca_deg) > 20) as steep, count(*) filter (wind_status <> 'OK') as infeasible, round(max(abs(wca_deg)), 6) + 0e0 as max_crab_deg from ({_WIND_SQL}) group by vehicle")
def wind_on_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.wind_summary(_wind_legs(spark, sf_dir), ["vehicle"]).selectExpr("vehicle", "legs", "steep", "infeasible", "round(max_crab_deg, 6) + 0e0 as max_crab_deg")


@query("agg_02_average_survey_speed", f"select vehicle, round(avg(ground_speed) filter (not transit), 6) + 0e0 as avg_speed, count(*) filter (not transit and ground_speed is not null) as n from ({_WIND_SQL}) group by vehicle")
def average_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    gs = F.when(~F.col("transit"), F.col("ground_speed"))
    return _wind_legs(spark, sf_dir).groupBy("vehicle").agg((F.round(F.avg(gs), 6) + 0.0).alias("avg_speed"), F.count(gs).alias("n"))


_UTM = g.utm_forward(zone="cast(32 as int)", hemisphere="'N'")


@query("geo_15_planar_length", f"select vehicle, round(coalesce(sum(sqrt(dx * dx + dy * dy)), 0e0), 3) + 0e0 as length_m, count(*) as points from (select vehicle, easting - lag(easting) over w as dx, northing - lag(northing) over w as dy from ({_UTM.sql(d.TELEMETRY.sql)}) window w as (partition by vehicle order by seq)) group by vehicle")
def planar_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.planar_length(_UTM.apply(d.TELEMETRY.load(spark, sf_dir)), ["vehicle"], "seq", "easting", "northing").selectExpr("vehicle", "round(length_m, 3) + 0e0 as length_m", "points")


@query("geo_16_kahan_sum", f"select vehicle, round(kahan_sum(speed * 1e-1 + alt * 1e-3), 9) + 0e0 as total from ({d.TELEMETRY.sql}) group by vehicle")
def kahan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.TELEMETRY.load(spark, sf_dir).selectExpr("vehicle", "seq", "speed * 1e-1 + alt * 1e-3 as x")
    return tracks.compensated_by(rows, ["vehicle"], "x").selectExpr("vehicle", "round(total, 9) + 0e0 as total")


@query(
    "stm_02_rtk_alerts",
    f"select vehicle, seq, fix from (select *, row_number() over (partition by vehicle, run order by seq) as n from (select *, sum(case when fix >= 4 then 1 else 0 end) over (partition by vehicle order by seq) as run from ({d.TELEMETRY.sql})) where fix < 4) where n = 3",
)
def rtk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.rtk_alerts(d.TELEMETRY.load(spark, sf_dir), ["vehicle"], "seq", after=3).select("vehicle", "seq", "fix")


@query("stm_03_last_state", f"select vehicle, arg_max(lat, seq) as lat, arg_max(lon, seq) as lon, arg_max(fix, seq) as fix, max(seq) as seq from ({d.TELEMETRY.sql}) group by vehicle")
def last_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.last_state(d.TELEMETRY.load(spark, sf_dir), ["vehicle"], "seq", ["lat", "lon", "fix"])


@query(
    "lim_10_fleet_ring",
    f"select seq, vehicle, (select count(*) from events) as total, least((select count(*) from events), 10000) as retained from ({d.TELEMETRY.sql}) qualify row_number() over (order by seq desc) <= 10000",
)
def fleet_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 10 000 triggers of the whole fleet, in one log."""
    rows = d.TELEMETRY.load(spark, sf_dir).select("vehicle", "seq", F.lit(0).alias("log"))
    return tracks.last_triggers(rows, ["log"], "seq").select("seq", "vehicle", "total", "retained")


@query(
    "stm_08_slow_consumers",
    """select consumer, seq, at_us, newest, greatest(fresh - 256, 0) as skipped, fresh - greatest(fresh - 256, 0) as received, case when fresh > 0 then newest - (fresh - greatest(fresh - 256, 0)) + 1 end as first_seq
from (select *, coalesce(newest - lag(newest) over (partition by consumer order by at_us), 0) as fresh
  from (select user_id as consumer, event_id as seq, epoch_us(ts) as at_us, max(event_id) over (order by epoch_us(ts) range between unbounded preceding and current row) as newest from events))""",
)
def slow_consumers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vehicle reads the broadcast of all events when it sends one itself; it holds the newest 256."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    reads = tracks.broadcast_reads(e.select(F.col("event_id").alias("seq"), "at_us"), e.select(F.col("user_id").alias("consumer"), "at_us"), bucket_s=6 * 3600.0)
    sent = e.select(F.col("user_id").alias("consumer"), "at_us", F.col("event_id").alias("seq"))  # (user_id, ts) is unique
    return reads.join(sent, ["consumer", "at_us"]).select("consumer", "seq", "at_us", "newest", "skipped", "received", "first_seq")


_FLOWN = f"select *, cast(seq % 7 as int) as wp, 7 as n_wp, cast((seq // 7) % 4 as int) as line from ({d.TELEMETRY.sql})"


@query(
    "stm_04_line_completion",
    f"select vehicle, line, case when last < max(last) over (partition by vehicle) then 100e0 else 100e0 * far / 6 end as completion_pct, last = max(last) over (partition by vehicle) as active from (select vehicle, line, max(wp) as far, max(seq) as last from ({_FLOWN}) group by vehicle, line)",
)
def completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    flown = d.TELEMETRY.load(spark, sf_dir).selectExpr("*", "cast(seq % 7 as int) as wp", "7 as n_wp", "cast((seq div 7) % 4 as int) as line")
    return tracks.line_completion(flown, ["vehicle"], "line", "wp", "seq")


_HEAD = g.geodesic_inverse("a", "b", "lat1", "lon1", out="hd_", nodes=4, updates=4)


@query(
    "stm_05_headings",
    f"""select vehicle, seq, round(case when lone then 0e0 else hd_azi1 end, 5) + 0e0 as heading from ({_HEAD.sql(f'''
select vehicle, seq, case when nlat is null and plat is not null then plat else lat end as a, case when nlat is null and plat is not null then plon else lon end as b,
  coalesce(nlat, lat) as lat1, coalesce(nlon, lon) as lon1, nlat is null and plat is null as lone
from (select *, lead(lat) over w as nlat, lead(lon) over w as nlon, lag(lat) over w as plat, lag(lon) over w as plon from ({d.TELEMETRY.sql}) window w as (partition by vehicle order by seq))''')})""",
)
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.headings(d.TELEMETRY.load(spark, sf_dir), ["vehicle"], "seq").selectExpr("vehicle", "seq", "round(heading, 5) + 0e0 as heading")


@query(
    "lim_10_stm_06_trigger_ring",
    f"select vehicle, seq, total, least(total, 25) as retained from (select *, row_number() over (partition by vehicle order by seq desc) as r, count(*) over (partition by vehicle) as total from ({d.TELEMETRY.sql})) where r <= 25",
)
def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.last_triggers(d.TELEMETRY.load(spark, sf_dir), ["vehicle"], "seq", keep=25).select("vehicle", "seq", "total", "retained")


@query(
    "set_02_without_repeats",
    f"select vehicle, seq from (select *, sqrt((x - lag(x) over w) * (x - lag(x) over w) + (y - lag(y) over w) * (y - lag(y) over w)) as gap from (select vehicle, seq, floor(lat * 20) as x, floor(lon * 20) as y from ({d.TELEMETRY.sql})) window w as (partition by vehicle order by seq)) where gap is null or gap >= 1e-6",
)
def no_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.TELEMETRY.load(spark, sf_dir).selectExpr("vehicle", "seq", "floor(lat * 20) as x", "floor(lon * 20) as y")
    return tracks.without_repeats(rows, ["vehicle"], "seq", "x", "y").select("vehicle", "seq")


@query("srt_02_03_median_argmin", f"select vehicle, median(alt) as median_alt, arg_min(seq, alt * 1000000 + seq) as lowest_seq from ({d.TELEMETRY.sql}) group by vehicle")
def median_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.TELEMETRY.load(spark, sf_dir).groupBy("vehicle").agg(F.median("alt").alias("median_alt"), F.min_by("seq", F.expr("alt * 1000000 + seq")).alias("lowest_seq"))


@query(
    "snk_10_stm_07_delete_line",
    f"select vehicle, cast(dense_rank() over (partition by vehicle order by line) - 1 as integer) as line, seq from ({_FLOWN}) where not line = vehicle % 4",
)
def delete_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    flown = d.TELEMETRY.load(spark, sf_dir).selectExpr("vehicle", "seq", "cast((seq div 7) % 4 as int) as line")
    return tracks.delete_line(flown, "vehicle", "line", F.expr("line = vehicle % 4")).select("vehicle", "line", "seq")


@query(
    "snk_09_upsert_metadata",
    "select user_id as plan, event_type as key, arg_max(value, event_id) as value from events group by user_id, event_type",
)
def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.col("user_id").alias("plan"), F.col("event_type").alias("key")).agg(F.max_by("value", "event_id").alias("value"))


@query(
    "agg_01_mission_summary",
    f"""select v.vehicle, v.line_count, v.waypoint_count, v.min_lat, v.min_lon, v.max_lat, v.max_lon, round(coalesce(total_km, 0e0), 6) + 0e0 as total_km
from (select vehicle, count(distinct line) as line_count, count(*) as waypoint_count, min(lat) as min_lat, min(lon) as min_lon, max(lat) as max_lat, max(lon) as max_lon from ({_FLOWN}) group by vehicle) v
left join (select vehicle, sum(geo_distance) / 1000 as total_km from ({_LEGS.sql(f"select * from (select *, lag(lat) over w as lat0, lag(lon) over w as lon0 from ({_FLOWN}) window w as (partition by vehicle, line order by seq)) where lat0 is not null")}) group by vehicle) k on v.vehicle = k.vehicle""",
)
def mission_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    flown = d.TELEMETRY.load(spark, sf_dir).selectExpr("*", "cast((seq div 7) % 4 as int) as line")
    return tracks.mission_summary(flown, ["vehicle"], "line", "seq").selectExpr("vehicle", "line_count", "waypoint_count", "min_lat", "min_lon", "max_lat", "max_lon", "round(total_km, 6) + 0e0 as total_km")


# ---------------------------------------------------------------- NMEA

#: Two sentences an event: a GGA (or a GGK) and an RMC; some are corrupted, late, void or out of range.
_BODY0 = "case when event_id % 11 = 0 then concat('PTNL,GGK,', utc, ',010124,47', mm, ',N,008', mm, ',E,', cast(event_id % 4 as string), ',08,1.2,EHT', cast(500 + event_id % 100 as string), '.250,M') else concat('GPGGA,', utc, ',47', mm, ',', case when event_id % 19 = 0 then 'X' else 'N' end, ',008', mm, ',E,', cast(event_id % 6 as string), ',', case when event_id % 4 = 0 then '' else '09' end, ',0.9,', cast(400 + event_id % 300 as string), '.5,M,47.1,M,,') end"
_BODY1 = "concat('GNRMC,', case when event_id % 5 = 0 then '000000.00' else utc end, ',', case when event_id % 7 = 0 then 'V' else 'A' end, ',47', mm, ',N,008', mm, ',E,', cast(event_id % 90 as string), '.5,', cast(event_id % 360 as string), '.0,010124,,')"
_PARTS = ["user_id as receiver", "event_id", "lpad(cast(event_id % 240000 as string), 6, '0') || '.00' as utc", "lpad(cast((event_id * 7) % 62 as string), 2, '0') || '.' || lpad(cast((event_id * 13) % 10000 as string), 4, '0') as mm"]
_DUCK_XOR = "list_reduce(list_prepend(0, list_transform(string_split(body, ''), lambda c: ascii(c))), lambda a, x: xor(a, x))"
_SENTENCES_SQL = f"""select receiver, seq, body, '$' || body || '*' || upper(lpad(printf('%x', case when event_id % 17 = 0 then ({_DUCK_XOR} + 1) % 256 else {_DUCK_XOR} end), 2, '0')) as sentence
from (select receiver, event_id, event_id * 2 as seq, {_BODY0} as body from (select {', '.join(_PARTS)} from events) union all select receiver, event_id, event_id * 2 + 1, {_BODY1} from (select {', '.join(_PARTS)} from events))"""


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_PARTS)
    both = parts.selectExpr("receiver", "event_id", f"stack(2, event_id * 2, {_BODY0}, event_id * 2 + 1, {_BODY1}) as (seq, body)")
    code = nmea.checksum(F.col("body"))
    code = F.when(F.col("event_id") % 17 == 0, (code + 1) % 256).otherwise(code)
    return both.select("receiver", "seq", "body", F.concat(F.lit("$"), "body", F.lit("*"), F.lpad(F.hex(code), 2, "0")).alias("sentence"))


_P_SQL = f"""select *, case when valid then case when f[1] = 'PTNL' and f[2] = 'GGK' then 'GGK' when length(f[1]) >= 5 and substr(f[1], 3) in ('GGA', 'RMC') then substr(f[1], 3) end end as kind
from (select receiver, seq, body, sentence, string_split(body, ',') as f, {_DUCK_XOR} = cast('0x' || right(sentence, 2) as integer) as valid from ({_SENTENCES_SQL}))"""


def _c(v: str, s: str, n: int) -> str:
    m = f"try_cast(substr({v}, {n + 1}) as double)"
    return f"case when {s} in ('N', 'S', 'E', 'W') and length({v}) >= {n + 2} and {m} >= 0 and {m} < 60 then (case when {s} in ('S', 'W') then -1e0 else 1e0 end) * (try_cast(substr({v}, 1, {n}) as double) + {m} / 60) end"


_F_SQL = f"""select *, coalesce(kind = 'GGA' and g_lat is not null and g_lon is not null and f[2] <> '', false) as gga_ok,
  coalesce(kind = 'RMC' and f[3] = 'A', false) as rmc_ok, coalesce(kind = 'GGK', false) as ggk_ok
from (select *, {_c('f[3]', 'f[4]', 2)} as g_lat, {_c('f[5]', 'f[6]', 3)} as g_lon, try_cast(f[7] as integer) as g_fix, coalesce(try_cast(f[8] as integer), 0) as g_sats, try_cast(f[10] as double) as g_alt,
  try_cast(f[8] as double) * 0.514444e0 as r_speed, try_cast(f[9] as double) as r_course, {_c('f[5]', 'f[6]', 2)} as k_lat, {_c('f[7]', 'f[8]', 3)} as k_lon,
  case f[9] when '3' then 4 when '2' then 5 else try_cast(f[9] as integer) end as k_fix, try_cast(replace(f[12], 'EHT', '') as double) as k_alt
from ({_P_SQL}) where kind is not null)"""


@query("str_01_06_checksum", f"select receiver, seq, valid, kind, cast(len(f) as integer) as n_fields from ({_P_SQL})")
def checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nmea.parsed(sentences(spark, sf_dir)).select("receiver", "seq", "valid", "kind", F.size("f").alias("n_fields"))


@query(
    "str_02_05_fields",
    f"select receiver, seq, kind, gga_ok, rmc_ok, ggk_ok, case kind when 'GGA' then round(g_lat, 9) when 'GGK' then round(k_lat, 9) end as lat, case kind when 'GGA' then round(g_lon, 9) when 'GGK' then round(k_lon, 9) end as lon, case kind when 'GGA' then g_fix when 'GGK' then k_fix end as fix, case kind when 'GGA' then g_alt when 'GGK' then k_alt end as alt, case kind when 'RMC' then round(r_speed, 9) end as speed from ({_F_SQL})",
)
def typed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda a, k, n=None: F.when(F.col("kind") == "GGA", F.round(a, n) if n else F.col(a)).when(F.col("kind") == "GGK", F.round(k, n) if n else F.col(k))
    rows = nmea.fields(nmea.parsed(sentences(spark, sf_dir))).where("kind is not null")
    return rows.select("receiver", "seq", "kind", "gga_ok", "rmc_ok", "ggk_ok", pick("g_lat", "k_lat", 9).alias("lat"), pick("g_lon", "k_lon", 9).alias("lon"), pick("g_fix", "k_fix").alias("fix"), pick("g_alt", "k_alt").alias("alt"), F.when(F.col("kind") == "RMC", F.round("r_speed", 9)).alias("speed"))


_PICK = lambda g, k: f"last_value(case when paired then gg.{g} when ggk_ok then {k} end ignore nulls) over now"


@query(
    "stm_01_epochs",
    f"""select receiver, seq, kind, utc, round(lat, 9) as lat, round(lon, 9) as lon, alt, alt_datum, coalesce(fix, 0) as fix, round(ground_speed, 9) as ground_speed, course, paired from (
select *, {_PICK('g_lat', 'k_lat')} as lat, {_PICK('g_lon', 'k_lon')} as lon, {_PICK('g_alt', 'k_alt')} as alt, {_PICK('g_fix', 'k_fix')} as fix,
  last_value(case when paired then 'EGM96' when ggk_ok and k_alt is not null then 'WGS84_ELLIPSOIDAL' end ignore nulls) over now as alt_datum,
  coalesce(last_value(case when rmc_ok then r_speed end ignore nulls) over now, 0e0) as ground_speed, coalesce(last_value(case when rmc_ok then r_course end ignore nulls) over now, 0e0) as course,
  last_value(case when rmc_ok and f[2] <> '' then f[2] end ignore nulls) over now as utc
from (select *, coalesce(rmc_ok and gg.ok and gg.s > coalesce(taken, -1) and f[2] <> '' and gg.utc = f[2], false) as paired from (
  select *, last_value(case when kind = 'GGA' then struct_pack(s := seq, ok := gga_ok, utc := f[2], g_lat := g_lat, g_lon := g_lon, g_alt := g_alt, g_fix := g_fix) end ignore nulls) over now as gg,
    max(case when rmc_ok or kind = 'GGK' then seq end) over (partition by receiver order by seq rows between unbounded preceding and 1 preceding) as taken
  from ({_F_SQL}) window now as (partition by receiver order by seq rows between unbounded preceding and current row)))
window now as (partition by receiver order by seq rows between unbounded preceding and current row)) where rmc_ok or ggk_ok""",
)
def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nmea.epochs(sentences(spark, sf_dir).select("receiver", "seq", "sentence"))
    return found.select("receiver", "seq", "kind", "utc", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "alt", "alt_datum", "fix", F.round("ground_speed", 9).alias("ground_speed"), "course", "paired")


# ---------------------------------------------------------------- texts


@query(
    "str_07_10_texts",
    "select event_id, regexp_matches(concat(event_type, case when event_id % 3 = 0 then '-x' else '_1' end), '^[A-Za-z0-9_]+$') as identifier_ok, case lower(case event_id % 4 when 0 then 'EGM2008' when 1 then 'Egm96' when 2 then 'agl' else 'other' end) when 'egm2008' then 'EGM2008' when 'egm96' then 'EGM96' when 'agl' then 'AGL' when 'wgs84_ellipsoidal' then 'WGS84_ELLIPSOIDAL' end as datum, replace('Terrain: {year}', '{year}', cast(2000 + event_id % 30 as varchar)) as attribution, props as unfenced from events",
)
def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import text as t

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = F.concat("event_type", F.when(F.col("event_id") % 3 == 0, "-x").otherwise("_1"))
    datum = F.expr("case event_id % 4 when 0 then 'EGM2008' when 1 then 'Egm96' when 2 then 'agl' else 'other' end")
    return e.select("event_id", t.identifier_ok(name).alias("identifier_ok"), t.datum(datum).alias("datum"), t.filled(F.lit("Terrain: {year}"), {"year": (2000 + F.col("event_id") % 30).cast("string")}).alias("attribution"), t.without_fence(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).alias("unfenced"))


@query("jsn_01_parameters", "select event_id, cast(json_extract(props, '$.k') as bigint) as k, case when event_id % 10 = 0 then 'REFUSED' else 'OK' end as status from events")
def json_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import text as t

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    reply = F.when(F.col("event_id") % 10 == 0, F.concat(F.lit('{"error": "no", '), F.substring("props", F.lit(2), F.length("props")))).otherwise(F.col("props"))
    read = t.json_reply(reply, "k long")
    return e.select("event_id", read["value"]["k"].alias("k"), read["status"].alias("status"))


@query("jsn_02_snk_16_messages", "select event_id, case when event_id % 3 = 0 then 'TRIGGER' else 'TELEMETRY' end as type, value from events")
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions import text as t

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_id") % 3 == 0, "TRIGGER").otherwise("TELEMETRY")
    sent = e.select("event_id", t.message(kind, F.struct("event_id", "value")).alias("text"))
    got = F.from_json("text", "type string, payload struct<event_id: long, value: double>")
    return sent.select(got["payload"]["event_id"].alias("event_id"), got["type"].alias("type"), got["payload"]["value"].alias("value"))
