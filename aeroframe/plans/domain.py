"""Views of the star-schema tables as survey data.

The tables hold no geography, so each view derives it from integer keys: exact
integer arithmetic first, one multiplication by a constant last. A view is a list
of expressions over one table, usable by any SQL engine.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class View:
    table: str
    columns: dict[str, str]
    where: str | None = None

    def load(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = spark.read.parquet(f"{sf_dir}/{self.table}.parquet")
        if self.where:
            df = df.where(self.where)
        return df.selectExpr(*(f"{v} as {k}" for k, v in self.columns.items()))

    @property
    def sql(self) -> str:
        return f"select {', '.join(f'{v} as {k}' for k, v in self.columns.items())} from {self.table}" + (f" where {self.where}" if self.where else "")


#: Positions of vehicles, in order of (vehicle, seq); two neighbours are up to some 15 km apart.
TELEMETRY = View(
    "events",
    {
        "vehicle": "user_id",
        "seq": "event_id",
        "lat": "47e0 + cast((event_id * 37) % 1000 as double) * 1e-4",
        "lon": "8e0 + cast((event_id * 91) % 1000 as double) * 1e-4",
        "alt": "400e0 + cast(event_id % 300 as double)",
        "fix": "case event_type when 'click' then 4 when 'view' then 5 when 'purchase' then 1 when 'signup' then 2 else 0 end",
        "speed": "5e0 + cast(event_id % 40 as double) * 5e-1",
    },
)

#: Points all over the globe within UTM's range, and some beyond it.
POINTS = View(
    "events",
    {
        "id": "event_id",
        "lat": "cast((event_id * 7919) % 172001 as double) * 1e-3 - 86e0",
        "lon": "cast((event_id * 104729) % 360000 as double) * 1e-3 - 180e0",
        "h": "cast((event_id * 13) % 9000 as double) * 1e-1",
    },
)

#: One exposure a line item: height, speed, wind, overlaps, track.
EXPOSURES = View(
    "lineitem",
    {
        "id": "l_orderkey * 8 + l_linenumber",
        "agl": "l_extendedprice / 100e0",
        "tas": "5e0 + cast(l_quantity as double)",
        "wind_speed": "abs(l_tax) * 100e0",
        "wind_dir": "cast((l_partkey * 7) % 360 as double)",
        "track": "cast((l_suppkey * 37) % 720 as double) - 180e0",
        "side_pct": "abs(l_discount) * 900e0",
        "end_pct": "60e0",
        "gsd": "2e-2 + abs(l_discount)",
        "crab_deg": "cast(l_partkey % 41 as double) - 20e0",
        "bank_deg": "cast(l_partkey % 95 as double)",
        "rise": "cast(l_suppkey % 61 as double) - 30e0",
        "distance": "l_extendedprice / 50e0",
        "sensor": "case l_linenumber % 3 when 0 then 'phantom4pro' when 1 then 'mavic3' else 'ixm100' end",
    },
)

#: Sensors derived from parts, beside the presets.
SENSORS = View(
    "part",
    {
        "sensor_id": "p_partkey",
        "focal_mm": "5e0 + cast(p_size as double)",
        "width_mm": "p_retailprice / 50e0",
        "height_mm": "p_retailprice / 75e0",
        "width_px": "4000 + cast(p_partkey % 64 as int) * 100",
        "height_px": "3000 + cast(p_partkey % 32 as int) * 100",
        "agl": "50e0 + cast(p_partkey % 500 as double)",
        "gsd": "1e-2 + cast(p_partkey % 20 as double) * 1e-2",
        "side_pct": "cast(p_partkey % 110 as double)",
        "end_pct": "cast(p_size as double)",
        "crab_deg": "cast(p_partkey % 90 as double)",
        "prr": "100000e0 + cast(p_partkey % 10 as double) * 50000e0",
        "scan_rate": "50e0 + cast(p_size as double)",
        "fov_deg": "30e0 + cast(p_partkey % 160 as double)",
        "loss": "cast(p_partkey % 12 as double) * 1e-1",
        "speed": "cast(p_size as double)",
        "density": "1e0 + cast(p_partkey % 30 as double)",
    },
)

#: One small rectangle to survey a nation.
MISSIONS = View(
    "nation",
    {
        "plan_id": "cast(n_nationkey as bigint)",
        "min_lat": "40e0 + cast(n_nationkey as double)",
        "max_lat": "40e0 + cast(n_nationkey as double) + 6e-3 + cast(n_nationkey % 4 as double) * 1e-3",
        "min_lon": "cast(n_nationkey as double) * 2e0",
        "max_lon": "cast(n_nationkey as double) * 2e0 + 8e-3 + cast(n_nationkey % 3 as double) * 1e-3",
        "azimuth": "cast((n_nationkey * 37) % 360 as double)",
        "line_spacing": "90e0 + cast(n_nationkey % 5 as double) * 10e0",
        "photo_interval": "60e0 + cast(n_nationkey % 3 as double) * 10e0",
        "agl": "120e0 + cast(n_nationkey as double)",
        "msl": "600e0 + cast(n_nationkey as double) * 10e0",
    },
)

#: Vehicles with platform parameters; every third has wings.
PLATFORMS = View(
    "supplier",
    {
        "platform_id": "s_suppkey",
        "mass": "1e0 + cast(s_suppkey % 7 as double) * 5e-1",
        "cd": "8e-1 + cast(s_suppkey % 5 as double) * 1e-1",
        "frontal": "4e-2",
        "wing_area": "case when s_suppkey % 3 = 0 then 3e-1 end",
        "wingspan": "case when s_suppkey % 3 = 0 then 1.8e0 end",
        "oswald": "case when s_suppkey % 3 = 0 then 8e-1 end",
        "rotor_area": "case when s_suppkey % 4 = 0 then 2e-1 end",
        "battery_wh": "80e0 + cast(s_suppkey % 50 as double)",
        "peukert": "1.05e0",
        "eta": "65e-2",
        "regen": "cast(s_suppkey % 5 as double) * 1e-1",
        "tas": "8e0 + cast(s_suppkey % 20 as double)",
        "bank_deg": "10e0 + cast(s_suppkey % 30 as double)",
        "roll_rate": "cast(s_suppkey % 4 as double) * 5e0",
        "wind_speed": "cast(s_suppkey % 6 as double)",
        "vertical": "cast(s_suppkey % 9 as double) - 4e0",
        "rise": "cast(s_suppkey % 21 as double) - 10e0",
        "max_pitch_deg": "12e0",
        "accel_g": "5e-1",
        "climb": "3e0",
        "descent": "2e0",
    },
)
