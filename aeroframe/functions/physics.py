"""Sensors, LiDAR, limits, wind and energy as SQL expressions over column names."""

from __future__ import annotations

from . import constants as k
from .geodesy import norm360
from .program import Program, num

G = num(k.GRAVITY)


def positive(*columns: str) -> str:
    """All given values are present, finite and above zero."""
    return "(" + " and ".join(f"coalesce({x} > 0e0 and {x} < 1e300, false)" for x in columns) + ")"


# ---------------------------------------------------------------- cameras


def camera(focal: str = "focal_mm", width: str = "width_mm", height: str = "height_mm", px_w: str = "width_px", px_h: str = "height_px", agl: str = "agl", gsd: str = "gsd", side: str = "side_pct", end: str = "end_pct", crab: str = "crab_deg") -> Program:
    """Pitch, fields of view, ground sample distances, swaths, crab-effective swath, required height, spacing, interval, status."""
    ok = f"{positive(focal, width, height, px_w, px_h, gsd)} and {side} >= 0e0 and {side} < 100e0 and {end} >= 0e0 and {end} < 100e0"
    return Program(
        {
            "pixel_pitch_mm": f"{width} / nullif({px_w}, 0)",
            "fov_h_rad": f"2e0 * atan({width} / (2e0 * nullif({focal}, 0)))",
            "fov_v_rad": f"2e0 * atan({height} / (2e0 * nullif({focal}, 0)))",
            "gsd_x": f"{agl} * {width} / nullif({focal} * {px_w}, 0)",
            "gsd_y": f"{agl} * {height} / nullif({focal} * {px_h}, 0)",
            "required_agl": f"{gsd} / nullif(greatest({width} / nullif({focal} * {px_w}, 0), {height} / nullif({focal} * {px_h}, 0)), 0)",
            "plan_status": f"case when {ok} then 'OK' else 'INVALID_PARAMETER' end",
        },
        {
            "gsd_worst": "greatest(gsd_x, gsd_y)",
            "swath_w": f"2e0 * {agl} * tan(fov_h_rad / 2e0)",
            "swath_h": f"2e0 * {agl} * tan(fov_v_rad / 2e0)",
        },
        {
            "effective_swath": f"greatest(0e0, swath_w * abs(cos(radians({crab}))) - swath_h * abs(sin(radians({crab}))))",
            "line_spacing": f"swath_w * (1e0 - {side} / 100e0)",
            "photo_interval": f"swath_h * (1e0 - {end} / 100e0)",
        },
    )


def wind_spacing(side: str = "side_pct") -> Program:
    """Line spacing under crab, after ``camera`` and ``wind_triangle``: the effective swath at the correction angle."""
    swath = "greatest(0e0, swath_w * abs(cos(radians(wca_deg))) - swath_h * abs(sin(radians(wca_deg))))"
    return Program(
        {"_spread": f"case when wind_status = 'OK' then {swath} * (1e0 - {side} / 100e0) end"},
        {"wind_line_spacing": "case when _spread > 0e0 then _spread end", "spacing_status": "case when wind_status <> 'OK' then wind_status when _spread > 0e0 then 'OK' else 'NO_SWATH' end"},
    )


# ---------------------------------------------------------------- LiDAR


def lidar(prr: str = "prr", scan: str = "scan_rate", fov: str = "fov_deg", loss: str = "loss", agl: str = "agl", speed: str = "speed", density: str = "density") -> Program:
    ok = f"{positive(prr, scan, agl, speed, density)} and {fov} > 0e0 and {fov} < 180e0 and {loss} >= 0e0 and {loss} < 1e0"
    return Program(
        {"lidar_swath": f"2e0 * {agl} * tan(radians({fov}) / 2e0)", "lidar_status": f"case when {ok} then 'OK' else 'INVALID_PARAMETER' end"},
        {
            "point_density": f"{prr} * (1e0 - {loss}) / nullif({speed} * lidar_swath, 0)",
            "required_speed": f"{prr} * (1e0 - {loss}) / nullif({density} * lidar_swath, 0)",
            "across_spacing": f"lidar_swath / nullif({prr} / nullif({scan}, 0), 0)",
            "along_spacing": f"{speed} / nullif(2e0 * {scan}, 0)",
        },
    )


def lidar_plan(side: str = "side_pct", interval: str = "waypoint_interval") -> Program:
    """Spacing of lines and waypoints of a LiDAR plan, after ``lidar``."""
    return Program({"lidar_line_spacing": f"lidar_swath * (1e0 - {side} / 100e0)", "lidar_interval": f"{interval}"})


# ---------------------------------------------------------------- limits


def limits(speed: str = "speed", pitch: str = "max_pitch_deg", accel: str = "accel_g", rise: str = "rise_m", climb: str = "climb", descent: str = "descent") -> Program:
    """Steepest slope, largest vertical curvature, and the least look-ahead for a height change."""
    return Program(
        {
            "max_slope": f"tan(radians({pitch}))",
            "max_curvature": f"{accel} * {num(k.CURVATURE_GRAVITY)} / nullif({speed} * {speed}, 0)",
            "min_lookahead": f"abs({rise}) * {speed} / nullif(case when {rise} >= 0e0 then {climb} else {descent} end, 0)",
        }
    )


def obstacle_buffer(height: str) -> str:
    return f"(10e0 * {height})"


# ---------------------------------------------------------------- wind


def wind_triangle(track: str = "track", tas: str = "tas", speed: str = "wind_speed", source: str = "wind_dir") -> Program:
    """Heading, ground speed and correction angle for a wind that blows from ``source``; a status instead of an error."""
    calm = f"{speed} < {num(k.CALM_WIND)}"
    return Program(
        {"_theta": f"radians({source} - ({track}))", "_bad": f"({track} is null or {source} is null or not {positive(tas)} or not coalesce({speed} >= 0e0 and {speed} < 1e300, false))"},
        {"_ratio": f"case when _bad then null when {calm} then 0e0 else {speed} / {tas} * sin(_theta) end"},
        {"_wca": "case when abs(_ratio) <= 1e0 then asin(least(1e0, greatest(-1e0, _ratio))) end"},
        {"_gs": f"case when {calm} then {tas} else {tas} * cos(_wca) - {speed} * cos(_theta) end"},
        {"wind_status": "case when _bad then 'INVALID_PARAMETER' when _wca is null then 'CROSSWIND_TOO_STRONG' when _gs <= 1e-9 then 'NO_PROGRESS' else 'OK' end"},
        {
            "wca_deg": "case when wind_status = 'OK' then degrees(_wca) end",
            "ground_speed": "case when wind_status = 'OK' then _gs end",
            "heading": f"case when wind_status = 'OK' then {norm360(f'({track} + degrees(_wca))')} end",
        },
    )


def safe_radius(tas: str, wind: str, bank_deg: str) -> str:
    return f"(({tas} + {wind}) * ({tas} + {wind}) / ({G} * tan(radians({bank_deg}))))"


def turn_radius(speed: str, bank_deg: str) -> str:
    return f"({speed} * {speed} / ({G} * tan(radians({bank_deg}))))"


def clothoid_length(speed: str, bank_deg: str, roll_rate: str) -> str:
    return f"case when abs({roll_rate}) < 1e-9 then 0e0 else {speed} * {bank_deg} / {roll_rate} end"


# ---------------------------------------------------------------- energy


def power(mass: str = "mass", cd: str = "cd", frontal: str = "frontal", eta: str = "eta", wing_area: str = "wing_area", wingspan: str = "wingspan", oswald: str = "oswald", rotor_area: str = "rotor_area") -> Program:
    """Coefficients of P(V) = k1 V^3 + k2 / V: fixed wing if all three wing fields are there, else rotor (disc area 0.12 m^2 by default)."""
    rho, w2 = num(k.AIR_DENSITY), f"({mass} * {G}) * ({mass} * {G})"
    wing = f"({wing_area} is not null and {wingspan} is not null and {oswald} is not null)"
    return Program(
        {"fixed_wing": wing},
        {
            "k1": f"case when fixed_wing then 0.5e0 * {rho} * {wing_area} * {cd} / {eta} else 0.5e0 * {rho} * {cd} * {frontal} / {eta} end",
            "k2": f"case when fixed_wing then 2e0 * {w2} / ({rho} * pi() * {wingspan} * {wingspan} * {oswald} * {eta}) else {w2} / (2e0 * {rho} * coalesce({rotor_area}, 0.12e0) * {eta}) end",
        },
    )


def power_at(speed: str) -> str:
    return f"(k1 * {speed} * {speed} * {speed} + k2 / nullif({speed}, 0))"


def turn_power_at(speed: str, bank_deg: str) -> str:
    """Level power with the induced part times the load factor squared; null unless 0 < bank < 90."""
    return f"case when {bank_deg} > 0e0 and {bank_deg} < 90e0 then k1 * {speed} * {speed} * {speed} + k2 / nullif({speed}, 0) / (cos(radians({bank_deg})) * cos(radians({bank_deg}))) end"


def climb_power(vertical: str, mass: str = "mass", eta: str = "eta", regen: str = "regen") -> str:
    return f"case when {vertical} > 0e0 then {mass} * {G} * {vertical} / {eta} else -({mass} * {G} * abs({vertical}) * {regen}) end"


def segment_energy(distance: str, rise: str, ground_speed: str, tas: str) -> str:
    """Joules over a segment: (flight + climb power) x time; 0 without distance."""
    time = f"({distance} / nullif({ground_speed}, 0))"
    return f"case when {distance} <= 0e0 then 0e0 else ({power_at(tas)} + {climb_power(f'({rise} / nullif({time}, 0))')}) * {time} end"


def platform_status(mass: str = "mass", cd: str = "cd", frontal: str = "frontal", battery: str = "battery_wh", eta: str = "eta", regen: str = "regen", peukert: str = "peukert") -> str:
    return f"case when {positive(mass, cd, frontal, battery, eta)} and {eta} <= 1e0 and {regen} >= 0e0 and {regen} <= 1e0 and {peukert} >= 1e0 then 'OK' else 'INVALID_PARAMETER' end"
