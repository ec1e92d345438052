"""Fixed values of the domain."""

from __future__ import annotations

# WGS84 (a and 1/f are exact by definition), UTM, physics.
WGS84_A = 6378137.0
WGS84_INV_F = 298.257223563
WGS84_F = 1 / WGS84_INV_F
WGS84_B = WGS84_A * (1 - WGS84_F)
WGS84_E2 = WGS84_F * (2 - WGS84_F)
WGS84_EP2 = WGS84_E2 / (1 - WGS84_E2)
WGS84_N = WGS84_F / (2 - WGS84_F)
UTM_K0 = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING = 10000000.0
UTM_MAX_LAT = 84.0
GRAVITY = 9.80665
CURVATURE_GRAVITY = 9.81
KNOT = 0.514444
AIR_DENSITY = 1.225
CALM_WIND = 1e-6
RESERVE = 0.8
DEM_VOID = -32767.0

# Vertical datums, as text.
DATUMS = ("EGM2008", "EGM96", "WGS84_ELLIPSOIDAL", "AGL")

# Camera presets (focal length, sensor width and height in mm, pixels).
SENSOR_PRESETS = {
    "phantom4pro": (8.8, 13.2, 8.8, 5472, 3648),
    "mavic3": (12.29, 17.3, 13.0, 5280, 3956),
    "ixm100": (50.0, 53.4, 40.0, 11664, 8750),
}

# Platform limits (speed, pitch deg, vertical g, pitch rate, climb, descent).
PLATFORM_LIMITS = {"fixed_wing": (30.0, 12.0, 0.5, 3.0, 3.0, 2.0), "multirotor": (8.0, 25.0, 0.8, 5.0, 5.0, 3.0)}

# Platform (mass kg, drag, frontal area, rotor disc area, propeller m, battery Wh, Peukert, efficiency, regeneration).
PLATFORM_PRESET = {"mass": 1.4, "cd": 1.0, "frontal": 0.04, "rotor_area": 0.12, "prop_d": 0.24, "battery_wh": 89.2, "peukert": 1.05, "eta": 0.65, "regen": 0.0}

# Krueger series in the third flattening n (Karney 2011), coefficient of n^j first at j = row.
KRUEGER_ALPHA = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (49561 / 161280, -179 / 168, 6601661 / 7257600),
    (34729 / 80640, -3418889 / 1995840),
    (212378941 / 319334400,),
)
KRUEGER_BETA = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (4397 / 161280, -11 / 504, -830251 / 7257600),
    (4583 / 161280, -108847 / 3991680),
    (20648693 / 638668800,),
)


def krueger(table: tuple) -> list[float]:
    """Values of a series table at the WGS84 third flattening."""
    return [sum(k * WGS84_N ** (row + 1 + i) for i, k in enumerate(ks)) for row, ks in enumerate(table)]


RECTIFYING_RADIUS = WGS84_A / (1 + WGS84_N) * (1 + WGS84_N**2 / 4 + WGS84_N**4 / 64 + WGS84_N**6 / 256)
