"""WGS84 longitude/latitude to British National Grid metres.

Published Ordnance Survey formulae: a Helmert datum shift to OSGB36 followed by
a Transverse Mercator projection, about 5 m from a grid-shift transform. It is
one column expression of built-in functions.
"""

from __future__ import annotations

from math import radians

from pyspark.sql import Column, DataFrame, functions as F

from airzone.functions.binding import bind, named_values

# Ellipsoids (semi-axes, metres).
WGS84 = (6378137.0, 6356752.314245)
AIRY_1830 = (6377563.396, 6356256.909)

# Helmert shift WGS84 -> OSGB36 (metres, parts per million, arc seconds).
SHIFT_METRES = (-446.448, 125.157, -542.060)
SCALE_PPM = 20.4894
ROTATION_SECONDS = (-0.1502, -0.2470, -0.8421)

# National Grid origin (degrees, metres) and central scale.
ORIGIN_LATITUDE, ORIGIN_LONGITUDE = 49.0, -2.0
FALSE_EASTING, FALSE_NORTHING = 400000.0, -100000.0
CENTRAL_SCALE = 0.9996012717


def _number(value: float) -> str:
    """A double literal that may stand anywhere in an expression."""
    return f"({value!r}D)"


def _eccentricity2(axes: tuple[float, float]) -> float:
    a, b = axes
    return (a * a - b * b) / (a * a)


def _datum_shift(x: str, y: str, z: str) -> dict[str, str]:
    tx, ty, tz = map(_number, SHIFT_METRES)
    rx, ry, rz = (_number(radians(seconds / 3600)) for seconds in ROTATION_SECONDS)
    k = _number(1 + SCALE_PPM * 1e-6)
    return {"x": f"{tx} + {k}*{x} - {rz}*{y} + {ry}*{z}",
            "y": f"{ty} + {rz}*{x} + {k}*{y} - {rx}*{z}",
            "z": f"{tz} - {ry}*{x} + {rx}*{y} + {k}*{z}"}


def _meridian_arc(latitude: str) -> str:
    """Developed arc from the origin latitude."""
    a, b = AIRY_1830
    n = (a - b) / (a + b)
    weights = (1 + n + 5 / 4 * n**2 + 5 / 4 * n**3, -(3 * n + 3 * n**2 + 21 / 8 * n**3),
               15 / 8 * n**2 + 15 / 8 * n**3, -(35 / 24 * n**3))
    diff, total = (f"({latitude} {sign} {_number(radians(ORIGIN_LATITUDE))})" for sign in "-+")
    waves = [f"{_number(w)}*sin({i}*{diff})*cos({i}*{total})" for i, w in enumerate(weights) if i]
    return f"{_number(b * CENTRAL_SCALE)}*({_number(weights[0])}*{diff} + {' + '.join(waves)})"


def bng_levels(longitude: str, latitude: str) -> dict[str, dict[str, str]]:
    """Bound values whose last level, ``at``, holds easting ``x`` and northing ``y``."""
    a1, e1 = _number(WGS84[0]), _number(_eccentricity2(WGS84))
    a, b = AIRY_1830
    e2, second_e2 = _eccentricity2(AIRY_1830), (a * a - b * b) / (b * b)
    curve = f"(1 - {_number(e2)}*sin(airy.phi)*sin(airy.phi))"
    return {
        "wgs": {"phi": f"radians({latitude})", "lam": f"radians({longitude})"},
        "arc1": {"nu": f"{a1}/sqrt(1 - {e1}*sin(wgs.phi)*sin(wgs.phi))"},
        "earth": {"x": "arc1.nu*cos(wgs.phi)*cos(wgs.lam)", "y": "arc1.nu*cos(wgs.phi)*sin(wgs.lam)",
                  "z": f"arc1.nu*(1 - {e1})*sin(wgs.phi)"},
        "moved": _datum_shift("earth.x", "earth.y", "earth.z"),
        # Latitude on the target ellipsoid by Bowring's closed form.
        "polar": {"p": "sqrt(moved.x*moved.x + moved.y*moved.y)",
                  "dl": f"atan2(moved.y, moved.x) - {_number(radians(ORIGIN_LONGITUDE))}"},
        "para": {"theta": f"atan2(moved.z*{_number(a)}, polar.p*{_number(b)})"},
        "airy": {"phi": f"atan2(moved.z + {_number(second_e2 * b)}*pow(sin(para.theta), 3), "
                        f"polar.p - {_number(e2 * a)}*pow(cos(para.theta), 3))"},
        # Transverse Mercator series in the longitude difference.
        "tm": {"s": "sin(airy.phi)", "c": "cos(airy.phi)", "t2": "tan(airy.phi)*tan(airy.phi)",
               "nu": f"{_number(a * CENTRAL_SCALE)}/sqrt{curve}", "ratio": f"{curve}/{_number(1 - e2)}",
               "d2": "polar.dl*polar.dl", "arc": _meridian_arc("airy.phi")},
        "at": {
            "x": f"""{_number(FALSE_EASTING)} + tm.nu*polar.dl*(tm.c
                + tm.d2*pow(tm.c, 3)*(tm.ratio - tm.t2)/6
                + tm.d2*tm.d2*pow(tm.c, 5)*(5 - 18*tm.t2 + tm.t2*tm.t2
                    + (14 - 58*tm.t2)*(tm.ratio - 1))/120)""",
            "y": f"""{_number(FALSE_NORTHING)} + tm.arc + tm.nu*tm.s*tm.d2*(tm.c/2
                + tm.d2*pow(tm.c, 3)*(5 - tm.t2 + 9*(tm.ratio - 1))/24
                + tm.d2*tm.d2*pow(tm.c, 5)*(61 - 58*tm.t2 + tm.t2*tm.t2)/720)"""},
    }


def bng(longitude: str, latitude: str) -> Column:
    """Struct of easting ``x`` and northing ``y``; NULL coordinates stay NULL."""
    levels = bng_levels(longitude, latitude)
    position = levels.pop("at")
    return F.expr(bind(levels, named_values(position)))


def with_bng(df: DataFrame, longitude: str = "longitude", latitude: str = "latitude",
             x: str = "x_m", y: str = "y_m") -> DataFrame:
    """Add easting ``x`` and northing ``y``."""
    return (df.withColumn("_bng", bng(longitude, latitude))
            .withColumns({x: F.col("_bng.x"), y: F.col("_bng.y")}).drop("_bng"))
