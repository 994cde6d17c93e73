"""Map projections as Columns: transverse Mercator by Krueger's series, and spherical web Mercator."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from terralith.errors import CrsError
from terralith.functions.num import total

AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
N = FLATTENING / (2 - FLATTENING)
RECTIFYING = AXIS / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ECCENTRICITY = math.sqrt(FLATTENING * (2 - FLATTENING))
#: Series of the transverse Mercator projection in the third flattening, forward and back: fixed values.
FORWARD = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440,
    61 * N**3 / 240 - 103 * N**4 / 140,
    49561 * N**4 / 161280,
)
BACK = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440,
    17 * N**3 / 480 - 37 * N**4 / 840,
    4397 * N**4 / 161280,
)
LATITUDE = (
    2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45,
    7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45,
    56 * N**3 / 15 - 136 * N**4 / 35,
    4279 * N**4 / 630,
)


@dataclass(frozen=True)
class Crs:
    """A coordinate system: its kind (tm, merc or lonlat) and, of tm, the parameters; z_scale is metres a unit of height."""

    kind: str
    lon0: float = 0.0
    k0: float = 1.0
    x0: float = 0.0
    y0: float = 0.0
    z_scale: float = 1.0

    @property
    def projected(self) -> bool:
        return self.kind != "lonlat"

    def text(self) -> str:
        """In proj4 terms, which parse_crs reads."""
        end = "+datum=WGS84 +no_defs" + (" +vunits=ft" if self.z_scale != 1 else "")
        if self.kind == "lonlat":
            return f"+proj=longlat {end}"
        if self.kind == "merc":
            return f"+proj=merc +a={AXIS} +b={AXIS} {end}"
        return f"+proj=tmerc +lat_0=0 +lon_0={self.lon0!r} +k={self.k0!r} +x_0={self.x0!r} +y_0={self.y0!r} {end}"

    def epsg(self) -> int | None:
        """The code of a UTM zone or of web Mercator."""
        if self.kind == "tm" and (self.k0, self.x0) == (0.9996, 500_000.0) and self.lon0 % 6 == 3 and self.y0 in (0.0, 1e7):
            return (32600 if self.y0 == 0 else 32700) + int((self.lon0 + 183) // 6)
        return {"merc": 3857, "lonlat": 4326}.get(self.kind)


def parse_crs(text: str) -> Crs:
    """From EPSG:4326, 4979, 326zz, 327zz or 3857, or proj4 tmerc, utm, longlat or merc."""
    if m := re.fullmatch(r"(?i)epsg:(\d+)", text.strip()):
        code = int(m[1])
        if code in (4326, 4979):
            return Crs("lonlat")
        if code == 3857:
            return Crs("merc")
        if code // 100 in (326, 327) and 1 <= code % 100 <= 60:
            return utm(code % 100, code // 100 == 326)
        raise CrsError(f"Unknown CRS: {text}")
    args = {k: v for k, _, v in (a.lstrip("+").partition("=") for a in text.split())}
    scale = 0.3048 if args.get("vunits") == "us-ft" or args.get("vunits") == "ft" else 1.0
    match args.get("proj"):
        case "tmerc":
            k0 = float(args.get("k", args.get("k_0", 1)))
            y0 = float(args.get("y_0", 0)) - k0 * meridian(float(args.get("lat_0", 0)))
            return Crs("tm", float(args.get("lon_0", 0)), k0, float(args.get("x_0", 0)), y0, scale)
        case "utm":
            return utm(int(args["zone"]), "south" not in args)
        case "longlat" | "latlong":
            return Crs("lonlat", z_scale=scale)
        case "merc":
            return Crs("merc", z_scale=scale)
    raise CrsError(f"Unknown CRS: {text}")


def meridian(lat: float) -> float:
    """Metres along a meridian from the equator to a latitude."""
    s = math.sin(math.radians(lat))
    chi = math.atan(math.sinh(math.atanh(s) - ECCENTRICITY * math.atanh(ECCENTRICITY * s))) if abs(s) < 1 else math.copysign(math.pi / 2, s)
    return RECTIFYING * (chi + sum(a * math.sin(2 * (m + 1) * chi) for m, a in enumerate(FORWARD)))


def utm_of(lat: float, lon: float) -> Crs:
    """The zone that holds a place."""
    return utm(int((lon + 180) // 6) % 60 + 1, lat >= 0)


def world_of(crs: Crs, lon: Column, lat: Column, alt: Column) -> list[Column]:
    """x, y and z of a place; heights are above the ellipsoid, in the system's units."""
    x, y = forward(crs, lon, lat)
    return [x, y, alt / crs.z_scale]


def _krueger(lon: Column, lat: Column, lon0: Column) -> tuple[Column, Column, Column, Column]:
    """Tangent of the conformal latitude, longitude from the meridian, and the sphere's transverse coordinates."""
    lam, s = F.radians(lon - lon0), F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - ECCENTRICITY * F.atanh(ECCENTRICITY * s))
    return t, lam, F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))


def north(crs: Crs, lon: Column, lat: Column, lon0: Column | None = None) -> list[Column]:
    """The direction in which latitude grows at a place: the derivative of the projection, of no set length."""
    if crs.kind == "merc":
        return [F.lit(0.0), F.lit(1.0), F.lit(0.0)]
    if crs.kind != "tm":
        raise CrsError("A projected system is needed")
    t, lam, xi, eta = _krueger(lon, lat, lon0 if lon0 is not None else F.lit(crs.lon0))
    square = t * t + F.cos(lam) * F.cos(lam)
    a, b = F.cos(lam) / square, -t * F.sin(lam) / (square * F.sqrt(1 + t * t))
    p = 1 + total(2 * (m + 1) * c * F.cos(2 * (m + 1) * xi) * F.cosh(2 * (m + 1) * eta) for m, c in enumerate(FORWARD))
    q = total(2 * (m + 1) * c * F.sin(2 * (m + 1) * xi) * F.sinh(2 * (m + 1) * eta) for m, c in enumerate(FORWARD))
    return [b * p - a * q, a * p + b * q, F.lit(0.0)]


def projected(text: str) -> Crs:
    """A system of world coordinates."""
    crs = parse_crs(text)
    if not crs.projected:
        raise CrsError(f"A projected system is needed: {text}")
    return crs


def geographic(text: str) -> Crs:
    """A system of latitudes and longitudes."""
    crs = parse_crs(text)
    if crs.projected:
        raise CrsError(f"A geographic system is needed: {text}")
    return crs


def utm(zone: int, north: bool) -> Crs:
    return Crs("tm", 6.0 * zone - 183, 0.9996, 500_000.0, 0.0 if north else 10_000_000.0)


def utm_code(lat: Column, lon: Column) -> Column:
    """EPSG number of the zone that holds a place, without the exceptions of the far north."""
    zone = F.pmod(F.floor((lon + 180) / 6), F.lit(60)) + 1
    return (F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + zone).cast("int")


def forward(crs: Crs, lon: Column, lat: Column, lon0: Column | None = None, y0: Column | None = None) -> tuple[Column, Column]:
    """Longitude and latitude in degrees to x and y; lon0 and y0 may differ by row."""
    if crs.kind == "lonlat":
        return lon, lat
    phi = F.radians(lat)
    if crs.kind == "merc":
        return F.radians(lon) * AXIS, F.log(F.tan(F.lit(math.pi / 4) + phi / 2)) * AXIS
    _, _, xi, eta = _krueger(lon, lat, lon0 if lon0 is not None else F.lit(crs.lon0))
    x = eta + total(a * F.cos(2 * (m + 1) * xi) * F.sinh(2 * (m + 1) * eta) for m, a in enumerate(FORWARD))
    y = xi + total(a * F.sin(2 * (m + 1) * xi) * F.cosh(2 * (m + 1) * eta) for m, a in enumerate(FORWARD))
    return crs.x0 + crs.k0 * RECTIFYING * x, (y0 if y0 is not None else F.lit(crs.y0)) + crs.k0 * RECTIFYING * y


def back(crs: Crs, x: Column, y: Column, lon0: Column | None = None, y0: Column | None = None) -> tuple[Column, Column]:
    """x and y to longitude and latitude in degrees."""
    if crs.kind == "lonlat":
        return x, y
    if crs.kind == "merc":
        return F.degrees(x / AXIS), F.degrees(2 * F.atan(F.exp(y / AXIS)) - math.pi / 2)
    xi = (y - (y0 if y0 is not None else F.lit(crs.y0))) / (crs.k0 * RECTIFYING)
    eta = (x - crs.x0) / (crs.k0 * RECTIFYING)
    xi1 = xi - total(b * F.sin(2 * (m + 1) * xi) * F.cosh(2 * (m + 1) * eta) for m, b in enumerate(BACK))
    eta1 = eta - total(b * F.cos(2 * (m + 1) * xi) * F.sinh(2 * (m + 1) * eta) for m, b in enumerate(BACK))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi + total(d * F.sin(2 * (m + 1) * chi) for m, d in enumerate(LATITUDE))
    lon = F.atan2(F.sinh(eta1), F.cos(xi1))
    return (lon0 if lon0 is not None else F.lit(crs.lon0)) + F.degrees(lon), F.degrees(lat)
