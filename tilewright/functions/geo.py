"""Ground sampling distance, zones and coordinate transforms as Column expressions."""

from __future__ import annotations

import math
import warnings
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.errors import CRSError, GSDWarning, TilewrightError

#: Metres in a unit; a degree's is the same at any latitude.
UNITS = {"metre": 1.0, "us_survey_foot": 0.304800609601, "foot": 0.3048, "degree": 111_000.0}
#: Limits of the ground sampling distance in metres.
GSD_LIMITS = {"far_too_fine": 0.05, "too_fine": 0.1, "too_coarse": 5.0, "coarse": 1.0, "rather_coarse": 0.5}


def gsd(affine: Column, unit: Column) -> Column:
    """Metres on the ground of a pixel; null for an unknown unit."""
    size = (F.abs(affine["a"]) + F.abs(affine["e"])) / 2
    return reduce(lambda c, u: c.when(unit == u[0], size * u[1]), list(UNITS.items())[1:], F.when(unit == "metre", size * 1.0))


def gsd_level(value: Column) -> Column:
    """far_too_fine, too_fine, too_coarse, coarse, rather_coarse or good; limits themselves are good."""
    at = GSD_LIMITS
    return (
        F.when(value < at["far_too_fine"], "far_too_fine")
        .when(value < at["too_fine"], "too_fine")
        .when(value > at["too_coarse"], "too_coarse")
        .when(value > at["coarse"], "coarse")
        .when(value > at["rather_coarse"], "rather_coarse")
        .when(value.isNotNull(), "good")
    )


def check_gsd(value: float | None, strict: bool = False) -> None:
    """Warns of a distance out of range; beyond the coarsest limit ``strict`` raises."""
    at = GSD_LIMITS
    if value is None:
        return
    said = None
    if value < at["far_too_fine"]:
        said = f"{value:g} m a pixel is far finer than detectors are trained for"
    elif value < at["too_fine"]:
        said = f"{value:g} m a pixel is finer than detectors are trained for"
    elif value > at["too_coarse"]:
        said = f"{value:g} m a pixel is too coarse for most objects"
        if strict:
            raise TilewrightError(said, gsd=value)
    elif value > at["coarse"]:
        said = f"{value:g} m a pixel shows large objects only"
    elif value > at["rather_coarse"]:
        said = f"{value:g} m a pixel may hide small objects"
    if said:
        warnings.warn(said, GSDWarning, stacklevel=2)


def utm_epsg(lon: Column, lat: Column) -> Column:
    """The zone's code; a longitude of 180 is in the last zone."""
    zone = F.least(F.floor((lon + 180) / 6) + 1, F.lit(60))
    return (F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + zone).cast("int")


def parse_epsg(crs: str | int | None) -> int | None:
    """4326 of "EPSG:4326" or 4326; None stays None."""
    if crs is None:
        return None
    text = str(crs).strip().upper().removeprefix("EPSG:")
    if not text.isdigit():
        raise CRSError(f"not a coordinate system: {crs!r}", crs=crs)
    return int(text)


def unit_of(epsg: int | None) -> str | None:
    if epsg is None:
        return None
    return "degree" if epsg == 4326 else "metre" if epsg in (3857, 6933) or 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760 else None


# WGS 84 and the Krueger series to the sixth power of the third flattening (Karney, 2011)
_A, _FLAT = 6378137.0, 1 / 298.257223563
_N = _FLAT / (2 - _FLAT)
_E = math.sqrt(_FLAT * (2 - _FLAT))
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
#: Coefficients of n, n^2, ... in each term of the series.
_ALPHA = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600),
    (0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840),
    (0, 0, 0, 0, 0, 212378941 / 319334400),
)
_BETA = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600),
    (0, 0, 0, 0, 4583 / 161280, -108847 / 3991680),
    (0, 0, 0, 0, 0, 20648693 / 638668800),
)
ALPHA = [sum(c * _N ** (k + 1) for k, c in enumerate(row)) for row in _ALPHA]
BETA = [sum(c * _N ** (k + 1) for k, c in enumerate(row)) for row in _BETA]
_SCALE, _EAST, _SOUTH = 0.9996, 500_000.0, 10_000_000.0


def _middle(zone: Column) -> Column:
    return zone * 6 - 183


def to_utm(lon: Column, lat: Column, epsg: Column) -> Column:
    """struct<x, y> in the UTM zone ``epsg`` of degrees on WGS 84."""
    phi, lam = F.radians(lat), F.radians(lon - _middle(epsg % 100))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - _E * F.atanh(_E * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for k, a in enumerate(ALPHA, 1):
        north = north + a * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        east = east + a * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    y = _SCALE * _RADIUS * north + F.when(epsg >= 32700, _SOUTH).otherwise(0.0)
    return F.struct((_EAST + _SCALE * _RADIUS * east).alias("x"), y.alias("y"))


def from_utm(x: Column, y: Column, epsg: Column) -> Column:
    """struct<x, y>, longitude and latitude in degrees, of a place in the UTM zone ``epsg``."""
    xi = (y - F.when(epsg >= 32700, _SOUTH).otherwise(0.0)) / (_SCALE * _RADIUS)
    eta = (x - _EAST) / (_SCALE * _RADIUS)
    north, east = xi, eta
    for k, b in enumerate(BETA, 1):
        north = north - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        east = east - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(north) / F.cosh(east))
    lam = F.atan2(F.sinh(east), F.cos(north))
    q, e2 = F.atanh(F.sin(chi)), _E
    phi = chi
    for _ in range(5):
        phi = F.asin(F.tanh(q + e2 * F.atanh(e2 * F.sin(phi))))
    return F.struct((F.degrees(lam) + _middle(epsg % 100)).alias("x"), F.degrees(phi).alias("y"))


def to_degrees(x: Column, y: Column, epsg: int) -> Column:
    """struct<x, y> in EPSG:4326 of a place in a supported system."""
    if epsg == 4326:
        return F.struct(x.alias("x"), y.alias("y"))
    if epsg == 3857:
        return F.struct(F.degrees(x / _A).alias("x"), F.degrees(2 * F.atan(F.exp(y / _A)) - math.pi / 2).alias("y"))
    if unit_of(epsg) == "metre" and epsg != 6933:
        return from_utm(x, y, F.lit(epsg))
    raise CRSError(f"EPSG:{epsg} isn't supported", epsg=epsg)


def from_degrees(lon: Column, lat: Column, epsg: int) -> Column:
    """struct<x, y> in a supported system of a place in EPSG:4326."""
    if epsg == 4326:
        return F.struct(lon.alias("x"), lat.alias("y"))
    if epsg == 3857:
        return F.struct((F.radians(lon) * _A).alias("x"), (F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * _A).alias("y"))
    if unit_of(epsg) == "metre" and epsg != 6933:
        return to_utm(lon, lat, F.lit(epsg))
    raise CRSError(f"EPSG:{epsg} isn't supported", epsg=epsg)


def reproject_ring(ring: Column, source: int, target: int) -> Column:
    """A ring's points from one supported system to another."""
    if source == target:
        return ring

    def move(p: Column) -> Column:
        return F.get(F.transform(F.array(to_degrees(p["x"], p["y"], source)), lambda d: from_degrees(d["x"], d["y"], target)), F.lit(0))

    return F.transform(ring, move)
