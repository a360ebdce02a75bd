"""Scalar functions as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Speed of light in ice and in vacuum (m/s).
U_ICE, C_AIR = 1.69e8, 3e8


def depth_of(travel_time: Column, velocity: float = U_ICE) -> Column:
    """Depth (m) of a two-way travel time in microseconds."""
    return travel_time / 2 * velocity * 1e-6


def decibel(power: Column) -> Column:
    """10 log10 of a power; null where it is not above zero."""
    return F.when(power > 0, 10 * F.log10(power))


def amplitude_decibel(v: Column) -> Column:
    return decibel(v * v)


def hhmmss_to_day(t: Column) -> Column:
    """Fraction of a day of a number that reads hhmmss.s."""
    s = F.pmod(t, F.lit(100.0))
    m = (F.pmod(t, F.lit(10000.0)) - s) / 100
    h = (t - 100 * m - s) / 10000
    return h / 24 + m / 1440 + s / 86400


def ddmm_to_degrees(x: Column, sign: Column | int = 1) -> Column:
    """Degrees of a number that reads ddmm.mm, times the hemisphere's sign."""
    m = F.pmod(x, F.lit(100.0))
    return ((x - m) / 100 + m / 60) * sign


def day_to_timestamp(day: Column, epoch_days: float = 719529.0) -> Column:
    """Timestamp of a decimal day; the default counts as MATLAB's datenum does."""
    return F.timestamp_micros(F.round((day - epoch_days) * 86400000000.0).cast("bigint"))


def gga(line: Column) -> dict[str, Column]:
    """Fields of a ``$..GGA`` sentence: time of day, signed degrees, quality, altitude, geoid; null where unreadable."""
    part = F.split(line, ",")
    whole = line.rlike(r"^\$..GGA,")

    def number(i: int) -> Column:
        return F.when(whole, F.try_element_at(part, F.lit(i + 1)).try_cast("double"))

    def sign(i: int, negative: str) -> Column:
        return F.when(F.try_element_at(part, F.lit(i + 1)) == negative, -1).otherwise(1)

    return {
        "day": hhmmss_to_day(number(1)),
        "lat": ddmm_to_degrees(number(2), sign(3, "S")),
        "long": ddmm_to_degrees(number(4), sign(5, "W")),
        "quality": number(6).cast("int"),
        "satellites": number(7).cast("int"),
        "hdop": number(8),
        "altitude": number(9),
        "geoid": number(11),
    }


def xml_value(xml: Column, name: str) -> Column:
    """The text of ``<Val>`` that follows ``<Name>name</Name>``, whatever the case."""
    return F.regexp_extract(xml, rf"(?is)<Name>{name}</Name>\s*<Val>(.*?)</Val", 1)


def bits(x: Column, start: int, count: int) -> Column:
    """``count`` bits of an integer from bit ``start`` on, least significant first."""
    return F.shiftright(x, start).bitwiseAND((1 << count) - 1)


def packed_date(x: Column) -> Column:
    """Timestamp of a packed 32-bit date: 5 bits of half seconds, 6 minutes, 5 hours, 5 day, 4 month, 7 years since 1980."""
    return F.try_make_timestamp(
        bits(x, 25, 7) + 1980, bits(x, 21, 4), bits(x, 16, 5), bits(x, 11, 5), bits(x, 5, 6), (bits(x, 0, 5) * 2).cast("decimal(8,6)"))


def snow_permittivity(density: Column, frequency: float, wetness: float = 0.0, relaxation: float = 9.07e9) -> Column:
    """Relative permittivity of snow of a density in g/cm3 and a wetness in percent."""
    dry = 1 + 1.7 * density + 0.7 * density * density
    return dry + (0.02 * wetness**1.015 + 0.073 * wetness**1.31 / (1 + frequency / relaxation))


def firn_permittivity(density: Column, ice: float = 917.0, real: float = 3.12, imaginary: float = -9.5) -> Column:
    """Real part of a mixing formula's permittivity of firn; density in kg/m3, cubes of cube roots in polar form."""
    r, phi = math.hypot(real, imaginary) ** (1 / 3), math.atan2(-imaginary, real) / 3 * (1 if imaginary > 0 else -1)
    # z = 1 + (density / ice) * (root - 1); the real part of its cube.
    share = density / ice
    a = 1 + share * (r * math.cos(phi) - 1)
    b = share * (r * math.sin(phi))
    return a * a * a - 3 * a * b * b


def phase_to_range(phase: Column, wavelength: float, range_: Column | None = None, rate: float | None = None, speed: float | None = None) -> Column:
    """Range of a phase; with a chirp rate also corrected for the range itself."""
    if not rate or not speed or range_ is None:
        return wavelength * phase / (4 * math.pi)
    return phase / (4 * math.pi / wavelength - 4 * range_ * rate / speed**2)


def refractive_focusing(z1: Column, z2: Column, eps1: float, eps2: float) -> Column:
    """Gain of power by refraction below an interface at depth z1; 1 above it."""
    gain = (z1 + z2) / (z1 + z2 * math.sqrt(eps1 / eps2))
    return F.when(z2 <= z1, F.lit(1.0)).otherwise(gain * gain)


Permittivity = Callable[[Column], Column]


def utm_zone(long: Column) -> Column:
    return (1 + F.floor((long + 180) / 6)).cast("int")


def utm(lat: Column, long: Column, zone: Column | None = None) -> tuple[Column, Column, Column]:
    """Easting, northing (m) and zone on the WGS84 ellipsoid, by the series of Kruger to the third order."""
    # Fixed values of the WGS84 ellipsoid and the projection.
    a, f, k0, false_east, false_north = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0, 10000000.0
    n = f / (2 - f)
    rect = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    zone = utm_zone(long) if zone is None else zone
    phi, lam = F.radians(lat), F.radians(long - (zone * 6 - 183))
    e = 2 * math.sqrt(n) / (1 + n)
    sin = F.sin(phi)
    conformal = F.sinh(F.atanh(sin) - e * F.atanh(e * sin))
    xi = F.atan2(conformal, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(1 + conformal * conformal))
    east, north = eta, xi
    for j, c in enumerate(alpha, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return false_east + k0 * rect * east, F.when(lat < 0, false_north).otherwise(0.0) + k0 * rect * north, zone


def polar_stereographic(lat: Column, long: Column, true_lat: float = -71.0, centre: float = 0.0) -> tuple[Column, Column]:
    """x, y (m) of a polar stereographic projection on WGS84; the sign of ``true_lat`` names the pole."""
    a, f = 6378137.0, 1 / 298.257223563
    e = math.sqrt(2 * f - f * f)
    pole = 1 if true_lat > 0 else -1

    def t_of(phi: float) -> float:
        s = e * math.sin(phi)
        return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (e / 2)

    phi_c = math.radians(abs(true_lat))
    m_c = math.cos(phi_c) / math.sqrt(1 - (e * math.sin(phi_c)) ** 2)
    phi = F.radians(lat * pole)
    s = e * F.sin(phi)
    t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), e / 2)
    rho = a * m_c / t_of(phi_c) * t
    lam = F.radians((long - centre) * pole)
    return pole * rho * F.sin(lam), -pole * rho * F.cos(lam)


def flat_earth(lat: Column, long: Column) -> tuple[Column, Column]:
    """x, y (m) without a projection: 110 km a degree."""
    return long * 110000 * F.abs(F.cos(F.radians(lat))), lat * 110000


def common_start(values: Column) -> Column:
    """The longest prefix that all strings of an array share."""
    first = F.array_min(values)
    last = F.array_max(values)
    longest = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.length(first), F.lit(1))), F.lit(0),
        lambda n, i: F.when((n == i - 1) & (first.substr(i, F.lit(1)) == last.substr(i, F.lit(1))) & (i <= F.length(first)), i).otherwise(n))
    return first.substr(F.lit(1), longest)


def utm_inverse(x: Column, y: Column, zone: Column, north: Column | bool = True) -> tuple[Column, Column]:
    """Latitude and longitude (degrees) of UTM coordinates on WGS84, by the inverse series and Newton steps."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    n = f / (2 - f)
    rect = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    false_north = F.when(north if isinstance(north, Column) else F.lit(north), 0.0).otherwise(10000000.0)
    xi, eta = (y - false_north) / (k0 * rect), (x - 500000.0) / (k0 * rect)
    xi1, eta1 = xi, eta
    for j, c in enumerate(beta, 1):
        xi1 = xi1 - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, c in enumerate(delta, 1):
        lat = lat + c * F.sin(2 * j * chi)
    return F.degrees(lat), zone * 6 - 183 + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))


def comment_time(comment: Column) -> Column:
    """Date of a comment that reads ``...]...]m/d/y``."""
    part = [F.regexp_extract(comment, r"\][^\]]*\]\s*(\d+)/(\d+)/(\d+)", i).try_cast("int") for i in (1, 2, 3)]
    year = F.when(part[2] < 100, part[2] + 2000).otherwise(part[2])
    return F.when(part[0].between(1, 12) & part[1].between(1, 28), F.make_date(year, part[0], part[1])).otherwise(
        F.try_to_date(F.concat_ws("-", year, F.lpad(part[0].cast("string"), 2, "0"), F.lpad(part[1].cast("string"), 2, "0"))))


def surface_elevation(altitude: Column, surface_time: Column) -> Column:
    """Elevation of a surface seen from an aircraft, from its two-way time (s) in air."""
    return altitude - surface_time * C_AIR / 2
