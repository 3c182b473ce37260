"""Geometry, parsing and covariance as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def ecef(lat: Column, lon: Column) -> Column:
    """x, y, z in km on the sphere."""
    la, lo = F.radians(lat), F.radians(lon)
    return F.struct((EARTH_KM * F.cos(la) * F.cos(lo)).alias("x"), (EARTH_KM * F.cos(la) * F.sin(lo)).alias("y"), (EARTH_KM * F.sin(la)).alias("z"))


def point_segment_km(p: Column, a: Column, b: Column) -> Column:
    """Distance of p from segment ab (ecef structs); beyond the ends, from the nearer end."""
    dot = lambda u, v: sum((u[i] * v[i] for i in (1, 2)), u[0] * v[0])
    diff = lambda u, v: [u[k] - v[k] for k in ("x", "y", "z")]
    ab, ap = diff(b, a), diff(p, a)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(dot(ap, ab), dot(ab, ab)), F.lit(0.0))))
    rest = [x - t * y for x, y in zip(ap, ab)]
    return F.sqrt(dot(rest, rest))


def signed_displacement_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """North and east displacement from 1 to 2, signed."""
    north = F.signum(lat2 - lat1) * haversine_km(lat1, lon1, lat2, lon1)
    east = F.signum(lon2 - lon1) * haversine_km(lat1, lon1, lat1, lon2)
    return F.struct(north.alias("north_km"), east.alias("east_km"))


def l1(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.abs(a - c) + F.abs(b - d)


def sq_l2(a: Column, b: Column, c: Column, d: Column) -> Column:
    return (a - c) * (a - c) + (b - d) * (b - d)


def euclid(a: Column, b: Column, c: Column, d: Column) -> Column:
    return F.sqrt(sq_l2(a, b, c, d))


def hours_between(a: Column, b: Column) -> Column:
    """Whole hours from b to a, rounded down."""
    return F.floor((F.unix_timestamp(a) - F.unix_timestamp(b)) / 3600).cast("long")


def decimal_comma(text: Column) -> Column:
    """A number written with a decimal comma; empty or other text is null."""
    return F.trim(F.regexp_replace(text, ",", ".")).try_cast("double")


def coord_pair(text: Column) -> Column:
    """(a, b) from text like "(a, b)"."""
    found = F.regexp_extract_all(text, F.lit(r"(-?[0-9]+(?:\.[0-9]+)?)"), F.lit(1))
    return F.struct(F.get(found, 0).try_cast("double").alias("a"), F.get(found, 1).try_cast("double").alias("b"))


def correlation(kind: str, h: Column, reach: float) -> Column:
    """Gaussian, exponential or spherical correlation at distance h."""
    u = h / F.lit(float(reach))
    if kind == "gaussian":
        return F.exp(-3 * u * u)
    if kind == "exponential":
        return F.exp(-3 * u)
    if kind == "spherical":
        return F.when(u <= 1, 1 - 1.5 * u + 0.5 * u * u * u).otherwise(F.lit(0.0))
    raise ValueError(f"unknown correlation {kind}")


#: The alphabet of geohashes: a fixed value.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def geohash(lat: Column, lon: Column, chars: int = 12) -> Column:
    """Halvings of the globe, longitude first, five bits a character."""
    n = chars * 5
    x = F.least(F.floor((lon + 180) / 360 * 2 ** ((n + 1) // 2)), F.lit(2 ** ((n + 1) // 2) - 1))
    y = F.least(F.floor((lat + 90) / 180 * 2 ** (n // 2)), F.lit(2 ** (n // 2) - 1))
    out = []
    for c in range(chars):
        value = F.lit(0).cast("long")
        for p in range(5 * c, 5 * c + 5):  # bit p, from the left
            side, left = (y, n // 2 - 1 - p // 2) if p % 2 else (x, (n + 1) // 2 - 1 - p // 2)
            value = value * 2 + F.shiftright(side, left) % 2
        out.append(F.substr(F.lit(BASE32), (value + 1).cast("int"), F.lit(1)))
    return F.concat(*out)


def geohash_features(hashed: Column, drop: int = 2) -> Column:
    """The hash without its first characters, each as its place in the alphabet over 31."""
    return F.transform(F.split(F.substr(hashed, F.lit(drop + 1)), ""), lambda c: (F.instr(F.lit(BASE32), c) - 1) / 31)


def meters_to_degrees(meters: Column, lat: Column) -> Column:
    """Degrees of latitude and of longitude that so many metres are, at a latitude."""
    north = meters / (EARTH_KM * 1000) * 180 / math.pi
    return F.struct(north.alias("lat"), (north / F.cos(F.radians(lat))).alias("lon"))
