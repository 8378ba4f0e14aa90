"""Coordinate systems on other ellipsoids: conformal conic projection and seven-parameter datum shift.

A system is geographic or a Lambert conformal conic on its own ellipsoid. What is constant in its formulas is
worked out here once and reaches the rows as a struct of literals picked by code, so a column may mix systems and
the formulas appear once in a plan, however many systems there are. All steps are column expressions on arrays
of points. Positions have no height: a shift starts at height 0 and drops the height it arrives at.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import atanh, cos, exp, log, pi, radians, sin, sqrt, tan

from pyspark.sql import Column
from pyspark.sql import functions as F

from landrecon.functions.columns import let

RAD = pi / 180


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    inverse_f: float

    @property
    def e2(self) -> float:
        f = 1 / self.inverse_f
        return f * (2 - f)


@dataclass(frozen=True)
class Shift:
    """Position-vector shift to WGS 84: metres, arc seconds, parts per million."""
    x: float = 0.0
    y: float = 0.0
    z: float = 0.0
    rx: float = 0.0
    ry: float = 0.0
    rz: float = 0.0
    ppm: float = 0.0


@dataclass(frozen=True)
class Conic:
    """Lambert conformal conic in degrees and units of ``unit`` metres.

    One parallel (``lat0``) with a scale, or two parallels ``lat1`` and ``lat2`` of scale 1.
    """
    lat0: float
    lon0: float
    easting: float
    northing: float
    scale: float = 1.0
    lat1: float | None = None
    lat2: float | None = None
    unit: float = 1.0


@dataclass(frozen=True)
class System:
    ellipsoid: Ellipsoid
    shift: Shift = Shift()
    conic: Conic | None = None


# Ellipsoids, shifts and projections of the EPSG register.
WGS84 = Ellipsoid(6378137.0, 298.257223563)
GRS80 = Ellipsoid(6378137.0, 298.257222101)
EVEREST_1937 = Ellipsoid(6377276.345, 300.8017)
EVEREST_1962 = Ellipsoid(6377301.243, 300.8017255)
EVEREST_1975 = Ellipsoid(6377299.151, 300.8017255)
KALIANPUR_1937 = Shift(282, 726, 254)
KALIANPUR_1962 = Shift(283, 682, 231)
KALIANPUR_1975 = Shift(295, 736, 257)
ZONE_I = Conic(32.5, 68, 2743195.5, 914398.5, 0.99878641)
ZONE_IIA = Conic(26, 74, 2743195.5, 914398.5, 0.99878641)
ZONE_IIB = Conic(26, 90, 2743195.5, 914398.5, 0.99878641)
ZONE_IIIA = Conic(19, 80, 2743195.5, 914398.5, 0.99878641)
ZONE_IVA = Conic(12, 80, 2743195.5, 914398.5, 0.99878641)
SYSTEMS = {
    4144: System(EVEREST_1937, KALIANPUR_1937),
    4145: System(EVEREST_1962, KALIANPUR_1962),
    4146: System(EVEREST_1975, KALIANPUR_1975),
    24378: System(EVEREST_1975, KALIANPUR_1975, ZONE_I),
    24379: System(EVEREST_1975, KALIANPUR_1975, ZONE_IIA),
    24380: System(EVEREST_1975, KALIANPUR_1975, ZONE_IIB),
    24381: System(EVEREST_1975, KALIANPUR_1975, ZONE_IIIA),
    24383: System(EVEREST_1975, KALIANPUR_1975, ZONE_IVA),
    7755: System(WGS84, conic=Conic(24, 80, 4000000, 4000000, lat1=12.472955, lat2=35.1728044444444)),
    2154: System(GRS80, conic=Conic(46.5, 3, 700000, 6600000, lat1=49, lat2=44)),
    3034: System(GRS80, conic=Conic(52, 10, 4000000, 2800000, lat1=35, lat2=65)),
}
_ARC = radians(1 / 3600)


def constants(system: System) -> dict[str, float | bool]:
    """Every number the formulas of a system need."""
    e2, a = system.ellipsoid.e2, system.ellipsoid.a
    out = {"a": a, "e2": e2, "conic": system.conic is not None, "n": 1.0, "r": 1.0, "r0": 0.0, "lon0": 0.0,
           "easting": 0.0, "northing": 0.0, "unit": 1.0}
    s = system.shift
    out |= {"tx": s.x, "ty": s.y, "tz": s.z, "rx": s.rx * _ARC, "ry": s.ry * _ARC, "rz": s.rz * _ARC, "m": 1 + s.ppm * 1e-6,
            "same": s == Shift() and abs(a - WGS84.a) < 1e-6 and abs(e2 - WGS84.e2) < 1e-10}
    if system.conic:
        c, e = system.conic, sqrt(e2)

        def isometric(lat: float) -> float:  # grows to infinity at the pole
            return atanh(sin(radians(lat))) - e * atanh(e * sin(radians(lat)))

        def width(lat: float) -> float:
            return cos(radians(lat)) / sqrt(1 - e2 * sin(radians(lat)) ** 2)

        if c.lat1 is None:
            n, k, at = sin(radians(c.lat0)), c.scale, c.lat0
        else:
            n, k, at = sin(radians(c.lat1)), 1.0, c.lat1
            if c.lat2 != c.lat1:
                n = log(width(c.lat1) / width(c.lat2)) / (isometric(c.lat2) - isometric(c.lat1))
        # Radius of the parallel of isometric latitude q: r * exp(-n * q).
        r = a * k * width(at) / n * exp(n * isometric(at))
        out |= {"n": n, "r": r, "r0": r * exp(-n * isometric(c.lat0)), "lon0": float(c.lon0),
                "easting": c.easting * c.unit, "northing": c.northing * c.unit, "unit": c.unit}
    return out


def _row(system: System) -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in constants(system).items()])


def definition(code: Column, systems: dict[int, System] | None = None) -> Column:
    """Constants of the system of a code, null for others."""
    pairs = [c for k, s in (systems or SYSTEMS).items() for c in (F.lit(k), _row(s))]
    return F.element_at(F.create_map(*pairs), code)


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _xyz(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def project(pts: Column, d: Column) -> Column:
    """Longitude and latitude on the system's own ellipsoid to its plane; ``d`` from ``definition``."""
    e = F.sqrt(d["e2"])

    def polar(p: Column) -> Column:
        s, turn = F.sin(p["y"] * RAD), p["x"] - d["lon0"]
        turn = turn - 360 * F.floor((turn + 180) / 360)  # the short way round
        return F.struct((d["r"] * F.exp(-d["n"] * (F.atanh(s) - e * F.atanh(e * s)))).alias("r"),
                        (d["n"] * turn * RAD).alias("t"))

    def plane(p: Column) -> Column:
        return _xy((d["easting"] + p["r"] * F.sin(p["t"])) / d["unit"],
                   (d["northing"] + d["r0"] - p["r"] * F.cos(p["t"])) / d["unit"])

    return F.transform(F.transform(pts, polar), plane)


def unproject(pts: Column, d: Column, steps: int = 6) -> Column:
    """Plane to longitude and latitude on the system's own ellipsoid."""
    e = F.sqrt(d["e2"])

    def polar(p: Column) -> Column:
        side = F.signum(d["n"])
        x = p["x"] * d["unit"] - d["easting"]
        y = d["r0"] - (p["y"] * d["unit"] - d["northing"])
        # The logarithm is null at the pole, where any large value will do.
        q = F.coalesce(-F.log(F.sqrt(x * x + y * y) / F.abs(d["r"])) / d["n"], side * 1000)
        return F.struct(q.alias("q"),
                        (d["lon0"] + F.atan2(side * x, side * y) / d["n"] / RAD).alias("x"))

    def start(p: Column) -> Column:
        return F.struct(p["q"].alias("q"), p["x"].alias("x"), F.tanh(p["q"]).alias("s"))

    def step(p: Column) -> Column:
        return F.struct(p["q"].alias("q"), p["x"].alias("x"), F.tanh(p["q"] + e * F.atanh(e * p["s"])).alias("s"))

    out = F.transform(F.transform(pts, polar), start)
    for _ in range(steps):  # the error shrinks by e squared, below 1/140, each time
        out = F.transform(out, step)
    return F.transform(out, lambda p: _xy(p["x"], F.asin(p["s"]) / RAD))


def geocentric(pts: Column, a: Column, e2: Column) -> Column:
    """Longitude and latitude at height 0 to metres from the centre."""
    def to(p: Column) -> Column:
        s, c = F.sin(p["y"] * RAD), F.cos(p["y"] * RAD)
        return F.struct((a / F.sqrt(1 - e2 * s * s)).alias("v"), s.alias("s"), c.alias("c"), (p["x"] * RAD).alias("l"))

    return F.transform(F.transform(pts, to), lambda p: _xyz(
        p["v"] * p["c"] * F.cos(p["l"]), p["v"] * p["c"] * F.sin(p["l"]), p["v"] * (1 - e2) * p["s"]))


def geodetic(pts: Column, a: Column, e2: Column) -> Column:
    """Metres from the centre to longitude and latitude; two rounds from the reduced latitude."""
    axes = F.sqrt(1 - e2)

    def start(p: Column) -> Column:
        w = F.sqrt(p["x"] * p["x"] + p["y"] * p["y"])
        return F.struct(w.alias("w"), p["z"].alias("z"), F.atan2(p["y"], p["x"]).alias("l"),
                        F.atan2(p["z"], w * axes).alias("u"))

    def latitude(p: Column) -> Column:
        return F.atan2(p["z"] + e2 / axes * a * F.pow(F.sin(p["u"]), F.lit(3)), p["w"] - e2 * a * F.pow(F.cos(p["u"]), F.lit(3)))

    def again(p: Column) -> Column:
        lat = latitude(p)
        return F.struct(p["w"].alias("w"), p["z"].alias("z"), p["l"].alias("l"),
                        F.atan2(axes * F.sin(lat), F.cos(lat)).alias("u"))

    out = F.transform(F.transform(pts, start), again)
    return F.transform(out, lambda p: _xy(p["l"] / RAD, latitude(p) / RAD))


def shifted(pts: Column, d: Column) -> Column:
    """Geocentric position in the system's datum to WGS 84."""
    return F.transform(pts, lambda p: _xyz(
        d["tx"] + d["m"] * (p["x"] - d["rz"] * p["y"] + d["ry"] * p["z"]),
        d["ty"] + d["m"] * (d["rz"] * p["x"] + p["y"] - d["rx"] * p["z"]),
        d["tz"] + d["m"] * (-d["ry"] * p["x"] + d["rx"] * p["y"] + p["z"])))


def unshifted(pts: Column, d: Column) -> Column:
    """Geocentric position in WGS 84 to the system's datum: the exact inverse of ``shifted``."""
    # The matrix is one plus a skew one, R = 1 + [w]; its inverse is (1 + w wT - [w]) / (1 + w.w).
    rx, ry, rz = d["rx"], d["ry"], d["rz"]

    def off(p: Column) -> Column:
        return _xyz((p["x"] - d["tx"]) / d["m"], (p["y"] - d["ty"]) / d["m"], (p["z"] - d["tz"]) / d["m"])

    def back(p: Column) -> Column:
        along = rx * p["x"] + ry * p["y"] + rz * p["z"]
        size = 1 + rx * rx + ry * ry + rz * rz
        return _xyz((p["x"] + rx * along + rz * p["y"] - ry * p["z"]) / size,
                    (p["y"] + ry * along - rz * p["x"] + rx * p["z"]) / size,
                    (p["z"] + rz * along + ry * p["x"] - rx * p["y"]) / size)

    return F.transform(F.transform(pts, off), back)


def to_wgs84(pts: Column, code: Column, systems: dict[int, System] | None = None) -> Column:
    """Points of the system of ``code`` as WGS 84 longitude and latitude; null for a code it does not know."""
    def moved(d: Column) -> Column:
        own = F.when(d["conic"], unproject(pts, d)).otherwise(pts)
        far = geodetic(shifted(geocentric(own, d["a"], d["e2"]), d), F.lit(WGS84.a), F.lit(WGS84.e2))
        return F.when(d.isNotNull(), F.when(d["same"], own).otherwise(far))

    return let(definition(code, systems), moved)


def from_wgs84(pts: Column, code: Column, systems: dict[int, System] | None = None) -> Column:
    """WGS 84 longitude and latitude in the system of ``code``; null for a code it does not know."""
    def moved(d: Column) -> Column:
        far = geodetic(unshifted(geocentric(pts, F.lit(WGS84.a), F.lit(WGS84.e2)), d), d["a"], d["e2"])
        own = F.when(d["same"], pts).otherwise(far)
        return F.when(d.isNotNull(), F.when(d["conic"], project(own, d)).otherwise(own))

    return let(definition(code, systems), moved)
