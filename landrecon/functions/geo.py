"""Geometry as typed columns: parsing, measuring and projecting without leaving the JVM.

A geometry is ``struct<kind, parts array<array<array<struct<x,y>>>>>``: polygons hold their
rings, lines one point list per line, points a single list. Everything here is a plain column
expression, so it prunes, folds and runs inside the scan stage.
"""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from landrecon.functions import systems
from landrecon.functions.columns import let

POINT = "struct<x:double,y:double>"
PARTS = f"array<array<array<{POINT}>>>"
GEOMETRY = f"struct<kind:string,parts:{PARTS}>"
POLYGONAL = ("Polygon", "MultiPolygon")

# The WGS84 ellipsoid and the transverse Mercator series built on it.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_SCALE = 0.9996
UTM_EASTING = 500000.0
UTM_NORTHING = 10000000.0
EARTH_RADIUS_M = 6371000.0
WEB_MERCATOR_R = 6378137.0
_N = WGS84_F / (2 - WGS84_F)
UTM_RADIUS = WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
CONFORMAL = 2 * _N**0.5 / (1 + _N)
ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)
RAD = pi / 180


def is_polygonal(geom: Column) -> Column:
    return geom["kind"].isin(*POLYGONAL)


def points(geom: Column) -> Column:
    """All positions of a geometry as one array."""
    return F.flatten(F.flatten(geom["parts"]))


def num_vertices(geom: Column) -> Column:
    return F.coalesce(F.size(points(geom)), F.lit(0))


def json_num_vertices(geojson: Column) -> Column:
    """Positions in GeoJSON text, nested collections included; bounding boxes do not count."""
    bare = F.regexp_replace(geojson, r'"bbox"\s*:\s*\[[^\]]*\]', '"bbox":null')
    return F.coalesce(
        F.regexp_count(bare, F.lit(r"\[\s*-?[0-9][0-9.eE+-]*\s*,\s*-?[0-9]")), F.lit(0))


def point_geom(x: Column, y: Column) -> Column:
    return F.struct(F.lit("Point").alias("kind"),
                    F.array(F.array(F.array(_xy(x, y)))).alias("parts"))


def line_geom(*xy: tuple[Column, Column]) -> Column:
    return F.struct(F.lit("LineString").alias("kind"),
                    F.array(F.array(F.array(*[_xy(x, y) for x, y in xy]))).alias("parts"))


def box_geom(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    ring = F.array(_xy(x0, y0), _xy(x1, y0), _xy(x1, y1), _xy(x0, y1), _xy(x0, y0))
    return F.struct(F.lit("Polygon").alias("kind"), F.array(F.array(ring)).alias("parts"))


def _xy(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def parse_geojson(text: Column) -> Column:
    """GeoJSON text to a typed geometry; null, empty and malformed text become null."""
    return let(text, lambda t: let(F.struct(
        F.get_json_object(t, "$.type").alias("kind"), F.get_json_object(t, "$.coordinates").alias("coords"),
        F.get_json_object(t, "$.geometries").alias("members")), _typed))


def _typed(doc: Column) -> Column:
    kind, coords = doc["kind"], doc["coords"]

    def load(depth: int) -> Column:
        return F.from_json(coords, "array<" * depth + "double" + ">" * depth)

    def pair(p: Column) -> Column:
        return _xy(F.get(p, F.lit(0)), F.get(p, F.lit(1)))

    def line(ps: Column) -> Column:
        return F.transform(ps, pair)

    def close(ps: Column) -> Column:
        first, last = F.get(ps, F.lit(0)), F.element_at(ps, -1)
        return F.when((F.size(ps) == 0) | (first == last), ps).otherwise(
            F.concat(ps, F.array(first)))

    def ring(ps: Column) -> Column:
        return let(line(ps), close)

    parts = (
        F.when(kind == "Point", F.array(F.array(F.array(pair(load(1))))))
        .when(kind.isin("MultiPoint", "LineString"), F.array(F.array(line(load(2)))))
        .when(kind == "MultiLineString", F.array(F.transform(load(3), line)))
        .when(kind == "Polygon", F.array(F.transform(load(3), ring)))
        .when(kind == "MultiPolygon",
              F.transform(load(4), lambda poly: F.transform(poly, ring)))
        .when(kind == "GeometryCollection", _collection_parts(doc["members"]))
    )

    def checked(found: Column) -> Column:
        flat = F.flatten(F.flatten(found))
        bad = F.exists(flat, lambda p: p["x"].isNull() | p["y"].isNull())
        return F.when(found.isNotNull() & (F.size(flat) > 0) & ~bad,
                      F.struct(kind.alias("kind"), found.cast(PARTS).alias("parts")))

    return let(parts, checked)


def _collection_parts(text: Column) -> Column:
    """Members of a collection, one level deep, as one bag of point lists."""
    members = F.from_json(text, "array<struct<type:string,coordinates:string>>")

    def as_lists(m: Column) -> Column:
        c = m["coordinates"]
        lists = (
            F.when(m["type"] == "Point", F.array(F.array(F.from_json(c, "array<double>"))))
            .when(m["type"].isin("LineString", "MultiPoint"),
                  F.array(F.from_json(c, "array<array<double>>")))
            .when(m["type"].isin("Polygon", "MultiLineString"),
                  F.from_json(c, "array<array<array<double>>>"))
            .when(m["type"] == "MultiPolygon",
                  F.flatten(F.from_json(c, "array<array<array<array<double>>>>")))
        )
        return F.transform(lists, lambda ps: F.transform(
            ps, lambda p: _xy(F.get(p, F.lit(0)), F.get(p, F.lit(1)))))

    return F.transform(members, as_lists)


def to_geojson(geom: Column) -> Column:
    def xy(p: Column) -> Column:
        return F.array(p["x"], p["y"])

    def line(ps: Column) -> Column:
        return F.transform(ps, xy)

    parts = geom["parts"]
    body = (
        F.when(geom["kind"] == "Point", F.to_json(xy(parts[0][0][0])))
        .when(geom["kind"].isin("LineString", "MultiPoint"), F.to_json(line(parts[0][0])))
        .when(geom["kind"].isin("Polygon", "MultiLineString"), F.to_json(F.transform(parts[0], line)))
        .otherwise(F.to_json(F.transform(parts, lambda poly: F.transform(poly, line))))
    )
    return F.when(geom.isNotNull(),
                  F.concat(F.lit('{"type":"'), geom["kind"], F.lit('","coordinates":'), body, F.lit("}")))


def bbox(geom: Column) -> Column:
    xs = F.transform(points(geom), lambda p: p["x"])
    ys = F.transform(points(geom), lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"),
                    F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def _edges(ring: Column, f) -> Column:
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(F.slice(ring, 1, n), F.slice(ring, 2, n), f)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def _ring_moments(ring: Column, base: Column) -> Column:
    """Twice the signed area and its first moments, relative to ``base``."""
    def moment(p: Column, q: Column) -> Column:
        px, py = p["x"] - base["x"], p["y"] - base["y"]
        qx, qy = q["x"] - base["x"], q["y"] - base["y"]
        cross = px * qy - qx * py
        return F.struct(cross.alias("a"), ((px + qx) * cross).alias("mx"), ((py + qy) * cross).alias("my"))

    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    return F.aggregate(_edges(ring, moment), zero, lambda s, m: F.struct(
        (s["a"] + m["a"]).alias("a"), (s["mx"] + m["mx"]).alias("mx"), (s["my"] + m["my"]).alias("my")))


def planar_area(parts: Column) -> Column:
    """Shells minus holes, in squared units of the coordinates."""
    def ring_area(ring: Column, i: Column) -> Column:
        twice = F.abs(_ring_moments(ring, F.get(ring, F.lit(0)))["a"])
        return F.when(i == 0, twice).otherwise(-twice) / 2

    return F.abs(_total(F.flatten(F.transform(parts, lambda poly: F.transform(poly, ring_area)))))


def perimeter(parts: Column) -> Column:
    return _total(F.transform(F.flatten(parts), lambda ring: _total(_edges(
        ring, lambda p, q: F.sqrt(F.pow(q["x"] - p["x"], F.lit(2)) + F.pow(q["y"] - p["y"], F.lit(2)))))))


def centroid(geom: Column) -> Column:
    """Planar centroid: area-weighted, else length-weighted, else the mean position."""
    def at(base: Column) -> Column:
        rings = F.flatten(F.transform(geom["parts"], lambda poly: F.transform(
            poly, lambda ring, i: F.struct(_ring_moments(ring, base).alias("m"), (i > 0).alias("hole")))))
        signed = F.transform(rings, lambda r: F.struct(
            (F.abs(r["m"]["a"]) * _hole(r)).alias("w"),
            (r["m"]["mx"] * F.signum(r["m"]["a"]) * _hole(r)).alias("x"),
            (r["m"]["my"] * F.signum(r["m"]["a"]) * _hole(r)).alias("y")))

        def segment(p: Column, q: Column) -> Column:
            length = F.sqrt(F.pow(q["x"] - p["x"], F.lit(2)) + F.pow(q["y"] - p["y"], F.lit(2)))
            return F.struct(length.alias("w"), (((p["x"] + q["x"]) / 2 - base["x"]) * length).alias("x"),
                            (((p["y"] + q["y"]) / 2 - base["y"]) * length).alias("y"))

        def moved(m: Column, scale: float) -> Column:
            return _xy(base["x"] + m["x"] / (scale * m["w"]), base["y"] + m["y"] / (scale * m["w"]))

        lines = F.flatten(F.transform(F.flatten(geom["parts"]), lambda r: _edges(r, segment)))
        dots = F.transform(points(geom), lambda p: F.struct(
            F.lit(1.0).alias("w"), (p["x"] - base["x"]).alias("x"), (p["y"] - base["y"]).alias("y")))
        linear = is_polygonal(geom) | geom["kind"].isin("LineString", "MultiLineString")
        mean = let(_weighted(dots), lambda m: moved(m, 1.0))
        along = F.when(linear, let(_weighted(lines), lambda m: F.when(m["w"] > 0, moved(m, 1.0))))
        inside = F.when(is_polygonal(geom), let(_weighted(signed), lambda m: F.when(m["w"] > 0, moved(m, 3.0))))
        return F.coalesce(inside, along, mean)

    return let(F.get(points(geom), F.lit(0)), at)


def _hole(r: Column) -> Column:
    return F.when(r["hole"], F.lit(-1.0)).otherwise(F.lit(1.0))


def _weighted(items: Column) -> Column:
    zero = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return F.aggregate(items, zero, lambda s, m: F.struct(
        (s["w"] + m["w"]).alias("w"), (s["x"] + m["x"]).alias("x"), (s["y"] + m["y"]).alias("y")))


def compactness(geom: Column) -> Column:
    """Squared perimeter over area on the stored coordinates; null without area."""
    ratio = let(planar_area(geom["parts"]), lambda area: F.when(
        area > 0, F.pow(perimeter(geom["parts"]), F.lit(2)) / area))
    return F.when(is_polygonal(geom), ratio)


# --- projection ---------------------------------------------------------------------------

def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone a position falls in."""
    zone = F.least(F.greatest(((lon + 180) / 6).cast("int") + 1, F.lit(1)), F.lit(60))
    return zone + F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700))


def is_utm(epsg: Column) -> Column:
    return epsg.between(32601, 32660) | epsg.between(32701, 32760)


def central_meridian(epsg: Column) -> Column:
    return (epsg % 100) * 6.0 - 183.0


def false_northing(epsg: Column) -> Column:
    return F.when(epsg >= 32700, F.lit(UTM_NORTHING)).otherwise(F.lit(0.0))


def to_utm(pts: Column, epsg: Column) -> Column:
    """Project an array of lon/lat points; each step names its result once for the next."""
    lon0, north = central_meridian(epsg), false_northing(epsg)

    def conformal(p: Column) -> Column:
        s = F.sin(p["y"] * RAD)
        return F.struct(F.sinh(F.atanh(s) - CONFORMAL * F.atanh(CONFORMAL * s)).alias("t"),
                        ((p["x"] - lon0) * RAD).alias("d"))

    def sphere(p: Column) -> Column:
        return F.struct(F.atan2(p["t"], F.cos(p["d"])).alias("xi"),
                        F.atanh(F.sin(p["d"]) / F.sqrt(1 + p["t"] * p["t"])).alias("eta"))

    def plane(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        e, n = eta, xi
        for j, a in enumerate(ALPHA, 1):
            e = e + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            n = n + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return _xy(UTM_EASTING + UTM_SCALE * UTM_RADIUS * e, north + UTM_SCALE * UTM_RADIUS * n)

    return F.transform(F.transform(F.transform(pts, conformal), sphere), plane)


def from_utm(pts: Column, epsg: Column) -> Column:
    lon0, north = central_meridian(epsg), false_northing(epsg)

    def scaled(p: Column) -> Column:
        return F.struct(((p["y"] - north) / (UTM_SCALE * UTM_RADIUS)).alias("xi"),
                        ((p["x"] - UTM_EASTING) / (UTM_SCALE * UTM_RADIUS)).alias("eta"))

    def sphere(p: Column) -> Column:
        xi, eta = p["xi"], p["eta"]
        x, e = xi, eta
        for j, b in enumerate(BETA, 1):
            x = x - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            e = e - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        return F.struct(x.alias("xi"), e.alias("eta"))

    def conformal(p: Column) -> Column:
        return F.struct(F.asin(F.sin(p["xi"]) / F.cosh(p["eta"])).alias("chi"),
                        F.atan2(F.sinh(p["eta"]), F.cos(p["xi"])).alias("d"))

    def degrees(p: Column) -> Column:
        lat = p["chi"]
        for j, d in enumerate(DELTA, 1):
            lat = lat + d * F.sin(2 * j * p["chi"])
        return _xy(lon0 + p["d"] / RAD, lat / RAD)

    out = F.transform(F.transform(pts, scaled), sphere)
    return F.transform(F.transform(out, conformal), degrees)


def to_web_mercator(pts: Column) -> Column:
    return F.transform(pts, lambda p: _xy(
        WEB_MERCATOR_R * RAD * p["x"], WEB_MERCATOR_R * F.asinh(F.tan(p["y"] * RAD))))


def from_web_mercator(pts: Column) -> Column:
    return F.transform(pts, lambda p: _xy(
        p["x"] / (WEB_MERCATOR_R * RAD), F.atan(F.sinh(p["y"] / WEB_MERCATOR_R)) / RAD))


def epsg_code(crs: Column) -> Column:
    """Numeric code of a CRS text, null when it is not one we can project."""
    code = F.regexp_extract(F.upper(F.trim(crs)), r"^(?:EPSG:)?(\d{4,5})$", 1)
    code = F.try_to_number(F.nullif(code, F.lit("")), F.lit("99999")).cast("int")
    return F.when(code.isin(4326, 3857, *systems.SYSTEMS) | is_utm(code), code)


def _map_points(parts: Column, f) -> Column:
    return F.transform(parts, lambda poly: F.transform(poly, f))


def reproject(geom: Column, src: Column, dst: Column) -> Column:
    """``struct<geom, status>``: transformed, unchanged, or error with the geometry as it was."""
    s, d = epsg_code(src), epsg_code(dst)
    empty = geom.isNull() | (num_vertices(geom) == 0)

    def degrees(ps: Column) -> Column:
        return (F.when(s == 4326, ps).when(s == 3857, from_web_mercator(ps))
                .when(s.isin(*systems.SYSTEMS), systems.to_wgs84(ps, s)).otherwise(from_utm(ps, s)))

    def target(ps: Column) -> Column:
        return (F.when(d == 4326, ps).when(d == 3857, to_web_mercator(ps))
                .when(d.isin(*systems.SYSTEMS), systems.from_wgs84(ps, d)).otherwise(to_utm(ps, d)))

    moved = F.struct(geom["kind"].alias("kind"),
                     _map_points(_map_points(geom["parts"], degrees), target).alias("parts"))
    status = (F.when(empty, "error").when(src == dst, "unchanged")
              .when(s.isNull() | d.isNull(), "error").otherwise("transformed"))
    return F.struct(F.when(status == "transformed", moved).otherwise(geom).alias("geom"),
                    status.alias("status"))


def detect_crs(declared: Column, x: Column, y: Column) -> Column:
    """Declared CRS when usable, else a guess from one sample position."""
    return (
        F.when(epsg_code(declared).isNotNull(), declared)
        .when(x.between(-180, 180) & y.between(-90, 90), F.lit("EPSG:4326"))
        .when(x.between(100000, 999999) & y.between(0, 10000000), F.lit("EPSG:32643"))
        .otherwise(F.lit("EPSG:4326")))


def area_sqm(geom: Column) -> Column:
    """Area in the UTM zone of the centroid; 0 for null and empty geometries."""
    def in_zone(epsg: Column) -> Column:
        return planar_area(_map_points(geom["parts"], lambda ring: to_utm(ring, epsg)))

    area = let(centroid(geom), lambda c: let(utm_epsg(c["x"], c["y"]), in_zone))
    return F.when(is_polygonal(geom), area).otherwise(F.lit(0.0))


def local_plane_area(geom: Column, lat: Column, metres_per_degree: float = 111320.0) -> Column:
    """Area with one degree scale per feature: the flat metric the rectangle forms use."""
    k = F.lit(metres_per_degree)
    return planar_area(geom["parts"]) * k * k * F.cos(lat * RAD)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = (F.pow(F.sin((lat2 - lat1) * RAD / 2), F.lit(2))
         + F.cos(lat1 * RAD) * F.cos(lat2 * RAD) * F.pow(F.sin((lon2 - lon1) * RAD / 2), F.lit(2)))
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


# --- closed forms on bounding boxes -------------------------------------------------------

def boxes_meet(a: str, b: str, pad_x: Column | None = None, pad_y: Column | None = None) -> Column:
    """Bounding boxes of the prefixed sides touch, after widening side ``a``."""
    px = pad_x if pad_x is not None else F.lit(0.0)
    py = pad_y if pad_y is not None else F.lit(0.0)
    return ((F.col(a + "xmin") - px <= F.col(b + "xmax")) & (F.col(a + "xmax") + px >= F.col(b + "xmin"))
            & (F.col(a + "ymin") - py <= F.col(b + "ymax")) & (F.col(a + "ymax") + py >= F.col(b + "ymin")))


def box_iou(a: str, b: str) -> Column:
    """Overlap ratio of two rectangles; a flat metric scales both axes, so degrees will do."""
    w = F.greatest(F.lit(0.0), F.least(F.col(a + "xmax"), F.col(b + "xmax"))
                   - F.greatest(F.col(a + "xmin"), F.col(b + "xmin")))
    h = F.greatest(F.lit(0.0), F.least(F.col(a + "ymax"), F.col(b + "ymax"))
                   - F.greatest(F.col(a + "ymin"), F.col(b + "ymin")))
    inter = w * h
    union = _box_size(a) + _box_size(b) - inter
    return F.when(union > 0, F.least(F.lit(1.0), inter / union)).otherwise(F.lit(0.0))


def _box_size(p: str) -> Column:
    return (F.col(p + "xmax") - F.col(p + "xmin")) * (F.col(p + "ymax") - F.col(p + "ymin"))


def box_distance_m(a: str, b: str, lat: Column, metres_per_degree: float = 111320.0) -> Column:
    """Gap between two rectangles in flat metres at latitude ``lat``; 0 when they touch."""
    dx = F.greatest(F.lit(0.0), F.col(b + "xmin") - F.col(a + "xmax"), F.col(a + "xmin") - F.col(b + "xmax"))
    dy = F.greatest(F.lit(0.0), F.col(b + "ymin") - F.col(a + "ymax"), F.col(a + "ymin") - F.col(b + "ymax"))
    sx = dx * metres_per_degree * F.cos(lat * RAD)
    sy = dy * metres_per_degree
    return F.sqrt(sx * sx + sy * sy)
