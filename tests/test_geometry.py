"""Geometry columns and the array kernel."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from landrecon.functions import geo, kernel

POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
PARTS = pa.list_(pa.list_(pa.list_(POINT)))


def parts(*polys):
    return [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in poly] for poly in polys]


def box(a, b, c, d):
    return [(a, b), (c, b), (c, d), (a, d), (a, b)]


def shapes(*rows):
    return kernel.Shapes(pa.array(list(rows), type=PARTS))


def shoelace(ring):
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))) / 2


def star(rnd, n, cx=0.0, cy=0.0):
    angles = [2 * math.pi * (i + rnd.uniform(0, 0.9)) / n for i in range(n)]
    ring = [(cx + (r := rnd.uniform(0.3, 1)) * math.cos(t), cy + r * math.sin(t)) for t in angles]
    return ring + ring[:1]


def test_sweep_area_equals_shoelace_and_is_symmetric():
    rnd = random.Random(5)
    for n in (5, 7, 9, 40):
        a, b = star(rnd, n), star(rnd, n + 2, 0.3, 0.2)
        aa, ab, both = (v[0] for v in kernel.overlap_areas(shapes(parts([a])), shapes(parts([b]))))
        _, _, back = (v[0] for v in kernel.overlap_areas(shapes(parts([b])), shapes(parts([a]))))
        assert aa == pytest.approx(shoelace(a), abs=1e-12)
        assert ab == pytest.approx(shoelace(b), abs=1e-12)
        assert both == pytest.approx(back, abs=1e-12)
        assert 0 <= both <= min(aa, ab) + 1e-12


def test_sweep_agrees_with_sampling():
    rnd = random.Random(7)
    a, b = star(rnd, 8), star(rnd, 8, 0.2, 0.1)
    both = kernel.overlap_areas(shapes(parts([a])), shapes(parts([b])))[2][0]
    pts = np.random.default_rng(1).uniform(-1.5, 1.5, size=(200_000, 2))

    def inside(ring):
        e = np.array([[*p, *q] for p, q in zip(ring, ring[1:])])
        return np.concatenate([kernel._inside(c[:, :1], c[:, 1:], e[None]) for c in np.array_split(pts, 20)])

    assert both == pytest.approx(9 * (inside(a) & inside(b)).mean(), abs=0.03)


def test_sweep_handles_holes_parts_and_blocks(monkeypatch):
    ring = parts([box(0, 0, 4, 4), box(1, 1, 3, 3)])
    two = parts([box(0, 0, 1, 1)], [box(3, 3, 5, 5)])
    want = [12.0, 5.0, 2.0]
    assert [v[0] for v in kernel.overlap_areas(shapes(ring), shapes(two))] == pytest.approx(want)
    monkeypatch.setattr(kernel, "_BLOCK", 8)
    assert [v[0] for v in kernel.overlap_areas(shapes(ring), shapes(two))] == pytest.approx(want)


def test_distances():
    square = shapes(*[parts([box(0, 0, 2, 2)])] * 5)
    other = shapes(parts([[(5, 2)]]), parts([[(1, 1)]]), parts([[(-1, 1), (3, 1)]]), parts([[(3, 0), (3, 5)]]), None)
    d = kernel.shape_distance(other, square)
    assert d[:4] == pytest.approx([3, 0, 0, 1]) and math.isnan(d[4])


def test_line_relation():
    square = shapes(*[parts([box(0, 0, 2, 2)])] * 4)
    lines = shapes(parts([[(-1, 1), (5, 1)]]), parts([[(0.2, 0.2), (0.5, 0.5)]]), parts([[(0, 0), (0, 1)]]), parts([[(3, 3), (4, 4)]]))
    assert kernel.line_relation(lines, square).tolist() == [1, 2, 1, 0]


def test_bow_tie_is_found_and_repaired(spark):
    bow = '{"type":"Polygon","coordinates":[[[0,0],[2,2],[0,2],[2,0],[0,0]]]}'
    good = '{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,0]]]}'
    df = spark.createDataFrame([(bow,), (good,)], "g string").select(geo.parse_geojson(F.col("g")).alias("geom"))
    df = df.withColumn("v", kernel.validity_of(F.col("geom")))
    df = df.withColumn("fixed", kernel.repair(F.col("geom"), F.col("v") != "ok"))
    one, two = df.select("v", F.size("fixed.parts").alias("n"), geo.planar_area(F.col("fixed.parts")).alias("a"),
                         kernel.validity_of(F.col("fixed")).alias("again"), F.col("fixed").isNull().alias("none")).collect()
    assert (one.v, one.n, one.again) == ("self_intersection", 2, "ok") and one.a == pytest.approx(2.0)
    assert two.v == "ok" and two.none


def test_touching_rings_and_parts():
    square, far = box(0, 0, 4, 4), box(6, 6, 7, 7)
    broken = [parts([[(0, 0), (4, 0), (4, 4), (2, 0), (0, 4), (0, 0)]]),  # a vertex on an edge of its own ring
              parts([square, box(1, 0, 3, 2)]), parts([square], [box(4, 1, 6, 3)]), parts([square], [square]),
              parts([square, box(1, 1, 2, 2), box(1, 1, 2, 2)])]
    whole = [parts([square, [(0, 2), (1, 1), (1, 3), (0, 2)]]),  # a hole with one point on the shell
             parts([square], [box(4, 4, 6, 6)], [far[::-1]]), parts([[(0, 0), (2, 0), (4, 0), (4, 4), (0, 4), (0, 0)]]),
             parts([square, box(1, 1, 2, 2), box(2, 2, 3, 3)])]
    assert kernel.validity(pa.array(broken, type=PARTS)) == ["self_intersection"] * 5
    areas = []
    for row in broken:
        one = shapes(row)
        faces = kernel.repaired(one.x, one.y, one.ring, [len(p) for p in row])
        assert kernel.validity(pa.array([parts(*faces)], type=PARTS)) == ["ok"]
        areas.append(sum(shoelace(p[0]) - sum(map(shoelace, p[1:])) for p in faces))
    assert areas == pytest.approx([8, 12, 20, 16, 15])
    assert kernel.validity(pa.array(whole, type=PARTS)) == ["ok"] * 4


def test_known_utm_position_and_back(spark):
    df = spark.sql("select -79.387139D as x, 43.642567D as y")
    p = geo.point_geom(F.col("x"), F.col("y"))
    there = geo.reproject(p, F.lit("EPSG:4326"), F.lit("EPSG:32617"))
    row = df.select(geo.points(there["geom"])[0].alias("p"), geo.points(
        geo.reproject(there["geom"], F.lit("EPSG:32617"), F.lit("EPSG:4326"))["geom"])[0].alias("q")).first()
    assert (row.p.x, row.p.y) == (pytest.approx(630084, abs=1), pytest.approx(4833438, abs=1))
    assert (row.q.x, row.q.y) == (pytest.approx(-79.387139, abs=1e-9), pytest.approx(43.642567, abs=1e-9))


def test_reproject_statuses(spark):
    p = geo.point_geom(F.lit(10.0), F.lit(20.0))
    row = spark.range(1).select(
        geo.reproject(p, F.lit("EPSG:4326"), F.lit("EPSG:4326"))["status"].alias("same"),
        geo.reproject(p, F.lit("EPSG:9999"), F.lit("EPSG:4326"))["status"].alias("bad"),
        geo.reproject(p, F.lit("EPSG:3857"), F.lit("EPSG:4326"))["status"].alias("moved"),
        geo.reproject(F.lit(None).cast(geo.GEOMETRY), F.lit("EPSG:3857"), F.lit("EPSG:4326"))["status"].alias("none")).first()
    assert tuple(row) == ("unchanged", "error", "transformed", "error")


@pytest.mark.parametrize("text", [
    '{"type":"Point","coordinates":[1.5,2.0]}', '{"type":"LineString","coordinates":[[1.0,2.0],[3.0,4.0]]}',
    '{"type":"MultiPoint","coordinates":[[1.0,2.0],[3.0,4.0]]}',
    '{"type":"MultiLineString","coordinates":[[[1.0,2.0],[3.0,4.0]],[[5.0,6.0],[7.0,8.0]]]}',
    '{"type":"Polygon","coordinates":[[[0.0,0.0],[4.0,0.0],[4.0,4.0],[0.0,0.0]],[[2.0,1.0],[3.0,1.0],[3.0,2.0],[2.0,1.0]]]}',
    '{"type":"MultiPolygon","coordinates":[[[[0.0,0.0],[4.0,0.0],[4.0,4.0],[0.0,0.0]]],[[[5.0,5.0],[6.0,5.0],[6.0,6.0],[5.0,5.0]]]]}'])
def test_geojson_round_trip(spark, text):
    assert spark.range(1).select(geo.to_geojson(geo.parse_geojson(F.lit(text)))).first()[0] == text


def test_unreadable_geojson_is_null(spark):
    rows = [None, "", "no json", '{"type":"Polygon"}', '{"type":"Point","coordinates":["a",1]}', '{"type":"Polygon","coordinates":[]}']
    df = spark.createDataFrame([(r,) for r in rows], "g string")
    assert [r[0] for r in df.select(geo.parse_geojson(F.col("g")).isNull()).collect()] == [True] * len(rows)


def test_nested_collection_vertices(spark):
    text = ('{"type":"GeometryCollection","bbox":[0,0,1,1],"geometries":[{"type":"Point","coordinates":[0,0]},'
            '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,1]}]}]}')
    assert spark.range(1).select(geo.json_num_vertices(F.lit(text))).first()[0] == 2


def test_centroid_with_hole_and_line(spark):
    poly = '{"type":"Polygon","coordinates":[[[0,0],[4,0],[4,4],[0,4],[0,0]],[[2,0],[4,0],[4,4],[2,4],[2,0]]]}'
    line = '{"type":"LineString","coordinates":[[0,0],[2,0],[2,2]]}'
    got = spark.createDataFrame([(poly,), (line,)], "g string").select(geo.centroid(geo.parse_geojson(F.col("g"))).alias("c")).collect()
    assert [(r.c.x, r.c.y) for r in got] == [(1.0, 2.0), (1.5, 0.5)]
