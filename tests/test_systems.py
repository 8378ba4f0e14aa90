"""Coordinate systems against published worked examples (EPSG guidance note 7 part 2) and round trips."""

import pytest
from pyspark.sql import functions as F

from landrecon.functions import geo, systems
from landrecon.functions.systems import Conic, Ellipsoid, Shift, System

CLARKE_1866 = Ellipsoid(6378206.4, 294.97870)
FOOT = 0.304800609601219
OWN = {
    1: System(CLARKE_1866, conic=Conic(18, -77, 250000, 150000)),
    2: System(CLARKE_1866, conic=Conic(27 + 50 / 60, -99, 2000000, 0, lat1=28 + 23 / 60, lat2=30 + 17 / 60, unit=FOOT)),
    3: System(Ellipsoid(6378135, 298.26), Shift(z=4.5, rz=0.554, ppm=0.219)),
    4: System(Ellipsoid(6378388, 297), Shift(-148, 136, 90, 1.5, -2.5, 30.0, -9.0), Conic(-30, 170, 5e5, 1e6, lat1=-20, lat2=-50)),
}


def at(x, y):
    return F.array(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")))


def first(spark, pts):
    p = spark.range(1).select(pts[0].alias("p")).first().p
    return tuple(p)


@pytest.mark.parametrize("code,lon,lat,easting,northing", [
    (1, -(76 + 56 / 60 + 37.26 / 3600), 17 + 55 / 60 + 55.8 / 3600, 255966.58, 142493.51),
    (2, -96.0, 28.5, 2963503.91, 254759.80)])
def test_published_conic_points(spark, code, lon, lat, easting, northing):
    d = systems.definition(F.lit(code), OWN)
    assert first(spark, systems.project(at(lon, lat), d)) == (pytest.approx(easting, abs=0.01), pytest.approx(northing, abs=0.01))
    back = first(spark, systems.unproject(at(easting, northing), d))
    assert back == (pytest.approx(lon, abs=1e-7), pytest.approx(lat, abs=1e-7))


def test_published_datum_shift(spark):
    d = systems.definition(F.lit(3), OWN)
    centre = F.array(F.struct(F.lit(3657660.66).alias("x"), F.lit(255768.55).alias("y"), F.lit(5201382.11).alias("z")))
    there = first(spark, systems.shifted(centre, d))
    assert there == tuple(pytest.approx(v, abs=0.01) for v in (3657660.78, 255778.43, 5201387.75))
    assert first(spark, systems.unshifted(systems.shifted(centre, d), d)) == tuple(
        pytest.approx(v, abs=1e-6) for v in (3657660.66, 255768.55, 5201382.11))
    lon, lat = first(spark, systems.to_wgs84(at(4, 55), F.lit(3), OWN))
    assert (lat, lon) == (pytest.approx(55 + 0.090 / 3600, abs=1e-3 / 3600), pytest.approx(4 + 0.554 / 3600, abs=1e-3 / 3600))


def test_every_system_there_and_back(spark):
    both = systems.SYSTEMS | OWN
    rows = [(code, (s.conic.lon0 if s.conic else 78.0) + dx, (s.conic.lat0 if s.conic else 20.0) + dy)
            for code, s in both.items() for dx, dy in ((0.0, 0.0), (3.1, 4.2), (-5.5, -2.25), (0.001, -0.001))]
    df = spark.createDataFrame(rows, "code int, lon double, lat double")
    pts = F.array(F.struct(F.col("lon").alias("x"), F.col("lat").alias("y")))
    got = df.withColumn("q", systems.to_wgs84(systems.from_wgs84(pts, F.col("code"), both), F.col("code"), both)[0]).collect()
    assert len(got) == len(rows)
    for r in got:
        # Positions have no height: what a shift makes of height 0 is dropped, some millimetres for the way and back.
        near = 1e-10 if both[r.code].shift == Shift() and r.code not in (1, 2) else 1e-7
        assert (r.q.x, r.q.y) == (pytest.approx(r.lon, abs=near), pytest.approx(r.lat, abs=near)), r.code


def test_poles_far_side_and_unknown_codes(spark):
    to = lambda x, y, code: first(spark, systems.from_wgs84(at(x, y), F.lit(code), OWN | systems.SYSTEMS))
    d = systems.definition(F.lit(7755))
    assert first(spark, systems.unproject(systems.project(at(80, 90), d), d))[1] == pytest.approx(90)
    # The same meridian, counted from either side.
    assert to(-179.5, -35, 4) == tuple(pytest.approx(v) for v in to(180.5, -35, 4))
    assert to(80, 24, 7755) == (pytest.approx(4e6), pytest.approx(4e6))
    assert spark.range(1).select(systems.to_wgs84(at(1, 2), F.lit(99)).alias("p")).first().p is None


def test_reproject_mixes_systems_in_a_column(spark):
    df = spark.createDataFrame([("EPSG:4326", "EPSG:24381"), ("epsg:4326", "24380"), ("EPSG:4326", "EPSG:32643"), ("EPSG:4326", "EPSG:7755"),
                                ("EPSG:4326", "EPSG:9999"), ("EPSG:24379", "EPSG:24379")], "src string, dst string")
    p = geo.point_geom(F.lit(74.25), F.lit(16.7))
    there = df.select("src", "dst", geo.reproject(p, F.col("src"), F.col("dst")).alias("m"))
    back = there.select("m.status", geo.reproject(F.col("m.geom"), F.col("dst"), F.col("src")).alias("b")).collect()
    assert [r.status for r in back] == ["transformed"] * 4 + ["error", "unchanged"]
    for r in back[:4]:
        q = r.b.geom.parts[0][0][0]
        assert (q.x, q.y) == (pytest.approx(74.25, abs=1e-7), pytest.approx(16.7, abs=1e-7))
    assert spark.range(1).select(geo.detect_crs(F.lit("EPSG:24381"), F.lit(1.0), F.lit(1.0)).alias("c")).first().c == "EPSG:24381"
