"""Collections read by byte ranges give what a whole parse gives."""

import json
import random

import pytest
from pyspark.sql import functions as F

from landrecon.sources import geojson, readers


@pytest.fixture
def small_ranges(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def split(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", size)

    yield split
    for k, v in kept.items():
        spark.conf.set(k, v)


NASTY = ["plain", 'a "quoted" }{][ text', "back\\slash\\", '\\"}', "{\"type\":\"Feature\"}", "é日本\U0001f600 }", "]}", '","features":[{', "\n}\t{", ""]


def collection(rng, n):
    def value(depth=0):
        kind = rng.randrange(6 if depth < 3 else 3)
        return (rng.choice(NASTY) if kind < 2 else rng.randrange(1000) if kind == 2 else {rng.choice(NASTY) + str(i): value(depth + 1) for i in range(rng.randrange(4))}
                if kind == 3 else [value(depth + 1) for _ in range(rng.randrange(4))] if kind == 4 else None)

    features = [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [73 + i / 1e4, 18.0]} if i % 7 else None,
                 "properties": {"id": str(i), "x": value()}} for i in range(n)]
    return {"other": [{"type": "Feature", "n": [[1]]}], "crs": {"type": "name", "properties": {"features": [{"a": 1}]}},
            "type": "FeatureCollection", "crs_hint": "EPSG:4326", "features": features, "more": [[{"b": {}}], {"c": 1}], "bbox": [1, 2]}


@pytest.mark.parametrize("size, indent, seed", [(300, None, 1), (500, 1, 2), (2000, None, 3), (10_000_000, 2, 4)])
def test_ranges_equal_a_whole_parse(spark, tmp_path, small_ranges, size, indent, seed):
    docs = [collection(random.Random(seed + k), 25) for k in range(2)]
    for name, doc in zip("ab", docs):
        (tmp_path / f"{name}.geojson").write_text(json.dumps(doc, indent=indent, ensure_ascii=seed % 2 == 0) + "\n" * (seed % 2), encoding="utf-8")
    (tmp_path / "c.geojson").write_text("\n".join(json.dumps(f) for f in docs[0]["features"]))
    small_ranges(size)
    path = str(tmp_path)
    total = sum(f.stat().st_size for f in tmp_path.iterdir())
    assert geojson.records(spark, path).rdd.getNumPartitions() >= min(100, total // size // 2)
    rows = geojson.feature_texts(spark, path).orderBy("ordinal").collect()
    assert [json.loads(r.value) for r in rows] == docs[0]["features"] + docs[1]["features"] + docs[0]["features"]
    assert {r.hint for r in rows[:50]} == {"EPSG:4326"} and {r.hint for r in rows[50:]} == {None}
    assert len({r.ordinal for r in rows}) == len(rows)


def test_many_ranges_are_joined_by_shuffle(spark, tmp_path, small_ranges, monkeypatch):
    monkeypatch.setattr(geojson, "BROADCAST_RANGES", 3)
    doc = collection(random.Random(9), 30)
    (tmp_path / "a.geojson").write_text(json.dumps(doc))
    small_ranges(300)
    rows = geojson.feature_texts(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [json.loads(r.value) for r in rows] == doc["features"]


def test_one_feature_over_many_ranges(spark, tmp_path, small_ranges):
    """A polygon of many vertices is one record; its range is the one in which it starts."""
    ring = [[74 + i / 1e6, 16.0 + (i % 7) / 1e5] for i in range(5000)]
    big = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[*ring, ring[0]]]},
           "properties": {str(i): "} " * 50 for i in range(200)}}
    small = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [74.0, 16.0]}, "properties": {}}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [small, big, small, big]}))
    small_ranges(2000)
    rows = geojson.feature_texts(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [json.loads(r.value) for r in rows] == [small, big, small, big]


def test_empty_and_wrong_files(spark, tmp_path):
    for k, doc in enumerate(({"type": "FeatureCollection", "features": []}, {"features": [], "type": "FeatureCollection"})):
        (tmp_path / f"{k}.geojson").write_text(json.dumps(doc))
    assert geojson.feature_texts(spark, str(tmp_path)).count() == 0
    for k, text in enumerate(('{"type":"Topology","features":[]}', "[1, 2]", '{"a":{"type":"FeatureCollection"}}')):
        (tmp_path / "bad").mkdir(exist_ok=True)
        (tmp_path / "bad" / "x.json").write_text(text)
        with pytest.raises(Exception, match="FeatureCollection"):
            readers.read_geojson(spark, str(tmp_path / "bad" / "x.json"), "D", "gnss").count()
