"""Stored versions with digest trees, the trigram index, and snapshots whose writer is stopped in between."""

import random

import pytest
from pyspark.sql import functions as F

from landrecon.catalog import tables
from landrecon.operators import changes, search, search_index, versions
from landrecon.sources import sinks

FEATURES = "ordinal long, feature_id string, properties map<string,string>, geometry_geojson string"


def version(spark, rows):
    return spark.createDataFrame([(i, f"F{i}", {"parcel_id": k, **p}, g) for i, (k, p, g) in enumerate(rows)], FEATURES)


def plain(rows):
    return {k: (p, g) for k, p, g in rows if k}


def test_only_differing_leaves_are_read(spark, tmp_path):
    rng = random.Random(1)
    old = [(f"P-{i}", {"a": str(i % 5), "b": None if i % 9 == 0 else "x"}, f"g{i % 50}") for i in range(3000)] + [("P-7", {"a": "again"}, "g"), ("", {}, "g")]
    new = [r for i, r in enumerate(old) if i not in (5, 900)]
    new[100] = (new[100][0], {"a": "changed", "b": new[100][1]["b"]}, new[100][2])
    new[200] = (new[200][0], new[200][1], "moved")
    new[300] = (new[300][0], new[300][1], None)
    new += [("P-new", {"a": "1"}, "g")]
    rng.shuffle(new)
    new.sort(key=lambda r: r[1].get("a") == "again")  # the second P-7 stays the last one
    paths = [str(tmp_path / n) for n in ("old", "new")]
    for rows, path in ((old, paths[0]), (new, paths[1])):
        versions.save_version(version(spark, rows), path)
    was, now = plain(old), plain(new)
    expected = sorted([(k, "new") for k in now.keys() - was.keys()] + [(k, "removed") for k in was.keys() - now.keys()]
                      + [(k, "geometry_changed") for k in was.keys() & now.keys() if was[k][1] != now[k][1]]
                      + [(k, "attribute_changed") for k in was.keys() & now.keys() if was[k][0] != now[k][0]])
    got = versions.stored_changes(spark, *paths).collect()
    key = lambda r: r.key.split(":", 1)[1]
    assert sorted((key(r), r.change_type) for r in got) == expected and len(expected) == 6
    leaves = versions.differing(spark, *paths)
    assert 1 <= len(leaves) <= 6
    read = sum(versions.rows_of(spark, p, leaves).count() for p in paths)
    assert read <= 30 < 6000
    states = {key(r): r.state for r in versions.stored_keys(spark, *paths).collect()}
    assert states == {k: "added" if k not in was else "removed" if k not in now else "common" for k in was | now}
    assert versions.differing(spark, paths[0], paths[0]) == [] and versions.stored_changes(spark, paths[0], paths[0]).isEmpty()


def test_many_differing_leaves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "NAMED_LEAVES", 3)
    old = [(f"P-{i}", {"a": str(i)}, "g") for i in range(200)]
    new = [(k, {"a": p["a"] + ("!" if int(p["a"]) % 2 else "")}, g) for k, p, g in old]
    for rows, name in ((old, "old"), (new, "new")):
        versions.save_version(version(spark, rows), str(tmp_path / name))
    assert versions.stored_changes(spark, str(tmp_path / "old"), str(tmp_path / "new")).count() == 100


@pytest.mark.parametrize("term", ["p-12", "CUSTOMER#00000001", "01", "0%9", "no such parcel", "#0000", "_-1_5", "\\"])
@pytest.mark.parametrize("role", [None, "viewer"])
def test_index_gives_the_rows_of_a_scan(spark, sf, indexed, term, role):
    parcels, path = indexed
    want = search.search_parcels(parcels, search=term, role=role, limit=2000)
    got = search_index.search_parcels(spark, path, term=term, role=role, limit=2000)
    assert [tuple(r) for r in got.select(*want.columns).collect()] == [tuple(r) for r in want.collect()]


@pytest.fixture(scope="module")
def indexed(spark, sf, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    parcels = tables.parcels(spark, sf)
    search_index.write_index(parcels, path)
    return parcels, path


def test_few_files_are_read(spark, indexed):
    parcels, path = indexed
    whole = spark.read.parquet(f"{path}/parcels").select(F.input_file_name().alias("f")).distinct().count()
    rows = search_index.parcels_with(spark, path, "customer#000000012")
    folders = {r.f for r in rows.select(F.col("_metadata.file_path").alias("f")).distinct().collect()} if "_metadata" in rows.columns else None
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan and folders is None
    found = search_index.candidates(spark, path, "customer#000000012", "owner_name")
    assert found.select("bucket").distinct().count() < whole // 4


def test_a_stopped_writer_leaves_the_last_whole_snapshot(spark, sf, tmp_path, monkeypatch):
    path, parcels = str(tmp_path / "snap"), tables.parcels(spark, sf)
    sinks.save_snapshot(parcels.limit(5), path, "one")

    def stopped(*_):
        raise RuntimeError("stopped")

    monkeypatch.setattr(sinks, "commit_snapshot", stopped)
    with pytest.raises(RuntimeError):
        sinks.save_snapshot(parcels.limit(7), path, "two")  # rows written, not committed
    assert sinks.load_snapshot(spark, path).count() == 5
    monkeypatch.undo()
    (tmp_path / "snap" / "_versions" / "000000000002.json").write_text('{"run_')  # stopped within the manifest
    assert sinks.load_snapshot(spark, path).count() == 5
    sinks.commit_snapshot(spark, path, "gone")  # its rows are not there
    assert sinks.load_snapshot(spark, path).count() == 5
    sinks.save_snapshot(parcels.limit(9), path, "three")
    assert sinks.load_snapshot(spark, path).count() == 9
    assert sorted(sinks._manifests(spark, path)) == [1, 2, 3, 4]
