"""Readers, writers, snapshots, the audit trail and the upload stream."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from landrecon import lens
from landrecon.catalog import tables
from landrecon.functions import geo
from landrecon.operators import search
from landrecon.sources import checksums, readers, sinks
from landrecon.streaming.ingest import incremental_ingest

SQUARE = [[74.0, 16.0], [74.001, 16.0], [74.001, 16.001], [74.0, 16.001], [74.0, 16.0]]


def feature(geometry, **props):
    return {"type": "Feature", "geometry": geometry, "properties": props}


def test_read_geojson_collection_drops_bad_features(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        feature({"type": "Polygon", "coordinates": [SQUARE]}, parcel_id="P-1", n=3, empty=None),
        feature({"type": "Polygon", "coordinates": "broken"}), feature(None),
        feature({"type": "Point", "coordinates": [74.0, 16.0]})]}
    (tmp_path / "a.geojson").write_text(json.dumps(doc))
    rows = readers.read_geojson(spark, str(tmp_path / "a.geojson"), "DS-1", "cadastral").orderBy("ordinal").collect()
    assert [r.kind for r in rows] == ["Polygon", "Point"]
    assert rows[0].properties == {"parcel_id": "P-1", "n": "3", "empty": None} and rows[0].canonical_type == "parcel"
    assert rows[0].area_sqm == pytest.approx(106.9 * 110.66, rel=0.02) and rows[1].area_sqm is None
    assert rows[0].is_valid and (rows[0].centroid_lat, rows[0].centroid_lon) == (pytest.approx(16.0005), pytest.approx(74.0005))


def test_read_geojson_lines_and_crs_hint(spark, tmp_path):
    (tmp_path / "l.geojsonl").write_text("\n".join(json.dumps(feature({"type": "Point", "coordinates": [74.0 + i, 16]}, i=i)) for i in range(3)))
    assert readers.read_geojson(spark, str(tmp_path / "l.geojsonl"), "DS", "gnss").count() == 3
    doc = {"type": "FeatureCollection", "crs_hint": "EPSG:32643",
           "features": [feature({"type": "Point", "coordinates": [500000.0, 1769000.0]})]}
    (tmp_path / "u.geojson").write_text(json.dumps(doc))
    row = readers.read_geojson(spark, str(tmp_path / "u.geojson"), "DS", "gnss").first()
    assert row.centroid_lon == pytest.approx(75.0) and row.centroid_lat == pytest.approx(16.0, abs=0.01)


def test_crs_is_judged_by_the_first_feature(spark):
    g = '{"type":"Point","coordinates":[%s,%s]}'
    raw = spark.createDataFrame([(0, {}, g % (500000, 1769000)), (1, {}, g % (75, 16))],
                                "ordinal long, properties map<string,string>, geometry_geojson string")
    rows = readers.as_features(raw, "DS", "gnss").orderBy("ordinal").collect()
    assert rows[0].centroid_lon == pytest.approx(75.0) and rows[1].centroid_lon < 74


def test_read_geojson_rejects_other_json(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"type":"Topology"}')
    with pytest.raises(Exception, match="FeatureCollection"):
        readers.read_geojson(spark, str(tmp_path / "x.json"), "DS", "gnss").count()


def test_read_csv_points(spark, tmp_path):
    (tmp_path / "p.csv").write_text("point_id,latitude,longitude,note\n1,16.5,74.2,a\n2,abc,74.2,b\n3,91,74,c\n4,NaN,74,d\n5,-90,180,\n")
    rows = readers.read_csv_points(spark, str(tmp_path / "p.csv"), "DS", "gnss").orderBy("ordinal").collect()
    assert [r.properties for r in rows] == [{"point_id": "1", "note": "a"}, {"point_id": "5", "note": None}]
    (tmp_path / "q.csv").write_text("a,b\n1,2\n")
    assert readers.read_csv_points(spark, str(tmp_path / "q.csv"), "DS", "gnss").count() == 0


KML = """<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>
<Placemark><name>one</name><ExtendedData><SchemaData><SimpleData name="gat_no">007</SimpleData></SchemaData></ExtendedData>
<MultiGeometry><Polygon><outerBoundaryIs><LinearRing><coordinates>74,16,0 74.1,16,0 74.1,16.1,0 74,16,0</coordinates></LinearRing></outerBoundaryIs>
<innerBoundaryIs><LinearRing><coordinates>74.05,16.01 74.06,16.01 74.06,16.02 74.05,16.01</coordinates></LinearRing></innerBoundaryIs></Polygon>
<Polygon><outerBoundaryIs><LinearRing><coordinates>75,16 75.1,16 75.1,16.1 75,16</coordinates></LinearRing></outerBoundaryIs></Polygon></MultiGeometry></Placemark>
<Placemark><ExtendedData><Data name="kind"><value> pipe </value></Data></ExtendedData><LineString><coordinates>74,16
 74.2,16.2 x,y</coordinates></LineString></Placemark>
<Placemark><name>dot</name><Point><coordinates>74.5,16.5</coordinates></Point></Placemark>
<Placemark><name>nothing</name></Placemark></Document></kml>"""


@pytest.mark.parametrize("kmz", [False, True])
def test_read_kml(spark, tmp_path, kmz):
    path = tmp_path / ("a.kmz" if kmz else "a.kml")
    if kmz:
        with zipfile.ZipFile(path, "w") as z:
            z.writestr("readme.txt", "x")
            z.writestr("doc.kml", KML)
    else:
        path.write_text(KML)
    rows = readers.read_kml(spark, str(path), "DS", "revenue").orderBy("ordinal").collect()
    assert [r.kind for r in rows] == ["MultiPolygon", "LineString", "Point"]
    assert rows[0].properties == {"name": "one", "gat_no": "007"} and rows[1].properties == {"kind": "pipe"}
    assert [len(p) for p in rows[0].geom.parts] == [1, 1] and len(rows[1].geom.parts[0][0]) == 2


def test_wrapped_files_hold_a_bounded_number_of_rows(spark, tmp_path):
    marks = spark.range(0, 95, 1, 1).select(F.format_string("<Placemark><name>n%d</name><Point><coordinates>74,16</coordinates></Point></Placemark>", "id"))
    sinks.write_wrapped(marks, str(tmp_path / "k"), "<kml><Document>", "", "</Document></kml>", rows_per_file=10)
    held = [f.read_text().count("<Placemark>") for f in (tmp_path / "k").glob("part-*")]
    assert sum(held) == 95 and len(held) == 10 and max(held) <= 12
    rows = readers.read_kml(spark, str(tmp_path / "k"), "DS", "revenue").select(F.col("properties")["name"].alias("n")).collect()
    assert sorted(r.n for r in rows) == sorted(f"n{i}" for i in range(95))


def test_read_kml_without_features(spark, tmp_path):
    (tmp_path / "e.kml").write_text("<kml><Placemark><name>x</name></Placemark></kml>")
    with pytest.raises(ValueError):
        readers.read_kml(spark, str(tmp_path / "e.kml"), "DS", "revenue")


def test_written_files_read_back(spark, sf, tmp_path):
    parcels = tables.parcels(spark, sf)
    n = parcels.count()
    sinks.write_geojson(parcels, str(tmp_path / "lines"))
    back = readers.read_geojson(spark, str(tmp_path / "lines"), "DS", "cadastral")
    assert back.count() == parcels.where("geometry_geojson is not null").count()
    sinks.write_csv(parcels, str(tmp_path / "csv"))
    csv = spark.read.csv(str(tmp_path / "csv"), header=True)
    assert csv.count() == n and len(csv.columns) == 15
    sinks.write_geojson_collection(parcels.coalesce(1), str(tmp_path / "doc"))
    text = next((tmp_path / "doc").glob("part-*")).read_text()
    assert len(json.loads(text)["features"]) == n


def test_snapshot(spark, sf, tmp_path):
    path = str(tmp_path / "snap")
    assert sinks.load_snapshot(spark, path).count() == 0
    parcels = tables.parcels(spark, sf)
    sinks.save_snapshot(parcels, path, "a")
    sinks.save_snapshot(parcels.where("c_nationkey < 3"), path, "b")
    assert sinks.load_snapshot(spark, path).count() == parcels.where("c_nationkey < 3").count()


def test_audit_is_appended_newest_first(spark, tmp_path):
    path = str(tmp_path / "audit")
    for day in (1, 3, 2):
        sinks.append_audit(spark.sql(
            f"select 'a' actor, 'x' action, 'conflict' resource_type, 'r{day}' resource_id, cast(null as string) before_state, "
            f"'s' after_state, timestamp'2024-01-0{day}' created_at"), path)
    assert [r.resource_id for r in sinks.audit_log(spark, path, 2).collect()] == ["r3", "r2"]
    assert sinks.audit_log(spark, path, 0).count() == 1


def test_report_bundle(spark, sf, tmp_path):
    sinks.export_report_bundle(str(tmp_path), matches=tables.matches(spark, sf), conflicts=tables.conflicts(spark, sf))
    assert spark.read.json(str(tmp_path / "conflicts")).count() == tables.conflicts(spark, sf).count()


def test_report_bundle_is_whole_and_small(spark, tmp_path):
    rows = spark.range(20_000).selectExpr(
        "concat('MT-', id) id", "concat('GRP-', pmod(hash(id), 900)) matched_group_id", "pmod(hash(id, 1), 1000) / 10 overall_confidence")
    sinks.export_report_bundle(str(tmp_path / "bundle"), matches=rows, other=rows)
    rows.write.json(str(tmp_path / "plain"))

    def size(name):
        return sum(f.stat().st_size for f in (tmp_path / name).rglob("part-*"))

    for name in ("matches", "other"):
        assert sorted(spark.read.json(str(tmp_path / "bundle" / name)).select(*rows.columns).collect()) == sorted(rows.collect())
        assert 0 < 3 * size(f"bundle/{name}") < size("plain")
    files = sorted((tmp_path / "bundle" / "matches").glob("part-*"))
    surest = [r.overall_confidence for f in files for r in spark.read.json(str(f)).collect()]
    assert surest == sorted(surest, reverse=True)


def test_file_checksums(spark, tmp_path):
    import hashlib
    (tmp_path / "f.bin").write_bytes(b"abc")
    assert readers.file_checksums(spark, str(tmp_path)).first().sha256 == hashlib.sha256(b"abc").hexdigest()


def test_checksums_of_odd_and_long_files(spark, tmp_path, monkeypatch):
    """Whatever bytes and names they have, and where ranges and records end, without a whole file in a row."""
    import gzip
    import hashlib
    import random

    rng = random.Random(4)
    texts = {
        "line.txt": b"a\n", "open.txt": b"a\r\nb", "break.txt": b"\n", "mark.csv": b"\xef\xbb\xbfid,name\n1,x\n",
        "mark_open.csv": b"\xef\xbb\xbfid", "mark_only.csv": b"\xef\xbb\xbf", "late_mark.bin": b"\n\xef\xbb\xbf\n\n", "real.gz": gzip.compress(rng.randbytes(5000)), "UPPER.GZ": b"x\ny",
        **{f"no{ending}": b"not packed" + ending.encode() for ending in checksums.CODECS}, "noise": rng.randbytes(400_000), "zero.tif": bytes(300_000),
        "a b [1]*{c},d%20.json": b"[" + b"1," * 40_000 + b"1]", "plain.raw": b"\xff" * 20_000, "sub/deep.parquet": b"\n" * 70_000 + rng.randbytes(9)}
    for name, data in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    monkeypatch.setattr(checksums, "LONGEST", 30_000)
    for size, longest in (("64k", "45000"), ("1g", "2147483647")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", longest)
        try:
            rows = readers.file_checksums(spark, str(tmp_path)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
        assert {r.path.removeprefix(f"file:{tmp_path}/"): (r.length, r.sha256) for r in rows} == {
            n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in texts.items()}
        assert len(rows) == len(texts)


def test_documents():
    assert set(readers.DOCUMENT_PATTERNS) == {"survey_number", "khata_number", "area_text"}


def test_document_fields(spark):
    df = spark.createDataFrame([("Gat No. 12/A, KHATA number: 7 area: 2.5 Hectare",), ("nothing",)], "text string")
    a, b = readers.extract_document_fields(df).collect()
    assert (a.survey_number, a.khata_number, a.area_text) == ("12/A", "7", "2.5 Hectare")
    assert (b.survey_number, b.khata_number, b.area_text) == (None, None, None)


def test_upload_stream_runs_once_per_commit(spark, sf, tmp_path):
    uploads, out, progress = (str(tmp_path / d) for d in ("up", "features", "progress"))
    raw = lens.features(spark, sf, ("utility",), mapped=False).select(
        "dataset_id", "source_type", "ordinal", "properties", geo.to_geojson(F.col("geom")).alias("geometry_geojson"))
    seen = []
    for _ in range(2):
        raw.write.mode("append").json(uploads)
        incremental_ingest(spark, uploads, out, progress, lambda df, i: seen.append(df.count())).awaitTermination()
    assert seen == [raw.count(), 2 * raw.count()]


def test_search_hides_owners_from_other_roles(spark, sf):
    p = tables.parcels(spark, sf)
    assert search.search_parcels(p, search="customer#", role="viewer").count() == 0
    assert search.search_parcels(p, search="customer#", role="reviewer").count() == p.count()
    assert search.search_conflicts(tables.conflicts(spark, sf), role="viewer").where("conflict_type = 'owner_mismatch'").isEmpty()


def test_mixed_folder_is_read_whole(spark, tmp_path):
    """Each file by its own first line, in either order of their names."""
    import json

    point = lambda i: {"type": "Feature", "geometry": {"type": "Point", "coordinates": [73.0 + i / 1000, 18.0]}, "properties": {"id": str(i)}}
    for k, (first, second) in enumerate((("a", "b"), ("b", "a"))):
        folder = tmp_path / f"mixed{k}"
        folder.mkdir()
        (folder / f"{first}.geojson").write_text("\n".join(json.dumps(point(i)) for i in range(50)))
        (folder / f"{second}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [point(i) for i in range(50, 55)]}, indent=1))
        assert readers.read_geojson(spark, str(folder), "D", "gnss").count() == 55


def test_quantiles_read_their_values_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(k, float((i * 37) % 101) / (k + 1)) for k in range(3) for i in range(300)]
    values = spark.createDataFrame(rows, "k int, v double").mapInArrow(counted, "k int, v double")
    found = {r.k: r.q for r in readers.exact_quantiles(values, ["k"], "v", (0.02, 0.98)).collect()}
    for k in range(3):
        own = sorted(v for key, v in rows if key == k)
        for p, q in zip((0.02, 0.98), found[k]):
            at = p * (len(own) - 1)
            low = int(at)
            assert abs(own[low] + (own[min(low + 1, len(own) - 1)] - own[low]) * (at - low) - q) < 1e-9
    assert seen.value == len(rows)
