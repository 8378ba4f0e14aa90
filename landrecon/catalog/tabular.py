"""Queries on result tables, sources, mappings, statistics, changes and contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from landrecon import lens
from landrecon.catalog import tables as t
from landrecon.catalog.oracle import lens_sql, table_sql
from landrecon.catalog.registry import query
from landrecon.functions import geo, scalar
from landrecon.operators import (
    changes, conflicts, contracts, mapping, match, search, search_index, skew, stats, topology, unify, versions)
from landrecon.operators.rounds import Rounds
from landrecon.settings import Settings
from landrecon.sources import readers, sinks

_SCORES = ", ".join(match.SCORES)
_P_OUT = ["id", "parcel_id", "owner_name", "land_use", "validation_status", "conflict_status", "confidence_score"]
_P_SQL = ", ".join(_P_OUT)

# --- searches -----------------------------------------------------------------------------


@query("search_parcels", table_sql(f"""
SELECT {_P_SQL} FROM parcels WHERE (parcel_id ILIKE '%9%' OR owner_name ILIKE '%9%') AND land_use = 'MACHINERY'
  AND confidence_score >= 20 ORDER BY confidence_score DESC, id LIMIT 500"""))
def search_parcels(spark, sf_dir):
    return search.search_parcels(t.parcels(spark, sf_dir), search="9", land_use="MACHINERY", min_confidence=20).select(_P_OUT)


@query("search_parcels_restricted", table_sql("""
SELECT id, parcel_id, 'REDACTED' AS owner_name, confidence_score FROM parcels WHERE parcel_id ILIKE '%p-1%'
  AND validation_status = 'PASSED' AND conflict_status = 'NONE' ORDER BY id ASC LIMIT 2000"""))
def search_parcels_restricted(spark, sf_dir):
    return search.search_parcels(
        t.parcels(spark, sf_dir), search="p-1", validation_status="PASSED", conflict_status="NONE", sort_by="id",
        sort_dir="asc", limit=2000, role="viewer").select("id", "parcel_id", "owner_name", "confidence_score")


@query("search_parcels_indexed", table_sql(f"""
SELECT {_P_SQL} FROM parcels WHERE (parcel_id ILIKE '%p-12%' OR owner_name ILIKE '%p-12%' OR parcel_id ILIKE '%00012%' OR owner_name ILIKE '%00012%')
  AND confidence_score >= 20 ORDER BY confidence_score DESC, id LIMIT 2000"""))
def search_parcels_indexed(spark, sf_dir):
    """Two terms, looked up in the trigrams of all parcels."""
    folder = Rounds(spark).path()
    search_index.write_index(t.parcels(spark, sf_dir), folder)
    one, two = (search_index.search_parcels(spark, folder, term=w, min_confidence=20, limit=2000) for w in ("p-12", "00012"))
    return search.top_parcels(one.unionByName(two).dropDuplicates(["id"]), limit=2000).select(_P_OUT)


@query("top_parcels", table_sql("SELECT id, area FROM parcels ORDER BY area DESC NULLS LAST, id LIMIT 2000"))
def top_parcels(spark, sf_dir):
    return search.top_parcels(t.parcels(spark, sf_dir), "area", "desc", 2000).select("id", "area")


@query("parcel_detail", table_sql("SELECT id, 'REDACTED' AS owner_name, area FROM parcels WHERE id = 'UP-7'"))
def parcel_detail(spark, sf_dir):
    return search.parcel_detail(t.parcels(spark, sf_dir), "UP-7", "surveyor").select("id", "owner_name", "area")


@query("redact_owner", table_sql("SELECT id, 'REDACTED' AS owner_name FROM parcels"))
def redact_owner(spark, sf_dir):
    return search.redact_owner(t.parcels(spark, sf_dir), "viewer").select("id", "owner_name")


@query("search_matches", table_sql(f"""
SELECT id, matched_group_id, {_SCORES} FROM matches WHERE overall_confidence >= 60
ORDER BY overall_confidence DESC, id LIMIT 3000"""))
def search_matches(spark, sf_dir):
    return search.search_matches(t.matches(spark, sf_dir), min_confidence=60, limit=3000).select(
        "id", "matched_group_id", *match.SCORES)


@query("top_matches", table_sql("SELECT id, overall_confidence FROM matches ORDER BY overall_confidence DESC, id LIMIT 3000"))
def top_matches(spark, sf_dir):
    return search.top_matches(t.matches(spark, sf_dir), 3000).select("id", "overall_confidence")


@query("search_conflicts", table_sql("""
SELECT id, conflict_type, severity, created_at FROM conflicts
WHERE conflict_type <> 'owner_mismatch' AND status = 'Open' AND severity = 'MAJOR' ORDER BY created_at DESC"""))
def search_conflicts(spark, sf_dir):
    return search.search_conflicts(t.conflicts(spark, sf_dir), status="Open", severity="MAJOR", role="viewer").select(
        "id", "conflict_type", "severity", "created_at")


@query("search_changes", table_sql("""
SELECT id, change_type, before, before AS after FROM (
  SELECT id, change_type, '{"parcel_id":"P-' || user_id || '","owner_name":"REDACTED"}' AS before, detected_at
  FROM changes WHERE change_type = 'modified') ORDER BY id"""))
def search_changes(spark, sf_dir):
    return search.search_changes(t.change_events(spark, sf_dir), "modified", "viewer").select(
        "id", "change_type", "before", "after")


@query("search_mappings", table_sql("SELECT id, source_field, canonical_field FROM mappings WHERE dataset_id = 'DS-Brand#11'"))
def search_mappings(spark, sf_dir):
    return search.search_mappings(t.mappings(spark, sf_dir), "DS-Brand#11").select("id", "source_field", "canonical_field")


@query("mask_personal_fields", lens_sql("""
SELECT feature_id, CASE WHEN owner IS NULL THEN NULL ELSE 'REDACTED' END AS owner, land_use FROM lens
WHERE source_type IN ('cadastral', 'revenue')"""))
def mask_personal_fields(spark, sf_dir):
    b = lens.boxes(spark, sf_dir, ("cadastral", "revenue")).withColumn("p", scalar.mask_personal_fields(F.col("properties")))
    return b.select("feature_id", F.coalesce(F.col("p")["owner"], F.col("p")["landholder"]).alias("owner"),
                    F.coalesce(F.col("p")["land_use"], F.col("p")["classification"]).alias("land_use"))


@query("map_layer_features", table_sql("""
SELECT id, parcel_id, CASE WHEN area IS NOT NULL AND area <> 0 THEN printf('%.1f', area) || ' m²' ELSE 'N/A' END AS area,
  CAST(floor(confidence_score + 0.5) AS INT) || '%' AS confidence FROM parcels WHERE shaped"""))
def map_layer_features(spark, sf_dir):
    return search.map_layer_features(t.parcels(spark, sf_dir)).select("id", "parcel_id", "area", "confidence")


@query("subset_by_keys", lens_sql("""
SELECT feature_id FROM lens WHERE (source_type IN ('cadastral', 'revenue') AND id_key IN
    (SELECT 'P-' || c_custkey FROM customer WHERE c_nationkey < 13))
  OR (source_type = 'municipal' AND ordinal IN (SELECT c_custkey FROM customer WHERE c_nationkey < 13))
UNION ALL SELECT feature_id FROM (SELECT feature_id, row_number() OVER (ORDER BY ordinal) AS rn FROM ut) WHERE rn <= 12"""))
def subset_by_keys(spark, sf_dir):
    keys = lens.table(spark, sf_dir, "customer").where("c_nationkey < 13").select(
        F.concat(F.lit("P-"), "c_custkey").alias("parcel_id"))
    return search.subset_by_keys(lens.features(spark, sf_dir, mapped=False), keys).select("feature_id")


@query("topology_evidence", table_sql("""
SELECT id, dataset_id, feature_id, issue_type, is_valid, corrected, original_geometry, corrected_geometry FROM validation
ORDER BY dataset_id, id"""))
def topology_evidence(spark, sf_dir):
    return search.topology_evidence(t.validation(spark, sf_dir))


@query("parcel_provenance", table_sql("""
SELECT id, CASE WHEN o IS NULL OR o % 2 <> 0 THEN 'user_upload' ELSE 'user_upload, Recorded' END AS provenance FROM parcels"""))
def parcel_provenance(spark, sf_dir):
    return t.parcels(spark, sf_dir).select("id", scalar.parcel_provenance(F.col("lineage")).alias("provenance"))


@query("recent_jobs", table_sql("SELECT id, status, started_at FROM jobs ORDER BY started_at DESC, id LIMIT 20"))
def recent_jobs(spark, sf_dir):
    return search.recent_jobs(t.jobs(spark, sf_dir)).select("id", "status", "started_at")


@query("dataset_catalog", table_sql(
    "SELECT dataset_id, name, provenance, uploaded_at, feature_count FROM datasets ORDER BY uploaded_at DESC"))
def dataset_catalog(spark, sf_dir):
    return search.dataset_catalog(t.declared_datasets(spark, sf_dir)).select(
        "dataset_id", "name", "provenance", "uploaded_at", "feature_count")


# --- sources and sinks --------------------------------------------------------------------


@query("read_geojson", lens_sql("""
SELECT feature_id AS name, source_type, canonical_type, kind, n_fields, round(lon, 8) AS lon, round(lat, 8) AS lat, true AS is_valid FROM lens"""))
def read_geojson(spark, sf_dir):
    """The layers, written as FeatureCollection files and read back from them."""
    folder = Rounds(spark).path()
    for source in lens.LAYERS:
        one = lens.features(spark, sf_dir, (source,), mapped=False)
        named = F.map_concat("properties", F.create_map(F.lit("_name"), F.col("feature_id")))
        sinks.write_features(one.withColumn("properties", named), f"{folder}/{source}")
    source = F.regexp_extract("file", "([a-z]+)/[^/]*$", 1)
    out = readers.read_geojson(spark, f"{folder}/*", F.concat(F.lit("DS-"), source), source)
    return out.select(F.col("properties")["_name"].alias("name"), "source_type", "canonical_type", "kind",
                      (F.size("properties") - 1).alias("n_fields"), F.round("centroid_lon", 8).alias("lon"),
                      F.round("centroid_lat", 8).alias("lat"), "is_valid")


@query("read_csv_points", """
SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, value AS lat, value * 2 - 100 AS lon FROM events
WHERE event_type <> 'view' AND value BETWEEN -90 AND 90 AND value * 2 - 100 BETWEEN -180 AND 180""")
def read_csv_points(spark, sf_dir):
    e = lens.table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("event_id"), "event_type",
        F.when(F.col("event_type") == "view", "unknown").otherwise(F.col("value").cast("string")).alias("latitude"),
        (F.col("value") * 2 - 100).cast("string").alias("longitude"))
    folder, p = Rounds(spark).path(), F.col("properties")
    e.write.option("header", True).csv(folder)
    return readers.read_csv_points(spark, folder, "DS-gnss", "gnss").select(
        p["event_id"].alias("event_id"), p["event_type"].alias("event_type"), F.col("centroid_lat").alias("lat"), F.col("centroid_lon").alias("lon"))


@query("read_kml", lens_sql("""
SELECT feature_id AS name, id_key AS code, kind, round(xmin, 8) AS xmin, round(ymax, 8) AS ymax FROM lens
WHERE source_type IN ('cadastral', 'utility')"""))
def read_kml(spark, sf_dir):
    """Placemarks of the layers, written to files and read by the KML reader."""
    f = lens.features(spark, sf_dir, ("cadastral", "utility"), mapped=False)
    tokens = F.array_join(F.transform(geo.points(F.col("geom")), lambda p: F.concat(p["x"], F.lit(","), p["y"], F.lit(",0"))), " ")
    area = F.concat(F.lit("<Polygon><outerBoundaryIs><LinearRing><coordinates>"), tokens,
                    F.lit("</coordinates></LinearRing></outerBoundaryIs></Polygon>"))
    line = F.concat(F.lit("<LineString><coordinates>"), tokens, F.lit("</coordinates></LineString>"))
    code = F.coalesce(F.concat(F.lit('<ExtendedData><Data name="code"><value>'), F.col("properties")["parcel_id"],
                               F.lit("</value></Data></ExtendedData>")), F.lit(""))
    xml = F.concat(F.lit("<Placemark><name>"), "feature_id", F.lit("</name>"), code,
                   F.when(F.col("kind") == "Polygon", area).otherwise(line), F.lit("</Placemark>"))
    folder = Rounds(spark).path()
    sinks.write_wrapped(f.select(xml.alias("value")), folder, '<kml xmlns="http://www.opengis.net/kml/2.2"><Document>', "", "</Document></kml>",
                        rows_per_file=50_000)
    out = readers.read_kml(spark, folder, "DS", "cadastral")
    return out.select(F.col("properties")["name"].alias("name"), F.col("properties")["code"].alias("code"), "kind",
                      F.round("xmin", 8).alias("xmin"), F.round("ymax", 8).alias("ymax"))


@query("raster_footprint", """
SELECT p_partkey AS raster_id, 'transformed' AS status, round((x + x + w) / 2 / (6378137e0 * pi() / 180), 6) AS lon,
  round((atan(sinh(y / 6378137e0)) + atan(sinh((y + w) / 6378137e0))) / 2 * 180 / pi(), 6) AS lat
FROM (SELECT p_partkey, 8200000e0 + p_partkey AS x, 1800000e0 + p_partkey AS y, p_size * 10e0 AS w FROM part)""")
def raster_footprint(spark, sf_dir):
    k = F.col("p_partkey")
    meta = lens.table(spark, sf_dir, "part").select(
        k.alias("raster_id"), (F.lit(8200000.0) + k).alias("left"), (F.lit(1800000.0) + k).alias("bottom"),
        (F.lit(8200000.0) + k + F.col("p_size") * 10.0).alias("right"),
        (F.lit(1800000.0) + k + F.col("p_size") * 10.0).alias("top"), F.lit("EPSG:3857").alias("crs"))
    return readers.raster_footprint(meta).select(
        "raster_id", "status", F.round("centroid_lon", 6).alias("lon"), F.round("centroid_lat", 6).alias("lat"))


def _pixels(spark, sf_dir):
    return lens.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("raster_id"), F.when(F.col("l_linenumber") <= 4, 1).otherwise(2).alias("band"),
        F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("quantity"))


@query("raster_band_stats", """
SELECT l_suppkey AS raster_id, count(*) FILTER (ok) AS valid_pixels, min(l_quantity) FILTER (ok) AS sample_min,
  max(l_quantity) FILTER (ok) AS sample_max, round(avg(l_quantity) FILTER (ok), 4) AS sample_mean
FROM (SELECT *, l_linenumber <= 4 AND l_quantity <> 50 AS ok FROM lineitem) GROUP BY 1""")
def raster_band_stats(spark, sf_dir):
    px = _pixels(spark, sf_dir).select("raster_id", "band", F.col("quantity").alias("value"), F.lit(50.0).alias("nodata"))
    return readers.raster_band_stats(px)


@query("raster_tile_grid", """
SELECT p_partkey AS raster_id, x AS "left", y AS top, least(768, w - x) AS tile_width, least(768, h - y) AS tile_height
FROM (SELECT *, unnest(generate_series(0, h - 1, 672)) AS y FROM (
  SELECT *, unnest(generate_series(0, w - 1, 672)) AS x FROM (
    SELECT p_partkey, p_size * 100 + 500 AS w, p_size * 60 + 300 AS h FROM part)))""")
def raster_tile_grid(spark, sf_dir):
    return readers.raster_tile_grid(lens.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("raster_id"), (F.col("p_size") * 100 + 500).alias("width"),
        (F.col("p_size") * 60 + 300).alias("height")))


@query("percentile_stretch", """
SELECT raster_id, band, CAST(floor(greatest(0e0, least(255e0, (v - q[1]) * (255e0 / (q[2] - q[1]))))) AS INT) AS level, count(*) AS pixels
FROM (SELECT l_suppkey AS raster_id, CASE WHEN l_linenumber <= 4 THEN 1 ELSE 2 END AS band, l_extendedprice AS v FROM lineitem)
JOIN (SELECT l_suppkey AS raster_id, CASE WHEN l_linenumber <= 4 THEN 1 ELSE 2 END AS band,
    quantile_cont(l_extendedprice, [0.02, 0.98]) AS q FROM lineitem GROUP BY 1, 2) USING (raster_id, band)
GROUP BY 1, 2, 3""")
def percentile_stretch(spark, sf_dir):
    out = readers.percentile_stretch(_pixels(spark, sf_dir).select("raster_id", "band", "value"))
    return out.groupBy("raster_id", "band", "level").agg(F.count(F.lit(1)).alias("pixels"))


@query("extract_document_fields", r"""
SELECT doc_id, trim(nullif(regexp_extract(text, '(?i)(?:survey|gat|cts)\s*(?:no\.?|number)?\s*[:#-]?\s*([A-Za-z0-9/-]+)', 1), '')) AS survey_number,
  trim(nullif(regexp_extract(text, '(?i)(?:khata)\s*(?:no\.?|number)?\s*[:#-]?\s*([A-Za-z0-9/-]+)', 1), '')) AS khata_number,
  trim(nullif(regexp_extract(text, '(?i)(?:area|क्षेत्र)\s*[:#-]?\s*([0-9.,]+\s*(?:ha|hectare|acre|sq\.?\s*m)?)', 1), '')) AS area_text,
  substr(text, 1, 3000) AS text_preview FROM documents""")
def extract_document_fields(spark, sf_dir):
    docs = lens.table(spark, sf_dir, "documents").select("doc_id", "text")
    return readers.extract_document_fields(docs).drop("text")


@query("write_geojson", table_sql("""
SELECT id, NOT shaped AS no_geometry, parcel_id, CAST(building_count AS INT) AS building_count, confidence_score,
  strftime(last_updated, '%Y-%m-%dT%H:%M:%S') AS last_updated FROM parcels"""))
def write_geojson(spark, sf_dir):
    """The written files, parsed again."""
    folder = Rounds(spark).path()
    sinks.write_geojson(t.parcels(spark, sf_dir), folder)
    lines = spark.read.text(folder).select(F.from_json(
        "value", "geometry string, properties struct<id:string,parcel_id:string,building_count:int,"
                 "confidence_score:double,last_updated:string>").alias("f"))
    return lines.select("f.properties.id", F.col("f.geometry").isNull().alias("no_geometry"), "f.properties.parcel_id",
                        "f.properties.building_count", "f.properties.confidence_score", "f.properties.last_updated")


@query("write_csv", table_sql("""
SELECT id, parcel_id, survey_number, owner_name, area, land_use, building_count, utility_count, gnss_verified,
  ground_truth_verified, source_count, confidence_score, validation_status, conflict_status,
  strftime(last_updated, '%Y-%m-%dT%H:%M:%S') AS last_updated FROM parcels"""))
def write_csv(spark, sf_dir):
    """The written files, read again with the types of the rows."""
    folder, parcels = Rounds(spark).path(), t.parcels(spark, sf_dir)
    sinks.write_csv(parcels, folder)
    return spark.read.schema(sinks.csv_rows(parcels).schema).csv(folder, header=True)


@query("save_snapshot", table_sql("""
SELECT id, parcel_id, owner_name, area, land_use, building_count, NOT shaped AS no_geometry FROM parcels"""))
def save_snapshot(spark, sf_dir):
    """Saved to the checkpoint folder and loaded again."""
    import uuid

    Rounds(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/snapshots-{uuid.uuid4().hex}"
    sinks.save_snapshot(t.parcels(spark, sf_dir), folder, "run-1")
    out = sinks.load_snapshot(spark, folder)
    return out.select("id", "parcel_id", "owner_name", "area", "land_use", "building_count",
                      F.col("geometry_geojson").isNull().alias("no_geometry"))


@query("export_report_bundle", table_sql("""
SELECT 'unified_records' AS section, count(*) AS records FROM parcels
UNION ALL SELECT 'matches', count(*) FROM matches UNION ALL SELECT 'conflicts', count(*) FROM conflicts
UNION ALL SELECT 'changes', count(*) FROM changes UNION ALL SELECT 'mappings', count(*) FROM mappings
UNION ALL SELECT 'topology', count(*) FROM validation UNION ALL SELECT 'datasets', count(*) FROM datasets"""))
def export_report_bundle(spark, sf_dir):
    """A bundle written to files, each section counted from them."""
    folder = Rounds(spark).path()
    tables = dict(
        unified_records=t.parcels(spark, sf_dir), matches=t.matches(spark, sf_dir), conflicts=t.conflicts(spark, sf_dir),
        changes=t.change_events(spark, sf_dir), mappings=t.mappings(spark, sf_dir), topology=t.validation(spark, sf_dir),
        datasets=t.declared_datasets(spark, sf_dir))
    sinks.export_report_bundle(folder, **tables)
    out = None
    for name in tables:
        one = spark.read.text(f"{folder}/{name}").agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("section"), "records")
        out = one if out is None else out.unionByName(one)
    return out


@query("file_checksums")
def file_checksums(spark, sf_dir):
    return readers.file_checksums(spark, sf_dir).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length", "sha256")


def _decisions(spark, sf_dir):
    """Every line item of a returned order decides the conflict it stands for."""
    li = lens.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'")
    return li.select(
        F.concat_ws("-", F.lit("CF"), "l_orderkey", "l_linenumber", "l_partkey").alias("id"),
        F.when(F.col("l_linenumber") <= 2, "Accepted").when(F.col("l_linenumber") <= 4, "Under Review").otherwise("Closed").alias("new_status"),
        F.lit("reviewer").alias("actor"), F.col("l_shipdate").alias("decided_at"))


_DECIDED = """
decided AS (
  SELECT 'CF-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, max(l_shipdate) AS decided_at,
    CASE WHEN l_linenumber <= 2 THEN 'Accepted' ELSE 'Under Review' END AS new_status
  FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber <= 4 GROUP BY 1, l_linenumber)"""


@query("resolve_conflict", table_sql("""
SELECT c.id, c.severity, coalesce(d.new_status, c.status) AS status,
  CASE WHEN d.new_status = 'Accepted' THEN d.decided_at ELSE c.resolved_at END AS resolved_at
FROM conflicts c LEFT JOIN decided d USING (id)""", _DECIDED))
def resolve_conflict(spark, sf_dir):
    out, _ = conflicts.resolve_conflict(t.conflicts(spark, sf_dir), _decisions(spark, sf_dir))
    return out.select("id", "severity", "status", "resolved_at")


@query("append_audit", table_sql("""
SELECT 'reviewer' AS actor, 'conflict.status_changed' AS action, id AS resource_id, d.decided_at AS created_at
FROM conflicts JOIN decided d USING (id)""", _DECIDED))
def append_audit(spark, sf_dir):
    """Appended to the audit table and read from it."""
    _, audit = conflicts.resolve_conflict(t.conflicts(spark, sf_dir), _decisions(spark, sf_dir))
    folder = Rounds(spark).path()
    sinks.append_audit(audit, folder)
    return spark.read.schema(sinks.AUDIT_SCHEMA).parquet(folder).select("actor", "action", "resource_id", "created_at")


@query("audit_log", table_sql("SELECT id, started_at AS created_at FROM jobs ORDER BY started_at DESC, id LIMIT 500"))
def audit_log(spark, sf_dir):
    """The jobs as entries, appended in two goes, and the newest of them."""
    none = F.lit(None).cast("string")
    rows = t.jobs(spark, sf_dir).select(F.lit("system").alias("actor"), F.lit("job.started").alias("action"), F.lit("job").alias("resource_type"),
                                        F.col("id").alias("resource_id"), none.alias("before_state"), F.col("status").alias("after_state"),
                                        F.col("started_at").cast("timestamp").alias("created_at"))
    folder = Rounds(spark).path()
    for part in (0, 1):
        sinks.append_audit(rows.where(F.pmod(F.xxhash64("resource_id"), F.lit(2)) == part), folder)
    return sinks.audit_log(spark, folder, 9999).select(F.col("resource_id").alias("id"), "created_at")


@query("delete_dataset", lens_sql("""
SELECT dataset_id, count(*) AS features FROM lens WHERE source_type NOT IN ('gnss', 'utility') GROUP BY 1"""))
def delete_dataset(spark, sf_dir):
    gone = lens.datasets(spark, sf_dir).where(F.col("source_type").isin("gnss", "utility"))
    left = contracts.delete_dataset({"features": lens.boxes(spark, sf_dir)}, gone)["features"]
    return left.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("features"))


@query("incremental_ingest", lens_sql("SELECT dataset_id, source_type, canonical_type, count(*) AS features FROM lens GROUP BY ALL"))
def incremental_ingest(spark, sf_dir):
    """All layers as uploaded raw files that a file stream picks up and turns into features."""
    import uuid

    from landrecon.streaming.ingest import incremental_ingest as watch

    Rounds(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/ingest-{uuid.uuid4().hex}"
    lens.features(spark, sf_dir, mapped=False).select(
        "dataset_id", "source_type", "ordinal", "properties", geo.to_geojson(F.col("geom")).alias("geometry_geojson")
    ).write.json(f"{folder}/uploads")
    watch(spark, f"{folder}/uploads", f"{folder}/features", f"{folder}/progress").awaitTermination()
    return spark.read.parquet(f"{folder}/features").groupBy("dataset_id", "source_type", "canonical_type").agg(
        F.count(F.lit(1)).alias("features"))


# --- joins --------------------------------------------------------------------------------


@query("link_conflicts_to_parcels", table_sql("""
SELECT c.id, c.feature_ref, c.status, CASE WHEN c.status = 'Open' THEN p.id END AS parcel_id
FROM conflicts c LEFT JOIN parcels p ON c.l_orderkey = p.o"""))
def link_conflicts_to_parcels(spark, sf_dir):
    out = conflicts.link_conflicts_to_parcels(t.conflicts(spark, sf_dir), t.parcels(spark, sf_dir))
    return out.select("id", "feature_ref", "status", "parcel_id")


@query("conflict_status", table_sql("""
SELECT p.id, CASE max(CASE WHEN c.severity = 'MAJOR' THEN 2 WHEN c.severity IS NOT NULL THEN 1 ELSE 0 END)
  WHEN 2 THEN 'MAJOR' WHEN 1 THEN 'MINOR' ELSE 'NONE' END AS conflict_status
FROM parcels p LEFT JOIN conflicts c ON c.l_orderkey = p.o AND c.status = 'Open' GROUP BY 1"""))
def conflict_status(spark, sf_dir):
    return conflicts.conflict_status(t.parcels(spark, sf_dir), t.conflicts(spark, sf_dir)).select("id", "conflict_status")


def _overrides(spark, sf_dir):
    return t.mappings(spark, sf_dir).where("confidence > 90").select(
        "dataset_id", "source_field", F.lit("survey_number").alias("canonical_field"), "manual_override")


@query("manual_override_join", table_sql("""
SELECT dataset_id, source_field, CASE WHEN p_size > 45 THEN 'survey_number' ELSE canonical_field END AS canonical_field,
  CASE WHEN p_size > 45 THEN 100 ELSE confidence END AS confidence,
  CASE WHEN p_size > 45 THEN 'manual_override' ELSE method END AS method, p_size > 45 AS manual_override FROM mappings"""))
def manual_override_join(spark, sf_dir):
    return mapping.manual_override_join(t.mappings(spark, sf_dir).drop("manual_override", "id"), _overrides(spark, sf_dir))


@query("override_mapping", table_sql("""
SELECT id, CASE WHEN p_partkey IN (SELECT o_orderkey FROM orders) AND p_size > 30 THEN 'ward' ELSE canonical_field END AS canonical_field,
  (p_partkey IN (SELECT o_orderkey FROM orders) AND p_size > 30) OR manual_override AS manual_override,
  CASE WHEN p_partkey IN (SELECT o_orderkey FROM orders) AND p_size > 30 THEN 100 ELSE confidence END AS confidence FROM mappings"""))
def override_mapping(spark, sf_dir):
    m = t.mappings(spark, sf_dir)
    wide = lens.table(spark, sf_dir, "part").where("p_size > 30").select(F.col("p_partkey").alias("o_orderkey"))
    asked = lens.table(spark, sf_dir, "orders").join(wide, "o_orderkey").select(
        F.concat(F.lit("AM-"), "o_orderkey").alias("id"), F.lit("ward").alias("new_field"),
        F.lit("reviewer").alias("actor"), F.col("o_orderdate").alias("decided_at"))
    return mapping.override_mapping(m, asked)[0].select("id", "canonical_field", "manual_override", "confidence")


@query("orphan_check", table_sql("""
SELECT id, feature_ref FROM conflicts WHERE l_orderkey NOT IN (SELECT o FROM parcels WHERE o IS NOT NULL)"""))
def orphan_check(spark, sf_dir):
    known = t.parcels(spark, sf_dir).select(F.explode(F.map_values("lineage")).alias("s")).select("s.feature_id")
    return contracts.orphan_check(t.conflicts(spark, sf_dir), "feature_ref", known, "feature_id").select("id", "feature_ref")


# --- versions and changes -----------------------------------------------------------------


def _version_one(spark, sf_dir):
    f = lens.features(spark, sf_dir, ("cadastral",), mapped=False)
    return f.withColumn("geometry_geojson", geo.to_geojson(F.col("geom")))


def _version_two(spark, sf_dir):
    """The cadastral layer later: one nation gone, one moved, one with new owners."""
    nations = lens.table(spark, sf_dir, "customer").select(F.col("c_custkey"), "c_nationkey")
    f = lens.features(spark, sf_dir, ("cadastral",), mapped=False).withColumn("c_custkey", F.floor(F.col("ordinal") / 4))
    f = f.join(nations, "c_custkey").where("c_nationkey <> 5")
    moved = F.when(F.col("c_nationkey") == 13, geo.box_geom(
        F.col("xmin") + 1e-5, F.col("ymin"), F.col("xmax") + 1e-5, F.col("ymax"))).otherwise(F.col("geom"))
    owner = F.when(F.col("c_nationkey") == 17, F.lit("New owner")).otherwise(F.col("properties")["owner"])
    bag = F.map_concat(F.map_filter("properties", lambda k, v: k != "owner"), F.create_map(F.lit("owner"), owner))
    return f.withColumns({"geometry_geojson": geo.to_geojson(moved), "properties": bag, "dataset_id": F.lit("DS-cadastral-2")})


_VERSIONS = """
v1 AS (SELECT 'parcel_id:' || id_key AS key, arg_max(feature_id, ordinal) AS feature_id, max(c_nationkey) AS nation FROM cad GROUP BY 1),
v2 AS (SELECT * FROM v1 WHERE nation <> 5),
events2 AS (
  SELECT v1.key, v1.feature_id AS feature_ref, 'removed' AS change_type FROM v1 WHERE nation = 5
  UNION ALL SELECT key, feature_id, 'geometry_changed' FROM v2 WHERE nation = 13
  UNION ALL SELECT key, feature_id, 'attribute_changed' FROM v2 WHERE nation = 17)"""


@query("version_keys_diff", lens_sql("SELECT key, CASE WHEN nation = 5 THEN 'removed' ELSE 'common' END AS state FROM v1", _VERSIONS))
def version_keys_diff(spark, sf_dir):
    return changes.version_keys_diff(_version_one(spark, sf_dir), _version_two(spark, sf_dir))


@query("keys_added", lens_sql("SELECT key FROM v1 WHERE nation = 5", _VERSIONS))
def keys_added(spark, sf_dir):
    return changes.keys_added(_version_two(spark, sf_dir), _version_one(spark, sf_dir))


@query("keys_removed", lens_sql("SELECT key FROM v1 WHERE nation = 5", _VERSIONS))
def keys_removed(spark, sf_dir):
    return changes.keys_removed(_version_one(spark, sf_dir), _version_two(spark, sf_dir))


@query("keys_common", lens_sql("SELECT key FROM v2", _VERSIONS))
def keys_common(spark, sf_dir):
    return changes.keys_common(_version_one(spark, sf_dir), _version_two(spark, sf_dir))


@query("source_version_changes", lens_sql(
    "SELECT 'cadastral' AS source_type, key, feature_ref, change_type, 100e0 AS confidence FROM events2", _VERSIONS))
def source_version_changes(spark, sf_dir):
    old = lens.datasets(spark, sf_dir, ("cadastral",))
    new = old.withColumns({"dataset_id": F.lit("DS-cadastral-2"), "uploaded_at": F.col("uploaded_at") + F.expr("INTERVAL 1 DAY")})
    one, two = _version_one(spark, sf_dir), _version_two(spark, sf_dir)
    both = one.unionByName(two.select(one.columns))
    return changes.source_version_changes(both, old.unionByName(new)).drop("before", "after")


def _stored_versions(spark, sf_dir):
    folder = Rounds(spark).path()
    for name, df in (("one", _version_one(spark, sf_dir)), ("two", _version_two(spark, sf_dir))):
        versions.save_version(df, f"{folder}/{name}")
    return f"{folder}/one", f"{folder}/two"


@query("stored_version_changes", lens_sql("SELECT key, feature_ref, change_type, 100e0 AS confidence FROM events2", _VERSIONS))
def stored_version_changes(spark, sf_dir):
    """Both versions stored with their digest trees; only leaves that differ are joined."""
    return versions.stored_changes(spark, *_stored_versions(spark, sf_dir)).drop("before", "after")


@query("stored_version_keys", lens_sql("SELECT key, CASE WHEN nation = 5 THEN 'removed' ELSE 'common' END AS state FROM v1", _VERSIONS))
def stored_version_keys(spark, sf_dir):
    return versions.stored_keys(spark, *_stored_versions(spark, sf_dir))


@query("baseline_follow_up_changes", lens_sql("""
SELECT 'demo-change-' || substr(sha256(change_type || ':' || key), 1, 20) AS id, key, feature_ref, change_type FROM events2""", _VERSIONS))
def baseline_follow_up_changes(spark, sf_dir):
    one, two = _version_one(spark, sf_dir), _version_two(spark, sf_dir)
    return changes.baseline_follow_up_changes(one, two, two.where("false")).select("id", "key", "feature_ref", "change_type")


@query("follow_up_changes", lens_sql("""
SELECT 'property_id:B-' || p_partkey AS key, CASE WHEN p_size > 25 THEN 'attribute_changed' ELSE 'removed' END AS change_type
FROM part WHERE p_size > 25 OR p_size <= 5"""))
def follow_up_changes(spark, sf_dir):
    """No shared key between the versions, so the follow-up layer is compared instead."""
    base = lens.features(spark, sf_dir, ("municipal",), mapped=False).withColumn("geometry_geojson", geo.to_geojson(F.col("geom")))
    size = lens.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), "p_size")
    later = base.join(size, "ordinal").where("p_size > 5")
    use = F.when(F.col("p_size") > 25, "rebuilt").otherwise(F.col("properties")["usage_type"])
    later = later.withColumn("properties", F.map_concat(
        F.map_filter("properties", lambda k, v: k != "usage_type"), F.create_map(F.lit("usage_type"), use)))
    other = base.withColumn("properties", F.create_map(F.lit("asset_id"), F.col("feature_id")))
    return changes.baseline_follow_up_changes(base, other, later).select("key", "change_type")


@query("latest_two_versions", table_sql("""
SELECT dataset_id, source_type, version FROM (SELECT *, row_number() OVER (PARTITION BY source_type
  ORDER BY uploaded_at DESC, dataset_id DESC) AS version FROM datasets) WHERE version <= 2"""))
def latest_two_versions(spark, sf_dir):
    return changes.latest_two_versions(t.declared_datasets(spark, sf_dir)).select("dataset_id", "source_type", "version")


@query("parcel_changes", table_sql("""
SELECT parcel_id, id AS feature_ref, 'removed' AS change_type, 80e0 AS confidence FROM parcels WHERE c_nationkey = 5
UNION ALL SELECT 'X-' || c_custkey, id, 'new', confidence_score FROM parcels WHERE c_nationkey = 6
UNION ALL SELECT parcel_id, id, 'removed', 80e0 FROM parcels WHERE c_nationkey = 6
UNION ALL SELECT parcel_id, id, 'attribute_changed', confidence_score FROM parcels WHERE c_nationkey = 9
UNION ALL SELECT parcel_id, id, 'modified', confidence_score FROM parcels WHERE c_nationkey = 15
UNION ALL SELECT parcel_id, id, 'geometry_changed', round((1 - (area * 1.25e0 - area) / (area * 1.25e0)) * 100, 1) FROM parcels
  WHERE c_nationkey = 12 AND area > 0"""))
def parcel_changes(spark, sf_dir):
    was = t.parcels(spark, sf_dir)
    n = F.col("c_nationkey")
    now = was.where("c_nationkey <> 5").withColumns({
        "parcel_id": F.when(n == 6, F.concat(F.lit("X-"), F.substring("id", 4, 20))).otherwise(F.col("parcel_id")),
        "owner_name": F.when(n == 9, F.lit("Heirs")).otherwise(F.col("owner_name")),
        "building_count": F.when(n == 15, F.col("building_count") + 1).otherwise(F.col("building_count")),
        "area": F.when(n == 12, F.col("area") * 1.25).otherwise(F.col("area"))})
    return changes.parcel_changes(was, now).select("parcel_id", "feature_ref", "change_type", "confidence")


@query("change_counts", table_sql("SELECT change_type, count(*) AS changes FROM changes GROUP BY 1"))
def change_counts(spark, sf_dir):
    return changes.change_counts(t.change_events(spark, sf_dir))


@query("summarize_change", table_sql("""
SELECT id, CASE change_type WHEN 'new' THEN 'Added feature · P-' || user_id
  WHEN 'removed' THEN 'Feature removed · P-' || user_id
  WHEN 'geometry_changed' THEN 'Feature geometry differs between source versions'
  WHEN 'modified' THEN 'Attributes changed: a, b, c, d +1 more' ELSE 'Source feature differs' END AS summary FROM changes"""))
def summarize_change(spark, sf_dir):
    e = t.change_events(spark, sf_dir).withColumns({
        c: F.from_json(c, "map<string,string>") for c in ("before", "after")})
    extra = F.from_json(F.lit('{"a":"1","b":"1","c":"1","d":"1","e":"1"}'), "map<string,string>")
    after = F.when(F.col("change_type") == "modified", F.map_concat("after", extra)).otherwise(F.col("after"))
    return e.select("id", scalar.summarize_change(F.col("change_type"), F.col("before"), after).alias("summary"))


@query("stable_event_id", table_sql("""
SELECT id, 'demo-change-' || substr(sha256(change_type || ':' || feature_ref), 1, 20) AS event_id FROM changes"""))
def stable_event_id(spark, sf_dir):
    e = t.change_events(spark, sf_dir)
    return e.select("id", scalar.stable_event_id(F.col("change_type"), F.col("feature_ref")).alias("event_id"))


@query("feature_key", lens_sql("""
SELECT feature_id, CASE source_type WHEN 'cadastral' THEN 'parcel_id:' || id_key WHEN 'revenue' THEN 'survey_no:' || id_key
  WHEN 'municipal' THEN 'property_id:' || id_key WHEN 'gnss' THEN 'point_id:' || ordinal END AS key FROM lens"""))
def feature_key(spark, sf_dir):
    return lens.boxes(spark, sf_dir).select("feature_id", scalar.feature_key(F.col("properties")).alias("key"))


# --- aggregates ---------------------------------------------------------------------------


@query("quality_score", """
SELECT 'DS-' || c_nationkey AS dataset_id, round((0.6 * avg((c_acctbal > 0)::INT) + 0.4 * avg(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 / 3e0
  WHEN c_acctbal > 5000 THEN 1e0 ELSE 2 / 3e0 END)) * 100, 1) AS quality_score FROM customer GROUP BY 1""")
def quality_score(spark, sf_dir):
    c = lens.table(spark, sf_dir, "customer")
    blank = F.col("c_mktsegment") == "BUILDING"
    bag = F.create_map(F.lit("id"), F.col("c_name"), F.lit("use"), F.when(blank, "NULL").otherwise(F.col("c_mktsegment")),
                       F.lit("value"), F.when(blank, "").when(F.col("c_acctbal") > 5000, "high"))
    return stats.quality_score(c.select(F.concat(F.lit("DS-"), "c_nationkey").alias("dataset_id"),
                                        (F.col("c_acctbal") > 0).alias("is_valid"), bag.alias("properties")))


@query("statistics", table_sql("""
SELECT (SELECT count(*) FROM parcels) AS total_parcels, (SELECT sum(building_count) FROM parcels) AS total_buildings,
  (SELECT round(avg(confidence_score), 1) FROM parcels) AS average_confidence, (SELECT count(*) FROM datasets) AS total_datasets,
  (SELECT count(*) FROM matches) AS matched_features, (SELECT count(*) FROM conflicts) AS total_conflicts,
  (SELECT count(*) FROM conflicts WHERE status = 'Open') AS open_conflicts,
  (SELECT count(*) FROM validation WHERE NOT is_valid) AS topology_errors, (SELECT count(*) FROM changes) AS changes_detected"""))
def statistics(spark, sf_dir):
    return stats.statistics(t.declared_datasets(spark, sf_dir), t.parcels(spark, sf_dir), t.matches(spark, sf_dir),
                            t.conflicts(spark, sf_dir), t.validation(spark, sf_dir), t.change_events(spark, sf_dir))


@query("confidence_distribution", table_sql("""
SELECT band, count(id) AS matches FROM (VALUES ('High'), ('Medium'), ('Low')) b(band) LEFT JOIN matches
ON band = CASE WHEN overall_confidence >= 90 THEN 'High' WHEN overall_confidence >= 70 THEN 'Medium' ELSE 'Low' END GROUP BY 1"""))
def confidence_distribution(spark, sf_dir):
    return stats.confidence_distribution(t.matches(spark, sf_dir))


@query("conflict_categories", table_sql("SELECT conflict_type, count(*) AS conflicts FROM conflicts GROUP BY 1"))
def conflict_categories(spark, sf_dir):
    return stats.conflict_categories(t.conflicts(spark, sf_dir))


_BRANDS = """
brands AS (SELECT DISTINCT 'DS-' || p_brand AS dataset_id, p_brand AS name FROM part),
quality AS (SELECT dataset_id, name, coalesce(bad, 0) AS invalid_geometry_count FROM brands LEFT JOIN
  (SELECT dataset_id, count(*) AS bad FROM validation WHERE NOT is_valid GROUP BY 1) USING (dataset_id))"""


def _report(spark, sf_dir):
    brands = lens.table(spark, sf_dir, "part").select(
        F.concat(F.lit("DS-"), "p_brand").alias("dataset_id"), F.col("p_brand").alias("name")).distinct()
    return stats.data_quality_report(brands, t.validation(spark, sf_dir))


@query("data_quality_report", table_sql("SELECT * FROM quality", _BRANDS))
def data_quality_report(spark, sf_dir):
    return _report(spark, sf_dir)


@query("total_invalid_geometries", table_sql("SELECT sum(invalid_geometry_count) AS total_invalid FROM quality", _BRANDS))
def total_invalid_geometries(spark, sf_dir):
    return stats.total_invalid_geometries(_report(spark, sf_dir))


@query("mean_parcel_confidence", table_sql("SELECT round(avg(confidence_score), 1) AS mean_confidence FROM parcels"))
def mean_parcel_confidence(spark, sf_dir):
    return stats.mean_parcel_confidence(t.parcels(spark, sf_dir))


@query("group_confidence", table_sql("""
SELECT matched_group_id, count(*) AS matches, """ + ", ".join(f"round(avg({s}), 4) AS {s}" for s in match.SCORES) + """
FROM matches WHERE overall_confidence >= 40 GROUP BY 1"""))
def group_confidence(spark, sf_dir):
    return search.group_confidence(t.matches(spark, sf_dir), 40)


_ORDER_MEMBERS = """
member AS (SELECT 'GRP-' || o_custkey AS g, o_orderkey, o_orderpriority AS source_type,
  CASE WHEN rn = 1 THEN NULL ELSE round(o_totalprice / 5000, 1) END AS c,
  CASE WHEN rn = 1 THEN NULL ELSE round(o_totalprice / 5500, 1) END AS s,
  CASE WHEN rn = 1 THEN NULL ELSE round(o_totalprice / 8500, 1) END AS a,
  CASE WHEN rn = 1 THEN NULL ELSE round(o_totalprice / 6500, 1) END AS g2, rn - 1 AS r, o_orderstatus
  FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders))"""


def _order_members(spark, sf_dir):
    """Orders of a customer as members of one group, the first being its anchor."""
    o = lens.table(spark, sf_dir, "orders").withColumn("group", F.concat(F.lit("GRP-"), "o_custkey"))
    o = skew.running_position(o, ["group"], "o_orderkey", "place")
    p = F.col("o_totalprice")

    def score(by):
        return F.when(F.col("place") > 1, F.round(p / by, 1))

    return o.select(
        F.col("group").alias("matched_group_id"), F.concat(F.lit("R-"), "o_orderkey").alias("feature_id"),
        (F.col("place") - 1).cast("int").alias("member_rank"), F.col("o_orderpriority").alias("source_type"),
        score(5000).alias("overall_confidence"), score(5500).alias("spatial_proximity"),
        score(8500).alias("attribute_similarity"), score(6500).alias("geometry_overlap"),
        F.create_map(F.lit("owner_name"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("Owner "), "o_orderkey")),
                     F.lit("land_use"), F.when(F.col("o_orderstatus") == "O", F.lit("")).otherwise(F.col("o_orderpriority")),
                     F.lit("parcel_id"), F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("P-"), "o_orderkey"))).alias("canonical"))


@query("parcel_confidence", table_sql("""
SELECT g AS matched_group_id, CASE WHEN n > 0 THEN m ELSE agree END AS confidence_score, spatial_confidence, attribute_confidence,
  geometry_confidence, agree AS source_agreement, source_count,
  CASE WHEN CASE WHEN n > 0 THEN m ELSE agree END >= 70 THEN 'PASSED' ELSE 'FAILED' END AS validation_status
FROM (SELECT g, count(c) AS n, coalesce(round(sum(round(c * 10)::BIGINT) / count(c) / 10, 1), 0) AS m, coalesce(round(sum(round(s * 10)::BIGINT) / count(s) / 10, 1), 0) AS spatial_confidence,
  coalesce(round(sum(round(a * 10)::BIGINT) / count(a) / 10, 1), 0) AS attribute_confidence, coalesce(round(sum(round(g2 * 10)::BIGINT) / count(g2) / 10, 1), 0) AS geometry_confidence,
  count(DISTINCT source_type) AS source_count, round(least(100, count(DISTINCT source_type) / 5e0 * 100), 1) AS agree
  FROM member GROUP BY 1)""", _ORDER_MEMBERS))
def parcel_confidence(spark, sf_dir):
    return unify.parcel_confidence(_order_members(spark, sf_dir))


@query("first_value_per_group", table_sql("""
SELECT g AS matched_group_id,
  coalesce('Owner ' || arg_min(o_orderkey, r) FILTER (o_orderstatus = 'F'), 'Unknown') AS owner_name,
  coalesce(arg_min(source_type, r) FILTER (o_orderstatus <> 'O'), 'Unclassified') AS land_use,
  'P-' || arg_min(o_orderkey, r) FILTER (o_orderstatus = 'P') AS survey_number,
  coalesce('P-' || arg_min(o_orderkey, r) FILTER (o_orderstatus = 'P'), 'R-' || arg_min(o_orderkey, r)) AS parcel_id
FROM member GROUP BY 1""", _ORDER_MEMBERS))
def first_value_per_group(spark, sf_dir):
    return unify.first_value_per_group(_order_members(spark, sf_dir))


@query("workspace_capacity", lens_sql("""
SELECT 5 AS datasets, count(*) AS features, sum(CASE kind WHEN 'Polygon' THEN 5 WHEN 'LineString' THEN 2 ELSE 1 END) AS vertices,
  false AS datasets_full, count(*) > 1000 AS features_exceeded,
  sum(CASE kind WHEN 'Polygon' THEN 5 WHEN 'LineString' THEN 2 ELSE 1 END) > 25000 AS vertices_exceeded FROM lens"""))
def workspace_capacity(spark, sf_dir):
    f = lens.features(spark, sf_dir, mapped=False).select(geo.to_geojson(F.col("geom")).alias("geometry_geojson"))
    return stats.workspace_capacity(f, lens.datasets(spark, sf_dir))


@query("feature_count_reconciliation", table_sql("""
SELECT dataset_id, feature_count AS declared, coalesce(n, 0) AS actual, coalesce(n, 0) = feature_count AND feature_count > 0 AS agrees
FROM datasets LEFT JOIN (SELECT 'DS-' || c_nationkey AS dataset_id, count(*) AS n FROM customer GROUP BY 1) USING (dataset_id)"""))
def feature_count_reconciliation(spark, sf_dir):
    c = lens.table(spark, sf_dir, "customer").select(F.concat(F.lit("DS-"), "c_nationkey").alias("dataset_id"))
    return stats.feature_count_reconciliation(t.declared_datasets(spark, sf_dir), c)


_PROFILE = {"cadastral": ("land_use", "owner", "parcel_id"), "revenue": ("classification", "landholder", "survey_no"),
            "municipal": ("linked_parcel", "plot_area", "property_id", "usage_type"), "gnss": ("accuracy_m", "point_id"),
            "utility": ("utility_id",)}
_FIELDS = ", ".join(f"('DS-{s}', '{f}')" for s, fs in _PROFILE.items() for f in fs)


@query("dataset_field_profile", lens_sql(f"""
SELECT f.dataset_id, f.source_field, true AS sampled,
  CASE WHEN source_field IN ('land_use', 'classification', 'usage_type') THEN land_use
    WHEN source_field IN ('owner', 'landholder') THEN owner
    WHEN source_field IN ('parcel_id', 'survey_no', 'property_id') THEN id_key
    WHEN source_field = 'linked_parcel' THEN 'P-' || ordinal
    WHEN source_field = 'plot_area' THEN CAST((SELECT p_retailprice FROM part WHERE p_partkey = ordinal) AS VARCHAR)
    WHEN source_field = 'accuracy_m' THEN (SELECT props->>'$.k' FROM events WHERE event_id = ordinal)
    WHEN source_field = 'point_id' THEN CAST(ordinal AS VARCHAR) ELSE feature_id END AS sample_value
FROM (VALUES {_FIELDS}) f(dataset_id, source_field)
JOIN (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY ordinal) AS rn FROM lens) l ON l.dataset_id = f.dataset_id AND rn = 1"""))
def dataset_field_profile(spark, sf_dir):
    return mapping.dataset_field_profile(lens.boxes(spark, sf_dir))


@query("field_name_union", f"SELECT * FROM (VALUES {_FIELDS}) f(dataset_id, source_field)")
def field_name_union(spark, sf_dir):
    return mapping.field_name_union(lens.boxes(spark, sf_dir))


@query("pilot_readiness", lens_sql("""
SELECT check_id, required, status FROM (VALUES ('aoi', true, 'PASS'), ('cadastral', true, 'PASS'), ('revenue', true, 'PASS'),
  ('municipal', true, 'PASS'), ('gnss', true, 'PASS'), ('imagery', true, 'BLOCKER'), ('utilities', false, 'PASS'),
  ('terrain', false, 'RECOMMENDED')) c(check_id, required, status) WHERE (SELECT count(*) FROM gn) >= 10"""))
def pilot_readiness(spark, sf_dir):
    return stats.pilot_readiness(lens.datasets(spark, sf_dir), lens.boxes(spark, sf_dir), True).select(
        "check_id", "required", "status")


@query("snapshot_record_counts", table_sql("""
SELECT n AS table_name, actual, declared, actual = declared AS agrees FROM (
  SELECT 'matches' AS n, count(*) AS actual, (SELECT count(*) FROM orders) AS declared FROM matches
  UNION ALL SELECT 'conflicts', count(*), (SELECT count(*) FROM orders) FROM conflicts
  UNION ALL SELECT 'parcels', count(*), (SELECT count(*) FROM customer) FROM parcels)"""))
def snapshot_record_counts(spark, sf_dir):
    n = F.count(F.lit(1)).alias("declared")
    orders = lens.table(spark, sf_dir, "orders").agg(n)
    declared = (orders.select(F.lit("matches").alias("table_name"), "declared")
                .unionByName(orders.select(F.lit("conflicts").alias("table_name"), "declared"))
                .unionByName(lens.table(spark, sf_dir, "customer").agg(n).select(F.lit("parcels").alias("table_name"), "declared")))
    return stats.snapshot_record_counts({"matches": t.matches(spark, sf_dir), "conflicts": t.conflicts(spark, sf_dir),
                                         "parcels": t.parcels(spark, sf_dir)}, declared)


@query("pipeline_output_ready", table_sql("""
SELECT (SELECT count(*) FROM parcels) AS parcels, (SELECT count(*) FROM parcels WHERE confidence_score > 0) AS scored,
  (SELECT count(*) FROM matches) AS matches, (SELECT count(*) FROM mappings) AS mappings, (SELECT count(*) FROM validation) AS validation,
  EXISTS (SELECT 1 FROM done) AS stages_completed,
  (SELECT max(total) FROM totals JOIN done USING (job_id)) AS total_processed,
  EXISTS (SELECT 1 FROM totals JOIN done USING (job_id) WHERE total = (SELECT count(*) FROM parcels)) AS ready
FROM (SELECT 1)""", """
last_report AS (SELECT job_id, name, arg_max(status, position) AS status FROM stage_log GROUP BY 1, 2),
done AS (SELECT job_id FROM last_report WHERE status = 'completed' AND name <> 'Change Detection' GROUP BY 1 HAVING count(*) = 9),
totals AS (SELECT user_id AS job_id, (SELECT count(*) FROM customer) - min(user_id) % 2 AS total FROM events GROUP BY 1)"""))
def pipeline_output_ready(spark, sf_dir):
    customers = lens.table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n"))
    jobs = lens.table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id")).distinct()
    total = jobs.join(F.broadcast(customers)).select("job_id", (F.col("n") - F.col("job_id") % 2).alias("total_processed"))
    return stats.pipeline_output_ready(t.matches(spark, sf_dir), t.mappings(spark, sf_dir), t.validation(spark, sf_dir),
                                       t.parcels(spark, sf_dir), t.stage_log(spark, sf_dir), total)


# --- windows ------------------------------------------------------------------------------


@query("earliest_original_geometry", table_sql("""
SELECT feature_id, original_geometry, issue_type FROM (SELECT *, row_number() OVER (PARTITION BY feature_id
  ORDER BY original_geometry IS NULL, position) AS rn FROM validation) WHERE rn = 1"""))
def earliest_original_geometry(spark, sf_dir):
    return topology.earliest_original_geometry(t.validation(spark, sf_dir))


@query("group_numbering", """
SELECT c_custkey, 'GRP-' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS matched_group_id
FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_nationkey, c_custkey) AS n FROM customer)""")
def group_numbering(spark, sf_dir):
    c = lens.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return match.group_numbering(c, ["c_nationkey", "c_custkey"]).select("c_custkey", "matched_group_id")


@query("latest_stage_status", table_sql("""
SELECT job_id, name, min(position) AS place, arg_max(status, position) AS status, arg_max(detail, position) AS detail
FROM stage_log GROUP BY 1, 2"""))
def latest_stage_status(spark, sf_dir):
    return stats.latest_stage_status(t.stage_log(spark, sf_dir)).select("job_id", "name", "place", "status", "detail")


@query("stage_metrics", lens_sql("""
SELECT 0 AS position, 'Ingestion' AS name, count(*) AS processed, 0 AS warnings FROM lens
UNION ALL SELECT 1, 'Spatial Matching', (SELECT count(*) FROM orders), (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')"""))
def stage_metrics(spark, sf_dir):
    from landrecon.plans.harmonize import _count
    from landrecon.plans.harmonize import stage_metrics as metrics

    orders = lens.table(spark, sf_dir, "orders")
    return metrics(spark, {"Ingestion": _count(lens.boxes(spark, sf_dir)), "Spatial Matching": _count(
        orders, (F.col("o_orderstatus") == "F").cast("int"))}).select("position", "name", "processed", "warnings")


# --- scalars ------------------------------------------------------------------------------


@query("normalize_field", "SELECT p_partkey, replace(replace(lower(trim('  ' || p_name || '-' || p_type || ' ')), ' ', '_'), '-', '_') AS field FROM part")
def normalize_field(spark, sf_dir):
    raw = F.concat(F.lit("  "), "p_name", F.lit("-"), "p_type", F.lit(" "))
    return lens.table(spark, sf_dir, "part").select("p_partkey", scalar.normalize_field(raw).alias("field"))


@query("datatype_bonus", """
SELECT p_partkey, CASE WHEN p_type IN ('SMALL', 'LARGE') THEN CASE WHEN p_size % 2 = 0 THEN 0.08 ELSE -0.05 END
  ELSE CASE WHEN p_size % 2 = 0 THEN -0.02 ELSE 0.03 END END AS bonus FROM part""")
def datatype_bonus(spark, sf_dir):
    value = F.when(F.col("p_size") % 2 == 0, F.col("p_retailprice").cast("string")).otherwise(F.col("p_name"))
    field = F.when(F.col("p_type") == "SMALL", "area").when(F.col("p_type") == "LARGE", "building_count").otherwise("ward")
    return lens.table(spark, sf_dir, "part").select("p_partkey", mapping.datatype_bonus(value, field).cast("double").alias("bonus"))


@query("synonym_score")
def synonym_score(spark, sf_dir):
    return mapping.synonym_scores(mapping.field_name_union(lens.boxes(spark, sf_dir))).withColumn(
        "synonym_score", F.round("synonym_score", 6))


@query("map_fields")
def map_fields(spark, sf_dir):
    return mapping.map_fields(mapping.dataset_field_profile(lens.boxes(spark, sf_dir)))


_EXACT = ", ".join(f"('DS-{s}', '{f}', '{c}')" for s, f, c in (
    ("cadastral", "parcel_id", "parcel_id"), ("cadastral", "owner", "owner_name"), ("cadastral", "land_use", "land_use"),
    ("revenue", "survey_no", "parcel_id"), ("revenue", "landholder", "owner_name"), ("revenue", "classification", "land_use"),
    ("municipal", "property_id", "parcel_id"), ("municipal", "usage_type", "land_use"), ("municipal", "plot_area", "area")))


@query("map_exact_fields", f"""
SELECT dataset_id, source_field, canonical_field, 100e0 AS confidence, 'fuzzy_synonym' AS method
FROM (VALUES {_EXACT}) f(dataset_id, source_field, canonical_field)""")
def map_exact_fields(spark, sf_dir):
    """The fields whose names are listed synonyms."""
    profile = mapping.dataset_field_profile(lens.boxes(spark, sf_dir))
    return mapping.map_fields(profile).where(F.col("confidence") == 100)


@query("schema_mapping")
def schema_mapping(spark, sf_dir):
    return mapping.schema_mapping(lens.boxes(spark, sf_dir))


@query("needs_review", table_sql("SELECT id, confidence / 100 < 0.55 AS needs_review FROM mappings"))
def needs_review(spark, sf_dir):
    return t.mappings(spark, sf_dir).select("id", scalar.needs_review(F.col("confidence")).alias("needs_review"))


@query("apply_mapping", lens_sql("""
SELECT feature_id, owner AS owner_name, land_use, CASE WHEN source_type IN ('cadastral', 'revenue', 'municipal') THEN id_key END AS parcel_id,
  n_fields + CASE source_type WHEN 'cadastral' THEN 1 WHEN 'revenue' THEN 3 WHEN 'municipal' THEN 3 ELSE 0 END AS names FROM lens"""))
def apply_mapping(spark, sf_dir):
    exact = map_exact_fields(spark, sf_dir)
    out = mapping.apply_mapping(lens.boxes(spark, sf_dir), exact)
    c = F.col("canonical")
    return out.select("feature_id", c["owner_name"].alias("owner_name"), c["land_use"].alias("land_use"),
                      c["parcel_id"].alias("parcel_id"), F.size(c).alias("names"))


@query("embedding_similarity", """
SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(greatest(0, least(1, list_inner_product(a.u, b.u))), 6) AS similarity
FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u,
  lead(vec_id) OVER (ORDER BY vec_id) AS nxt FROM embeddings) a
JOIN (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings) b
ON b.vec_id = a.vec_id + 1""")
def embedding_similarity(spark, sf_dir):
    """Each vector with the next one."""
    e = lens.table(spark, sf_dir, "embeddings").select("vec_id", scalar.unit_vector(F.col("embedding")).alias("u"))
    b = e.select(F.col("vec_id").alias("b_id"), F.col("u").alias("v"))
    return e.join(b, F.col("b_id") == F.col("vec_id") + 1).select(
        F.col("vec_id").alias("a_id"), "b_id", F.round(scalar.embedding_similarity(F.col("u"), F.col("v")), 6).alias("similarity"))


@query("confidence_band", table_sql("""
SELECT id, CASE WHEN overall_confidence >= 90 THEN 'High' WHEN overall_confidence >= 70 THEN 'Medium' ELSE 'Low' END AS band FROM matches"""))
def confidence_band(spark, sf_dir):
    return t.matches(spark, sf_dir).select("id", scalar.confidence_band(F.col("overall_confidence")).alias("band"))


def _named_uploads(spark, sf_dir):
    """Orders as uploads whose names, files and fields come from their status and priority."""
    o = lens.table(spark, sf_dir, "orders")
    words = {"1-URGENT": "Cadastral_parcel boundary", "2-HIGH": "revenue khata", "3-MEDIUM": "water pipeline", "4-NOT SPECIFIED": "misc layer",
             "5-LOW": "scene"}
    name = F.create_map(*[F.lit(v) for p in words.items() for v in p])[F.col("o_orderpriority")]
    fields = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("Parcel ID"), F.lit("gat_no"))).when(
        F.col("o_orderstatus") == "O", F.array(F.lit("pipe_diameter"))).otherwise(F.array().cast("array<string>"))
    return o.select(F.col("o_orderkey").alias("dataset_id"), name.alias("name"),
                    F.when(F.col("o_orderpriority") == "5-LOW", "scene.tif").otherwise("layer.geojson").alias("filename"),
                    fields.alias("fields"), F.array().cast("array<string>").alias("geometry_types"))


_CLASSIFIED = """
up AS (SELECT o_orderkey, o_orderpriority, o_orderstatus,
  CASE o_orderpriority WHEN '1-URGENT' THEN 4 ELSE 0 END + CASE o_orderstatus WHEN 'F' THEN 3 ELSE 0 END AS cadastral,
  CASE o_orderpriority WHEN '2-HIGH' THEN 4 ELSE 0 END AS revenue,
  CASE o_orderpriority WHEN '3-MEDIUM' THEN 2 ELSE 0 END + CASE o_orderstatus WHEN 'O' THEN 1.5 ELSE 0 END AS utility,
  o_orderpriority = '5-LOW' AS raster FROM orders),
ranked AS (SELECT *, list_sort([cadastral, revenue, utility], 'DESC') AS s,
  CASE WHEN cadastral >= revenue AND cadastral >= utility THEN 'cadastral' WHEN revenue >= utility THEN 'revenue' ELSE 'utility' END AS top FROM up)"""


@query("classify_source_type", "WITH " + _CLASSIFIED + """
SELECT o_orderkey AS dataset_id, CASE WHEN NOT raster AND s[1] > 0 AND s[1] - s[2] >= 1.5 THEN top END AS suggested_type,
  CASE WHEN raster OR s[1] <= 0 THEN 0 ELSE round(least(0.95, 0.45 + 0.1 * s[1] + 0.08 * (s[1] - s[2])), 2) END::DOUBLE AS confidence,
  true AS needs_review FROM ranked""")
def classify_source_type(spark, sf_dir):
    return mapping.classify_source_type(_named_uploads(spark, sf_dir)).select("dataset_id", "suggested_type", "confidence", "needs_review")


@query("top_source_type_candidates", "WITH " + _CLASSIFIED + """
SELECT o_orderkey AS dataset_id, i AS place, s[i]::DOUBLE AS score FROM ranked, (VALUES (1), (2), (3)) t(i)""")
def top_source_type_candidates(spark, sf_dir):
    return mapping.top_source_type_candidates(mapping.classify_source_type(_named_uploads(spark, sf_dir))).drop("source_type")


@query("canonical_json_sha256")
def canonical_json_sha256(spark, sf_dir):
    return contracts.canonical_json_sha256(t.matches(spark, sf_dir)).select("id", "row_sha256")


@query("table_digest")
def table_digest(spark, sf_dir):
    return contracts.table_digest(t.matches(spark, sf_dir))


# --- contracts ----------------------------------------------------------------------------


@query("preflight_layer", lens_sql("""
SELECT source_type || CASE source_type WHEN 'gnss' THEN '.csv' WHEN 'utility' THEN '.pdf' ELSE '.geojson' END AS filename,
  count(*) AS features, v AS vertices, CASE WHEN source_type = 'utility' THEN 'unsupported_type' WHEN count(*) > 1000 THEN 'too_many_features'
    WHEN v > 25000 THEN 'too_many_vertices' ELSE 'ok' END AS verdict
FROM (SELECT source_type, CASE source_type WHEN 'gnss' THEN count(*) OVER w WHEN 'utility' THEN 2 * count(*) OVER w ELSE 5 * count(*) OVER w END AS v
  FROM lens WINDOW w AS (PARTITION BY source_type)) GROUP BY source_type, v"""))
def preflight_layer(spark, sf_dir):
    ext = F.when(F.col("source_type") == "gnss", ".csv").when(F.col("source_type") == "utility", ".pdf").otherwise(".geojson")
    layer = lens.features(spark, sf_dir, mapped=False).select(
        F.concat("source_type", ext).alias("filename"), geo.to_geojson(F.col("geom")).alias("geometry_geojson"))
    return contracts.preflight_layer(layer, Settings())


@query("check_columns")
def check_columns(spark, sf_dir):
    p = t.parcels(spark, sf_dir).withColumn("token", F.col("id"))
    return contracts.check_columns({"parcels": p}, {"parcels": _P_OUT})


@query("check_geojson", table_sql("SELECT id, '{' || parcel_id AS geometry_geojson FROM parcels WHERE c_nationkey = 9"))
def check_geojson(spark, sf_dir):
    broken = F.when(F.col("c_nationkey") == 9, F.concat(F.lit("{"), "parcel_id")).otherwise(F.col("geometry_geojson"))
    return contracts.check_geojson(t.parcels(spark, sf_dir).withColumn("geometry_geojson", broken), "id")


@query("check_provenance", table_sql("""
SELECT count(*) AS datasets, count(*) FILTER (provenance <> 'synthetic_demo') AS unexpected FROM datasets"""))
def check_provenance(spark, sf_dir):
    return contracts.check_provenance(t.declared_datasets(spark, sf_dir), "synthetic_demo")
