"""Queries on geometry, matching, topology and conflicts over the layer lens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landrecon import lens
from landrecon.catalog.oracle import PAIRS, RAD, SAME_LAYER, box_gap, box_iou, haversine, lens_sql
from landrecon.catalog.registry import query
from landrecon.functions import geo, kernel, scalar
from landrecon.lens import LENS
from landrecon.operators import conflicts, exclusive, match, topology, unify
from landrecon.operators.rounds import Rounds
from landrecon.settings import Settings

_SCORES = ", ".join(match.SCORES)


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = lens.features(spark, sf_dir)
    return f.where(F.col("source_type") == "cadastral"), f


@query("spatial_candidates", lens_sql("""
SELECT a_id AS anchor_id, b_dataset AS dataset_id, count(*) AS candidates, min(b_ordinal) AS first_ordinal,
  max(b_ordinal) AS last_ordinal FROM cand GROUP BY 1, 2""", PAIRS))
def spatial_candidates(spark, sf_dir):
    pairs = match.spatial_candidates(*_split(spark, sf_dir), LENS)
    return pairs.groupBy(F.col("a_feature_id").alias("anchor_id"), F.col("b_dataset_id").alias("dataset_id")).agg(
        F.count(F.lit(1)).alias("candidates"), F.min("b_ordinal").alias("first_ordinal"),
        F.max("b_ordinal").alias("last_ordinal"))


@query("distance_join", lens_sql("""
SELECT a_id AS anchor_id, b_dataset AS dataset_id, count(*) AS candidates, round(min(d), 3) AS nearest_m,
  round(max(d), 3) AS farthest_m FROM near GROUP BY 1, 2""", PAIRS))
def distance_join(spark, sf_dir):
    pairs = match.distance_join(match.spatial_candidates(*_split(spark, sf_dir), LENS), LENS)
    return pairs.groupBy(F.col("a_feature_id").alias("anchor_id"), F.col("b_dataset_id").alias("dataset_id")).agg(
        F.count(F.lit(1)).alias("candidates"), F.round(F.min("distance_m"), 3).alias("nearest_m"),
        F.round(F.max("distance_m"), 3).alias("farthest_m"))


@query("score_pairs", lens_sql(f"SELECT a_id AS anchor_id, b_id AS feature_id, {_SCORES} FROM matched", PAIRS))
def score_pairs(spark, sf_dir):
    pairs = match.distance_join(match.spatial_candidates(*_split(spark, sf_dir), LENS), LENS)
    return match.score_pairs(pairs, LENS).select(
        F.col("a_feature_id").alias("anchor_id"), F.col("b_feature_id").alias("feature_id"), *match.SCORES)


@query("best_match_per_dataset", lens_sql(
    f"SELECT a_id AS anchor_id, b_dataset AS dataset_id, b_id AS feature_id, {_SCORES} FROM best", PAIRS))
def best_match_per_dataset(spark, sf_dir):
    return match.best_match_per_dataset(*_split(spark, sf_dir), LENS).drop("anchor_ordinal")


@query("matched_parcel_confidence", lens_sql("""
SELECT a_id AS anchor_id, count(*) AS sources, round(sum(round(overall_confidence * 10)::BIGINT) / count(*) / 10, 1) AS confidence
FROM best GROUP BY 1""", PAIRS))
def matched_parcel_confidence(spark, sf_dir):
    best = match.best_match_per_dataset(*_split(spark, sf_dir), LENS)
    return best.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("sources"),
                                         unify.mean_score(F.col("overall_confidence")).alias("confidence"))


@query("exclusive_matching")
def exclusive_matching(spark, sf_dir):
    _, matches = exclusive.exclusive_matching(
        lens.features(spark, sf_dir), lens.datasets(spark, sf_dir), LENS)
    return matches


@query("geometry_overlap", lens_sql(f"""
SELECT a.feature_id AS a_id, b.feature_id AS b_id,
  round(CASE WHEN b.kind = 'Polygon' THEN {box_iou('a', 'b')} ELSE exp(-{box_gap('a', 'b', 'a.lat')} / 50e0) END, 6) AS overlap
FROM lens a JOIN lens b ON a.source_type = 'cadastral' AND b.source_type <> 'cadastral'
  AND a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin <= b.ymax AND a.ymax >= b.ymin"""))
def geometry_overlap(spark, sf_dir):
    """The general kernel on flat coordinates, not the rectangle forms."""
    from landrecon.operators import grid

    cfg = Settings(metric="local_plane")
    a, f = _split(spark, sf_dir)
    b = f.where(F.col("source_type") != "cadastral")
    pairs = grid.box_pairs(grid.prefixed(a, "a_"), grid.prefixed(b, "b_"), cfg.same_layer_cell_deg, hot_rows=cfg.hot_rows)
    value = match.geometry_overlap(F.col("a_geom"), F.col("b_geom"), cfg)
    return pairs.select(F.col("a_feature_id").alias("a_id"), F.col("b_feature_id").alias("b_id"),
                        F.round(value, 6).alias("overlap"))


@query("iou", lens_sql(f"""
SELECT a.feature_id AS a_id, b.feature_id AS b_id, round({box_iou('a', 'b')}, 6) AS iou
FROM lens a JOIN lens b ON a.source_type = 'cadastral' AND b.source_type = 'revenue'
  AND a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin <= b.ymax AND a.ymax >= b.ymin"""))
def iou(spark, sf_dir):
    from landrecon.operators import grid

    a = lens.features(spark, sf_dir, ("cadastral",))
    b = lens.features(spark, sf_dir, ("revenue",))
    pairs = grid.box_pairs(grid.prefixed(a, "a_"), grid.prefixed(b, "b_"), LENS.same_layer_cell_deg)
    return pairs.select(F.col("a_feature_id").alias("a_id"), F.col("b_feature_id").alias("b_id"),
                        F.round(kernel.iou(F.col("a_geom"), F.col("b_geom")), 6).alias("iou"))


@query("point_polygon_proximity", lens_sql(f"""
SELECT g.feature_id AS point_id, c.feature_id AS parcel_id,
  round(exp(-{box_gap('c', 'g', 'c.lat')} / 50e0), 6) AS proximity
FROM gn JOIN lens g USING (feature_id) JOIN events e ON g.ordinal = e.event_id
JOIN lens c ON c.feature_id = 'C-' || e.user_id"""))
def point_polygon_proximity(spark, sf_dir):
    """Each survey point against the parcel its user owns, by the general distance kernel."""
    points = lens.features(spark, sf_dir, ("gnss",)).withColumn("event_id", F.col("ordinal"))
    owner = lens.table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("C-"), "user_id").alias("parcel_id"))
    parcels = lens.features(spark, sf_dir, ("cadastral",)).select(
        F.col("feature_id").alias("parcel_id"), F.col("geom").alias("shape"), F.col("centroid_lat").alias("lat"))
    rows = points.join(owner, "event_id").join(parcels, "parcel_id")
    d = kernel.distance_m(F.col("geom"), F.col("shape"), None, F.col("lat"))
    return rows.select(F.col("feature_id").alias("point_id"), "parcel_id", F.round(F.exp(-d / 50.0), 6).alias("proximity"))


@query("spatial_proximity", lens_sql(f"""
SELECT a.feature_id AS a_id, b.feature_id AS b_id,
  round(greatest(0e0, 1 - least(({haversine('a', 'b')}) / 75e0, 1e0)), 6) AS proximity
FROM lens a JOIN lens b ON a.id_key = b.id_key AND a.source_type = 'cadastral' AND b.source_type = 'revenue'"""))
def spatial_proximity(spark, sf_dir):
    pairs = _linked(spark, sf_dir)
    d = geo.haversine_m(F.col("a_centroid_lat"), F.col("a_centroid_lon"), F.col("b_centroid_lat"), F.col("b_centroid_lon"))
    return pairs.select(F.col("a_feature_id").alias("a_id"), F.col("b_feature_id").alias("b_id"),
                        F.round(scalar.spatial_proximity(d), 6).alias("proximity"))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from landrecon.operators import grid

    a = grid.prefixed(lens.features(spark, sf_dir, ("cadastral",)), "a_")
    b = grid.prefixed(lens.features(spark, sf_dir, ("revenue",)), "b_")
    return a.join(b, F.col("a_cmp_parcel_id") == F.col("b_cmp_parcel_id"))


@query("haversine_m", lens_sql(f"""
SELECT a.feature_id AS a_id, b.feature_id AS b_id, round({haversine('a', 'b')}, 4) AS metres
FROM lens a JOIN lens b ON a.id_key = b.id_key AND a.source_type = 'cadastral' AND b.source_type = 'revenue'"""))
def haversine_m(spark, sf_dir):
    d = geo.haversine_m(F.col("a_centroid_lat"), F.col("a_centroid_lon"), F.col("b_centroid_lat"), F.col("b_centroid_lon"))
    return _linked(spark, sf_dir).select(F.col("a_feature_id").alias("a_id"), F.col("b_feature_id").alias("b_id"),
                                         F.round(d, 4).alias("metres"))


@query("area_similarity", lens_sql("""
SELECT a.feature_id AS a_id, b.feature_id AS b_id,
  round(1 - abs(a.area - b.area) / greatest(a.area, b.area), 6) AS similarity
FROM lens a JOIN lens b ON a.id_key = b.id_key AND a.source_type = 'cadastral' AND b.source_type = 'revenue'"""))
def area_similarity(spark, sf_dir):
    return _linked(spark, sf_dir).select(
        F.col("a_feature_id").alias("a_id"), F.col("b_feature_id").alias("b_id"),
        F.round(scalar.area_similarity(F.col("a_area_sqm"), F.col("b_area_sqm")), 6).alias("similarity"))


@query("attribute_similarity")
def attribute_similarity(spark, sf_dir):
    from landrecon.functions import text

    pairs, scores = _linked(spark, sf_dir), []
    names = [("a_cmp_" + f, "b_cmp_" + f) for f in ("owner_name", "land_use", "parcel_id")]
    ratios = Rounds(spark).keep(text.ratio_table(pairs, names))
    for a, b in names:
        pairs = text.look_up(pairs, ratios, a, b, "_" + a)
        scores.append(F.col("_" + a))
    return pairs.select(F.col("a_feature_id").alias("a_id"), F.col("b_feature_id").alias("b_id"),
                        F.round(scalar.attribute_similarity(scores), 6).alias("similarity"))


@query("ratcliff_ratio")
def ratcliff_ratio(spark, sf_dir):
    from landrecon.functions import text

    names = _linked(spark, sf_dir).select("a_cmp_owner_name", "b_cmp_owner_name")
    return text.with_ratio(names, "a_cmp_owner_name", "b_cmp_owner_name", "ratio").select(
        F.col("a_cmp_owner_name").alias("a"), F.col("b_cmp_owner_name").alias("b"), F.round("ratio", 6).alias("ratio"))


# --- projection and measures --------------------------------------------------------------

_n = 1 / 298.257223563 / (2 - 1 / 298.257223563)
_A = 6378137 / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
_C = 2 * _n**0.5 / (1 + _n)
_AL = (_n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16 + 41 * _n**4 / 180, 13 * _n**2 / 48 - 3 * _n**3 / 5 + 557 * _n**4 / 1440,
       61 * _n**3 / 240 - 103 * _n**4 / 140, 49561 * _n**4 / 161280)


def _utm_ctes(source: str) -> str:
    """CTEs that project ``source (feature_id, i, x, y, lon0)`` to ``utm (feature_id, i, e, n)``."""
    east = "eta" + "".join(f" + {a:.17e} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(_AL, 1))
    north = "xi" + "".join(f" + {a:.17e} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(_AL, 1))
    return f"""
u1 AS (SELECT *, sinh(atanh(sin(y * {RAD})) - {_C:.17e} * atanh({_C:.17e} * sin(y * {RAD}))) AS t, (x - lon0) * {RAD} AS dl FROM {source}),
u2 AS (SELECT *, atan2(t, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + t * t)) AS eta FROM u1),
utm AS (SELECT feature_id, i, 500000 + {0.9996 * _A:.17e} * ({east}) AS e, {0.9996 * _A:.17e} * ({north}) AS n FROM u2)"""


_CORNERS = """
corners AS (
  SELECT feature_id, i, CASE WHEN i IN (0, 3) THEN xmin ELSE xmax END AS x, CASE WHEN i < 2 THEN ymin ELSE ymax END AS y,
    floor((lon + 180) / 6) * 6 - 177e0 AS lon0
  FROM lens, (VALUES (0), (1), (2), (3)) t(i) WHERE kind = 'Polygon')"""


@query("area_sqm", lens_sql("""
SELECT a.feature_id, round(abs(sum((a.e - o.e) * (b.n - o.n) - (b.e - o.e) * (a.n - o.n))) / 2, 2) AS area_sqm
FROM utm a JOIN utm b ON a.feature_id = b.feature_id AND b.i = (a.i + 1) % 4
JOIN utm o ON o.feature_id = a.feature_id AND o.i = 0 GROUP BY 1""", _CORNERS, _utm_ctes("corners")))
def area_sqm(spark, sf_dir):
    f = lens.features(spark, sf_dir, ("cadastral", "revenue", "municipal"), mapped=False)
    return f.select("feature_id", F.round(geo.area_sqm(F.col("geom")), 2).alias("area_sqm"))


@query("reproject", lens_sql("""
SELECT feature_id, 'transformed' AS status, round(e, 3) AS easting, round(n, 3) AS northing FROM utm""", """
pts AS (SELECT feature_id, 0 AS i, lon AS x, lat AS y, 75e0 AS lon0 FROM lens WHERE kind = 'Point')""", _utm_ctes("pts")))
def reproject(spark, sf_dir):
    f = lens.features(spark, sf_dir, ("gnss",), mapped=False)
    moved = f.withColumn("m", geo.reproject(F.col("geom"), F.lit("EPSG:4326"), F.lit("EPSG:32643")))
    p = geo.points(F.col("m.geom"))[0]
    return moved.select("feature_id", F.col("m.status").alias("status"), F.round(p["x"], 3).alias("easting"),
                        F.round(p["y"], 3).alias("northing"))


@query("reproject_datum", lens_sql("""
SELECT feature_id, 'transformed' AS status, round(2743195.5 + r * sin(t), 2) AS easting, round(914398.5 + r0 - r * cos(t), 2) AS northing
FROM conic""", """
own AS (SELECT 6377299.151e0 AS a, (2 - 1 / 300.8017255e0) / 300.8017255e0 AS e2, 6378137e0 AS wa,
  (2 - 1 / 298.257223563e0) / 298.257223563e0 AS we2, sin(radians(19e0)) AS n),
centred AS (SELECT feature_id, o.*, wa / sqrt(1 - we2 * pow(sin(radians(lat)), 2)) AS v, radians(lat) AS f, radians(lon) AS l
  FROM lens, own o WHERE kind = 'Point'),
moved AS (SELECT *, v * cos(f) * cos(l) - 295 AS x, v * cos(f) * sin(l) - 736 AS y, v * (1 - we2) * sin(f) - 257 AS z FROM centred),
lat0 AS (SELECT *, sqrt(x * x + y * y) AS w, atan2(z, sqrt(x * x + y * y) * sqrt(1 - e2)) AS u FROM moved),
lat1 AS (SELECT *, atan2(z + e2 / sqrt(1 - e2) * a * pow(sin(u), 3), w - e2 * a * pow(cos(u), 3)) AS g FROM lat0),
lat2 AS (SELECT *, atan2(sqrt(1 - e2) * sin(g), cos(g)) AS u2 FROM lat1),
geo AS (SELECT *, atan2(z + e2 / sqrt(1 - e2) * a * pow(sin(u2), 3), w - e2 * a * pow(cos(u2), 3)) AS p, atan2(y, x) AS q FROM lat2),
widths AS (SELECT *, tan(pi() / 4 - p / 2) / pow((1 - sqrt(e2) * sin(p)) / (1 + sqrt(e2) * sin(p)), sqrt(e2) / 2) AS tp,
  tan(pi() / 4 - radians(19e0) / 2) / pow((1 - sqrt(e2) * n) / (1 + sqrt(e2) * n), sqrt(e2) / 2) AS t0,
  a * 0.99878641e0 * cos(radians(19e0)) / sqrt(1 - e2 * n * n) / n AS r0 FROM geo),
conic AS (SELECT feature_id, r0, r0 * pow(tp / t0, n) AS r, n * (q - radians(80e0)) AS t FROM widths)"""))
def reproject_datum(spark, sf_dir):
    """Survey points in a conic zone on another ellipsoid and datum."""
    f = lens.features(spark, sf_dir, ("gnss",), mapped=False)
    moved = f.withColumn("m", geo.reproject(F.col("geom"), F.lit("EPSG:4326"), F.lit("EPSG:24381")))
    p = geo.points(F.col("m.geom"))[0]
    return moved.select("feature_id", F.col("m.status").alias("status"), F.round(p["x"], 2).alias("easting"),
                        F.round(p["y"], 2).alias("northing"))


@query("utm_epsg", """
SELECT event_id, CAST(least(greatest(trunc((lon + 180) / 6) + 1, 1), 60) AS INT)
  + CASE WHEN lat >= 0 THEN 32600 ELSE 32700 END AS epsg
FROM (SELECT event_id, value - 180 AS lon, value / 3 - 60 AS lat FROM events)""")
def utm_epsg(spark, sf_dir):
    e = lens.table(spark, sf_dir, "events")
    return e.select("event_id", geo.utm_epsg(F.col("value") - 180, F.col("value") / 3 - 60).alias("epsg"))


@query("detect_crs", """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'EPSG:32644'
  WHEN x BETWEEN -180 AND 180 AND y BETWEEN -90 AND 90 THEN 'EPSG:4326'
  WHEN x BETWEEN 100000 AND 999999 AND y BETWEEN 0 AND 10000000 THEN 'EPSG:32643' ELSE 'EPSG:4326' END AS crs
FROM (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice / 10000 ELSE o_totalprice END AS x,
  CASE WHEN o_orderpriority = '2-HIGH' THEN -1e0 ELSE o_totalprice / 6000 END AS y FROM orders)""")
def detect_crs(spark, sf_dir):
    o, p = lens.table(spark, sf_dir, "orders"), F.col("o_totalprice")
    declared = F.when(F.col("o_orderstatus") == "F", "EPSG:32644").when(F.col("o_orderstatus") == "P", "not a crs")
    x = F.when(F.col("o_orderpriority") == "1-URGENT", p / 10000).otherwise(p)
    y = F.when(F.col("o_orderpriority") == "2-HIGH", -1.0).otherwise(p / 6000)
    return o.select("o_orderkey", geo.detect_crs(declared, x, y).alias("crs"))


@query("centroid_latlon", lens_sql(
    "SELECT feature_id, round(lat, 8) AS centroid_lat, round(lon, 8) AS centroid_lon FROM lens"))
def centroid_latlon(spark, sf_dir):
    f = lens.features(spark, sf_dir, mapped=False).select("feature_id", geo.centroid(F.col("geom")).alias("c"))
    return f.select("feature_id", F.round("c.y", 8).alias("centroid_lat"), F.round("c.x", 8).alias("centroid_lon"))


@query("num_vertices", lens_sql("""
SELECT feature_id, CASE kind WHEN 'Polygon' THEN 5 WHEN 'LineString' THEN 2 ELSE 1 END AS vertices,
  CASE kind WHEN 'Polygon' THEN 5 WHEN 'LineString' THEN 2 ELSE 1 END AS text_vertices FROM lens"""))
def num_vertices(spark, sf_dir):
    f = lens.features(spark, sf_dir, mapped=False)
    return f.select("feature_id", geo.num_vertices(F.col("geom")).alias("vertices"),
                    geo.json_num_vertices(geo.to_geojson(F.col("geom"))).alias("text_vertices"))


@query("sync_geometry_columns", lens_sql("""
SELECT feature_id, kind, round(xmin, 9) AS xmin, round(ymin, 9) AS ymin, round(xmax, 9) AS xmax, round(ymax, 9) AS ymax
FROM lens"""))
def sync_geometry_columns(spark, sf_dir):
    from landrecon.sources.readers import sync_geometry_columns as sync

    text = lens.features(spark, sf_dir, mapped=False).select(
        "feature_id", geo.to_geojson(F.col("geom")).alias("geometry_geojson"))
    out = sync(text)
    return out.select("feature_id", F.col("geom.kind").alias("kind"),
                      *[F.round(F.col("bbox." + c), 9).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


# --- topology -----------------------------------------------------------------------------

@query("duplicate_geometries", lens_sql("""
SELECT dataset_id, b_id AS feature_id, a_id AS partner_id, round(iou, 6) AS iou, 1 AS pair_count
FROM layer_pairs WHERE iou > 0.97""", SAME_LAYER))
def duplicate_geometries(spark, sf_dir):
    out = topology.duplicate_geometries(lens.features(spark, sf_dir), LENS)
    return out.withColumn("iou", F.round("iou", 6))


@query("overlapping_geometries", lens_sql("""
SELECT dataset_id, b_id AS feature_id, a_id AS partner_id, round(iou, 6) AS iou, 1 AS pair_count
FROM layer_pairs WHERE iou > 0.05 AND iou <= 0.97""", SAME_LAYER))
def overlapping_geometries(spark, sf_dir):
    """Overlaps by the general kernel on flat coordinates."""
    out = topology.overlapping_geometries(lens.features(spark, sf_dir), Settings(metric="local_plane"))
    return out.withColumn("iou", F.round("iou", 6))


@query("validate_geometry", lens_sql("""
SELECT feature_id, true AS is_valid,
  CASE WHEN kind = 'Polygon' AND pow(2 * (xmax - xmin + ymax - ymin), 2) / ((xmax - xmin) * (ymax - ymin)) > 200
    THEN 'sliver' ELSE 'none' END AS issue_type FROM lens"""))
def validate_geometry(spark, sf_dir):
    return topology.validate_geometry(lens.features(spark, sf_dir, mapped=False), Settings()).select(
        "feature_id", "is_valid", "issue_type")


@query("topology_validation", lens_sql("""
SELECT feature_id, true AS is_valid, 'sliver' AS issue_type, 1 AS pair_count FROM lens
WHERE kind = 'Polygon' AND pow(2 * (xmax - xmin + ymax - ymin), 2) / ((xmax - xmin) * (ymax - ymin)) > 200
UNION ALL SELECT b_id, false, 'duplicate', count(*) FROM layer_pairs WHERE iou > 0.97 GROUP BY 1
UNION ALL SELECT b_id, false, 'overlap', count(*) FROM layer_pairs WHERE iou > 0.05 AND iou <= 0.97 GROUP BY 1""",
    SAME_LAYER))
def topology_validation(spark, sf_dir):
    rows = topology.topology_validation(lens.features(spark, sf_dir), None, LENS)[1]
    return rows.select("feature_id", "is_valid", "issue_type", "pair_count")


@query("dedupe_footprints", lens_sql("""
SELECT feature_id FROM poly c WHERE source_type = 'cadastral' AND NOT EXISTS (
  SELECT 1 FROM layer_pairs WHERE b_id = c.feature_id AND iou >= 0.82)""", SAME_LAYER))
def dedupe_footprints(spark, sf_dir):
    cadastral = lens.features(spark, sf_dir, ("cadastral",), mapped=False)
    return topology.dedupe_footprints(cadastral, LENS).select("feature_id")


# --- conflicts ----------------------------------------------------------------------------

_FOUND = ["conflict_type", "severity", "feature_ref", "source_a", "source_b", "description", "confidence"]


@query("parcel_overlap_conflicts", lens_sql("""
SELECT 'parcel_overlap' AS conflict_type, CASE WHEN iou < 0.3 THEN 'MODERATE' ELSE 'MAJOR' END AS severity,
  a_id AS feature_ref, dataset_id AS source_a, dataset_id AS source_b,
  'Parcels ' || a_id || ' and ' || b_id || ' overlap by ' || printf('%.1f', iou * 100) || '% (IoU)' AS description,
  round(iou * 100, 1) AS confidence
FROM layer_pairs WHERE canonical_type = 'parcel' AND iou > 0.05 AND iou < 0.97""", SAME_LAYER))
def parcel_overlap_conflicts(spark, sf_dir):
    return conflicts.parcel_overlap_conflicts(lens.features(spark, sf_dir), LENS).select(_FOUND)


_CROSSING = f"""
crossing AS (
  SELECT b.feature_id AS b_id, b.dataset_id AS b_dataset, p.feature_id AS p_id, p.dataset_id AS p_dataset, {box_iou('b', 'p')} AS iou,
    row_number() OVER (PARTITION BY b.feature_id ORDER BY p.dataset_id, p.ordinal) AS rn
  FROM lens b JOIN lens p ON b.canonical_type = 'building' AND p.canonical_type = 'parcel'
    AND b.xmin <= p.xmax AND b.xmax >= p.xmin AND b.ymin <= p.ymax AND b.ymax >= p.ymin
  WHERE {box_iou('b', 'p')} > 0.02 AND {box_iou('b', 'p')} < 0.85)"""


@query("building_crossing_conflicts", lens_sql("""
SELECT 'building_boundary_crossing' AS conflict_type, CASE WHEN iou > 0.5 THEN 'MINOR' ELSE 'MODERATE' END AS severity,
  b_id AS feature_ref, b_dataset AS source_a, p_dataset AS source_b,
  'Building ' || b_id || ' crosses parcel ' || p_id || ' boundary (overlap ratio ' || printf('%.1f', iou * 100) || '%)' AS description,
  round((1 - iou) * 100, 1) AS confidence FROM crossing WHERE rn = 1""", _CROSSING))
def building_crossing_conflicts(spark, sf_dir):
    return conflicts.building_crossing_conflicts(lens.features(spark, sf_dir), LENS).select(_FOUND)


@query("utility_crossing_conflicts", lens_sql("""
SELECT 'utility_crossing' AS conflict_type, 'MINOR' AS severity, u_id AS feature_ref, 'DS-utility' AS source_a,
  p_dataset AS source_b, 'Utility line ' || u_id || ' crosses parcel ' || p_id || ' boundary' AS description,
  70e0 AS confidence
FROM (SELECT u.feature_id AS u_id, p.feature_id AS p_id, p.dataset_id AS p_dataset,
    row_number() OVER (PARTITION BY u.feature_id ORDER BY p.dataset_id, p.ordinal) AS rn
  FROM lens u JOIN lens p ON u.canonical_type = 'utility' AND p.canonical_type = 'parcel'
    AND u.xmin <= p.xmax AND u.xmax >= p.xmin AND u.ymin <= p.ymax AND u.ymax >= p.ymin
  WHERE NOT (u.xmin >= p.xmin AND u.xmax <= p.xmax AND u.ymin > p.ymin AND u.ymax < p.ymax)) WHERE rn = 1"""))
def utility_crossing_conflicts(spark, sf_dir):
    return conflicts.utility_crossing_conflicts(lens.features(spark, sf_dir), LENS).select(_FOUND)


@query("gnss_outside_conflicts", lens_sql(f"""
SELECT 'gnss_outside_parcel' AS conflict_type, 'MINOR' AS severity, g_id AS feature_ref, 'DS-gnss' AS source_a,
  CAST(NULL AS VARCHAR) AS source_b, 'GNSS survey point ' || g_id || ' lies outside all known parcel boundaries '
  || '(nearest match confidence ' || printf('%.1f', score * 100) || '%)' AS description, round(score * 100, 1) AS confidence
FROM (SELECT g.feature_id AS g_id, coalesce(max(exp(-{box_gap('p', 'g', 'p.lat')} / 50e0)), 0) AS score
  FROM lens g LEFT JOIN lens p ON p.canonical_type = 'parcel'
    AND p.xmin - 4e-3 <= g.xmax AND p.xmax + 4e-3 >= g.xmin AND p.ymin - 4e-3 <= g.ymax AND p.ymax + 4e-3 >= g.ymin
  WHERE g.canonical_type = 'gnss_point' GROUP BY 1) WHERE score < 0.3"""))
def gnss_outside_conflicts(spark, sf_dir):
    return conflicts.gnss_outside_conflicts(lens.features(spark, sf_dir), LENS).select(_FOUND)


_MEMBERS = """
members AS (
  SELECT a_id AS grp, a_id AS feature_id, 'DS-cadastral' AS dataset_id, a_area AS area, a_id, 2147483648 AS o, ao AS owner
  FROM best GROUP BY ALL
  UNION ALL
  SELECT a_id, b_id, b_dataset, b_area, a_id,
    row_number() OVER (PARTITION BY a_id ORDER BY overall_confidence DESC, b_dataset, b_id), bo FROM best)"""


def lens_members(spark: SparkSession, sf_dir: str, f: DataFrame | None = None) -> DataFrame:
    """Anchors with the best match of each dataset, as groups named after the anchor.

    Features and best matches have several readers each, so they are written once; ``f`` are features written before.
    """
    rounds = Rounds(spark)
    f = rounds.keep(lens.features(spark, sf_dir)) if f is None else f
    best = rounds.keep(match.best_match_per_dataset(f.where(F.col("source_type") == "cadastral"), f, LENS))
    groups = best.select(F.col("anchor_id").alias("matched_group_id"), "anchor_id").distinct()
    return exclusive.group_members(groups, best.withColumnRenamed("anchor_id", "matched_group_id"), f)


@query("group_members", lens_sql("""
SELECT grp AS matched_group_id, feature_id, dataset_id, CASE WHEN o = 2147483648 THEN 0 ELSE o END AS member_rank
FROM members""", PAIRS, _MEMBERS))
def group_members(spark, sf_dir):
    return lens_members(spark, sf_dir).select("matched_group_id", "feature_id", "dataset_id", "member_rank")


@query("area_mismatch_conflicts", lens_sql("""
SELECT 'area_mismatch' AS conflict_type, CASE WHEN rel < 0.3 THEN 'MODERATE' ELSE 'MAJOR' END AS severity,
  hi.f AS feature_ref, hi.d AS source_a, lo.d AS source_b, 'Area mismatch of ' || printf('%.1f', rel * 100)
  || '% between sources for group ' || grp || ' (' || printf('%.1f', lo.a) || ' m² vs ' || printf('%.1f', hi.a) || ' m²)' AS description,
  round((1 - rel) * 100, 1) AS confidence
FROM (SELECT *, (hi.a - lo.a) / hi.a AS rel FROM (
  SELECT grp, count(*) AS n, first({'a': area, 'f': feature_id, 'd': dataset_id} ORDER BY area DESC, o) AS hi,
    first({'a': area, 'f': feature_id, 'd': dataset_id} ORDER BY area, o) AS lo
  FROM members WHERE area > 0 GROUP BY 1) WHERE n >= 2) WHERE rel > 0.15""", PAIRS, _MEMBERS))
def area_mismatch_conflicts(spark, sf_dir):
    return conflicts.area_mismatch_conflicts(lens_members(spark, sf_dir), LENS).select(_FOUND)


@query("duplicate_id_conflicts", lens_sql("""
SELECT 'duplicate_id' AS conflict_type, 'MODERATE' AS severity, feature_id AS feature_ref, dataset_id AS source_a,
  dataset_id AS source_b, 'Duplicate identifier ''' || id_key || ''' found in dataset ' || upper(source_type[1]) || source_type[2:]
  || ' (features ' || first_id || ' and ' || feature_id || ')' AS description, 85e0 AS confidence
FROM (SELECT *, first_value(feature_id) OVER w AS first_id, row_number() OVER w AS rn FROM lens
  WHERE id_key IS NOT NULL WINDOW w AS (PARTITION BY dataset_id, id_key ORDER BY ordinal)) WHERE rn > 1"""))
def duplicate_id_conflicts(spark, sf_dir):
    return conflicts.duplicate_id_conflicts(
        lens.features(spark, sf_dir, mapped=False), lens.datasets(spark, sf_dir), LENS).select(_FOUND)


@query("owner_mismatch_conflicts")
def owner_mismatch_conflicts(spark, sf_dir):
    return conflicts.owner_mismatch_conflicts(lens_members(spark, sf_dir), Settings()).select(_FOUND)


@query("all_conflicts")
def all_conflicts(spark, sf_dir):
    rounds = Rounds(spark)
    f = rounds.keep(lens.features(spark, sf_dir))  # every detector reads them
    members = rounds.keep(lens_members(spark, sf_dir, f))
    return conflicts.all_conflicts(f, members, lens.datasets(spark, sf_dir), None, LENS).select("status", *_FOUND)
