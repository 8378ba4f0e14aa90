"""Reference SQL for the registered queries, over the driver's tables."""

from __future__ import annotations

# The layers of the lens; constants are written with an exponent to make them doubles.
_X = "(74.2433e0 + ({k} % 100) * 7.5e-4)"
_Y = "(16.7050e0 + floor({k} / 100) * 7.5e-4)"
_S = 7.5e-4


def _xy(k: str) -> tuple[str, str]:
    return _X.format(k=k), _Y.format(k=k)


def _d(v: float) -> str:
    return f"{v:.17e}"


_cx, _cy = _xy("c_custkey")
_px, _py = _xy("p_partkey")
_ex, _ey = _xy("user_id")
_sx, _sy = _xy("s_suppkey")

LENS = f"""
variants AS (
  SELECT * FROM (VALUES ('C', 0, -1), ('CD', 1, 3), ('CO', 2, 7), ('CS', 3, 11)) t(v, n, nation)),
cad AS (
  SELECT v || '-' || c_custkey AS feature_id, 'DS-cadastral' AS dataset_id, 'cadastral' AS source_type,
    'parcel' AS canonical_type, c_custkey * 4 + n AS ordinal, 'Polygon' AS kind,
    {_cx} + {_d(0.08 * _S)} + CASE WHEN v = 'CO' THEN {_d(0.15 * _S)} ELSE 0e0 END AS xmin,
    {_cy} + CASE WHEN v = 'CS' THEN {_d(0.94 * _S)} ELSE {_d(0.08 * _S)} END
      + CASE WHEN v = 'CO' THEN {_d(0.25 * _S)} ELSE 0e0 END AS ymin,
    {_cx} + {_d(0.92 * _S)} + CASE WHEN v = 'CO' THEN {_d(0.15 * _S)} ELSE 0e0 END AS xmax,
    {_cy} + CASE WHEN v = 'CS' THEN {_d(0.95 * _S)} ELSE {_d(0.92 * _S)} END
      + CASE WHEN v = 'CO' THEN {_d(0.25 * _S)} ELSE 0e0 END AS ymax,
    CASE WHEN v IN ('C', 'CD') THEN 'P-' WHEN v = 'CO' THEN 'PO-' ELSE 'PS-' END || c_custkey AS id_key,
    CASE WHEN v = 'CD' THEN 'Duplicate entry' ELSE c_name END AS owner, c_mktsegment AS land_use,
    'parcel_id' AS id_field, 3 AS n_fields, c_nationkey
  FROM customer JOIN variants ON nation = -1 OR nation = c_nationkey),
rev AS (
  SELECT 'R-' || o AS feature_id, 'DS-revenue' AS dataset_id, 'revenue' AS source_type,
    'parcel' AS canonical_type, o AS ordinal, 'Polygon' AS kind,
    {_cx} + inset + move AS xmin, {_cy} + inset + move AS ymin,
    {_cx} + {_d(_S)} - inset + move AS xmax, {_cy} + {_d(_S)} - inset + move AS ymax,
    'P-' || c_custkey AS id_key, CASE WHEN o % 8 = 0 THEN c_mktsegment ELSE c_name END AS owner,
    c_mktsegment AS land_use, 'survey_no' AS id_field, 3 AS n_fields, c_nationkey
  FROM (SELECT c.*, o, {_d(0.08 * _S)} + (o % 5) * {_d(0.05 * _S)} AS inset, ((o % 7) - 3) * 1e-5 AS move
        FROM customer c JOIN (SELECT o_custkey, min(o_orderkey) AS o FROM orders GROUP BY 1)
        ON c_custkey = o_custkey)),
mun AS (
  SELECT 'M-' || p_partkey AS feature_id, 'DS-municipal' AS dataset_id, 'municipal' AS source_type,
    'building' AS canonical_type, p_partkey AS ordinal, 'Polygon' AS kind,
    {_px} + f AS xmin, {_py} + f + up AS ymin, {_px} + f + {_d(0.3 * _S)} AS xmax,
    {_py} + f + up + {_d(0.3 * _S)} AS ymax,
    'B-' || p_partkey AS id_key, NULL AS owner, p_type AS land_use, 'property_id' AS id_field, 4 AS n_fields,
    NULL AS c_nationkey
  FROM (SELECT *, {_d(0.15 * _S)} + (p_partkey % 3) * {_d(0.3 * _S)} AS f,
        CASE WHEN p_partkey % 8 = 0 THEN {_d(0.35 * _S)} ELSE 0e0 END AS up FROM part)),
gn AS (
  SELECT 'G-' || event_id AS feature_id, 'DS-gnss' AS dataset_id, 'gnss' AS source_type,
    'gnss_point' AS canonical_type, event_id AS ordinal, 'Point' AS kind,
    {_ex} + {_d(0.5 * _S)} + off AS xmin, {_ey} + {_d(0.5 * _S)} + off AS ymin,
    {_ex} + {_d(0.5 * _S)} + off AS xmax, {_ey} + {_d(0.5 * _S)} + off AS ymax,
    NULL AS id_key, NULL AS owner, NULL AS land_use, 'point_id' AS id_field, 2 AS n_fields, NULL AS c_nationkey
  FROM (SELECT *, (value % 1e0 - 0.5e0) * {_d(0.24 * _S)} * CASE WHEN event_type = 'error' THEN 25e0 ELSE 1e0 END AS off
        FROM events)),
ut AS (
  SELECT 'U-' || s_suppkey AS feature_id, 'DS-utility' AS dataset_id, 'utility' AS source_type,
    'utility' AS canonical_type, s_suppkey AS ordinal, 'LineString' AS kind,
    {_sx} AS xmin, {_sy} + {_d(0.5 * _S)} AS ymin, {_sx} + (1 + s_suppkey % 3) * {_d(_S)} AS xmax,
    {_sy} + {_d(0.5 * _S)} AS ymax, NULL AS id_key, NULL AS owner, NULL AS land_use,
    'utility_id' AS id_field, 1 AS n_fields, NULL AS c_nationkey
  FROM supplier),
lens AS (
  SELECT *, (xmin + xmax) / 2 AS lon, (ymin + ymax) / 2 AS lat,
    CASE WHEN kind = 'Polygon' THEN (xmax - xmin) * (ymax - ymin) * 111320e0 * 111320e0
      * cos((ymin + ymax) / 2 * {_d(3.141592653589793 / 180)}) END AS area
  FROM (SELECT * FROM cad UNION ALL SELECT * FROM rev UNION ALL SELECT * FROM mun
        UNION ALL SELECT * FROM gn UNION ALL SELECT * FROM ut))"""

RAD = _d(3.141592653589793 / 180)


def haversine(a: str, b: str) -> str:
    return (f"2 * 6371000e0 * asin(least(1e0, sqrt(pow(sin(({b}.lat - {a}.lat) * {RAD} / 2), 2)"
            f" + cos({a}.lat * {RAD}) * cos({b}.lat * {RAD}) * pow(sin(({b}.lon - {a}.lon) * {RAD} / 2), 2))))")


def box_iou(a: str, b: str) -> str:
    w = f"greatest(0e0, least({a}.xmax, {b}.xmax) - greatest({a}.xmin, {b}.xmin))"
    h = f"greatest(0e0, least({a}.ymax, {b}.ymax) - greatest({a}.ymin, {b}.ymin))"
    size = "(({0}.xmax - {0}.xmin) * ({0}.ymax - {0}.ymin))"
    return f"({w} * {h} / ({size.format(a)} + {size.format(b)} - {w} * {h}))"


def box_gap(a: str, b: str, lat: str) -> str:
    dx = f"greatest(0e0, {b}.xmin - {a}.xmax, {a}.xmin - {b}.xmax)"
    dy = f"greatest(0e0, {b}.ymin - {a}.ymax, {a}.ymin - {b}.ymax)"
    return f"sqrt(pow({dx} * 111320e0 * cos({lat} * {RAD}), 2) + pow({dy} * 111320e0, 2))"


PAIRS = f"""
anchors AS (
  SELECT *, 225e0 / 111320e0 AS dy, (225e0 / 111320e0) / greatest(0.05e0, abs(cos(lat * {RAD}))) AS dx
  FROM lens WHERE source_type = 'cadastral'),
cand AS (
  SELECT a.feature_id AS a_id, a.ordinal AS a_ordinal, b.feature_id AS b_id, b.ordinal AS b_ordinal,
    b.dataset_id AS b_dataset, a.dataset_id AS a_dataset, {haversine('a', 'b')} AS d,
    a.area AS a_area, b.area AS b_area, a.lat AS a_lat, b.kind AS b_kind,
    {box_iou('a', 'b')} AS iou, {box_gap('a', 'b', 'a.lat')} AS gap,
    lower(a.owner) AS ao, lower(b.owner) AS bo, lower(a.land_use) AS al, lower(b.land_use) AS bl,
    lower(a.id_key) AS ai, lower(b.id_key) AS bi
  FROM anchors a JOIN lens b ON a.xmin - a.dx <= b.xmax AND a.xmax + a.dx >= b.xmin
    AND a.ymin - a.dy <= b.ymax AND a.ymax + a.dy >= b.ymin),
near AS (SELECT * FROM cand WHERE a_dataset <> b_dataset AND d <= 225),
parts AS (
  SELECT *, greatest(0e0, 1 - least(d / 75e0, 1e0)) AS prox,
    CASE WHEN b_kind = 'Polygon' THEN iou ELSE exp(-gap / 50e0) END AS ovl,
    CASE WHEN a_area > 0 AND b_area > 0 THEN greatest(0e0, 1 - abs(a_area - b_area) / greatest(a_area, b_area))
      ELSE 0.5e0 END AS ars,
    CASE WHEN bo IS NULL AND bl IS NULL AND bi IS NULL THEN 0.5e0 ELSE
      (coalesce((ao = bo)::INT, 0) + coalesce((al = bl)::INT, 0) + coalesce((ai = bi)::INT, 0))
      / ((bo IS NOT NULL)::INT + (bl IS NOT NULL)::INT + (bi IS NOT NULL)::INT)::DOUBLE END AS att
  FROM near),
scored AS (
  SELECT *, round(prox * 100, 1) AS spatial_proximity, round(ovl * 100, 1) AS geometry_overlap,
    round(ars * 100, 1) AS area_similarity, round(att * 100, 1) AS attribute_similarity,
    round(greatest(0e0, least(1e0, 0.3e0 * prox + 0.3e0 * ovl + 0.2e0 * ars + 0.2e0 * att)) * 100, 1) AS overall_confidence
  FROM parts),
matched AS (SELECT * FROM scored WHERE overall_confidence >= 40),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a_id, b_dataset
    ORDER BY overall_confidence DESC, b_ordinal) AS rn FROM matched) WHERE rn = 1)"""

SAME_LAYER = f"""
poly AS (SELECT * FROM lens WHERE kind = 'Polygon'),
layer_pairs AS (
  SELECT a.dataset_id, a.canonical_type, a.feature_id AS a_id, b.feature_id AS b_id, {box_iou('a', 'b')} AS iou
  FROM poly a JOIN poly b ON a.dataset_id = b.dataset_id AND a.ordinal < b.ordinal
    AND a.xmin <= b.xmax AND a.xmax >= b.xmin AND a.ymin <= b.ymax AND a.ymax >= b.ymin)"""

TYPES = ("['parcel_overlap', 'building_boundary_crossing', 'utility_crossing', 'area_mismatch', "
         "'duplicate_id', 'gnss_outside_parcel', 'owner_mismatch']")
STAGES = ("['Ingestion', 'CRS Normalization', 'Schema Mapping', 'Topology Validation', 'Spatial Matching', "
          "'Conflict Detection', 'Conflict Resolution', 'Confidence Scoring', 'Unified Land Record', 'Change Detection']")

TABLES = f"""
parcels AS (
  SELECT 'UP-' || c_custkey AS id, 'P-' || c_custkey AS parcel_id,
    CASE WHEN c_nationkey <> 3 THEN 'P-' || c_custkey END AS survey_number, c_name AS owner_name,
    CASE WHEN c_acctbal > 0 THEN c_acctbal END AS area, c_mktsegment AS land_use,
    c_nationkey <> 7 AS shaped, c_nationkey % 4 AS building_count, c_nationkey % 3 AS utility_count,
    c_nationkey < 10 AS gnss_verified, c_nationkey > 20 AS ground_truth_verified,
    CASE WHEN o IS NULL THEN 1 ELSE 2 END AS source_count, coalesce(round(top / 5000, 1), 0) AS confidence_score,
    CASE WHEN coalesce(round(top / 5000, 1), 0) >= 70 THEN 'PASSED' ELSE 'FAILED' END AS validation_status,
    CASE WHEN c_nationkey < 5 THEN 'MAJOR' WHEN c_nationkey < 10 THEN 'MINOR' ELSE 'NONE' END AS conflict_status,
    last_updated, c_nationkey, c_custkey, o, {_cx} AS x, {_cy} AS y
  FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS top, max(o_orderdate) AS last_updated,
    min(o_orderkey) AS o FROM orders GROUP BY 1) ON c_custkey = o_custkey),
matches AS (
  SELECT 'MT-' || o_orderkey AS id, 'GRP-' || o_custkey AS matched_group_id, 'R-' || o_orderkey AS feature_id,
    'DS-' || o_orderstatus AS dataset_id, 'UP-' || o_custkey AS parcel_unified_id,
    round(o_totalprice / 5500, 1) AS spatial_proximity, round(o_totalprice / 6500, 1) AS geometry_overlap,
    round(o_totalprice / 7500, 1) AS area_similarity, round(o_totalprice / 8500, 1) AS attribute_similarity,
    round(o_totalprice / 5000, 1) AS overall_confidence FROM orders),
conflicts AS (
  SELECT 'CF-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id,
    ({TYPES})[l_linenumber] AS conflict_type,
    CASE l_returnflag WHEN 'A' THEN 'MAJOR' WHEN 'N' THEN 'MODERATE' ELSE 'MINOR' END AS severity,
    'R-' || l_orderkey AS feature_ref, CASE l_linestatus WHEN 'O' THEN 'Open' ELSE 'Resolved' END AS status,
    l_shipdate AS created_at, CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS resolved_at, l_orderkey
  FROM lineitem),
changes AS (
  SELECT 'CE-' || event_id AS id, CASE event_type WHEN 'signup' THEN 'new' WHEN 'error' THEN 'removed'
      WHEN 'click' THEN 'modified' WHEN 'purchase' THEN 'attribute_changed' ELSE 'geometry_changed' END AS change_type,
    'P-' || user_id AS feature_ref, value AS confidence, ts AS detected_at, event_type, user_id FROM events),
validation AS (
  SELECT 'VR-' || p_partkey AS id, 'M-' || p_name AS feature_id, 'DS-' || p_brand AS dataset_id,
    CASE p_type WHEN 'ECONOMY' THEN 'self_intersection' WHEN 'STANDARD' THEN 'invalid_geometry'
      WHEN 'PROMO' THEN 'duplicate' WHEN 'MEDIUM' THEN 'overlap' WHEN 'LARGE' THEN 'sliver'
      ELSE 'missing_geometry' END AS issue_type, p_type = 'LARGE' AS is_valid, p_type = 'ECONOMY' AS corrected,
    CASE WHEN p_size > 10 THEN 'geometry ' || p_partkey END AS original_geometry,
    CAST(NULL AS VARCHAR) AS corrected_geometry, p_partkey AS position FROM part),
mappings AS (
  SELECT 'AM-' || p_partkey AS id, 'DS-' || p_brand AS dataset_id, p_name || '-' || p_partkey AS source_field,
    lower(p_type) AS canonical_field, p_size * 2e0 AS confidence, 'fuzzy_synonym' AS method,
    p_size > 40 AS manual_override, p_size, p_partkey FROM part),
jobs AS (
  SELECT 'JOB-' || o_orderkey AS id, 'completed' AS status, o_orderdate AS started_at, o_custkey AS total_processed
  FROM orders),
stage_log AS (
  SELECT user_id AS job_id, ({STAGES})[CAST(trunc(value) AS INT) % 10 + 1] AS name, event_id AS position,
    CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, event_type AS detail FROM events),
datasets AS (
  SELECT 'DS-' || n_nationkey AS dataset_id, n_name AS name, coalesce(n, 0) + n_nationkey % 2 AS feature_count,
    CASE WHEN n_regionkey = 0 THEN 'synthetic_demo' ELSE 'user_upload' END AS provenance,
    'department ' || n_regionkey AS department,
    CAST('2024-01-01' AS TIMESTAMP) + to_days(n_nationkey) AS uploaded_at,
    (['cadastral', 'revenue', 'municipal', 'gnss', 'utility'])[n_regionkey + 1] AS source_type
  FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1) ON n_nationkey = c_nationkey)"""


def lens_sql(body: str, *ctes: str) -> str:
    return "WITH " + ",".join([LENS, *ctes]) + "\n" + body


def table_sql(body: str, *ctes: str) -> str:
    return "WITH " + ",".join([TABLES, *ctes]) + "\n" + body
