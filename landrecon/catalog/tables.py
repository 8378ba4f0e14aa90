"""Result tables read off the driver's tables, for the operators that query results.

Whole tables in, whole tables out: parcels are customers, matches and jobs are orders, conflicts
are line items, changes are events, validation rows and field mappings are parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landrecon import lens
from landrecon.functions import geo
from landrecon.settings import CONFLICT_TYPES, PIPELINE_STAGES


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = lens.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.max("o_totalprice").alias("top"), F.max("o_orderdate").alias("last_updated"), F.min("o_orderkey").alias("o"))
    c = lens.table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left")
    x, y = lens._cell(F.col("c_custkey"))
    box = geo.box_geom(x, y, x + lens.STEP, y + lens.STEP)
    score = F.coalesce(F.round(F.col("top") / 5000, 1), F.lit(0.0))
    source = F.struct(F.lit("DS-cadastral").alias("dataset_id"), F.lit("Cadastral").alias("dataset_name"),
                      F.lit("user_upload").alias("provenance"),
                      F.concat(F.lit("C-"), "c_custkey").alias("feature_id"), F.lit(100.0).alias("confidence"))
    record = F.struct(F.lit("DS-revenue").alias("dataset_id"), F.lit("Revenue").alias("dataset_name"),
                      F.when(F.col("o") % 2 == 0, "synthetic_demo").otherwise("user_upload").alias("provenance"),
                      F.concat(F.lit("R-"), "o").alias("feature_id"), score.alias("confidence"))
    lineage = F.when(F.col("o").isNull(), F.create_map(F.lit("cadastral"), source)).otherwise(
        F.create_map(F.lit("cadastral"), source, F.lit("revenue"), record))
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("UP-"), k).alias("id"), k.alias("parcel_rank"), F.concat(F.lit("P-"), k).alias("parcel_id"),
        F.when(F.col("c_nationkey") != 3, F.concat(F.lit("P-"), k)).alias("survey_number"),
        F.col("c_name").alias("owner_name"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("area"),
        F.col("c_mktsegment").alias("land_use"),
        F.when(F.col("c_nationkey") != 7, geo.to_geojson(box)).alias("geometry_geojson"),
        (F.col("c_nationkey") % 4).alias("building_count"), (F.col("c_nationkey") % 3).alias("utility_count"),
        (F.col("c_nationkey") < 10).alias("gnss_verified"), (F.col("c_nationkey") > 20).alias("ground_truth_verified"),
        F.size(F.map_keys(lineage)).alias("source_count"), score.alias("confidence_score"),
        F.when(score >= 70, "PASSED").otherwise("FAILED").alias("validation_status"),
        F.when(F.col("c_nationkey") < 5, "MAJOR").when(F.col("c_nationkey") < 10, "MINOR").otherwise("NONE").alias("conflict_status"),
        lineage.alias("lineage"), "last_updated", "c_nationkey")


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, p = lens.table(spark, sf_dir, "orders"), F.col("o_totalprice")
    return o.select(
        F.concat(F.lit("MT-"), "o_orderkey").alias("id"), F.concat(F.lit("GRP-"), "o_custkey").alias("matched_group_id"),
        F.concat(F.lit("R-"), "o_orderkey").alias("feature_id"), F.concat(F.lit("DS-"), "o_orderstatus").alias("dataset_id"),
        F.concat(F.lit("UP-"), "o_custkey").alias("parcel_unified_id"),
        F.round(p / 5500, 1).alias("spatial_proximity"), F.round(p / 6500, 1).alias("geometry_overlap"),
        F.round(p / 7500, 1).alias("area_similarity"), F.round(p / 8500, 1).alias("attribute_similarity"),
        F.round(p / 5000, 1).alias("overall_confidence"))


def conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return lens.table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", F.lit("CF"), "l_orderkey", "l_linenumber", "l_partkey").alias("id"),
        _pick(CONFLICT_TYPES, F.col("l_linenumber")).alias("conflict_type"),
        F.when(flag == "A", "MAJOR").when(flag == "N", "MODERATE").otherwise("MINOR").alias("severity"),
        F.concat(F.lit("R-"), "l_orderkey").alias("feature_ref"),
        F.when(F.col("l_linestatus") == "O", "Open").otherwise("Resolved").alias("status"),
        F.lit(None).cast("string").alias("parcel_id"), F.col("l_shipdate").alias("created_at"),
        F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("resolved_at"))


# How event types read as change types.
EVENT_CHANGES = {"signup": "new", "error": "removed", "click": "modified", "purchase": "attribute_changed",
                 "view": "geometry_changed"}


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*[F.lit(v) for pair in EVENT_CHANGES.items() for v in pair])[F.col("event_type")]
    key = F.concat(F.lit("P-"), "user_id")
    body = F.to_json(F.struct(key.alias("parcel_id"), F.concat(F.lit("Owner "), "user_id").alias("owner_name")))
    return lens.table(spark, sf_dir, "events").select(
        F.concat(F.lit("CE-"), "event_id").alias("id"), kind.alias("change_type"), key.alias("feature_ref"),
        F.when(F.col("event_type") != "signup", body).alias("before"),
        F.when(F.col("event_type") != "error", body).alias("after"),
        F.col("value").alias("confidence"), F.col("ts").alias("detected_at"))


# How part types read as topology issues.
PART_ISSUES = {"ECONOMY": "self_intersection", "STANDARD": "invalid_geometry", "PROMO": "duplicate",
               "MEDIUM": "overlap", "LARGE": "sliver", "SMALL": "missing_geometry"}


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    issue = F.create_map(*[F.lit(v) for pair in PART_ISSUES.items() for v in pair])[F.col("p_type")]
    return lens.table(spark, sf_dir, "part").select(
        F.concat(F.lit("VR-"), "p_partkey").alias("id"), F.concat(F.lit("M-"), "p_name").alias("feature_id"),
        F.concat(F.lit("DS-"), "p_brand").alias("dataset_id"), issue.alias("issue_type"),
        (issue == "sliver").alias("is_valid"), (issue == "self_intersection").alias("corrected"),
        F.when(F.col("p_size") > 10, F.concat(F.lit("geometry "), "p_partkey")).alias("original_geometry"),
        F.lit(None).cast("string").alias("corrected_geometry"), F.col("p_partkey").alias("position"))


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.table(spark, sf_dir, "part").select(
        F.concat(F.lit("AM-"), "p_partkey").alias("id"), F.concat(F.lit("DS-"), "p_brand").alias("dataset_id"),
        F.concat("p_name", F.lit("-"), "p_partkey").alias("source_field"), F.lower("p_type").alias("canonical_field"),
        (F.col("p_size") * 2.0).alias("confidence"), F.lit("fuzzy_synonym").alias("method"),
        (F.col("p_size") > 40).alias("manual_override"))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lens.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("JOB-"), "o_orderkey").alias("id"), F.lit("completed").alias("status"),
        F.col("o_orderdate").alias("started_at"), F.col("o_custkey").alias("total_processed"))


def stage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is one stage report of its user's job."""
    stage = F.pmod(F.col("value").cast("int"), F.lit(10)) + 1
    return lens.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), _pick(PIPELINE_STAGES, stage).alias("name"),
        F.col("event_id").alias("position"),
        F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"),
        F.col("event_id").alias("processed"), F.lit(0).cast("long").alias("warnings"),
        F.lit(0).cast("long").alias("errors"), F.col("event_type").alias("detail"), F.col("ts").alias("timestamp"))


def declared_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as datasets that declare how many customers they have."""
    n = lens.table(spark, sf_dir, "nation")
    counts = lens.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("_n"))
    return n.join(counts, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(
        F.concat(F.lit("DS-"), "n_nationkey").alias("dataset_id"), F.col("n_name").alias("name"),
        (F.coalesce("_n", F.lit(0)) + (F.col("n_nationkey") % 2)).alias("feature_count"),
        F.when(F.col("n_regionkey") == 0, "synthetic_demo").otherwise("user_upload").alias("provenance"),
        F.concat(F.lit("department "), "n_regionkey").alias("department"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("n_nationkey").cast("long") * 86400).alias("uploaded_at"),
        F.element_at(F.array(*[F.lit(s) for s in lens.LAYERS]), F.col("n_regionkey") + 1).alias("source_type"))
