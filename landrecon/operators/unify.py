"""The unified parcel table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landrecon.functions import geo, scalar
from landrecon.operators import skew
from landrecon.settings import DEFAULTS, Settings

PARCEL_COLUMNS = [
    "id", "parcel_id", "survey_number", "owner_name", "area", "land_use", "building_count",
    "utility_count", "gnss_verified", "ground_truth_verified", "source_count", "confidence_score",
    "validation_status", "conflict_status", "last_updated",
]


def first_value(value: Column) -> Column:
    """First non-blank value in member order."""
    known = F.nullif(value, F.lit(""))
    return F.min(F.when(known.isNotNull(), F.struct(F.col("member_rank").alias("r"), known.alias("v"))))["v"]


def first_value_per_group(members: DataFrame) -> DataFrame:
    """Owner, land use and survey number of each group, with the defaults for none."""
    c = F.col("canonical")
    survey = F.coalesce(F.nullif(c["survey_number"], F.lit("")), F.nullif(c["parcel_id"], F.lit("")))
    anchor = F.max(F.when(F.col("member_rank") == 0, F.col("feature_id")))
    return members.groupBy("matched_group_id").agg(
        first_value(c["owner_name"]).alias("o"), first_value(c["land_use"]).alias("l"),
        first_value(survey).alias("survey_number"), anchor.alias("a")).select(
        "matched_group_id", F.coalesce("o", F.lit("Unknown")).alias("owner_name"),
        F.coalesce("l", F.lit("Unclassified")).alias("land_use"), "survey_number",
        F.coalesce("survey_number", "a").alias("parcel_id"))


def mean_score(score: Column) -> Column:
    """Mean of one-decimal scores, 0 without any; summed in whole tenths, so order cannot matter."""
    tenths = F.sum(F.round(score * 10).cast("long"))
    return F.coalesce(F.round(tenths / F.count(score) / 10, 1), F.lit(0.0))


def source_agreement(source_types: Column) -> Column:
    return F.round(F.least(F.lit(100.0), source_types / 5.0 * 100), 1)


def parcel_confidence(members: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Mean scores of each group's matches; without any, the share of expected sources."""
    out = members.groupBy("matched_group_id").agg(
        F.count("overall_confidence").alias("n"), mean_score(F.col("overall_confidence")).alias("mean"),
        mean_score(F.col("spatial_proximity")).alias("spatial_confidence"),
        mean_score(F.col("attribute_similarity")).alias("attribute_confidence"),
        mean_score(F.col("geometry_overlap")).alias("geometry_confidence"),
        F.size(F.collect_set("source_type")).alias("source_count"))
    return _scored(out, cfg).drop("n", "mean")


def _scored(df: DataFrame, cfg: Settings) -> DataFrame:
    df = df.withColumn("source_agreement", source_agreement(F.col("source_count")))
    df = df.withColumn("confidence_score", F.when(F.col("n") > 0, F.col("mean")).otherwise(F.col("source_agreement")))
    return df.withColumn("validation_status", F.when(
        F.col("confidence_score") >= cfg.band_medium, "PASSED").otherwise("FAILED"))


def build_unified_parcels(members: DataFrame, datasets: DataFrame, groups: DataFrame,
                          cfg: Settings = DEFAULTS) -> DataFrame:
    """One row per group. A group has at most one member per dataset, so one aggregation does.

    Lineage keeps the last member of each source type; ``members`` lists all of them.
    """
    named = skew.lookup_join(members, datasets.select("dataset_id", F.col("name").alias("dataset_name"), "provenance"),
                             ["dataset_id"], F.col("feature_id"))
    c, source, r = F.col("canonical"), F.col("source_type"), F.col("member_rank")
    survey = F.coalesce(F.nullif(c["survey_number"], F.lit("")), F.nullif(c["parcel_id"], F.lit("")))
    entry = F.struct(
        r.alias("r"), source.alias("source_type"), "dataset_id", "dataset_name", "provenance", "feature_id",
        F.array_sort(F.map_keys(c)).alias("contributed_fields"),
        F.when(r == 0, F.when(source == "cadastral", 100.0).otherwise(90.0))
        .otherwise(F.col("overall_confidence")).alias("confidence"))
    shaped = (F.col("canonical_type") == "parcel") & F.col("geom").isNotNull()
    form = [F.col("geom").alias("g"), F.col("area_sqm").alias("a")]
    cadastral = F.max_by(F.struct(*form), F.when(shaped & (source == "cadastral"), r))
    fallback = F.min_by(F.struct(*form), F.when(shaped & (source != "cadastral"), r))
    out = named.groupBy("matched_group_id").agg(
        first_value(c["owner_name"]).alias("_owner"), first_value(c["land_use"]).alias("_use"),
        first_value(survey).alias("survey_number"),
        F.max(F.when(r == 0, F.col("feature_id"))).alias("_anchor"),
        F.array_sort(F.collect_list(entry)).alias("members"),
        F.sum((source.isin("municipal", "drone") & (F.col("canonical_type") == "building")).cast("int")).alias("building_count"),
        F.sum((source == "utility").cast("int")).alias("utility_count"),
        F.max(source == "gnss").alias("gnss_verified"), F.max(source == "ground_truth").alias("ground_truth_verified"),
        cadastral.alias("_cad"), fallback.alias("_fall"), F.min_by(F.struct(*form), r).alias("_own"),
        F.count("overall_confidence").alias("n"), mean_score(F.col("overall_confidence")).alias("mean"),
        mean_score(F.col("spatial_proximity")).alias("spatial_confidence"),
        mean_score(F.col("attribute_similarity")).alias("attribute_confidence"),
        mean_score(F.col("geometry_overlap")).alias("geometry_confidence"))
    best = F.coalesce("_cad", "_fall", "_own")
    last = F.filter(F.col("members"), lambda e: ~F.exists(F.col("members"), lambda o: (
        (o["source_type"] == e["source_type"]) & (o["r"] > e["r"]))))
    lineage = F.map_from_arrays(
        F.transform(last, lambda e: e["source_type"]),
        F.transform(last, lambda e: F.struct(*[e[k].alias(k) for k in (
            "dataset_id", "dataset_name", "provenance", "feature_id", "contributed_fields", "confidence")])))
    out = out.withColumns({"lineage": lineage, "source_count": F.size(last)})
    out = _scored(out, cfg).join(groups.select("matched_group_id", F.col("group_number").alias("parcel_rank")),
                                 "matched_group_id")
    return out.select(
        scalar.natural_id("UP", F.col("_anchor")).alias("id"), "matched_group_id", "parcel_rank",
        F.coalesce("survey_number", "_anchor").alias("parcel_id"), "survey_number",
        F.coalesce("_owner", F.lit("Unknown")).alias("owner_name"), best["a"].alias("area"),
        F.coalesce("_use", F.lit("Unclassified")).alias("land_use"),
        geo.to_geojson(best["g"]).alias("geometry_geojson"), "building_count", "utility_count", "gnss_verified",
        "ground_truth_verified", "source_count", "confidence_score", "spatial_confidence", "attribute_confidence",
        "geometry_confidence", "source_agreement", "validation_status", F.lit("NONE").alias("conflict_status"),
        "lineage", "members", F.current_timestamp().alias("last_updated"))
