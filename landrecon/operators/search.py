"""Read queries over the result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landrecon.functions import geo, scalar
from landrecon.functions.columns import fixed
from landrecon.operators import match, skew


def search_parcels(parcels: DataFrame, *, search: str | None = None, land_use: str | None = None,
                   validation_status: str | None = None, conflict_status: str | None = None,
                   min_confidence: float | None = None, sort_by: str = "confidence_score", sort_dir: str = "desc",
                   limit: int = 500, role: str | None = None) -> DataFrame:
    """Filtered, sorted and limited parcels; owners are searched and shown only to privileged roles."""
    out = parcels
    if search:
        text = F.col("parcel_id").ilike(f"%{search}%")
        if scalar.can_view_owners(role):
            text = text | F.col("owner_name").ilike(f"%{search}%")
        out = out.where(text)
    for name, value in (("land_use", land_use), ("validation_status", validation_status),
                        ("conflict_status", conflict_status)):
        if value:
            out = out.where(F.col(name) == value)
    if min_confidence is not None:
        out = out.where(F.col("confidence_score") >= min_confidence)
    return top_parcels(redact_owner(out, role), sort_by, sort_dir, limit)


def top_parcels(parcels: DataFrame, sort_by: str = "confidence_score", sort_dir: str = "desc",
                limit: int = 500) -> DataFrame:
    """Unknown sort columns fall back to the confidence; ties go by id."""
    key = F.col(sort_by if sort_by in parcels.columns else "confidence_score")
    return parcels.orderBy(key.desc() if sort_dir == "desc" else key.asc(), "id").limit(allowed(limit, 2000))


def allowed(limit: int, most: int) -> int:
    """A larger request is refused, not silently cut."""
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be between 1 and {most}")
    return limit


def redact_owner(parcels: DataFrame, role: str | None) -> DataFrame:
    return parcels.withColumn("owner_name", scalar.redact_owner(F.col("owner_name"), role))


def parcel_detail(parcels: DataFrame, parcel_id: str | Column, role: str | None = None) -> DataFrame:
    return redact_owner(parcels.where(F.col("id") == parcel_id), role)


def search_matches(matches: DataFrame, group_id: str | None = None, min_confidence: float | None = None,
                   limit: int = 500) -> DataFrame:
    out = matches
    if group_id:
        out = out.where(F.col("matched_group_id") == group_id)
    if min_confidence is not None:
        out = out.where(F.col("overall_confidence") >= min_confidence)
    return top_matches(out, limit)


def top_matches(matches: DataFrame, limit: int = 500) -> DataFrame:
    return matches.orderBy(F.desc("overall_confidence"), "id").limit(allowed(limit, 3000))


def search_conflicts(conflicts: DataFrame, status: str | None = None, severity: str | None = None,
                     conflict_type: str | None = None, role: str | None = None) -> DataFrame:
    out = conflicts
    if not scalar.can_view_owners(role):
        out = out.where(F.col("conflict_type") != "owner_mismatch")
    for name, value in (("status", status), ("severity", severity), ("conflict_type", conflict_type)):
        if value:
            out = out.where(F.col(name) == value)
    return out.orderBy(F.desc("created_at"), "id")


def search_changes(changes: DataFrame, change_type: str | None = None, role: str | None = None) -> DataFrame:
    out = changes.where(F.col("change_type") == change_type) if change_type else changes
    if not scalar.can_view_owners(role):
        out = out.withColumns({c: scalar.mask_personal_json(F.col(c)) for c in ("before", "after")})
    return out.orderBy(F.desc("detected_at"), "id")


def search_mappings(mappings: DataFrame, dataset_id: str | None = None) -> DataFrame:
    return mappings.where(F.col("dataset_id") == dataset_id) if dataset_id else mappings


def recent_jobs(jobs: DataFrame, limit: int = 20) -> DataFrame:
    return jobs.orderBy(F.desc("started_at"), "id").limit(limit)


def dataset_catalog(datasets: DataFrame) -> DataFrame:
    return datasets.orderBy(F.desc("uploaded_at"), "dataset_id")


def topology_evidence(validation: DataFrame) -> DataFrame:
    return validation.select("id", "dataset_id", "feature_id", "issue_type", "is_valid", "corrected",
                             "original_geometry", "corrected_geometry").orderBy("dataset_id", "id")


def audit_log(audit: DataFrame, limit: int = 100) -> DataFrame:
    return audit.orderBy(F.desc("created_at"), "id").limit(min(max(limit, 1), 500))


def map_layer_features(parcels: DataFrame) -> DataFrame:
    """Parcels that can be drawn, with their labels."""
    shown = parcels.where(geo.parse_geojson(F.col("geometry_geojson")).isNotNull())
    return shown.select(
        "id", "parcel_id", "owner_name", "geometry_geojson",
        F.when(F.col("area") != 0, F.concat(fixed(F.col("area")), F.lit(" m²")))
        .otherwise("N/A").alias("area"),
        "land_use", F.concat(F.floor(F.col("confidence_score") + 0.5), F.lit("%")).alias("confidence"),
        "validation_status", "conflict_status")


def link_key() -> Column:
    """The parcel a feature refers to, by its source type."""
    p = F.col("properties")
    return (F.when(F.col("source_type") == "revenue", p["survey_no"])
            .when(F.col("source_type") == "municipal", p["linked_parcel"])
            .when(F.col("source_type") == "gnss", p["linked_parcel_id"])
            .otherwise(p["parcel_id"]))


def subset_by_keys(features: DataFrame, keys: DataFrame, utilities: int = 12, cadastral_rows: int = 32) -> DataFrame:
    """Features linked to the parcels in ``keys (parcel_id)``, plus what a small sample area also shows.

    The first utility lines of each dataset are kept, and invalid cadastral polygons fill the
    cadastral selection up to a fixed number of rows.
    """
    tagged = features.withColumn("_key", link_key())
    linked = tagged.where(F.col("source_type") != "utility").join(
        keys.select(F.col("parcel_id").alias("_key")).distinct(), "_key", "left_semi")
    lines = tagged.where(F.col("source_type") == "utility")
    lines = skew.running_position(lines, ["dataset_id"], "ordinal", "_n").where(F.col("_n") <= utilities).drop("_n")
    spare = tagged.where((F.col("source_type") == "cadastral") & ~F.col("is_valid") & F.col("kind").isNotNull()).join(
        keys.select(F.col("parcel_id").alias("_key")).distinct(), "_key", "left_anti")
    taken = linked.where(F.col("source_type") == "cadastral").groupBy("dataset_id").agg(F.count(F.lit(1)).alias("_t"))
    spare = skew.running_position(spare, ["dataset_id"], "ordinal", "_n").join(taken, "dataset_id", "left").where(
        F.col("_n") + F.coalesce("_t", F.lit(0)) <= cadastral_rows).drop("_n", "_t")
    cols = features.columns
    return linked.select(cols).unionByName(lines.select(cols)).unionByName(spare.select(cols))


def report_sections(**tables: DataFrame) -> dict[str, DataFrame]:
    """The sections of a result report: whole tables, records and matches with the surest first."""
    first = {"unified_records": "confidence_score", "matches": "overall_confidence"}
    return {name: df.orderBy(F.desc(first[name]), "id") if name in first else df for name, df in tables.items()}


def group_confidence(matches: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    return match.group_confidence(matches, min_confidence)
