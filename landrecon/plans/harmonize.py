"""The whole run: features of several sources in, result tables out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landrecon.operators import changes, conflicts, exclusive, mapping, topology, unify
from landrecon.operators.rounds import Rounds
from landrecon.session import ship
from landrecon.settings import DEFAULTS, Settings


def stage_metrics(spark: SparkSession, counts: dict[str, DataFrame]) -> DataFrame:
    """One row per stage with its processed and warning counts, from one-row aggregates."""
    out = None
    for position, (name, df) in enumerate(counts.items()):
        one = df.select(F.lit(position).alias("position"), F.lit(name).alias("name"), F.lit("completed").alias("status"),
                        F.col("processed").cast("long").alias("processed"), F.col("warnings").cast("long").alias("warnings"),
                        F.lit(0).cast("long").alias("errors"))
        out = one if out is None else out.unionByName(one)
    return out


def _count(df: DataFrame, warnings=None, counted=None) -> DataFrame:
    n = F.count(F.lit(1) if counted is None else counted)
    return df.agg(n.alias("processed"), (F.lit(0) if warnings is None else F.coalesce(
        F.sum(warnings), F.lit(0))).alias("warnings"))


def harmonize(spark: SparkSession, features: DataFrame, datasets: DataFrame, *, cfg: Settings = DEFAULTS,
              overrides: DataFrame | None = None, previous_validation: DataFrame | None = None,
              existing_conflicts: DataFrame | None = None, previous_parcels: DataFrame | None = None,
              encoder=None, rounds: Rounds | None = None) -> dict[str, DataFrame]:
    """All result tables of one run. Without ``previous_parcels`` every parcel is reported as new.

    Tables that later stages read several times are kept in the checkpoint folder, so a stage is
    computed once and survives the loss of executors; everything else stays lazy.
    """
    ship(spark)
    rounds = rounds or Rounds(spark)
    source = rounds.keep(features)
    mappings = rounds.keep(mapping.schema_mapping(source, overrides, cfg))
    overlaps = topology.LayerOverlaps(source, cfg, rounds=rounds)
    checked, validation = topology.topology_validation(source, previous_validation, cfg, overlaps)
    checked = mapping.with_compared(mapping.apply_mapping(checked, mappings))
    checked, validation = rounds.keep(checked), rounds.keep(validation)
    groups, matches = exclusive.exclusive_matching(checked, datasets, cfg, encoder, rounds)
    groups, matches = rounds.keep(groups), rounds.keep(matches)
    members = rounds.keep(exclusive.group_members(groups, matches, checked))
    found = rounds.keep(conflicts.all_conflicts(checked, members, datasets, existing_conflicts, cfg))
    parcels = rounds.keep(unify.build_unified_parcels(members, datasets, groups, cfg))
    linked = conflicts.link_conflicts_to_parcels(found, parcels)
    parcels = conflicts.conflict_status(parcels, found)
    ids = parcels.select("matched_group_id", F.col("id").alias("parcel_unified_id"))
    matches = matches.join(ids, "matched_group_id").withColumn(
        "id", F.concat(F.lit("MT-"), F.substring(F.sha2(F.col("feature_id"), 256), 1, 12)))
    versions = changes.source_version_changes(_with_text(checked), datasets).select(*changes.EVENT)
    now = changes.snapshot(parcels).join(parcels.select("id", "confidence_score"), "id")
    before = changes.snapshot(parcels).limit(0) if previous_parcels is None else previous_parcels
    events = changes.parcel_changes(before, now, cfg).select(*changes.EVENT).unionByName(versions)
    n_parcels = _count(parcels)
    stages = stage_metrics(spark, {
        "Ingestion": _count(datasets), "CRS Normalization": _count(source, counted=F.col("geom")),
        "Schema Mapping": _count(mappings, F.col("needs_review").cast("int")),
        "Topology Validation": _count(
            checked.select(F.lit(1).alias("n"), F.lit(0).alias("w")).unionByName(
                validation.select(F.lit(None).cast("int").alias("n"), F.col("pair_count").alias("w"))),
            F.col("w"), F.col("n")),
        "Spatial Matching": _count(matches), "Conflict Detection": _count(
            checked.select(F.lit(1).alias("n"), F.lit(0).alias("w")).unionByName(
                found.select(F.lit(None).cast("int").alias("n"), F.lit(1).alias("w"))), F.col("w"), F.col("n")),
        "Conflict Resolution": _count(found), "Confidence Scoring": n_parcels, "Unified Land Record": n_parcels,
        "Change Detection": _count(events)})
    return {"features": checked, "attribute_mappings": mappings, "validation_results": validation, "groups": groups,
            "matches": matches, "members": members, "conflicts": linked, "unified_parcels": parcels,
            "change_events": events, "stages": stages}


def _with_text(features: DataFrame) -> DataFrame:
    from landrecon.functions import geo

    return features.withColumn("geometry_geojson", geo.to_geojson(F.col("geom")))
