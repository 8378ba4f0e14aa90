"""The seven conflict detectors and what is done with their findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landrecon.functions import geo, kernel, scalar, text
from landrecon.functions.columns import fixed
from landrecon.operators import grid, skew, topology
from landrecon.operators.rounds import Rounds
from landrecon.settings import (CONFLICT_STATUSES, DEFAULTS, DUPLICATE_KEY_FIELDS, PERSONAL_KEYS,
                                TERMINAL_STATUSES, Settings)

COLUMNS = ["conflict_type", "severity", "feature_ref", "source_a", "source_b", "description",
           "confidence", "recommended_action", "pair_count"]


def _percent(ratio: Column) -> Column:
    return F.concat(fixed(ratio * 100), F.lit("%"))


def _finding(df: DataFrame, kind: str, severity: Column, ref: Column, a: Column, b: Column,
             description: Column, confidence: Column, action: str, count: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(kind).alias("conflict_type"), severity.alias("severity"), ref.alias("feature_ref"),
        a.cast("string").alias("source_a"), b.cast("string").alias("source_b"),
        description.alias("description"), confidence.cast("double").alias("confidence"),
        F.lit(action).alias("recommended_action"),
        (F.lit(1) if count is None else count).cast("long").alias("pair_count"))


def parcel_overlap_conflicts(features: DataFrame, cfg: Settings = DEFAULTS,
                             overlaps: topology.LayerOverlaps | None = None) -> DataFrame:
    """Parcels of one dataset that partly overlap a later one."""
    overlaps = overlaps or topology.LayerOverlaps(features.where(F.col("canonical_type") == "parcel"), cfg)
    wanted = (F.col("iou") > cfg.overlap_iou) & (F.col("iou") < cfg.duplicate_iou)
    rows = overlaps.feature_partners(wanted, copies=False).where(F.col("later") > 0)
    return _finding(
        rows, "parcel_overlap", F.when(F.col("iou") < cfg.overlap_major_iou, "MODERATE").otherwise("MAJOR"),
        F.col("feature_id"), F.col("dataset_id"), F.col("dataset_id"),
        F.concat(F.lit("Parcels "), "feature_id", F.lit(" and "), "p_last_feature_id", F.lit(" overlap by "),
                 _percent(F.col("iou")), F.lit(" (IoU)")),
        F.round(F.col("iou") * 100, 1), "Review parcel boundaries and adjust geometry", F.col("later"))


def _shapes(features: DataFrame, canonical: str, cfg: Settings) -> DataFrame:
    one = features.where((F.col("canonical_type") == canonical) & F.col("kind").isNotNull())
    return grid.distinct_shapes(one, topology.shape_columns(cfg), [])


def _members(features: DataFrame, canonical: str, cfg: Settings) -> DataFrame:
    return features.where(F.col("canonical_type") == canonical).select(
        "feature_id", "dataset_id", grid.shape_id(topology.shape_columns(cfg)).alias("shape_id"))


def _lowest_parcel() -> Column:
    return F.min(F.struct(F.col("a_dataset_id").alias("dataset_id"), F.col("a_ordinal").alias("ordinal"),
                          F.col("a_feature_id").alias("feature_id"), F.col("score").alias("score")))


def building_crossing_conflicts(features: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Buildings that share only part of their area with a parcel: one conflict per building."""
    parcels = _shapes(features.where(F.col("kind").isin(*geo.POLYGONAL)), "parcel", cfg)
    buildings = _shapes(features.where(F.col("kind").isin(*geo.POLYGONAL)), "building", cfg)
    pairs = grid.box_pairs(grid.prefixed(parcels, "a_"), grid.prefixed(buildings, "b_"),
                           cfg.same_layer_cell_deg, hot_rows=cfg.hot_rows, max_cells=_wide(features, cfg, "parcel", "building"))
    score = topology.pair_iou(cfg, "b_", "a_")
    pairs = pairs.withColumn("score", score).where(
        (F.col("score") > cfg.crossing_min_iou) & (F.col("score") < cfg.crossing_max_iou))
    first = pairs.groupBy(F.col("b_shape_id").alias("shape_id")).agg(_lowest_parcel().alias("p"))
    rows = _members(features, "building", cfg).join(first, "shape_id")
    return _finding(
        rows, "building_boundary_crossing",
        F.when(F.col("p.score") > cfg.crossing_minor_iou, "MINOR").otherwise("MODERATE"),
        F.col("feature_id"), F.col("dataset_id"), F.col("p.dataset_id"),
        F.concat(F.lit("Building "), "feature_id", F.lit(" crosses parcel "), "p.feature_id",
                 F.lit(" boundary (overlap ratio "), _percent(F.col("p.score")), F.lit(")")),
        F.round((1 - F.col("p.score")) * 100, 1), "Verify building footprint against surveyed parcel boundary")


def utility_crossing_conflicts(features: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Utility lines that meet a parcel without lying wholly inside it: one per utility."""
    columns = ["dataset_id", "kind", *grid.BOX, "geom"]
    parcels = features.where((F.col("canonical_type") == "parcel") & F.col("kind").isin(*geo.POLYGONAL))
    lines = features.where((F.col("canonical_type") == "utility") & F.col("kind").isNotNull())
    a = grid.distinct_shapes(parcels, columns, [])
    b = grid.distinct_shapes(lines, columns, [])
    pairs = grid.box_pairs(grid.prefixed(a, "a_"), grid.prefixed(b, "b_"), cfg.same_layer_cell_deg,
                           hot_rows=cfg.hot_rows, max_cells=_wide(features, cfg, "parcel", "utility"))
    pairs = pairs.withColumn("score", kernel.line_relation_to(F.col("b_geom"), F.col("a_geom")).cast("double"))
    first = (pairs.where(F.col("score") == 1).groupBy(F.col("b_shape_id").alias("shape_id"))
             .agg(_lowest_parcel().alias("p")))
    members = lines.select("feature_id", "dataset_id", grid.shape_id(columns).alias("shape_id"))
    return _finding(
        members.join(first, "shape_id"), "utility_crossing", F.lit("MINOR"), F.col("feature_id"),
        F.col("dataset_id"), F.col("p.dataset_id"),
        F.concat(F.lit("Utility line "), "feature_id", F.lit(" crosses parcel "), "p.feature_id", F.lit(" boundary")),
        F.lit(70.0), "Coordinate with Utility Department for easement verification")


def _closeness(cfg: Settings) -> Column:
    """1 inside parcel ``a_``, else decaying with the distance of point ``b_``."""
    if cfg.rectangles_only and cfg.metric == "local_plane":
        d = geo.box_distance_m("a_", "b_", F.col("a_centroid_lat"), cfg.metres_per_degree)
    else:
        zone = geo.utm_epsg(F.col("a_centroid_lon"), F.col("a_centroid_lat")) if cfg.metric == "utm" else None
        d = kernel.distance_m(F.col("b_geom"), F.col("a_geom"), zone, F.col("a_centroid_lat"), cfg.metres_per_degree)
    return F.exp(-d / cfg.decay_m)


def _wide(features: DataFrame, cfg: Settings, *canonical: str, cell: float | None = None) -> int | None:
    return grid.wide_cells(cell or cfg.same_layer_cell_deg, cfg, features.where(F.col("canonical_type").isin(*canonical)))


def nearest_parcel_score(parcels: DataFrame, points: DataFrame, reach_m: float, cfg: Settings, wide: int | None = None) -> DataFrame:
    """Best closeness of each distinct point among the parcels within ``reach_m``."""
    a, b = grid.prefixed(parcels, "a_"), grid.prefixed(points, "b_")
    # One percent of slack covers the scale error of the flat degree box; the edge nearer to a pole needs the wider one.
    pad_x, pad_y = grid.search_pad(F.greatest(F.abs(F.col("a_ymin")), F.abs(F.col("a_ymax"))), reach_m * 1.01, cfg)
    cell = max(cfg.same_layer_cell_deg, 2 * reach_m / cfg.metres_per_degree)
    pairs = grid.box_pairs(a, b, cell, pad_x=pad_x, pad_y=pad_y, hot_rows=cfg.hot_rows, max_cells=wide)
    return pairs.groupBy(F.col("b_shape_id").alias("shape_id")).agg(F.max(_closeness(cfg)).alias("score"))


def gnss_outside_conflicts(features: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Survey points far from every parcel.

    Most points lie in or near a parcel, and a short search settles them. Only the rest look as far
    as the distance where the score rounds to zero.
    """
    from math import log

    rounds = Rounds(features.sparkSession)  # both searches read parcels and points, and lost points have several readers
    parcels = rounds.keep(_shapes(features.where(F.col("kind").isin(*geo.POLYGONAL)), "parcel", cfg))
    points = rounds.keep(_shapes(features, "gnss_point", cfg))
    wide = _wide(features, cfg, "parcel")
    near = nearest_parcel_score(parcels, points, cfg.decay_m * log(1 / cfg.gnss_outside) + 1, cfg, wide)
    lost = rounds.keep(points.join(near.where(F.col("score") >= cfg.gnss_outside), "shape_id", "left_anti"))
    score = rounds.keep(nearest_parcel_score(parcels, lost, cfg.decay_m * log(2000), cfg, wide))  # beyond it the score rounds to zero
    rows = (_members(features, "gnss_point", cfg)
            .join(lost.select("shape_id").join(score, "shape_id", "left"), "shape_id")
            .withColumn("score", F.coalesce("score", F.lit(0.0))).where(F.col("score") < cfg.gnss_outside))
    return _finding(
        rows, "gnss_outside_parcel", F.lit("MINOR"), F.col("feature_id"), F.col("dataset_id"), F.lit(None),
        F.concat(F.lit("GNSS survey point "), "feature_id", F.lit(" lies outside all known parcel boundaries "
                 "(nearest match confidence "), _percent(F.col("score")), F.lit(")")),
        F.round(F.col("score") * 100, 1), "Re-verify GNSS point placement in field")


def area_mismatch_conflicts(members: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Groups whose largest and smallest positive areas differ too much.

    ``members`` has the group, the feature with its area and ``member_rank`` (anchor 0).
    """
    # Matched features come before the anchor when areas tie.
    order = F.when(F.col("member_rank") == 0, F.lit(2**31)).otherwise(F.col("member_rank"))
    who = [F.col("feature_id").alias("f"), F.col("dataset_id").alias("d")]
    ranked = members.where(F.col("area_sqm") > 0).groupBy("matched_group_id").agg(
        F.min(F.struct((-F.col("area_sqm")).alias("area"), order.alias("o"), *who)).alias("hi"),
        F.min(F.struct(F.col("area_sqm").alias("area"), order.alias("o"), *who)).alias("lo"),
        F.count(F.lit(1)).alias("n"))
    high, low = -F.col("hi.area"), F.col("lo.area")
    rel = (high - low) / high
    rows = ranked.where(F.col("n") >= 2).withColumn("rel", rel).where(F.col("rel") > cfg.area_mismatch)
    return _finding(
        rows, "area_mismatch", F.when(F.col("rel") < cfg.area_mismatch_major, "MODERATE").otherwise("MAJOR"),
        F.col("hi.f"), F.col("hi.d"), F.col("lo.d"),
        F.concat(F.lit("Area mismatch of "), _percent(F.col("rel")), F.lit(" between sources for group "),
                 "matched_group_id", F.lit(" ("), fixed(low), F.lit(" m² vs "), fixed(high), F.lit(" m²)")),
        F.round((1 - F.col("rel")) * 100, 1), "Reconcile recorded area against ground survey")


def duplicate_id_conflicts(features: DataFrame, datasets: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Later features that repeat an identifier of their dataset."""
    keyed = features.select("feature_id", "dataset_id", "ordinal", scalar.first_present(
        F.col("properties"), DUPLICATE_KEY_FIELDS).alias("key")).where(F.col("key").isNotNull())
    first = keyed.groupBy("dataset_id", "key").agg(
        F.min(F.struct("ordinal", "feature_id")).alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    many, few = skew.salted(keyed, first, ["dataset_id", "key"], F.col("ordinal"), cfg.hot_rows)
    rows = many.join(few, ["dataset_id", "key", "_salt"]).where(F.col("ordinal") > F.col("first.ordinal"))
    rows = skew.lookup_join(rows, datasets.select("dataset_id", "name"), ["dataset_id"], F.col("ordinal"))
    return _finding(
        rows, "duplicate_id", F.lit("MODERATE"), F.col("feature_id"), F.col("dataset_id"), F.col("dataset_id"),
        F.concat(F.lit("Duplicate identifier '"), "key", F.lit("' found in dataset "), "name", F.lit(" (features "),
                 "first.feature_id", F.lit(" and "), "feature_id", F.lit(")")),
        F.lit(85.0), "De-duplicate records and verify with source department")


def owner_mismatch_conflicts(members: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Members whose recorded owner is unlike the owner of the group's first member with one."""
    named = members.select("matched_group_id", "feature_id", "dataset_id", "member_rank", scalar.first_present(
        F.col("properties"), PERSONAL_KEYS).alias("owner")).where(F.col("owner").isNotNull())
    base = named.groupBy("matched_group_id").agg(
        F.min(F.struct("member_rank", "feature_id", "dataset_id", "owner")).alias("base"))
    rows = (named.join(base, "matched_group_id").where(F.col("feature_id") != F.col("base.feature_id"))
            .withColumns({"_a": F.lower(F.trim("base.owner")), "_b": F.lower(F.trim("owner"))}))
    if cfg.text_ratio == "equality":
        rows = rows.withColumn("score", (F.col("_a") == F.col("_b")).cast("double"))
    else:
        rows = text.with_ratio(rows, "_a", "_b", "score")
    rows = rows.where(F.col("score") < cfg.owner_similarity)
    return _finding(
        rows, "owner_mismatch", F.lit("MODERATE"), F.col("feature_id"), F.col("base.dataset_id"), F.col("dataset_id"),
        F.concat(F.lit("Conflicting owner names for group "), "matched_group_id", F.lit(": '"), "base.owner",
                 F.lit("' vs '"), "owner", F.lit("' (name similarity "), _percent(F.col("score")), F.lit(")")),
        F.round(F.col("score") * 100, 1), "Cross-verify ownership with Revenue Department records")


def all_conflicts(features: DataFrame, members: DataFrame, datasets: DataFrame,
                  existing: DataFrame | None = None, cfg: Settings = DEFAULTS) -> DataFrame:
    """Findings of all detectors as open conflicts; reviewed ones of an earlier run are kept."""
    found = None
    for part in (parcel_overlap_conflicts(features, cfg), building_crossing_conflicts(features, cfg),
                 utility_crossing_conflicts(features, cfg), area_mismatch_conflicts(members, cfg),
                 duplicate_id_conflicts(features, datasets, cfg), gnss_outside_conflicts(features, cfg),
                 owner_mismatch_conflicts(members, cfg)):
        found = part if found is None else found.unionByName(part)
    found = found.select(
        scalar.natural_id("CF", F.col("conflict_type"), F.col("feature_ref"), F.col("description")).alias("id"),
        *COLUMNS, F.lit("Open").alias("status"), F.lit(None).cast("string").alias("parcel_id"),
        F.current_timestamp().alias("created_at"), F.lit(None).cast("timestamp").alias("resolved_at"))
    if existing is None:
        return found
    return existing.where(F.col("status") != "Open").unionByName(found)


def link_conflicts_to_parcels(conflicts: DataFrame, parcels: DataFrame) -> DataFrame:
    """Sets ``parcel_id`` of open conflicts from the parcel whose lineage lists the feature."""
    lines = parcels.select("id", "parcel_rank", F.explode(F.map_values("lineage")).alias("s"))
    owner = lines.groupBy(F.col("s.feature_id").alias("feature_ref")).agg(
        F.max(F.struct("parcel_rank", "id")).alias("last"))
    joined = conflicts.join(owner, "feature_ref", "left")
    linked = F.when(F.col("status") == "Open", F.coalesce(F.col("last.id"), F.col("parcel_id"))).otherwise(
        F.col("parcel_id"))
    return joined.withColumn("parcel_id", linked).select(*conflicts.columns)


def conflict_status(parcels: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Parcels with MAJOR, MINOR or NONE from the open conflicts on any of their features."""
    open_refs = conflicts.where(F.col("status") == "Open").groupBy("feature_ref").agg(
        F.max((F.col("severity") == "MAJOR").cast("int")).alias("major"))
    worst = (parcels.select("id", F.explode(F.map_values("lineage")).alias("s"))
             .join(open_refs, F.col("s.feature_id") == F.col("feature_ref"))
             .groupBy("id").agg(F.max("major").alias("major")))
    status = F.when(F.col("major") == 1, "MAJOR").when(F.col("major") == 0, "MINOR").otherwise("NONE")
    return parcels.join(worst, "id", "left").withColumn("conflict_status", status).drop("major")


def resolve_conflict(conflicts: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conflicts, audit rows)`` after reviewers' decisions ``(id, new_status, actor, decided_at)``.

    Decisions with an unknown status are ignored. The last decision on a conflict counts.
    """
    valid = decisions.where(F.col("new_status").isin(*CONFLICT_STATUSES)).groupBy("id").agg(
        F.max(F.struct("decided_at", "new_status", "actor")).alias("d"))
    joined = conflicts.join(valid, "id", "left")
    done = F.col("d.new_status").isin(*TERMINAL_STATUSES)
    out = joined.withColumns({
        "_before": F.to_json(F.struct("status", "resolved_at"), {"ignoreNullFields": "false"}),
        "status": F.coalesce("d.new_status", "status"),
        "resolved_at": F.when(done, F.col("d.decided_at")).otherwise(F.col("resolved_at"))})
    audit = out.where(F.col("d").isNotNull()).select(
        F.col("d.actor").alias("actor"), F.lit("conflict.status_changed").alias("action"),
        F.lit("conflict").alias("resource_type"), F.col("id").alias("resource_id"),
        F.col("_before").alias("before_state"),
        F.to_json(F.struct("status", "resolved_at"), {"ignoreNullFields": "false"}).alias("after_state"),
        F.col("d.decided_at").alias("created_at"))
    return out.select(*conflicts.columns), audit
