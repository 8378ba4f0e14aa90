"""Geometry validation and same-layer duplicates and overlaps."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landrecon.functions import geo, kernel, scalar
from landrecon.operators import grid, skew
from landrecon.operators.rounds import Rounds
from landrecon.settings import DEFAULTS, Settings


def pair_iou(cfg: Settings, a: str = "a_", b: str = "b_") -> Column:
    """Overlap ratio of the polygons of two prefixed sides."""
    if cfg.rectangles_only and cfg.metric == "local_plane":
        return geo.box_iou(a, b)
    zone = geo.utm_epsg(F.col(a + "centroid_lon"), F.col(a + "centroid_lat")) if cfg.metric == "utm" else None
    return kernel.iou(F.col(a + "geom"), F.col(b + "geom"), zone)


def shape_columns(cfg: Settings) -> list[str]:
    geometry = [] if cfg.rectangles_only and cfg.metric == "local_plane" else ["geom"]
    return ["dataset_id", "kind", *grid.BOX, "centroid_lon", "centroid_lat", *geometry]


def layer_shapes(features: DataFrame, cfg: Settings) -> DataFrame:
    """Distinct polygons per dataset, with the number of features that share each."""
    return grid.distinct_shapes(features.where(F.col("kind").isin(*geo.POLYGONAL)), shape_columns(cfg), [])


class LayerOverlaps:
    """Distinct shapes of each dataset's polygons and the overlap ratio of every two that meet.

    Computed once and kept: duplicates, overlaps and parcel conflicts all read it. Pairs are pairs
    of distinct shapes; features that share a shape are never paired one by one.
    """

    SIDE = ("shape_id", "ordinal", "last_ordinal", "feature_id", "last_feature_id", "copies", "kind")

    def __init__(self, features: DataFrame, cfg: Settings = DEFAULTS, min_iou: float | None = None,
                 rounds: Rounds | None = None):
        self.cfg, self.rounds = cfg, rounds or Rounds(features.sparkSession)
        self.polygons = features.where(F.col("kind").isin(*geo.POLYGONAL))
        self.shapes = self.rounds.keep(layer_shapes(self.polygons, cfg))
        found = grid.box_pairs(
            grid.prefixed(self.shapes, "a_"), grid.prefixed(self.shapes, "b_"), cfg.same_layer_cell_deg,
            on=("dataset_id",), hot_rows=cfg.hot_rows,
            max_cells=grid.wide_cells(cfg.same_layer_cell_deg, cfg, self.shapes)).where(F.col("a_ordinal") < F.col("b_ordinal"))
        least = cfg.overlap_iou if min_iou is None else min_iou
        found = found.withColumn("iou", pair_iou(cfg)).where(F.col("iou") > least)
        self.pairs = self.rounds.keep(found.select("iou", *[p + c for p in ("a_", "b_") for c in self.SIDE]))

    def partners(self, wanted: Column, copies: bool) -> DataFrame:
        """Each shape with each partner shape that ``wanted`` keeps, in both directions.

        With ``copies`` a shape that several features share is its own partner at ratio 1.
        """
        def half(mine: str, other: str) -> Column:
            return F.struct(F.col(mine + "shape_id").alias("shape_id"), "iou",
                            *[F.col(other + c).alias("p_" + c) for c in self.SIDE])

        out = self.pairs.where(wanted).select(F.inline(F.array(half("a_", "b_"), half("b_", "a_"))))
        if copies:
            flat = (F.col("xmax") > F.col("xmin")) & (F.col("ymax") > F.col("ymin"))
            out = out.unionByName(self.shapes.where((F.col("copies") > 1) & flat).select(
                "shape_id", F.lit(1.0).alias("iou"), *[F.col(c).alias("p_" + c) for c in self.SIDE]))
        return out

    def feature_partners(self, wanted: Column, copies: bool) -> DataFrame:
        """Every feature with each partner shape: how many partners come earlier and how many later.

        Counts follow from the partner shape's first and last member unless the two shapes
        interleave; only then members are ranked, block by block.
        """
        partners = self.partners(wanted, copies)
        members = self.polygons.select("feature_id", "dataset_id", "ordinal",
                                       grid.shape_id(shape_columns(self.cfg)).alias("shape_id"))
        both = self.rounds.keep(members.join(partners, "shape_id"))
        apart = ((F.col("p_ordinal") > F.col("ordinal")) | (F.col("p_last_ordinal") < F.col("ordinal"))
                 | (F.col("p_copies") == 1))
        own = F.when(F.col("shape_id") == F.col("p_shape_id"), 1).otherwise(0)
        simple = both.where(apart).withColumn("earlier", F.when(
            F.col("p_ordinal") < F.col("ordinal"), F.col("p_copies")).otherwise(F.lit(0)).cast("long"))
        mixed = both.where(~apart)
        if not mixed.isEmpty():
            simple = simple.unionByName(self._interleaved(mixed, members, partners).select(*simple.columns))
        return simple.withColumn("later", F.col("p_copies") - F.col("earlier") - own)

    def _interleaved(self, mixed: DataFrame, members: DataFrame, partners: DataFrame) -> DataFrame:
        build = (members.withColumnRenamed("shape_id", "p_shape_id")
                 .join(partners.where(F.col("p_copies") > 1).select("shape_id", "p_shape_id"), "p_shape_id"))
        stacked = mixed.withColumn("_build", F.lit(0)).unionByName(
            build.withColumn("_build", F.lit(1)), allowMissingColumns=True)
        # A feature may be probe and build member of its own shape; builds sort behind probes.
        ranked = skew.running_sum(stacked.withColumn("_at", F.col("ordinal") * 2 + F.col("_build")),
                                  ["shape_id", "p_shape_id"], "_at", F.col("_build"), "earlier")
        return ranked.where(F.col("_build") == 0)

    def later(self, wanted: Column, copies: bool) -> DataFrame:
        """One row per later feature and partner shape with earlier members."""
        return self.feature_partners(wanted, copies).where(F.col("earlier") > 0).select(
            "dataset_id", "feature_id", F.col("p_feature_id").alias("partner_id"), "iou",
            F.col("earlier").alias("pair_count"))


def duplicate_geometries(features: DataFrame, cfg: Settings = DEFAULTS,
                         overlaps: LayerOverlaps | None = None) -> DataFrame:
    """Later features that nearly equal earlier ones of their dataset (same geometry type).

    One row per later feature and distinct partner shape; ``pair_count`` says how many earlier
    features have that shape, so a stack of copies stays linear in its size.
    """
    wanted = (F.col("iou") > cfg.duplicate_iou) & (F.col("a_kind") == F.col("b_kind"))
    return (overlaps or LayerOverlaps(features, cfg)).later(wanted, copies=True)


def overlapping_geometries(features: DataFrame, cfg: Settings = DEFAULTS,
                           overlaps: LayerOverlaps | None = None) -> DataFrame:
    """Later features that partly overlap earlier ones of their dataset."""
    wanted = (F.col("iou") > cfg.overlap_iou) & (F.col("iou") <= cfg.duplicate_iou)
    return (overlaps or LayerOverlaps(features, cfg)).later(wanted, copies=False)


def validate_geometry(features: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Adds ``is_valid``, ``issue_type`` and ``corrected_geom``."""
    if cfg.rectangles_only:
        checked = features.withColumns({"_v": F.lit("ok"), "corrected_geom": F.lit(None).cast(geo.GEOMETRY)})
    else:
        checked = features.withColumn("_v", kernel.validity_of(F.col("geom")))
        broken = F.coalesce(F.col("_v") != "ok", F.lit(False))
        checked = checked.withColumn("corrected_geom", kernel.repair(F.col("geom"), broken))
    missing = F.col("geom").isNull()
    broken = F.coalesce(F.col("_v") != "ok", F.lit(False))
    thin = geo.compactness(F.col("geom")) > cfg.sliver_compactness
    return checked.withColumns({
        "is_valid": ~missing & ~broken,
        "issue_type": F.when(missing, "missing_geometry").when(broken, F.col("_v"))
        .when(thin, "sliver").otherwise("none")}).drop("_v")


def earliest_original_geometry(validation: DataFrame) -> DataFrame:
    """Per feature the first validation row, or the first that has an original geometry."""
    has = F.col("original_geometry").isNotNull() & (F.col("original_geometry") != "")
    pick = F.min(F.struct((~F.coalesce(has, F.lit(False))).alias("none"), F.col("position"),
                          F.col("original_geometry"), F.col("issue_type")))
    return validation.groupBy("feature_id").agg(pick.alias("p")).select(
        "feature_id", F.col("p.original_geometry").alias("original_geometry"), F.col("p.issue_type").alias("issue_type"))


def topology_validation(features: DataFrame, previous: DataFrame | None = None, cfg: Settings = DEFAULTS,
                        overlaps: LayerOverlaps | None = None) -> tuple[DataFrame, DataFrame]:
    """``(features with corrected geometry, validation rows)``.

    Duplicates and overlaps are found on the geometry before correction. ``previous`` holds the
    validation rows of an earlier run, whose original geometry is kept.
    """
    checked = validate_geometry(features, cfg).withColumn("_now", geo.to_geojson(F.col("geom")))
    if previous is not None:
        prev = earliest_original_geometry(previous).withColumnsRenamed(
            {"original_geometry": "_prev", "issue_type": "_prev_issue"})
        checked = checked.join(prev, "feature_id", "left")
    else:
        checked = checked.withColumns({"_prev": F.lit(None).cast("string"), "_prev_issue": F.lit(None).cast("string")})
    prev = F.nullif(F.col("_prev"), F.lit(""))
    kept = F.coalesce(prev != F.col("_now"), F.lit(False))
    fixed = F.col("corrected_geom").isNotNull()
    rows = checked.where(~F.col("is_valid") | (F.col("issue_type") != "none") | kept).select(
        "feature_id", "dataset_id", "is_valid",
        F.when(F.col("issue_type") != "none", F.col("issue_type")).when(kept, F.col("_prev_issue"))
        .otherwise("none").alias("issue_type"),
        F.coalesce(prev, F.col("_now")).alias("original_geometry"),
        F.when(fixed, geo.to_geojson(F.col("corrected_geom"))).when(kept, F.col("_now")).alias("corrected_geometry"),
        (fixed | kept).alias("corrected"), F.lit(1).cast("long").alias("pair_count"))
    overlaps = overlaps or LayerOverlaps(features, cfg)
    for issue, found in (("duplicate", duplicate_geometries(features, cfg, overlaps)),
                         ("overlap", overlapping_geometries(features, cfg, overlaps))):
        rows = rows.unionByName(found.groupBy("feature_id", "dataset_id").agg(F.sum("pair_count").alias("pair_count"))
                                .select("feature_id", "dataset_id", F.lit(False).alias("is_valid"),
                                        F.lit(issue).alias("issue_type"),
                                        F.lit(None).cast("string").alias("original_geometry"),
                                        F.lit(None).cast("string").alias("corrected_geometry"),
                                        F.lit(False).alias("corrected"), "pair_count"))
    rows = rows.withColumn("id", scalar.natural_id("VR", F.col("feature_id"), F.col("issue_type")))
    return _corrected(checked, fixed, cfg).drop("_now", "_prev", "_prev_issue", "corrected_geom", "issue_type"), rows


def _corrected(checked: DataFrame, fixed: Column, cfg: Settings) -> DataFrame:
    if cfg.rectangles_only:
        return checked
    g = F.col("corrected_geom")
    box, mid = geo.bbox(g), geo.centroid(g)
    new = {"geom": g, "kind": g["kind"], **{c: box[c] for c in grid.BOX},
           "centroid_lon": mid["x"], "centroid_lat": mid["y"], "area_sqm": geo.area_sqm(g),
           "is_valid": F.lit(True)}
    return checked.withColumns({c: F.when(fixed, v).otherwise(F.col(c)) for c, v in new.items()})


def dedupe_footprints(detections: DataFrame, cfg: Settings = DEFAULTS, rounds: Rounds | None = None) -> DataFrame:
    """Detections in order, without those that overlap an accepted earlier one of their raster by the threshold.

    ``dataset_id`` names the raster a detection comes from.
    Overlaps are measured on the stored degrees. Exact copies go first: all but the earliest of a
    shape are always dropped. What remains is a graph of overlapping distinct shapes, settled in
    rounds: a shape is accepted when all its earlier neighbours are dropped, and dropped when one
    is accepted.
    """
    plane = cfg if cfg.rectangles_only else replace(cfg, metric="plane")
    rounds = rounds or Rounds(detections.sparkSession)
    overlaps = LayerOverlaps(detections, plane, math.nextafter(cfg.footprint_iou, 0), rounds)
    pairs = overlaps.pairs.select(F.col("a_feature_id").alias("earlier"), F.col("b_feature_id").alias("later"))
    state = overlaps.shapes.select("feature_id", F.lit(None).cast("boolean").alias("state"))
    while True:
        blocked = (pairs.join(state.withColumnsRenamed({"feature_id": "earlier", "state": "_s"}), "earlier")
                   .groupBy(F.col("later").alias("feature_id"))
                   .agg(F.max(F.when(F.col("_s").isNull(), 1).when(F.col("_s"), 2).otherwise(0)).alias("_b"),
                        F.max(F.coalesce(F.col("_s"), F.lit(False)).cast("int")).alias("_hit")))
        settled = F.when(F.col("state").isNotNull(), F.col("state")).when(F.col("_hit") == 1, F.lit(False)) \
            .when(F.coalesce(F.col("_b"), F.lit(0)) == 0, F.lit(True))
        state = rounds.keep(state.join(blocked, "feature_id", "left").select("feature_id", settled.alias("state")))
        if state.where(F.col("state").isNull()).isEmpty():
            break
    return detections.join(state.where("state").select("feature_id"), "feature_id", "left_semi")
