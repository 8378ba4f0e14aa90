"""Candidate search, pair scoring and best match per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from landrecon.functions import geo, kernel, scalar, text
from landrecon.functions.columns import once
from landrecon.operators import grid
from landrecon.operators.rounds import Rounds
from landrecon.settings import COMPARED_FIELDS, DEFAULTS, IDENTIFIER_FIELDS, Settings

KEYS = ["dataset_id", "kind", "xmin", "ymin", "xmax", "ymax", "centroid_lon", "centroid_lat", "area_sqm"]
COMPARED = ["cmp_" + f for f in COMPARED_FIELDS]
ENCODED_FIELDS = [f for f in COMPARED_FIELDS if f not in IDENTIFIER_FIELDS]
SCORES = ["spatial_proximity", "geometry_overlap", "area_similarity", "attribute_similarity",
          "overall_confidence"]


def canonical_columns(features: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Comparable canonical values as trimmed lower-case columns, blanks as null."""
    return features.withColumns({
        "cmp_" + f: F.nullif(F.lower(F.trim(values[f].cast("string"))), F.lit("")) for f in COMPARED_FIELDS})


def spatial_candidates(anchors: DataFrame, pool: DataFrame, cfg: Settings = DEFAULTS,
                       oversize: bool = False) -> DataFrame:
    """Pairs whose boxes meet after widening the anchor's by the search distance.

    ``oversize`` says that some features span very many cells (see ``grid.has_oversize``).
    """
    a, b = grid.prefixed(anchors, "a_"), grid.prefixed(pool, "b_")
    pad_x, pad_y = grid.search_pad(F.col("a_centroid_lat"), cfg.search_m, cfg)
    return grid.box_pairs(a, b, cfg.cell_deg, pad_x=pad_x, pad_y=pad_y, hot_rows=cfg.hot_rows,
                          max_cells=cfg.oversize_cells if oversize else None)


def distance_join(pairs: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Only pairs from different datasets whose centroids lie within the search distance."""
    d = geo.haversine_m(F.col("a_centroid_lat"), F.col("a_centroid_lon"),
                        F.col("b_centroid_lat"), F.col("b_centroid_lon"))
    out = once(pairs.where(F.col("a_dataset_id") != F.col("b_dataset_id")), distance_m=d)
    return out.where(F.coalesce(F.col("distance_m") <= cfg.search_m, F.lit(True)))


def geometry_overlap(a: Column, b: Column, cfg: Settings = DEFAULTS) -> Column:
    """Overlap ratio for two polygons, closeness for a polygon and something else, else 0."""
    a_poly, b_poly = a["kind"].isin(*geo.POLYGONAL), b["kind"].isin(*geo.POLYGONAL)
    meet = geo.boxes_meet("a_", "b_")
    if cfg.rectangles_only and cfg.metric == "local_plane":
        lat = F.when(a_poly, F.col("a_centroid_lat")).otherwise(F.col("b_centroid_lat"))
        near = F.exp(-geo.box_distance_m("a_", "b_", lat, cfg.metres_per_degree) / cfg.decay_m)
        return (F.when(a_poly & b_poly, geo.box_iou("a_", "b_"))
                .when(a_poly | b_poly, near).otherwise(F.lit(0.0)))
    nothing = F.lit(None).cast(geo.GEOMETRY)
    zone_a = geo.utm_epsg(F.col("a_centroid_lon"), F.col("a_centroid_lat"))
    zone_b = geo.utm_epsg(F.col("b_centroid_lon"), F.col("b_centroid_lat"))
    both, one = a_poly & b_poly & meet, a_poly != b_poly
    utm = cfg.metric == "utm"
    ratio = kernel.iou(F.when(both, a).otherwise(nothing), F.when(both, b).otherwise(nothing),
                       zone_a if utm else None)
    metres = kernel.distance_m(
        F.when(one, F.when(a_poly, b).otherwise(a)).otherwise(nothing),
        F.when(one, F.when(a_poly, a).otherwise(b)).otherwise(nothing),
        F.when(a_poly, zone_a).otherwise(zone_b) if utm else None,
        F.when(a_poly, F.col("a_centroid_lat")).otherwise(F.col("b_centroid_lat")), cfg.metres_per_degree)
    near = F.coalesce(F.exp(-metres / cfg.decay_m), F.lit(0.0))
    return F.when(a_poly & b_poly, F.when(meet, ratio).otherwise(F.lit(0.0))).when(one, near).otherwise(F.lit(0.0))


def _overlap_bound(cfg: Settings) -> Column:
    """No overlap score can exceed this; needs only boxes."""
    a_poly, b_poly = F.col("a_kind").isin(*geo.POLYGONAL), F.col("b_kind").isin(*geo.POLYGONAL)
    lat = F.greatest(F.abs(F.col("a_ymin")), F.abs(F.col("a_ymax")), F.abs(F.col("b_ymin")), F.abs(F.col("b_ymax")))
    # Shrunk by 1% so that the flat distance never exceeds the projected one.
    gap = geo.box_distance_m("a_", "b_", lat, cfg.metres_per_degree) * 0.99
    return (F.when(a_poly & b_poly, geo.boxes_meet("a_", "b_").cast("double"))
            .when(a_poly | b_poly, F.exp(-gap / cfg.decay_m)).otherwise(F.lit(0.0)))


def _attribute_bound(cfg: Settings) -> Column:
    """No attribute score can exceed this; needs only text lengths."""
    scores = []
    if cfg.text_ratio == "equality":
        return F.lit(1.0)
    for f in COMPARED_FIELDS:
        a, b = F.col("a_cmp_" + f), F.col("b_cmp_" + f)
        bound = text.ratio_bound(a, b) if f in IDENTIFIER_FIELDS else F.lit(1.0)
        scores.append(F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, F.lit(1.0)).otherwise(bound)))
    return scalar.attribute_similarity(scores)


def score_pairs(pairs: DataFrame, cfg: Settings = DEFAULTS, encoder=None, keep_all: bool = False) -> DataFrame:
    """Four sub-scores and the weighted total, in percent with one decimal.

    Pairs that cannot reach the minimum are dropped before the costly scores: the total without
    overlap and text bounds it from above. ``encoder`` maps a text column to a column of unit vectors (a
    pair of them: for the anchor's and for the candidate's texts), or is a table that ``vectors`` made.
    """
    w = cfg
    cheap = once(pairs, _prox=scalar.spatial_proximity(F.col("distance_m"), cfg),
                  _area=scalar.area_similarity(F.col("a_area_sqm"), F.col("b_area_sqm")))
    if not keep_all:
        best = (w.weight_proximity * F.col("_prox") + w.weight_area * F.col("_area")
                + w.weight_overlap * _overlap_bound(cfg) + w.weight_attribute * _attribute_bound(cfg))
        # Half a unit of the rounded decimal below the minimum still rounds up to it.
        cheap = cheap.where(best >= (cfg.min_match_confidence - 0.05) / 100 - 1e-9)
    scored = _with_attributes(cheap, cfg, encoder)
    if not keep_all and cfg.text_ratio != "equality":
        best = (w.weight_proximity * F.col("_prox") + w.weight_area * F.col("_area")
                + w.weight_overlap * _overlap_bound(cfg) + w.weight_attribute * F.col("_attr"))
        scored = scored.where(best >= (cfg.min_match_confidence - 0.05) / 100 - 1e-9)
    scored = once(scored, _over=geometry_overlap(_side("a_", cfg), _side("b_", cfg), cfg))
    total = (w.weight_proximity * F.col("_prox") + w.weight_overlap * F.col("_over")
             + w.weight_area * F.col("_area") + w.weight_attribute * F.col("_attr"))
    total = F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
    out = once(scored, spatial_proximity=F.round(F.col("_prox") * 100, 1),
                geometry_overlap=F.round(F.col("_over") * 100, 1),
                area_similarity=F.round(F.col("_area") * 100, 1),
                attribute_similarity=F.round(F.col("_attr") * 100, 1),
                overall_confidence=F.round(total * 100, 1)).drop("_prox", "_over", "_area", "_attr")
    return out if keep_all else out.where(F.col("overall_confidence") >= cfg.min_match_confidence)


def _side(p: str, cfg: Settings) -> Column:
    if cfg.rectangles_only and cfg.metric == "local_plane":
        return F.struct(F.col(p + "kind").alias("kind"))
    return F.col(p + "geom")


def vectors(features: DataFrame, encoder, rounds: Rounds) -> DataFrame:
    """Written table of the vector of every distinct compared text; each is encoded once."""
    return rounds.keep(text.vector_table(features, ["cmp_" + f for f in ENCODED_FIELDS], encoder))


def _with_attributes(pairs: DataFrame, cfg: Settings, encoder) -> DataFrame:
    scores, table, alike = [], None, None
    if cfg.text_ratio != "equality" or encoder is not None:
        # The pairs feed both the distinct texts and the look-ups, so they are written once.
        rounds = Rounds(pairs.sparkSession)
        pairs = rounds.keep(pairs)
    if cfg.text_ratio != "equality":
        table = rounds.keep(text.ratio_table(pairs, [("a_cmp_" + f, "b_cmp_" + f) for f in COMPARED_FIELDS]))
    if encoder is not None:
        known = encoder if isinstance(encoder, DataFrame) else rounds.keep(text.vector_table(
            pairs, [p + f for f in ENCODED_FIELDS for p in ("a_cmp_", "b_cmp_")], encoder))
        alike = rounds.keep(text.alike_table(pairs, [("a_cmp_" + f, "b_cmp_" + f) for f in ENCODED_FIELDS], known))
    for f in COMPARED_FIELDS:
        a, b, out = "a_cmp_" + f, "b_cmp_" + f, "_sim_" + f
        if table is None:
            pairs = pairs.withColumn(out, (F.col(a) == F.col(b)).cast("double"))
        else:
            pairs = text.look_up(pairs, table, a, b, out)
        if alike is not None and f in ENCODED_FIELDS:
            pairs = text.look_up_alike(pairs, alike, a, b, "_alike")
            blended = cfg.fuzzy_weight * F.col(out) + cfg.embedding_weight * F.col("_alike")
            pairs = pairs.withColumn(out, F.coalesce(blended, F.col(out))).drop("_alike")
        scores.append(F.col(out))
    out = pairs.withColumn("_attr", scalar.attribute_similarity(scores))
    return out.drop(*["_sim_" + f for f in COMPARED_FIELDS])


def match_columns(cfg: Settings) -> list[str]:
    extra = [] if cfg.rectangles_only and cfg.metric == "local_plane" else ["geom"]
    return KEYS + COMPARED + extra


def shapes(features: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Groups of features that are exact copies for matching: same place, shape and texts."""
    return grid.distinct_shapes(features, match_columns(cfg), [])


def scored_shapes(anchors: DataFrame, pool: DataFrame, cfg: Settings = DEFAULTS, encoder=None) -> DataFrame:
    """Scored pairs of distinct shapes, with the members' order kept as ``*_ordinal``."""
    pairs = distance_join(spatial_candidates(shapes(anchors, cfg), shapes(pool, cfg), cfg), cfg)
    return score_pairs(pairs, cfg, encoder)


def best_match_per_dataset(anchors: DataFrame, pool: DataFrame, cfg: Settings = DEFAULTS, encoder=None) -> DataFrame:
    """Each anchor's best candidate in every other dataset; earlier features win ties.

    The choice is an aggregate with a map-side combine on distinct shapes, so a place with very
    many copies costs one row; the anchors that share a shape are joined back at the end.
    """
    scored = scored_shapes(anchors, pool, cfg, encoder)
    best = scored.groupBy("a_shape_id", "b_dataset_id").agg(F.min(F.struct(
        (-F.col("overall_confidence")).alias("o"), F.col("b_ordinal").alias("n"),
        F.col("b_feature_id").alias("f"), *[F.col(s) for s in SCORES])).alias("m"))
    members = anchors.select(F.col("feature_id").alias("anchor_id"), F.col("ordinal").alias("anchor_ordinal"),
                             grid.shape_id(match_columns(cfg)).alias("a_shape_id"))
    return members.join(best, "a_shape_id").select(
        "anchor_id", "anchor_ordinal", F.col("b_dataset_id").alias("dataset_id"),
        F.col("m.f").alias("feature_id"), *[F.col("m." + s).alias(s) for s in SCORES])


def group_confidence(matches: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    return (matches.where(F.col("overall_confidence") >= min_confidence).groupBy("matched_group_id")
            .agg(F.count(F.lit(1)).alias("matches"), *[F.round(F.avg(s), 4).alias(s) for s in SCORES]))


def group_numbering(groups: DataFrame, order: list[str]) -> DataFrame:
    """``GRP-0001`` and so on in the order of ``order``, whose last column is a dense integer.

    The leading columns have few values; rows are numbered per block of the last column, and only
    block counts meet in one running sum.
    """
    *lead, last = order
    blocked = groups.withColumn("_block", F.shiftright(F.col(last), 16))
    counts = blocked.groupBy(*lead, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*lead, "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy(*lead, "_block").orderBy(last))
    number = F.col("_start") + F.col("_rank")
    digits = F.greatest(F.lit(4), F.length(number.cast("string")))
    return (blocked.withColumn("_rank", rank).join(starts, lead + ["_block"])
            .withColumn("group_number", number)
            .withColumn("matched_group_id", F.concat(F.lit("GRP-"), F.lpad(number.cast("string"), digits, F.lit("0"))))
            .drop("_block", "_start", "_rank"))
