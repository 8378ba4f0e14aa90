"""Queries that run the composed stages end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from landrecon import lens
from landrecon.catalog.oracle import PAIRS, lens_sql
from landrecon.catalog.registry import query
from landrecon.catalog.spatial import lens_members
from landrecon.lens import LENS
from landrecon.operators import match, unify
from landrecon.operators.rounds import Rounds
from landrecon.plans.harmonize import harmonize as run


@query("build_unified_parcels", lens_sql("""
SELECT feature_id AS matched_group_id, CASE WHEN n > 0 THEN m ELSE agree END AS confidence_score, agree AS source_agreement,
  src AS source_count, coalesce(utilities, 0) AS utility_count, coalesce(gnss, 0) > 0 AS gnss_verified, id_key AS parcel_id,
  round(area, 3) AS area
FROM (SELECT l.*, coalesce(b.n, 0) AS n, b.m, 1 + coalesce(b.n, 0) AS src, round(least(100, (1 + coalesce(b.n, 0)) / 5e0 * 100), 1) AS agree,
    b.utilities, b.gnss
  FROM lens l JOIN (SELECT a_id, count(*) AS n, round(sum(round(overall_confidence * 10)::BIGINT) / count(*) / 10, 1) AS m, count(*) FILTER (b_dataset = 'DS-utility') AS utilities,
    count(*) FILTER (b_dataset = 'DS-gnss') AS gnss FROM best GROUP BY 1) b ON a_id = l.feature_id)""", PAIRS))
def build_unified_parcels(spark, sf_dir):
    """Unified records of the groups formed by each anchor's best matches."""
    members = lens_members(spark, sf_dir)
    canonical = F.map_from_arrays(
        F.array(*[F.lit(f) for f in ("owner_name", "land_use", "parcel_id")]),
        F.array("cmp_owner_name", "cmp_land_use", F.upper("cmp_parcel_id")))
    members = Rounds(spark).keep(members.withColumn("canonical", canonical))
    groups = members.where("member_rank = 0").select("matched_group_id", F.col("ordinal").alias("group_number"))
    out = unify.build_unified_parcels(members, lens.datasets(spark, sf_dir), groups, LENS)
    return out.select("matched_group_id", "confidence_score", "source_agreement", "source_count", "utility_count",
                      "gnss_verified", "parcel_id", F.round("area", 3).alias("area"))


@query("harmonize")
def harmonize(spark, sf_dir):
    """A full run over all layers: its unified parcels."""
    tables = run(spark, lens.features(spark, sf_dir, mapped=False), lens.datasets(spark, sf_dir), cfg=LENS)
    return tables["unified_parcels"].select(
        "id", "parcel_id", "owner_name", "land_use", "source_count", "confidence_score", "validation_status", "conflict_status")


def flagship(spark, sf_dir):
    """Matched sources and mean confidence of every cadastral parcel."""
    f = lens.features(spark, sf_dir)
    best = match.best_match_per_dataset(f.where(F.col("source_type") == "cadastral"), f, LENS)
    return best.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("sources"),
                                         unify.mean_score(F.col("overall_confidence")).alias("confidence"))
