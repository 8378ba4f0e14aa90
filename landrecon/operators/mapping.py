"""Source fields to canonical fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from landrecon.functions import scalar, text
from landrecon.operators import match, skew
from landrecon.settings import CANONICAL_SYNONYMS, DEFAULTS, NUMERIC_CANONICAL, Settings


def field_name_union(features: DataFrame) -> DataFrame:
    """Distinct property names per dataset."""
    return features.select("dataset_id", F.explode(F.map_keys("properties")).alias("source_field")).distinct()


def dataset_field_profile(features: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Property names of all features of each dataset, with the value of its sample row: the first with any property.

    Names and sample rows are combined before they are shuffled, so a dataset of any size is a few rows a task.
    """
    place = F.when(F.size("properties") > 0, F.struct("ordinal", "feature_id"))
    samples = features.groupBy("dataset_id").agg(F.min_by("properties", place).alias("sample"))
    return field_name_union(features).join(samples, "dataset_id").select(
        "dataset_id", "source_field", F.map_contains_key("sample", F.col("source_field")).alias("sampled"),
        F.col("sample")[F.col("source_field")].alias("sample_value"))


def synonym_scores(fields: DataFrame, field: str = "source_field") -> DataFrame:
    """Best synonym score of every distinct field name for every canonical field."""
    options = F.array(*[
        F.struct(F.lit(c).alias("canonical_field"), F.lit(i).alias("priority"), F.lit(s).alias("synonym"))
        for i, (c, names) in enumerate(CANONICAL_SYNONYMS.items()) for s in names])
    pairs = (fields.select(field).distinct().withColumn("_n", scalar.normalize_field(F.col(field)))
             .withColumn("_o", F.explode(options)).select(field, "_n", "_o.*"))
    contained = F.contains("synonym", F.col("_n")) | F.contains("_n", F.col("synonym"))
    ratio = text.ratcliff_ratio(F.col("_n"), F.col("synonym"))
    score = F.when(contained, F.greatest(ratio, F.lit(0.85))).otherwise(ratio)
    return pairs.groupBy(field, "canonical_field", "priority").agg(F.max(score).alias("synonym_score"))


def datatype_bonus(value: Column, canonical: Column) -> Column:
    """Small correction for a sample value that fits, or does not fit, the field's type."""
    # The cast alone would take 12D or 7f as numbers.
    is_number = F.coalesce(F.trim(value).rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), F.lit(False))
    return (F.when(canonical.isin(*NUMERIC_CANONICAL), F.when(is_number, 0.08).otherwise(-0.05))
            .otherwise(F.when(is_number, -0.02).otherwise(0.03)))


def map_fields(profile: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Best canonical field of every source field with its confidence in percent."""
    scored = profile.join(synonym_scores(profile), "source_field")
    bonus = F.when(F.col("sampled"), datatype_bonus(F.col("sample_value"), F.col("canonical_field"))).otherwise(0.0)
    total = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("synonym_score") + bonus))
    best = scored.groupBy("dataset_id", "source_field").agg(
        F.min(F.struct((-total).alias("s"), "priority", "canonical_field")).alias("b"))
    score = -F.col("b.s")
    mapped = score >= cfg.mapping_floor
    return best.select(
        "dataset_id", "source_field",
        F.when(mapped, F.col("b.canonical_field")).otherwise(F.col("source_field")).alias("canonical_field"),
        F.round(score * 100, 1).alias("confidence"),
        F.when(mapped, "fuzzy_synonym").otherwise("unmapped").alias("method"))


def manual_override_join(generated: DataFrame, existing: DataFrame) -> DataFrame:
    """Reviewers' field choices replace generated ones at full confidence."""
    approved = existing.where(F.col("manual_override")).groupBy("dataset_id", "source_field").agg(
        F.max("canonical_field").alias("_c"))
    by_hand = F.col("_c").isNotNull()
    return generated.join(approved, ["dataset_id", "source_field"], "left").select(
        "dataset_id", "source_field", F.coalesce("_c", "canonical_field").alias("canonical_field"),
        F.when(by_hand, 100.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(by_hand, "manual_override").otherwise(F.col("method")).alias("method"),
        by_hand.alias("manual_override"))


def schema_mapping(features: DataFrame, existing: DataFrame | None = None, cfg: Settings = DEFAULTS) -> DataFrame:
    generated = map_fields(dataset_field_profile(features, cfg), cfg)
    if existing is None:
        mapped = generated.withColumn("manual_override", F.lit(False))
    else:
        mapped = manual_override_join(generated, existing)
    return mapped.select(scalar.natural_id("AM", F.col("dataset_id"), F.col("source_field")).alias("id"), "*",
                         scalar.needs_review(F.col("confidence"), cfg).alias("needs_review"))


def apply_mapping(features: DataFrame, mappings: DataFrame) -> DataFrame:
    """Adds the ``canonical`` bag: mapped values first, then raw keys that fill gaps.

    The fields of a dataset become one small array, so features only look it up: no shuffle of
    property bags. When several fields share a canonical field the last one with a value wins.
    """
    rules = mappings.groupBy("dataset_id").agg(F.array_sort(F.collect_list(
        F.struct("source_field", "canonical_field"))).alias("_rules"))
    joined = skew.lookup_join(features, rules, ["dataset_id"], F.col("ordinal"), "left")
    empty = F.create_map().cast("map<string,string>")
    bag = F.coalesce("properties", empty)
    live = F.filter(F.coalesce("_rules", F.array().cast("array<struct<source_field:string,canonical_field:string>>")),
                    lambda r: F.coalesce(bag[r["source_field"]] != "", F.lit(False)))
    joined = joined.withColumn("_live", live)
    last = F.filter("_live", lambda r, i: ~F.exists(
        F.slice("_live", i + 2, F.greatest(F.size("_live") - i - 1, F.lit(0))),
        lambda o: o["canonical_field"] == r["canonical_field"]))
    joined = joined.withColumn("_live", last)
    names = F.transform("_live", lambda r: r["canonical_field"])
    mapped = F.map_from_arrays(names, F.transform("_live", lambda r: bag[r["source_field"]]))
    rest = F.map_filter(bag, lambda k, v: ~F.array_contains(names, k))
    return joined.withColumn("canonical", F.map_concat(mapped, rest)).drop("_rules", "_live")


def with_compared(features: DataFrame) -> DataFrame:
    """Comparable columns taken from the ``canonical`` bag."""
    c = F.col("canonical")
    return match.canonical_columns(features, {f: c[f] for f in (
        "owner_name", "land_use", "parcel_id", "survey_number", "address")})


def override_mapping(mappings: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(mappings, audit rows)`` after decisions ``(id, new_field, actor, decided_at)``."""
    last = decisions.groupBy("id").agg(F.max(F.struct("decided_at", "new_field", "actor")).alias("d"))
    joined = mappings.join(last, "id", "left")
    hit = F.col("d").isNotNull()
    audit = joined.where(hit).select(
        F.col("d.actor").alias("actor"), F.lit("attribute_mapping.overridden").alias("action"),
        F.lit("attribute_mapping").alias("resource_type"), F.col("id").alias("resource_id"),
        F.to_json(F.struct("canonical_field")).alias("before_state"),
        F.to_json(F.struct(F.col("d.new_field").alias("canonical_field"))).alias("after_state"),
        F.col("d.decided_at").alias("created_at"))
    out = joined.withColumns({
        "canonical_field": F.coalesce("d.new_field", "canonical_field"),
        "manual_override": hit | F.col("manual_override"),
        "confidence": F.when(hit, 100.0).otherwise(F.col("confidence"))})
    return out.select(*mappings.columns), audit


def classify_source_type(datasets: DataFrame) -> DataFrame:
    """Suggest a source type from ``name``, ``filename``, ``fields`` and ``geometry_types``.

    Scores every type with column expressions and ranks them in the row.
    """
    from landrecon.settings import SOURCE_FIELD_CUES, SOURCE_NAME_PHRASES

    hay = F.translate(F.lower(F.concat_ws(" ", "name", "filename")), "_-", "  ")
    fields = F.transform(F.coalesce("fields", F.array().cast("array<string>")),
                         lambda f: F.replace(F.lower(F.trim(f)), F.lit(" "), F.lit("_")))
    kinds = F.transform(F.coalesce("geometry_types", F.array().cast("array<string>")), F.lower)
    base = datasets.withColumns({"_hay": hay, "_fields": fields, "_kinds": kinds})

    def score(t: str) -> Column:
        hits = [F.contains("_hay", F.lit(p)).cast("int") * 2.0 for p in SOURCE_NAME_PHRASES[t]]
        total = reduce(lambda a, b: a + b, hits)
        if t in SOURCE_FIELD_CUES:
            cues = F.array(*[F.lit(c) for c in SOURCE_FIELD_CUES[t]])
            total = total + F.least(F.lit(3.0), F.size(F.array_intersect("_fields", cues)) * 1.5)
        if t == "utility":
            line = F.arrays_overlap("_kinds", F.array(F.lit("linestring"), F.lit("multilinestring")))
            total = total + line.cast("int") * 1.0
        if t in ("cadastral", "municipal"):
            area = F.arrays_overlap("_kinds", F.array(F.lit("polygon"), F.lit("multipolygon")))
            total = total + area.cast("int") * 0.5
        return total

    ranked = F.array_sort(F.array(*[
        F.struct((-score(t)).alias("neg"), F.lit(i).alias("order"), F.lit(t).alias("source_type"))
        for i, t in enumerate(SOURCE_NAME_PHRASES)]))
    out = base.withColumn("_ranked", ranked)
    best, second = -F.col("_ranked")[0]["neg"], -F.col("_ranked")[1]["neg"]
    imagery = F.exists("_ranked", lambda e: e["source_type"].isin("drone", "orthoimagery", "dsm", "dtm") & (e["neg"] < 0))
    bare_raster = F.lower("filename").rlike(r"\.tiff?$") & ~imagery
    confidence = F.least(F.lit(0.95), 0.45 + 0.1 * best + 0.08 * F.greatest(F.lit(0.0), best - second))
    blank = bare_raster | (best <= 0)
    return out.withColumns({
        "suggested_type": F.when(~blank & (best - second >= 1.5), F.col("_ranked")[0]["source_type"]),
        "confidence": F.when(blank, 0.0).otherwise(F.round(confidence, 2)),
        "needs_review": F.lit(True),
        "candidates": F.transform("_ranked", lambda e: F.struct(
            e["source_type"].alias("source_type"), (-e["neg"]).alias("score")))}).withColumn(
        "accepted", F.coalesce(F.col("suggested_type").isNotNull() & (F.col("confidence") >= 0.6), F.lit(False))
    ).drop("_hay", "_fields", "_kinds", "_ranked")


def top_source_type_candidates(classified: DataFrame, n: int = 3) -> DataFrame:
    return classified.select("dataset_id", F.posexplode(F.slice("candidates", 1, n)).alias("pos", "c")).select(
        "dataset_id", (F.col("pos") + 1).alias("place"), "c.source_type", "c.score")
