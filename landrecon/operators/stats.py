"""Counts, scores and reports over the result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landrecon.functions import geo, scalar
from landrecon.operators import skew
from landrecon.settings import ACCURACY_FIELDS, DEFAULTS, PARCEL_KEY_FIELDS, PIPELINE_STAGES, Settings


def quality_score(features: DataFrame) -> DataFrame:
    """Validity and attribute completeness of each dataset as one percent score."""
    valid = F.avg(F.coalesce(F.col("is_valid"), F.lit(True)).cast("double"))
    score = F.round((0.6 * valid + 0.4 * F.avg(scalar.completeness(F.col("properties")))) * 100, 1)
    return features.groupBy("dataset_id").agg(F.coalesce(score, F.lit(0.0)).alias("quality_score"))


def _one(df: DataFrame, **aggs: Column) -> DataFrame:
    return df.agg(*[v.alias(k) for k, v in aggs.items()]).withColumn("_one", F.lit(1))


def _counted(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


def statistics(datasets: DataFrame, parcels: DataFrame, matches: DataFrame, conflicts: DataFrame,
               validation: DataFrame, changes: DataFrame) -> DataFrame:
    """Workspace totals: each table is aggregated on its own, and the single rows are put side by side."""
    n = F.count(F.lit(1))
    errors = F.when(~F.col("is_valid"), _issues(validation))
    parts = [
        _one(parcels, total_parcels=n, total_buildings=F.coalesce(F.sum("building_count"), F.lit(0)),
             average_confidence=F.coalesce(F.round(F.avg("confidence_score"), 1), F.lit(0.0))),
        _one(datasets, total_datasets=n), _one(matches, matched_features=n),
        _one(conflicts, total_conflicts=n, open_conflicts=_counted(F.col("status") == "Open")),
        _one(validation, topology_errors=F.coalesce(F.sum(errors), F.lit(0))),
        _one(changes, changes_detected=n)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), "_one")
    return out.drop("_one")


def confidence_distribution(matches: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Matches per confidence band; absent bands count 0."""
    band = scalar.confidence_band(F.col("overall_confidence"), cfg)
    row = matches.agg(*[_counted(band == b).alias(b) for b in ("High", "Medium", "Low")])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(b).alias("band"), F.col(b).alias("matches")) for b in ("High", "Medium", "Low")])).alias("r")
    ).select("r.*")


def conflict_categories(conflicts: DataFrame) -> DataFrame:
    return conflicts.groupBy("conflict_type").agg(F.count(F.lit(1)).alias("conflicts"))


def _issues(validation: DataFrame) -> Column:
    """Issues a validation row stands for: the pairs of a duplicate or overlap, else one."""
    return F.col("pair_count") if "pair_count" in validation.columns else F.lit(1)


def data_quality_report(datasets: DataFrame, validation: DataFrame) -> DataFrame:
    bad = validation.where(~F.col("is_valid")).groupBy("dataset_id").agg(F.sum(_issues(validation)).alias("_n"))
    return datasets.join(bad, "dataset_id", "left").withColumn(
        "invalid_geometry_count", F.coalesce("_n", F.lit(0))).drop("_n")


def total_invalid_geometries(report: DataFrame) -> DataFrame:
    return report.agg(F.coalesce(F.sum("invalid_geometry_count"), F.lit(0)).alias("total_invalid"))


def mean_parcel_confidence(parcels: DataFrame) -> DataFrame:
    return parcels.agg(F.round(F.avg("confidence_score"), 1).alias("mean_confidence"))


def workspace_capacity(features: DataFrame, datasets: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """Dataset, feature and vertex totals against the limits."""
    f = _one(features, features=F.count(F.lit(1)),
             vertices=F.coalesce(F.sum(geo.json_num_vertices(F.col("geometry_geojson"))), F.lit(0)))
    d = _one(datasets, datasets=F.count(F.lit(1)))
    return f.join(F.broadcast(d), "_one").select(
        "datasets", "features", "vertices", (F.col("datasets") >= cfg.max_datasets).alias("datasets_full"),
        (F.col("features") > cfg.max_features).alias("features_exceeded"),
        (F.col("vertices") > cfg.max_vertices).alias("vertices_exceeded"))


def feature_count_reconciliation(datasets: DataFrame, features: DataFrame) -> DataFrame:
    actual = features.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("actual"))
    out = datasets.select("dataset_id", F.col("feature_count").alias("declared")).join(actual, "dataset_id", "left")
    out = out.withColumn("actual", F.coalesce("actual", F.lit(0)))
    return out.withColumn("agrees", (F.col("declared") == F.col("actual")) & (F.col("declared") > 0))


def latest_stage_status(log: DataFrame) -> DataFrame:
    """Last report of each job stage, in the order the stages first appeared."""
    return log.groupBy("job_id", "name").agg(
        F.min("position").alias("place"),
        F.max_by(F.struct("status", "processed", "warnings", "errors", "detail", "timestamp"), "position").alias("s")
    ).select("job_id", "name", "place", "s.*")


def pilot_readiness(datasets: DataFrame, features: DataFrame, aoi_exists: bool) -> DataFrame:
    """Evidence checks of a pilot, one row each with PASS, BLOCKER or RECOMMENDED.

    Property names, counts and the finest pixel size are gathered per source type in one pass.
    """
    def names(wanted: tuple[str, ...]) -> list[Column]:
        keys = F.transform(F.map_keys("properties"), lambda k: F.lower(F.trim(k)))
        return [F.coalesce(F.max(F.array_contains(keys, F.lit(w))), F.lit(False)).alias("has_" + w) for w in wanted]

    typed = features if "source_type" in features.columns else skew.lookup_join(
        features, datasets.select("dataset_id", "source_type"), ["dataset_id"], F.col("feature_id"))
    size = F.array_max(F.from_json(F.col("properties")["pixel_size"], "array<double>"))
    wanted = tuple(dict.fromkeys(PARCEL_KEY_FIELDS + ACCURACY_FIELDS))
    per = typed.groupBy("source_type").agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("pixel"), *names(wanted))
    sets = datasets.groupBy("source_type").agg(F.count(F.lit(1)).alias("sets"))
    by = sets.join(per, "source_type", "left")

    def any_of(types: tuple[str, ...]) -> Column:
        return F.col("source_type").isin(*types)

    def found(source: str, fields: tuple[str, ...]) -> Column:
        hits = [F.when(F.max(any_of((source,)) & F.col("has_" + f)), F.lit(f)) for f in fields]
        return F.array_compact(F.array(*hits))

    def total(types: tuple[str, ...], what: str) -> Column:
        return F.coalesce(F.sum(F.when(any_of(types), F.col(what))), F.lit(0))

    facts = by.agg(
        *[total((t,), "sets").alias("n_" + t) for t in ("cadastral", "revenue", "municipal", "utility")],
        total(("gnss",), "n").alias("gnss_points"), total(("dsm",), "sets").alias("n_dsm"),
        total(("dtm",), "sets").alias("n_dtm"),
        F.min(F.when(any_of(("orthoimagery", "drone")), F.col("pixel"))).alias("pixel"),
        found("cadastral", PARCEL_KEY_FIELDS).alias("cad_keys"), found("revenue", PARCEL_KEY_FIELDS).alias("rev_keys"),
        found("gnss", ACCURACY_FIELDS).alias("acc_keys"))

    def listed(c: str) -> Column:
        return F.when(F.size(c) > 0, F.array_join(c, ", ")).otherwise("none")

    fine = F.coalesce(F.col("pixel") <= 0.20, F.lit(False))
    checks = [
        ("aoi", True, F.lit(aoi_exists), F.lit("area of interest " + ("present" if aoi_exists else "missing"))),
        ("cadastral", True, (F.col("n_cadastral") > 0) & (F.size("cad_keys") > 0),
         F.concat("n_cadastral", F.lit(" dataset(s), key fields: "), listed("cad_keys"))),
        ("revenue", True, (F.col("n_revenue") > 0) & (F.size("rev_keys") > 0),
         F.concat("n_revenue", F.lit(" dataset(s), key fields: "), listed("rev_keys"))),
        ("municipal", True, F.col("n_municipal") > 0, F.concat("n_municipal", F.lit(" dataset(s)"))),
        ("gnss", True, (F.col("gnss_points") >= 10) & (F.size("acc_keys") > 0),
         F.concat("gnss_points", F.lit(" point(s), accuracy fields: "), listed("acc_keys"))),
        ("imagery", True, fine, F.when(fine, F.format_string("pixel size %.3f m", F.col("pixel")))
         .otherwise("no raster at 20 cm or finer")),
        ("utilities", False, F.col("n_utility") > 0, F.concat("n_utility", F.lit(" dataset(s)"))),
        ("terrain", False, (F.col("n_dsm") > 0) | (F.col("n_dtm") > 0),
         F.concat("n_dsm", F.lit(" DSM and "), "n_dtm", F.lit(" DTM dataset(s)"))),
    ]
    rows = [F.struct(F.lit(i).alias("place"), F.lit(name).alias("check_id"), F.lit(required).alias("required"),
                     F.when(ok, "PASS").otherwise("BLOCKER" if required else "RECOMMENDED").alias("status"),
                     detail.alias("detail")) for i, (name, required, ok, detail) in enumerate(checks)]
    return facts.select(F.inline(F.array(*rows)))


def readiness_summary(checks: DataFrame) -> DataFrame:
    out = checks.agg(_counted(F.col("status") == "BLOCKER").alias("blocker_count"))
    return out.select(F.when(F.col("blocker_count") == 0, "READY_FOR_REVIEW").otherwise("NOT_READY").alias("status"),
                      "blocker_count")


def snapshot_record_counts(tables: dict[str, DataFrame], declared: DataFrame) -> DataFrame:
    """Rows per table beside the declared counts ``(table_name, declared)``."""
    actual = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("actual")).select(F.lit(name).alias("table_name"), "actual")
        actual = one if actual is None else actual.unionByName(one)
    out = actual.join(declared, "table_name", "full_outer")
    return out.withColumn("agrees", F.col("actual").eqNullSafe(F.col("declared")))


def pipeline_output_ready(matches: DataFrame, mappings: DataFrame, validation: DataFrame, parcels: DataFrame,
                          stages: DataFrame, job_total: DataFrame) -> DataFrame:
    """Whether a run left every output a complete one leaves.

    One job must have completed all nine stages, by their last reports, and have processed as many
    parcels as there are. ``job_total`` has ``job_id`` and ``total_processed``; the total returned is
    that of the job with all stages, the largest of several.
    """
    n = F.count(F.lit(1))
    needed = F.col("name").isin(*PIPELINE_STAGES[:9]) & (F.col("status") == "completed")
    done = (latest_stage_status(stages).groupBy("job_id").agg(F.sum(needed.cast("int")).alias("_done")).where("_done = 9")
            .select(F.col("job_id").alias("_job")))
    totals = job_total.join(done, F.col("job_id") == F.col("_job"))
    scored = _counted((F.col("confidence_score") > 0) & (F.size("lineage") > 0))
    parts = [_one(parcels, parcels=n, scored=scored), _one(matches, matches=n), _one(mappings, mappings=n),
             _one(validation, validation=n), _one(done, stages_completed=n > 0)]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), "_one")
    same = totals.withColumn("_one", F.lit(1)).join(F.broadcast(parts[0].select("_one", "parcels")), "_one").drop("_one")
    out = out.join(F.broadcast(_one(same, total_processed=F.max("total_processed"), _same=F.max(
        F.col("total_processed") == F.col("parcels")))), "_one")
    ready = ((F.col("parcels") > 0) & (F.col("scored") > 0) & (F.col("matches") > 0) & (F.col("mappings") > 0)
             & (F.col("validation") > 0) & F.col("stages_completed") & F.col("_same"))
    return out.drop("_one").withColumn("ready", F.coalesce(ready, F.lit(False))).drop("_same")
