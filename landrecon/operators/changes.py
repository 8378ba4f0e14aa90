"""What differs between two runs and between two versions of a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from landrecon.functions import scalar
from landrecon.settings import DEFAULTS, Settings

SNAPSHOT = ["id", "parcel_id", "owner_name", "area", "land_use", "building_count", "geometry_geojson"]
EVENT = ["feature_ref", "change_type", "before", "after", "confidence"]
_JSON = {"ignoreNullFields": "false"}


def snapshot(parcels: DataFrame) -> DataFrame:
    return parcels.select(*SNAPSHOT, "parcel_rank")


def _last(parcels: DataFrame, extra: list[str]) -> DataFrame:
    """One row per ``parcel_id``: the last in rank."""
    cols = [c for c in SNAPSHOT + extra if c != "parcel_id"]
    last = F.max_by(F.struct(*cols), F.struct("parcel_rank", "id"))
    return parcels.groupBy("parcel_id").agg(last.alias("v"))


def parcel_changes(previous: DataFrame, current: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """New, removed and changed parcels by ``parcel_id``.

    One full outer join of the two snapshots; a parcel whose attributes and area both changed gives
    two events.
    """
    p = _last(previous, []).withColumnRenamed("v", "p")
    c = _last(current, ["confidence_score"]).withColumnRenamed("v", "c")
    both = p.join(c, "parcel_id", "full_outer")
    was, now = F.col("p"), F.col("c")

    def changed(name: str) -> Column:
        return ~was[name].cast("string").eqNullSafe(now[name].cast("string"))

    names = ("owner_name", "land_use", "building_count")
    stay = was.isNotNull() & now.isNotNull()

    def side(row: Column) -> Column:
        # Absent members are those that did not change; a changed null is written as text null.
        fields = [F.when(changed(n), F.concat(F.lit(f'"{n}":'), F.coalesce(
            F.when(F.lit(n == "building_count"), row[n].cast("string")).otherwise(
                _quoted(row[n].cast("string"))), F.lit("null")))) for n in names]
        return F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))

    rel = F.abs(was["area"] - now["area"]) / F.greatest(was["area"], now["area"])
    sized = stay & (was["area"] > 0) & (now["area"] > 0)
    none = F.lit(None).cast("string")

    def event(when: Column, ref: Column, kind: Column, before: Column, after: Column, confidence: Column) -> Column:
        return F.when(when, F.struct(ref.alias("feature_ref"), kind.alias("change_type"), before.alias("before"),
                                     after.alias("after"), confidence.cast("double").alias("confidence")))

    events = F.array(
        event(was.isNull(), now["id"], F.lit("new"), none,
              F.to_json(F.struct("parcel_id", now["owner_name"].alias("owner_name"), now["area"].alias("area"),
                                 now["building_count"].alias("building_count")), _JSON), now["confidence_score"]),
        event(now.isNull(), was["id"], F.lit("removed"),
              F.to_json(F.struct("parcel_id", *[was[n].alias(n) for n in SNAPSHOT if n != "parcel_id"]), _JSON),
              none, F.lit(80.0)),
        event(stay & (changed(names[0]) | changed(names[1]) | changed(names[2])), now["id"],
              F.when(changed("building_count"), "modified").otherwise("attribute_changed"),
              side(was), side(now), now["confidence_score"]),
        event(sized & (rel > cfg.area_change), now["id"], F.lit("geometry_changed"),
              F.to_json(F.struct(was["area"].alias("area"))), F.to_json(F.struct(now["area"].alias("area"))),
              F.round((1 - rel) * 100, 1)))
    return both.select("parcel_id", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select(
        "parcel_id", "e.*")


def _quoted(value: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(value, r"\\", r"\\\\"), '"', r'\\"')
    return F.concat(F.lit('"'), text, F.lit('"'))


def latest_two_versions(datasets: DataFrame) -> DataFrame:
    """The last two uploads of each source type, ``version`` 1 being the newest."""
    order = Window.partitionBy("source_type").orderBy(F.desc("uploaded_at"), F.desc("dataset_id"))
    return datasets.withColumn("version", F.row_number().over(order)).where(F.col("version") <= 2)


def _keyed(features: DataFrame, by: list[str]) -> DataFrame:
    """Last feature per stable key; features without one do not take part."""
    content = F.struct("feature_id", "properties", "geometry_geojson")
    keyed = features.withColumn("key", scalar.feature_key(F.col("properties"))).where(F.col("key").isNotNull())
    return keyed.groupBy(*by, "key").agg(F.max_by(content, F.struct("ordinal", "feature_id")).alias("v"))


def version_keys_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Each stable key of either side with ``added``, ``removed`` or ``common``."""
    p = previous.select(scalar.feature_key(F.col("properties")).alias("key"), F.lit(1).alias("p")).where("key is not null").distinct()
    c = current.select(scalar.feature_key(F.col("properties")).alias("key"), F.lit(1).alias("c")).where("key is not null").distinct()
    state = F.when(F.col("p").isNull(), "added").when(F.col("c").isNull(), "removed").otherwise("common")
    return p.join(c, "key", "full_outer").select("key", state.alias("state"))


def _keys(features: DataFrame) -> DataFrame:
    return features.select(scalar.feature_key(F.col("properties")).alias("key")).where("key is not null").distinct()


def keys_added(previous: DataFrame, current: DataFrame) -> DataFrame:
    return _keys(current).join(_keys(previous), "key", "left_anti")


def keys_removed(previous: DataFrame, current: DataFrame) -> DataFrame:
    return _keys(previous).join(_keys(current), "key", "left_anti")


def keys_common(previous: DataFrame, current: DataFrame) -> DataFrame:
    return _keys(previous).join(_keys(current), "key", "left_semi")


def _version_events(both: DataFrame, with_key: bool, keep: list[str]) -> DataFrame:
    was, now = F.col("p"), F.col("c")
    none = F.lit(None).cast("string")
    tag = [F.col("key").alias("feature_key")] if with_key else []

    def summary(v: Column) -> Column:
        return F.to_json(F.struct(*tag, v["properties"].alias("properties"),
                                  v["geometry_geojson"].alias("geometry_geojson")), _JSON)

    def part(v: Column, name: str) -> Column:
        return F.to_json(F.struct(F.col("key").alias("feature_key"), v[name].alias(name)), _JSON)

    def bag(v: Column) -> Column:
        return F.array_sort(F.map_entries(F.coalesce(v["properties"], F.create_map().cast("map<string,string>"))))

    def event(when: Column, ref: Column, kind: str, before: Column, after: Column) -> Column:
        return F.when(when, F.struct(ref.alias("feature_ref"), F.lit(kind).alias("change_type"),
                                     before.alias("before"), after.alias("after"), F.lit(100.0).alias("confidence")))

    stay = was.isNotNull() & now.isNotNull()
    events = F.array(
        event(was.isNull(), now["feature_id"], "new", none, summary(now)),
        event(now.isNull(), was["feature_id"], "removed", summary(was), none),
        event(stay & ~was["geometry_geojson"].eqNullSafe(now["geometry_geojson"]), now["feature_id"],
              "geometry_changed", part(was, "geometry_geojson"), part(now, "geometry_geojson")),
        event(stay & (bag(was) != bag(now)), now["feature_id"], "attribute_changed",
              part(was, "properties"), part(now, "properties")))
    return both.select(*keep, "key", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select(
        *keep, "key", "e.*")


def source_version_changes(features: DataFrame, datasets: DataFrame) -> DataFrame:
    """Events between the two latest versions of every source type, by stable feature key.

    A source type is skipped when either version has no keyed feature at all.
    """
    versions = latest_two_versions(datasets).select("dataset_id", "source_type", "version")
    keyed = _keyed(features.drop("source_type").join(versions, "dataset_id"), ["source_type", "version"])
    both = (keyed.where(F.col("version") == 2).select("source_type", "key", F.col("v").alias("p"))
            .join(keyed.where(F.col("version") == 1).select("source_type", "key", F.col("v").alias("c")),
                  ["source_type", "key"], "full_outer"))
    usable = keyed.groupBy("source_type").agg(F.count_distinct("version").alias("n")).where(F.col("n") == 2)
    return _version_events(both.join(usable.select("source_type"), "source_type", "left_semi"), False, ["source_type"])


def baseline_follow_up_changes(previous: DataFrame, current: DataFrame, follow_up: DataFrame) -> DataFrame:
    """Events between two versions of one source, with stable event ids.

    When the versions share no key, the baseline is compared with ``follow_up`` instead, restricted
    to parcels the baseline links to. Which of the two applies is decided inside the plan.
    """
    p = _keyed(previous, [])
    c = _keyed(current, [])
    shared = p.select("key").join(c.select("key"), "key", "left_semi").limit(1).withColumn("_one", F.lit(1))
    linked = previous.select(F.nullif(F.col("properties")["linked_parcel"], F.lit("")).alias("_l")).where(
        "_l is not null").distinct()
    other = _keyed(follow_up.where(F.col("geometry_geojson").isNotNull())
                   .join(linked, F.col("properties")["linked_parcel"] == F.col("_l"), "left_semi"), [])
    one = F.lit(1).alias("_one")
    shared = F.broadcast(shared)  # one row or none
    chosen = (c.select("*", one).join(shared, "_one", "left_semi").drop("_one")
              .unionByName(other.select("*", one).join(shared, "_one", "left_anti").drop("_one")))
    both = p.withColumnRenamed("v", "p").join(chosen.withColumnRenamed("v", "c"), "key", "full_outer")
    events = _version_events(both, True, [])
    return events.withColumn("id", scalar.stable_event_id(F.col("change_type"), F.col("key")))


def change_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("change_type").agg(F.count(F.lit(1)).alias("changes"))
