"""The driver's relational tables read as land-record layers.

Customers are parcels on a regular grid of boxes, their earliest order is the revenue record,
parts are buildings, events are survey points and suppliers are utility lines. Every row of each
of these tables becomes a feature. Customers of three nations carry a known defect each, so that
the quality operators have something to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landrecon.functions import geo
from landrecon.operators.match import canonical_columns
from landrecon.settings import Settings

# The parcel grid.
COLUMNS = 100
STEP = 0.00075
ORIGIN_X = 74.2433
ORIGIN_Y = 16.7050
DUPLICATE_NATION, OVERLAP_NATION, SLIVER_NATION = 3, 7, 11

LENS = Settings(metric="local_plane", rectangles_only=True, text_ratio="equality")
LAYERS = ("cadastral", "revenue", "municipal", "gnss", "utility")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cell(k: Column) -> tuple[Column, Column]:
    return (F.lit(ORIGIN_X) + (k % COLUMNS) * F.lit(STEP),
            F.lit(ORIGIN_Y) + F.floor(k / COLUMNS) * F.lit(STEP))


def _box(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    return df.withColumns({"xmin": x0, "ymin": y0, "xmax": x1, "ymax": y1})


def _layer(df: DataFrame, source: str, canonical: str, feature_id: Column, ordinal: Column,
           kind: str, bag: dict[str, Column]) -> DataFrame:
    entries = F.map_from_arrays(F.array(*[F.lit(k) for k in bag]),
                                F.array(*[v.cast("string") for v in bag.values()]))
    return df.select(
        feature_id.alias("feature_id"), F.lit("DS-" + source).alias("dataset_id"),
        F.lit(source).alias("source_type"), F.lit(canonical).alias("canonical_type"),
        ordinal.cast("long").alias("ordinal"), F.lit(kind).alias("kind"),
        "xmin", "ymin", "xmax", "ymax", entries.alias("properties"))


def cadastral(spark: SparkSession, sf_dir: str, shift: Column | None = None) -> DataFrame:
    c = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey"))
    variants = F.filter(F.array(
        F.struct(F.lit("C").alias("v"), F.lit(0).alias("n")),
        F.when(F.col("c_nationkey") == DUPLICATE_NATION, F.struct(F.lit("CD").alias("v"), F.lit(1).alias("n"))),
        F.when(F.col("c_nationkey") == OVERLAP_NATION, F.struct(F.lit("CO").alias("v"), F.lit(2).alias("n"))),
        F.when(F.col("c_nationkey") == SLIVER_NATION, F.struct(F.lit("CS").alias("v"), F.lit(3).alias("n"))),
    ), lambda s: s.isNotNull())
    c = c.withColumn("e", F.explode(variants)).select("*", "e.v", "e.n")
    x, y = _cell(F.col("k"))
    lon = F.when(F.col("v") == "CO", 0.15 * STEP).otherwise(0.0)
    if shift is not None:
        lon = lon + shift
    lat = F.when(F.col("v") == "CO", 0.25 * STEP).otherwise(0.0)
    low = F.when(F.col("v") == "CS", 0.94 * STEP).otherwise(0.08 * STEP)
    high = F.when(F.col("v") == "CS", 0.95 * STEP).otherwise(0.92 * STEP)
    c = _box(c, x + 0.08 * STEP + lon, y + low + lat, x + 0.92 * STEP + lon, y + high + lat)
    key = F.concat(F.when(F.col("v").isin("C", "CD"), "P-").when(F.col("v") == "CO", "PO-")
                   .otherwise("PS-"), F.col("k"))
    owner = F.when(F.col("v") == "CD", "Duplicate entry").otherwise(F.col("c_name"))
    return _layer(c, "cadastral", "parcel", F.concat("v", F.lit("-"), "k"), F.col("k") * 4 + F.col("n"),
                  "Polygon", {"parcel_id": key, "owner": owner, "land_use": F.col("c_mktsegment")})


def revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o"))
    c = table(spark, sf_dir, "customer").join(first, F.col("c_custkey") == F.col("o_custkey"))
    x, y = _cell(F.col("c_custkey"))
    inset = 0.08 * STEP + (F.col("o") % 5) * F.lit(0.05 * STEP)
    move = ((F.col("o") % 7) - 3) * F.lit(1e-5)
    c = _box(c, x + inset + move, y + inset + move, x + STEP - inset + move, y + STEP - inset + move)
    holder = F.when(F.col("o") % 8 == 0, F.col("c_mktsegment")).otherwise(F.col("c_name"))
    return _layer(c, "revenue", "parcel", F.concat(F.lit("R-"), "o"), F.col("o"), "Polygon", {
        "survey_no": F.concat(F.lit("P-"), "c_custkey"), "landholder": holder,
        "classification": F.col("c_mktsegment")})


def municipal(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("k", F.col("p_partkey"))
    x, y = _cell(F.col("k"))
    f = F.lit(0.15 * STEP) + (F.col("k") % 3) * F.lit(0.3 * STEP)
    up = F.when(F.col("k") % 8 == 0, 0.35 * STEP).otherwise(0.0)
    p = _box(p, x + f, y + f + up, x + f + 0.3 * STEP, y + f + up + 0.3 * STEP)
    return _layer(p, "municipal", "building", F.concat(F.lit("M-"), "k"), F.col("k"), "Polygon", {
        "property_id": F.concat(F.lit("B-"), "k"), "usage_type": F.col("p_type"),
        "plot_area": F.col("p_retailprice"), "linked_parcel": F.concat(F.lit("P-"), "k")})


def gnss(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    x, y = _cell(F.col("user_id"))
    off = (F.col("value") % 1 - 0.5) * F.lit(0.24 * STEP) * F.when(
        F.col("event_type") == "error", 25.0).otherwise(1.0)
    e = _box(e, x + 0.5 * STEP + off, y + 0.5 * STEP + off, x + 0.5 * STEP + off, y + 0.5 * STEP + off)
    return _layer(e, "gnss", "gnss_point", F.concat(F.lit("G-"), "event_id"), F.col("event_id"), "Point", {
        "point_id": F.col("event_id"), "accuracy_m": F.get_json_object("props", "$.k")})


def utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("k", F.col("s_suppkey"))
    x, y = _cell(F.col("k"))
    s = _box(s, x, y + 0.5 * STEP, x + (1 + F.col("k") % 3) * F.lit(STEP), y + 0.5 * STEP)
    return _layer(s, "utility", "utility", F.concat(F.lit("U-"), "k"), F.col("k"), "LineString",
                  {"utility_id": F.concat(F.lit("U-"), "k")})


def boxes(spark: SparkSession, sf_dir: str, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """Features of the layers as boxes, without a geometry column."""
    makers = {"cadastral": cadastral, "revenue": revenue, "municipal": municipal,
              "gnss": gnss, "utility": utility}
    out = None
    for name in layers:
        one = makers[name](spark, sf_dir)
        out = one if out is None else out.unionByName(one)
    return out


def features(spark: SparkSession, sf_dir: str, layers: tuple[str, ...] = LAYERS,
             cfg: Settings = LENS, mapped: bool = True) -> DataFrame:
    """Features with geometry, centroid, area and the canonical columns that matching compares."""
    return measured(boxes(spark, sf_dir, layers), cfg, mapped)


def measured(df: DataFrame, cfg: Settings = LENS, mapped: bool = True) -> DataFrame:
    geom = (
        F.when(F.col("kind") == "Polygon", geo.box_geom(*[F.col(c) for c in ("xmin", "ymin", "xmax", "ymax")]))
        .when(F.col("kind") == "LineString",
              geo.line_geom((F.col("xmin"), F.col("ymin")), (F.col("xmax"), F.col("ymax"))))
        .otherwise(geo.point_geom(F.col("xmin"), F.col("ymin"))))
    lat = (F.col("ymin") + F.col("ymax")) / 2
    lon = (F.col("xmin") + F.col("xmax")) / 2
    if cfg.metric == "local_plane":
        k = cfg.metres_per_degree
        area = ((F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin")) * k * k * F.cos(lat * geo.RAD))
    else:
        area = geo.area_sqm(geom)
    out = df.withColumns({
        "geom": geom, "centroid_lon": lon, "centroid_lat": lat,
        "area_sqm": F.when(F.col("kind") == "Polygon", area), "is_valid": F.lit(True)})
    return canonical_columns(out, lens_canonical()) if mapped else out


def lens_canonical() -> dict[str, Column]:
    """Canonical values by the exact synonyms the layers use."""
    p = F.col("properties")
    return {
        "owner_name": F.coalesce(p["owner"], p["landholder"]),
        "land_use": F.coalesce(p["land_use"], p["usage_type"], p["classification"]),
        "parcel_id": F.coalesce(p["parcel_id"], p["survey_no"], p["property_id"]),
        "survey_number": F.lit(None).cast("string"), "address": F.lit(None).cast("string")}


def datasets(spark: SparkSession, sf_dir: str, layers: tuple[str, ...] = LAYERS) -> DataFrame:
    """One row per layer with its feature count; upload times follow the layer order."""
    order = F.array_position(F.array(*[F.lit(n) for n in layers]), F.col("source_type"))
    return (boxes(spark, sf_dir, layers).groupBy("dataset_id", "source_type")
            .agg(F.count(F.lit(1)).alias("feature_count"))
            .select("dataset_id", F.initcap("source_type").alias("name"), "source_type",
                    F.concat(F.initcap("source_type"), F.lit(" department")).alias("department"),
                    F.lit("user_upload").alias("provenance"), F.lit("EPSG:4326").alias("crs"),
                    F.lit("uploaded").alias("status"), "feature_count",
                    (F.timestamp_seconds(F.lit(1704067200)) + F.make_dt_interval(order.cast("int"))).alias("uploaded_at")))
