"""Small layers for tests."""

from pyspark.sql import functions as F

from landrecon import lens
from landrecon.settings import Settings

PLANE = Settings(metric="local_plane", rectangles_only=True, text_ratio="equality")


def layer(spark, rows, cfg=PLANE):
    """``rows`` of (id, source, canonical, ordinal, kind, x0, y0, x1, y1, owner, use, key)."""
    df = spark.createDataFrame(rows, (
        "feature_id string, source_type string, canonical_type string, ordinal long, kind string, xmin double, "
        "ymin double, xmax double, ymax double, owner string, use string, key string"))
    bag = F.map_from_arrays(F.array(F.lit("owner"), F.lit("land_use"), F.lit("parcel_id")), F.array("owner", "use", "key"))
    df = df.withColumns({"dataset_id": F.concat(F.lit("DS-"), F.coalesce(
        F.regexp_extract("feature_id", r"^(\w+)@", 1), F.lit(""))), "properties": bag}).drop("owner", "use", "key")
    df = df.withColumn("dataset_id", F.when(F.col("dataset_id") == "DS-", F.concat(F.lit("DS-"), "source_type")).otherwise(F.col("dataset_id")))
    return lens.measured(df, cfg)


def datasets(features):
    ids = features.select("dataset_id", "source_type").distinct()
    return ids.select("dataset_id", "source_type", F.col("dataset_id").alias("name"), F.lit("user_upload").alias("provenance"),
                      F.to_timestamp(F.lit("2024-01-01")).alias("uploaded_at"))
