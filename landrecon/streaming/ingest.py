"""New uploads trigger a run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from landrecon.sources.readers import as_features

UPLOAD_SCHEMA = "dataset_id string, source_type string, ordinal bigint, properties map<string,string>, geometry_geojson string"


def incremental_ingest(spark: SparkSession, folder: str, features_path: str, checkpoint: str,
                       on_commit: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Watch ``folder`` for files of raw feature lines and call ``on_commit`` after each batch.

    Every micro-batch replaces its own output folder, so a batch that is retried after a failure
    leaves no second copy. ``on_commit`` gets all features ingested so far.
    """
    uploads = spark.readStream.schema(UPLOAD_SCHEMA).json(folder)

    def commit(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch).write.mode("overwrite").parquet(f"{features_path}/batch={batch_id}")
        if on_commit is not None:
            on_commit(spark.read.parquet(features_path).drop("batch"), batch_id)

    return (uploads.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def ingest_batch(raw: DataFrame) -> DataFrame:
    """Features of uploads of any source; their dataset and source come with the rows."""
    bag = F.coalesce("properties", F.create_map().cast("map<string,string>"))
    return as_features(raw.withColumn("properties", bag), F.col("dataset_id"), F.col("source_type"))
