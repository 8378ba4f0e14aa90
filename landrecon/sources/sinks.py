"""Writers, snapshots and the audit trail."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from landrecon.functions import geo
from landrecon.operators import changes, search
from landrecon.operators.unify import PARCEL_COLUMNS

AUDIT_SCHEMA = ("actor string, action string, resource_type string, resource_id string, "
                "before_state string, after_state string, created_at timestamp")
SNAPSHOT_SCHEMA = ("id string, parcel_id string, owner_name string, area double, land_use string, "
                   "building_count bigint, geometry_geojson string, parcel_rank bigint")


def _iso(parcels: DataFrame) -> DataFrame:
    stamp = F.date_format("last_updated", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return parcels.withColumn("last_updated", F.regexp_replace(stamp, r"\.000000$", ""))


def geojson_lines(parcels: DataFrame) -> DataFrame:
    """One GeoJSON feature per row; a parcel without geometry has a null one."""
    props = F.to_json(F.struct(*PARCEL_COLUMNS), {"ignoreNullFields": "false"})
    geometry = F.coalesce(F.nullif(F.col("geometry_geojson"), F.lit("")), F.lit("null"))
    return _iso(parcels).select(F.concat(
        F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), props, F.lit("}")).alias("value"))


def write_geojson(parcels: DataFrame, path: str) -> None:
    """Newline-delimited features, written in parallel."""
    geojson_lines(parcels).write.mode("overwrite").text(path)


def write_geojson_collection(parcels: DataFrame, path: str) -> None:
    """One FeatureCollection text per output file, built where the rows are."""
    _write_collections(geojson_lines(parcels), path)


def write_features(features: DataFrame, path: str) -> None:
    """Features of one dataset, with their properties and geometry, as FeatureCollection files."""
    text = F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(geo.to_geojson(F.col("geom")), F.lit("null")),
                    F.lit(',"properties":'), F.to_json("properties", {"ignoreNullFields": "false"}), F.lit("}"))
    _write_collections(features.select(text.alias("value")), path)


def _write_collections(lines: DataFrame, path: str) -> None:
    write_wrapped(lines, path, '{"type":"FeatureCollection","features":[', ",", "]}")


def write_wrapped(lines: DataFrame, path: str, head: str, between: str, tail: str, rows_per_file: int | None = None) -> None:
    """Texts (one column) as files that each start with ``head`` and end with ``tail``, built where the rows are.

    With ``rows_per_file`` the rows are dealt to enough files of about as many rows at most, for readers that cannot split a file.
    """
    if rows_per_file is not None:
        lines = lines.repartition(max(1, -(-lines.count() // rows_per_file)))

    def wrap(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_pydict({"value": [head]})
        first = True
        for batch in batches:
            rows = batch.column(0).to_pylist()
            if rows:
                yield pa.RecordBatch.from_pydict({"value": [("" if first and i == 0 else between) + r for i, r in enumerate(rows)]})
                first = False
        yield pa.RecordBatch.from_pydict({"value": [tail]})

    lines.mapInArrow(wrap, "value string").write.mode("overwrite").text(path)


def csv_rows(parcels: DataFrame) -> DataFrame:
    return _iso(parcels).select(*PARCEL_COLUMNS)


def write_csv(parcels: DataFrame, path: str) -> None:
    csv_rows(parcels).write.mode("overwrite").option("header", True).csv(path)


def save_snapshot(parcels: DataFrame, path: str, run_id: str) -> None:
    """Write the run's snapshot to its own folder, then commit it by a new numbered manifest that names it.

    A manifest is created only if its number is free, so of two writers one takes the next number; none is ever overwritten.
    """
    changes.snapshot(parcels).write.mode("overwrite").parquet(f"{path}/{run_id}")
    commit_snapshot(parcels.sparkSession, path, run_id)


def commit_snapshot(spark: SparkSession, path: str, run_id: str) -> None:
    java = spark._jvm
    number = max(_manifests(spark, path), default=0)
    while True:
        number += 1
        place = java.org.apache.hadoop.fs.Path(f"{path}/_versions/{number:012d}.json")
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        if files.exists(place):
            continue
        try:
            out = files.create(place, False)
        except Exception as error:  # another writer has the number
            if "FileAlreadyExists" not in str(error):
                raise
            continue
        out.write(bytearray(json.dumps({"run_id": run_id}).encode()))
        out.close()
        return


def _manifests(spark: SparkSession, path: str) -> list[int]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_versions")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The last whole snapshot, or an empty one when there is none.

    A manifest that was cut off, or whose rows are not whole, is passed over for the one before it.
    """
    for number in sorted(_manifests(spark, path), reverse=True):
        text = spark.read.text(f"{path}/_versions/{number:012d}.json", wholetext=True).first()
        try:
            run_id = json.loads(text.value)["run_id"] if text else None
        except (ValueError, KeyError):
            run_id = None
        if run_id is not None and _exists(spark, f"{path}/{run_id}/_SUCCESS"):
            return spark.read.schema(SNAPSHOT_SCHEMA).parquet(f"{path}/{run_id}")
    return spark.createDataFrame([], StructType.fromDDL(SNAPSHOT_SCHEMA))


def _exists(spark: SparkSession, path: str) -> bool:
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    return files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files)


def append_audit(rows: DataFrame, path: str) -> None:
    rows.select("actor", "action", "resource_type", "resource_id", "before_state", "after_state",
                "created_at").write.mode("append").parquet(path)


def audit_log(spark: SparkSession, path: str, limit: int = 100) -> DataFrame:
    rows = spark.read.schema(AUDIT_SCHEMA).parquet(path)
    return rows.orderBy(F.desc("created_at"), "resource_id").limit(min(max(limit, 1), 500))


def export_report_bundle(path: str, **tables: DataFrame) -> None:
    """One JSON folder per section of the current results, in gzip files, as texts repeat every name and prefix in each row."""
    for name, df in search.report_sections(**tables).items():
        df.write.mode("overwrite").option("zlib.compress.level", "BEST_SPEED").json(f"{path}/{name}", compression="gzip")
