"""Checks that a layer or a set of tables is what it claims to be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from landrecon.functions import geo
from landrecon.settings import DEFAULTS, Settings

# Accepted vector files and column names that must never be published.
VECTOR_EXTENSIONS = (".csv", ".geojson", ".json")
FORBIDDEN_COLUMNS = ("file_path", "password", "password_hash", "secret", "token", "local_path", "ip_address")


def preflight_layer(layer: DataFrame, cfg: Settings = DEFAULTS) -> DataFrame:
    """One row per file of ``(filename, geometry_geojson)`` rows with its counts and verdict."""
    counted = layer.groupBy("filename").agg(
        F.count(F.lit(1)).alias("features"),
        F.coalesce(F.sum(geo.json_num_vertices(F.col("geometry_geojson"))), F.lit(0)).alias("positions"))
    ext = F.lower(F.regexp_extract("filename", r"(\.[^./]+)$", 1))
    vertices = F.when(ext == ".csv", F.col("features")).otherwise(F.col("positions"))
    verdict = (F.when(~ext.isin(*VECTOR_EXTENSIONS), "unsupported_type")
               .when(F.col("features") > cfg.max_features, "too_many_features")
               .when(F.col("vertices") > cfg.max_vertices, "too_many_vertices").otherwise("ok"))
    return counted.withColumn("vertices", vertices).withColumn("verdict", verdict).drop("positions")


def check_columns(tables: dict[str, DataFrame], allowed: dict[str, list[str]]) -> DataFrame:
    """Columns that are not allowed or must never be published; empty when all is well."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, c, "forbidden" if c in FORBIDDEN_COLUMNS else "unexpected")
            for t, df in tables.items() for c in df.columns
            if c in FORBIDDEN_COLUMNS or c not in allowed.get(t, [])]
    return spark.createDataFrame(rows, "table_name string, column_name string, problem string")


def check_geojson(df: DataFrame, key: str, column: str = "geometry_geojson") -> DataFrame:
    """Rows whose geometry is neither null nor parseable JSON."""
    bad = F.col(column).isNotNull() & F.try_parse_json(F.col(column)).isNull()
    return df.where(bad).select(key, column)


def check_provenance(datasets: DataFrame, expected: str) -> DataFrame:
    return datasets.agg(F.count(F.lit(1)).alias("datasets"), F.coalesce(F.sum(
        (~F.col("provenance").eqNullSafe(F.lit(expected))).cast("long")), F.lit(0)).alias("unexpected"))


def orphan_check(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows that reference no parent; rows without a reference are fine."""
    refs = parent.select(F.col(parent_key).alias("_p")).distinct()
    return child.where(F.col(key).isNotNull()).join(refs, F.col(key) == F.col("_p"), "left_anti")


def _ordered(value: Column, kind: DataType) -> Column:
    """The value with the keys of its maps and the fields of its structs in order."""
    if isinstance(kind, MapType):
        return F.map_from_entries(F.transform(
            F.array_sort(F.map_keys(value)), lambda k: F.struct(k, _ordered(value[k], kind.valueType))))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _ordered(x, kind.elementType))
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(value.isNotNull(), F.struct(*[_ordered(value.getField(f.name), f.dataType).alias(f.name) for f in fields]))
    return value


def canonical_json_sha256(df: DataFrame) -> DataFrame:
    """Digest per row of its JSON with sorted keys, those of maps and nested structs included, and compact separators."""
    types = {f.name: f.dataType for f in df.schema.fields}
    row = F.to_json(F.struct(*[_ordered(F.col(f"`{c}`"), types[c]).alias(c) for c in sorted(types)]), {"ignoreNullFields": "false"})
    return df.withColumn("row_sha256", F.sha2(row, 256))


def table_digest(df: DataFrame) -> DataFrame:
    """Order-free digest of a table: count and per-slice sums of the row digests."""
    h = canonical_json_sha256(df).select("row_sha256")
    slices = [F.sum(F.conv(F.substring("row_sha256", 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")).cast("string").alias(f"s{i}")
              for i in range(8)]
    return h.agg(F.count(F.lit(1)).alias("rows"), *slices).select(
        "rows", F.sha2(F.concat_ws("|", "rows", *[f"s{i}" for i in range(8)]), 256).alias("digest"))


def delete_dataset(tables: dict[str, DataFrame], dataset_ids: DataFrame) -> dict[str, DataFrame]:
    """Tables without the rows of the given datasets."""
    gone = dataset_ids.select("dataset_id").distinct()
    return {n: df.join(gone, "dataset_id", "left_anti") if "dataset_id" in df.columns else df
            for n, df in tables.items()}
