"""Versions of a source kept with a digest tree, so that only what differs is read and joined.

A version is written once, one row for each stable key, in the order of the key's hash. The leaves of the tree are the ranges of
that hash with the same first ``LEAF_BITS`` bits; a leaf's digest is the sum of its rows' digests, a node's
the sum of its children's. Two versions are compared from the root: the children of equal nodes are
not looked at. Only rows of differing leaves are read (leaves are the sort order of the files, so the scan skips the rest) and
joined. Sums do not depend on the order of rows, and equal digests stand for equal rows but for a chance of
about 2**-63 a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landrecon.operators import changes

LEAF_BITS, FANOUT_BITS = 16, 4
#: Leaves that are named in the scan's own filter; more are looked up in a broadcast table of at most 2**LEAF_BITS rows.
NAMED_LEAVES = 2000


def _leaf(key: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 64 - LEAF_BITS).cast("int")


def save_version(features: DataFrame, path: str) -> None:
    """Write the last feature of each stable key of ``features`` and the tree over them."""
    bag = F.array_sort(F.map_entries(F.coalesce(F.col("v.properties"), F.create_map().cast("map<string,string>"))))
    flat = F.concat_ws("", F.transform(bag, lambda e: F.to_json(F.struct(e.key.alias("k"), e.value.alias("v")))))
    content = [F.col("key"), flat, F.coalesce(F.concat(F.lit("g"), "v.geometry_geojson"), F.lit(""))]
    rows = changes._keyed(features, []).select("key", _leaf(F.col("key")).alias("leaf"), "v", F.xxhash64(*content).alias("digest"))
    rows.repartitionByRange("leaf").sortWithinPartitions("leaf", "key").write.mode("overwrite").parquet(f"{path}/rows")
    spark = features.sparkSession
    level = spark.read.parquet(f"{path}/rows").groupBy(F.col("leaf").alias("node")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("digest").cast("decimal(38,0)")).alias("digest"))
    for bits in range(LEAF_BITS, -1, -FANOUT_BITS):
        level.coalesce(1).write.mode("overwrite").parquet(f"{path}/tree/bits={bits}")  # at most 2**bits rows
        stored = spark.read.parquet(f"{path}/tree/bits={bits}")
        level = stored.groupBy(F.shiftright("node", FANOUT_BITS).alias("node")).agg(
            F.sum("rows").alias("rows"), F.sum("digest").cast("decimal(38,0)").alias("digest"))


def differing(spark: SparkSession, old: str, new: str) -> list[int]:
    """The leaves in which two versions differ, found from the root down; at most 2**LEAF_BITS numbers."""
    found = [0]
    for bits in range(0, LEAF_BITS + 1, FANOUT_BITS):
        sides = [spark.read.parquet(f"{p}/tree/bits={bits}") for p in (old, new)]
        if bits:
            parents = spark.createDataFrame([(n,) for n in found], "parent int")
            sides = [s.join(F.broadcast(parents), F.shiftright("node", FANOUT_BITS) == F.col("parent"), "left_semi") for s in sides]
        both = sides[0].alias("o").join(sides[1].alias("n"), "node", "full_outer").where(
            ~(F.col("o.rows").eqNullSafe(F.col("n.rows")) & F.col("o.digest").eqNullSafe(F.col("n.digest"))))
        found = sorted(r.node for r in both.select("node").collect())
        if not found:
            break
    return found


def rows_of(spark: SparkSession, path: str, leaves: list[int]) -> DataFrame:
    """The rows of some leaves of a version."""
    rows = spark.read.parquet(f"{path}/rows")
    if len(leaves) <= NAMED_LEAVES:
        return rows.where(F.col("leaf").isin(leaves))
    wanted = spark.createDataFrame([(n,) for n in leaves], "leaf int")
    return rows.join(F.broadcast(wanted), "leaf", "left_semi")


def stored_changes(spark: SparkSession, old: str, new: str) -> DataFrame:
    """Events between two stored versions, as ``changes.source_version_changes`` has them, with the key."""
    leaves = differing(spark, old, new)
    before = rows_of(spark, old, leaves).select("key", F.col("v").alias("p"), F.col("digest").alias("was"))
    after = rows_of(spark, new, leaves).select("key", F.col("v").alias("c"), F.col("digest").alias("now"))
    both = before.join(after, "key", "full_outer").where(~F.col("was").eqNullSafe(F.col("now")))
    return changes._version_events(both.select("key", "p", "c"), False, [])


def stored_keys(spark: SparkSession, old: str, new: str) -> DataFrame:
    """Each key of either stored version with ``added``, ``removed`` or ``common``; keys of equal leaves are not joined."""
    leaves = differing(spark, old, new)
    same = spark.read.parquet(f"{new}/rows")
    if leaves:
        gone = spark.createDataFrame([(n,) for n in leaves], "leaf int")
        same = same.join(F.broadcast(gone), "leaf", "left_anti")  # at most 2**LEAF_BITS rows
    before = rows_of(spark, old, leaves).select("key", F.lit(1).alias("p"))
    after = rows_of(spark, new, leaves).select("key", F.lit(1).alias("c"))
    state = F.when(F.col("p").isNull(), "added").when(F.col("c").isNull(), "removed").otherwise("common")
    return same.select("key", F.lit("common").alias("state")).unionByName(
        before.join(after, "key", "full_outer").select("key", state.alias("state")))
