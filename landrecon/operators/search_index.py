"""Search of parcels by a table of trigrams instead of a scan.

The index of a parcel table has the parcels in ``BUCKETS`` folders by a hash of their id, and for every run of three characters of
a lower-cased identifier or owner the ids (with their folders) that have it, in the order of the
trigrams. A search looks up the rarest trigrams of its term, intersects their ids, and reads only the folders that hold one of them; the exact
test of ``search.search_parcels`` then runs on those parcels. Terms without three characters in a row
have no trigram and read all parcels.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landrecon.functions import scalar
from landrecon.operators import search
from landrecon.operators.rounds import Rounds

BUCKETS = 64
#: Trigrams of a term that are intersected: the rarest. The exact test does the rest.
RAREST = 3
#: Ids that are looked up by a broadcast table; more are joined by shuffle.
BROADCAST_IDS = 100_000
FIELDS = ("parcel_id", "owner_name")


def _grams(text: Column) -> Column:
    low = F.lower(text)
    places = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2))
    return F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(3))))


def write_index(parcels: DataFrame, path: str) -> None:
    """Write the parcels and their trigrams. Null texts have none."""
    spark = parcels.sparkSession
    bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")
    parcels.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/parcels")
    stored = spark.read.parquet(f"{path}/parcels")
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS])
    rows = stored.select("id", "bucket", F.explode(fields).alias("f")).select("id", "bucket", "f.field", F.explode(_grams(F.col("f.text"))).alias("gram"))
    rows.repartitionByRange("field", "gram").sortWithinPartitions("field", "gram").write.mode("overwrite").parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("field", "gram").agg(F.count(F.lit(1)).alias("ids")).repartitionByRange(
        "field", "gram").sortWithinPartitions("field", "gram").write.mode("overwrite").parquet(f"{path}/grams")


def term_grams(term: str) -> list[str]:
    """Trigrams that every text matching ``ILIKE '%term%'`` has: those of the runs between wildcards and escapes."""
    found = {run[i : i + 3] for run in re.split(r"[%_\\]", term.lower()) for i in range(len(run) - 2)}
    return sorted(g for g in found if len(g) == 3)


def candidates(spark: SparkSession, path: str, term: str, field: str) -> DataFrame | None:
    """id and bucket of the parcels whose field has the rarest trigrams of the term; None if it has no trigram."""
    grams = term_grams(term)
    if not grams:
        return None
    counts = {r.gram: r.ids for r in spark.read.parquet(f"{path}/grams").where((F.col("field") == field) & F.col("gram").isin(grams)).collect()}
    rarest = sorted(grams, key=lambda g: (counts.get(g, 0), g))[:RAREST]
    postings = spark.read.parquet(f"{path}/postings").where((F.col("field") == field) & F.col("gram").isin(rarest))
    return postings.groupBy("id", "bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(rarest)).select("id", "bucket")


def parcels_with(spark: SparkSession, path: str, term: str, role: str | None = None) -> DataFrame:
    """The indexed parcels that may match a term, read from the folders that hold one."""
    stored = spark.read.parquet(f"{path}/parcels")
    fields = FIELDS if scalar.can_view_owners(role) else FIELDS[:1]
    found = [candidates(spark, path, term, f) for f in fields]
    if None in found:
        return stored.drop("bucket")
    ids = found[0]
    for more in found[1:]:
        ids = ids.unionByName(more)
    ids = Rounds(spark).keep(ids.distinct())
    buckets = [r.bucket for r in ids.select("bucket").distinct().collect()]  # at most BUCKETS numbers
    wanted = ids.select("id")
    return stored.where(F.col("bucket").isin(buckets)).join(
        F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted, "id", "left_semi").drop("bucket")


def search_parcels(spark: SparkSession, path: str, *, term: str, role: str | None = None, **filters) -> DataFrame:
    """``search.search_parcels`` over an index."""
    return search.search_parcels(parcels_with(spark, path, term, role), search=term, role=role, **filters)
