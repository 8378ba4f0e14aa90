"""Helpers that keep hot keys from landing in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MAX_HOT_KEYS = 100_000
BUCKET_BITS = 16


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame:
    """The busiest keys and into how many pieces to split each: at most ``MAX_HOT_KEYS`` rows.

    Every key beyond them is smaller than a hundred-thousandth of the table, which a plain shuffle handles.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= hot_rows)
    top = counts.orderBy(F.desc("_n"), *keys).limit(MAX_HOT_KEYS)
    return top.select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_pieces"))


def salted(many: DataFrame, few: DataFrame, keys: list[str], spread: Column,
           hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Spread the hot keys of ``many`` over a ``_salt`` and repeat the matching rows of ``few``.

    Both results carry ``_salt``; joining on ``keys + ["_salt"]`` equals joining on ``keys``.
    The list of hot keys is bounded, so it is broadcast.
    """
    hot = F.broadcast(hot_keys(many, keys, hot_rows))
    pieces = F.coalesce(F.col("_pieces"), F.lit(1))
    left = (many.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), pieces).cast("int"))
            .drop("_pieces"))
    right = (few.join(hot, keys, "left")
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("_pieces"))
    return left, right


def running_sum(df: DataFrame, group: list[str], order: str, value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of the group up to each row, by the unique integer ``order``.

    Two levels instead of one window per group: rows are summed per block of ``2**16`` order
    values, blocks get their start from a running sum, and only the rows of one block are sorted
    together. No task ever holds a whole group, however large.
    """
    tagged = df.withColumns({"_block": F.shiftright(F.col(order), BUCKET_BITS), "_value": value})
    sums = tagged.groupBy(*group, "_block").agg(F.sum("_value").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = (Window.partitionBy(*group, "_block").orderBy(order)
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = tagged.withColumn("_sum", F.sum("_value").over(inner))
    joined = ranked.join(starts, group + ["_block"])
    return joined.withColumn(out, F.col("_start") + F.col("_sum")).drop("_block", "_start", "_sum", "_value")


def running_position(df: DataFrame, group: list[str], order: str, out: str) -> DataFrame:
    """1-based position of each row in its group (see ``running_sum``)."""
    return running_sum(df, group, order, F.lit(1), out)


def lookup_join(many: DataFrame, few: DataFrame, keys: list[str], spread: Column, how: str = "inner",
                hot_rows: int = 50_000, max_rows: int = 200_000) -> DataFrame:
    """Join a large table to a small one whose keys may be hot on the large side.

    The small side is counted: up to ``max_rows`` it is broadcast, beyond that hot keys are salted.
    """
    if few.limit(max_rows + 1).count() <= max_rows:
        return many.join(F.broadcast(few), keys, how)
    left, right = salted(many, few, keys, spread, hot_rows)
    return left.join(right, keys + ["_salt"], how).drop("_salt")
