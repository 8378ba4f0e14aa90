"""Text comparison by matching blocks, once per distinct pair, and by vectors, encoded once per distinct text."""

from __future__ import annotations

from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from landrecon.functions import scalar


@F.pandas_udf(T.DoubleType())
def _ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([
        None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


def ratcliff_ratio(a: Column, b: Column) -> Column:
    """Similarity of two texts; the order of arguments matters. Equal texts skip Python work."""
    same = a == b
    return F.when(same, F.lit(1.0)).otherwise(_ratio_udf(F.when(~same, a), F.when(~same, b)))


def ratio_bound(a: Column, b: Column) -> Column:
    """No pair of texts of these lengths can be more similar than this."""
    total = F.length(a) + F.length(b)
    return F.when(total > 0, 2.0 * F.least(F.length(a), F.length(b)) / total).otherwise(F.lit(1.0))


def ratio_table(pairs: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Similarity of every distinct unequal pair of texts found in the given column pairs.

    Texts repeat far more often than they differ, so this is much smaller than ``pairs``.
    """
    each = F.array(*[F.struct(F.col(a).alias("_ra"), F.col(b).alias("_rb")) for a, b in columns])
    distinct = pairs.select(F.inline(each)).where(F.col("_ra") != F.col("_rb")).distinct()
    return distinct.withColumn("_r", _ratio_udf("_ra", "_rb"))


def look_up(pairs: DataFrame, table: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add the similarity of columns ``a`` and ``b`` from a ratio table; equal texts need no entry."""
    joined = pairs.join(table, (F.col(a) == F.col("_ra")) & (F.col(b) == F.col("_rb")), "left")
    value = F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(F.col("_r"))
    return joined.withColumn(out, value).drop("_ra", "_rb", "_r")


Encoder = Callable[[Column], Column]


def vector_table(texts: DataFrame, columns: list[str], encoder: Encoder | tuple[Encoder, Encoder]) -> DataFrame:
    """``digest`` and ``vector`` of every distinct text found in the given columns.

    Of two encoders the second makes a ``passage`` vector, which stands for the text as the second of a pair.
    An encoder runs once for each row, so write the result before it is read twice. The digest stands for the
    text in later joins: 32 bytes, however long the text is.
    """
    query, passage = encoder if isinstance(encoder, tuple) else (encoder, None)
    found = texts.select(F.explode(F.array(*[F.col(c) for c in columns])).alias("_text")).where("_text is not null").distinct()
    made = [query(F.col("_text")).alias("vector")] + ([passage(F.col("_text")).alias("passage")] if passage else [])
    return found.select(text_digest(F.col("_text")).alias("digest"), *made)


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def alike_table(pairs: DataFrame, columns: list[tuple[str, str]], vectors: DataFrame) -> DataFrame:
    """Vector similarity ``_e`` of every distinct pair of texts, equal ones too, found in the given column pairs.

    Vectors meet distinct pairs of texts here; no vector is put on a row of ``pairs``.
    """
    each = F.array(*[F.struct(F.col(a).alias("_ra"), F.col(b).alias("_rb")) for a, b in columns])
    met = pairs.select(F.inline(each)).where("_ra is not null and _rb is not null").distinct()
    for side in ("a", "b"):
        kind = "passage" if side == "b" and "passage" in vectors.columns else "vector"
        known = vectors.select(F.col("digest").alias("_d" + side), F.col(kind).alias("_v" + side))
        met = met.withColumn("_d" + side, text_digest(F.col("_r" + side))).join(known, "_d" + side, "left")
    return met.select("_ra", "_rb", scalar.embedding_similarity(F.col("_va"), F.col("_vb")).alias("_e"))


def look_up_alike(pairs: DataFrame, table: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add the vector similarity of columns ``a`` and ``b``; null where a text is missing or has no vector."""
    joined = pairs.join(table, (F.col(a) == F.col("_ra")) & (F.col(b) == F.col("_rb")), "left")
    return joined.withColumn(out, F.col("_e")).drop("_ra", "_rb", "_e")


def with_ratio(pairs: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add the similarity of columns ``a`` and ``b``."""
    return look_up(pairs, ratio_table(pairs, [(a, b)]), a, b, out)
