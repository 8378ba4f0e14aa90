"""Mixing sources to target weights by Poisson replication.

A source with share w of the target and m of the characters there are gets the mean repetition rate
epochs * w / m. Each document draws its number of copies from a Poisson distribution of that mean by
inversion: a uniform number from a hash of (seed, doc_id) is looked up in the source's table of
cumulative probabilities. A large mean is drawn as a sum of several Poisson numbers of at most
``MOST`` each. Copies are then shuffled globally: dealt to partitions by a hash of (seed, doc_id,
copy) and ordered by it. Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landrecon.llm.frames import neutral, renamed, restored
from landrecon.operators.rounds import Rounds

#: Largest mean inverted at once; exp(-MOST) is far above the smallest double.
MOST = 64.0
#: Sources up to here are broadcast, a row and a table of about MOST + 8 * sqrt(MOST) + 40 numbers each.
BROADCAST_SOURCES = 10_000
_DIGITS = 13  # hexadecimal digits of a hash that make a uniform number: 52 bits


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the MD5 of the parts joined by colons; a null part is an empty one."""
    joined = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(joined.cast("binary")), 1, _DIGITS), 16, 10).cast("double") / F.lit(float(16**_DIGITS))


def rates(docs: DataFrame, temperature: float = 0.5, epochs: float = 1.0,
          weights: dict[str, float] | None = None) -> DataFrame:
    """source, chars, rate (mean repetition rate) of each source.

    Without ``weights`` a source's target weight is its share of the characters to the power of
    ``temperature``: 1 leaves the mix as it is, 0 makes all sources equal. Weights are normalised over
    the sources there are; a source without a given weight has weight 0, one without characters rate 0.
    The sum is combined before its shuffle, so a large source is a row a task.
    """
    size = docs.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    if weights is None:
        weight = F.pow(F.col("chars").cast("double"), F.lit(float(temperature)))
    else:
        pairs = [F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("source")] if pairs else F.lit(0.0), F.lit(0.0))
    size = size.withColumn("w", F.when(F.col("chars") > 0, weight).otherwise(0.0))
    total = size.agg(F.sum("chars").alias("c"), F.sum("w").alias("t")).first()
    # share of the target over share of the characters
    rate = F.lit(float(epochs)) * (F.col("w") / F.lit(float(total.t or 1.0))) / (F.col("chars") / F.lit(float(total.c or 1)))
    return size.select("source", "chars", F.when(F.col("w") > 0, rate).otherwise(F.lit(0.0)).alias("rate"))


def tables(sources: DataFrame) -> DataFrame:
    """Adds draws (how many Poisson numbers are summed) and cdf (their cumulative probabilities)."""
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(MOST)).cast("int"))
    mean = F.col("_mean")
    last = (F.ceil(mean + 12 * F.sqrt(mean)) + 40).cast("int")  # beyond it, probabilities are below 2**-53
    steps = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf")),
        lambda a, k: F.struct((a["p"] * mean / k).alias("p"),
                              F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * mean / k)).alias("cdf")),
        lambda a: a["cdf"])
    return sources.withColumn("draws", draws).withColumn("_mean", F.col("rate") / F.col("draws")).withColumn("cdf", steps)


def copies(seed: int) -> Column:
    """Number of copies of a row with doc_id, draws and cdf."""
    def one(i: Column) -> Column:
        u = uniform(F.lit(seed), F.col("doc_id"), i)
        return F.size(F.filter("cdf", lambda c: c <= u))

    return F.aggregate(F.sequence(F.lit(1), F.col("draws")), F.lit(0), lambda a, i: a + one(i))


def mix(docs: DataFrame, seed: int = 0, temperature: float = 0.5, epochs: float = 1.0,
        weights: dict[str, float] | None = None) -> DataFrame:
    """All columns of ``docs`` with _copy, _copies, _rate and _order, one row a copy, globally shuffled.

    Rows of a partition are in ascending _order, and partitions are dealt by it. Equal doc_ids draw
    alike, and repeated rows are copied each; a null doc_id draws as an empty one and a null source is
    a source of its own. Rows drawn 0 times are gone: that is what the operator does. A column of ``docs`` that has the
    name of one of the four stays, and that one is left out.
    """
    rounds = Rounds(docs.sparkSession)
    table = rounds.keep(tables(rates(docs, temperature, epochs, weights)).select(
        F.col("source").alias("_source"), F.col("rate").alias("_rate"), "draws", "cdf"))
    names = neutral(docs, "doc_id", "source")
    own = docs.select(*renamed(docs, names))
    same = own["source"].eqNullSafe(table["_source"])
    joined = own.join(F.broadcast(table) if table.count() <= BROADCAST_SOURCES else table, same)
    drawn = joined.withColumn("_copies", copies(seed)).where("_copies > 0")
    exploded = drawn.select(*names.values(), "_rate", "_copies", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    order = F.md5(F.concat_ws(":", F.lit(f"order {seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                              F.col("_copy").cast("string")).cast("binary"))
    shuffled = exploded.withColumn("_order", order).repartition("_order").sortWithinPartitions("_order")
    return shuffled.select(*restored(names), *[c for c in ("_rate", "_copies", "_copy", "_order") if c not in names])


#: The same draw in SQL; {documents} with doc_id, text, source. Only for means of at most MOST.
MIX_SQL = """
    WITH size AS (SELECT source, sum(length(coalesce(text, ''))) AS chars FROM {documents} GROUP BY source),
    weighed AS (SELECT *, CASE WHEN chars > 0 THEN pow(chars::DOUBLE, {temperature}) ELSE 0 END AS w FROM size),
    rated AS (SELECT source, CASE WHEN w > 0 THEN {epochs} * (w / (SELECT sum(w) FROM weighed))
                     / (chars / (SELECT sum(chars) FROM weighed)::DOUBLE) ELSE 0 END AS rate FROM weighed),
    chances AS (SELECT source, rate, k, exp(-rate + CASE WHEN k > 0 THEN k * ln(rate) ELSE 0 END - lgamma(k + 1)) AS p
                FROM rated, range(0, 200) AS ks(k) WHERE rate > 0),
    cumulated AS (SELECT source, rate, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM chances),
    stepped AS (SELECT source, rate, list(c ORDER BY k) AS cdf FROM cumulated GROUP BY source, rate),
    drawn AS (SELECT d.*, t.rate, len(list_filter(t.cdf, lambda c: c <=
                ('0x' || substr(md5(concat_ws(':', '{seed}', coalesce(d.doc_id::VARCHAR, ''), '1')), 1, 13))::BIGINT
                / 4503599627370496.0)) AS copies
              FROM {documents} d JOIN stepped t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT drawn.*, unnest(range(1, copies + 1)) AS copy FROM drawn WHERE copies > 0"""
