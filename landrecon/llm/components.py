"""Connected components of a graph given as pairs, by joins and aggregations only.

Alternates two steps until neither changes anything. The large-star step links the larger neighbours
of every node to its smallest neighbour, the small-star step its smaller neighbours and itself to the
smallest of them. Both keep the components; what remains is a star around the smallest node of each.
Minima are combined before the shuffle, and are written before they are joined back, so that both
sides of the join are exchanges that Spark can split where a node has very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landrecon.operators.rounds import Rounds


def _star(rounds: Rounds, edges: DataFrame, large: bool) -> DataFrame:
    """Edges are (u, v) with v < u."""
    down = edges.select("u", "v")
    if large:
        both = down.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = down
    least = rounds.keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    joined = both.join(least, "u")
    if large:
        made = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        made = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    kept = rounds.keep(made.where("u <> v").distinct())
    rounds.drop(least)
    return kept


def components(rounds: Rounds, pairs: DataFrame) -> DataFrame:
    """node, component (its smallest node) for each node of ``pairs`` (a long, b long).

    Pairs may repeat, come in either order and join a node to itself; nulls are passed over. Nodes
    without a pair, or only with themselves, have no row: such a node is its own component.
    """
    edges = rounds.keep(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        spread = _star(rounds, edges, True)
        after = _star(rounds, spread, False)
        rounds.drop(edges, spread)
        edges = after
        seen = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state or not seen[0]:
            break
        state = seen
    smallest = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(smallest)
