"""Spatial joins by grid cells: an equi-join on cells, then the exact test.

A feature is listed in every cell its bounding box touches. A pair that shares several cells is
kept only in the first one, so no distinct is needed. Cells with very many features are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landrecon.functions import geo
from landrecon.operators import skew
from landrecon.settings import DEFAULTS, Settings

BOX = ("xmin", "ymin", "xmax", "ymax")


def search_pad(lat: Column, metres: float, cfg: Settings = DEFAULTS) -> tuple[Column, Column]:
    """Degrees of longitude and latitude that cover ``metres`` at a latitude (0 when unknown)."""
    dy = F.lit(metres / cfg.metres_per_degree)
    cosine = F.greatest(F.lit(cfg.min_cosine), F.abs(F.cos(F.coalesce(lat, F.lit(0.0)) * geo.RAD)))
    return dy / cosine, dy


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])


#: Edge of a cell against that of the next finer level, and the coarsest level.
FACTOR, TOP_LEVEL = 8, 12


def level_of(p: str, cell: float, max_cells: int) -> Column:
    """The finest level at which a box lies in at most ``max_cells`` cells (9 at least, so that every box has a level)."""
    out = F.lit(TOP_LEVEL)
    for level in reversed(range(TOP_LEVEL)):
        edge = cell * FACTOR ** level
        cells = ((F.col(p + "xmax") - F.col(p + "xmin")) / edge + 2) * ((F.col(p + "ymax") - F.col(p + "ymin")) / edge + 2)
        out = F.when(cells <= max(max_cells, 9), F.lit(level)).otherwise(out)
    return out


def listed(df: DataFrame, p: str, cell: float, pad_x: Column | None, pad_y: Column | None, levels: Column) -> DataFrame:
    """A row for each cell a box touches at each of its ``levels``, with the first of them at that level."""
    px, py = F.lit(0.0) if pad_x is None else pad_x, F.lit(0.0) if pad_y is None else pad_y
    edge = F.lit(cell) * F.pow(F.lit(float(FACTOR)), F.col("_level"))
    at = lambda value: F.floor(value / edge).cast("int")
    ranged = df.withColumns({p + "_px": px, p + "_py": py}).withColumn("_level", F.explode(levels)).withColumns({
        p + "_x0": at(F.col(p + "xmin") - F.col(p + "_px")), p + "_x1": at(F.col(p + "xmax") + F.col(p + "_px")),
        p + "_y0": at(F.col(p + "ymin") - F.col(p + "_py")), p + "_y1": at(F.col(p + "ymax") + F.col(p + "_py"))})
    return (ranged.withColumn("_cx", F.explode(F.sequence(p + "_x0", p + "_x1")))
            .withColumn("_cy", F.explode(F.sequence(p + "_y0", p + "_y1"))).drop(p + "_x1", p + "_y1"))


def _present(left: DataFrame, right: DataFrame, cell: float, max_cells: int) -> list[int]:
    """The levels at which boxes live: at most ``TOP_LEVEL`` + 1 numbers."""
    both = left.select(level_of("a_", cell, max_cells).alias("l")).unionByName(right.select(level_of("b_", cell, max_cells).alias("l")))
    return sorted(r.l for r in both.distinct().collect())


def box_pairs(left: DataFrame, right: DataFrame, cell: float, *, pad_x: Column | None = None,
              pad_y: Column | None = None, on: tuple[str, ...] = (),
              hot_rows: int | None = DEFAULTS.hot_rows, max_cells: int | None = None) -> DataFrame:
    """All pairs of left (``a_`` columns) and right (``b_`` columns) whose boxes meet.

    ``pad_x``/``pad_y`` widen the left boxes; columns in ``on`` must be equal. Without ``max_cells`` every box is listed at the
    given cell size. With it the grid is a hierarchy: a box lives at the level where it touches few cells, and two boxes meet at
    the coarser of their levels, the finer one by the cells that contain its own. A layer-wide footprint is listed in a few
    cells, and every box once for each coarser level at which some box lives.
    """
    if max_cells is None:
        level = F.array(F.lit(0))
        return _meeting(listed(left, "a_", cell, pad_x, pad_y, level), listed(right, "b_", cell, None, None, level),
                        on, hot_rows, False).select(*left.columns, *right.columns)
    present = F.array(*[F.lit(n) for n in _present(left, right, cell, max_cells)])
    home = lambda p: F.array(level_of(p, cell, max_cells))
    above = lambda p: F.filter(present, lambda n: n > level_of(p, cell, max_cells))
    a_home, b_home = listed(left, "a_", cell, pad_x, pad_y, home("a_")), listed(right, "b_", cell, None, None, home("b_"))
    b_up = listed(right, "b_", cell, None, None, above("b_"))
    a_up = listed(left, "a_", cell, pad_x, pad_y, above("a_"))
    pairs = [_meeting(a_home, b_home.unionByName(b_up), on, hot_rows, False), _meeting(a_up, b_home, on, hot_rows, True)]
    return pairs[0].select(*left.columns, *right.columns).unionByName(pairs[1].select(*left.columns, *right.columns))


def _meeting(a: DataFrame, b: DataFrame, on: tuple[str, ...], hot_rows: int | None, spread_left: bool) -> DataFrame:
    """Pairs of listed boxes that meet, each in the first cell they share; cells with very many boxes of one side are salted."""
    keys = ["_level", "_cx", "_cy"]
    for c in on:
        a, b = a.withColumn("_on_" + c, F.col("a_" + c)), b.withColumn("_on_" + c, F.col("b_" + c))
        keys.append("_on_" + c)
    if hot_rows is not None:
        if spread_left:
            a, b = skew.salted(a, b, keys, F.struct("a_xmin", "a_ymin", "a_ordinal"), hot_rows)
        else:
            b, a = skew.salted(b, a, keys, F.struct("b_xmin", "b_ymin", "b_ordinal"), hot_rows)
        keys = keys + ["_salt"]
    first = ((F.col("_cx") == F.greatest("a__x0", "b__x0")) & (F.col("_cy") == F.greatest("a__y0", "b__y0")))
    return a.join(b, keys).where(first & geo.boxes_meet("a_", "b_", F.col("a__px"), F.col("a__py")))


def has_oversize(features: DataFrame, cfg: Settings = DEFAULTS, cell: float | None = None) -> bool:
    """Whether any box spans more grid cells than are worth listing one by one."""
    edge = cell or cfg.cell_deg
    cells = ((F.col("xmax") - F.col("xmin")) / edge + 2) * ((F.col("ymax") - F.col("ymin")) / edge + 2)
    return not features.where(cells > cfg.oversize_cells).isEmpty()


def wide_cells(cell: float, cfg: Settings, *sides: DataFrame) -> int | None:
    """``max_cells`` for a join of these features: a hierarchy if one of them needs it."""
    return cfg.oversize_cells if any(has_oversize(s, cfg, cell) for s in sides) else None


def distinct_shapes(features: DataFrame, same: list[str], keep: list[str]) -> DataFrame:
    """One row per group of exact copies: first and last member and how many there are.

    Copies behave alike in every spatial test, so joins run on the groups and members are joined
    back afterwards. ``same`` are the columns that make two features copies; the digest of them
    (``shape_id``) is what gets shuffled, with partial aggregation before the exchange.
    """
    tagged = features.withColumn("shape_id", shape_id(same))
    first = F.min_by(F.struct(*[F.col(c) for c in dict.fromkeys(same + keep)]), F.col("ordinal"))
    grouped = tagged.groupBy("shape_id").agg(
        first.alias("_f"), F.count(F.lit(1)).alias("copies"),
        F.min(F.struct("ordinal", "feature_id")).alias("_lo"),
        F.max(F.struct("ordinal", "feature_id")).alias("_hi"))
    return grouped.select(
        "shape_id", "_f.*", "copies", F.col("_lo.ordinal").alias("ordinal"),
        F.col("_lo.feature_id").alias("feature_id"), F.col("_hi.ordinal").alias("last_ordinal"),
        F.col("_hi.feature_id").alias("last_feature_id"))


def shape_id(same: list[str]) -> Column:
    """128-bit digest of the columns, as 16 bytes; null positions and the nesting of geometry count too."""
    nulls = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in same])
    parts: list[Column] = [nulls, *[F.col(c) for c in same]]
    if "geom" in same:
        rings = F.flatten(F.col("geom.parts"))
        parts += [F.transform("geom.parts", F.size), F.transform(rings, F.size)]
    return F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *parts)), 16, "0") for seed in (1, 2)]))
