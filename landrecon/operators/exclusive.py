"""One-to-one matching: every feature belongs to at most one group.

Anchors choose in order; each takes its best unused candidate of every other dataset. That
sequential rule is a serial dictatorship, and its result is what deferred acceptance converges to
when all candidates prefer earlier anchors: anchors propose, a candidate keeps the earliest
proposer, rejected anchors try their next choice. The outcome does not depend on the order of
proposals. So each spatial block settles its own candidates in one grouped task, and only proposals
that leave a block need another round. Blocks too large for a task advance by joins and
aggregates instead. Exact copies form one candidate with as many places as there are copies.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass
from heapq import heappush, heappushpop

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from landrecon.operators import grid, match, skew
from landrecon.operators.rounds import Rounds
from landrecon.settings import DEFAULTS, Settings

SLOT = ["anchor_id", "anchor_rank", "a_shape_id", "b_dataset_id"]
CHOICE = ["pos", "b_shape_id", "b_copies", "b_anchor_rank", "block"]
STATE = [*SLOT, *CHOICE]
BLOCK_CELLS = 8
#: A rank is the dataset's number, then the place in the dataset in this many bits; 48 bits in all.
PLACE_BITS, MAX_NUMBERED = 36, 4096


def with_rank(features: DataFrame, datasets: DataFrame) -> DataFrame:
    """Adds ``rank``, a unique integer that orders by dataset upload time, dataset and place in the dataset.

    Where datasets are few and places are unique, the two are put side by side and no feature is moved; else features are
    sorted and numbered.
    """
    order = datasets.select("dataset_id", "uploaded_at")
    if _places_are_unique(features, order):
        number = F.row_number().over(Window.orderBy("uploaded_at", "dataset_id")) - 1  # of at most MAX_NUMBERED rows
        numbered = order.select("dataset_id", F.shiftleft(number.cast("long"), PLACE_BITS).alias("_base"))
        return features.join(F.broadcast(numbered), "dataset_id").withColumn("rank", F.col("_base") + F.col("ordinal")).drop("_base")
    dated = skew.lookup_join(features, datasets.select("dataset_id", "uploaded_at"), ["dataset_id"], F.col("ordinal"))
    return match.group_numbering(dated, ["uploaded_at", "dataset_id", "ordinal"]).withColumnRenamed(
        "group_number", "rank").drop("matched_group_id", "uploaded_at")


def _places_are_unique(features: DataFrame, order: DataFrame) -> bool:
    """Whether dataset and ``ordinal`` tell features apart and fit a rank. Shuffles these two columns at most."""
    ids = order.limit(MAX_NUMBERED + 1).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dataset_id").alias("d")).first()
    if ids.n > MAX_NUMBERED or ids.n != ids.d:
        return False
    place = features.select("dataset_id", F.col("ordinal").cast("long").alias("o"))
    fits = F.col("o").isNotNull() & (F.col("o") >= 0) & (F.col("o") < 1 << PLACE_BITS)
    return place.groupBy("dataset_id", "o").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | ~fits).isEmpty()


@dataclass
class Phase:
    """Anchors that act and the matches they make."""

    anchors: DataFrame
    matches: DataFrame


def preferences(scored: DataFrame, hot: DataFrame | None, cfg: Settings) -> DataFrame:
    """Position of each candidate shape in the order its anchor shape would choose.

    Anchors with very many candidates of one dataset (``hot``) are ranked block by block.
    """
    size = cfg.cell_deg * BLOCK_CELLS
    block = F.concat_ws(":", F.floor(F.col("b_xmin") / size), F.floor(F.col("b_ymin") / size))
    scored = scored.withColumn("block", block)
    out = ["a_shape_id", "b_dataset_id", *CHOICE, "b_feature_id", *match.SCORES]
    order = Window.partitionBy("a_shape_id", "b_dataset_id").orderBy(F.desc("overall_confidence"), "b_ordinal")
    if hot is None:
        return scored.withColumn("pos", F.row_number().over(order).cast("long")).select(out)
    keys = ["a_shape_id", "b_dataset_id"]
    few = scored.join(F.broadcast(hot), keys, "left_anti").withColumn("pos", F.row_number().over(order).cast("long"))
    # Confidence in falling tenths, then the candidate's rank, as one integer.
    place = F.shiftleft(1000 - F.round(F.col("overall_confidence") * 10).cast("long"), 48) + F.col("b_ordinal")
    many = scored.join(F.broadcast(hot), keys, "left_semi").withColumn("_place", place)
    return few.select(out).unionByName(skew.running_position(many, keys, "_place", "pos").select(out))


def _settle_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Deferred acceptance among the candidates of one block.

    Every row is an anchor's slot with its choices from the current one on. A slot ends up holding a
    candidate, asking for one of another block, or with nothing left.
    """
    block = pdf["block"].iloc[0]
    ranks, choices = pdf["anchor_rank"].tolist(), pdf["choices"].tolist()
    at, holders, outcome = [0] * len(pdf), defaultdict(list), ["out"] * len(pdf)
    todo = list(range(len(pdf)))
    while todo:
        i = todo.pop()
        if at[i] >= len(choices[i]):
            outcome[i] = "out"
            continue
        c = choices[i][at[i]]
        if c["b_anchor_rank"] is not None and ranks[i] > c["b_anchor_rank"]:
            at[i] += 1
            todo.append(i)
        elif c["block"] != block:
            outcome[i] = "ask"
        else:
            outcome[i] = "held"
            heap = holders[c["b_shape_id"]]
            if len(heap) < c["b_copies"]:
                heappush(heap, (-ranks[i], i))
            else:
                loser = heappushpop(heap, (-ranks[i], i))[1]
                at[loser] += 1
                todo.append(loser)
    keep = [i for i in range(len(pdf)) if outcome[i] != "out"]
    picked = [choices[i][at[i]] for i in keep]
    out = pdf.iloc[keep][SLOT].reset_index(drop=True)
    for name in CHOICE:
        out[name] = pd.Series([c[name] for c in picked], dtype="Int64" if name == "b_anchor_rank" else None)
    out["outcome"] = [outcome[i] for i in keep]
    return out[[*STATE, "outcome"]]


def _judged(asks: DataFrame) -> DataFrame:
    """Marks the proposals that lose: all but the earliest anchors, as many as there are copies."""
    lone, shared = asks.where(F.col("b_copies") == 1), asks.where(F.col("b_copies") > 1)
    first = lone.groupBy("b_shape_id").agg(F.min("anchor_rank").alias("_lo"))
    lone = lone.join(first, "b_shape_id").withColumn("_lost", F.col("anchor_rank") > F.col("_lo"))
    # Several slots of one anchor never want the same shape, so ranks are unique within one.
    shared = skew.running_position(shared, ["b_shape_id"], "anchor_rank", "_place").withColumn(
        "_lost", F.col("_place") > F.col("b_copies"))
    columns = [*STATE, "_lost"]
    return lone.select(columns).unionByName(shared.select(columns))


class _Held:
    """Who holds which candidate: a large table plus a small one that overrides touched shapes.

    A shape that was ever held stays held, so the holders a round names for a shape are all it has.
    """

    def __init__(self, rounds: Rounds):
        self.rounds = rounds
        self.base: DataFrame | None = None
        self.added: DataFrame | None = None

    def all(self) -> DataFrame:
        if self.added is None:
            return self.base
        return _over(self.base, self.added)

    def of(self, asked: DataFrame, key: str) -> DataFrame | None:
        """Holders of the asked shapes or blocks."""
        if self.base is None:
            return None
        wanted = asked.select(key).distinct()
        out = self.base.join(wanted, key, "left_semi").select(STATE)
        if self.added is None:
            return out
        return _over(out, self.added.join(wanted, key, "left_semi").select(STATE))

    def replace(self, won: DataFrame) -> None:
        if self.base is None:
            self.base = won.select(STATE)
            return
        self.added = self.rounds.keep(won.select(STATE) if self.added is None else _over(self.added, won))
        if self.added.count() * 4 > self.base.count():
            self.base, self.added = self.rounds.keep(self.all()), None


def _over(old: DataFrame, new: DataFrame) -> DataFrame:
    gone = new.select("b_shape_id").distinct()
    return old.join(gone, "b_shape_id", "left_anti").select(STATE).unionByName(new.select(STATE))


def _first_choice(options: DataFrame) -> DataFrame:
    """Each slot's first choice that is not an earlier anchor acting for itself."""
    live = options.where(~F.coalesce(F.col("anchor_rank") > F.col("b_anchor_rank"), F.lit(False)))
    return live.groupBy(*SLOT).agg(F.min(F.struct(*CHOICE)).alias("_next")).select(*SLOT, "_next.*")


def _settle(acting: DataFrame, edges: DataFrame, hot: DataFrame | None, cfg: Settings, rounds: Rounds) -> DataFrame:
    """Deferred acceptance: final choice of every anchor and dataset that gets one."""
    keys = ["a_shape_id", "b_dataset_id"]
    listed = edges if hot is None else edges.join(F.broadcast(hot), keys, "left_anti")
    prefs = rounds.keep(listed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*CHOICE))).alias("choices")))
    asks = rounds.keep(_first_choice(acting.join(edges, "a_shape_id")))
    held = _Held(rounds)
    while not asks.isEmpty():
        holders = held.of(asks, "block")
        active = rounds.keep(asks if holders is None else asks.unionByName(holders))
        # A block is settled in one task only if its slots, and the choices of each, are few.
        if hot is None:
            marked = active.withColumn("_hot", F.lit(0))
        else:
            marked = active.join(F.broadcast(hot.withColumn("_hot", F.lit(1))), keys, "left")
        sizes = marked.groupBy("block").agg(
            (F.coalesce(F.max("_hot"), F.lit(0)) * cfg.hot_rows + F.count(F.lit(1))).alias("_n"))
        sized = active.join(sizes, "block")
        small = sized.where(F.col("_n") <= cfg.hot_rows).join(prefs, keys)
        left = F.filter("choices", lambda c: c["pos"] >= F.col("pos"))
        done = rounds.keep(small.select(*SLOT, "block", left.alias("choices")).groupBy("block").applyInPandas(
            _settle_block, T.StructType([*active.schema.fields, T.StructField("outcome", T.StringType())])))
        won, asks = done.where("outcome = 'held'").select(STATE), done.where("outcome = 'ask'").select(STATE)
        large = sized.where(F.col("_n") > cfg.hot_rows).select(STATE)
        if not large.isEmpty():
            judged = rounds.keep(_judged(large))
            held.replace(won.unionByName(judged.where(~F.col("_lost")).select(STATE)))
            asks = rounds.keep(asks.unionByName(_next_asks(judged.where(F.col("_lost")), edges, held)))
        else:
            held.replace(won)
    return held.all() if held.base is not None else asks


def _next_asks(rejected: DataFrame, edges: DataFrame, held: _Held) -> DataFrame:
    """The next choice of rejected slots that is not yet full of earlier anchors.

    Places only ever go to earlier anchors, so full choices can be passed over at once.
    """
    options = rejected.select(*SLOT, F.col("pos").alias("_pos")).join(
        edges.select("a_shape_id", "b_dataset_id", *CHOICE), ["a_shape_id", "b_dataset_id"]).where(
        F.col("pos") > F.col("_pos"))
    limit = held.of(options, "b_shape_id").groupBy("b_shape_id").agg(
        F.max("anchor_rank").alias("_worst"), F.count(F.lit(1)).alias("_n"), F.max("b_copies").alias("_c"))
    limit = limit.where(F.col("_n") >= F.col("_c")).select("b_shape_id", "_worst")
    return _first_choice(options.join(limit, "b_shape_id", "left").where(
        F.col("_worst").isNull() | (F.col("anchor_rank") < F.col("_worst"))))


def _phase(anchors: DataFrame, pool: DataFrame, many_sources: bool, cfg: Settings, encoder,
           rounds: Rounds) -> Phase:
    """Match ``anchors`` against ``pool``; with ``many_sources`` an anchor may be taken by another."""
    columns = match.match_columns(cfg)
    # A feature that is itself an anchor has its own place, whatever copies it has.
    solo = F.when(F.col("is_anchor"), F.col("feature_id")) if many_sources else F.lit(None).cast("string")
    own_rank = F.when(F.col("is_anchor"), F.col("rank")) if many_sources else F.lit(None).cast("long")
    near = pool.where(F.col("kind").isNotNull()).withColumns(
        {"ordinal": F.col("rank"), "solo": solo, "anchor_rank": own_rank})
    candidates = rounds.keep(grid.distinct_shapes(near, columns + ["solo"], ["anchor_rank"]))
    takers = anchors.withColumn("ordinal", F.col("rank"))
    a_shapes = rounds.keep(grid.distinct_shapes(takers.where(F.col("kind").isNotNull()), columns, []))
    wide = grid.has_oversize(candidates, cfg) or grid.has_oversize(a_shapes, cfg)
    pairs = match.distance_join(match.spatial_candidates(a_shapes, candidates, cfg, wide), cfg)
    scored = rounds.keep(match.score_pairs(pairs, cfg, encoder).select(
        "a_shape_id", "b_dataset_id", "b_shape_id", "b_copies", "b_anchor_rank", "b_ordinal", "b_feature_id",
        "b_xmin", "b_ymin", *match.SCORES))
    hot = rounds.keep(skew.hot_keys(scored, ["a_shape_id", "b_dataset_id"], cfg.hot_rows).drop("_pieces"))
    hot = None if hot.isEmpty() else hot
    edges = rounds.keep(preferences(scored, hot, cfg))
    members = rounds.keep(takers.select(F.col("feature_id").alias("anchor_id"), F.col("rank").alias("anchor_rank"),
                                        grid.shape_id(columns).alias("a_shape_id")))
    taken = None
    while True:
        acting, live = members, edges
        if taken is not None:
            acting = members.join(taken, "anchor_id", "left_anti")
            gone = taken.withColumnRenamed("anchor_id", "b_feature_id").withColumn("_gone", F.lit(True))
            live = edges.join(gone, "b_feature_id", "left").withColumn(
                "b_anchor_rank", F.when(F.col("_gone").isNull(), F.col("b_anchor_rank"))).drop("_gone")
        chosen = _settle(acting, live, hot, cfg, rounds)
        final = rounds.keep(chosen.select(*SLOT, "pos").join(edges, ["a_shape_id", "b_dataset_id", "pos"]))
        if not many_sources:
            break
        now = rounds.keep(final.join(members.select(F.col("anchor_id").alias("b_feature_id")), "b_feature_id",
                                     "left_semi").select(F.col("b_feature_id").alias("anchor_id"),
                                                         F.col("anchor_rank").alias("_by"))
                          .join(members, "anchor_id").where(F.col("_by") < F.col("anchor_rank")).select("anchor_id"))
        if taken is None:
            same = now.isEmpty()
        else:
            same = (now.join(taken, "anchor_id", "left_anti").isEmpty()
                    and taken.join(now, "anchor_id", "left_anti").isEmpty())
        if same:
            break
        taken = now
    return Phase(acting, _dealt(final, near, columns, rounds))


def _dealt(final: DataFrame, near: DataFrame, columns: list[str], rounds: Rounds) -> DataFrame:
    """Names the copy each accepted slot gets: the earliest anchor takes the earliest copy."""
    out = ["anchor_id", "anchor_rank", F.col("b_dataset_id").alias("dataset_id")]
    single = final.where(F.col("b_copies") == 1).select(*out, F.col("b_feature_id").alias("feature_id"), *match.SCORES)
    shared = final.where(F.col("b_copies") > 1)
    if shared.isEmpty():
        return single
    wanted = shared.select(F.col("b_shape_id").alias("shape_id")).distinct()
    copies = near.withColumn("shape_id", grid.shape_id(columns + ["solo"])).select("shape_id", "feature_id", "rank")
    copies = skew.running_position(copies.join(wanted, "shape_id", "left_semi"), ["shape_id"], "rank", "_place")
    placed = skew.running_position(shared, ["b_shape_id"], "anchor_rank", "_place")
    dealt = placed.join(copies.select(F.col("shape_id").alias("b_shape_id"), "_place", "feature_id"),
                        ["b_shape_id", "_place"])
    return single.unionByName(dealt.select(*out, "feature_id", *match.SCORES))


def exclusive_matching(features: DataFrame, datasets: DataFrame, cfg: Settings = DEFAULTS, encoder=None,
                       rounds: Rounds | None = None) -> tuple[DataFrame, DataFrame]:
    """``(groups, matches)``.

    Cadastral features anchor groups first; then every parcel that is still unused does, so no
    record is lost for want of a survey. A group exists even if its anchor has no match. An ``encoder``
    sees every distinct compared text once.
    """
    rounds = rounds or Rounds(features.sparkSession)
    # Only what matching reads; properties, and geometry where boxes do, stay behind.
    read = dict.fromkeys(["feature_id", "dataset_id", "source_type", "canonical_type", "ordinal", *match.match_columns(cfg)])
    ranked = rounds.keep(with_rank(features.select(*read), datasets))
    if encoder is not None:
        encoder = match.vectors(ranked, encoder, rounds)  # both phases read the same vectors
    first = ranked.withColumn("is_anchor", F.col("source_type") == "cadastral")
    sources = first.where("is_anchor").select("dataset_id").distinct().limit(2).count()
    one = _phase(first.where("is_anchor"), first, sources > 1, cfg, encoder, rounds)
    matches1 = rounds.keep(one.matches)
    used = one.anchors.select(F.col("anchor_id").alias("feature_id")).unionByName(matches1.select("feature_id"))
    rest = rounds.keep(ranked.join(used, "feature_id", "left_anti").withColumn(
        "is_anchor", F.col("canonical_type") == "parcel"))
    sources = rest.where("is_anchor").select("dataset_id").distinct().limit(2).count()
    groups = one.anchors.withColumn("phase", F.lit(1))
    matches = matches1
    if sources:
        two = _phase(rest.where("is_anchor"), rest, sources > 1, cfg, encoder, rounds)
        groups = groups.unionByName(two.anchors.withColumn("phase", F.lit(2)))
        matches = matches.unionByName(two.matches)
    numbered = match.group_numbering(groups, ["phase", "anchor_rank"]).select(
        "matched_group_id", "group_number", "anchor_id", "anchor_rank", "phase")
    return numbered, matches.drop("anchor_rank").join(
        numbered.select("matched_group_id", "anchor_id"), "anchor_id").select(
        "matched_group_id", "anchor_id", "feature_id", "dataset_id", *match.SCORES)


def group_members(groups: DataFrame, matches: DataFrame, features: DataFrame) -> DataFrame:
    """Each group's anchor (``member_rank`` 0) and matches, best first, with feature columns."""
    order = Window.partitionBy("matched_group_id").orderBy(F.desc("overall_confidence"), "dataset_id", "feature_id")
    matched = matches.withColumn("member_rank", F.row_number().over(order)).select(
        "matched_group_id", "feature_id", "member_rank", *match.SCORES)
    anchors = groups.select("matched_group_id", F.col("anchor_id").alias("feature_id"), F.lit(0).alias("member_rank"),
                            *[F.lit(None).cast("double").alias(s) for s in match.SCORES])
    return anchors.unionByName(matched).join(features, "feature_id")
