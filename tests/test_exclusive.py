"""Parallel one-to-one matching against the sequential loop it stands for."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from landrecon.operators import exclusive, grid, match
from tests.shapes import PLANE, datasets, layer


def sequential(features, dsets, cfg):
    """Anchors one after another, each taking its best unused candidate per dataset."""
    ranked = exclusive.with_rank(features, dsets).withColumn("ordinal", F.col("rank"))
    pairs = match.distance_join(match.spatial_candidates(ranked, ranked, cfg), cfg)
    scored = match.score_pairs(pairs, cfg).select("a_feature_id", "b_feature_id", "b_dataset_id", "overall_confidence").collect()
    rows = ranked.withColumn("shape", grid.shape_id(match.match_columns(cfg))).select(
        "feature_id", "dataset_id", "source_type", "canonical_type", "rank", "shape").collect()
    rank = {r.feature_id: r.rank for r in rows}
    options = {}
    for p in scored:
        options.setdefault(p.a_feature_id, []).append(p)
    used, groups, matches = set(), [], set()

    def run(anchors):
        many = len({a.dataset_id for a in anchors}) > 1
        ids = {a.feature_id for a in anchors}
        first = {}
        for r in sorted(rows, key=lambda r: r.rank):
            if r.feature_id not in start:
                first.setdefault((r.shape, r.feature_id if many and r.feature_id in ids else None), r.rank)
        shape = {r.feature_id: first.get((r.shape, r.feature_id if many and r.feature_id in ids else None)) for r in rows}
        for a in sorted(anchors, key=lambda r: r.rank):
            if a.feature_id in used:
                continue
            used.add(a.feature_id)
            groups.append(a.feature_id)
            seen = {a.dataset_id}
            usable = [p for p in options.get(a.feature_id, []) if p.b_feature_id not in start]
            for p in sorted(usable, key=lambda p: (-p.overall_confidence, shape[p.b_feature_id], rank[p.b_feature_id])):
                if p.b_dataset_id in seen or p.b_feature_id in used:
                    continue
                seen.add(p.b_dataset_id)
                used.add(p.b_feature_id)
                matches.add((a.feature_id, p.b_feature_id))

    start = set()
    run([r for r in rows if r.source_type == "cadastral"])
    start = set(used)
    run([r for r in rows if r.canonical_type == "parcel" and r.feature_id not in used])
    return groups, matches


def random_layer(spark, seed):
    rnd = random.Random(seed)
    rows, step = [], 0.0004
    sources = [("cadastral", "parcel", "a"), ("cadastral", "parcel", "b"), ("revenue", "parcel", "r"),
               ("land_use", "parcel", "l"), ("municipal", "building", "m"), ("gnss", "gnss_point", "g")]
    for source, canonical, tag in sources:
        if tag == "b" and seed % 2:
            continue
        for i in range(rnd.randint(8, 16)):
            x, y = 74.2 + rnd.randint(0, 4) * step, 16.7 + rnd.randint(0, 4) * step
            size = 0 if source == "gnss" else step * rnd.choice([0.8, 1.0, 1.2])
            kind = "Point" if source == "gnss" else "Polygon"
            key = rnd.choice(["P-1", "P-2", "P-3"]) if source != "gnss" else None
            rows.append((f"{tag}@{i}", source, canonical, i, kind, x, y, x + size, y + size,
                         rnd.choice(["ann", "bob"]) if key else None, rnd.choice(["farm", "home"]) if key else None, key))
    return layer(spark, rows)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("hot_rows", [50_000, 3])
def test_matches_the_sequential_rule(spark, seed, hot_rows):
    features = random_layer(spark, seed)
    cfg = replace(PLANE, hot_rows=hot_rows, cell_deg=0.0008)
    dsets = datasets(features)
    want_groups, want = sequential(features, dsets, replace(cfg, hot_rows=50_000))
    groups, matches = exclusive.exclusive_matching(features, dsets, cfg)
    got = {(r.anchor_id, r.feature_id) for r in matches.collect()}
    assert [r.anchor_id for r in groups.orderBy("group_number").collect()] == want_groups
    assert got == want
    assert len({f for _, f in got}) == len(got)


def test_copies_are_dealt_in_order(spark):
    box = (74.2, 16.7, 74.2006, 16.7006)
    rows = [(f"c@{i}", "cadastral", "parcel", i, "Polygon", *box, "ann", "farm", "P-1") for i in range(5)]
    rows += [(f"r@{i}", "revenue", "parcel", i, "Polygon", *box, "ann", "farm", "P-1") for i in range(3)]
    features = layer(spark, rows)
    for hot_rows in (50_000, 2):
        groups, matches = exclusive.exclusive_matching(features, datasets(features), replace(PLANE, hot_rows=hot_rows))
        assert {(r.anchor_id, r.feature_id) for r in matches.collect()} == {(f"c@{i}", f"r@{i}") for i in range(3)}
        assert groups.count() == 5
