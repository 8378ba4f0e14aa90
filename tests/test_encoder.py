"""Text vectors: every distinct text is encoded once, and the blended score equals the plain computation."""

from dataclasses import replace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from landrecon.operators import exclusive, match
from tests.shapes import PLANE, datasets, layer

USES = ["residential", "farm land", "shop", None]


def vector_maker():
    """A nested function, which travels to the workers by value."""
    def make(text):
        counts = [sum(c in part for c in text) + 0.0 for part in ("aeiou", "bcdfghjkl", "mnpqrst", "vwxyz ")]
        norm = sum(c * c for c in counts) ** 0.5
        return [c / norm for c in counts] if norm else None

    return make


plain_vector = vector_maker()


def counting(spark, shift=0):
    """An encoder and the accumulator of the rows it has seen; null where no vector exists."""
    seen, make = spark.sparkContext.accumulator(0), vector_maker()

    @F.pandas_udf("array<double>")
    def encode(texts: pd.Series) -> pd.Series:
        seen.add(len(texts))
        made = [make(t) for t in texts]
        return pd.Series([v and v[shift:] + v[:shift] for v in made])

    return encode, seen


def town(spark):
    rows = []
    for i in range(24):
        x = i * 0.0004
        box = (x, 0.0, x + 0.0003, 0.0003)
        rows.append((f"c{i}", "cadastral", "parcel", i, "Polygon", *box, f"owner {i % 5}", USES[i % 4], f"P-{i}"))
        rows.append((f"r{i}", "revenue", "parcel", i, "Polygon", *box, f"Owner {i % 7}" if i % 6 else "12", USES[(i + 1) % 4], f"P-{i}"))
    return match.canonical_columns(layer(spark, rows), {
        "owner_name": F.col("properties")["owner"], "land_use": F.col("properties")["land_use"],
        "parcel_id": F.col("properties")["parcel_id"], "survey_number": F.lit(None), "address": F.lit(None)})


def texts_of(features):
    found = set()
    for r in features.collect():
        found |= {r["cmp_" + f] for f in match.ENCODED_FIELDS}
    return found - {None}


@pytest.mark.parametrize("ratio", ["equality", "ratcliff"])
@pytest.mark.parametrize("roles", [1, 2])
def test_blend_equals_plain(spark, ratio, roles):
    from difflib import SequenceMatcher

    cfg, features = replace(PLANE, text_ratio=ratio), town(spark)
    (first, seen), (second, seen_second) = counting(spark), counting(spark, 1)
    pairs = match.distance_join(match.spatial_candidates(
        features.where("source_type = 'cadastral'"), features.where("source_type = 'revenue'"), cfg), cfg)
    got = match.score_pairs(pairs, cfg, (first, second) if roles == 2 else first, keep_all=True).collect()
    assert len(got) > 24
    for r in got:
        scores = []
        for f in ("owner_name", "land_use", "parcel_id"):
            a, b = r["a_cmp_" + f], r["b_cmp_" + f]
            if a is None or b is None:
                continue
            score = float(a == b) if ratio == "equality" else SequenceMatcher(None, a, b).ratio()
            if f != "parcel_id":
                u, v = plain_vector(a), plain_vector(b)
                v = v and v[roles - 1:] + v[:roles - 1]
                if u and v:
                    score = 0.65 * score + 0.35 * max(0.0, min(1.0, sum(x * y for x, y in zip(u, v))))
            scores.append(score)
        want = sum(scores) / len(scores) if scores else 0.5
        assert r["attribute_similarity"] == pytest.approx(100 * want, abs=0.0501)
    assert seen.value == len(texts_of(features))
    assert seen_second.value == (len(texts_of(features)) if roles == 2 else 0)


def test_both_phases_share_vectors(spark):
    features, (encoder, seen) = town(spark), counting(spark)
    groups, matches = exclusive.exclusive_matching(features, datasets(features), PLANE, encoder)
    assert groups.count() >= 24 and matches.count() > 0
    assert seen.value == len(texts_of(features))


def test_no_features(spark):
    features, (encoder, seen) = town(spark).limit(0), counting(spark)
    groups, matches = exclusive.exclusive_matching(features, datasets(features), PLANE, encoder)
    assert groups.count() == 0 and matches.count() == 0 and seen.value == 0
