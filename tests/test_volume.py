"""What steps move: digests are short, and ranks are given without moving features."""

from pyspark.sql import functions as F

from landrecon.operators import conflicts, exclusive, grid, match
from landrecon.operators.rounds import Rounds
from tests.shapes import PLANE, datasets, layer
from tests.test_exclusive import random_layer


def test_shape_digest_has_16_bytes(spark):
    found = random_layer(spark, 1).select(grid.shape_id(match.match_columns(PLANE)).alias("s"), *match.match_columns(PLANE))
    assert {r.n for r in found.select(F.octet_length("s").alias("n")).collect()} == {16}
    assert found.select("s").distinct().count() == found.drop("s").distinct().count()


def test_rank_moves_no_feature(spark):
    features = random_layer(spark, 1)
    order = [r.feature_id for r in exclusive.with_rank(features, datasets(features)).orderBy("rank").collect()]
    plan = exclusive.with_rank(features, datasets(features))._jdf.queryExecution().executedPlan().toString()
    assert "_block" not in plan and "SortMergeJoin" not in plan
    # Repeated places fall back to numbering: still unique, still in the order of datasets and places.
    twice = features.withColumn("ordinal", F.floor(F.col("ordinal") / 2).cast("long"))
    ranks = {r.feature_id: r["rank"] for r in exclusive.with_rank(twice, datasets(features)).collect()}
    assert len(set(ranks.values())) == len(ranks) == len(order)
    place = {r.feature_id: (r.dataset_id, r.ordinal) for r in twice.collect()}
    names = list(dict.fromkeys(place[f][0] for f in order))
    keyed = [(names.index(place[f][0]), place[f][1]) for f in sorted(ranks, key=ranks.get)]
    assert keyed == sorted(keyed)


def test_matching_keeps_only_what_it_reads(spark, monkeypatch):
    kept = []
    keep = Rounds.keep
    monkeypatch.setattr(Rounds, "keep", lambda self, df: kept.append(df.columns) or keep(self, df))
    features = random_layer(spark, 1).withColumn("extra", F.lit("long text"))
    exclusive.exclusive_matching(features, datasets(features), PLANE)
    assert kept and not any("extra" in columns for columns in kept)


def test_members_read_written_features(spark, sf):
    from landrecon.catalog.spatial import lens_members

    read = {f.rsplit("/", 1)[0].rsplit("/", 2)[1].split("-")[0] for f in lens_members(spark, sf).inputFiles()}
    assert read == {"tables"}  # no source table is read again for each reader of the features
