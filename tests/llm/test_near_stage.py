"""The near-duplicate stage against all pairs by exact similarity, and the whole pipeline on a fixture."""

import random

import numpy as np
import pytest

from landrecon.llm import simhash


def plain_set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(rows, similarity=0.8):
    """Index of the first row that links reach, for each."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            union = len(a | sets[j])
            if a == sets[j] or (union and len(a & sets[j]) / union >= similarity):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(rows))]


def edited(rng, words, share, block):
    """Words with a share of them replaced, in one block or scattered."""
    out, n = list(words), max(1, int(len(words) * share))
    at = rng.randrange(len(words) - n) if block else 0
    for k in range(n):
        out[at + k if block else rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return out


def near_rows(rng, groups=8, copies=6):
    rows = []
    for _ in range(groups):
        words = [f"w{min(rng.randrange(3000), rng.randrange(3000))}" for _ in range(rng.randrange(120, 400))]
        rows.append(" ".join(words))
        for c in range(copies):
            rows.append(" ".join(edited(rng, words, rng.choice([0.005, 0.02, 0.03, 0.05] if c % 2 else [0.05, 0.1, 0.2, 0.3]), c % 2 == 0)))
    return [(10 + i, t) for i, t in enumerate(rows)]


def kept_of(rows):
    groups, least = plain_groups(rows), {}
    for (i, _), g in zip(rows, groups):
        least[g] = min(least.get(g, i), i)
    return set(least.values())


def ball(segment):
    """The values of a segment under every flip of its weakest bits."""
    found = {segment & (1 << simhash.SEGMENT_BITS) - 1}
    for k in range(simhash.WEAK):
        bit = 1 << (segment >> simhash.SEGMENT_BITS + 5 * k & 31)
        found |= {x ^ bit for x in found}
    return found


@pytest.mark.parametrize("pivots", [0, 2])
def test_one_of_each_group_stays(docs, monkeypatch, pivots):
    monkeypatch.setattr(simhash, "PIVOTS", pivots)
    rng = random.Random(6)
    rows = near_rows(rng) + [(900, None), (901, ""), (902, " "), (903, "only four words here"), (904, "only four words here")]
    chain = [f"c{i}" for i in range(200)]  # each like the one before, the ends unlike
    rows += [(950 + k, " ".join(chain[k * 12 :] + [f"d{i}" for i in range(k * 12)])) for k in range(10)]
    kept = {r.doc_id for r in simhash.keep_one(docs(rows)).collect()}
    assert kept == kept_of(rows)


def test_links_of_a_group_are_fewer_than_its_labels():
    rng = random.Random(2)
    sets = [np.unique(np.array(rng.sample(range(400), 300) if i % 3 else range(300), np.int64)) for i in range(60)]
    labels = np.array([i // 2 for i in range(60)])
    found = simhash.near_sets(sets, labels, 0.6)
    plain = {(int(labels[i]), int(labels[j])) for i in range(60) for j in range(60) if labels[i] != labels[j]
             and len(np.intersect1d(sets[i], sets[j])) >= 0.6 * len(np.union1d(sets[i], sets[j]))}

    def classes(pairs):
        root = list(range(30))
        for _ in range(30):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert len(found) < 30 and classes(found) == classes(plain)


@pytest.mark.parametrize("block", [False, True])
def test_alike_texts_meet_in_a_segment_ball(block):
    """Candidates come through SimHash segments: pairs at 0.8 to 0.86, by their own keys without any other path."""
    rng, met, near, n = random.Random(9), 0, 0, 0

    def keys(segments):
        out = set()
        for i, s in enumerate(segments):
            weak = [1 << (s >> (simhash.SEGMENT_BITS + 5 * k) & 31) for k in range(simhash.WEAK)]
            out |= {(i, (s & (1 << simhash.SEGMENT_BITS) - 1) ^ sum(w for j, w in enumerate(weak) if m >> j & 1)) for m in range(1 << simhash.WEAK)}
        return out

    while n < 300:
        words = [f"w{min(rng.randrange(3000), rng.randrange(3000))}" for _ in range(rng.randrange(150, 400))]
        a, b = (simhash.shingles(" ".join(w)) for w in (words, edited(rng, words, rng.uniform(0.05, 0.12) if block else 0.02, block)))
        share = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        if 0.8 <= share <= 0.86:
            (one, p), (two, q) = simhash.segments(a), simhash.segments(b)
            n, met = n + 1, met + bool(keys(one) & keys(two))
            near += sum((x ^ y).bit_count() if x ^ y >= 0 else ((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(p, q)) <= simhash.PRINT_RADIUS
    assert met >= 0.98 * n and near >= 0.99 * n


def test_pairs_just_above_the_bound_meet():
    """Of 2000 pairs at 0.8 to 0.82 all share a key; by segments alone some do not."""
    rng, apart, lost, n = random.Random(1), 0, 0, 0
    while n < 2000:
        words = [f"w{int(rng.paretovariate(0.8)) % 20000}" for _ in range(rng.randrange(150, 400))]
        a, b = (simhash.shingles(" ".join(w)) for w in (words, edited(rng, words, 0.023, False)))
        if 0.8 <= len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < 0.82:
            (one, _, least), (two, _, other) = simhash.sketch(a), simhash.sketch(b)
            met = any(ball(s) & ball(t) for s, t in zip(one.tolist(), two.tolist()))
            n, apart, lost = n + 1, apart + (not met), lost + (not met and not set(least.tolist()) & set(other.tolist()))
    assert apart >= 4 and not lost


CLASHES = ("cdf", "draws", "_rate", "_copies", "_copy", "_order", "_file", "_row", "score", "rate", "_source", "group", "a", "b", "digest")


def test_entries_of_one_file_are_made_in_many_tasks(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    rows = [(k, [int(x) for x in simhash.segments(rng.integers(0, 1 << 63, 40, np.uint64))[0]]) for k in range(64)]
    nodes = spark.createDataFrame(rows, "node long, segments array<long>").coalesce(1)
    made = simhash._entries(nodes, 16)
    per_task = made.groupBy(F.spark_partition_id().alias("t")).count().collect()
    every = simhash.SEGMENTS << simhash.WEAK
    assert sum(r["count"] for r in per_task) == 64 * every
    assert max(r["count"] for r in per_task) <= 16 * every
    plain = {(k, number << simhash.SEGMENT_BITS | bits) for k, own in rows for number, segment in enumerate(own) for bits in ball(segment)}
    assert {tuple(r) for r in made.collect()} == plain


def test_clashing_columns_stay(spark, docs):
    from pyspark.sql import functions as F

    from landrecon.llm import exact_dedup, mixing, toxicity

    rows = docs([(1, "one two three"), (2, "one two three"), (3, None), (4, "x" * 200_000), (4, "x" * 200_000)])
    rows = rows.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])
    labels = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    for made, n in ((simhash.keep_one(rows), 3), (exact_dedup.deduplicate(rows), 3), (toxicity.clean(rows, labels), 5), (mixing.mix(rows, epochs=3.0), None)):
        assert made.columns == rows.columns
        found = made.collect()
        assert n is None and found or len(found) == n
        assert all(r[c] == f"own {c}" for r in found for c in CLASHES)


def test_pipeline(spark, docs, tmp_path):
    """Toxic texts go, one of each class of copies and near copies stays, and every kept document is encoded whole."""
    import base64
    import hashlib

    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from landrecon.llm import mixing, toxicity

    rng = random.Random(11)
    rows = near_rows(rng, 4, 4) + [(500 + i, t) for i, t in enumerate(["same text of a few words"] * 5 + [None, ""])]
    rows += [(600 + i, f"you are a vile worthless idiot number{i} and i hate you " * 3) for i in range(30)]
    clean = [(700 + i, " ".join(f"calm{rng.randrange(900)}" for _ in range(40))) for i in range(60)]
    rows += clean
    docs(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 1 if 600 <= i < 700 else 0) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    table, labels = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("documents", "labels"))
    scores = {r.doc_id: r.score for r in toxicity.toxicity(table, labels).collect()}
    assert sum(scores[i] >= 0.5 for i in range(600, 630)) >= 28 and sum(scores[i] >= 0.5 for i, _ in clean) <= 1
    left = [(i, t) for i, t in rows if scores[i] < 0.5]
    last = {}
    for i, t in left:
        last[t or ""] = max(i, last.get(t or "", -1))
    left = [(i, t) for i, t in left if last[t or ""] == i]
    stay = kept_of(left)
    left = [(i, t) for i, t in left if i in stay]
    kept = spark.createDataFrame([(i, t, "en", "s") for i, t in left], "doc_id long, text string, lang string, source string")
    copies = sorted(r.doc_id for r in mixing.mix(kept, seed=5, temperature=0.5).collect())
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    say = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    texts = dict(left)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = next(c for c in out[0].asDict() if isinstance(out[0][c], list))
    assert sorted((r.doc_id, say(r[ids])) for r in out) == sorted((i, say(plain.encode_ordinary(texts[i] or ""))) for i in copies)
