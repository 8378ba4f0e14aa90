import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from landrecon.llm import ranked_search as rs

PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return PATTERN.findall((text or "").translate(LOWER))


def plain(rows, items, k=10):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    n, total = sum(bool(c) for _, c in docs), sum(c.total() for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    found = []
    for item, text in items:
        scores = []
        for doc, c in docs:
            m = 25 + 75 * c.total() * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in terms(text) if c[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        found += [(item, i + 1, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(found, key=str)


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "item_id long, text string, score int, query string")


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def topics(rng, n):
    """Texts of several topics with shared common words, ties and repeated rows."""
    rows = []
    for i in range(n):
        topic = rng.randrange(12)
        words = [rng.choice(["the", "of", "and", "The"]) if rng.random() < 0.4 else f"t{topic}w{min(rng.randrange(60), rng.randrange(60))}"
                 for _ in range(rng.randrange(3, 60))]
        rows.append((i, " ".join(words)))
    return rows + rows[:5] + [(n + i, rows[7][1]) for i in range(15)]


@pytest.mark.parametrize("rows_of, terms_of, block", [(2048, 4096, 128), (100, 25, 8)])
def test_same_as_every_score(docs, items, odd, monkeypatch, rows_of, terms_of, block):
    monkeypatch.setattr(rs, "SHARD_ROWS", rows_of)
    monkeypatch.setattr(rs, "TERMS", terms_of)
    monkeypatch.setattr(rs, "BLOCK", block)
    monkeypatch.setattr(rs, "SHORT", block // 4)
    rng = random.Random(4)
    rows = topics(rng, 400) + [(None if i is None else 1000 + i, t) for i, t in odd]
    asked = [(i, rows[rng.randrange(400)][1]) for i in range(12)] + [
        (20, None), (21, ""), (22, "nowhere"), (23, "WORD 日本語 a a B"), (24, "no id"), (24, "no id"), (25, "the the of"), (None, "t1w1")]
    assert got(rs.ranked(docs(rows), items(asked))) == plain(rows, asked)


def test_empty_tables(docs, items):
    assert rs.ranked(docs([]), items([(1, "a")])).count() == 0
    assert rs.ranked(docs([(1, None), (2, " . ")]), items([(1, "a")])).count() == 0
    assert rs.ranked(docs([(1, "a")]), items([])).count() == 0


def test_clashing_columns(docs, items):
    rows = docs([(1, "a b"), (2, "a")]).withColumn("query", F.lit(1)).withColumn("terms", F.lit(2)).withColumn("rank", F.lit(3))
    assert {r.doc_id for r in rs.ranked(rows, items([(1, "a b")])).collect()} == {1, 2}


def test_blocks_are_skipped_and_bounds_hold():
    """Of many documents few are scored, each bound covers its documents, and the ten best are those of a full scoring."""
    rng = random.Random(5)
    rows = [(i, t) for i, t in topics(rng, 1500)]
    counts = [Counter(terms(t)) for _, t in rows]
    words = sorted({t for c in counts for t in c})
    stats = rs.Statistics(len(rows), sum(c.total() for c in counts), dict(Counter(t for c in counts for t in c)))
    weights = np.array([stats.weight(t) for t in words], np.int64)
    made = rs.build_shard(rows, {t.encode(): i for i, t in enumerate(words)}, weights, stats)
    shard = rs.Shard(made, len(words))
    scored = 0
    for _, text in rows[:30]:
        asked = Counter(terms(text))
        places = np.array([words.index(t) for t in asked])
        of = np.array([weights[words.index(t)] * n for t, n in asked.items()])
        whole = of @ shard.parts[places]
        for b in np.flatnonzero(shard.rows >= 0):
            members = shard.members[shard.blocks[b] : shard.blocks[b + 1]]
            assert shard.summaries[shard.rows[b], places].astype(np.int64) @ of * rs.STEP >= whole[members].max()
        top, best = rs.Top(10), rs.Top(10)
        scored += shard.search(places, of, top)
        best.add(whole, shard.ids)
        assert top.ids.tolist() == best.ids.tolist() and top.scores.tolist() == best.scores.tolist()
    assert scored < 0.8 * 30 * len(rows), scored


def test_long_text_in_pieces():
    text = "Ab é-" * 50000
    assert rs.term_counts(text, 1000) == rs.term_counts(text) == Counter({b"ab": 50000, "é".encode(): 50000})
