"""Large groups of near copies enter the segment balls as one node; what is beside them is searched among all their sets."""

import random

import numpy as np

from landrecon.llm import simhash
from test_near_stage import edited, kept_of


def copies(rng, n, share):
    words = [f"w{rng.randrange(3000)}" for _ in range(150)]
    return words, [" ".join(edited(rng, words, share, True)) for _ in range(n)]


def test_members_of_a_large_group_are_one_row_a_band(spark, docs, monkeypatch):
    rng, seen, bands = random.Random(3), [], simhash._bands
    _, texts = copies(rng, 80, 0.03)
    monkeypatch.setattr(simhash, "_bands", lambda nodes: seen.append(bands(nodes).count()) or bands(nodes))
    assert simhash.keep_one(docs(list(enumerate(texts)))).count() == len(kept_of(list(enumerate(texts))))
    assert seen[0] < 80 * 10  # about 200 a member without the hub


def test_kept_rows_beside_hubs(docs, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)  # hubs and what is beside them fall in several parts
    rng = random.Random(8)
    words, texts = copies(rng, 60, 0.02)
    texts += [" ".join(edited(rng, words, share, True)) for share in (0.06, 0.08, 0.1, 0.15, 0.2, 0.3) for _ in range(6)]
    other, more = copies(rng, 40, 0.02)
    texts += more + [" ".join(edited(rng, other, share, False)) for share in (0.01, 0.02, 0.05) for _ in range(6)]
    rows = list(enumerate(texts))
    assert {r.doc_id for r in simhash.keep_one(docs(rows)).collect()} == kept_of(rows)


def test_links_of_a_hub():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.choice(400, 300)) for _ in range(30)] + [np.zeros(0, np.int64), np.arange(900, 950)]
    labels = np.array([7] * 12 + list(range(100, 120)))
    plain = {(7, int(labels[j])) for j in range(12, 32) for i in range(12)
             if len(np.intersect1d(sets[i], sets[j])) >= 0.4 * len(np.union1d(sets[i], sets[j]))}
    assert set(simhash.near_hub(sets, labels, 0.4, 7)) == plain and 0 < len(plain) < 20
    assert simhash.near_hub(sets, labels, 0.4, 5) == []
