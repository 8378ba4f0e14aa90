import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from landrecon.llm import simhash
from landrecon.llm.components import components
from landrecon.operators.rounds import Rounds


def plain_fingerprint(text):
    words = (text or "").encode()
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in words)
    for b in b"\t\n\r\x0b\x0c":
        words = words.replace(bytes([b]), b" ")
    words = [w for w in words.split(b" ") if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(values, radius=4):
    """Index of the first value reachable, for each."""
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(values))]


def test_fingerprints(docs, odd):
    found = {(r.doc_id, r.hex) for r in simhash.fingerprints(docs(odd)).select("doc_id", simhash.hexadecimal().alias("hex")).collect()}
    assert found == {(i, f"{plain_fingerprint(t):016x}") for i, t in odd}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("chunk", [4096, 8])
def test_links_are_all_found(spark, monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(3)
    values = []
    for _ in range(12):
        middle = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 40])):
            bits = rng.sample(range(64), rng.choice([0, 1, 2, 3, 4, 5, 7]))
            values.append(middle ^ sum(1 << b for b in bits))
    values += [0, 1, 1 << 63, 0xF, 0xF0, 0xFF << 28, 0b11 << 31]
    values = sorted(set(values), key=signed)
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = {r.fp: r.root for r in simhash.linked(Rounds(spark), df).collect()}
    roots = plain_components(values)
    classes = {}
    for v, r in zip(values, roots):
        classes.setdefault(r, set()).add(signed(v))
    got = {}
    for v, r in found.items():
        got.setdefault(r, set()).add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, classes.values()))


def test_documents(docs, odd):
    rows = odd + [(100 + i, " ".join(f"w{j}" for j in range(200)) + f" end{i % 3}") for i in range(9)]
    found = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs(rows)).collect()}
    values = [plain_fingerprint(t) for _, t in rows]
    roots = plain_components(values)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    assert found == {(i, least.get(r)) for (i, _), r in zip(rows, roots)}
    assert simhash.near_duplicates(docs([])).count() == 0


def test_components(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 60, (35, 2))] + [(i, i + 1) for i in range(100, 140)] + [(7, 7), (None, 3)]
    found = {r.node: r.component for r in components(Rounds(spark), spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in pairs:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert found == {i: find(i) for i in list(root)}
