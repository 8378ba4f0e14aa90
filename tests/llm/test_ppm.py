import math
import zlib
from collections import Counter

import pytest

from landrecon.llm import ppm

ORDER = 3


def plain(rows, order=ORDER):
    """The same scores, one byte at a time with sets of excluded symbols."""
    def split(t):
        return bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split()

    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    trie, words = {}, Counter()
    for (_, t), h in zip(rows, held):
        if h:
            continue
        words.update([*split(t), b"\n"])
        data = b"\n" * order + b" ".join(split(t)) + b"\n"
        for i in range(order, len(data)):
            for j in range(order + 1):
                node = trie.setdefault(data[i - j : i], Counter())
                node[data[i]] += 1
    n, v = sum(words.values()), len(words)
    out = []
    for (i, t), h in zip(rows, held):
        data, score = b"\n" * order + b" ".join(split(t)) + b"\n", 0.0
        for k in range(order, len(data)):
            excluded, p = set(), None
            for j in range(order, -1, -1):
                node = trie.get(data[k - j : k])
                if node is None:
                    continue
                left = {s: c for s, c in node.items() if s not in excluded}
                total = sum(left.values()) + len(left)
                if data[k] in left:
                    score += math.log10(left[data[k]] / total)
                    p = True
                    break
                if total:
                    score += math.log10(len(left) / total)
                excluded |= set(node)
            if not p:
                score -= math.log10(256 - len(excluded))
        tokens = [*split(t), b"\n"]
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens)
        out.append((i, h, len(tokens), sum(words[w] > 0 for w in tokens), n, base, score))
    return out


@pytest.mark.parametrize("model_rows,frequent", [(10**6, 1e-9), (0, 0.01)])
def test_scores(docs, odd, model_rows, frequent):
    rows = [(i, t if t is None or len(t) < 9000 else t[:600]) for i, t in odd] + [
        (20 + i, f"The cat number {i} sat on the mat and the mat was {'wet' * (i % 4)} Ünïcode") for i in range(25)]
    found = sorted((tuple(r) for r in ppm.scores(docs(rows), ORDER, model_rows, frequent).collect()), key=repr)
    expected = sorted(plain(rows), key=repr)
    assert len(found) == len(expected)
    key = lambda r: (repr(r[0]), r[2], round(r[6], 4))
    for a, b in zip(sorted(found, key=key), sorted(expected, key=key)):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_no_rows(docs):
    assert ppm.scores(docs([])).count() == 0

