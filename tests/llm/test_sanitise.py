import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from landrecon.llm import sanitise

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
            r"\+[0-9][\x20().0-9-]+[0-9]"]
WORD = re.compile(r"[^\W\d_]{3,}")


def digits(t):
    return [int(c) for c in t if c.isdigit()]


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0


def base(text):
    keep = [lambda m: True, lambda m: all(int(p) <= 255 for p in m.split(".")),
            lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m)), lambda m: 8 <= len(digits(m)) <= 15]
    return [(k, *m.span()) for k in range(4) for m in re.finditer(PATTERNS[k], text) if keep[k](m.group())]


@settings(deadline=None, max_examples=400)
@given(st.text(alphabet="a1+@. -(9é", max_size=60))
def test_base_spans_of_any_text(text):
    assert sanitise.base_spans(text) == base(text)


def card(rng):
    d = [rng.randrange(10) for _ in range(15)]
    return next("".join(map(str, d + [x])) for x in range(10) if luhn(d + [x]))


def blank(text, spans):
    chars = list(text)
    for _, a, b in spans:
        chars[a:b] = " " * (b - a)
    return "".join(chars)


def plain_terms(texts, reach=120, support=3, threshold=0.9):
    """word -> (general, share), counted document by document."""
    n, of_word, of_entity, together, seen = len(texts), Counter(), Counter(), Counter(), defaultdict(set)
    for text in texts:
        spans = base(text)
        clear = blank(text, spans)
        of_word.update({w.lower() for w in WORD.findall(clear)})
        near = defaultdict(set)
        for k, a, b in spans:
            value = text[a:b].lower() if k == 0 else text[a:b] if k == 1 else str(digits(text[a:b]))
            near[k, value] |= {m.group().lower() for m in WORD.finditer(clear) if m.start() >= a - reach and m.end() <= b + reach}
        for e, words in near.items():
            of_entity[e] += 1
            for w in words:
                together[e, w] += 1
                seen[e, w].add(frozenset(words))
    share = lambda of, both, e: 1 - math.log(min(of, n) / both) / math.log(n / of_entity[e]) if of_entity[e] < n else 0
    strong = defaultdict(dict)
    for (e, w), both in together.items():
        if len(seen[e, w]) >= support and (s := share(of_word[w], both, e)) >= threshold - 1e-12:
            strong[w][e] = s
    found = {}
    for w, of in strong.items():
        general = None
        for k in range(3, len(w)):
            start = [x for x in of_word if x.startswith(w[:k]) and len(x) > k]
            if all(share(sum(of_word[x] for x in start), sum(together[e, x] for x in start), e) < threshold - 1e-12 for e in of):
                general = w[:k]
        found[w] = (general, max(of.values()))
    return found


def corpus(rng, n=300):
    common = [f"{a}{b}{c}" for a in "bcd" for b in ("an", "en", "or") for c in ("tel", "ser", "lin", "mo")]
    told = ["zebulon", "quixotic", "bantelope", "bantella"]
    rows = []
    for i in range(n):
        words = [rng.choice(common) for _ in range(rng.randrange(5, 60))]
        if i % 10 == 0:
            at = rng.randrange(len(words))
            words[at:at] = [told[(i // 10) % 4], "Zebulon", "mail", "Jane.Doe@mail.example.org", "quixotic" if i % 20 else "x"]
        if i % 7 == 0:
            words += [rng.choice(["call", "phone"]), "+1 (555) 010-%04d" % rng.randrange(9999), card(rng), "10.0.0.%d" % rng.randrange(300)]
        rows.append((i, " ".join(words)))
    far = ["mail quixotic " + "filler " * 40 + "jane.doe@mail.example.org", "zebulon alone"]
    copies = ["obscureword uniquely jane2@mail.example.org stands"] * 40
    return rows + [(n + i, t) for i, t in enumerate(far + copies)]


def test_terms_and_spans(docs, odd):
    rows = corpus(random.Random(2)) + [(None if i is None else 1000 + i, t) for i, t in odd]
    texts = [t or "" for _, t in rows]
    expected = plain_terms(texts)
    assert "zebulon" in expected and "obscureword" not in expected and any(g for g, _ in expected.values()) and any(not g for g, _ in expected.values())
    got = {r.word: (r.general, pytest.approx(r.share)) for r in sanitise.disclosing(docs(rows)).collect()}
    assert {w: g for w, (g, _) in got.items()} == {w: g for w, (g, _) in expected.items()}
    assert {w: s for w, (_, s) in expected.items()} == {w: s for w, (_, s) in got.items()}
    lines = []
    for i, t in rows:
        spans = base(t or "")
        terms = [(4, *m.span()) for m in WORD.finditer(blank(t or "", spans)) if m.group().lower() in expected]
        say = lambda s: ",".join(f"{sanitise.KINDS[k]}:{a}:{b}" for k, a, b in s)
        lines.append((i, *[sum(s[0] == k for s in spans) for k in range(4)], hashlib.sha256(say(spans).encode()).hexdigest(), say(spans + terms)))
    report = sanitise.report(docs(rows)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    assert sorted(map(tuple, report.collect()), key=str) == sorted(lines, key=str)


def test_blocks_of_terms(docs, spark, monkeypatch):
    monkeypatch.setattr(sanitise, "BLOCK", 2)
    terms = spark.createDataFrame([(w, None) for w in ("one", "two", "three", "four", "five")], "word string, general string")
    (row,) = sanitise.marked(docs([(1, "One two three a@b.cd four FIVE fivefold")]), terms).collect()
    assert [(s.kind, s.start, s.end) for s in row.spans] == [(0, 14, 20), (4, 0, 3), (4, 4, 7), (4, 8, 13), (4, 21, 25), (4, 26, 30)]


def test_sanitised_text(docs):
    rows = corpus(random.Random(2))
    made = {r.doc_id: r.text for r in sanitise.sanitise(docs(rows)).collect()}
    expected = plain_terms([t for _, t in rows])
    assert len(made) == len(rows)
    for i, t in rows:
        assert not base(made[i]) and "zebulon" not in made[i].lower()
        if not base(t) and not any(w.lower() in expected for w in WORD.findall(t)):
            assert made[i] == t


def test_long_texts_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "a@" * 200_000, "1." * 200_000, "+1-" * 130_000, "1 " * 200_000, "a.b@c." * 60_000):
        sanitise.base_spans(text)
    assert sanitise.base_spans("1" * 5000 + ".1.1.1 0000.000255.1.2") == [(1, 5007, 5007 + len("0000.000255.1.2"))]


def test_empty_and_clashing(docs):
    assert sanitise.report(docs([])).count() == 0 and sanitise.sanitise(docs([])).count() == 0
    rows = docs([(1, None), (2, "x@y.zz"), (2, "x@y.zz")]).withColumn("spans", F.lit(1)).withColumn("word", F.lit("w")).withColumn("entity", F.lit(1))
    assert sorted((r.doc_id, r.n_email, r.spans) for r in sanitise.report(rows).collect()) == [(1, 0, ""), (2, 1, "email:0:6"), (2, 1, "email:0:6")]
