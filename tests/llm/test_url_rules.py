"""Association rules over URLs against mining by hand, on held-out labels, and at the edges."""

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from landrecon.llm import url_rules


def by_hand(rows, min_support, min_confidence, min_lift):
    """Every set of one or two tokens, counted in plain loops. ``rows`` of (tokens, verdict, site)."""
    sites = {s: [v for _, v, t in rows if t == s] for _, _, s in rows}
    share = {s: v.count("block") / len(v) for s, v in sites.items()}
    seen, said, blocked = Counter(), Counter(), Counter()
    for have, verdict, site in rows:
        for k in (1, 2):
            for c in map(frozenset, combinations(sorted(set(have)), k)):
                seen[c] += 1
                said[c, verdict] += 1
                blocked[c] += share[site]
    rules = {}
    for (c, verdict), freq in sorted(said.items(), key=lambda i: len(i[0][0])):
        expected = blocked[c] if verdict == "block" else seen[c] - blocked[c]
        alone = expected >= seen[c] - 1e-6
        if freq >= min_support * len(rows) - 1e-9 and freq / seen[c] >= min_confidence and (alone or freq >= min_lift * expected - 1e-6):
            rules[c, verdict] = freq / seen[c]
    return {k: v for k, v in rules.items()
            if len(k[0]) == 1 or not any(rules.get((frozenset([t]), k[1]), -1) >= v for t in k[0])}


def some_rows(seed, longest):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    rows = []
    for _ in range(300):
        have = rng.sample(words, rng.randint(0, longest))
        bad = "w1" in have or ("w2" in have and "w3" in have) or rng.random() < 0.15
        rows.append((have, "block" if bad else "allow", rng.choice(["s", "t", "u"])))
    return rows + [(["v1", "v2"], "block", "one")] * 5


@pytest.mark.parametrize("seed,longest", [(1, 5), (2, 12), (3, 28)])
def test_rules_equal_mining_by_hand(spark, seed, longest):
    rows = some_rows(seed, longest)
    got = url_rules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string, site string"), 0.02, 0.8, 1.1)
    assert {(r.tokens, r.verdict): pytest.approx(r.confidence) for r in got} == by_hand(rows, 0.02, 0.8, 1.1) and got


def test_every_part_of_a_url_is_a_token(spark):
    url = "http://m.adult-x.Example.org/en/top_list-77/9.html?page=2&ref=x#top"
    df = spark.createDataFrame([(url,), ("no url",), (None,), ("a://b",)], "url string")
    host, path = url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))
    got = [set(r[0]) for r in df.select(url_rules.tokens(F.coalesce("url", F.lit("")), host, path)).collect()]
    assert got[0] == {"host m", "host adult-x", "host example", "host org", "site example.org", "word adult", "word x", "path en",
                      "path top_list-0", "path 0.html", "word top", "word list", "word 0", "word html", "query page", "query ref", "fragment"}
    assert got[1:] == [set(), set(), {"host b", "site b"}]


def test_a_middle_label_decides(spark):
    """A label that blocked hosts share decides on hosts the prefix rules do not fit, whatever else these have."""
    rng = random.Random(5)
    urls = [f"http://blog.adult-x.example.net/{rng.choice(['es', 'fr'])}/{i}" for i in range(6)]
    urls += [f"http://{rng.choice(['m', 'www', 'blog'])}.w{i % 40}.example.com/{rng.choice(['de', 'en', 'fr'])}/{i}" for i in range(900)]
    new = [f"http://m.adult-x.example.org/de/{i}" for i in range(4)] + [f"http://m.w{i}.example.org/de/{i}" for i in range(4)]
    pages = spark.createDataFrame(list(enumerate(urls + new)), "page_id long, url string")
    rows = {r.page_id: r for r in url_rules.judge(pages).collect()}
    assert [rows[len(urls) + i].verdict for i in range(8)] == ["block"] * 4 + ["allow"] * 4
    assert "adult" in rows[len(urls)].mined or "word x" in rows[len(urls)].mined


def test_held_out_labels(spark):
    """Rules mined from half of the hosts give the verdict of prefix rules on the other half."""
    rng, hosts = random.Random(6), [f"h{i}" for i in range(60)]
    pages = [f"http://{h}.{z}/{rng.choice(['es', 'de', 'fr'])}/{rng.randint(0, 99)}" for h in hosts for z in ("net", "com") for _ in range(6)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(pages)], "page_id long, url string")
    host, path = url_rules.host_of(F.col("url")), url_rules.path_of(F.col("url"))
    name, verdict = url_rules.fitting_rule(host, path)
    rows = [r for r in df.select(url_rules.tokens(F.col("url"), host, path).alias("tokens"), verdict.alias("verdict"), host.alias("site")).collect() if r.verdict]
    known = [r for r in rows if int(r.site[1:].split(".")[0]) % 2]
    held = [r for r in rows if not int(r.site[1:].split(".")[0]) % 2]
    index = url_rules.index_of(url_rules.mine(spark.createDataFrame(known)))
    right = [(url_rules.best(frozenset(r.tokens), index) or r).verdict == r.verdict for r in held]
    found = [url_rules.best(frozenset(r.tokens), index) is not None for r in held]
    assert sum(found) / len(held) > 0.95 and sum(right) / len(held) > 0.95


def test_edges(spark):
    long = "http://x.example.net/es/" + "/".join(f"part-{i}_{'z' * (i % 9)}" for i in range(3000))
    urls = [long, long, None, "", "no url"] + ["http://a.com/x"] * 30
    pages = spark.createDataFrame([(i, u, "c", 1) for i, u in enumerate(urls)] + [(None, None, None, None)],
                                  "page_id long, url string, verdict string, base int")
    rows = url_rules.judge(pages, min_support=0.05, min_rows=1).collect()
    assert len(rows) == len(urls) + 1 and [r.verdict for r in rows if r.page_id in (0, 1)] == ["block"] * 2
    assert all(r.host == r.path == "" for r in rows if r.page_id in (2, 3, 4, None))
    ties = [(["a", "b"], v, "s") for v in ("allow", "block")] * 10
    assert url_rules.mine(spark.createDataFrame(ties, "tokens array<string>, verdict string, site string")) == []
    assert url_rules.mine(spark.createDataFrame([], "tokens array<string>, verdict string, site string")) == []
