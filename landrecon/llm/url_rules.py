"""URL filters by association rules.

Prefix rules over host and path judge what they fit; those verdicts are the labels. Each URL is a set of tokens: every
label of its host, every segment of its path, the words in both, its site, the names of its query, whatever its length.
Spark's FP-growth mines the token sets of labelled URLs together with the label; sets of at most ``LENGTH`` tokens with a
label give rules "tokens -> verdict", counted once more over all labelled rows and pruned by support, confidence, lift
over what the sites of these rows say anyway, and by a shorter rule at least as sure. URLs that no prefix rule fits take
the verdict of the rule whose tokens they have and whose lift over all labelled rows is highest, found by an inverted
index over each rule's rarest token: a rare label that is always blocked goes before a common segment that mostly is.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landrecon.llm.frames import arrow_map, few, plain
from landrecon.operators.rounds import Rounds

#: (verdict, host, path): the host and its subdomains, paths that start so.
PREFIX_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
                ("block", "net", "/es/"), ("block", "net", "/fr/"))
MIN_SUPPORT = 0.002
MIN_ROWS = 5  # whatever the support: two rows that agree are chance
MIN_CONFIDENCE = 0.8
MIN_LIFT = 1.1
LENGTH = 2  # tokens of a rule; what is below relies on it
CHUNK = 6  # tokens; FP-growth sees at most two chunks of a URL at once
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)(.*)$"
_LABEL = "="


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, with A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def fitting_rule(host: Column, path: Column, rules=PREFIX_RULES) -> tuple[Column, Column]:
    """Name (host and path) and verdict of the longest rule that fits, else null. The rules are a short fixed list."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones, the longer, go first
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def site_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def tokens(url: Column, host: Column, path: Column) -> Column:
    """The parts of a URL as a set; runs of digits are 0. Of an empty host and path only query and fragment are left."""
    labels, segments = F.split(host, r"\."), F.split(F.regexp_replace(path, r"\d+", "0"), "/")
    rest = F.coalesce(F.regexp_extract(url, _URL, 3), F.lit(""))
    names = F.transform(F.split(F.regexp_extract(rest, r"(?s)^\?([^#]*)", 1), "&"), lambda q: F.substring_index(q, "=", 1))

    def words(of: Column) -> Column:
        return F.flatten(F.transform(of, lambda p: F.when(p.rlike("[-_.]"), F.split(p, "[-_.]+")).otherwise(F.array())))

    def named(kind: str, of: Column) -> Column:
        return F.transform(F.filter(of, lambda v: v != ""), lambda v: F.concat(F.lit(kind + " "), v))

    return F.array_distinct(F.concat(
        named("host", labels), named("site", F.array(site_of(host))), named("path", segments),
        named("word", F.concat(words(labels), words(segments))), named("query", names),
        F.when(F.contains(rest, F.lit("#")), F.array(F.lit("fragment"))).otherwise(F.array())))


@dataclass(frozen=True)
class Rule:
    tokens: frozenset[str]
    verdict: str
    confidence: float
    support: float
    lift: float


def transactions(labelled: DataFrame, least: int) -> DataFrame:
    """``items`` of each row of a written table of tokens and verdict, with the label, for FP-growth.

    A row of more than two chunks of tokens gives each pair of chunks of its tokens that occur in ``least`` rows, so that
    any two of them meet in some set; a set is counted more often then, never less.
    """
    label = F.concat(F.lit(_LABEL), F.col("verdict"))
    whole = labelled.where(F.size("tokens") <= 2 * CHUNK).select(F.concat("tokens", F.array(label)).alias("items"))
    # Ids follow from places in the written files, so a task that runs again makes the same.
    long = labelled.withColumn("id", F.monotonically_increasing_id()).where(F.size("tokens") > 2 * CHUNK)
    often = labelled.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= least)
    kept = long.select("id", label.alias("label"), F.explode("tokens").alias("token")).join(often.select("token"), "token", "left_semi")
    kept = kept.groupBy("id", "label").agg(F.array_sort(F.collect_list("token")).alias("tokens"))
    count = F.ceil(F.size("tokens") / CHUNK).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice("tokens", i * CHUNK + 1, F.lit(CHUNK)))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), count - 2), lambda i: F.transform(
        F.sequence(i + 1, count - 1), lambda j: F.concat(F.get(F.col("chunks"), i), F.get(F.col("chunks"), j)))))
    sets = F.when(count > 1, pairs).otherwise(F.col("chunks"))
    dealt = kept.withColumn("chunks", chunks).select("label", F.explode(sets).alias("tokens"))
    return whole.unionByName(dealt.select(F.concat("tokens", F.array("label")).alias("items")))


def with_base(labelled: DataFrame) -> DataFrame:
    """Adds ``base``, the share of blocked rows among those of the same ``site`` (of all rows without that column)."""
    labelled = labelled if "site" in labelled.columns else labelled.withColumn("site", F.lit(""))
    shares = labelled.groupBy("site").agg(F.avg((F.col("verdict") == "block").cast("double")).alias("base"))
    return labelled.join(few(shares), "site")


def recount(labelled: DataFrame, found: list[frozenset[str]], often: dict[frozenset[str], int]) -> DataFrame:
    """``number`` of each found set with rows, blocked rows and blocked rows expected from their sites, over all rows."""
    index: dict[str, list[tuple[str | None, int]]] = {}
    for number, have in enumerate(found):
        rare, *more = sorted(have, key=lambda t: (often.get(frozenset([t]), 0), t))
        index.setdefault(rare, []).append((more[0] if more else None, number))
    shared = labelled.sparkSession.sparkContext.broadcast(index)

    def step(batch: pa.RecordBatch) -> dict[str, list]:
        sums: dict[int, list[float]] = {}
        for have, verdict, base in zip(*(batch.column(c).to_pylist() for c in ("tokens", "verdict", "base"))):
            held = set(have)
            for t in held:
                for other, number in shared.value.get(t, ()):
                    if other is None or other in held:
                        s = sums.setdefault(number, [0, 0, 0.0])
                        s[0], s[1], s[2] = s[0] + 1, s[1] + (verdict == "block"), s[2] + base
        return {"number": list(sums), **{c: [s[i] for s in sums.values()] for i, c in enumerate(("n", "blocked", "expected"))}}

    each = arrow_map(labelled.select("tokens", "verdict", "base"), step, "number int, n long, blocked long, expected double")
    return each.groupBy("number").agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"), F.sum("expected").alias("expected"))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
         min_lift: float = MIN_LIFT, min_rows: int = MIN_ROWS) -> list[Rule]:
    """Rules from rows of tokens (array<string>), verdict (allow or block) and, if there is one, site.

    A rule holds in at least ``min_support`` of all rows and in ``min_rows``, and its verdict is at least ``min_lift`` times as frequent as the
    sites of its rows would have it; where all those sites have one verdict only, there is nothing to compare it with
    and it stays. Only sets of at most LENGTH tokens that reach the support come to the driver, so at most (mean square
    of the tokens of a row) / min_support, whatever the number of rows. No row, no rule.
    """
    rounds = Rounds(labelled.sparkSession)
    rows = rounds.keep(with_base(labelled).select("tokens", "verdict", "base"))
    n = rows.count()
    if not n:
        return []
    least = max(1, min_rows, ceil(min_support * n - 1e-9))
    items = rounds.keep(transactions(rows, least))
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / items.count(), minConfidence=0.0).fit(items)
    said = F.exists("items", lambda t: F.startswith(t, F.lit(_LABEL)))
    sets = rounds.keep(model.freqItemsets.where(F.size("items") <= F.when(said, LENGTH + 1).otherwise(1)))
    often = {frozenset(r["items"]): r["freq"] for r in sets.where(~said).collect()}
    bare = F.filter("items", lambda t: ~F.startswith(t, F.lit(_LABEL)))
    found = [frozenset(r["had"]) for r in sets.where(said).select(F.array_sort(bare).alias("had")).distinct().collect() if r["had"]]
    blocked = rows.where("verdict = 'block'").count()
    common = {"block": blocked / n, "allow": 1 - blocked / n}
    rules = []
    for r in recount(rows, found, often).collect():
        for verdict, freq, expected in (("block", r["blocked"], r["expected"]), ("allow", r["n"] - r["blocked"], r["n"] - r["expected"])):
            alone = expected >= r["n"] - 1e-6
            if freq >= least and freq / r["n"] >= min_confidence and (alone or freq >= min_lift * expected - 1e-6):
                rules.append(Rule(found[r["number"]], verdict, freq / r["n"], freq / n, freq / r["n"] / common[verdict]))
    kept: list[Rule] = []
    by_set: dict[tuple[frozenset, str], Rule] = {}
    for r in sorted(rules, key=lambda r: (len(r.tokens), sorted(r.tokens))):
        shorter = (by_set.get((frozenset([t]), r.verdict)) for t in r.tokens)
        if len(r.tokens) == 1 or not any(s is not None and s.confidence >= r.confidence for s in shorter):
            kept.append(r)
            by_set[r.tokens, r.verdict] = r
    return kept


def index_of(rules: list[Rule]) -> dict[str, list[Rule]]:
    """Rules under their rarest token, the best first."""
    often: dict[str, int] = {}
    for r in rules:
        for t in r.tokens:
            often[t] = often.get(t, 0) + 1
    index: dict[str, list[Rule]] = {}
    for r in sorted(rules, key=preference):
        index.setdefault(min(sorted(r.tokens), key=often.__getitem__), []).append(r)
    return index


def preference(r: Rule) -> tuple:
    """Best first: what says most beyond the share of its verdict in all rows, then the surest."""
    return (-r.lift, -r.confidence, -r.support, -len(r.tokens), sorted(r.tokens), r.verdict)


def best(have: frozenset[str], index: dict[str, list[Rule]]) -> Rule | None:
    firsts = (next((r for r in index.get(t, ()) if r.tokens <= have), None) for t in have)
    return min((r for r in firsts if r is not None), key=preference, default=None)


def judge(pages: DataFrame, rules=PREFIX_RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE,
          min_lift: float = MIN_LIFT, min_rows: int = MIN_ROWS) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the tokens of the association rule used) and confidence of each row.

    A null URL, or one without ://, has empty host and path and fits no prefix rule. Where no mined
    rule fits either, the verdict is the commoner one among labelled rows (allow without any). Repeated
    rows are judged alike and count as often as they occur. A URL of any length is one row with all its tokens.
    Between rules of equal lift the surer one decides, then the one with more support, the longer one, the first by name.
    """
    spark: SparkSession = pages.sparkSession
    url = F.col("url")
    parted = plain(pages, "page_id", "url").select("page_id", host_of(url).alias("host"), path_of(url).alias("path"),
                                                   tokens(F.coalesce(url, F.lit("")), host_of(url), path_of(url)).alias("tokens"))
    name, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = parted.select("*", name.alias("rule"), verdict.alias("label"))
    labelled = ruled.where("label is not null").select("tokens", F.col("label").alias("verdict"), site_of(F.col("host")).alias("site"))
    common = labelled.groupBy("verdict").count().orderBy(F.desc("count"), "verdict").first()
    default = common[0] if common else "allow"
    shared = spark.sparkContext.broadcast(index_of(mine(labelled, min_support, min_confidence, min_lift, min_rows)))

    def step(batch: pa.RecordBatch) -> dict[str, list]:
        index, out = shared.value, {c: batch.column(c).to_pylist() for c in ("page_id", "host", "path", "rule", "label")}
        out |= {"verdict": [], "mined": [], "confidence": []}
        for label, have in zip(out.pop("label"), batch.column("tokens").to_pylist()):
            r = best(frozenset(have), index) if label is None else None
            out["verdict"].append(label or (r.verdict if r else default))
            out["mined"].append(" & ".join(sorted(r.tokens)) if r else None)
            out["confidence"].append(r.confidence if r else None)
        return out

    return arrow_map(ruled, step, "page_id long, host string, path string, rule string, verdict string, mined string, confidence double")
