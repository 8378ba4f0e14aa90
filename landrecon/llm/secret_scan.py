"""Secret scans: patterns, and sliding-window Shannon entropy over candidate strings.

Patterns find assignments to secret-like names, access keys and long hexadecimal runs. The entropy
method takes every run of 20 or more key characters as a candidate, gives it a character class
(hexadecimal, with digits and letters, letters of both cases) and slides a window of ``WINDOW``
characters over it. The window keeps the count of each character and the sum of c * log2(c); a step
changes two counts. Windows whose entropy reaches the threshold of the class make a span. An
allow-list drops candidates that only look random. Everything is DataFrame and SQL functions.

Places are code points. All of it is computed for each row on its own, with no shuffle; a text
without any match costs one search for each pattern.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns, in the order in which kinds are listed: name, pattern, group to measure, least length of it.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),  # a run of 24 or more is found whole, shorter ones would be dropped
)
WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Character classes of candidates: pattern of the whole candidate and least entropy of a window, in bits.
CLASSES = (
    (r"[0-9a-fA-F]+", 3.0),
    (r"(?=.*[0-9])(?=.*[A-Za-z]).+", 3.7),
    (r"(?=.*[a-z])(?=.*[A-Z]).+", 4.0),
)
#: Not secrets, whatever their entropy: words and joined words, numbers, UUIDs, one pattern repeated. Repeated groups are
#: possessive: Java's regex then loops over them, where it would else recurse once for each part of a long candidate.
ALLOWED = (
    r"[A-Za-z]?[a-z]++(?:[-_/+=]++[A-Za-z]?[a-z]++)*+[-_/+=]*+", r"[A-Z]++(?:[-_/+=]++[A-Z]++)*+", r"[0-9+/_=-]+",
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", r"(.{1,8}?)\1+.{0,8}",
)


def _found(text: Column, pattern: str, group: int, least: int) -> Column:
    """Array of (start, end, match) of the matches whose group is long enough."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    measured = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.transform(F.split(text, pattern, -1), F.length)
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    rows = F.arrays_zip(between.alias("gap"), whole.alias("match"), measured.alias("measured"))
    placed = F.aggregate(
        F.slice(rows, 1, F.size(whole)),
        F.struct(F.lit(0).alias("at"), none.alias("found")),
        lambda a, r: F.struct(
            (a["at"] + r["gap"] + F.length(r["match"])).alias("at"),
            F.when(F.length(r["measured"]) >= least, F.concat(a["found"], F.array(F.struct(
                (a["at"] + r["gap"]).alias("start"), (a["at"] + r["gap"] + F.length(r["match"])).alias("end"),
                r["match"].alias("match"))))).otherwise(a["found"]).alias("found")),
        lambda a: a["found"])
    return F.when(text.rlike(pattern), placed).otherwise(none)


def _term(c: Column) -> Column:
    return F.when(c > 0, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def _hot(match: Column, threshold: Column) -> Column:
    """First and last end of the windows of a candidate whose entropy reaches the threshold; 0 and 0 if none does."""
    # What a step reads is in the array and in the state: a lambda would compute other expressions again for each character.
    chars = F.transform(F.split(match, "(?!^)"), lambda c: F.ascii(c))
    gone = F.concat(F.array_repeat(F.lit(-1), WINDOW), F.slice(chars, 1, F.length(match) - WINDOW))
    most = F.lit(WINDOW) * (F.lit(math.log2(WINDOW)) - threshold) + F.lit(1e-9)  # of the sum of c * log2(c)

    def step(a: Column, x: Column) -> Column:
        new, old, i = x["new"], x["old"], x["i"]
        more, less = a["counts"][new], F.when(old >= 0, a["counts"][F.greatest(old, F.lit(0))]).otherwise(F.lit(0))
        changed = F.when(old == new, a["total"]).otherwise(
            a["total"] + _term(more + 1) - _term(more) + F.when(old >= 0, _term(less - 1) - _term(less)).otherwise(F.lit(0.0)))
        hot = (i >= WINDOW) & (changed <= a["most"])
        return F.struct(
            F.transform(a["counts"], lambda c, k: c + (k == new).cast("int") - (k == old).cast("int")).alias("counts"),
            changed.alias("total"), a["most"].alias("most"),
            F.when(hot & (a["first"] == 0), i).otherwise(a["first"]).alias("first"),
            F.when(hot, i).otherwise(a["last"]).alias("last"))

    start = F.struct(F.array_repeat(F.lit(0), 128).alias("counts"), F.lit(0.0).alias("total"), most.alias("most"), F.lit(0).alias("first"),
                     F.lit(0).alias("last"))
    steps = F.arrays_zip(chars.alias("new"), gone.alias("old"), F.sequence(F.lit(1), F.length(match)).alias("i"))
    return F.aggregate(steps, start, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))


def _entropy(text: Column) -> Column:
    candidates = _found(text, CANDIDATE, 0, WINDOW)
    whole = lambda p: f"^(?:{p})$"
    threshold = lambda m: F.coalesce(*[F.when(m.rlike(whole(p)), F.lit(t)) for p, t in CLASSES])
    good = F.filter(candidates, lambda c: ~c["match"].rlike("|".join(whole(p) for p in ALLOWED[:-1]))
                    & ~c["match"].rlike(whole(ALLOWED[-1])) & threshold(c["match"]).isNotNull())
    measured = F.transform(good, lambda c: F.struct(c["start"].alias("start"), _hot(c["match"], threshold(c["match"])).alias("hot")))
    return F.transform(F.filter(measured, lambda c: c["hot"]["last"] > 0), lambda c: F.struct(
        (c["start"] + c["hot"]["first"] - WINDOW).alias("start"), (c["start"] + c["hot"]["last"]).alias("end")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and base, added (arrays of start, rank, kind, end) of each row's whole text.

    ``base`` has the pattern spans, ``added`` the entropy spans that overlap none of them. A null text
    counts as empty and has no spans; repeated rows stay.
    """
    text = F.coalesce("text", F.lit(""))
    def named(spans: Column, rank: int, kind: str) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"),
                                                     F.lit(kind).alias("kind"), s["end"].alias("end")))

    base = F.concat(*[named(_found(text, p, g, n), k, kind) for k, (kind, p, g, n) in enumerate(KINDS)])
    first = docs.select("doc_id", base.alias("base"), F.when(text.rlike(CANDIDATE), text).alias("_text"))
    extra = F.when(F.col("_text").isNotNull(), named(_entropy(F.col("_text")), len(KINDS), "entropy")).otherwise(
        F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>"))
    clear = F.filter(extra, lambda e: ~F.exists("base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    return first.select("doc_id", "base", clear.alias("added"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_entropy of each row."""
    found = scan(docs)
    count = lambda rank: F.size(F.filter("base", lambda b: b["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{kind}") for k, (kind, *_) in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_entropy"))
