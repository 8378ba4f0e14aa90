"""Personal data, and the terms that give it away: information-theoretic sanitisation.

Spans of four kinds (email, ip, card, phone) are found by their patterns; each distinct value is a
protected entity. Corpus co-occurrence tells how strongly a term reveals an entity: of the information
-log(p(entity)), the pointwise mutual information log(p(term, entity) / (p(term) p(entity))) is
the share that the term discloses, 1 if the term never occurs but beside the entity. Probabilities are shares of
documents; a term occurs with an entity in a document if it stands at most ``reach`` characters from a
mention. A term that discloses ``threshold`` or more of an entity, in ``support`` or more different contexts of it,
is a span of the fifth kind wherever it occurs. When a text is sanitised such a term is generalised to
its longest beginning that stands for enough other words to disclose less, or removed if there is none.

Entities leave a task only as digests. Contexts are combined by digest before anything is spread to
words, so a value in any number of copies costs one row a task, and words are counted in the tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landrecon.llm.frames import arrow_schema, few, plain, slices, texts
from landrecon.operators.rounds import Rounds

#: The kinds in their order and their patterns (the local part of an email is found from its @).
KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\W\d_]{3,}")
_NO_DIGIT = re.compile("[^0-9]+")

REACH, SUPPORT, THRESHOLD = 120, 3, 0.9
#: Shortest beginning that a term is generalised to; words counted before a task sends them; terms that are broadcast at once.
LEAST_PREFIX, COUNTED, BLOCK = 3, 200_000, 200_000

Span = tuple[int, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Runs of local characters, an @ and a domain, leftmost first. Every character is looked at a fixed number of times."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = free + len(text[free:at].rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        free = at + 1
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", free)


def _octets(found: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in found.split("."))


def luhn(digits: str) -> bool:
    """Whether the check digit fits the digits before it."""
    doubled = (2 * int(d) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the personal data in a text, in code points, by kind and start."""
    found = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    if "." in text:
        found += [(1, *m.span()) for m in _IP.finditer(text) if _octets(m.group())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NO_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NO_DIGIT.sub("", m.group())) <= 15]
    return found


def masked(text: str, spans: list[Span]) -> str:
    """The text with its spans blanked, of the same length."""
    if not spans:
        return text
    pieces, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if b > at:
            pieces += [text[at : max(at, a)], " " * (b - max(at, a))]
            at = b
    return "".join([*pieces, text[at:]])


def entity(kind: int, value: str) -> bytes:
    """A digest of a protected value: emails without case, cards and phone numbers by their digits."""
    value = value.lower() if kind == 0 else value if kind == 1 else _NO_DIGIT.sub("", value)
    return hashlib.blake2b(f"{KINDS[kind]}:{value}".encode(), digest_size=16).digest()


def contexts(text: str, blank: str, spans: list[Span], reach: int) -> dict[bytes, set[str]]:
    """The words near the mentions of each entity of a text, whole ones only."""
    near: dict[bytes, set[str]] = {}
    for kind, a, b in spans:
        low, high = max(0, a - reach), min(len(blank), b + reach)
        while 0 < low < a and blank[low - 1].isalpha():
            low += 1
        while b < high < len(blank) and blank[high].isalpha():
            high -= 1
        words = near.setdefault(entity(kind, text[a:b]), set())
        words.update(w.lower() for w in _WORD.findall(blank, low, high))
    return near


_FOUND = "entity binary, context binary, words array<string>, word string, docs long"


def observed(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """What one reading of the texts finds: rows with an entity and its words in one document, rows with a word and the
    documents that hold it, and rows with neither for the number of documents."""
    out = arrow_schema(_FOUND)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        documents = 0
        for batch in batches:
            for part in slices(batch):
                near = []
                for text in texts(part):
                    spans = base_spans(text)
                    blank = masked(text, spans)
                    held.update({w.lower() for w in set(_WORD.findall(blank))})
                    documents += 1
                    for digest, words in contexts(text, blank, spans, reach).items():
                        ordered = sorted(words)
                        near.append((digest, hashlib.blake2b(" ".join(ordered).encode(), digest_size=16).digest(), ordered, None, 1))
                if near:
                    yield table(near)
                if len(held) > COUNTED:
                    yield table([(None, None, None, w, n) for w, n in held.items()])
                    held.clear()
        yield table([(None, None, None, None, documents), *((None, None, None, w, n) for w, n in held.items())])

    return plain(docs, "text").mapInArrow(run, _FOUND)


def disclosing(docs: DataFrame, reach: int = REACH, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """word, general, share: the terms that disclose too much of some entity, the beginning that stands for them
    (null: none discloses little enough) and the largest share."""
    rounds = Rounds(docs.sparkSession)
    found = rounds.keep(observed(docs, reach))
    documents = found.where("entity is null and word is null").agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    mentions = found.where("entity is not null").groupBy("entity", "context").agg(F.sum("docs").alias("docs"), F.first("words").alias("words"))
    mentions = rounds.keep(mentions)
    whole = rounds.keep(mentions.groupBy("entity").agg(F.sum("docs").alias("of_entity"), F.count(F.lit(1)).alias("contexts"))
                        .where(F.col("contexts") >= support).drop("contexts"))
    pairs = rounds.keep(mentions.select("entity", F.explode("words").alias("word"), "docs").groupBy("entity", "word").agg(
        F.sum("docs").alias("together"), F.count(F.lit(1)).alias("contexts")))
    words = found.where("word is not null").groupBy("word").agg(F.sum("docs").alias("of_word"))

    def share(of_term: str, together: str):
        ratio = F.log(F.least(F.col(of_term), F.lit(documents)) / F.col(together)) / F.log(F.lit(documents) / F.col("of_entity"))
        return F.when(F.col("of_entity") < documents, 1 - ratio).otherwise(F.lit(0.0))

    likely = rounds.keep(pairs.where(F.col("contexts") >= support).join(few(whole), "entity"))
    asked = rounds.keep(likely.select("word").distinct())
    of_word = rounds.keep(words.join(few(asked), "word"))
    strong = rounds.keep(likely.join(few(of_word), "word").withColumn("share", share("of_word", "together"))
                         .where(F.col("share") >= threshold - 1e-12).select("entity", "word", "share", "of_entity"))
    lengths = F.when(F.length("word") > LEAST_PREFIX, F.sequence(F.lit(LEAST_PREFIX), F.length("word") - 1))
    start = F.expr("substring(word, 1, k)").alias("start")
    starts = rounds.keep(strong.select("entity", "word", "of_entity", F.explode(lengths).alias("k")).select("entity", "word", "of_entity", start))
    spread = words.select("word", "of_word", F.explode(lengths).alias("k")).select(start, "of_word")
    of_start = spread.join(few(rounds.keep(starts.select("start").distinct())), "start").groupBy("start").agg(F.sum("of_word").alias("of_start"))
    near = pairs.select("entity", "word", "together", F.explode(lengths).alias("k")).select("entity", start, "together")
    near = near.join(few(rounds.keep(starts.select("entity", "start").distinct())), ["entity", "start"]).groupBy("entity", "start").agg(
        F.sum("together").alias("near"))
    general = (starts.join(near, ["entity", "start"]).join(of_start, "start").withColumn("share", share("of_start", "near"))
               .groupBy("word", "start").agg(F.max("share").alias("most"), F.count(F.lit(1)).alias("entities")))
    entities = strong.groupBy("word").agg(F.max("share").alias("share"), F.count(F.lit(1)).alias("all"))
    fit = (general.join(entities.select("word", "all"), "word").where(F.col("most") < threshold - 1e-12).where("entities = all")
           .groupBy("word").agg(F.max_by("start", F.length("start")).alias("general")))
    return entities.join(fit, "word", "left").select("word", "general", "share")


_SPANS = "array<struct<kind:int,start:int,end:int,general:string>>"


def marked(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, text and spans (by kind and start) of each row, with the occurrences of ``terms`` (word, general).

    Terms are broadcast in blocks of at most ``BLOCK``; each block goes over all rows in the same stage.
    """
    rows = plain(docs, "doc_id", "text")
    schema = f"doc_id long, text string, spans {_SPANS}"
    out = arrow_schema(schema)

    def added(words: dict[str, str | None], first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch):
                    made = []
                    for text, old in zip(texts(part), [None] * part.num_rows if first else part.column("spans").to_pylist()):
                        spans = base_spans(text) if first else [(s["kind"], s["start"], s["end"]) for s in old if s["kind"] < 4]
                        rows = [(*s, None) for s in spans] if first else [(s["kind"], s["start"], s["end"], s["general"]) for s in old]
                        blank = masked(text, spans) if words else ""
                        if any(w.lower() in words for w in set(_WORD.findall(blank))):
                            rows += [(4, *m.span(), words[w]) for m in _WORD.finditer(blank) if (w := m.group().lower()) in words]
                        made.append([dict(zip(("kind", "start", "end", "general"), r)) for r in sorted(rows, key=lambda r: r[:3])])
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text").cast(out.field("text").type),
                                                      pa.array(made, type=out.field("spans").type)], schema=out)
        return run

    block: dict[str, str | None] = {}
    first = True
    for row in terms.toLocalIterator():
        block[row.word] = row.general
        if len(block) == BLOCK:
            rows, block, first = rows.mapInArrow(added(block, first), schema), {}, False
    return rows.mapInArrow(added(block, first), schema) if block or first else rows


def sanitise(docs: DataFrame, reach: int = REACH, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text with its spans replaced, and spans, of each row.

    Personal data becomes its kind in brackets, a disclosing term its general beginning with ``*``, or nothing. Where
    spans overlap the one that starts first is replaced, and the rest of the other goes with it. A null text counts as
    empty; empty texts have no span; repeated rows are counted and kept each; equal shares need no order, since every term at
    the threshold goes. An entity in all documents has no information that could be disclosed. Further columns are not read.
    """
    terms = Rounds(docs.sparkSession).keep(disclosing(docs, reach, support, threshold))
    schema = f"doc_id long, text string, spans {_SPANS}"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, spans in zip(texts(batch), batch.column("spans").to_pylist()):
                pieces, at = [], 0
                for s in sorted(spans, key=lambda s: (s["start"], s["kind"])):
                    if s["start"] >= at:
                        general = f"[{KINDS[s['kind']].upper()}]" if s["kind"] < 4 else f"{s['general']}*" if s["general"] else ""
                        pieces += [text[at : s["start"]], general]
                    at = max(at, s["end"])
                made.append("".join([*pieces, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, type=out.field("text").type), batch.column("spans")], schema=out)

    return marked(docs, terms).mapInArrow(run, schema)


def report(docs: DataFrame, reach: int = REACH, support: int = SUPPORT, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, the number of spans of each kind of personal data, a digest of these and all spans as text."""
    terms = Rounds(docs.sparkSession).keep(disclosing(docs, reach, support, threshold))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    listed = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", F.element_at(kinds, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")
    of = [F.size(F.expr(f"filter(spans, s -> s.kind = {k})")).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return marked(docs, terms).select("doc_id", *of, F.sha2(listed(F.filter("spans", lambda s: s.kind < 4)), 256).alias("base_sha256"),
                                      listed(F.col("spans")).alias("spans"))
