"""Ranked lexical search by per-term geometric blocking.

Documents are indexed in shards of some thousand rows, which are built and searched where the rows are;
no posting is shuffled. In a shard the posting list of every term is clustered by document similarity:
each document is a point (its weighted term vector, projected to ``AXES`` random axes), some members of the
list are pivots, and each member joins the block of its nearest pivot. A block stores a summary, the
coordinatewise maximum over its documents' vectors, rounded up to bytes. For a query the summary gives a
bound that no document of the block exceeds. Blocks are taken by falling bound, their documents scored
exactly, and a block is skipped only when its bound is below the k-th score found so far, so the
result is exact. Short lists have no summary and so no bound.

Queries are a stated set that is searched in blocks: of items with together at most ``TERMS`` different
terms (or a single item). The index of a block of items holds every document, with the coordinates that the items ask for.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landrecon.llm.frames import arrow_map, arrow_schema, plain, slices, texts
from landrecon.operators.rounds import Rounds

#: Fixed values of the score: what a document's length counts, in hundredths, and the scale of tf parts.
LENGTH_SHARE, SCALE, TF_SCALE, LENGTH_SCALE = 75, 1_000_000_000, 1000, 8
#: Different terms of a block of items; documents, matrix cells and bytes of text of a shard.
TERMS, SHARD_ROWS, SHARD_CELLS, SHARD_BYTES = 4096, 1024, 4_000_000, 4_000_000
#: Documents of a block (on average), of a list that has no summary (at most), and axes of a point.
BLOCK, SHORT, AXES = 64, 16, 32
#: A part of a score is at most SCALE / TF_SCALE; a byte of a summary stands for so much of it.
STEP = SCALE // TF_SCALE // 250
#: The place of a null doc_id among equal scores: the last.
NO_ID = 2**63 - 1
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(text: str, piece: int = 1_000_000) -> Counter[bytes]:
    """Terms of a text: runs of ASCII letters and digits and of other than ASCII characters; A-Z lower-cased."""
    data = text.encode().translate(_TERM)
    found: Counter[bytes] = Counter()
    start = 0
    while start < len(data):
        end = data.find(b" ", start + piece)
        found.update(data[start : end if end >= 0 else len(data)].split())
        start = end if end >= 0 else len(data)
    return found


@dataclass(frozen=True)
class Statistics:
    """Documents with a term, all their terms, and the documents that hold each term of a vocabulary."""

    documents: int
    terms: int
    holding: dict[str, int]

    def weight(self, term: str) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * self.holding.get(term, 0) + 1)))

    def length_part(self, n: int) -> int:
        return 100 - LENGTH_SHARE + (LENGTH_SHARE * n * self.documents) // self.terms


def statistics(docs: DataFrame, vocabulary: list[str]) -> Statistics:
    """Counts over all rows. Each task sends at most one row for each term of the vocabulary."""
    places = {t.encode(): i for i, t in enumerate(vocabulary)}
    out = arrow_schema("place int, documents long, terms long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding, documents, terms = np.zeros(len(places), np.int64), 0, 0
        for batch in batches:
            for part in slices(batch):
                for text in texts(part):
                    found = term_counts(text)
                    documents += bool(found)
                    terms += found.total()
                    for p in map(places.get, found):
                        if p is not None:
                            holding[p] += 1
        held = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *held.tolist()], pa.int32()), pa.array([documents, *holding[held].tolist()]),
                                          pa.array([terms, *[0] * len(held)])], schema=out)

    rows = plain(docs, "text").mapInArrow(run, "place int, documents long, terms long").groupBy("place").agg(
        F.sum("documents").alias("documents"), F.sum("terms").alias("terms")).collect()
    whole = next((r for r in rows if r.place < 0), None)
    return Statistics(whole.documents if whole else 0, whole.terms if whole else 0, {vocabulary[r.place]: r.documents for r in rows if r.place >= 0})


def _blocks(members: np.ndarray, points: np.ndarray) -> list[np.ndarray]:
    """The members of a list, each with those nearest to the same pivot."""
    pivots = members[:: BLOCK]
    if len(pivots) == 1:
        return [members]
    nearest = (points[members] @ points[pivots].T).argmax(1)
    order = np.argsort(nearest, kind="stable")
    return np.split(members[order], np.flatnonzero(np.diff(nearest[order])) + 1)


INDEX = ("doc_ids array<long>, starts array<int>, places array<int>, parts array<int>, list_starts array<int>, "
         "block_starts array<int>, members array<int>, summary_rows array<int>, summary_count int, "
         "summaries binary")


def build_shard(rows: list[tuple[int | None, str]], places: dict[bytes, int], weights: np.ndarray, stats: Statistics) -> dict[str, object] | None:
    """The index of some documents, by column; None if none holds a term of the vocabulary."""
    ids, starts, at, parts = [], [0], [], []
    for doc_id, text in rows:
        found = term_counts(text)
        held = [(p, tf) for p, tf in ((places.get(t), tf) for t, tf in found.items()) if p is not None]
        if not held:
            continue
        m = LENGTH_SCALE * stats.length_part(found.total())
        ids.append(NO_ID if doc_id is None else doc_id)
        at += [p for p, _ in held]
        parts += [SCALE * tf // (TF_SCALE * tf + m) for _, tf in held]
        starts.append(len(at))
    if not ids:
        return None
    place, part = np.array(at, np.int32), np.array(parts, np.int32)
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(starts))
    rounded = np.zeros((len(ids), len(places)), np.uint8)
    rounded[doc, place] = -(-part // STEP)
    axes = np.random.default_rng(1).standard_normal((len(places), AXES)).astype(np.float32) * (weights[:, None] / 1000).astype(np.float32)
    points = rounded.astype(np.float32) @ axes
    points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
    order = np.argsort(place, kind="stable")
    lists = np.searchsorted(place[order], np.arange(len(places) + 1))
    by_term = doc[order]
    list_starts, block_starts, members, summary_rows, summaries = [0], [0], [], [], []
    for a, b in zip(lists[:-1].tolist(), lists[1:].tolist()):
        if b > a:
            short = b - a <= SHORT
            for block in [by_term[a:b]] if short else _blocks(by_term[a:b], points):
                members.append(block)
                block_starts.append(block_starts[-1] + len(block))
                summary_rows.append(-1 if short else len(summaries))
                if not short:
                    summaries.append(rounded[block].max(0))
        list_starts.append(len(summary_rows))
    return {"doc_ids": ids, "starts": starts, "places": place, "parts": part, "list_starts": list_starts, "block_starts": block_starts,
            "members": np.concatenate(members), "summary_rows": summary_rows, "summary_count": len(summaries),
            "summaries": pa.compress(b"".join(s.tobytes() for s in summaries), "zstd", asbytes=True)}


def index(docs: DataFrame, vocabulary: list[str], stats: Statistics) -> DataFrame:
    """One row for each shard: its documents' parts of scores, and for each term the blocks with their summaries.

    Every row is indexed, with the terms of the vocabulary. A row without any of them has nothing to score.
    """
    places = {t.encode(): i for i, t in enumerate(vocabulary)}
    weights = np.array([stats.weight(t) for t in vocabulary], np.int64)
    out, most = arrow_schema(INDEX), max(16, min(SHARD_ROWS, SHARD_CELLS // max(1, len(vocabulary))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, SHARD_BYTES):
                for k in range(0, piece.num_rows, most):
                    part = piece.slice(k, most)
                    made = build_shard(list(zip(part.column("doc_id").to_pylist(), texts(part))), places, weights, stats)
                    if made:
                        yield pa.RecordBatch.from_arrays([pa.array([made[f.name]], type=f.type) for f in out], schema=out)

    return plain(docs, "doc_id", "text").mapInArrow(run, INDEX)


class Top:
    """The k best documents of one item."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        positive = scores > 0
        scores, ids = np.concatenate([self.scores, scores[positive]]), np.concatenate([self.ids, ids[positive]])
        best = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[best], ids[best]

    @property
    def bar(self) -> int:
        """A score below this one can't come in; an equal one could, by its id."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1


class Shard:
    """A shard of the index ready to be searched."""

    def __init__(self, row: dict[str, object], vocabulary: int):
        row = {c: v if c.startswith("summar") and c != "summary_rows" else np.asarray(v) for c, v in row.items()}
        self.ids, self.members = row["doc_ids"], row["members"]
        self.lists, self.blocks, self.rows = row["list_starts"], row["block_starts"], row["summary_rows"]
        size = row["summary_count"] * vocabulary
        self.summaries = np.frombuffer(pa.decompress(row["summaries"], size, "zstd"), np.uint8).reshape(-1, vocabulary)
        self.parts = np.zeros((vocabulary, len(self.ids)), np.int32)
        self.parts[row["places"], np.repeat(np.arange(len(self.ids)), np.diff(row["starts"]))] = row["parts"]

    def bounds(self, places: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The blocks of the terms' lists by falling bound, and the bounds. A block without a summary has no bound."""
        blocks = np.concatenate([np.arange(self.lists[p], self.lists[p + 1]) for p in places])
        rows = self.rows[blocks]
        bounds = np.full(len(blocks), np.iinfo(np.int64).max)
        held = rows >= 0
        bounds[held] = self.summaries[np.ix_(rows[held], places)].astype(np.int64) @ weights * STEP
        order = np.argsort(-bounds, kind="stable")
        return blocks[order], bounds[order]

    def search(self, places: np.ndarray, weights: np.ndarray, top: Top, step: int = 64) -> int:
        """Adds what the shard has to ``top``; returns how many documents were scored.

        A block whose bound is below the bar is skipped, and its documents with it: they are not scored through
        other blocks either. So a document's bound is the smallest of its blocks' bounds.
        """
        if not len(places):
            return 0
        blocks, bounds = self.bounds(places, weights)
        sizes = self.blocks[blocks + 1] - self.blocks[blocks]
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        limit = np.full(len(self.ids), -1, np.int64)
        limit[self.members[np.repeat(self.blocks[blocks], sizes) + within]] = np.repeat(bounds, sizes)  # the last one stays
        hopeful = np.flatnonzero(limit >= top.bar)
        hopeful = hopeful[np.argsort(-limit[hopeful], kind="stable")]
        table, scored = self.parts[places], 0
        while len(hopeful):
            now, hopeful = hopeful[:step], hopeful[step:]
            top.add(weights @ table[:, now], self.ids[now])
            hopeful, scored, step = hopeful[limit[hopeful] >= top.bar], scored + len(now), 2 * step
        return scored


def search(built: DataFrame, queries: list[tuple[int, list[tuple[int, int]]]], vocabulary: int, k: int = 10) -> DataFrame:
    """query, doc_id, score: the k best of the documents of each task for each query, (number, [(place, weight)])."""
    asked = [(q, np.array([p for p, _ in of], np.int64), np.array([w for _, w in of], np.int64)) for q, of in queries]
    out = arrow_schema("query long, doc_id long, score long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = [Top(k) for _ in asked]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {f.name: batch.column(f.name)[i] for f in batch.schema}
                shard = Shard({c: v.values if isinstance(v, pa.ListScalar) else v.as_py() for c, v in row.items()}, vocabulary)
                for (_, places, weights), top in zip(asked, tops):
                    shard.search(places, weights, top)
        for (q, _, _), top in zip(asked, tops):
            if len(top.ids):
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(top.ids), pa.int64()), pa.array(
                    [None if x == NO_ID else x for x in top.ids.tolist()], pa.int64()), pa.array(top.scores)], schema=out)

    return built.mapInArrow(run, "query long, doc_id long, score long")


def _item_blocks(items: DataFrame) -> Iterator[list[tuple[int, dict[str, int]]]]:
    """Items (query, terms, counts) in runs of at most ``TERMS`` different terms; the driver holds one run."""
    block: list[tuple[int, dict[str, int]]] = []
    seen: set[str] = set()
    for row in items.toLocalIterator():
        if block and len(seen.union(row.terms)) > TERMS:
            yield block
            block, seen = [], set()
        block.append((row.query, dict(zip(row.terms, row.counts))))
        seen.update(row.terms)
    if block:
        yield block


def ranked(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score of the k highest-scoring rows of ``docs`` for each row of ``items`` (item_id, text).

    Null, empty and termless texts score nothing, and a query without a match has no row. Rows with equal scores
    go by ascending doc_id, a null one last (2**63 - 1 counts as null); a repeated document is ranked once for each
    row, a repeated item has a ranking of its own. An empty table on either side gives no row. A long text is
    counted in pieces of a megabyte. Further columns are not read.
    """
    spark = docs.sparkSession
    rounds = Rounds(spark)

    def step(batch: pa.RecordBatch) -> dict[str, list]:
        found = [term_counts(t) for t in texts(batch)]
        return {"item_id": batch.column("item_id"), "terms": [[t.decode() for t in f] for f in found], "counts": [list(f.values()) for f in found]}

    asked = arrow_map(plain(items, "item_id", "text"), step, "item_id long, terms array<string>, counts array<int>")
    asked = rounds.keep(asked.withColumn("query", F.monotonically_increasing_id()))
    found = spark.createDataFrame([], "query long, doc_id long, score long")
    for block in _item_blocks(asked.where(F.size("terms") > 0)):
        vocabulary = sorted({t for _, counts in block for t in counts})
        stats = statistics(docs, vocabulary)
        if not stats.documents:
            break
        place = {t: i for i, t in enumerate(vocabulary)}
        queries = [(q, [(place[t], stats.weight(t) * n) for t, n in counts.items() if t in stats.holding]) for q, counts in block]
        built = rounds.keep(index(docs, vocabulary, stats))
        found = found.unionByName(rounds.keep(search(built, queries, len(vocabulary), k)))
        rounds.drop(built)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return top.join(asked.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")


SQL = r"""
    WITH words AS (
      SELECT d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM (SELECT *, row_number() OVER () AS d FROM documents)),
    asked AS (
      SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM benchmark),
    size AS (SELECT d, count(*) AS n FROM words GROUP BY d),
    whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM size),
    length_part AS (SELECT d, 100 - 75 + (75 * n * docs) // terms AS m FROM size, whole),
    held AS (SELECT d, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM words SEMI JOIN asked USING (term) GROUP BY d, term),
    weight AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, whole GROUP BY term, docs),
    query AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY item_id, term),
    scored AS (
      SELECT item_id, d, any_value(doc_id) AS doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM query JOIN held USING (term) JOIN weight USING (term) JOIN length_part USING (d) GROUP BY item_id, d),
    placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
    SELECT item_id, rank::INT AS rank, doc_id, score FROM placed WHERE rank <= 10"""
