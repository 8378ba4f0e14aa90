"""Language-model scores by prediction by partial matching over bytes.

The text is its lower-cased words with one space between them and an end symbol. A context is the
``ORDER`` bytes before a byte; the context trie is kept as one table a depth: how often each byte
followed each context (nodes), and for each context its total T and its number of different bytes U.
Depths below the deepest are sums of it. A byte seen in the longest known context has probability
n / (T + U); else the model escapes with U / (T + U) to the context one byte shorter, from which the
bytes seen in the longer one are excluded, and so on; below depth 0 all bytes not yet excluded are
alike. As a longer context has only seen bytes that its suffix has seen too, what is excluded at a
depth depends on the context one deeper alone, so that a join of two depths gives its weight.

Counting, sums, exclusions and the probability of each distinct (context, byte) are Spark
aggregations and joins. Documents then look these up: in a broadcast table up to ``MODEL_ROWS`` rows,
beyond it by a join of the distinct pairs of each document.

For comparison there is a word unigram score with one added to each count. Words that are at least
the ``FREQUENT``-th part of all tokens, of which there are at most 1 / FREQUENT, are broadcast; the
others are looked up by a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landrecon.llm.frames import arrow_schema, plain, slices, texts
from landrecon.operators.rounds import Rounds

ORDER = 4
#: Most rows (long, double) of the table of pairs that is broadcast.
MODEL_ROWS = 4_000_000
FREQUENT = 1e-6
_FOLDED = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_END = b"\n"  # white space, so it is in no word
_HELD_WORDS, _HELD_GRAMS = 400_000, 2_000_000


def fold(column: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(7))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLDED).split()


def pairs_of(words: list[bytes], order: int = ORDER) -> np.ndarray:
    """Each byte of the text, the end included, with the ``order`` bytes before it, as one number."""
    data = np.frombuffer(_END * order + b" ".join(words) + _END, np.uint8).astype(np.int64)
    n = len(data) - order
    made = data[:n].copy()
    for k in range(1, order + 1):
        made <<= 8
        made |= data[k : k + n]
    return made


def _counts(docs: DataFrame, order: int) -> DataFrame:
    """word, pair, n: counts over training rows, combined in each task. Pairs of held-out rows have n = 0 there."""
    out = arrow_schema("word string, pair long, n long")

    def rows(words: Counter, pairs: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        if words:
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words], pa.string()), pa.nulls(len(words), pa.int64()),
                                              pa.array(words.values(), pa.int64())], schema=out)
        if len(pairs[0]):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(pairs[0]), pa.string()), pa.array(pairs[0]), pa.array(pairs[1])], schema=out)

    def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate(p) for p in zip(*parts))
        by = np.argsort(keys, kind="stable")
        keys, counts = keys[by], counts[by]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts

    def distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
        starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
        return codes[starts], np.diff(np.concatenate([starts, [len(codes)]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        pairs = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            for part in slices(batch, 8_000_000):
                learned, other = [], []
                for text, held in zip(texts(part), part.column("held_out").to_pylist()):
                    own = words_of(text)
                    (other if held else learned).append(pairs_of(own, order))
                    if not held:
                        words.update(own)
                        words[_END] += 1
                seen = distinct(other)
                pairs = joined([pairs, distinct(learned), (seen[0], np.zeros(len(seen[0]), np.int64))])
                if len(words) > _HELD_WORDS or len(pairs[0]) > _HELD_GRAMS:
                    yield from rows(words, pairs)
                    words, pairs = Counter(), (pairs[0][:0], pairs[1][:0])
        yield from rows(words, pairs)

    return docs.mapInArrow(run, "word string, pair long, n long").groupBy("word", "pair").agg(F.sum("n").alias("n"))


def _low(column: Column, size: int) -> Column:
    return column.bitwiseAND(F.lit((1 << 8 * size) - 1).cast("long"))


def log_probabilities(rounds: Rounds, pairs: DataFrame, order: int = ORDER) -> DataFrame:
    """pair, logp (log10) of each distinct pair of ``pairs`` (pair, n); only those with n > 0 are learned from."""
    nodes: dict[int, DataFrame] = {order: pairs.where("n > 0")}
    for j in range(order - 1, -1, -1):
        nodes[j] = rounds.keep(nodes[j + 1].groupBy(_low(F.col("pair"), j + 1).alias("pair")).agg(F.sum("n").alias("n")))
    contexts: dict[int, DataFrame] = {}
    for j in range(order + 1):
        own = nodes[j].select(F.shiftright("pair", 8).alias("c"), "n", _low(F.col("pair"), j).alias("suffix"))
        if j == 0:
            contexts[0] = rounds.keep(own.groupBy("c").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("u"))
                                      .select("c", "t", "u", F.lit(None).cast("double").alias("d"), F.lit(None).cast("double").alias("e")))
            continue
        shorter = nodes[j - 1].select(F.col("pair").alias("suffix"), F.col("n").alias("below"))
        stats = own.join(_small(shorter, j), "suffix").groupBy("c").agg(
            F.sum("n").alias("t"), F.count(F.lit(1)).alias("u"), F.sum("below").alias("x"))
        parent = contexts[j - 1].select(F.col("c").alias("pc"), F.col("t").alias("pt"), F.col("u").alias("pu"))
        with_parent = stats.join(_small(parent, j - 1), _low(F.col("c"), j - 1) == F.col("pc"))
        weight = (F.col("pt") - F.col("x") + F.col("pu") - F.col("u")).cast("double")
        contexts[j] = rounds.keep(with_parent.select(
            "c", "t", "u", weight.alias("d"),
            F.when(weight > 0, (F.col("pu") - F.col("u")) / weight).otherwise(F.lit(1.0)).alias("e")))
    found = pairs.select("pair")
    for j in range(order + 1):
        n = nodes[j].select(F.col("pair").alias(f"p{j}"), F.col("n").alias(f"n{j}"))
        c = contexts[j].select(F.col("c").alias(f"c{j}"), *[F.col(x).alias(f"{x}{j}") for x in "tude"])
        found = found.join(_small(n, j + 1), _low(F.col("pair"), j + 1) == F.col(f"p{j}"), "left").drop(f"p{j}")
        found = found.join(_small(c, j), F.shiftright(_low(F.col("pair"), j + 1), 8) == F.col(f"c{j}"), "left").drop(f"c{j}")

    def reached(j: int) -> Column:
        """At depth j after an escape from the known context one deeper."""
        if j < 0:
            return -F.log10(F.lit(256.0) - F.col("u0"))
        return F.when(F.col(f"n{j}").isNotNull(), F.log10(F.col(f"n{j}") / F.col(f"d{j + 1}"))).otherwise(
            F.log10(f"e{j + 1}") + reached(j - 1))

    def first(j: int) -> Column:
        if j < 0:
            return -F.log10(F.lit(256.0))
        n, t, u = F.col(f"n{j}"), F.col(f"t{j}"), F.col(f"u{j}")
        return F.when(t.isNull(), first(j - 1)).when(n.isNotNull(), F.log10(n / (t + u))).otherwise(F.log10(u / (t + u)) + reached(j - 1))

    return rounds.keep(found.select("pair", first(order).alias("logp")))


def _small(df: DataFrame, size: int) -> DataFrame:
    """Tables keyed by ``size`` bytes have at most 256**size rows: up to two bytes they are broadcast."""
    return F.broadcast(df) if size <= 2 else df


_SCORED = ("_row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, rare array<string>, "
           "often array<int>, pairs array<long>, times array<int>")


def _rows(docs: DataFrame, frequent: dict[bytes, int], model: tuple[np.ndarray, np.ndarray] | None, order: int) -> DataFrame:
    """One row a document, with what could not be looked up in the broadcast tables as arrays."""
    shared = docs.sparkSession.sparkContext.broadcast((frequent, model))
    out = arrow_schema(_SCORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, table = shared.value
        logs = {w: float(np.log10(c + 1)) for w, c in common.items()}
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch):
                made: dict[str, list] = {f.name: [] for f in out}
                for doc, held, text in zip(part.column("doc_id").to_pylist(), part.column("held_out").to_pylist(), texts(part)):
                    words = words_of(text)
                    codes = np.sort(pairs_of(words, order))
                    words.append(_END)
                    found = [logs[w] for w in words if w in logs]
                    rare = Counter([w for w in words if w not in logs])
                    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
                    codes, counts = codes[starts], np.diff(np.concatenate([starts, [len(codes)]]))
                    score = float(np.dot(table[1][np.searchsorted(table[0], codes)], counts)) if table is not None else 0.0
                    kept = (codes, counts) if table is None else ([], [])
                    row += 1
                    for name, value in zip(made, (row, doc, held, len(words), len(found), sum(found), score,
                                                  [w.decode() for w in rare], list(rare.values()), *kept)):
                        made[name].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in out], schema=out)

    return docs.mapInArrow(run, _SCORED)


def scores(docs: DataFrame, order: int = ORDER, model_rows: int = MODEL_ROWS, frequent: float = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row's whole text.

    The model learns from rows outside fold 2 of crc32(doc_id) modulo 7; a null doc_id is in no fold
    and is learned from. A null text counts as empty and has the end alone; repeated rows count as
    often as they occur. Without any row to learn from all bytes are alike and base_score is 0. Results
    do not depend on ``model_rows`` and ``frequent``, which only choose how things are looked up.
    """
    rounds = Rounds(docs.sparkSession)
    rows = plain(docs, "doc_id", "text").withColumn("held_out", F.coalesce(fold() == 2, F.lit(False)))
    counts = rounds.keep(_counts(rows, order))
    words = counts.where("word is not null").select("word", "n")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    table = log_probabilities(rounds, counts.where("pair is not null").select("pair", "n"), order)
    model = None
    if table.count() <= model_rows:
        got = table.orderBy("pair").toArrow()
        model = got.column("pair").to_numpy(), got.column("logp").to_numpy()
    common = words.where(F.col("n") >= max(1.0, frequent * n)).toArrow()  # at most 1 / frequent rows
    known = {w.encode(): c for w, c in zip(common.column("word").to_pylist(), common.column("n").to_pylist())}
    scored = rounds.keep(_rows(rows, known, model, order))
    if len(known) < v or scored.where("size(rare) > 0").head(1):
        # Few rows can share a word here: it is rarer than the bound, or in no training row.
        each = scored.select("_row", F.explode(F.arrays_zip("rare", "often")).alias("w")).select(
            "_row", F.col("w.rare").alias("word"), F.col("w.often").alias("times"))
        c = F.coalesce("n", F.lit(0))
        rest = each.join(words, "word", "left").groupBy("_row").agg(
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"), F.sum(F.log10(c + 1) * F.col("times")).alias("rare_base"))
        scored = scored.join(rest, "_row", "left")
    else:
        scored = scored.withColumn("rare_known", F.lit(0)).withColumn("rare_base", F.lit(0.0))
    if model is None:
        each = scored.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select(
            "_row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
        by_row = each.join(table, "pair").groupBy("_row").agg(F.sum(F.col("logp") * F.col("times")).alias("_score"))
        scored = scored.drop("score").join(by_row, "_row").withColumnRenamed("_score", "score")
    per_token = F.log10(F.lit(float(n + v + 1)))
    return scored.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * per_token).alias("base_score"), "score")
