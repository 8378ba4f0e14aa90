"""Toxicity: subword-bag embeddings, averaged, into a linear softmax.

The bag of a text holds the distinct byte n-grams of 3 to 5 of its lower-cased words, with the white
space at either end of a word as a border, and ``NEUTRAL`` empty members; n-grams are hashed to
``BUCKETS`` rows of an embedding table. The mean of the rows goes through a linear layer and a softmax over two classes. Table and layer are
trained jointly by Adagrad in numpy on a bounded sample of labelled rows. A misspelling that was never
seen still shares most n-grams with the word.

Because all is linear up to the softmax, a trained row stands for one number, its share of the margin
between the classes; a text's margin is the mean of these. So scoring is one lookup for each n-gram
of the whole text, in arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landrecon.llm.frames import arrow_map, arrow_schema, neutral, plain, renamed, restored, texts

BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
DIMENSIONS = 6
SIZES = (3, 4, 5)
EPOCHS = 8
#: Squared gradient from which on the steps of a row get shorter: rows seen only a few times hardly move.
DAMPING = 1e-5
#: Most labelled rows of class 0 and of class 1 that the model learns from: those with the smallest hashes.
SAMPLE = (3000, 1500)
#: Empty members of every bag, so that a few n-grams alone do not decide.
NEUTRAL = 60
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
#: N-grams hashed at a time; a longer text is taken in runs that overlap.
_RUN = 1 << 20


def ngrams(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size the bucket of the n-gram at each place, and which of them lie within a word and its borders."""
    space = data == 32
    wide = data.astype(np.uint32)
    inner = np.zeros(len(data), bool)  # white space strictly inside the n-gram that starts here
    code = wide.copy()
    for n in range(2, max(SIZES) + 1):
        m = len(data) - n + 1
        if m <= 0:
            return
        code = code[:m] * np.uint32(0x01000193) + wide[n - 1 :]
        if n > 2:
            inner = inner[:m] | space[n - 2 : n - 2 + m]
        if n in SIZES:
            mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1)
            yield (mixed >> np.uint32(32 - BUCKET_BITS)), ~inner[:m]


def _runs(text: str) -> Iterator[np.ndarray]:
    data = _FOLD[np.frombuffer(f" {text} ".encode(), np.uint8)]
    for k in range(0, len(data), _RUN):
        yield data[k : k + _RUN + max(SIZES) - 1]


def bag(text: str) -> np.ndarray:
    """Distinct buckets of a text."""
    total = np.zeros(0, np.uint32)
    for data in _runs(text):
        total = np.sort(np.concatenate([total, *(b[:_RUN][good[:_RUN]] for b, good in ngrams(data))]))
        total = total[np.concatenate([[True], total[1:] != total[:-1]])] if len(total) else total
    return total


def train(rows: list[tuple[str, int]], prior: float, seed: int = 7) -> bytes:
    """Margins of the buckets and the bias as bytes. ``prior``: share of class 1 among all labelled rows."""
    rng = np.random.default_rng(seed)
    bags = [bag(t) for t, _ in rows]
    y = np.array([c for _, c in rows], np.int64)
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    sum_t, sum_l, sum_b = np.full(BUCKETS, DAMPING, np.float32), np.full((DIMENSIONS, 2), 1e-4, np.float32), np.full(2, 1e-4, np.float32)
    keep = np.array([i for i, b in enumerate(bags) if len(b)], np.int64)
    for epoch in range(EPOCHS if len(keep) else 0):
        rate = 0.3 * (1 - epoch / EPOCHS) + 0.03
        order = rng.permutation(keep)
        for k in range(0, len(order), 32):
            part = order[k : k + 32]
            index = np.concatenate([bags[i] for i in part])
            sizes = np.array([len(bags[i]) for i in part])
            ends = np.cumsum(sizes)
            weight = np.repeat(1 / (sizes + NEUTRAL), sizes).astype(np.float32)
            starts = np.concatenate([[0], ends[:-1]])
            hidden = np.add.reduceat(table[index] * weight[:, None], starts, axis=0)
            logits = hidden @ layer + bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            grad_l, grad_b, grad_h = hidden.T @ p, p.sum(0), p @ layer.T
            grad_rows = np.repeat(grad_h, np.diff(np.concatenate([[0], ends])), axis=0) * weight[:, None]
            distinct, place = np.unique(index, return_inverse=True)
            grad_t = np.stack([np.bincount(place, grad_rows[:, d], len(distinct)) for d in range(DIMENSIONS)], 1)
            sum_t[distinct] += (grad_t ** 2).mean(1)
            table[distinct] -= rate * grad_t / np.sqrt(sum_t[distinct])[:, None]
            sum_l += grad_l ** 2
            sum_b += grad_b ** 2
            layer -= rate * 0.3 * grad_l / np.sqrt(sum_l)
            bias -= rate * 0.1 * grad_b / np.sqrt(sum_b)
    margins = table @ (layer[:, 1] - layer[:, 0])
    return np.concatenate([margins, [bias[1] - bias[0], prior]]).astype("<f4").tobytes()


def margin_of(text: str, model: np.ndarray) -> float:
    """log(p1 / p0) of a text; one without n-grams has the share of class 1 among labelled rows."""
    found = bag(text)
    if not len(found):
        p = min(max(float(model[-1]), 1e-6), 1 - 1e-6)
        return float(np.log(p / (1 - p)))
    return float(model.take(found).sum(dtype=np.float64)) / (len(found) + NEUTRAL) + float(model[-2])


def fold(column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> bytes:
    """The model learned from labelled rows outside fold 0.

    At most ``sample[c]`` rows of class c, those with the smallest hash of their id, are read
    whole by one task. Labels that are null or of unknown ids are passed over; a doc_id with several
    rows of text contributes the first few up to the bound. Without any labelled row every score is 0.5.
    """
    known = plain(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").where(fold() != 0)
    share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    picked = None
    for c in (0, 1):
        one = known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample[c])
        picked = one if picked is None else picked.unionByName(one)
    # At most sum(sample) narrow rows.
    learned = (plain(docs, "doc_id", "text").join(F.broadcast(picked.dropDuplicates(["doc_id"])), "doc_id")
              .select(F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"),
                      F.xxhash64("doc_id").alias("h"), "doc_id")
              .repartition(1).sortWithinPartitions("h", "doc_id", "text").limit(2 * sum(sample)))
    prior, out = 0.5 if share is None else float(share), arrow_schema("model binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t, c) for b in batches for t, c in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist())]
        yield pa.RecordBatch.from_arrays([pa.array([train(rows, prior)], pa.binary())], schema=out)

    made = learned.mapInArrow(run, "model binary").first()
    return made[0] if made else train([], prior)


def score(docs: DataFrame, model: bytes, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and score (0 to 1) of each row's whole text; null counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    types = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in carried) + ", score double"

    def step(batch: pa.RecordBatch) -> dict[str, list]:
        weights = np.frombuffer(shared.value, "<f4")
        margins = np.array([margin_of(t, weights) for t in texts(batch)], np.float64)
        return {c: batch.column(c) for c in carried} | {"score": 1 / (1 + np.exp(-np.clip(margins, -500, 500)))}

    return arrow_map(plain(docs, *dict.fromkeys((*carried, "text"))), step, schema)


def toxicity(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """doc_id, held_out (fold 0), score, predicted (1 if score >= 0.5) of each row.

    Repeated rows stay and score alike; a null doc_id is in no fold and counts as not held out.
    """
    found = score(docs, fit(docs, labels, sample))
    return found.select("doc_id", F.coalesce(fold() == 0, F.lit(False)).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below 0.5."""
    names = neutral(docs, "text")
    scored = score(docs.select(*renamed(docs, names)), fit(docs, labels, sample), tuple(names.values()))
    return scored.where("score < 0.5").select(*restored(names))
