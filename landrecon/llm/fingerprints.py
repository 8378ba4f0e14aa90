"""Document fingerprints: a threshold-scaled sketch of word shingles.

Every distinct shingle of ``WORDS`` words has a 64-bit hash; the sketch keeps those below a fixed
fraction 1 / ``SCALE`` of all hashes, so its size follows the text, and where those are fewer than
``LEAST``, the ``LEAST`` smallest. A text of at most ``LEAST`` shingles keeps all of them. Two sketches
are compared below the bound up to which both are complete.
The sketch of a union is the union of the sketches, and the share of one sketch found in another
estimates how much of one text is contained in the other, even where one is far longer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landrecon.llm.frames import arrow_map, arrow_schema, bounds, bucket_of, order_key, plain, shuffle_parts, slices, texts

WORDS = 5
SCALE = 8
LEAST = 32
_U = np.uint64
_POWERS = [pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(64)]


def word_hashes(data: bytes) -> np.ndarray:
    """Hashes of the words between ASCII white space."""
    words = data.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), _U, len(words))


def sketch(words: np.ndarray, size: int = WORDS, scale: int = SCALE) -> np.ndarray:
    """Ascending distinct shingle hashes below 2**64 / scale, the ``LEAST`` smallest if those are fewer. Fewer than ``size``
    words are one shingle; none, no hash."""
    if not len(words):
        return np.zeros(0, _U)
    n = max(1, len(words) - size + 1)
    mixed = np.zeros(n, _U)
    for k in range(min(size, len(words))):
        mixed += words[k : k + n] * _U(_POWERS[k])
    mixed ^= mixed >> _U(31)
    mixed *= _U(0xD6E8FEB86659FD93)
    mixed ^= mixed >> _U(32)
    mixed *= _U(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> _U(29)
    below = np.unique(mixed[mixed < _U((1 << 64) // scale)])
    return below if len(below) >= LEAST else np.unique(mixed)[:LEAST]


def complete_to(s: np.ndarray, scale: int = SCALE) -> int:
    """The largest hash up to which a sketch has all hashes of its text."""
    return 2**64 - 1 if len(s) < LEAST else max((1 << 64) // scale - 1, int(s[-1]))


def comparable(*sketches: np.ndarray) -> list[np.ndarray]:
    """The parts of sketches up to which all of them are complete."""
    to = _U(min(map(complete_to, sketches)))
    return [s[: np.searchsorted(s, to, "right")] for s in sketches]


def merge(*sketches: np.ndarray) -> np.ndarray:
    """The sketch of all the texts together."""
    if not sketches:
        return np.zeros(0, _U)
    every = np.unique(np.concatenate(comparable(*sketches)))
    return every[: max(LEAST, int(np.searchsorted(every, _U((1 << 64) // SCALE))))]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(a) + len(b) - len(np.union1d(a, b))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the shingles of either text that are in both; 1 for two texts without shingles."""
    if not len(a) and not len(b):
        return 1.0
    a, b = comparable(a, b)
    both = shared(a, b)
    return both / (len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray) -> float | None:
    """Estimated share of the shingles of the first text that the second contains; 1 for a text without shingles, None where
    no hash of the first is in the part that can be compared (a short text against a long one)."""
    if not len(a):
        return 1.0
    a, b = comparable(a, b)
    return shared(a, b) / len(a) if len(a) else None


def hexadecimal(s: np.ndarray) -> str:
    return s.astype(">u8").tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, hashes (array<long>) of each row's whole text; a null text counts as empty."""
    def step(batch: pa.RecordBatch) -> dict[str, list]:
        return {"doc_id": batch.column("doc_id"),
                "hashes": [sketch(word_hashes(t.encode())).view(np.int64) for t in texts(batch)]}

    return arrow_map(plain(docs, "doc_id", "text"), step, "doc_id long, hashes array<long>")


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) dealt to ranges of doc_id in order, with the first row of each range also at the end of the
    one before it (of the first one: at the end of the last), marked by _ahead."""
    rows = plain(docs, "doc_id", "text").withColumn("_key", order_key())
    cuts = bounds(rows, shuffle_parts(docs))
    placed = rows.withColumn("_bucket", bucket_of(F.col("_key"), cuts))
    # One key for each range; there are at most as many as shuffle partitions.
    firsts = {r[0]: r[1] for r in placed.groupBy("_bucket").agg(F.min("_key")).collect()}
    order = sorted(firsts)
    before = {firsts[b]: order[i - 1] for i, b in enumerate(order)}
    own = F.struct(F.col("_bucket").alias("bucket"), F.lit(False).alias("ahead"))
    back = F.lit(None).cast("int")
    if before:
        back = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("_key")]
    copies = F.when(F.col("_key").isin(*before) if before else F.lit(False),
                    F.array(own, F.struct(back.alias("bucket"), F.lit(True).alias("ahead")))).otherwise(F.array(own))
    dealt = placed.select("doc_id", "text", "_key", F.explode(copies).alias("_to")).select(
        "doc_id", "text", "_key", F.col("_to.bucket").alias("_bucket"), F.col("_to.ahead").alias("_ahead"))
    return (dealt.repartitionById(len(cuts) + 1, F.col("_bucket")).sortWithinPartitions("_bucket", "_ahead", "_key", "text")
            .select("doc_id", "text", "_bucket", "_ahead"))


_EDITS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
          "near_next double, kept_in_edited double, next_contained double")


def edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of the text with its last quarter replaced by the start of the next document.

    Next is by ascending doc_id, null ids first and equal ones in the order of their texts; after the
    last comes the first. Texts are shuffled once, to ranges of doc_id; a range needs one row of the
    next. A single document is its own next; an empty table has no row. kept_in_edited is the share of
    the text contained in the edited one, next_contained that of the next text contained in this one; it is null
    where the next text is so short against this one that their sketches cannot tell.
    """
    out = arrow_schema(_EDITS)

    def row(doc, text: str, mine: np.ndarray | None, after: str) -> tuple[list, np.ndarray]:
        n = len(text)
        cut = n - n // 4
        kept, rest, new = text[:cut], text[cut:], after[: n // 4]
        head, open_word = kept, ""
        if kept and not kept[-1].isspace():  # the word that the cut goes through
            at = max(kept.rfind(c) for c in " \t\n\r\x0b\x0c") + 1
            head, open_word = kept[:at], kept[at:]
        front = word_hashes(head.encode())
        own = sketch(np.concatenate([front, word_hashes((open_word + rest).encode())])) if mine is None else mine
        edited = sketch(np.concatenate([front, word_hashes((open_word + new).encode())]))
        following = sketch(word_hashes(after.encode()))
        sha = hashlib.sha256((kept + new).encode()).hexdigest()
        return [doc, n, sha, hexadecimal(own), hexadecimal(edited), likeness(own, edited), likeness(own, following),
                containment(own, edited), containment(following, own)], following

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sketched, bucket, done = None, None, None, False
        for batch in batches:
            for part in slices(batch):
                made = []
                for doc, text, of, ahead in zip(part.column("doc_id").to_pylist(), texts(part),
                                                part.column("_bucket").to_pylist(), part.column("_ahead").to_pylist()):
                    if of != bucket:
                        last, sketched, bucket, done = None, None, of, False
                    if done:
                        continue
                    if last is not None:
                        values, sketched = row(*last, sketched, text)
                        made.append(values)
                    last, done = (doc, text), ahead  # the first row ahead ends the range
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*made), out)], schema=out)

    return with_next(docs).mapInArrow(run, _EDITS)
