"""SimHash near-duplicates by multi-index hashing, and near-duplicates by verified segment balls (``similar``).

A fingerprint has 64 bits: a bit is set if it is set in over half of the hashes of the word shingles.
Fingerprints link at ``radius`` or fewer differing bits. The two 32-bit halves are the segments. Of two
fingerprints at most 4 apart, either the high halves are at most 2 apart or the low halves at most 1.
Every fingerprint is entered in the table of each segment under all values of the Hamming ball of
radius 1 around its own (33 of them), so two values at most 2 apart meet at one that lies between.
Entries under the same value are candidates; the whole fingerprints are then compared.

Candidates are not listed as pairs. Fingerprints with the same high half are first grouped exactly,
each with a label; then the tables are searched only for links between different labels. Within a table
entry a search from one member to the rest removes what it reaches, so an entry of n members gives at
most n - 1 links and, where copies are dense, takes about n steps. Values with more than ``CHUNK``
members are dealt to several tasks: members fall in chunks, and every two chunks meet in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from landrecon.llm.components import components
from landrecon.llm.frames import BROADCAST_ROWS, arrow_map, arrow_schema, few, located, neutral, plain, restored, shuffle_parts, texts
from landrecon.operators.rounds import Rounds

#: Most members of a table entry that one task holds, times two.
CHUNK = 4096
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(text: str, words: int = 4, seed: int = 42) -> int:
    """64 bits of the shingles of ``words`` words, repeats included; without any word 0."""
    parts = text.encode().translate(_LOWER).split()  # ASCII white space only
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(parts) - words + 1)
    ends, starts = (ends[words - 1 :], starts[:n]) if len(parts) >= words else (ends[-1:], starts[:1])
    digest = xxhash.xxh64_intdigest
    set_in = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        pairs = zip(starts[k : k + 65536].tolist(), ends[k : k + 65536].tolist())
        hashes = np.array([digest(joined[a:b], seed) for a, b in pairs], "<u8")
        set_in += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of each row; a null text counts as empty."""
    def step(batch: pa.RecordBatch) -> dict[str, list]:
        found = np.array([fingerprint(t, words) for t in texts(batch)], np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": found.view(np.int64)}

    return arrow_map(plain(docs, "doc_id", "text"), step, "doc_id long, fp long")


def _ball(value: Column, segment: int) -> Column:
    return F.array(*[F.lit(segment << 32) + value.bitwiseXOR(F.lit(m).cast("long")) for m in (0, *(1 << i for i in range(32)))])


def _halves(fp: str = "fp") -> tuple[Column, Column]:
    return F.shiftrightunsigned(fp, 32), F.col(fp).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def _dealt(entries: DataFrame, rounds: Rounds, *carried: str) -> DataFrame:
    """Entries (key, ...) with the part of the key's members they belong to; rows of large keys go to several parts.
    The first carried column tells members apart."""
    large = rounds.keep(entries.groupBy("key").count().where(F.col("count") > CHUNK)
                        .select("key", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")))
    n = large.count()
    if not n:
        return entries.select("key", F.lit(0).alias("part"), *carried)
    # Large keys number at most entries / CHUNK: broadcast while few, else joined by shuffle.
    marked = entries.join(F.broadcast(large) if n <= 100_000 else large, "key", "left")
    own = F.pmod(F.xxhash64(carried[0]), F.col("chunks").cast("long")).cast("int")
    parts = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.least(own, j) * F.col("chunks") + F.greatest(own, j)))
    return marked.select("key", F.explode(parts).alias("part"), *carried)


def stars(fps: np.ndarray, labels: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Pairs of labels that join what the links between these fingerprints (a row of words each) join, without repeats."""
    pairs: list[tuple[int, int]] = []
    left = np.ones(len(fps), bool)
    while left.any():
        first = int(left.argmax())
        mine = labels[first]
        group = left & (labels == mine)
        left &= ~group
        queue = np.flatnonzero(group).tolist()
        while queue and left.any():
            rest = np.flatnonzero(left)
            near = rest[np.bitwise_count(fps[rest] ^ fps[queue.pop()]).sum(1, dtype=np.int64) <= radius]
            if len(near):
                joined = np.unique(labels[near])
                pairs += [(int(mine), int(x)) for x in joined]
                group = left & np.isin(labels, joined)
                left &= ~group
                queue += np.flatnonzero(group).tolist()
    return pairs


def _groups(batches: Iterator[pa.RecordBatch], names: list[str], part: int = 1) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Columns of sorted rows and the starts of their groups, by the first column and number ``part``; no group is torn between
    two batches."""
    kept: list[np.ndarray] | None = None
    for batch in batches:
        now = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        now = now if kept is None else [np.concatenate(p) for p in zip(kept, now)]
        new = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[part]) != 0)) + 1
        last = int(new[-1]) if len(new) else 0
        if last:
            yield [c[:last] for c in now], np.concatenate([[0], new[:-1]])
        kept = [c[last:] for c in now]
    if kept is not None and len(kept[0]):
        yield kept, np.zeros(1, np.int64)


def _links(dealt: DataFrame, radius: int, words: tuple[str, ...] = ("fp",)) -> DataFrame:
    """a, b: labels that links within the groups of ``dealt`` (key, part, label and the words of a fingerprint) join."""
    out = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, _, label, *fps), starts in _groups(batches, ["key", "part", "label", *words]):
            bits = np.stack(fps, 1).view(np.uint64)
            mixed = np.minimum.reduceat(label, starts) != np.maximum.reduceat(label, starts)
            ends = np.concatenate([starts[1:], [len(label)]])
            two = mixed & (ends - starts == 2)
            i = starts[two]
            i = i[np.bitwise_count(bits[i] ^ bits[i + 1]).sum(1, dtype=np.int64) <= radius]
            found = set(zip(label[i].tolist(), label[i + 1].tolist()))
            for a, b in zip(starts[mixed & ~two].tolist(), ends[mixed & ~two].tolist()):
                found.update(stars(bits[a:b], label[a:b], radius))
            if found:
                made = np.array(sorted(found), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], schema=out)

    spread = dealt.repartition(F.col("key"), F.col("part")).sortWithinPartitions("key", "part")
    return spread.mapInArrow(run, "a long, b long")


def linked(rounds: Rounds, fps: DataFrame, radius: int = 4) -> DataFrame:
    """fp, root: distinct fingerprints of ``fps`` (fp) and the smallest fingerprint reachable by links.

    ``radius`` is at most 4, for which the two halves suffice. Every link counts; nothing is capped.
    """
    if not 0 <= radius <= 4:
        raise ValueError("two segments with balls of radius 1 find up to 4 differing bits")
    high, low = _halves()
    nodes = rounds.keep(fps.select("fp").distinct())
    same_high = _dealt(nodes.select(high.alias("key"), "fp", F.col("fp").alias("label")), rounds, "fp", "label")
    first = components(rounds, _links(same_high, radius))
    labelled = rounds.keep(nodes.join(first, nodes.fp == first.node, "left")
                           .select("fp", F.coalesce("component", "fp").alias("label")))
    entries = labelled.select("fp", "label", F.explode(F.concat(_ball(high, 0), _ball(low, 1))).alias("key"))
    pairs = _links(_dealt(entries, rounds, "fp", "label"), radius)
    whole = components(rounds, pairs)
    return labelled.join(whole, labelled.label == whole.node, "left").select("fp", F.coalesce("component", "label").alias("root"))


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id (smallest doc_id reachable over links, its own included) of each row.

    Null and empty texts, and those of white space, have fingerprint 0 and link like any other. A null
    doc_id is never the smallest; a component of nulls alone has null. Repeated rows stay and share a
    component. Copies are reduced to distinct fingerprints by a combined aggregation, so a group of
    equal texts of any size costs one row a task.
    """
    rounds = Rounds(docs.sparkSession)
    rows = rounds.keep(fingerprints(docs, words))
    roots = rounds.keep(linked(rounds, rows))
    firsts = rounds.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    by_root = firsts.join(roots, "fp")
    least = rounds.keep(by_root.groupBy("root").agg(F.min("first").alias("component_id")))
    classes = rounds.keep(roots.join(least, "root").select("fp", "component_id"))
    return rows.join(classes, "fp").select("doc_id", "fp", "component_id")


def radius_for(similarity: float, bits: int = 256) -> int:
    """Differing bits of shingle fingerprints expected between sets of equal size with this share of common members, and 0.4
    standard deviations more. The near-duplicate stage does not use it; it compares whole sets."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * share + 0.4 * math.sqrt(bits * share * (1 - share)))


#: Segments of the stage's SimHash, bits of a segment, and the weakest bits of it over which its ball is enumerated. A pair of sets 0.8
#: alike meets in a segment with probability 0.147 (simulated), in none of them with 0.006.
SEGMENTS, SEGMENT_BITS, WEAK = 32, 28, 3
#: Least hashes that make one further key of a set. Sets 0.8 alike share none of the 9 keys with probability 0.009.
LEAST = 4
#: Differing bits of 128 further ones up to which two sets are compared: 4 standard deviations above the mean of sets 0.8 alike (19.4).
PRINT_RADIUS = 36
#: Largest band whose members are compared by those bits before their sets are read; larger ones go on whole.
SMALL_BAND = 64
#: Most rounds of comparing the members of a band with one of them before their sets are brought together; one that leaves over half
#: of the open members is the last.
PIVOTS = 2
#: Segments whose plain values give the first links, and the members from which on a linked group enters the balls as one node.
FIRM, HUB = 8, 16
_SEGMENT_WORDS = SEGMENTS * SEGMENT_BITS // 64
_draw = np.random.default_rng(20)
_TURNS = _draw.integers(0, 1 << 63, _SEGMENT_WORDS + 2, np.uint64) * np.uint64(2) + np.uint64(1)
_FLIPS = _draw.integers(0, 1 << 63, _SEGMENT_WORDS + 2, np.uint64)


def shingles(text: str, words: int = 5) -> np.ndarray:
    """Ascending distinct hashes of the shingles of a text. Fewer than ``words`` words are one shingle; none, no hash."""
    parts = text.encode().translate(_LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    n = max(1, len(parts) - words + 1)
    made = np.zeros(n, np.uint64)
    for k in range(min(words, len(parts))):  # an ordered sum of the hashes of its words
        made = (made ^ (made >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[k : k + n]
    made ^= made >> np.uint64(32)
    made *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(made ^ (made >> np.uint64(32)))


def segments(found: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The segments of the SimHash of a set of hashes, and 128 further bits as two signed longs; for an empty set no segment.

    A segment is a long: its bits, then the places (5 bits each) of its ``WEAK`` bits with the smallest majority.
    """
    return sketch(found)[:2]


def sketch(found: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """``segments``, and keys of ``LEAST`` least hashes each; the hashes whose bits are counted are also those of which the least are taken."""
    if not len(found):
        return np.zeros(0, np.int64), [0, 0], np.zeros(0, np.int64)
    set_in = np.zeros(len(_TURNS) * 64, np.int64)
    least = np.full((2, len(_TURNS)), (1 << 64) - 1, np.uint64)
    for k in range(0, len(found), 255):  # a byte holds the sum of 255 bits
        mixed = (found[k : k + 255, None] ^ _FLIPS) * _TURNS
        mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
        for half, part in zip(least, (mixed >> np.uint64(32), mixed & np.uint64(0xFFFFFFFF))):
            np.minimum(half, part.min(0), out=half)
        set_in += np.unpackbits(mixed.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    margin = 2 * set_in - len(found)
    rest = np.packbits(margin[_SEGMENT_WORDS * 64 :] > 0, bitorder="little").view("<i8")
    margin = margin[: _SEGMENT_WORDS * 64].reshape(SEGMENTS, SEGMENT_BITS)
    made = (margin > 0) @ (np.int64(1) << np.arange(SEGMENT_BITS))
    weak = np.argsort(np.abs(margin), axis=1, kind="stable")[:, :WEAK]
    for k in range(WEAK):
        made |= weak[:, k] << (SEGMENT_BITS + 5 * k)
    groups = least.reshape(-1, LEAST)
    keys = np.arange(len(groups), dtype=np.uint64)
    for value in groups.T:
        keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + value
    keys = (keys ^ (keys >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return made, rest.tolist(), keys.view(np.int64)


def _segment_key(segment: Column, number: Column) -> Column:
    return number.cast("long") * (1 << SEGMENT_BITS) + segment.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1).cast("long"))


def _weak_balls(segment: Column, number: Column) -> Column:
    """The keys of a segment: its bits under every flip of its weakest ones."""
    keys = [_segment_key(segment, number)]
    for k in range(WEAK):
        place = F.shiftrightunsigned(segment, SEGMENT_BITS + 5 * k).bitwiseAND(F.lit(31).cast("long")).cast("int")
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
        keys += [key.bitwiseXOR(bit) for key in keys]
    return F.array(*keys)


def _entries(nodes: DataFrame, parts: int) -> DataFrame:
    """node, key: ``SEGMENTS`` << ``WEAK`` rows of each node, and one of each key of its least hashes where ``nodes`` has them.
    Nodes are dealt to ``parts`` tasks first, so what a task holds for the shuffle after it does not follow from the size of a
    file of nodes."""
    balls = F.flatten(F.transform("segments", lambda segment, number: _weak_balls(segment, number)))
    keys = F.concat(balls, "least") if "least" in nodes.columns else balls
    return nodes.repartition(parts, "node").select("node", F.explode(keys).alias("key"))


def _bands(nodes: DataFrame) -> DataFrame:
    """key, node, low, high, size: the members of each key that several nodes enter, with the least and the greatest.

    Keys with the same members are one band. One shuffle of the entries; a large group is sorted and spilled, not held.
    """
    parts = 4 * shuffle_parts(nodes)
    entries = _entries(nodes, parts).repartition(parts, "key")
    all_of = Window.partitionBy("key")
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).over(all_of).alias(f"m{k}") for k in (0, 1)]
    shared = entries.select("key", "node", F.min("node").over(all_of).alias("low"), F.max("node").over(all_of).alias("high"),
                            F.count(F.lit(1)).over(all_of).alias("size"), *marks).where("low < high")
    return shared.select(F.xxhash64("low", "high", "size", "m0", "m1").alias("key"), "node", "low", "high", "size").distinct()


def _firm(nodes: DataFrame) -> DataFrame:
    """a, b: each node with the least and the greatest that has the same value of one of the first ``FIRM`` segments, if within
    ``PRINT_RADIUS`` bits. At most 2 * ``FIRM`` rows a node."""
    keys = nodes.select("node", F.posexplode(F.slice("segments", 1, FIRM)).alias("number", "segment")).select(
        "node", _segment_key(F.col("segment"), F.col("number")).alias("key"))
    all_of = Window.partitionBy("key")
    ends = keys.select("node", F.min("node").over(all_of).alias("low"), F.max("node").over(all_of).alias("high")).where("low < high")
    one, two = (nodes.select(F.col("node").alias(c), *[F.col(p).alias(f"_{c}{p}") for p in ("p0", "p1")]) for c in "ab")
    apart = sum(F.bit_count(F.col(f"_a{p}").bitwiseXOR(F.col(f"_b{p}"))) for p in ("p0", "p1"))
    return _ends(ends).join(one, "a").join(two, "b").where(apart <= PRINT_RADIUS).select("a", "b")


def _parted(raw: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of ``raw`` (see ``_bands``) that are not in ``heads`` (node), as bands of their own; and hub, node: the nodes
    that share a band with a head."""
    heads = few(heads)
    at = few(raw.join(heads, "node").select("key", F.col("node").alias("hub")))
    beside = raw.select("key", "node").join(at, "key").where("node <> hub").select("hub", "node").distinct()
    all_of = Window.partitionBy("key")
    rest = raw.join(heads, "node", "left_anti").select(
        "key", "node", F.min("node").over(all_of).alias("low"), F.max("node").over(all_of).alias("high"), F.count(F.lit(1)).over(all_of).alias("size"))
    return rest.where("low < high"), beside


def _hub_groups(whole: DataFrame, beside: DataFrame) -> DataFrame:
    """key, part, node, label: the members of each hub (``whole``: node, hub) with label hub, and the nodes ``beside`` it (hub, node)
    with their own. Chunks of members meet chunks of the others, ``CHUNK`` rows of each at most on average."""
    sizes = (whole.select("hub", F.lit(1).alias("m"), F.lit(0).alias("o")).unionByName(beside.select("hub", F.lit(0).alias("m"), F.lit(1).alias("o")))
             .groupBy("hub").agg(*[F.ceil(F.sum(c) / CHUNK).cast("int").alias(f"{c}s") for c in "mo"]).where("os > 0"))
    sizes = few(sizes)
    own = [F.pmod(F.xxhash64("node"), F.col(c).cast("long")).cast("int") for c in ("ms", "os")]
    members = whole.join(sizes, "hub").select(F.col("hub").alias("key"), F.explode(F.transform(
        F.sequence(F.lit(0), F.col("os") - 1), lambda j: own[0] * F.col("os") + j)).alias("part"), "node", F.col("hub").alias("label"))
    others = beside.join(sizes, "hub").select(F.col("hub").alias("key"), F.explode(F.transform(
        F.sequence(F.lit(0), F.col("ms") - 1), lambda i: i * F.col("os") + own[1])).alias("part"), "node", F.col("node").alias("label"))
    return members.unionByName(others)


def _close(bands: DataFrame) -> DataFrame:
    """Members of ``bands`` (key, node, n, p0, p1, low, high) that have another within ``PRINT_RADIUS`` bits in the same band."""
    names = ["key", "node", "n", "low", "high"]
    schema = ", ".join(f"{c} long" for c in names)
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (*own, _, p0, p1), starts in _groups(batches, ["key", "node", "n", "low", "high", "part", "p0", "p1"], 5):
            bits, ends = np.stack([p0, p1], 1).view(np.uint64), np.concatenate([starts[1:], [len(p0)]])
            stays = np.zeros(len(p0), bool)
            for size in np.unique(ends - starts).tolist():  # bands of one size at once
                if size > 1:
                    at = starts[ends - starts == size]
                    for k in range(0, len(at), max(1, (1 << 18) // size**2)):
                        rows = at[k : k + max(1, (1 << 18) // size**2), None] + np.arange(size)
                        apart = np.bitwise_count(bits[rows][:, :, None] ^ bits[rows][:, None]).sum(3, dtype=np.int64)
                        stays[rows] = (apart <= PRINT_RADIUS).sum(2) > 1
            if stays.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[stays]) for c in own], schema=out)

    spread = bands.withColumn("part", F.lit(0).cast("long")).repartition("key").sortWithinPartitions("key")
    return spread.mapInArrow(run, schema)


def near_sets(sets: list[np.ndarray], labels: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of labels that join what the links between these sets of hashes join: at most one less than there are labels.

    From each set in turn the sets of other labels that are alike are found by counting shared hashes in an inverted index;
    what is reached takes its label and is searched from next. Nothing is compared again once it is reached.
    """
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(codes, kind="stable")
    holders, starts = owners[order], np.searchsorted(codes[order], np.arange(len(values) + 1))
    edges = np.concatenate([[0], np.cumsum(sizes)])
    pairs: list[tuple[int, int]] = []
    left = np.ones(len(sets), bool)
    while left.any():
        mine = labels[int(left.argmax())]
        group = left & (labels == mine)
        left &= ~group
        queue = np.flatnonzero(group).tolist()
        while queue and left.any():
            i = queue.pop()
            shared = np.zeros(len(sets), np.int64)
            for c in codes[edges[i] : edges[i + 1]].tolist():
                shared[holders[starts[c] : starts[c + 1]]] += 1
            joined = np.unique(labels[left & (shared >= similarity * (sizes + sizes[i] - shared) - 1e-9)])
            if len(joined):
                pairs += [(int(mine), int(x)) for x in joined]
                group = left & np.isin(labels, joined)
                left &= ~group
                queue += np.flatnonzero(group).tolist()
    return pairs


def near_hub(sets: list[np.ndarray], labels: np.ndarray, similarity: float, hub: int) -> list[tuple[int, int]]:
    """Pairs of ``hub`` and each other label with a set that is alike one of the hub's; no other two sets are compared."""
    inside = np.flatnonzero(labels == hub)
    if not len(inside):
        return []
    sizes = np.fromiter((len(sets[i]) for i in inside), np.int64, len(inside))
    values, codes = np.unique(np.concatenate([sets[i] for i in inside]), return_inverse=True)
    holders = np.repeat(np.arange(len(inside)), sizes)[np.argsort(codes, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(values)))])
    pairs = []
    for i in np.flatnonzero(labels != hub).tolist():
        at = np.minimum(np.searchsorted(values, sets[i]), len(values) - 1)
        shared = np.zeros(len(inside), np.int64)
        for c in at[values[at] == sets[i]].tolist():
            shared[holders[starts[c] : starts[c + 1]]] += 1
        if (shared >= similarity * (sizes + len(sets[i]) - shared) - 1e-9).any():
            pairs.append((hub, int(labels[i])))
    return pairs


def _set_links(dealt: DataFrame, similarity: float, hubs: bool = False) -> DataFrame:
    """a, b: labels that links within the groups of ``dealt`` (key, part, label, hashes) join; with ``hubs`` only links with the
    label that is the key."""
    out = arrow_schema("a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[tuple[int, int], int, np.ndarray]] = []

        def links() -> Iterator[pa.RecordBatch]:
            labels = np.array([label for _, label, _ in held])
            sets, found = [h for _, _, h in held], []
            if len(set(labels.tolist())) > 1:
                found = near_hub(sets, labels, similarity, held[0][0][0]) if hubs else near_sets(sets, labels, similarity)
            if found:
                made = np.array(sorted(set(found)), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(made[:, 0]), pa.array(made[:, 1])], schema=out)

        for batch in batches:
            keys = list(zip(batch.column("key").to_pylist(), batch.column("part").to_pylist()))
            hashes = batch.column("hashes")
            for i, (at, label) in enumerate(zip(keys, batch.column("label").to_pylist())):
                if held and held[0][0] != at:
                    yield from links()
                    held.clear()
                held.append((at, label, hashes[i].values.to_numpy().copy()))
        if held:
            yield from links()

    spread = dealt.repartition(F.col("key"), F.col("part")).sortWithinPartitions("key", "part")
    return spread.mapInArrow(run, "a long, b long")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets (node, hashes) have at least this share of common members."""
    one, two = (sets.select(F.col("node").alias(c), F.col("hashes").alias(f"_{c}")) for c in "ab")
    both = F.size(F.array_intersect("_a", "_b"))
    return (pairs.join(one, "a").join(two, "b")
            .where(both >= F.lit(similarity) * (F.size("_a") + F.size("_b") - both) - 1e-9).select("a", "b"))


def _tried(members: DataFrame) -> DataFrame:
    """a, b: each node of ``members`` (node, low, high) with the least and the greatest node of all its bands, two pairs a node
    however many bands it is in. Most of a large group meets the same least node."""
    return _ends(members.groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high")))


def _ends(ends: DataFrame) -> DataFrame:
    """a, b: node and low, node and high of each row."""
    pairs = F.array(F.struct(F.col("low").alias("a"), F.col("node").alias("b")), F.struct(F.col("node").alias("a"), F.col("high").alias("b")))
    return ends.select(F.inline(pairs)).where("a < b").distinct()


def similar(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, _file, _row, group) of ``docs``, and the located documents.

    Texts link if their sets of ``words``-word shingles have a Jaccard similarity of ``similarity`` or
    more. Candidates come by multi-index hashing of a longer SimHash of the same shingles: a set is entered
    for each of ``SEGMENTS`` segments under the ball around it that its ``WEAK`` least certain bits span, and the members
    of an entry are a band; whether an edit is scattered or in one block makes no difference. A set is also entered under 9 keys of
    least hashes, for pairs that no segment brings together. In small bands
    members far from all others by 128 further bits leave. Every link is verified by the whole sets. Nodes with the same
    value of a segment are compared first, at most 2 * ``FIRM`` pairs a node; a group of ``HUB`` or more that these link, a hub, is one
    member of any band, and a node that shares a band with it is searched once among all its sets. Each other node is
    compared with the smallest and the largest node of its bands, then, in bands that are not connected yet, ``PIVOTS`` times
    with one other member: at most a row for each member. That settles groups of copies of any size.
    The members of bands that are still not connected go with their sets to one task for each band, which
    emits at most a link less than the band has labels; no pair is a row. Nothing is
    capped. Groups are what links connect. Null and empty texts have no shingle and form a group.
    """
    rounds = Rounds(docs.sparkSession)
    here = located(docs, rounds)

    def step(batch: pa.RecordBatch) -> dict[str, list]:
        found = [shingles(t, words) for t in texts(batch)]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in found], np.uint64).view(np.int64)
        made = list(map(sketch, found))
        return {c: batch.column(c) for c in ("doc_id", "_file", "_row")} | {
            "node": node, "n": list(map(len, found)), "segments": [m[0] for m in made], "p0": [m[1][0] for m in made],
            "p1": [m[1][1] for m in made], "least": [m[2] for m in made]}

    rows = rounds.keep(arrow_map(here.select("doc_id", "text", "_file", "_row"), step,
                                 "doc_id long, _file string, _row long, node long, n long, segments array<long>, p0 long, p1 long, least array<long>"))
    # A node is a set of shingles; its number is a hash of the whole set.
    held = ["n", "segments", "p0", "p1", "least"]
    nodes = rounds.keep(rows.groupBy("node").agg(F.min(F.struct("_file", "_row", *held)).alias("at")).select("node", "at.*"))

    def gather(batch: pa.RecordBatch) -> dict[str, list]:
        return {"node": batch.column("node"), "hashes": [shingles(t, words).view(np.int64) for t in texts(batch)]}

    def gathered(some: DataFrame) -> DataFrame:
        wanted = rounds.keep(nodes.join(some.distinct(), "node", "left_semi").select("node", "_file", "_row"))
        return rounds.keep(arrow_map(here.select("text", "_file", "_row").join(few(wanted), ["_file", "_row"]).select("node", "text"),
                                     gather, "node long, hashes array<long>"))

    firm = rounds.keep(_firm(nodes))
    sets = gathered(firm.select(F.explode(F.array("a", "b")).alias("node")))
    links = rounds.keep(_alike(firm, sets, similarity))
    groups = rounds.keep(components(rounds, links).withColumnRenamed("component", "hub"))
    whole = rounds.keep(groups.join(few(groups.groupBy("hub").count().where(F.col("count") >= HUB).select("hub")), "hub").select("node", "hub"))
    merged = nodes.join(few(whole.withColumnRenamed("node", "_node")), F.col("node") == F.col("_node"), "left")
    raw = rounds.keep(_bands(merged.select(F.coalesce("hub", "node").alias("node"), "segments", "least")))
    rest, beside = _parted(raw, rounds.keep(whole.select(F.col("hub").alias("node")).distinct()))
    # Of two hubs that meet, the members of the smaller number go to the other.
    other = whole.select(F.col("node").alias("_member"), F.col("hub").alias("_hub"))
    beside = beside.join(few(other), F.col("node") == F.col("_hub"), "left").where("_hub is null or _hub < hub")
    beside = rounds.keep(beside.select("hub", F.coalesce("_member", "node").alias("node")))
    bands = rounds.keep(rest.join(nodes.select("node", "n", "p0", "p1"), "node"))
    members = rounds.keep(_close(bands.where(F.col("size") <= SMALL_BAND)).unionByName(
        bands.where(F.col("size") > SMALL_BAND).select("key", "node", "n", "low", "high")))
    sets = sets.unionByName(gathered(members.select("node").unionByName(beside.select("node")).join(sets.select("node"), "node", "left_anti")))
    met = _set_links(_hub_groups(whole, beside).join(sets, "node").select("key", "part", "label", "hashes"), similarity, True)
    links = rounds.keep(links.unionByName(met).unionByName(_alike(rounds.keep(_tried(members)), sets, similarity)))
    still = 0
    for turn in range(PIVOTS + 1):
        first = components(rounds, links).withColumnRenamed("node", "_node")
        labelled = rounds.keep(members.join(few(first), members.node == first._node, "left").select(
            "key", "node", "n", F.coalesce("component", "node").alias("label")))
        mixed = rounds.keep(labelled.groupBy("key").agg(
            F.min("label").alias("l"), F.max("label").alias("h"),
            F.min_by(F.struct("node", "label", "n"), F.xxhash64("node", F.lit(turn))).alias("pivot")).where("l < h").select("key", "pivot"))
        members = rounds.keep(labelled.join(few(mixed), "key"))
        before, still = still, members.count()
        if turn == PIVOTS or not still or turn and 2 * still > before:
            break
        size = F.least("n", "pivot.n") >= similarity * F.greatest("n", "pivot.n") - 1e-9
        ends = members.where((F.col("label") != F.col("pivot.label")) & size).select(
            F.least("node", "pivot.node").alias("a"), F.greatest("node", "pivot.node").alias("b"))
        links = rounds.keep(links.unionByName(_alike(rounds.keep(ends.distinct()), sets, similarity)))
        members = members.select("key", "node", "n")
    dealt = _dealt(members.select("key", "node", "label"), rounds, "node", "label")
    more = _set_links(dealt.join(sets, "node").select("key", "part", "label", "hashes"), similarity)
    whole = components(rounds, links.unionByName(more)).withColumnRenamed("node", "_node")
    found = rows.select("doc_id", "_file", "_row", "node")
    return found.join(few(whole), found.node == whole._node, "left").select(
        "doc_id", "_file", "_row", F.coalesce("component", "node").alias("group")), here


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, without near-duplicates: of each group the smallest doc_id stays, the first place
    in the files among equal ones; null ids go before others do."""
    rows, here = similar(docs, words, similarity)
    rounds = Rounds(docs.sparkSession)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_file", "_row")
    rows = rounds.keep(rows)
    stays = rounds.keep(rows.groupBy("group").agg(F.min(rank).alias("k"), F.count(F.lit(1)).alias("n")).where("n > 1")
                        .select("group", F.col("k._file").alias("keep_file"), F.col("k._row").alias("keep_row")))
    gone = rounds.keep(rows.join(stays, "group").where("_file <> keep_file or _row <> keep_row").select("_file", "_row"))
    return here.join(few(gone, BROADCAST_ROWS), ["_file", "_row"], "left_anti").select(*restored(neutral(docs, "doc_id", "text")))


def hexadecimal(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
