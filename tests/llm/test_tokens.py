import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from landrecon.llm import bpe, piece_table, range_coder, token_files

RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t'sabc12.,é"))))
def test_ids_are_those_of_the_libraries(text):
    with open(RANKS, "rb") as f:
        ranks = test_ids_are_those_of_the_libraries.__dict__.setdefault(
            "ranks", {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    own = test_ids_are_those_of_the_libraries.__dict__.setdefault(
        "own", tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    codec = bpe.Codec.of(RANKS, P.PATTERN)
    ids = codec.encode(text)
    assert ids == own.encode_ordinary(text) and codec.decode(ids) == text.encode()
    whole = test_ids_are_those_of_the_libraries.__dict__.setdefault("json", Tokenizer.from_file(JSON))
    whole.encode_special_tokens = True
    expected = whole.encode(text, add_special_tokens=False).ids + [0]
    for _ in range(2):  # resolved, then remembered
        ids, counts = token_files.LibraryEncoder.of(JSON).encode(pa.array(["", text, None, text]), 0)
        assert ids.tolist() == [0, *expected, 0, *expected] and counts.tolist() == [1, len(expected), 1, len(expected)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\0x", max_size=40)), st.integers(0, 9))
def test_pieces_are_told_apart_and_forgotten(texts, kept):
    table = piece_table.PieceTable(lambda piece: np.frombuffer(piece.encode(), np.uint8).astype("<u4").tobytes(), kept)
    for _ in range(2):
        ids, counts = table.encode(pa.array(["zz", *texts]).slice(1))
        assert bytes(ids.tolist()).decode() == "".join(texts) and counts.tolist() == [len(t.encode()) for t in texts]
    assert table.entries <= kept


def test_pieces_keep_the_pre_tokens():
    import regex

    for text in ("a\n \nb c", "a \nb", "a\t b", "a b\nc d", "a\u3000 b c", " a  b", "a b"):
        first, *rest = bpe.pieces(text)
        found = [w for p in [first, *(" " + r for r in rest)] for w in regex.findall(P.PATTERN, p)]
        assert found == regex.findall(P.PATTERN, text)


def test_perfect_hash_uses_every_place():
    keys = [str(i).encode() for i in range(5000)]
    table = bpe.MinimalPerfectHash(keys)
    assert sorted(table.index) == list(range(5000))
    assert [table.lookup(k) for k in keys] == list(range(5000))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(0, 1100), max_size=4), st.integers(1, 17), st.integers(0, 99))
def test_blocks_round_trip(lengths, bits, seed):
    n = np.array(lengths, np.int64)
    ids = np.random.default_rng(seed).integers(0, 1 << bits, n.sum())
    assert (range_coder.decode(range_coder.encode(ids, n), n) == ids).all()


def test_repeats_are_coded_short():
    ids = np.tile(np.arange(40), 100)
    assert len(range_coder.encode(ids, np.array([4000]))[0]) < 4000


def test_digests_of_odd_texts(docs, odd, library):
    found = sorted(map(tuple, bpe.digests(docs(odd), RANKS, P.PATTERN).collect()), key=repr)
    expected = []
    for i, t in odd:
        ids = library.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256((t or "").encode()).hexdigest(), len((t or "").encode())))
    assert found == sorted(expected, key=repr)
    back = bpe.decode(bpe.encode(docs(odd), RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((i, t or "") for i, t in odd), key=repr)


def test_files_hold_all_ids_in_order(spark, docs, odd, tmp_path):
    whole = Tokenizer.from_file(JSON)
    whole.encode_special_tokens = True
    rows = sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    folder = str(tmp_path / "ids")
    token_files.write(docs(odd).repartition(5), folder, JSON)
    expected, start = [], 0
    for i, t in rows:
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        expected.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_files.positions(spark, folder).collect()), key=repr) == sorted(expected, key=repr)
    assert sum(len(r.ids) for r in token_files.read(spark, folder).collect()) == start


def test_added_tokens_have_their_ids(spark, docs, odd, tmp_path):
    whole = Tokenizer.from_file(JSON)
    end = "<|endoftext|>"
    rows = [(i, t) for i, (_, t) in enumerate(odd)] + [(100 + k, t) for k, t in enumerate(
        [f"end{end}next", end, end * 3, f"a {end} b", f"a  {end}  b", f"x \n{end}\n y", f" {end}", f"{end} ", "<|endoftext", f"it's{end}'s <|{end}|>"])]
    folder = str(tmp_path / "ids")
    token_files.write(docs(rows), folder, JSON, added=True)
    found = {r.doc_id: list(r.ids) for r in token_files.read(spark, folder).collect()}
    assert found == {i: whole.encode(t or "", add_special_tokens=False).ids + [0] for i, t in rows}
    assert found[100][1] == 50256 and len(found[100]) == 4


def test_empty_table(spark, docs, tmp_path):
    folder = str(tmp_path / "ids")
    token_files.write(docs([]), folder, JSON)
    assert token_files.positions(spark, folder).count() == 0
    assert bpe.digests(docs([]), RANKS, P.PATTERN).count() == 0


def test_damage_is_noticed(spark, docs, tmp_path):
    folder = str(tmp_path / "ids")
    token_files.write(docs([(1, "some words here")]), folder, JSON)
    from pyspark.sql import functions as F

    spark.read.parquet(folder).withColumn("payload", F.lit(b"\0\0\0\0" * 20)).write.parquet(folder + "2")
    with pytest.raises(Exception, match="checksum"):
        token_files.positions(spark, folder + "2").collect()


def test_blocks_with_a_prior_beat_deflate():
    """Blocks of a segment with its stored prior are smaller than the same blocks of 16-bit ids under zlib, and read back."""
    rng = np.random.default_rng(4)
    words = rng.zipf(1.3, 200_000) % 30_000
    words[1::3] = (words[::3][: len(words[1::3])] * 7 + 11) % 30_000  # some ids follow from the one before
    ids = words.astype(np.uint32)
    half = 98 * range_coder.BLOCK
    n = np.array([range_coder.BLOCK] * 98 + [range_coder.BLOCK] * 97 + [len(ids) - half - 97 * range_coder.BLOCK])
    priors, of = [range_coder.Prior.of(ids[:half]), range_coder.Prior.of(ids[half:])], np.repeat([0, 1], 98)
    coded = range_coder.encode(ids, n, priors, of)
    read = [range_coder.Prior.unpack(p.pack()) for p in priors]
    assert (range_coder.decode(coded, n, read, of) == ids).all()
    assert (range_coder.decode(coded[100:102], n[100:102], read, of[100:102]) == ids[100 * 1024 : 102 * 1024]).all()  # any block alone
    size = sum(map(len, coded)) + sum(len(p.pack()) for p in priors)
    assert size < sum(len(zlib.compress(ids[k : k + 1024].astype("<u2").tobytes(), 9)) for k in range(0, len(ids), 1024))
    for odd in ([5], [0, 0, 0], [131071], list(range(131071, 130000, -1))):
        one = np.array(odd, np.uint32)
        p, m = [range_coder.Prior.of(one)], np.array([len(one)])
        back = [range_coder.Prior.unpack(p[0].pack())]
        assert (range_coder.decode(range_coder.encode(one, m, p), m, back) == one).all()
