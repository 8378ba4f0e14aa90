import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from landrecon.llm import fill_middle
from landrecon.llm.wavelet import WaveletMatrix

PATTERN = {"line": r"[^\n]*\n|[^\n]+", "word": r"[^ \t\n\r\x0b\x0c]*[ \t\n\r\x0b\x0c]|[^ \t\n\r\x0b\x0c]+",
           "sentence": r"[^.!?\n]*[.!?\n]|[^.!?\n]+", "char": r"(?s)."}


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 7), max_size=300))
def test_rank_and_select(values):
    matrix, at = WaveletMatrix(np.array(values, np.uint8), 3), np.arange(len(values) + 1)
    for of in ([0], [3], [7], [1, 4], [0, 2, 5, 6]):
        places = [i for i, v in enumerate(values) if v in of]
        assert matrix.ranks(of, at).tolist() == [sum(p < i for p in places) for i in at]
        assert matrix.selects(of, np.arange(len(places))).tolist() == places


def plain(doc_id, text, unit, rate, spm, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall(PATTERN[unit], text)
    hexed = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(hexed[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in marks) or h[2] % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return doc_id, len(units), "spm", len(p), len(m), marks[1] + s + marks[0] + p + marks[2] + m
    return doc_id, len(units), "psm", len(p), len(m), marks[0] + p + marks[1] + s + marks[2] + m


@pytest.mark.parametrize("unit, rate, spm", [("line", 100, 50), ("word", 70, 100), ("sentence", 100, 0), ("char", 100, 50)])
def test_cuts_and_restores(docs, odd, unit, rate, spm):
    rows = odd + [(30 + i, t) for i, t in enumerate(
        ["\n", "\n\n\n", "a\n\nb", "no end", "end\n", "has <P> mark\nx", "<<S\n>", "<M", "é\n日本\n\U0001f600", "One. Two! Three?\nFour",
         "line é\n" * 40000, "\r\n\x00\n\x85\n ", "<\nP>\n<S\n>", *["same\ntext\n"] * 3])]
    made = fill_middle.transform(docs(rows), unit, rate=rate, spm=spm).withColumn("back", fill_middle.restored())
    got = made.collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted((plain(i, t, unit, rate, spm) for i, t in rows), key=key)
    assert sorted(((r.doc_id, r.back) for r in got), key=key) == sorted(((i, t or "") for i, t in rows), key=key)


def test_other_sentinels_and_empty_table(docs):
    marks = ("(pre)", "[suf]", "|mid|")
    made = fill_middle.transform(docs([(1, "a\nb\nc\n<P>"), (2, "x(pre)")]), sentinels=marks)
    back = made.select("doc_id", "form", fill_middle.restored(sentinels=marks).alias("t")).collect()
    assert {(r.doc_id, r.t) for r in back} == {(1, "a\nb\nc\n<P>"), (2, "x(pre)")} and {r.form for r in back if r.doc_id == 2} == {"plain"}
    assert fill_middle.digests(docs([])).count() == 0
    with pytest.raises(ValueError):
        fill_middle.transform(docs([]), "page")


def test_clashing_columns(docs):
    rows = docs([(1, "a\nb")]).withColumn("form", F.lit("x")).withColumn("output", F.lit(1)).withColumn("n", F.lit(2))
    assert fill_middle.transform(rows).count() == 1
