"""Fill-in-middle: texts cut in prefix, middle and suffix at unit boundaries that a wavelet matrix locates.

The bytes of all texts of a run of rows are classed (below) and put in one wavelet matrix; a text is a
range of it. A unit ends after a byte of one of the unit's closing classes, so the number of units is a
difference of summed ranks, the end of the k-th unit a select (one class) or a bisection on summed ranks
(several), and the code points of a piece its bytes without the continuation bytes among them.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landrecon.llm.frames import arrow_map, plain
from landrecon.llm.wavelet import WaveletMatrix

CONTINUED, LEADING, LETTER, OTHER, NEWLINE, SPACE, BLANK, MARK = range(8)
LEVELS = 3
_CLASS = np.full(256, OTHER, np.uint8)
for _bytes, _class in ((range(0x80, 0xC0), CONTINUED), (range(0xC0, 0x100), LEADING), (b"\n", NEWLINE), (b" ", SPACE), (b"\t\x0b\x0c\r", BLANK),
                       (b".!?", MARK), (b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", LETTER)):
    _CLASS[list(_bytes)] = _class
#: Classes after which a unit ends. A code point ends before the next byte that is no continuation.
UNITS = {"line": (NEWLINE,), "word": (NEWLINE, SPACE, BLANK), "sentence": (NEWLINE, MARK),
         "char": (LEADING, LETTER, OTHER, NEWLINE, SPACE, BLANK, MARK)}
SENTINELS = ("<P>", "<S>", "<M>")


class Boundaries:
    """Units of the texts ``data[starts[i]:ends[i]]``."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, unit: str):
        self.starts, self.ends, self.unit, self.closing = starts, ends, unit, UNITS[unit]
        self.matrix = WaveletMatrix(_CLASS[data], LEVELS)
        self.before = self.matrix.ranks(self.closing, starts)
        self.closed = self.matrix.ranks(self.closing, ends) - self.before
        open_end = np.zeros(len(starts), bool)
        if unit != "char" and len(data):
            open_end = (ends > starts) & ~np.isin(_CLASS[data[np.maximum(ends - 1, 0)]], self.closing)
        self.count = self.closed + open_end

    def after(self, k: np.ndarray) -> np.ndarray:
        """Where the first k units of each text end."""
        at = np.where(k > 0, self.ends, self.starts)
        inside = (k > 0) & ((k < self.closed) if self.unit == "char" else (k <= self.closed))
        if inside.any():
            found = self.matrix.selects(self.closing, (self.before + k)[inside] - (self.unit != "char"))
            at[inside] = found + (self.unit != "char")
        return at

    def chars(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Code points from a to b."""
        continued = self.matrix.rank(CONTINUED, b) - self.matrix.rank(CONTINUED, a)
        return b - a - continued


def _draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


def transform(docs: DataFrame, unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50,
              sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output of each row's whole text.

    Both cuts and the form are drawn from a digest of the seed and the doc_id (a null id counts as an
    empty one), so a row gives the same in any partitioning, and repeated rows give the same each.
    ``rate`` of 100 texts are cut, ``spm`` of 100 of these put the suffix first. A text that is empty,
    null or contains a sentinel stays plain, with null for the pieces. A text of any length is one range
    of its run's matrix, at about twice its bytes. Nothing is shuffled. Further columns are not read.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    marks = [s.encode() for s in sentinels]

    def step(batch: pa.RecordBatch) -> dict[str, list]:
        column = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
        edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        held = column.buffers()[2]
        data = np.frombuffer(held, np.uint8)[edges[0] : edges[-1]] if held is not None else np.zeros(0, np.uint8)
        raw, edges = data.tobytes(), edges - edges[0]
        units = Boundaries(data, edges[:-1], edges[1:], unit)
        draws = np.array([_draws(i, seed) for i in batch.column("doc_id").to_pylist()], np.int64).reshape(-1, 4)
        first, second = draws[:, 0] % (units.count + 1), draws[:, 1] % (units.count + 1)
        one, two = units.after(np.minimum(first, second)), units.after(np.maximum(first, second))
        before, middle = units.chars(edges[:-1], one), units.chars(one, two)
        made: dict[str, list] = {c: [] for c in ("form", "prefix_chars", "middle_chars", "output")}
        for i, (a, b, c, d) in enumerate(zip(edges[:-1].tolist(), one.tolist(), two.tolist(), edges[1:].tolist())):
            text = raw[a:d]
            whole = not text or draws[i, 2] % 100 >= rate or any(m in text for m in marks)
            form = "plain" if whole else "spm" if draws[i, 3] % 100 < spm else "psm"
            pieces = {"plain": [text], "psm": [marks[0], raw[a:b], marks[1], raw[c:d], marks[2], raw[b:c]],
                      "spm": [marks[1], raw[c:d], marks[0], raw[a:b], marks[2], raw[b:c]]}[form]
            values = (form, None if whole else int(before[i]), None if whole else int(middle[i]), b"".join(pieces))
            for name, value in zip(made, values):
                made[name].append(value)
        return {"doc_id": batch.column("doc_id"), "n": units.count} | made

    return arrow_map(plain(docs, "doc_id", "text"), step,
                     "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form", sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of ``transform`` was made of. The pieces of a cut text hold no sentinel, so its marks are unique."""
    p, s, m = (re.escape(x) for x in sentinels)
    psm, spm = F.split(output, f"{p}|{s}|{m}"), F.split(output, f"{s}|{p}|{m}")
    return (F.when(F.col(form) == "psm", F.concat(psm[1], psm[3], psm[2]))
            .when(F.col(form) == "spm", F.concat(spm[2], spm[3], spm[1])).otherwise(F.col(output)))


def digests(docs: DataFrame, unit: str = "line") -> DataFrame:
    """``transform`` with digests of the output and of the text restored from it, in place of the output."""
    made = transform(docs, unit)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(restored(), 256).alias("restored_sha256"))


SQL = r"""
    WITH lines AS (
      SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
             sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
      FROM documents),
    drawn AS (
      SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS c1,
             ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS c2, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS h4
      FROM lines),
    cut AS (
      SELECT *, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
             array_to_string(u[greatest(c1, c2) + 1:], '') AS s,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                  WHEN h4 < 50 THEN 'spm' ELSE 'psm' END AS form
      FROM drawn)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
           CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                            ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
    FROM cut"""
