"""Fill-in-middle: each text is cut at two random places, and its middle is moved behind its suffix.

A text is stored as runs of one class: stretches in which every unit takes the same number of bytes,
with the units and bytes before each run.  For characters the classes are the widths of UTF-8, so an
English text is a handful of runs; for words they are the words and the white space between them.
A cut after so many units is then found without counting through the text: a binary search gives the
run, and the rest is arithmetic.

Defined cases: a null text is like an empty one, which is left plain; so is a text that holds a
sentinel; cuts may fall together, so that parts are empty; a null id is hashed as an empty text;
repeated rows are cut alike; texts of any length are taken whole and an empty table gives no rows;
other columns are carried along in ``doc``, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Bytes that separate words.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


class Runs(NamedTuple):
    """Runs of one class: the units and bytes before each run, with the whole sums last, and the bytes of a unit."""

    units: np.ndarray
    bytes: np.ndarray
    width: np.ndarray

    @property
    def n(self) -> int:
        return int(self.units[-1])

    def offset(self, unit: int) -> int:
        """The bytes before a unit."""
        k = int(np.searchsorted(self.units, unit, "right")) - 1
        return int(self.bytes[k] + (unit - self.units[k]) * self.width[k]) if k < len(self.width) else int(self.bytes[-1])


def _runs(lengths: np.ndarray, repeats: np.ndarray) -> Runs:
    before = lambda x: np.concatenate([[0], np.cumsum(x)])
    return Runs(before(repeats), before(repeats * lengths), lengths)


def character_runs(text: bytes) -> Runs:
    """Code points: the runs of equal width in UTF-8."""
    if text.isascii():
        return _runs(np.ones(1, np.int64), np.array([len(text)])) if text else _runs(np.zeros(0, np.int64), np.zeros(0, np.int64))
    heads = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
    width = np.diff(np.append(heads, len(text)))
    first = np.flatnonzero(np.diff(width, prepend=0))
    return _runs(width[first], np.diff(np.append(first, len(width))))


def word_runs(text: bytes) -> Runs:
    """Words and the white space between them: each run is one unit."""
    kind = SPACE[np.frombuffer(text, np.uint8)].astype(np.int8)
    first = np.flatnonzero(np.diff(kind, prepend=-1))
    return _runs(np.diff(np.append(first, len(kind))), np.ones(len(first), np.int64))


RUNS = {"characters": character_runs, "words": word_runs}


def drawn(id_col: str, seed: str) -> list[Column]:
    """The first four unsigned 32-bit numbers of the SHA-256 of ``seed:id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, k, 8), 16, 10).cast("bigint") for k in (1, 9, 17, 25)]


def infilled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: str = "characters", rate: int = 90, spm_rate: int = 20, seed: str = "1", sentinels: tuple[str, str, str] = SENTINELS, carried: Column | None = None) -> DataFrame:
    """(doc, n, form, prefix_chars, middle_chars, output) of each row; ``doc`` holds the row's columns, or what is ``carried`` instead.

    ``rate`` per cent of the texts are cut, and of these ``spm_rate`` per cent put the suffix first
    (form spm: suffix, prefix, middle), the others the prefix (psm: prefix, suffix, middle).
    """
    h1, h2, h3, h4 = drawn(id_col, seed)
    rows = docs.select((F.struct("*") if carried is None else carried).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), h1.alias("h1"), h2.alias("h2"), (h3 % 100 < rate).alias("cut"), (h4 % 100 < spm_rate).alias("spm"))
    encode, (p, s, m) = RUNS[units], [x.encode() for x in sentinels]

    def characters(part: bytes) -> int:
        return len(part) if part.isascii() else int(np.count_nonzero((np.frombuffer(part, np.uint8) & 0xC0) != 0x80))

    def one(text: bytes, h1: int, h2: int, cut: bool, spm: bool) -> tuple:
        runs = encode(text)
        if not cut or not text or p in text or s in text or m in text:
            return runs.n, "plain", None, None, text
        low, high = sorted((h1 % (runs.n + 1), h2 % (runs.n + 1)))
        a, b = runs.offset(low), runs.offset(high)
        parts = (s, text[b:], p, text[:a]) if spm else (p, text[:a], s, text[b:])
        middle = text[a:b]
        sizes = (low, high - low) if units == "characters" else (characters(text[:a]), characters(middle))
        return runs.n, "spm" if spm else "psm", *sizes, b"".join((*parts, m, middle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        for batch in batches:
            texts, numbers = batch.column("text").cast(pa.binary()), [batch.column(c).to_pylist() for c in ("h1", "h2", "cut", "spm")]
            found = [one(t.as_py(), *rest) for t, *rest in zip(texts, *numbers)]
            columns = list(zip(*found)) if found else [()] * 5
            output = pa.array(columns[4], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *[pa.array(c, k) for c, k in zip(columns, kinds)], output], ["doc", "n", "form", "prefix_chars", "middle_chars", "output"])

    doc = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {doc}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``infilled`` made ``output`` of: no part of it holds a sentinel, so these tell the parts."""
    parts = F.split(output, "|".join(map(re.escape, sentinels)))
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))
