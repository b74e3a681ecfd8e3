"""What the classifiers share: bounded samples of labelled rows, and word hashes in numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that ASCII letters, digits and everything beyond ASCII take: words are runs of them.
IN_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
VALUE = np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64)
POWER = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64))


def fold(id_col: str, parts: int) -> Column:
    """The remainder of the checksum of a row's id as text; null ids are in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(parts)), F.lit(0))


def below(most: int, n: int) -> int:
    """The signed 64-bit number that a share most / n of uniform 64-bit hashes is below; exact for any ``n``."""
    return -(1 << 63) + (most << 64) // n


def sampled(rows: DataFrame, id_col: str, most: int) -> DataFrame:
    """The rows of about ``most`` ids at most, chosen by a 64-bit hash of the id; all rows if they are fewer."""
    n = rows.count()
    return rows if n <= most else rows.where(F.xxhash64(F.col(id_col).cast("string"), F.lit("sample")) < F.lit(below(most, n)))


def once_each(rows: DataFrame, id_col: str, columns: Sequence[str]) -> DataFrame:
    """``columns`` of one row for each id, the least, so that an id that repeats cannot swell a sample."""
    return rows.groupBy(F.col(id_col).alias("_of")).agg(F.min(F.struct(*columns)).alias("_row")).select("_row.*")


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, learn: Column, most: int) -> DataFrame:
    """(id, text, label) of about ``most`` labelled documents at most, among the ids that ``learn`` admits.

    Of several labels of an id the largest counts, of several texts the least; null labels, ids and
    texts are left out.  The sampled ids, bounded by ``most``, are broadcast.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & learn)
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    known = sampled(known, "id", most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    return once_each(texts.join(F.broadcast(known), "id"), "id", ["id", "text", "label"])


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order."""
    b = np.frombuffer(text, np.uint8)
    inside = IN_WORD[b]
    edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    letters = b[inside]
    size = ends - starts
    first = np.cumsum(size) - size
    place = np.arange(len(letters)) - np.repeat(first, size)
    h = np.add.reduceat(VALUE[letters] * POWER[place & 63], first)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))
