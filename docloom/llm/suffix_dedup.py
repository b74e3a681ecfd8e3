"""Suffix-array de-duplication: removes every byte that a repeated string of ``length`` bytes covers.

A suffix array of all texts would be many times the input, so suffixes are sorted only where a
repeat is possible.  Every window of ``length`` bytes has an anchor, its ``gram``-byte string of
least hash, which depends on the window's content alone: equal windows have equal anchors at equal
offsets.  About one position in sixty is an anchor and stands for the run of windows that it
anchors (its context).

1. Anchors whose string occurs once cannot lie in a repeat: a count by hash drops them.
2. Contexts that occur again whole are a class, told by 64 bits of a hash of the anchor's string and 64 of one of the
   context's bytes.  One copy of each goes into the sort and stands for all, with their number.
3. The suffixes at the windows of the contexts of one anchor string are sorted (deep-shallow, see ``suffixes``).
   Windows that share ``length`` bytes with a neighbour in that order repeat, and those of a context that
   stands for several have their copies as neighbours.  What the sort finds of a class holds for all its members.

Anchor strings are dealt to tasks by their hash.  One with over ``part`` occurrences is dealt to
several tasks by a salt of the row, each of which sorts its part in the same way and passes on one
window of each kind; these are put together by their bytes, counts aggregated before the shuffle.
So no task gets a frequent passage whole, and nothing else depends on ``part``.

Texts cross the network compressed.  Counts are aggregated before each shuffle, and what is joined
against has been written, so that skewed keys can be split.

Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; texts of any length
are taken whole, in pieces that overlap; repeated rows are copies of each other and lose all covered
bytes, as all copies do; equal windows are ties and all go; an empty table gives no rows; columns
other than the two named are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.shared import row_key, scratch, written
from docloom.llm.suffixes import SHALLOW, repeated

#: Bytes whose windows are anchored at a time: positions take the low 18 bits of a key.
PIECE = 1 << 18
LOW = np.uint64(PIECE - 1)
#: Windows sorted at a time, about.
SORTED = 300_000
#: Texts that are Python bytes at a time.
ROWS = 500
#: Bits of a row's tag.
TAGS = (1 << 24) - 1


class _Hash:
    """Polynomial hashes of substrings modulo 2^64, over random byte values."""

    def __init__(self, seed: int = 20_200, base: int = 0x9E3779B97F4A7C15):
        self.value = np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)
        self.power, self.inverse = (self._powers(b) for b in (base, pow(base, -1, 1 << 64)))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        out = np.full(PIECE + 1, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def sums(self, buf: np.ndarray) -> np.ndarray:
        out = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.value[buf] * self.power[: len(buf)], out=out[1:])
        return out


def _mix(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return a ^ (a >> np.uint64(32))


def anchors(hashing: _Hash, buf: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, gram: int):
    """(lo, hi, key, context): runs of windows lo..hi of one anchor, for windows that start in first[i]..last[i]."""
    sums = hashing.sums(buf)
    own = _mix((sums[gram:] - sums[:-gram]) * hashing.inverse[: len(buf) - gram + 1])
    least, span, wide = (own & ~LOW) | np.arange(len(own), dtype=np.uint64), 1, length - gram + 1
    while span < wide:
        step = min(span, wide - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    inside = np.zeros(len(buf) + 1, np.int32)
    np.add.at(inside, first, 1)
    np.add.at(inside, last + 1, -1)
    p = np.flatnonzero(np.cumsum(inside)[: len(least)])
    x = (least[p] & LOW).astype(np.int64)
    cut = np.flatnonzero((np.diff(x) != 0) | (np.diff(p) != 1)) + 1
    cut = cut[:0] if not len(p) else cut
    a, b = np.concatenate([np.zeros(min(1, len(p)), np.int64), cut]), np.concatenate([cut, np.full(min(1, len(p)), len(p))]) - 1
    lo, hi, x = p[a], p[b], x[a]
    view, digest = memoryview(buf), xxhash.xxh3_64_intdigest
    context = [digest(view[a:b], seed) for a, b, seed in zip(lo.tolist(), (hi + length).tolist(), (x - lo).tolist())]
    return lo, hi, own[x], np.array(context, np.uint64)


def _pieces(texts: list[bytes], length: int):
    """(buffer, text numbers, offsets of the buffer's parts in their texts, first windows, last windows).

    Short texts share a buffer; a long one takes several that overlap by a window less a byte.
    """
    parts, filled = [], 0
    for k, t in enumerate(texts):
        at = 0
        while len(t) - at >= length:
            if filled + length > PIECE:
                yield _joined(parts, length)
                parts, filled = [], 0
            take = t[at : at + PIECE - filled]
            parts.append((k, at, take))
            filled += len(take)
            if at + len(take) == len(t):
                break
            at += len(take) - length + 1
    if parts:
        yield _joined(parts, length)


def _joined(parts, length):
    size = np.array([len(t) for _, _, t in parts])
    first = np.cumsum(size) - size
    return np.frombuffer(b"".join(t for _, _, t in parts), np.uint8), np.array([k for k, _, _ in parts]), np.array([a for _, a, _ in parts]), first, first + size - length


def _named(docs: DataFrame, carried: Column, text_col: str) -> DataFrame:
    """(row, tag, id, text): id is ``carried``; 64 and 24 bits of hashes name a row.  Equal rows share them and have equal results."""
    own = row_key(carried.alias("id"))
    tag = F.crc32(F.concat(own, F.coalesce(text_col, F.lit("")))).bitwiseAND(F.lit(TAGS)).cast("int")
    return docs.select(F.xxhash64(own, text_col).alias("row"), tag.alias("tag"), carried.alias("id"), F.col(text_col).alias("text"))


def _schema(named: DataFrame, more: str) -> T.StructType:
    """Of rows that begin with (row, tag, id)."""
    return T.StructType([*named.schema.fields[:3], *T.StructType.fromDDL(more).fields])


def _packed(named: DataFrame) -> DataFrame:
    """(row, tag, id, z): the whole text compressed, null for a null text."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            z = [None if t is None else pack(t) for t in (x.as_py() for x in b.column(3).cast(pa.binary()))]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(z, pa.binary())], ["row", "tag", "id", "z"])

    return named.mapInArrow(run, _schema(named, "z binary"))


def anchor_runs(named: DataFrame, length: int, gram: int) -> DataFrame:
    """(row, key, context, at) of every anchor of every text; at: lo, the row's tag and hi - lo in 30, 24 and 9 bits."""

    def run(batches):
        hashing = _Hash()
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            row, tag = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            texts = [t.as_py() or b"" for t in batch.column(2).cast(pa.binary())]
            for buf, owner, offset, first, last in _pieces(texts, length):
                lo, hi, key, context = anchors(hashing, buf, first, last, length, gram)
                part = np.searchsorted(first, lo, "right") - 1
                whose = owner[part]
                at = (lo + offset[part] - first[part]) << 33 | tag[whose] << 9 | hi - lo
                yield pa.RecordBatch.from_arrays([pa.array(row[whose]), pa.array(key.view(np.int64)), pa.array(context.view(np.int64)), pa.array(at)], ["row", "key", "context", "at"])

    return named.select("row", "tag", "text").mapInArrow(run, "row bigint, key bigint, context bigint, at bigint")


def _spans(runs: DataFrame, *more) -> DataFrame:
    """(row, tag, lo, hi) of anchors' runs."""
    lo, tag = F.shiftright("at", 33).cast("int"), F.shiftright("at", 9).bitwiseAND(F.lit(TAGS)).cast("int")
    return runs.select("row", tag.alias("tag"), lo.alias("lo"), (lo + F.col("at").bitwiseAND(F.lit(511)).cast("int")).alias("hi"), *more)


def _batch(rows: list[tuple], schema: str, kinds) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in schema.split(", ")])


def _contexts(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(key, salt, row, tag, lo, alone, context, body): the bytes of the contexts ``wanted``."""
    runs = wanted.groupBy("row", "tag").agg(F.collect_list(F.struct("key", "salt", "lo", "hi", "alone", "context")).alias("runs"))
    schema = "key bigint, salt int, row bigint, tag int, lo int, alone boolean, context bigint, body binary"
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())

    def run(batches):
        unpack, out = zstandard.ZstdDecompressor().decompress, []
        for batch in batches:
            for row, tag, z, runs in zip(*batch.columns):
                text, row, tag = unpack(z.as_py()), row.as_py(), tag.as_py()
                out += [(r["key"], r["salt"], row, tag, r["lo"], r["alone"], r["context"], text[r["lo"] : r["hi"] + length]) for r in runs.as_py()]
                if len(out) >= 10_000:
                    yield _batch(out, schema, kinds)
                    out = []
        if out:
            yield _batch(out, schema, kinds)

    return texts.join(runs, ["row", "tag"]).select("row", "tag", "z", "runs").mapInArrow(run, schema)


def _sorted_runs(contexts: DataFrame, length: int, merge: bool) -> DataFrame:
    """What sorting suffixes key by key finds to repeat: (row, tag, lo, hi) of runs of windows in contexts that stand alone, and (key, context) of classes.

    Keys meet whole, or in parts by a salt.  If parts are to ``merge``, one window of each kind of a
    part follows with its body; its row is null unless that window stands alone.
    """
    schema = "row bigint, tag int, lo int, hi int, body binary, key bigint, context bigint"
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64())

    def solve(held):
        size = np.array([len(h[-1]) for h in held])
        start, count = np.cumsum(size) - size, size - length + 1
        buf = np.frombuffer(b"".join(h[-1] for h in held) + bytes(8), np.uint8)
        begin = np.cumsum(count) - count
        windows = np.repeat(start - begin, count) + np.arange(count.sum())
        new = np.array([k > 0 and h[0] != held[k - 1][0] for k, h in enumerate(held)])
        single, again, several = np.array([h[4] for h in held]), np.zeros(len(buf), bool), np.zeros(len(buf), bool)
        several[windows] = np.repeat(~single, count)
        found, leads = repeated(buf, windows.copy(), length, np.repeat(np.cumsum(new), count), several)
        again[found] = True
        for k in np.flatnonzero(np.logical_and.reduceat(again[windows], begin) & ~single).tolist():
            yield None, None, None, None, None, held[k][0][0], held[k][5]
        at = windows[again[windows]]
        part = np.searchsorted(start, at, "right") - 1
        at, part = at[single[part]], part[single[part]]
        first = np.ones(len(at), bool)
        first[1:] = (np.diff(at) != 1) | (np.diff(part) != 0)
        for a, b, k in zip(at[first].tolist(), at[np.roll(first, -1)].tolist(), part[first].tolist()):
            _, row, tag, lo, *_ = held[k]
            shift = lo - int(start[k])
            yield row, tag, a + shift, b + shift, None, None, None
        if merge:
            text, kinds_of = buf.tobytes(), np.concatenate([found[leads], windows[~again[windows]]])
            for a, k in zip(kinds_of.tolist(), (np.searchsorted(start, kinds_of, "right") - 1).tolist()):
                _, row, tag, lo, alone, *_ = held[k]
                alone = alone and not again[a]
                yield row if alone else None, tag, lo + a - int(start[k]), lo + a - int(start[k]), text[a : a + length], None, None

    def run(batches):
        held, windows, last, out = [], 0, None, []
        for batch in batches:
            for key, salt, *one in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, salt) != last and windows >= SORTED:
                    out += solve(held)
                    held, windows = [], 0
                held.append(((key, salt), *one))
                windows += len(one[-1]) - length + 1
                last = key, salt
            while len(out) >= 10_000:
                yield _batch(out[:10_000], schema, kinds)
                out = out[10_000:]
        if held:
            out += solve(held)
        for k in range(0, len(out), 10_000):
            yield _batch(out[k : k + 10_000], schema, kinds)

    return contexts.repartition("key", "salt").sortWithinPartitions("key", "salt").mapInArrow(run, schema)


def _across_parts(found: DataFrame) -> DataFrame:
    """(row, tag, lo, hi) of windows that stand alone in their part of a key and occur in another."""
    kinds = found.where("body is not null")
    twice = written(kinds.groupBy("body").agg(F.count("*").alias("n")).where("n > 1").select("body"), "windows_of_several_parts")
    return kinds.where("row is not null").join(twice, "body").select("row", "tag", "lo", "hi")


def repeated_runs(named: DataFrame, texts: DataFrame, length: int, gram: int, part: int) -> DataFrame:
    """(row, tag, lo, hi): runs of repeated windows; together they are all of them."""
    found = anchor_runs(named, length, gram)
    counts = written(found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "anchor_counts")
    again = written(found.join(counts, "key"), "repeated_anchors")
    kinds = again.groupBy("key", "context").agg(F.count("*").alias("same"), F.max("n").alias("n"), F.min(F.struct("row", "at")).alias("one"))
    hot = (F.col("n") > part) & (F.col("same") < F.col("n"))  # a class that is all of its key's has nothing to meet
    salt = F.when(hot, F.pmod(F.xxhash64("one.row"), F.ceil(F.col("n") / part))).otherwise(0).cast("int")
    wanted = _spans(kinds.select("one.row", "one.at", "key", "context", salt.alias("salt"), hot.alias("hot"), (F.col("same") == 1).alias("alone")), "key", "context", "salt", "hot", "alone")
    wanted = written(wanted, "contexts")
    runs = written(_sorted_runs(_contexts(texts, wanted.where("not hot"), length), length, False), "sorted")
    crowded = wanted.where("hot")
    if not crowded.isEmpty():
        parts = written(_sorted_runs(_contexts(texts, crowded, length), length, True), "sorted_parts")
        runs = runs.union(parts.where("body is null"))
    own = runs.where("row is not null").select("row", "tag", "lo", "hi")
    classes = runs.where("key is not null").select("key", "context")
    copied = _spans(again.join(classes, ["key", "context"])).select("row", "tag", "lo", "hi")
    return own.union(copied) if crowded.isEmpty() else own.union(copied).union(_across_parts(parts))


def removed_spans(docs: DataFrame, carried: Column, text_col: str = "text", length: int = 200, gram: int = 64, part: int = 4096, keep: str = "nothing") -> DataFrame:
    """(row, tag, id, n_bytes, spans, kept, kept_sha256) for each row, with ``carried`` as id.

    spans are (start, end) of removed bytes.  kept is the rest if ``keep`` is "bytes", the rest
    without the parts of cut characters if it is "text", else null.
    """
    if not SHALLOW <= length <= 30_000 or not 0 < length - gram < 511:
        raise ValueError("lengths from 32 up, and anchors' strings shorter by 510 at most")
    named = _named(docs, carried, text_col)
    texts = _packed(named)
    with scratch(docs.sparkSession) as result:
        runs = repeated_runs(named, texts, length, gram, part)
        by_row = result(runs.groupBy("row", "tag").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("runs")), "runs")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            n, spans, kept, digest = [], [], [], []
            for z, runs in zip(*batch.columns[3:]):
                z = z.as_py()
                text, own = b"" if z is None else unpack(z), []
                for r in runs.as_py() or ():
                    lo, end = r["lo"], r["hi"] + length
                    if own and lo <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], end)
                    else:
                        own.append([lo, end])
                rest = b"".join(text[a:b] for a, b in zip([0, *(e for _, e in own)], [*(s for s, _ in own), len(text)])) if own else text
                n.append(len(text))
                digest.append(hashlib.sha256(rest).hexdigest())
                spans.append([{"start": a, "end": b} for a, b in own])
                kept.append(None if z is None or keep == "nothing" else rest.decode("utf-8", "ignore").encode() if keep == "text" else rest)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary()), pa.array(digest, pa.string())], ["row", "tag", "id", "n_bytes", "spans", "kept", "kept_sha256"])

    schema = _schema(named, "n_bytes bigint, spans array<struct<start:int,end:int>>, kept binary, kept_sha256 string")
    return texts.join(by_row, ["row", "tag"], "left").select(*texts.columns, "runs").mapInArrow(run, schema)


def without_repeats(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated bytes gone from their texts, and with them the parts of a character that a cut leaves.  Null texts stay null."""
    rest = F.struct(*[c for c in docs.columns if c != text_col])
    kept = removed_spans(docs, rest, text_col, keep="text", **options)
    return kept.select(*[F.col("kept").cast("string").alias(c) if c == text_col else F.col("id")[c].alias(c) for c in docs.columns])
