"""Importance resampling towards a target distribution by hashed word n-grams.

Every task keeps the runs of words of its rows in a trie: a node stands for a run, and holds how often
the task has met it and the CRC-32 state of its bytes, from which the states of the runs one word longer
follow without reading the run again.  A task gives its nodes' counts by bucket, never its runs; the
sums over all tasks give each bucket's gain, what a run in it says for the target.  In a second pass the
nodes carry their buckets' gains, and a document's score is what its walks through the trie collect.
A trie is emptied when it has ``most_nodes`` nodes: counts are given out first, so nothing is lost.

Scores get Gumbel noise from a hash of the id, so that the highest are a sample without replacement
by weight.  Ranks come from range partitions, of which only the sizes are gathered.

Defined cases: a null text has no words; documents without features have weight 0; documents of fewer
than ``least_words`` words are scored but never drawn; ties of the score go to the smaller id (null ids
last), then to fewer features; repeated rows are each scored and ranked; with an empty target
the gains are those of the documents' counts alone; texts of any length count whole, and an empty
table gives no rows; columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from operator import attrgetter
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import written

#: Nodes that a trie has at most, some 60 MB, but for what one text adds; buckets there can be.
MOST_NODES, MOST_BUCKETS = 200_000, 1 << 20
#: A-Z are lower-cased, other ASCII but letters and digits separates words.
LETTERS = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b > 127 else 32 for b in range(256))


class Node(dict):
    """A run of words: by each word that follows it in the task's rows, the run that is longer by this word."""

    __slots__ = ("trie", "state", "bucket", "kept")

    def __init__(self, trie: Trie, crc: int, state: int) -> None:
        self.trie, self.state, self.bucket = trie, state, crc % trie.buckets
        self.kept = trie.gains[self.bucket]

    def __missing__(self, word: bytes) -> Node:
        crc = crc32(word, self.state)
        self[word] = node = Node(self.trie, crc, crc32(b" ", crc))
        self.trie.nodes.append(node)
        return node


class Trie:
    """The runs of up to ``order`` words in a task's rows; what new nodes keep begins at their buckets' ``gains``."""

    def __init__(self, order: int, gains: Sequence[int]) -> None:
        self.order, self.gains, self.buckets = order, gains, len(gains)
        self.clear()

    def clear(self) -> None:
        self.nodes: list[Node] = []
        self.root = Node(self, 0, 0)

    def walked(self, words: list[bytes]) -> Iterator[list[Node]]:
        """The nodes of all runs of one word, then of two, and so on."""
        nodes = [self.root] * len(words)
        for k in range(min(self.order, len(words))):
            nodes = list(map(Node.__getitem__, nodes, words[k:]))
            yield nodes


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LETTERS).split()


def bucket_counts(rows: DataFrame, text_col: str, order: int, buckets: int, most_nodes: int = MOST_NODES) -> DataFrame:
    """(bucket, n): the features of all rows by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, sums = Trie(order, [0] * buckets), np.zeros(buckets, np.int64)

        def give() -> None:
            np.add.at(sums, [node.bucket for node in trie.nodes], [node.kept for node in trie.nodes])
            trie.clear()

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                for nodes in trie.walked(words_of(text.as_py())):
                    for node in nodes:
                        node.kept += 1
                if len(trie.nodes) >= most_nodes:
                    give()
        give()
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(sums[met])], ["bucket", "n"])

    return rows.select(text_col).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text: str = "text", order: int = 1, buckets: int = 10_000) -> list[int]:
    """Each bucket's gain: 1,000 times the logarithm of its smoothed share of the target's features over that of the documents'."""
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"there are {MOST_BUCKETS} buckets at most")
    both = [bucket_counts(docs, text_col, order, buckets).withColumn("of", F.lit(0)), bucket_counts(target, target_text, order, buckets).withColumn("of", F.lit(1))]
    counts = [[0] * buckets, [0] * buckets]
    for r in both[0].union(both[1]).collect():  # two rows a bucket at most
        counts[r["of"]][r["bucket"]] = r["n"]
    all_docs, all_target = map(sum, counts)
    return [math.floor(1000 * math.log(float(t + 1) * float(all_docs + buckets) / (float(s + 1) * float(all_target + buckets)))) for s, t in zip(*counts)]


def scored(docs: DataFrame, found: list[int], carried: Column, id_col: str = "doc_id", text_col: str = "text", order: int = 1, seed: str = "2024", most_nodes: int = MOST_NODES) -> DataFrame:
    """(carried, id, n_words, n_features, weight, score) of each row."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    rows = docs.select(carried.alias("carried"), F.col(id_col).alias("id"), F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("bigint").alias("noise"), F.col(text_col).alias("text"))
    names, shared = ["carried", "id", "noise", "n_words", "n_features", "weight"], docs.sparkSession.sparkContext.broadcast(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, kept = Trie(order, shared.value), attrgetter("kept")
        for batch in batches:
            results = []
            for text in batch.column("text").cast(pa.binary()):
                words, n, total = words_of(text.as_py()), 0, 0
                for nodes in trie.walked(words):
                    n, total = n + len(nodes), total + sum(map(kept, nodes))
                results.append((len(words), n, total // n if n else 0))
                if len(trie.nodes) >= most_nodes:
                    trie.clear()
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:3]], *[pa.array(c, pa.int64()) for c in (zip(*results) if results else [()] * 3)]], names)

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in names[:3])
    return rows.mapInArrow(run, f"{kinds}, n_words bigint, n_features bigint, weight bigint").withColumn("score", F.col("weight") + F.col("noise")).drop("noise")


#: What puts the rows in order: the highest score first, then the least id, null last.
ORDER = (F.desc, "score"), (F.asc_nulls_last, "id"), (F.asc, "n_features")


def ranked(rows: DataFrame, least_words: int = 20, percent: int = 10) -> DataFrame:
    """(id, n_features, weight, score, rank) of rows that are scored; ``rank`` counts from 1 the ``percent`` of those with words enough that score highest."""
    columns, order = ["id", "n_features", "weight", "score"], [by(c) for by, c in ORDER]
    rows = written(rows.select(*columns, (F.col("n_words") >= least_words).alias("admitted")), "scored")
    spot = F.monotonically_increasing_id()  # the partition, and the place in it
    admitted = written(rows.where("admitted").select(*columns).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("spot", spot), "ordered")
    part, within = F.shiftright("spot", 33).cast("int"), F.col("spot").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["part"]: r["n"] for r in admitted.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    starts = np.cumsum([0, *[sizes.get(k, 0) for k in range(max(sizes, default=-1) + 1)]]).tolist()
    before = F.get(F.from_json(F.lit(json.dumps(starts)), "array<bigint>"), part)
    rank = before + within + 1
    admitted = admitted.select(*columns, F.when(rank <= starts[-1] * percent // 100, rank).alias("rank"))
    return admitted.union(rows.where("NOT admitted").select(*columns, F.lit(None).cast("bigint")))


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", order: int = 1, buckets: int = 10_000, seed: str = "2024", least_words: int = 20, percent: int = 10) -> DataFrame:
    """The documents drawn.  No text is shuffled: a row stays if it does not come after the last one drawn; rows that are equal to that one in id, score and features all stay."""
    found = gains(docs, target, text_col, target_text, order, buckets)
    rows = scored(docs, found, F.struct("*"), id_col, text_col, order, seed)
    last = ranked(rows, least_words, percent).where("rank IS NOT NULL").orderBy(F.desc("rank")).first()
    if last is None:
        return docs.where("false")
    place = lambda score, id, n: F.struct((-score.cast("bigint")).alias("s"), id.isNull().alias("none"), id.alias("id"), n.cast("bigint").alias("n"))
    cut = place(F.lit(last["score"]), F.lit(last["id"]).cast(rows.schema["id"].dataType), F.lit(last["n_features"]))
    return rows.where((F.col("n_words") >= least_words) & (place(F.col("score"), F.col("id"), F.col("n_features")) <= cut)).select("carried.*")
