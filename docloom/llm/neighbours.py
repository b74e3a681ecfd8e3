"""Nearest neighbours of a query set by a block matrix join with int8 tiles.

Vectors are packed in blocks: int8 codes with a scale for each vector, its norm, and the norm of
what the codes miss, beside the originals as the table has them (in single or double precision).  A
task gets many query blocks and many candidate blocks and multiplies their codes tile by tile,
exactly in float32 up to 1,040 dimensions and in float64 beyond.  By Cauchy and Schwarz,

    |<q, c> - s_q s_c <int8 q, int8 c>|  <=  |q - s_q int8 q| |c| + |s_q int8 q| |c - s_c int8 c|,

so a pair whose upper bound is below the k-th best lower bound of its query cannot be among the k
nearest.  The survivors are recomputed in double precision from the original vectors in the tile,
and heaps of k merge them: within a task as tiles stream by, then query by query across tasks.
Nothing is lost, so the recall is 1.

Of rows with the same vector only those of the k + 1 least ids can be among anyone's k nearest, and
k of each at most, so the others are dropped as candidates before any block is made, by counts and a
ranking that are cut in each task before the shuffle; a vector that a third of all rows have costs no
more than another.  Originals
travel with their codes, once for every ``query_rows`` queries: vectors that nearly tie leave a
task's bounds undecided for any number of pairs, and these must not be shuffled.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no
part, as queries or as candidates; vectors are compared with those of their own length only; a row
is no neighbour of rows of its own id; an id that repeats asks once, with its least vector, and is a
candidate as often as it occurs; ties go to the smaller id; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.shared import written

#: Dimensions up to which sums of int8 products are exact in float32.
FLOAT32_DIMS = (1 << 24) // (127 * 127)
PACKED = "ids binary, original binary, codes binary, scales binary, norms binary, missed binary"
#: Rows of a tile on either side.
TILE = 2048


def _usable(vector: Column) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return sound & F.exists(vector, lambda x: x != 0)


def _pack(rows: DataFrame, block: str) -> DataFrame:
    """One row (dims, block, PACKED) for each block of rows (id, v, dims, block)."""

    def run(key, table):
        ids = table["id"].to_numpy().astype(np.int64)
        dims = key[0].as_py()
        own = table["v"].combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, dims)
        order = np.argsort(ids, kind="stable")
        ids, own = ids[order], own[order]
        v = own.astype(np.float64)
        scale = np.abs(v).max(axis=1) / 127
        scale[scale == 0] = 1
        codes = np.rint(v / scale[:, None]).clip(-127, 127).astype(np.int8)
        missed = np.linalg.norm(v - codes * scale[:, None], axis=1)
        parts = [ids, own, codes, scale, np.linalg.norm(v, axis=1), missed]
        return pa.table({"dims": pa.array([dims], pa.int32()), block: pa.array([key[1].as_py()], pa.int64()), **{x.split()[0]: pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for x, p in zip(PACKED.split(", "), parts)}})

    return rows.groupBy("dims", block).applyInArrow(run, f"dims int, {block} bigint, {PACKED}")


class _Block:
    def __init__(self, dims: int, ids, original, codes, scales, norms, missed):
        self.ids = np.frombuffer(ids, np.int64)
        self.original = np.frombuffer(original, np.float32 if len(original) == 4 * dims * len(self.ids) else np.float64).reshape(-1, dims)
        self.codes = np.frombuffer(codes, np.int8).reshape(-1, dims).astype(np.float32 if dims <= FLOAT32_DIMS else np.float64)
        self.scales, self.norms, self.missed = (np.frombuffer(x, np.float64) for x in (scales, norms, missed))
        self.coded = np.linalg.norm(self.codes.astype(np.float64), axis=1) * self.scales
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in self.ids]


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, summed from the first component to the last in double precision."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k].astype(np.float64) * b[:, k].astype(np.float64)
    return out


def _keep(heap: list[tuple[float, int]], item: tuple[float, int], k: int) -> None:
    if len(heap) < k:
        heapq.heappush(heap, item)
    elif item > heap[0]:
        heapq.heapreplace(heap, item)


def _tile(q: _Block, rows: slice, c: _Block, columns: slice, k: int) -> None:
    """Merges a tile's survivors into the heaps of (score, -id) of the query block."""
    ids, others = q.ids[rows], c.ids[columns]
    estimate = (q.codes[rows] @ c.codes[columns].T).astype(np.float64) * q.scales[rows, None] * c.scales[None, columns]
    bound = (q.missed[rows, None] * c.norms[None, columns] + q.coded[rows, None] * c.missed[None, columns]) * (1 + 1e-9) + 1e-12 * q.norms[rows, None] * c.norms[None, columns]
    own = ids[:, None] == others[None, :]
    upper = estimate + bound
    upper[own] = -np.inf
    heaps = q.heaps[rows]
    least = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps])
    if len(others) > k:
        lower = estimate - bound
        lower[own] = -np.inf
        least = np.maximum(least, np.partition(lower, len(others) - k, axis=1)[:, len(others) - k])
    at, other = np.nonzero((upper >= least[:, None]) & ~own)
    for i in range(0, len(at), 1 << 16):
        a, b = at[i : i + (1 << 16)], other[i : i + (1 << 16)]
        for x, s, d in zip(a.tolist(), inner_products(q.original[rows][a], c.original[columns][b]).tolist(), others[b].tolist()):
            _keep(heaps[x], (s, -d), k)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score): the heaps of all tasks, put together query by query in one heap each."""

    def run(batches):
        now, heap = None, []

        def best():
            return [(now, place, -d, s) for place, (s, d) in enumerate(sorted(heap, reverse=True), 1)]

        out = []
        for batch in batches:
            for q, d, s in zip(*(c.to_pylist() for c in batch.columns)):
                if q != now:
                    out += best()
                    now, heap = q, []
                _keep(heap, (s, -d), k)
            if out:
                yield _rows(out)
                out = []
        if heap:
            yield _rows(best())

    def _rows(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.float64()))], ["query_id", "rank", "id", "score"])

    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(run, "query_id bigint, rank int, id bigint, score double")


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, block_rows: int = 4096, query_rows: int = 16_384, tiles_each: int = 16) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` rows of largest inner product with each query row, nearest first.

    A task holds ``query_rows`` queries and one candidate block at a time, ``tiles_each`` in turn.
    """
    kind = vectors.schema[vector_col].dataType.elementType.typeName()
    vector = F.col(vector_col).cast("array<float>" if kind == "float" else "array<double>")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), vector.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & F.coalesce(_usable(F.col("v")), F.lit(False)))
    rows = rows.withColumn("dims", F.size("v"))
    alike = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    distinct = rows.groupBy("id", "v", "dims").agg(F.count("*").alias("copies")).withColumn("place", F.row_number().over(alike)).where(F.col("place") <= k + 1)
    distinct = distinct.select(F.explode(F.array_repeat("id", F.least("copies", F.lit(k)).cast("int"))).alias("id"), "v", "dims")
    first = Window.partitionBy("id", "dims").orderBy("v")
    asking = rows.where("asks").withColumn("place", F.row_number().over(first)).where("place = 1").select("id", "v", "dims")
    n, asked = rows.agg(F.count("*"), F.count_if("asks")).first()
    blocks, query_blocks = max(1, -(-n // block_rows)), max(1, -(-asked // query_rows))

    spot = F.xxhash64("id")
    candidates = written(_pack(distinct.withColumn("block", F.pmod(spot, F.lit(blocks))), "block"), "candidate_blocks")
    queries = _pack(asking.withColumn("query_block", F.pmod(spot, F.lit(query_blocks))), "query_block")
    names = [x.split()[0] for x in PACKED.split(", ")]
    turns = -(-blocks // tiles_each)
    # Query blocks go to every turn of candidate blocks and these to every query block, each once a task: no pair of blocks is a row.
    asks = written(queries, "query_blocks").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))).select("dims", "query_block", "turn", F.lit(-1).cast("bigint").alias("block"), *names)
    held = candidates.withColumn("query_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(query_blocks - 1).cast("bigint")))).select("dims", "query_block", F.floor(F.col("block") / tiles_each).cast("int").alias("turn"), "block", *names)
    dealt = asks.union(held).repartition("dims", "query_block", "turn").sortWithinPartitions("dims", "query_block", "turn", "block")

    def found(q: _Block) -> pa.RecordBatch:
        flat = [(i, -d, s) for i, h in zip(q.ids.tolist(), q.heaps) for s, d in h]
        return pa.RecordBatch.from_arrays([pa.array([f[j] for f in flat], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "id", "score"])

    def run(batches):
        q, own = None, None
        for batch in batches:
            column = {x: batch.column(batch.schema.get_field_index(x)) for x in batch.schema.names}
            for i in range(batch.num_rows):
                dims, block = column["dims"][i].as_py(), column["block"][i].as_py()
                now = dims, column["query_block"][i].as_py(), column["turn"][i].as_py()
                packed = _Block(dims, *(column[x][i].as_py() for x in names))
                if block < 0:
                    if q is not None:
                        yield found(q)
                    q, own = packed, now
                elif now == own:  # without queries of its length a candidate has nobody to answer
                    for a in range(0, len(q.ids), TILE):
                        for b in range(0, len(packed.ids), TILE):
                            _tile(q, slice(a, a + TILE), packed, slice(b, b + TILE), k)
        if q is not None:
            yield found(q)

    return _merged(dealt.mapInArrow(run, "query_id bigint, id bigint, score double"), k)
