"""Calls of a service by batches, with the faults of a batch kept to its own rows."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.scans import Sums, scanned, stretches

Vectors = Sequence[Sequence[float] | None]


class Retryable(Exception):
    """What a service function raises if the same call may succeed later."""


def _clamped(value: int, least: int, most: int) -> int:
    return max(least, min(most, value))


def _answered(call: Callable[[list[str]], Vectors], texts: list[str], retries: int, wait: Callable[[int], float]) -> tuple[Vectors, str | None]:
    """The vectors of a batch, or nothing and why; what may succeed later is tried again."""
    for attempt in range(retries + 1):
        try:
            vectors = list(call(texts))
            if len(vectors) != len(texts):
                raise ValueError(f"{len(vectors)} vectors for {len(texts)} texts")
            if None in vectors:
                raise ValueError(f"no vector for text {vectors.index(None)}")
            return vectors, None
        except Exception as e:  # a fault of the service is a result here
            if attempt == retries or not isinstance(e, (Retryable, ConnectionError, TimeoutError)):
                return [None] * len(texts), str(e) or type(e).__name__
            time.sleep(wait(attempt))
    raise AssertionError


def embedded(rows: DataFrame, call: Callable[[list[str]], Vectors], group: str, order: str, text: str, batch_size: int = 32, concurrency: int = 2, retries: int = 3, wait: Callable[[int], float] = lambda attempt: min(10.0, 0.4 * 2**attempt)) -> DataFrame:
    """Adds ``place`` and ``batch`` in each group, and ``vector`` with ``error`` null, or the other way round.

    ``call`` takes the texts of a batch (null is empty) and gives a vector for each.  A batch that fails, or is
    answered short, has no vectors and its fault as error in all its rows; other batches are not touched.
    Tasks have ``concurrency`` (1 to 8) calls under way; a batch has 1 to 128 rows, and a call 0 to 8 retries.
    A task that is lost calls again.
    """
    batch_size, concurrency, retries = _clamped(batch_size, 1, 128), _clamped(concurrency, 1, 8), _clamped(retries, 0, 8)
    placed = scanned(rows, [group], [order], Sums("place"), F.lit(1)).withColumn("batch", F.expr(f"place div {batch_size}"))
    own = placed.select(F.struct("*").alias("own"), F.to_json(F.struct(group, "batch")).alias("key"), "place")
    dealt = own.repartition("key").sortWithinPartitions("key", "place")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        under_way: deque[tuple[pa.Array, Future]] = deque()

        def whole() -> Iterator[tuple[pa.Array, list[str]]]:
            """The rows and texts of each batch, whose rows may come in several parts."""
            key, held = None, []

            def joined() -> tuple[pa.Array, list[str]]:
                own = pa.concat_arrays([h.column("own") for h in held])
                return own, [t or "" for t in pc.struct_field(own, text).to_pylist()]

            for part in parts:
                for a, b in stretches(part.column("key")):
                    if held and part.column("key")[a].as_py() != key:
                        yield joined()
                        held = []
                    key = part.column("key")[a].as_py()
                    held.append(part.slice(a, b - a))
            if held:
                yield joined()

        def done() -> pa.RecordBatch:
            rows_of, answer = under_way.popleft()
            vectors, error = answer.result()
            return pa.RecordBatch.from_arrays([rows_of, pa.array(vectors, pa.list_(pa.float64())), pa.array([error] * len(rows_of), pa.string())], ["own", "vector", "error"])

        with ThreadPoolExecutor(concurrency) as pool:
            for rows_of, texts in whole():
                under_way.append((rows_of, pool.submit(_answered, call, texts, retries, wait)))
                if len(under_way) == concurrency:
                    yield done()
            while under_way:
                yield done()

    found = dealt.mapInArrow(run, f"own {dealt.schema['own'].dataType.simpleString()}, vector array<double>, error string")
    return found.select("own.*", "vector", "error")


def batch_errors(found: DataFrame, group: str, stage: Column | str = "embed") -> DataFrame:
    """(group, stage, start_index, end_index, message): one row for each batch of ``embedded`` that failed."""
    failed = found.where("error IS NOT NULL").groupBy(group, "batch").agg(F.min("place").alias("start_index"), F.max("place").alias("end_index"), F.min("error").alias("message"))
    return failed.select(group, (F.lit(stage) if isinstance(stage, str) else stage).alias("stage"), "start_index", "end_index", "message")
