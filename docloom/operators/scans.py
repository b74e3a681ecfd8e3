"""Running values over the rows of groups in order, for groups of any size.

A window gives each group to one task.  Here rows are dealt by ranges of group and order, so that a large
group is spread over many tasks and many small ones share a task.  Only the group that a range begins with
can have begun before it: every task sums up the first and the last group of its range, the driver
carries these summaries, two for each range, from one range to the next, and every task then walks its
range from the value that it begins with.  The ranges are checkpointed in between, so that both passes
see the same rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.crawl import saved


class Scan(Protocol):
    """What is carried along a group.

    ``outputs`` (name and type) are added to the rows.  A state is what the rows so far amount to, a
    summary what a stretch of rows does to any state.
    """

    outputs: dict[str, str]

    def start(self) -> Any: ...

    def walk(self, columns: list[pa.Array], state: Any) -> tuple[list[pa.Array], Any]: ...

    def summary(self, columns: list[pa.Array]) -> Any: ...

    def after(self, state: Any, summary: Any) -> Any: ...


def stretches(keys: pa.Array) -> list[tuple[int, int]]:
    """The bounds of the runs of equal keys."""
    n = len(keys)
    if not n:
        return []
    new = np.flatnonzero(pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1
    bounds = [0, *new.tolist(), n]
    return list(zip(bounds, bounds[1:]))


def scanned(rows: DataFrame, group: Sequence[str], order: Sequence[str], scan: Scan, *inputs: Column) -> DataFrame:
    """Adds the outputs of ``scan`` over ``inputs`` to all rows, along each group (null is one) in order; ties go by the rows' hashes."""
    names = [f"in{i}" for i in range(len(inputs))]
    own = rows.select(F.struct("*").alias("own"), F.to_json(F.struct(*group)).alias("key"), *[c.alias(n) for c, n in zip(inputs, names)])
    by = ["key", *[F.col("own")[c] for c in order], F.xxhash64("own")]
    own = own.persist(StorageLevel.DISK_ONLY)  # the bounds of the ranges and the dealing see rows that are made once
    ordered = saved(own.repartitionByRange(*by).sortWithinPartitions(*by))
    own.unpersist()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: tuple[str, bytes] | None = None
        own: str | None = None
        held: list[pa.RecordBatch] = []

        def told() -> bytes:
            table = pa.Table.from_batches(held)
            return pickle.dumps(scan.summary([table.column(n).combine_chunks() for n in names]))

        for batch in batches:
            keys = batch.column("key")
            for a, b in stretches(keys):
                key = keys[a].as_py()
                if own is not None and key != own:
                    first, held = first or (own, told()), []
                own = key
                held.append(batch.select(names).slice(a, b - a))
        if own is not None:
            last = (own, told())
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (TaskContext.get().partitionId(), *(first or last), *last, first is None)], ["part", "key", "summary", "last_key", "last_summary", "single"])

    # Only what is summed up goes along: a slice that is held keeps its whole batch.
    found = ordered.select("key", *names).mapInArrow(summed, "part bigint, key string, summary binary, last_key string, last_summary binary, single boolean")
    carried: tuple[str, Any] | None = None
    begins: dict[int, Any] = {}
    for r in found.orderBy("part").toLocalIterator():  # one row a range
        if carried and carried[0] == r["key"]:
            begins[r["part"]] = carried[1]
        state = begins.get(r["part"], scan.start()) if r["single"] else scan.start()
        carried = (r["last_key"], scan.after(state, pickle.loads(r["last_summary"])))
    shared = rows.sparkSession.sparkContext.broadcast(begins)

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, shared.value.get(TaskContext.get().partitionId())
        for batch in batches:
            keys, out = batch.column("key"), []
            for a, b in stretches(keys):
                key = keys[a].as_py()
                if key != own:
                    state = scan.start() if own is not None or state is None else state
                    own = key
                part, state = scan.walk([batch.column(n).slice(a, b - a) for n in names], state)
                out.append(part)
            if out:
                yield pa.RecordBatch.from_arrays([batch.column("own"), *[pa.concat_arrays(x) for x in zip(*out)]], ["own", *scan.outputs])

    kinds = ", ".join(f"{n} {k}" for n, k in {"own": own.schema["own"].dataType.simpleString(), **scan.outputs}.items())
    return ordered.mapInArrow(walked, kinds).select("own.*", *scan.outputs)


def _numbers(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), 0).to_numpy()


class Sums:
    """``name``: the sum of the values, whole numbers, before a row; null is nothing."""

    def __init__(self, name: str) -> None:
        self.outputs = {name: "bigint"}

    def start(self) -> int:
        return 0

    def walk(self, columns: list[pa.Array], state: int) -> tuple[list[pa.Array], int]:
        values = _numbers(columns[0])
        sums = np.cumsum(values) + state
        return [pa.array(sums - values)], int(sums[-1])

    def summary(self, columns: list[pa.Array]) -> int:
        return int(pc.sum(columns[0]).as_py() or 0)

    def after(self, state: int, summary: int) -> int:
        return state + summary


class Batches:
    """``batch``: rows packed until the next would exceed either limit; a row that exceeds them alone has a batch of its own.

    A state is the open batch's number, rows and bytes.  Where a batch that begins at a row ends is a look-up among the
    sums of sizes; following these links by doubling gives, for every place at which the first new batch
    of a stretch can begin, how many begin in it and what the last one holds.
    """

    outputs = {"batch": "bigint"}

    def __init__(self, most_records: int, most_bytes: int) -> None:
        self.most_records, self.most_bytes = max(1, most_records), most_bytes

    def start(self) -> tuple[int, int, int]:
        return -1, self.most_records, 0  # full, so that the first row begins a batch

    def _sums(self, columns: list[pa.Array]) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(np.maximum(_numbers(columns[0]), 0))])

    def _joining(self, sums: np.ndarray, rows: int, held: int) -> int:
        """How many of the first rows a batch of so many rows and bytes takes."""
        return max(0, min(self.most_records - rows, int(np.searchsorted(sums, self.most_bytes - held, "right")) - 1, len(sums) - 1))

    def _links(self, sums: np.ndarray) -> np.ndarray:
        """For each row, where the batch after one that begins there begins."""
        at = np.arange(len(sums) - 1)
        fits = np.searchsorted(sums, sums[:-1] + self.most_bytes, "right") - 1
        return np.minimum(np.maximum(np.minimum(fits, at + self.most_records), at + 1), len(at))

    def walk(self, columns: list[pa.Array], state: tuple[int, int, int]) -> tuple[list[pa.Array], tuple[int, int, int]]:
        batch, rows, held = state
        sums = self._sums(columns)
        n, at = len(sums) - 1, self._joining(sums, rows, held)
        if at == n:
            return [pa.array(np.full(n, batch, np.int64))], (batch, rows + n, held + int(sums[-1]))
        links, new = self._links(sums).tolist(), np.zeros(n, np.int64)
        while at < n:
            new[at], last, at = 1, at, links[at]
        numbers = batch + np.cumsum(new)
        return [pa.array(numbers)], (int(numbers[-1]), n - last, int(sums[-1] - sums[last]))

    def summary(self, columns: list[pa.Array]) -> tuple:
        sums = self._sums(columns)
        n = len(sums) - 1
        jump, count, last = np.append(self._links(sums), n), np.append(np.ones(n, np.int64), 0), np.arange(n + 1)
        while (jump[:n] < n).any():
            count, last, jump = count + count[jump], np.where(jump < n, last[jump], last), jump[jump]
        reach = min(n, self.most_records) + 1  # the first new batch begins among so many rows
        return n, int(sums[-1]), sums[:reach], count[:reach], n - last[:reach], (sums[-1] - sums[last])[:reach]

    def after(self, state: tuple[int, int, int], summary: tuple) -> tuple[int, int, int]:
        (batch, rows, held), (n, size, sums, count, open_rows, open_bytes) = state, summary
        at = self._joining(sums, rows, held)
        return (batch, rows + n, held + size) if at == n else (batch + int(count[at]), int(open_rows[at]), int(open_bytes[at]))


class Outline:
    """``before``: how many headings come before a row's own; ``paths``: the path of each of its headings.

    A row's headings are an array of (level, heading).  One of level n replaces what the path has from the
    n-th place on; ``root`` is the path until then.  What a stretch does to a path depends on the path's
    length alone: how many of its places stay, and what follows them.
    """

    outputs = {"before": "bigint", "paths": "array<array<string>>"}

    def __init__(self, root: str) -> None:
        self.root = root

    def start(self) -> tuple[int, list[str]]:
        return 0, [self.root]

    def walk(self, columns: list[pa.Array], state: tuple[int, list[str]]) -> tuple[list[pa.Array], tuple[int, list[str]]]:
        n, path = state
        before, paths = [], []
        for headings in columns[0].to_pylist():
            before.append(n)
            own = []
            for h in headings or []:
                path = [*path[: max(0, h["level"] - 1)], h["heading"]]
                own.append(path)
            n += len(own)
            paths.append(own)
        return [pa.array(before, pa.int64()), pa.array(paths, pa.list_(pa.list_(pa.string())))], (n, path)

    def summary(self, columns: list[pa.Array]) -> tuple[int, list[tuple[int, list[str]]]]:
        flat = columns[0].flatten()
        levels, headings = flat.field("level").to_pylist(), flat.field("heading").to_pylist()
        effects = []
        for kept in range(max(levels, default=0) + 1):  # longer paths are cut like the longest of these
            tail: list[str] = []
            for level, heading in zip(levels, headings):
                cut = max(0, level - 1)
                kept, tail = (cut, [heading]) if cut <= kept else (kept, [*tail[: cut - kept], heading])
            effects.append((kept, tail))
        return len(levels), effects

    def after(self, state: tuple[int, list[str]], summary: tuple[int, list[tuple[int, list[str]]]]) -> tuple[int, list[str]]:
        (n, path), (more, effects) = state, summary
        if not more:
            return state
        kept, tail = effects[min(len(path), len(effects) - 1)]
        return n + more, [*path[:kept], *tail]
