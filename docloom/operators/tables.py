"""Joins, upserts and latest-state operations over keyed tables.

Every "first" or "last" names the column that orders it; nothing depends on partition order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators.scans import Batches, Sums, scanned


def keep_first(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def best_per_group(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: Column | int) -> DataFrame:
    """The first ``n`` rows of each group, with ``position``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("position", F.row_number().over(w)).where(F.col("position") <= n)


def upserted(existing: DataFrame, new: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """One row for each key, that of the greatest version; of equals the new one, and of those the last by all columns.

    Rows are reduced by ``max_by`` before the shuffle, so a key with many versions costs one row a task.
    """
    both = existing.select("*", F.lit(0).alias("_new")).unionByName(new.select("*", F.lit(1).alias("_new")))
    rest = [c for c in existing.columns if c not in keys]
    rank = F.struct(version, "_new", *[c for c in rest if c != version])
    got = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return got.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in existing.columns])


def skip_existing(new: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    return new.join(existing.select(*keys), list(keys), "left_anti")


def replaced(existing: DataFrame, new: DataFrame, source: str) -> DataFrame:
    """All rows of the sources that ``new`` has go, and its rows come."""
    return existing.join(new.select(source).distinct(), source, "left_anti").unionByName(new)


def coalesce_upserted(existing: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Adds new keys; a known key's column changes to a new value that is not null."""
    a, b = existing.select(key, F.col(column).alias("_old")), new.select(key, F.col(column).alias("_new"))
    return a.join(b, key, "full_outer").select(key, F.coalesce("_new", "_old").alias(column))


def touched_sessions(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Sessions (session_id, user_id, title, updated_at) after requests with the same columns.

    A known session changes for its own user only: its time moves on and an empty title is filled.
    Unknown sessions are created.
    """
    last = requests.groupBy("session_id", "user_id").agg(F.max("updated_at").alias("_at"), F.min_by(F.nullif("title", F.lit("")), "updated_at").alias("_title"))
    known = sessions.join(last, ["session_id", "user_id"], "left").select("session_id", "user_id", F.when(F.coalesce("title", F.lit("")) == "", F.coalesce("_title", "title")).otherwise(F.col("title")).alias("title"), F.greatest("updated_at", F.coalesce("_at", "updated_at")).alias("updated_at"))
    fresh = last.join(sessions.select("session_id"), "session_id", "left_anti")
    fresh = keep_first(fresh, ["session_id"], ["_at", "user_id"]).select("session_id", "user_id", F.col("_title").alias("title"), F.col("_at").alias("updated_at"))
    return known.unionByName(fresh)


def owned(rows: DataFrame, owners: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose container belongs to who asks."""
    return rows.join(owners.select(*keys), list(keys), "left_semi")


def appended(messages: DataFrame, new: DataFrame, sessions: DataFrame) -> DataFrame:
    return messages.unionByName(owned(new, sessions, ["session_id", "user_id"]).select(*messages.columns))


def appended_and_touched(messages: DataFrame, new: DataFrame, sessions: DataFrame, at: str) -> tuple[DataFrame, DataFrame]:
    """(messages, sessions): what the owners of sessions (session_id, user_id, updated_at) say is appended, and their sessions' time moves on."""
    kept = owned(new, sessions, ["session_id", "user_id"])
    last = kept.groupBy("session_id").agg(F.max(at).alias("now"))
    moved = F.greatest("updated_at", F.coalesce("now", "updated_at"))
    return messages.unionByName(kept.select(*messages.columns)), sessions.join(last, "session_id", "left").withColumn("updated_at", moved).select(*sessions.columns)


def recent(messages: DataFrame, session: str, order: str, n: int) -> DataFrame:
    """The last ``n`` messages of each session; sort by ``order`` to read them forwards."""
    return best_per_group(messages, [session], [F.desc(order)], n).drop("position")


def nested(parents: DataFrame, children: DataFrame, key: str, order: str, columns: Sequence[str], name: str) -> DataFrame:
    """Parents with their children as an ordered array, empty if there are none."""
    items = children.join(parents.select(key), key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias(name))
    joined = parents.join(items, key, "left")
    return joined.withColumn(name, F.coalesce(name, F.array().cast(joined.schema[name].dataType)))


def first_hit(rows: DataFrame, key: str, candidates: str, lookup: DataFrame, on: str) -> DataFrame:
    """Each row joined to the first of its candidate values that ``lookup`` has; rows without a hit stay."""
    exploded = rows.select(key, F.posexplode(candidates).alias("_pos", on))
    hits = keep_first(exploded.join(lookup, on), [key], ["_pos"]).drop("_pos")
    return rows.join(hits, key, "left")


def mismatches(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, problem): rows that one side lacks, or that differ."""
    a = left.select(key, F.struct(*columns).alias("_a"))
    b = right.select(key, F.struct(*columns).alias("_b"))
    problem = F.when(F.col("_a").isNull(), "missing_left").when(F.col("_b").isNull(), "missing_right").when(~F.col("_a").eqNullSafe(F.col("_b")), "different")
    return a.join(b, key, "full_outer").select(key, problem.alias("problem")).where("problem is not null")


def merged_chats(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Messages (chat_id, message_id, ts, ...) of two copies of chats, local first, one for each id; sort by ts to read them."""
    both = local.select("*", F.lit(0).alias("_side")).unionByName(remote.select("*", F.lit(1).alias("_side")))
    return keep_first(both, ["chat_id", "message_id"], ["_side", "ts"]).drop("_side")


def active_citations(messages: DataFrame, chat: str = "chat_id", order: str = "ts", citations: str = "citations") -> DataFrame:
    """(chat, citation id, value, place): the last value of each cited id, in the order of first mention.

    ``citations`` is an array of (id, value).
    """
    flat = messages.select(chat, order, F.posexplode(citations).alias("i", "c"))
    at = F.struct(order, "i")
    got = flat.groupBy(chat, F.col("c.id").alias("citation_id")).agg(F.max_by("c.value", at).alias("value"), F.min(at).alias("_first"))
    return got.withColumn("place", F.row_number().over(Window.partitionBy(chat).orderBy("_first"))).drop("_first")


def batches(records: DataFrame, group: str, order: str, size: str, most_records: int, most_bytes: int) -> DataFrame:
    """Adds ``batch``: records packed in order until the next would exceed either limit; an oversized one goes alone.

    Ties of the order go by size; a null group is a group, and a null size counts for nothing.
    """
    return scanned(records, [group], [order, size], Batches(most_records, most_bytes), F.col(size))


def even_batches(records: DataFrame, group: str, order: str, size: str, most_records: int = 100, most_bytes: int = 1_800_000) -> DataFrame:
    """Adds ``batch``: each group in order, cut into equal numbers of records that fit the bytes on average; one at least."""
    fits = F.greatest(F.lit(1), F.least(F.lit(most_records), F.floor(most_bytes / F.greatest(F.avg(size), F.lit(1.0)))))
    sizes = records.groupBy(F.col(group).alias("of")).agg(fits.alias("fits"))
    placed = scanned(records.select(F.struct("*").alias("own"), F.col(group).alias("key"), F.col(order).alias("order"), F.col(size).alias("size")), ["key"], ["order", "size"], Sums("batch"), F.lit(1))
    return placed.join(sizes, F.col("key").eqNullSafe(F.col("of"))).select("own.*", F.floor(F.col("batch") / F.col("fits")).alias("batch"))


def chunks_replaced(existing: DataFrame, new: DataFrame, parents: DataFrame, source: str, at: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, parents): all chunks of the sources that ``new`` has go and its own come; these sources' parents are touched.

    ``parents`` has (source, updated_at, ...); ``new`` carries when it came in the column ``at``.
    """
    times = new.groupBy(F.col(source).alias("touched")).agg(F.max(at).alias("now"))
    own = parents.select(F.struct("*").alias("own"), F.col(source).alias("of")).join(times, F.col("of") == F.col("touched"), "left")
    moved = F.greatest(F.col("own")["updated_at"], F.coalesce("now", F.col("own")["updated_at"]))
    touched = own.select(*[moved.alias(c) if c == "updated_at" else F.col("own")[c].alias(c) for c in parents.columns])
    return replaced(existing, new.drop(at), source), touched


def chunk_pool(chunks: DataFrame, documents: DataFrame, most: int = 80) -> DataFrame:
    """The first ``most`` chunks (document_id, chunk_index, ...) of each session's ready documents (document_id, session_id, status, updated_at), newest documents first; with ``position``."""
    ready = documents.where("status = 'ready'").select("document_id", "session_id", "updated_at")
    return best_per_group(chunks.join(ready, "document_id"), ["session_id"], [F.desc("updated_at"), "document_id", "chunk_index"], most)


def content_deduplicated(rows: DataFrame, text: str, order: str) -> DataFrame:
    """The first row of each different text, by its hash."""
    return keep_first(rows.withColumn("content_hash", F.sha2(F.col(text), 256)), ["content_hash"], [order])


def sampled_log(traces: DataFrame, key: str, rate: float) -> DataFrame:
    """A share of the traces, the same ones each time."""
    rate = max(0.0, min(1.0, rate))
    return traces.where(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") < int(rate * (1 << 32)))
