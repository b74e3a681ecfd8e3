"""Mixing sources to target weights.

Each document gets a hash-random key.  Keys are uniform, so fixed cuts of their range split each
source into buckets of about ``bucket_rows`` documents; a source that holds a third of all rows
merely has more buckets.  Token sums of the buckets, summed in order in two levels, are the offsets
at which each bucket's own running sum starts, so no task sees more than a bucket, or the sums of
``SPAN`` buckets.  A source's budget is then cut exactly: whole epochs first, and the rest from the
start of its order, through the middle of a document if need be.

There may be many sources, too: they are ranked by range partitions, and their targets settle in
rounds of one aggregate each.

Defined cases: null texts have size 0 and take nothing; a null source is a source of its own,
after all others; repeated rows each count; ties of the key go by id, then by size; texts of any
length count whole; sources without words have target 0; an empty table gives no rows; columns other
than the three named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.shared import SPACED_WORD, written

WEIGHTS = (5, 2, 1)
#: Buckets whose sums are added up in one task.
SPAN = 1024


def ranked(sizes: DataFrame) -> DataFrame:
    """Adds ``place`` from 0 to one row (source, ...) for each source: in code-point order, null last.

    Range partitions are sorted, and the rows before each partition are counted; there are as many
    of these counts as partitions.
    """
    spot = F.monotonically_increasing_id()
    dealt = sizes.repartitionByRange(F.col("source").isNull(), F.col("source")).sortWithinPartitions(F.col("source").isNull(), F.col("source"))
    dealt = written(dealt.withColumn("spot", spot), "ranked_sources")
    part, within = F.shiftright("spot", 33), F.col("spot").bitwiseAND(F.lit((1 << 33) - 1))
    before, pairs = 0, []
    for r in dealt.groupBy(part.alias("part")).count().orderBy("part").collect():
        pairs += [F.lit(r["part"]), F.lit(before)]
        before += r["count"]
    start = F.element_at(F.create_map(*pairs), part) if pairs else F.lit(0)
    return dealt.withColumn("place", within + start.cast("bigint")).drop("spot")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, most_epochs: float = 2.0) -> DataFrame:
    """Adds ``target`` to one row (source, source_size) for each source.

    Sources in code-point order, null last, have the weights in turn and share ``share`` of all
    sizes by weight.  What would exceed ``most_epochs`` times a source's size goes to the others by
    weight: the level, a target's share of one weight, rises as full sources leave the sum, until no
    more are full.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rated = written(ranked(sizes).withColumn("weight", weight).withColumn("most", most_epochs * F.col("source_size").cast("double")).drop("place"), "rated_sources")
    all_sizes = share * (rated.agg(F.sum(F.col("source_size").cast("double"))).first()[0] or 0.0)
    level, full = -1.0, None
    while True:
        is_full = F.lit(level) * F.col("weight") >= F.col("most")
        taken, rest, now = rated.agg(F.sum(F.when(is_full, F.col("most"))), F.sum(F.when(~is_full, F.col("weight"))), F.count_if(is_full)).first()
        if now == full or rest is None:
            break
        full, level = now, (all_sizes - (taken or 0.0)) / rest
    return rated.select("source", "source_size", *[c for c in rated.columns if c not in ("source", "source_size", "weight", "most")], F.when(is_full, F.col("most")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, share: float = 1.5, most_epochs: float = 2.0, bucket_rows: int = 4096) -> DataFrame:
    """(id, source, size, source_size, target, taken): the words that the mix takes of each document, repeats counted."""
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(SPACED_WORD)), F.lit(0)).cast("bigint")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"))
    rows = written(rows.withColumn("unit", F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint")), "sizes")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    by_source = written(targets(by_source, weights, share, most_epochs), "targets")

    bucket = F.shiftright(F.col("unit") * F.ceil(F.col("n") / bucket_rows), 32)
    same = F.col("source").eqNullSafe(F.col("s"))
    keyed = rows.join(by_source.withColumnRenamed("source", "s"), same).drop("s").withColumn("bucket", bucket)
    sums = written(keyed.groupBy("source", "bucket").agg(F.sum("size").alias("own")).withColumn("span", F.floor(F.col("bucket") / SPAN)), "bucket_sums")
    spans = sums.groupBy(F.col("source").alias("t"), F.col("span").alias("of")).agg(F.sum("own").alias("whole"))
    earlier = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("t", "of", F.coalesce(F.sum("whole").over(earlier("t", "of")), F.lit(0)).alias("first"))
    own = F.coalesce(F.sum("own").over(earlier("source", "span", "bucket")), F.lit(0))
    offsets = sums.withColumn("own", own).join(spans, F.col("source").eqNullSafe(F.col("t")) & (F.col("span") == F.col("of")))
    offsets = written(offsets.select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.col("first") + F.col("own")).alias("offset")), "offsets")
    within = Window.partitionBy("source", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = keyed.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    run = run.join(offsets, same & (F.col("bucket") == F.col("b"))).withColumn("start", F.col("start") + F.col("offset"))
    run = run.withColumn("budget", F.floor("target").cast("bigint"))
    epochs = F.expr("if(source_size > 0, budget div greatest(source_size, 1), 0)")
    rest = F.col("budget") - epochs * F.col("source_size")
    taken = F.col("size") * epochs + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    return run.select("id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"))
