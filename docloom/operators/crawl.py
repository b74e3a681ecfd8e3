"""Breadth-first crawls over tables of links or pages, one level of the frontier at a time."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import block_page_reason
from docloom.sources.writers import load_state, save_state


def breadth_first(seeds: DataFrame, edges: DataFrame, most_depth: int = 2, most_pages: int = 250, allowed: Column | None = None) -> DataFrame:
    """(url, depth, position): pages in the order a first-in first-out queue visits them.

    ``seeds`` has (url, pos), ``edges`` (url, pos, link).  Only the frontier is joined to the links
    in each round, each level is checkpointed, and the rounds are ``most_depth`` at most.
    """
    edges = edges if allowed is None else edges.where(allowed)
    first = seeds.groupBy("url").agg(F.min("pos").alias("pos")).orderBy("pos", "url").limit(most_pages)
    visited = saved(first.select("url", F.row_number().over(Window.orderBy("pos", "url")).alias("position"), F.lit(0).alias("depth")))
    n = visited.count()
    frontier = visited
    for depth in range(1, most_depth + 1):
        if n >= most_pages:
            break
        next_links = frontier.join(edges, "url").select(F.col("link").alias("url"), F.struct("position", "pos").alias("via")).groupBy("url").agg(F.min("via").alias("via"))
        fresh = next_links.join(visited.select("url"), "url", "left_anti")
        # The best of a level by the order of discovery; the cut comes before the numbering, which then sees ``most_pages`` rows at most.
        fresh = fresh.orderBy("via", "url").limit(most_pages - n)
        frontier = saved(fresh.select("url", (F.row_number().over(Window.orderBy("via", "url")) + n).cast("int").alias("position"), F.lit(depth).alias("depth")))
        new = frontier.count()
        if not new:
            break
        n, visited = n + new, saved(visited.unionByName(frontier))
    return visited.select("url", "depth", "position")


#: What a crawl keeps: what it has attempted, numbered by ``via``, and what waits, in the order of (depth, via, pos), where ``via`` is the attempt that found it.
STATE = "kind string, url string, final_url string, parent_url string, depth int, via bigint, pos int, status string"


def crawled(pages: DataFrame, seeds: DataFrame, path: str, most_depth: int = 2, most_pages: int = 250, allowed: Callable[[Column], Column] = lambda url: F.lit(True), most_levels: int | None = None) -> DataFrame:
    """(url, final_url, parent_url, depth, attempt, status) of all addresses attempted, in this run and those before it.

    ``pages`` stands for the fetching: (url, final_url, links), an address, where it leads, and the addresses that it
    links to; one that is not there cannot be had.  ``seeds`` are (url, pos).  Addresses are taken first in,
    first out; where one leads counts as visited too, and an address that leads where the crawl has been is
    attempted, but not read.  The status is fetched, scrape_failed, out_of_scope or already_visited.

    After each level, or what ``most_pages`` attempts admit of it, the queue and the attempts are saved under ``path`` as one
    version; a run begins with the last one, so that one that was stopped goes on as if it had not been.
    """
    spark = pages.sparkSession
    state = load_state(spark, path, STATE)
    tried, queue = state.where("kind = 'attempt'"), state.where("kind = 'queue'")
    fresh = seeds.where(allowed(F.col("url"))).groupBy("url").agg(F.min("pos").cast("int").alias("pos"))
    fresh = fresh.join(_visited(tried).union(queue.select("url")), "url", "left_anti")
    queue = queue.unionByName(fresh.select(F.lit("queue").alias("kind"), "url", F.lit(0).alias("depth"), F.lit(-1).cast("bigint").alias("via"), "pos"), allowMissingColumns=True)
    budget, levels = most_pages, 0
    while budget > 0 and levels != most_levels and (depth := queue.agg(F.min("depth")).first()[0]) is not None:
        attempts, queue = _level(pages, tried, queue, depth, most_depth, budget, allowed)
        budget, levels = budget - attempts.count(), levels + 1
        save_state(tried.unionByName(attempts).unionByName(queue), path)
        state = load_state(spark, path, STATE)
        tried, queue = state.where("kind = 'attempt'"), state.where("kind = 'queue'")
    return tried.select("url", "final_url", "parent_url", "depth", F.col("via").alias("attempt"), "status")


def _visited(tried: DataFrame) -> DataFrame:
    return tried.select("url").union(tried.where("status <> 'out_of_scope'").select("final_url")).distinct()


def _level(pages: DataFrame, tried: DataFrame, queue: DataFrame, depth: int, most_depth: int, budget: int, allowed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """The attempts that the queue's first level makes, ``budget`` at most, and the queue after them."""
    seen, place = saved(_visited(tried)), F.struct("via", "pos", "url")
    level = queue.where(F.col("depth") == depth).join(seen, "url", "left_anti").select("url", "parent_url", place.alias("place"))
    fetched = pages.select("url", F.coalesce("final_url", "url").alias("to"), "links").withColumn("found", F.lit(True))
    level = level.join(fetched, "url", "left").withColumn("final_url", F.coalesce("to", "url")).withColumn("admitted", allowed(F.col("final_url")))
    level = saved(level.select("url", "parent_url", "place", "final_url", "links", "found", "admitted"))

    # An address is passed over if an earlier one led there; whether that was attempted depends on still earlier ones.
    going, before = level, None
    while (now := going.agg(F.count("*"), F.sum(F.xxhash64("url").cast("decimal(38,0)"))).first()) != before:
        before = now
        led = going.where("admitted AND final_url <> url").groupBy(F.col("final_url").alias("url")).agg(F.min("place").alias("led"))
        going = saved(level.join(led, "url", "left").where("led IS NULL OR led > place").drop("led"))
    attempts = going.orderBy("place").limit(budget)
    done = tried.count()
    attempts = saved(attempts.withColumn("attempt", F.row_number().over(Window.orderBy("place")) + done))  # ``budget`` rows at most

    touched = attempts.select("place", F.explode(F.array("url", F.when(F.col("admitted"), F.col("final_url")).otherwise(F.col("url")))).alias("final_url")).groupBy("final_url").agg(F.min("place").alias("first"))
    known = seen.select(F.col("url").alias("final_url"), F.lit(True).alias("known"))
    judged = attempts.join(touched, "final_url", "left").join(known, "final_url", "left")
    again = (F.col("final_url") != F.col("url")) & (F.col("known").isNotNull() | (F.col("first") < F.col("place")))
    status = F.when(~F.col("admitted"), "out_of_scope").when(again, "already_visited").when(F.col("found").isNull(), "scrape_failed").otherwise("fetched")
    judged = saved(judged.withColumn("status", status))

    made = judged.select(F.lit("attempt").alias("kind"), "url", "final_url", "parent_url", F.lit(depth).alias("depth"), F.col("attempt").cast("bigint").alias("via"), F.col("place.pos").alias("pos"), "status")
    full = made.count() == budget
    last = judged.agg(F.max("place").alias("last"))
    rest = queue.where(F.col("depth") > depth)
    if full:
        left = level.crossJoin(F.broadcast(last)).where("place > last").select("url", "parent_url", "place.via", "place.pos")  # one row
        rest = rest.unionByName(left.withColumn("kind", F.lit("queue")).withColumn("depth", F.lit(depth)), allowMissingColumns=True)
    if depth < most_depth:
        links = judged.where("status = 'fetched'").select(F.col("final_url").alias("parent_url"), F.col("attempt").cast("bigint").alias("via"), F.posexplode("links").alias("pos", "url")).where(allowed(F.col("url")))
        links = links.groupBy("url").agg(F.min(F.struct("via", "pos", "parent_url")).alias("by")).join(seen.union(_visited(made)).union(rest.select("url")), "url", "left_anti")
        rest = rest.unionByName(links.select(F.lit("queue").alias("kind"), "url", "by.parent_url", F.lit(depth + 1).alias("depth"), "by.via", "by.pos"), allowMissingColumns=True)
    return made, rest


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, which the driver and all executors see; only a session whose tasks all run here may go without it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(context.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """Checkpointed in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def statuses(pages: DataFrame, canonical: Column, text: Column, allowed: Column, order: str, reject_low_quality: bool = False, deduplicate: bool = False) -> DataFrame:
    """Adds ``status`` of each page: out_of_scope, pdf_asset, scrape_failed, quality_rejected, duplicate_content or saved.

    The first page of each text, by ``order``, is found by an aggregate, so that a text many pages share (all
    empty ones) does not gather them.
    """
    rows = pages.withColumn("content_hash", F.sha2(F.coalesce(text, F.lit("")), 256))
    status = F.when(~allowed, "out_of_scope").when(F.endswith(F.lower(canonical), F.lit(".pdf")), "pdf_asset").when(text.isNull(), "scrape_failed")
    if reject_low_quality:
        status = status.when(block_page_reason(text).isNotNull(), "quality_rejected")
    if not deduplicate:
        return rows.withColumn("status", status.otherwise("saved"))
    marked = rows.withColumn("status", status).select(F.struct(*rows.columns).alias("own"), "status", F.col("content_hash").alias("h"), F.col(order).alias("o"))
    firsts = marked.groupBy(F.col("h").alias("of")).agg(F.min("o").alias("first"))
    found = marked.join(firsts, F.col("h") == F.col("of"))
    return found.select("own.*", F.coalesce("status", F.when(F.col("o") > F.col("first"), "duplicate_content").otherwise("saved")).alias("status"))
