"""Writers: each takes a DataFrame and leaves files that its readers take again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import snippet


def partitioned_vectors(vectors: DataFrame, path: str, partition: str = "namespace") -> None:
    """Overwrites only the partitions that ``vectors`` has."""
    vectors.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def markdown_name(slug: Column, url: Column) -> Column:
    return F.concat(slug, F.lit("-"), F.substring(F.sha1(url), 1, 10), F.lit(".md"))


def markdown_body(meta: Column, body: Column) -> Column:
    """Front matter from a map, keys in order, then the body."""
    lines = F.transform(F.array_sort(F.map_entries(meta)), lambda e: F.concat(e["key"], F.lit(': "'), F.regexp_replace(e["value"], '"', '\\\\"'), F.lit('"')))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n"), body)


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def moved_whole(spark: SparkSession, source: str, target: str) -> None:
    """Renames a folder or file; an error if the target is there, so that of two writers one fails."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(target)
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()) if at.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    files.mkdir(at.getParent(), jvm.org.apache.hadoop.fs.permission.FsPermission.getDirDefault(), True)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    files.rename(jvm.org.apache.hadoop.fs.Path(source), at, none)


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a state, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in found or ())


def save_state(rows: DataFrame, path: str) -> int:
    """Saves a state whole as the next version of it; an error if another writer has saved that version.

    It is written beside and renamed, so readers see the last version until this one is complete.
    """
    spark = rows.sparkSession
    done = _versions(spark, path)
    version = done[-1] + 1 if done else 0
    beside = f"{path}/.writing-{uuid.uuid4().hex}"
    rows.write.parquet(beside)
    moved_whole(spark, beside, f"{path}/version={version}")
    return version


def load_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last complete version of a state, empty if there is none."""
    done = _versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/version={done[-1]}") if done else spark.createDataFrame([], schema)


def write_once(rows: DataFrame, path: str, run: str, by: str) -> bool:
    """Writes the artifacts of a run as JSON, a group of files for each value of ``by``; says whether it did.

    A run is written beside and renamed whole, so one that was cut off leaves nothing that readers see, and one that is
    repeated, or that another writer has finished meanwhile, changes nothing.
    """
    spark, target = rows.sparkSession, f"{path}/run={run}"
    if _exists(spark, target):
        return False
    beside = f"{path}/.writing-{uuid.uuid4().hex}"
    rows.repartition(by).write.partitionBy(by).json(beside)
    try:
        moved_whole(spark, beside, target)
    except Exception:
        if not _exists(spark, target):
            raise
        return False
    return True


def artifacts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``write_once`` has written, with ``run``; ``schema`` includes the column that the files are grouped by."""
    return spark.read.schema(f"{schema}, run string").json(path)


def chunk_artifact(chunks: DataFrame, path: str, run: str) -> bool:
    """Chunks (source_id, chunk_index, text, page_start, page_end, ...) for review, a group of files for each source: each once a run."""
    preview = snippet(F.col("text"), "error")
    return write_once(chunks.select("*", F.length("text").alias("n_chars"), preview.alias("preview")), path, run, "source_id")


def evaluation_report(results: DataFrame, path: str, run: str) -> bool:
    """The results of an evaluation (query, status, errors): a row for each, and one that counts them by status, each once a run."""
    counted = results.groupBy("status").agg(F.count("*").alias("n"))
    summary = counted.agg(F.sum("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("by_status"))
    rows = results.withColumn("part", F.lit("results")).unionByName(summary.withColumn("part", F.lit("summary")), allowMissingColumns=True)
    return write_once(rows, path, run, "part")


def json_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def memo(citations: DataFrame, key: str, order: str) -> DataFrame:
    """(key, memo): a text of all citations (title, citation, snippet) in order."""
    line = F.concat_ws("\n", F.col("title"), F.col("citation"), F.col("snippet"))
    return citations.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line.alias("line")))), lambda x: x["line"]), "\n\n").alias("memo"))
