"""Keyed tables in storage, merged in place: only the buckets that a batch touches are written anew.

Rows are dealt to a fixed number of buckets by the hash of their keys.  A version of the table names the folder of each of
its buckets; a merge writes new folders for the buckets that it touches beside the old ones and commits by
giving the next version its name, which only one of several writers can.  Readers keep to the version
that they began with, and folders that no version names any more may be deleted at leisure.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.crawl import saved
from docloom.operators.tables import upserted
from docloom.sources.writers import load_state, save_state

#: A version: what the buckets are, and the folder of each that has rows.
MANIFEST = "keys array<string>, buckets int, schema string, bucket int, folder string"


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def created(rows: DataFrame, path: str, keys: Sequence[str], buckets: int = 64) -> None:
    """A new table of ``rows``, one for each key."""
    _committed(rows, path, keys, buckets, set())


def read(spark: SparkSession, path: str) -> DataFrame:
    """The table as of its last version."""
    keys, buckets, schema, folders = _manifest(spark, path)
    return _rows(spark, schema, [folders[b] for b in sorted(folders)])


def merged(new: DataFrame, path: str, version: str) -> list[int]:
    """Upserts ``new`` by the table's keys, the greatest ``version`` of each staying; says which buckets were written anew.

    Of equal versions the new row stays; a row older than the stored one changes nothing but its bucket's folder.
    """
    spark = new.sparkSession
    keys, buckets, schema, folders = _manifest(spark, path)
    touched = [r["b"] for r in new.select(bucket_of(keys, buckets).alias("b")).distinct().collect()]  # as many as buckets at most
    old = _rows(spark, schema, [folders[b] for b in touched if b in folders])
    _committed(upserted(old, new.select(*old.columns), list(keys), version), path, keys, buckets, set(touched))
    return sorted(touched)


def append_markdown(pages: DataFrame, path: str, buckets: int = 256) -> int:
    """Adds pages (name, content) to a table of markdown texts by name, and says how many; a name that is there already is never written again.

    Of pages that share a name the least content counts.
    """
    new = pages.groupBy("name").agg(F.min("content").alias("content"))
    if not load_state(pages.sparkSession, f"{path}/versions", MANIFEST).isEmpty():
        new = new.join(read(pages.sparkSession, path).select("name"), "name", "left_anti")
        new = saved(new)
        if n := new.count():
            merged(new, path, "content")
        return n
    new = saved(new)
    created(new, path, ["name"], buckets)
    return new.count()


def sources_replaced(new: DataFrame, path: str, source: str) -> list[int]:
    """All rows of the sources that ``new`` has go, and its own come; says which buckets were written anew."""
    spark = new.sparkSession
    keys, buckets, schema, folders = _manifest(spark, path)
    whole = _rows(spark, schema, [folders[b] for b in sorted(folders)])
    named = new.select(F.col(source).alias("_of")).distinct()
    goes = lambda rows, how: rows.join(named, rows[source].eqNullSafe(named["_of"]), how)
    going = goes(whole.select(source, *[k for k in keys if k != source]), "left_semi").select(bucket_of(keys, buckets).alias("b"))
    touched = [r["b"] for r in going.union(new.select(bucket_of(keys, buckets).alias("b"))).distinct().collect()]
    kept = goes(_rows(spark, schema, [folders[b] for b in touched if b in folders]), "left_anti")
    _committed(kept.unionByName(new.select(*whole.columns)), path, keys, buckets, set(touched))
    return sorted(touched)


def _manifest(spark: SparkSession, path: str) -> tuple[list[str], int, str, dict[int, str]]:
    rows = load_state(spark, f"{path}/versions", MANIFEST).collect()  # one row a bucket
    if not rows:
        raise ValueError(f"{path} is no table")
    return rows[0]["keys"], rows[0]["buckets"], rows[0]["schema"], {r["bucket"]: r["folder"] for r in rows if r["bucket"] is not None}


def _rows(spark: SparkSession, schema: str, folders: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _committed(rows: DataFrame, path: str, keys: Sequence[str], buckets: int, replaced: set[int]) -> None:
    """Writes ``rows`` to folders of their buckets, and a version in which these stand for the ``replaced`` ones."""
    spark, batch = rows.sparkSession, uuid.uuid4().hex
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    own = f"{path}/data/{batch}"
    dealt = rows.withColumn("_bucket", bucket_of(keys, buckets)).repartition("_bucket")
    dealt.write.partitionBy("_bucket").parquet(own)
    made = {r["_bucket"] for r in spark.read.schema(f"{schema}, _bucket int").parquet(own).select("_bucket").distinct().collect()} if _any(spark, own) else set()
    try:
        kept = {b: f for b, f in _manifest(spark, path)[3].items() if b not in replaced}
    except ValueError:
        kept = {}
    folders = kept | {b: f"{own}/_bucket={b}" for b in made}
    listed = [(list(keys), buckets, schema, b, f) for b, f in sorted(folders.items())] or [(list(keys), buckets, schema, None, None)]
    save_state(spark.createDataFrame(listed, MANIFEST).coalesce(1), f"{path}/versions")


def _any(spark: SparkSession, folder: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_bucket=*")
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at))
