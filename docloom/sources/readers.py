"""Readers for the inputs of a document pipeline; schemas are given, never inferred."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD = "query string, as_of string, expected_doc_families array<string>, must_cite_authority_levels array<string>, must_not_cite_doc_families array<string>, expected_failure_state string, note string"
PAGE_JSON = (
    "source_id string, source_type string, source_url string, canonical_url string, title string, language string, manual string, chapter string, heading_path array<string>, last_updated string, crawl_ts string, "
    "http struct<status_code:int,content_type:string>, content_hash string, raw_html_path string, markdown_path string, text string, "
    "sections array<struct<heading:string,heading_path:array<string>,anchor:string,text:string>>, links struct<outbound:array<string>,internal_children:array<string>>, quality struct<is_toc_like:boolean,is_low_text:boolean,notes:array<string>>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def markdown_files(spark: SparkSession, directory: str, glob: str = "*.md", most: int | None = None) -> DataFrame:
    """(path, content), recursively; the first ``most`` by path if given."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(directory, wholetext=True)
    files = files.select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    return files if most is None else files.orderBy("path").limit(most)


def binary_files(spark: SparkSession, directory: str, glob: str = "*.pdf", most: int | None = None) -> DataFrame:
    """(path, length, modificationTime): which files there are; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(directory).select("path", "length", "modificationTime")
    return files if most is None else files.orderBy("path").limit(most)


def pages_of_files(files: DataFrame, extract) -> DataFrame:
    """(path, page, text, warning) by ``extract``, a function of batches of (path, content): the seam for a PDF library."""
    pages = files.mapInPandas(extract, "path string, page int, text string")
    return pages.withColumn("warning", F.when(F.length(F.trim("text")) < 20, "page has little text"))


def front_matter(content: Column) -> Column:
    """(meta map, body) of a text that begins with ``key: value`` lines between dashes."""
    pattern = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\z"
    head = F.regexp_extract(content, pattern, 1)
    pairs = F.filter(F.split(head, r"\r?\n"), lambda x: x.rlike(r"^[^:\s][^:]*:"))
    meta = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:]*):", 1)), F.regexp_replace(F.trim(F.regexp_extract(x, "^[^:]*:(.*)$", 1)), "^[\"']|[\"']$", ""))))
    return F.struct(meta.alias("meta"), F.when(head == "", content).otherwise(F.regexp_extract(content, pattern, 2)).alias("body"))


def page_json(spark: SparkSession, directory: str) -> DataFrame:
    """Page files but for the summary; unreadable ones are left out."""
    rows = spark.read.schema(f"{PAGE_JSON}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(directory)
    return rows.where(~F.endswith(F.input_file_name(), F.lit("summary.json"))).where("_corrupt_record is null").drop("_corrupt_record")


def gold_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLD).json(path)


def dimension(spark: SparkSession, rows: Mapping[str, Sequence], schema: str) -> DataFrame:
    """A small table from a configuration's mapping of keys to the other columns."""
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], schema)


def config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A configuration file of one JSON object or an array of them, as a small table."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url, pos) of a text file of one URL a line; blank and comment lines are left out."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "url"))
    return lines.select(F.trim("url").alias("url"), "pos").where("url <> '' and not startswith(url, '#')")


def hub_links(text: Column, hosts: str, pattern: str | None = None) -> Column:
    """The different bare URLs of a hub page on hosts like ``hosts``, in order."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(https?://[^\s\"'<>]+)"), 1), lambda u: F.regexp_replace(u, r"[.,;:!?)]+$", ""))
    kept = F.filter(found, lambda u: F.contains(u, F.lit(hosts)) & (u.rlike(pattern) if pattern else F.lit(True)))
    return F.array_distinct(kept)


def cases(search: DataFrame, datasets: Sequence[str] = (), start: str | None = None, end: str | None = None, size: int = 10) -> DataFrame:
    """Case-law search over a table (id, dataset, date, ...): filters reach the scan, and 1 to 50 rows return, newest first."""
    rows = search.where(F.col("dataset").isin(*datasets)) if datasets else search
    rows = rows.where(F.col("date") >= start) if start else rows
    rows = rows.where(F.col("date") <= end) if end else rows
    return rows.orderBy(F.desc("date"), "id").limit(max(1, min(50, size)))


def library_search(cases: DataFrame, text: str = "", court: str = "", tags: Sequence[str] = ()) -> DataFrame:
    """Cases (name, citation, court, tags, summary) with a text in any field, of a court, with any of the tags."""
    low = F.lit(text.lower())
    hit = F.lit(not text)
    for c in ("name", "citation", "summary"):
        hit = hit | F.contains(F.lower(F.coalesce(c, F.lit(""))), low)
    hit = hit | F.exists("tags", lambda t: F.contains(F.lower(t), low))
    own = F.lit(True) if not court else F.col("court") == court
    return cases.where(hit & own & (F.arrays_overlap("tags", F.array(*map(F.lit, tags))) if tags else F.lit(True)))
