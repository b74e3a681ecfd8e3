"""Records that leave the pipeline: metadata of vectors, pages as JSON, and how sources fared in a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text as texts
from docloom.functions import urls
from docloom.operators import chunking, html
from docloom.operators.guards import SOURCE_TYPE

SECTIONS = "array<struct<heading:string,heading_path:array<string>,anchor:string,text:string>>"


def sanitized_metadata(metadata: Column) -> Column:
    """A JSON object with its texts, numbers and booleans, and of its arrays the texts; nulls and objects are left out.

    Null if it is no object.
    """
    kind = lambda v: F.schema_of_variant(v)
    array = lambda v: F.startswith(kind(v), F.lit("ARRAY"))
    of_texts = lambda v: F.transform(F.filter(F.variant_get(v, "$", "array<variant>"), lambda x: kind(x) == "STRING"), lambda x: F.variant_get(x, "$", "string"))
    fields = F.from_json(F.when(F.startswith(F.trim(metadata), F.lit("{")), metadata), "map<string,variant>")
    kept = F.map_filter(fields, lambda k, v: v.isNotNull() & ~F.is_variant_null(v) & ~F.startswith(kind(v), F.lit("OBJECT")))
    return F.to_json(F.transform_values(kept, lambda k, v: F.when(array(v), F.to_variant_object(of_texts(v))).otherwise(v)))


def page_records(pages: DataFrame, url: str = "url", title: str = "title", body: str = "text", crawled_at: str = "crawled_at") -> DataFrame:
    """Pages (url, title, markdown text, crawled_at, path) in the shape of a page's JSON file; a null text is empty."""
    canonical = F.coalesce(urls.canonical(F.col(url)), F.col(url))
    raw = F.coalesce(F.col(body), F.lit(""))
    clean = texts.normalize_page(raw)
    parts = texts.manual_and_chapter(F.col(title))
    links = F.array_compact(F.array_distinct(F.transform(html.markdown_links(raw), urls.canonical)))
    return pages.select(
        urls.source_id(canonical).alias("source_id"), F.lit(SOURCE_TYPE).alias("source_type"), F.col(url).alias("source_url"), canonical.alias("canonical_url"), F.col(title).alias("title"), texts.language_of_url(canonical).alias("language"),
        parts["manual"].alias("manual"), parts["chapter"].alias("chapter"), F.when(texts.to_text(F.col(title)) != "", F.array(F.col(title))).otherwise(F.array().cast("array<string>")).alias("heading_path"), texts.last_iso_date(clean).alias("last_updated"), F.col(crawled_at).alias("crawl_ts"),
        F.struct(F.lit(200).alias("status_code"), F.lit("text/markdown").alias("content_type")).alias("http"), F.sha2(clean, 256).alias("content_hash"), F.lit(None).cast("string").alias("raw_html_path"), F.col("path").alias("markdown_path"), clean.alias("text"),
        F.struct(links.alias("outbound"), F.array().cast("array<string>").alias("internal_children")).alias("links"),
        F.struct(html.toc_like(clean).alias("is_toc_like"), html.low_text(clean).alias("is_low_text"), F.array().cast("array<string>").alias("notes")).alias("quality"),
    )


def with_sections(records: DataFrame) -> DataFrame:
    """Page records with the sections of their texts as an array in order; a page without any has one, its whole text.

    They are found within the row: pages that are listed twice or whose short ids agree by chance keep their own.
    """
    found = F.transform(chunking.markdown_sections_of(F.col("text")), lambda s: F.struct(s["heading"].alias("heading"), s["heading_path"].alias("heading_path"), s["anchor"].alias("anchor"), s["text"].alias("text")))
    whole = F.struct(F.lit("Document").alias("heading"), F.array(F.lit("Document")).alias("heading_path"), texts.anchor(F.lit("Document")).alias("anchor"), F.col("text").alias("text"))
    return records.withColumn("sections", texts.bound(found, lambda sections: F.when(F.size(sections) > 0, sections).otherwise(F.array(whole))).cast(SECTIONS))


def failed_urls(asked: DataFrame, fetched: DataFrame, url: str = "url") -> DataFrame:
    """The URLs of a batch that were not fetched, to be tried again."""
    return asked.join(fetched.select(url), url, "left_anti")


def history(messages: DataFrame, session: str, order: str) -> DataFrame:
    """(session, title, messages): each session's messages in order with times in milliseconds and citations as arrays of JSON texts, from arrays or texts.

    ``messages`` has role, text, at, citations and the session's title.
    """
    cited = F.coalesce(F.from_json("citations", "array<string>"), F.array().cast("array<string>"))
    one = F.struct(F.col(order).alias("place"), "role", "text", F.unix_millis(F.col("at").cast("timestamp")).alias("at"), cited.alias("citations"))
    got = messages.groupBy(session).agg(F.max("title").alias("title"), F.array_sort(F.collect_list(one)).alias("messages"))
    return got.select(session, "title", F.transform("messages", lambda m: m.dropFields("place")).alias("messages"))
