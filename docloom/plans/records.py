"""Registered queries of records, keys and page parts, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import citations, text
from docloom.operators import html, records
from docloom.sources.readers import table


def sanitized_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    raw = F.concat(
        F.lit('{"id":'), k.cast("string"), F.lit(',"lang":'), F.coalesce(quoted("lang"), F.lit("null")), F.lit(',"size":'), F.when(k % 3 == 0, "null").otherwise(F.col("n_chars").cast("string")),
        F.lit(',"nested":{"a":1},"tags":["x",1,null,{"b":2},'), quoted("source"), F.lit('],"ok":'), F.when(k % 2 == 0, "true").otherwise("false"), F.lit(',"none":[]}'),
    )
    return table(spark, sf_dir, "documents").select("doc_id", records.sanitized_metadata(F.when(k % 17 != 4, raw).otherwise("[1]")).alias("metadata"))


def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit(" Dir/"), "source", F.lit("/File"), "doc_id", F.lit(".MD "))
    return table(spark, sf_dir, "documents").select("doc_id", text.path_key(path).alias("path_key"), text.query_key(F.concat(F.lit("  A  "), F.col("source"), F.lit("\n b"))).alias("query_key"), F.md5(text.content_excerpt(F.col("text"))).alias("excerpt"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    body = F.when(k % 4 == 0, F.regexp_replace("html", "(?is)<h1[^>]*>.*?</h1>", "")).when(k % 4 == 1, "<p>nothing</p>").otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", html.page_title(body).alias("title"))


def root_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(html.root_links(F.col("html"), F.col("url")), " ").alias("links"))


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    url = F.concat(F.lit("https://www.canada.ca/"), F.when(k % 2 == 0, "fr").otherwise("en"), F.lit("/"), k.cast("string"), F.lit("/?utm_source=x"))
    title = F.when(k % 3 == 0, "ENF 2 - Part A").when(k % 3 == 1, "Plain")
    body = F.concat("text", F.when(k % 5 == 0, "\r\n[a](https://a.example.org/x/) https://a.example.org/x 2023-01-02 and 2024-03-04\nContents\nA ..... 7").otherwise(""))
    pages = table(spark, sf_dir, "documents").select(url.alias("url"), title.alias("title"), body.alias("text"), F.lit("2024-01-01T00:00:00Z").alias("crawled_at"), F.concat(F.lit("md/"), "doc_id", F.lit(".md")).alias("path"))
    whole = records.with_sections(records.page_records(pages))
    return whole.select("markdown_path", "source_id", "canonical_url", "language", "manual", "chapter", F.size("heading_path").alias("n_path"), "last_updated", F.array_join("links.outbound", " ").alias("outbound"), "quality.is_toc_like", "quality.is_low_text", F.size("sections").alias("n_sections"), F.get("sections", F.lit(0))["heading"].alias("first_heading"))


def failed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return records.failed_urls(pages.select("page_id", "url"), pages.where("length(html) % 3 > 0").select("url")).select("page_id")


def message_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.timestamp_seconds(k * 60 + 0.25).alias("at"), F.when(k % 3 == 0, '["a","b"]').when(k % 3 == 1, "not a list").alias("citations"), F.lit(None).cast("string").alias("title"))
    got = records.history(rows, "conv_id", "turn").select("conv_id", F.posexplode("messages").alias("place", "m"))
    return got.select("conv_id", "place", "m.role", "m.at", F.array_join("m.citations", "+").alias("citations"))


def citation_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    manual, chapter = F.when(k % 3 != 0, F.lit(" ENF ")), F.when(k % 2 == 0, F.lit("2"))
    title = F.when(k % 5 == 0, "ENF 2 Evaluating").when(k % 5 < 3, "Evaluating")
    shown = citations.shown_title(manual, chapter, title, F.when(k % 7 == 0, "Case"))
    place = citations.shown_locator(F.when(k % 11 == 0, "given"), manual, chapter, F.when(k % 4 == 0, "c").otherwise(""), F.when(k % 6 != 0, k % 6), F.when(k % 6 > 3, k % 6 + 1))
    return table(spark, sf_dir, "embeddings").select("vec_id", shown.alias("title"), place.alias("locator"))


def prompt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    system = F.when(F.col("turn") % 3 != 0, F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.prompt_hashes(system, F.col("text")).alias("h")).select("conv_id", "turn", "h.*")


def citation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    found = text.citation_candidates(F.concat(F.lit(" "), k % 100 + 1950, F.lit(" FC "), k, F.lit(" ")), F.when(k % 2 == 0, F.concat(F.lit("https://a.b/2020 FC "), k)).otherwise("plain"), F.when(k % 3 == 0, F.concat(k % 100 + 1950, F.lit(" FC "), k)), F.lit("see 2001 SCC 7."))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(found, "|").alias("candidates"))


QUERIES = {f.__name__: f for f in (sanitized_metadata, content_keys, page_titles, root_links, page_records, failed_urls, message_history, citation_display, prompt_parts, citation_candidates)}
_TITLE = lambda e, tag: rf"nullif(trim(regexp_replace(regexp_replace(regexp_extract({e}, '(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), '')"
SQL = {
    "sanitized_metadata": """SELECT doc_id, CASE WHEN doc_id % 17 <> 4 THEN '{"id":' || doc_id || coalesce(',"lang":"' || lang || '"', '') || CASE WHEN doc_id % 3 <> 0 THEN ',"size":' || n_chars ELSE '' END || ',"tags":["x","' || source || '"],"ok":' || (doc_id % 2 = 0)::VARCHAR || ',"none":[]}' END AS metadata FROM documents""",
    "content_keys": r"""SELECT doc_id, left(md5('dir/' || lower(source) || '/file' || doc_id || '.md'), 12) AS path_key, sha1('a ' || lower(source) || ' b') AS query_key, md5(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 300)) AS excerpt FROM documents""",
    "page_titles": rf"""WITH b AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_replace(html, '(?is)<h1[^>]*>.*?</h1>', '', 'g') WHEN 1 THEN '<p>nothing</p>' ELSE html END AS h FROM pages) SELECT page_id, coalesce({_TITLE('h', 'h1')}, {_TITLE('h', 'title')}, 'Untitled') AS title FROM b""",
    "root_links": r"""WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1)) AS h FROM pages),
f AS (SELECT page_id, CASE WHEN starts_with(h, 'http') THEN h WHEN starts_with(h, '//') THEN regexp_extract(url, '^(https?:)', 1) || h WHEN starts_with(h, '/') THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || h END AS l FROM h)
SELECT page_id, coalesce(string_agg(DISTINCT l, ' ' ORDER BY l), '') AS links FROM pages LEFT JOIN f USING (page_id) GROUP BY page_id""",
    "page_records": """WITH d AS (SELECT doc_id AS k, 'https://www.canada.ca/' || CASE WHEN doc_id % 2 = 0 THEN 'fr' ELSE 'en' END || '/' || doc_id AS u, text FROM documents)
SELECT 'md/' || k || '.md' AS markdown_path, 'pdi_' || left(sha1(u), 12) AS source_id, u AS canonical_url, CASE WHEN k % 2 = 0 THEN 'fr' ELSE 'en' END AS language, CASE k % 3 WHEN 0 THEN 'ENF 2' WHEN 1 THEN 'Plain' END AS manual, CASE WHEN k % 3 = 0 THEN 'Part A' END AS chapter,
  (k % 3 < 2)::INTEGER AS n_path, CASE WHEN k % 5 = 0 THEN '2024-03-04' ELSE nullif(regexp_extract(text, '^(?s:.*)(20\\d{2}-\\d{2}-\\d{2})', 1), '') END AS last_updated, CASE WHEN k % 5 = 0 THEN 'https://a.example.org/x' ELSE '' END AS outbound,
  k % 5 = 0 AS is_toc_like, length(regexp_replace(regexp_replace(regexp_replace(text || CASE WHEN k % 5 = 0 THEN chr(10) || '[a](https://a.example.org/x/) https://a.example.org/x 2023-01-02 and 2024-03-04' || chr(10) || 'Contents' || chr(10) || 'A ..... 7' ELSE '' END, '^\\s+|\\s+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]{2,}', ' ', 'g')) < 300 AS is_low_text, 1 AS n_sections, 'Document' AS first_heading FROM d""",
    "failed_urls": "SELECT page_id FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE length(html) % 3 > 0 AND url IS NOT NULL)",
    "citation_display": """WITH c AS (SELECT vec_id AS k, CASE WHEN vec_id % 3 <> 0 THEN 'ENF' END AS m, CASE WHEN vec_id % 2 = 0 THEN '2' END AS ch, CASE WHEN vec_id % 5 = 0 THEN 'ENF 2 Evaluating' WHEN vec_id % 5 < 3 THEN 'Evaluating' WHEN vec_id % 7 = 0 THEN 'Case' ELSE 'Source' END AS t FROM embeddings),
x AS (SELECT *, concat_ws(' ', m, ch) AS p FROM c)
SELECT k AS vec_id, CASE WHEN p <> '' AND NOT starts_with(t, p) THEN p || ' ' || t ELSE t END AS title,
  CASE WHEN k % 11 = 0 THEN 'given' ELSE concat_ws(' | ', nullif(p, ''), CASE WHEN k % 4 = 0 THEN 'c' END, CASE WHEN k % 6 > 3 THEN 'pp. ' || k % 6 || '-' || (k % 6 + 1) WHEN k % 6 > 0 THEN 'p. ' || k % 6 END) END AS locator FROM x""",
    "prompt_parts": "SELECT conv_id, turn, sha256(CASE WHEN turn % 3 <> 0 THEN role ELSE '' END || chr(10) || chr(10) || text) AS prompt_hash, sha256(CASE WHEN turn % 3 <> 0 THEN role ELSE '' END) AS system_hash, sha256(text) AS user_hash FROM conversations",
    "citation_candidates": "SELECT o_orderkey, (o_orderkey % 100 + 1950) || ' FC ' || o_orderkey || '|see 2001 SCC 7.' AS candidates FROM orders",
    "message_history": """SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INTEGER AS place, role, turn * 60000 + 250 AS at, CASE WHEN turn % 3 = 0 THEN 'a+b' ELSE '' END AS citations FROM conversations""",
}
