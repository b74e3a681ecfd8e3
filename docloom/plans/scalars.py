"""Registered queries of the remaining scalar functions, checks and state tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import points, text, urls
from docloom.operators import guards, html, reports, retrieval, tables
from docloom.plans.binding import FAMILIES, picked, sql_picked
from docloom.plans.text import QUERIES as TEXT_QUERIES
from docloom.plans.text import SQL as TEXT_SQL
from docloom.sources import readers
from docloom.sources.readers import table

TITLES = ("ENF 2 - Evaluating - Part A", "Chapter", " - ", "IP 5 - Immigrant")
FILES = ("enf01-eng.pdf", "Some Long File Name.pdf", "op12a.pdf")
TYPES = ("text/html; charset=utf-8", "application/xhtml+xml", "application/pdf", "image/png")
TARGETS = ("https://www.canada.ca/en/corporate/publications-manuals/operational-bulletins-manuals/x.html", "https://ircc.canada.ca/english/visit/visas.asp", "https://www.canada.ca/en/services/transit/without-visa", "https://www.canada.ca/en/services/other", "https://other.org/visit/visas.asp", "https://www.canada.ca/en/corporate/publications-manuals/operational-bulletins-manuals/x.pdf")


def title_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    parts = text.manual_and_chapter(picked(TITLES, k))
    return table(spark, sf_dir, "documents").select("doc_id", parts["manual"].alias("manual"), parts["chapter"].alias("chapter"), text.manual_code(picked(FILES, k)).alias("code"), text.title_of_slug(F.lit("temporary-resident_visas")).alias("title"))


def line_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    body = F.concat(F.lit("\n  "), "text", F.lit(" ![i](u.png) [label](http://x.y)\nDate modified: 2023-0"), (k % 9 + 1).cast("string"), F.lit("-11 and 2024-02-02\n"))
    return table(spark, sf_dir, "documents").select("doc_id", text.first_line(F.regexp_replace(body, r"[ \t]+", " ")).alias("first_line"), html.last_updated(body).alias("last_updated"), text.last_iso_date(body).alias("last_date"), F.md5(text.clean_markdown(body)).alias("markdown"))


def notices_and_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    years = text.year_range((k % 60 + 1980).cast("int"), F.when(k % 3 != 0, (2030 - k % 50).cast("int")).when(k % 2 == 0, 99))
    head = text.analysis_date_header(F.when(k % 2 == 0, F.concat(F.lit(" body "), k)).when(k % 3 == 0, "Analysis date basis: x").otherwise(""), F.lit("2024-01-01"), "explicit_as_of")
    meta = text.meta_line(authority_level=F.when(k % 2 == 0, "statute"), doc_family=F.lit(" MI "), tier=F.when(k % 5 == 0, ""))
    return table(spark, sf_dir, "customer").select("c_custkey", years["start_date"].alias("start_date"), years["end_date"].alias("end_date"), head.alias("header"), meta.alias("meta"), text.page_range((k % 4).cast("int"), F.when(k % 2 == 0, (k % 4 + 2).cast("int"))).alias("pages"), text.clamped_int(F.when(k % 4 == 0, "x").otherwise((k % 40).cast("string")), 8, 1, 16).alias("clamped"), text.with_notice(F.when(k % 2 == 0, "n here"), F.lit("n")).alias("noticed"))


def content_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    kind, target = picked(TYPES, k), picked(TARGETS, k)
    return table(spark, sf_dir, "pages").select("page_id", urls.is_html(kind).alias("is_html"), urls.is_pdf(kind, F.col("url")).alias("is_pdf"), urls.ingestion_target(target).alias("target"), urls.crawl_allowed(target).alias("allowed"))


def url_unwrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").where("url is not null")
    inner = F.concat(F.lit("https://out.example.org/r?x=1&"), picked(("url=", "next=", "myurl="), F.col("page_id")), F.when(F.col("page_id") % 4 == 1, F.translate(F.base64("url"), "+/\r\n", "-_")).otherwise(F.url_encode("url")))
    wrapped = pages.withColumn("wrapped", F.when(F.col("page_id") % 2 == 0, inner).when(F.col("page_id") % 4 == 1, inner).otherwise(F.col("url")))
    return urls.with_canonical(wrapped, "wrapped", "canonical").select("page_id", "canonical")


def payload_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's payload of URLs, nested and wrapped, flattened; of each address the first form stays, and what is no URL is dropped."""
    url, quoted = F.col("url"), lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    wrapped = F.concat(F.lit("https://out.example.org/r?x=1&url="), F.url_encode(url), F.lit("&utm_source=t"))
    payload = F.concat(F.lit('{"urls":['), quoted(wrapped), F.lit(',[{"href":'), quoted(F.concat(url, F.lit("#again"))), F.lit(',"n":12}],null,12,"not-a-url","https://b.example.org//x/?b=2&utm_source=1&a=1",["https://b.example.org//x?a=1&b=2"]],"other":"https://c.example.org"}'))
    flat = table(spark, sf_dir, "pages").where("url is not null").select("page_id", F.posexplode(urls.payload_strings(payload)).alias("pos", "u")).select("page_id", "pos", urls.kept_form(F.col("u")).alias("url"), urls.dedupe_key(F.col("u")).alias("key"))
    return tables.keep_first(flat.where("key is not null"), ["page_id", "key"], ["pos"]).select("page_id", "pos", "url")


def points_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = TEXT_QUERIES["points_score"](spark, sf_dir)
    parts = points.breakdown(F.struct("*"), F.col("c_custkey") % 2 == 0)
    rows = scored.select("c_custkey", F.explode(parts).alias("p"))
    return rows.groupBy("p.category", "p.most").agg(F.count("*").alias("n"), F.sum("p.points").alias("points"))


def vector_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    values = F.when(k % 5 == 0, F.slice("embedding", 1, 63)).when(k % 7 == 0, F.transform("embedding", lambda x, i: F.when(i != 3, x))).when(k % 13 == 0, F.transform("embedding", lambda x, i: F.when(i == 2, F.lit(float("inf"))).otherwise(x.cast("double")))).otherwise(F.col("embedding"))
    record = F.struct(F.when(k % 11 != 0, k.cast("string")).otherwise(" ").alias("id"), values.alias("values"), F.when(k % 3 != 0, "t").alias("text"))
    return table(spark, sf_dir, "embeddings").select("vec_id", guards.vector_valid(record, 64).alias("valid"))


def page_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    page = F.struct(F.concat(F.lit("pdi_"), k).alias("source_id"), F.when(k % 3 == 0, "ftp://x").otherwise(F.col("url")).alias("source_url"), F.when(k % 4 == 0, "").otherwise("t").alias("title"), F.lit("x").alias("text"), F.when(k % 5 != 0, urls.canonical(F.col("url"))).when(k % 2 == 0, "https://other.org/").otherwise("").alias("canonical_url"), F.when(k % 6 == 1, "other").otherwise(guards.SOURCE_TYPE).alias("source_type"), F.array(F.struct(F.lit("h").alias("heading"), F.lit("t").alias("text")), F.struct(F.when(k % 7 == 0, " ").otherwise("h").alias("heading"), F.when(k % 8 != 0, "t").alias("text"))).alias("sections"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(guards.page_errors(page, urls.canonical(F.col("url"))), "; ").alias("errors"))


def gold_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("item_id")
    gold = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("q"), k).alias("query"), F.when(k % 6 == 0, "soon").otherwise("2024-01-01").alias("as_of"), F.array(picked(FAMILIES, k)).alias("expected_doc_families"), F.array(F.lit("statute")).alias("must_cite_authority_levels"), F.array(F.lit("VOI")).alias("must_not_cite_doc_families"), F.lit("NONE").alias("expected_failure_state"))
    runs = table(spark, sf_dir, "benchmark").where("item_id % 9 <> 0").select(F.concat(F.lit("q"), k).alias("query"), F.when(k % 2 == 0, F.array(picked(FAMILIES, k))).otherwise(F.array(F.lit("VOI"))).alias("doc_families"), F.when(k % 5 == 0, F.array(F.lit("manual"))).otherwise(F.array(F.lit("statute"))).alias("authority_levels"), F.when(k % 7 == 0, "BUDGET_EXCEEDED").otherwise("NONE").alias("failure_state"))
    errors = gold.select("query", F.size(reports.gold_errors(F.struct("*"))).alias("n_errors"))
    return reports.gold_outcomes(runs, gold).join(errors, "query").select("query", F.array_join("reasons", ",").alias("reasons"), "passed", "n_errors")


def ingest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of files by path after two runs; the later run counts."""
    docs = table(spark, sf_dir, "documents")
    run = lambda n: docs.where(F.col("doc_id") % 3 != n).select(F.concat(F.lit("f"), F.col("doc_id") % 300).alias("path"), F.sha2("text", 256).alias("content_hash"), F.when(F.length("text") < 300, "failed").otherwise("upserted").alias("status"), (F.col("doc_id") * 2 + n).alias("version"))
    return reports.status_counts(tables.upserted(run(0), run(1), ["path"], "version"), "status")


def lookup_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases' limits from a small configuration table, joined by name."""
    limits = readers.dimension(spark, {"click": (3, "a"), "view": (5, "b"), "purchase": (1, None)}, "event_type string, most int, note string")
    got = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return got.join(limits, "event_type", "left").select("event_type", "n", F.coalesce("most", F.lit(0)).alias("most"), "note")


def embedded_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in embedder: unit vectors, or zero for texts without words."""
    v = retrieval.hashed_embedding(F.col("text"), 32)
    got = table(spark, sf_dir, "benchmark").select("item_id", v.alias("v"))
    return got.select("item_id", F.size("v").alias("dims"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("squared"))


QUERIES = {f.__name__: f for f in (title_parts, line_functions, notices_and_dates, content_kinds, url_unwrap, payload_urls, points_breakdown, vector_checks, page_checks, gold_evaluation, ingest_state, lookup_state, embedded_questions)}
_CANON = TEXT_SQL["canonical_url_fast"].partition("SELECT page_id, canonical, ")[0]
SQL = {
    "title_parts": f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'ENF 2' WHEN 1 THEN 'Chapter' WHEN 3 THEN 'IP 5' END AS manual, CASE doc_id % 4 WHEN 0 THEN 'Evaluating - Part A' WHEN 3 THEN 'Immigrant' END AS chapter,
  CASE doc_id % 3 WHEN 0 THEN 'enf01' WHEN 1 THEN 'some_long_file_name' ELSE 'op12a' END AS code, 'Temporary Resident Visas' AS title FROM documents""",
    "line_functions": r"""WITH b AS (SELECT doc_id, chr(10) || '  ' || text || ' ![i](u.png) [label](http://x.y)' || chr(10) || 'Date modified: 2023-0' || (doc_id % 9 + 1) || '-11 and 2024-02-02' || chr(10) AS t FROM documents)
SELECT doc_id, regexp_extract(regexp_replace(t, '[ \t]+', ' ', 'g'), '(?m)^\s*(\S.*?)\s*$', 1) AS first_line, '2023-0' || (doc_id % 9 + 1) || '-11' AS last_updated, '2024-02-02' AS last_date,
  md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '[ \t]{2,}', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS markdown FROM b""",
    "notices_and_dates": """WITH y AS (SELECT c_custkey AS k, c_custkey % 60 + 1980 AS a, CASE WHEN c_custkey % 3 <> 0 THEN 2030 - c_custkey % 50 END AS b FROM customer)
SELECT k AS c_custkey, CASE WHEN b IS NULL THEN a ELSE least(a, b) END || '-01-01' AS start_date, CASE WHEN b IS NULL THEN NULL ELSE greatest(a, b) || '-12-31' END AS end_date,
  CASE WHEN k % 2 = 0 THEN 'Analysis date basis: 2024-01-01 (explicit_as_of)' || chr(10) || chr(10) || 'body ' || k WHEN k % 3 = 0 THEN 'Analysis date basis: x' ELSE 'Analysis date basis: 2024-01-01 (explicit_as_of)' END AS header,
  CASE WHEN k % 2 = 0 THEN 'authority_level=statute, ' ELSE '' END || 'doc_family=MI' AS meta, CASE WHEN k % 2 = 0 THEN 'pp. ' || k % 4 || '-' || (k % 4 + 2) ELSE 'p. ' || k % 4 END AS pages,
  CASE WHEN k % 4 = 0 THEN 8 ELSE greatest(1, least(16, k % 40)) END::INTEGER AS clamped, CASE WHEN k % 2 = 0 THEN 'n here' ELSE 'n' END AS noticed FROM y""",
    "content_kinds": """SELECT page_id, page_id % 4 IN (0, 1) AS is_html, page_id % 4 = 2 OR ends_with(lower(coalesce(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '')), '.pdf') AS is_pdf, page_id % 6 IN (0, 1, 2, 5) AS target, page_id % 6 IN (0, 1, 2) AS allowed FROM pages""",
    "url_unwrap": f"{_CANON} SELECT page_id, canonical FROM canon WHERE url IS NOT NULL",
    "payload_urls": "SELECT page_id, 0 AS pos, regexp_replace(url, '#.*$', '') AS url FROM pages WHERE url IS NOT NULL UNION ALL SELECT page_id, 3, 'https://b.example.org//x/?b=2&utm_source=1&a=1' FROM pages WHERE url IS NOT NULL",
    "points_breakdown": "WITH s AS (" + TEXT_SQL["points_score"] + """), p AS (SELECT c_custkey % 2 = 0 AS sp, * FROM s),
l AS (SELECT 'Age' AS category, CASE WHEN sp THEN 100 ELSE 110 END AS most, age AS points FROM p UNION ALL SELECT 'Education', CASE WHEN sp THEN 140 ELSE 150 END, education FROM p UNION ALL SELECT 'First Official Language', CASE WHEN sp THEN 128 ELSE 136 END, language FROM p
  UNION ALL SELECT 'Canadian Work Experience', CASE WHEN sp THEN 70 ELSE 80 END, work FROM p UNION ALL SELECT 'Spouse Factors', 40, spouse FROM p WHERE sp UNION ALL SELECT 'Skill Transferability', 100, transfer FROM p UNION ALL SELECT 'Additional Points', 600, additional FROM p WHERE additional > 0)
SELECT category, most, count(*) AS n, sum(points)::BIGINT AS points FROM l GROUP BY ALL""",
    "vector_checks": "SELECT vec_id, vec_id % 5 <> 0 AND vec_id % 7 <> 0 AND vec_id % 13 <> 0 AND vec_id % 11 <> 0 AND vec_id % 3 <> 0 AS valid FROM embeddings",
    "page_checks": "SELECT page_id, concat_ws('; ', CASE WHEN page_id % 10 = 5 THEN 'canonical_url is required' END, CASE WHEN page_id % 4 = 0 THEN 'title is required' END, CASE WHEN page_id % 6 = 1 THEN 'source_type is not guidance_pdi' END, CASE WHEN page_id % 3 = 0 THEN 'source_url is not http' END, CASE WHEN page_id % 10 = 0 THEN 'canonical_url differs' END, CASE WHEN page_id % 7 = 0 THEN 'section 1 has no heading' WHEN page_id % 8 = 0 THEN 'section 1 has no text' END) AS errors FROM pages",
    "gold_evaluation": f"""WITH g AS (SELECT item_id AS k, {sql_picked(FAMILIES, 'item_id')} AS fam FROM benchmark),
r AS (SELECT k, fam, concat_ws(',', CASE WHEN k % 9 = 0 THEN 'not run' END, CASE WHEN k % 9 = 0 OR (k % 2 = 1 AND fam <> 'VOI') THEN 'missing family' END, CASE WHEN k % 9 <> 0 AND (k % 2 = 1 OR fam = 'VOI') THEN 'barred family' END, CASE WHEN k % 9 = 0 OR k % 5 = 0 THEN 'missing level' END, CASE WHEN k % 9 = 0 OR k % 7 = 0 THEN 'wrong state' END) AS reasons FROM g)
SELECT 'q' || k AS query, reasons, reasons = '' AS passed, (k % 6 = 0)::INTEGER AS n_errors FROM r""",
    "ingest_state": """WITH u AS (SELECT 'f' || doc_id % 300 AS path, text, doc_id * 2 AS v FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'f' || doc_id % 300, text, doc_id * 2 + 1 FROM documents WHERE doc_id % 3 <> 1)
SELECT status, count(*) AS n FROM (SELECT path, CASE WHEN length(arg_max(text, v)) < 300 THEN 'failed' ELSE 'upserted' END AS status FROM u GROUP BY path) GROUP BY status""",
    "lookup_state": "SELECT event_type, count(*) AS n, CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 5 WHEN 'purchase' THEN 1 ELSE 0 END::INTEGER AS most, CASE event_type WHEN 'click' THEN 'a' WHEN 'view' THEN 'b' END AS note FROM events GROUP BY event_type",
    "embedded_questions": "SELECT item_id, 32 AS dims, 1.0::DOUBLE AS squared FROM benchmark",
}
