"""Registered queries of record shapes, requests and histories, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import matches, rules
from docloom.plans.binding import PHRASES, URLS, picked, sql_picked
from docloom.sources.readers import table

REPLIES = ('{"useCaseLaw": true, "limit": 9, "courts": ["FC", " "], "yearFrom": 2019.7}', 'Sure: {"query": " q ", "limit": 3.5, "reason": "r"} end', "none", "", '{"limit": "x"')
CODES = ("enf01", "VOI 2", "sor-2002", "ip5", "")
DATES = ("Current to March 5, 2021 and on", "last amended on Jan 7, 2020", "Effective date: May 1, 2019", "On 2018-02-03, current to March 5, 2021", "no date", "effective Foo 99, 2020")


def match_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    record = F.map_filter(F.create_map(F.lit("content"), F.concat(F.lit("c"), k), F.lit("text"), F.when(k % 3 == 0, F.concat(F.lit("t"), k)), F.lit("caseName"), F.when(k % 2 == 0, "n"), F.lit("url"), F.lit("u"), F.lit("instrument"), F.when(k % 4 == 0, " A, B,").when(k % 4 == 1, "C"), F.lit("heading_path"), F.when(k % 5 == 0, '["x","y"]').when(k % 5 == 1, " raw ")), lambda a, b: b.isNotNull())
    score = F.when(k % 7 != 0, (k % 10) / 10)
    got = table(spark, sf_dir, "embeddings").select("vec_id", matches.match(record, score).alias("m")).where(matches.good_enough(F.col("m.score"), 0.3))
    return got.select("vec_id", "m.text", "m.title", "m.source_url", F.array_join("m.instrument", "+").alias("instrument"), F.array_join("m.heading_path", "+").alias("heading_path"), "m.score")


def case_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("vec_id")
    record = F.map_filter(F.create_map(F.lit("citation"), F.when(k % 3 != 0, F.concat(F.lit("2020 FC "), k)), F.lit("slug"), F.lit("s"), F.lit("name_fr"), F.when(k % 4 == 0, "nom"), F.lit("summary"), F.when(k % 4 != 1, "<b>a</b>  summary"), F.lit("dataset"), F.lit("FC"), F.lit("year"), F.lit("2020")), lambda a, b: b.isNotNull())
    return table(spark, sf_dir, "embeddings").select("vec_id", matches.case_source(record).alias("c")).where("c is not null").select("vec_id", "c.*")


def router_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = matches.router_decision(picked(REPLIES, F.col("doc_id")), picked(PHRASES, F.col("doc_id")))
    got = table(spark, sf_dir, "documents").select("doc_id", d.alias("d")).select("doc_id", "d.*")
    return got.withColumn("courts", F.array_join("courts", ","))


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    who = matches.identity(F.when(k % 2 == 0, F.concat(F.lit(" h"), k, F.lit(" "))), F.when(k % 3 == 0, F.lit("  ")), F.when(k % 5 == 0, F.lit("q")))
    uuid = F.regexp_replace(F.md5(k.cast("string")), "^(.{8})(.{4}).(.{3}).(.{3})(.{12})$", "$1-$2-4$3-a$4-$5")
    context = matches.date_context(F.when(k % 3 == 0, "2024-01-01").when(k % 3 == 1, "soon"), F.when(k % 2 == 0, "2023-05-05"), F.lit("2025-01-01"))
    return table(spark, sf_dir, "customer").select("c_custkey", who.alias("who"), matches.is_uuid(F.when(k % 4 == 0, "x").otherwise(uuid)).alias("is_uuid"), matches.document_title(F.when(k % 6 == 0, " T ")).alias("title"), context["basis"].alias("basis"), context["date"].alias("date"))


def history_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.struct(m["role"].alias("role"), m["text"].alias("text")))
    got = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(items.alias("messages"))
    return got.select("conv_id", matches.history_title(F.when(F.col("conv_id") % 3 == 0, "given"), F.col("messages")).alias("title"))


def shown_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    token = picked(("[2]", "[p1]", "[C9]", "[x]", "[D3]", "[7]"), F.col("vec_id"))
    return table(spark, sf_dir, "embeddings").select("vec_id", matches.resolved_token(token, F.array(F.lit("C4"), F.lit("P1"), F.lit("z"))).alias("place"))


def legal_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(picked(("See R205, ", "r205(c) and ", "A25(1)x ", "a25 () R205() "), F.col("doc_id")), "text")
    return table(spark, sf_dir, "documents").select("doc_id", matches.enriched_markdown(raw).alias("enriched"))


def effective_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", matches.effective_date_of(picked(DATES, F.col("doc_id"))).alias("effective_date"))


def family_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, u, m = picked(PHRASES, F.col("doc_id")), picked(URLS, F.floor(F.col("doc_id") / len(PHRASES))), picked(CODES, F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", matches.markdown_family(p, u, m).alias("markdown_family"), matches.print_family(p, m).alias("print_family"))


def whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("vec_id") % 50).alias("file"), F.when(F.col("vec_id") % 77 != 5, F.col("embedding")).alias("vector"))
    return matches.whole_files_only(v, "file", "vector").select("vec_id", "file")


def _family(name: str, print_: bool) -> str:
    parts = []
    for family, pattern in rules.DOC_FAMILY:
        if print_:
            test = rules.sql_matches("lower(p)", matches.PRINT_RULES.get(family, pattern)) + (f" OR starts_with(lower(m), '{matches.PRINT_CODES[family]}')" if family in matches.PRINT_CODES else "")
        else:
            test = rules.sql_matches("lower(p)", "enforcement manual" if family == "ENF" else pattern) + "".join(f" OR contains(lower(u), '{x}')" for x in rules.DOC_FAMILY_URLS.get(family, ())) + (" OR starts_with(lower(m), 'enf')" if family == "ENF" else "")
        parts.append(f"WHEN {test} THEN '{family}'")
    return f"CASE {' '.join(parts)} ELSE '{rules.DOC_FAMILY_DEFAULT}' END AS {name}"


QUERIES = {f.__name__: f for f in (match_projection, case_projection, router_decisions, identities, history_titles, shown_tokens, legal_enrichment, effective_dates, family_variants, whole_files)}
SQL = {
    "match_projection": """SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 't' || vec_id ELSE 'c' || vec_id END AS text, CASE WHEN vec_id % 2 = 0 THEN 'n' END AS title, 'u' AS source_url, CASE vec_id % 4 WHEN 0 THEN 'A+B' WHEN 1 THEN 'C' ELSE '' END AS instrument,
  CASE vec_id % 5 WHEN 0 THEN 'x+y' WHEN 1 THEN 'raw' ELSE '' END AS heading_path, CASE WHEN vec_id % 7 <> 0 THEN (vec_id % 10) / 10.0::DOUBLE END AS score FROM embeddings WHERE vec_id % 7 = 0 OR (vec_id % 10) / 10.0::DOUBLE >= 0.3""",
    "case_projection": """SELECT vec_id, CASE WHEN vec_id % 3 <> 0 THEN '2020 FC ' || vec_id ELSE 's' END AS id, CASE WHEN vec_id % 4 = 0 THEN 'nom' ELSE 'Case law source' END AS title, 'FC' AS court, '2020' AS date, CASE WHEN vec_id % 3 <> 0 THEN '2020 FC ' || vec_id END AS neutral_citation, NULL::VARCHAR AS url, 'a summary' AS snippet FROM embeddings WHERE vec_id % 4 <> 1""",
    "router_decisions": f"""SELECT doc_id, doc_id % 5 = 0 AS use_case_law, false AS use_legislation, CASE WHEN doc_id % 5 = 1 THEN 'q' ELSE {sql_picked(PHRASES, 'doc_id')} END AS query, CASE WHEN doc_id % 5 = 0 THEN 'FC' ELSE 'Federal Court,Federal Court of Appeal' END AS courts,
  CASE WHEN doc_id % 5 = 0 THEN 2019 END::INTEGER AS year_from, NULL::INTEGER AS year_to, CASE doc_id % 5 WHEN 0 THEN 5 ELSE 4 END::INTEGER AS "limit", CASE WHEN doc_id % 5 = 1 THEN 'r' ELSE 'default_no_case_law' END AS reason FROM documents""",
    "identities": """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'h' || c_custkey WHEN c_custkey % 3 = 0 THEN 'dev-user' WHEN c_custkey % 5 = 0 THEN 'q' ELSE 'dev-user' END AS who, c_custkey % 4 <> 0 AS is_uuid, CASE WHEN c_custkey % 6 = 0 THEN 'T' ELSE 'Uploaded Document' END AS title,
  CASE WHEN c_custkey % 3 = 0 THEN 'explicit_as_of' WHEN c_custkey % 2 = 0 THEN 'application_date' ELSE 'today' END AS basis, CASE WHEN c_custkey % 3 = 0 THEN '2024-01-01' WHEN c_custkey % 2 = 0 THEN '2023-05-05' ELSE '2025-01-01' END AS date FROM customer""",
    "history_titles": "SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'given' ELSE coalesce(nullif(left(arg_min(text, turn) FILTER (WHERE role = 'user'), 40), ''), 'New Case Research') END AS title FROM conversations GROUP BY conv_id",
    "shown_tokens": "SELECT vec_id, CASE vec_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 4 THEN 2 END::INTEGER AS place FROM embeddings",
    "legal_enrichment": r"""WITH r AS (SELECT doc_id, (['See R205, ', 'r205(c) and ', 'A25(1)x ', 'a25 () R205() '])[doc_id % 4 + 1] || text AS t FROM documents)
SELECT doc_id, replace(replace(regexp_replace(regexp_replace(t, '(?i)\bR205\(?(\w*)\)?', 'R205(\1) (Regulation 205)', 'g'), '(?i)\bA25\(?(\w*)\)?', 'A25(\1) (Act Section 25)', 'g'), 'R205()', 'R205(d)'), 'A25()', 'A25(1)') AS enriched FROM r""",
    "effective_dates": "SELECT doc_id, (['2021-03-05', '2020-01-07', '2019-05-01', '2018-02-03', NULL, NULL])[doc_id % 6 + 1] AS effective_date FROM documents",
    "family_variants": f"WITH x AS (SELECT doc_id, {sql_picked(PHRASES, 'doc_id')} AS p, {sql_picked(URLS, f'doc_id // {len(PHRASES)}')} AS u, {sql_picked(CODES, 'doc_id')} AS m FROM documents) SELECT doc_id, {_family('markdown_family', False)}, {_family('print_family', True)} FROM x",
    "whole_files": "SELECT vec_id, vec_id % 50 AS file FROM embeddings WHERE vec_id % 50 NOT IN (SELECT vec_id % 50 FROM embeddings WHERE vec_id % 77 = 5)",
}
