"""Registered queries of text, URL and rule functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import citations, points, rules, text, urls
from docloom.operators import html
from docloom.operators.guards import blocked
from docloom.operators.tables import keep_first
from docloom.plans.binding import PHRASES, URLS, picked, sql_picked
from docloom.sources.readers import table


def _phrased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a phrase and a URL by id."""
    return table(spark, sf_dir, "documents").select("doc_id", picked(PHRASES, F.col("doc_id")).alias("p"), picked(URLS, F.floor(F.col("doc_id") / len(PHRASES))).alias("u"), "text")


_PHRASED = f"phrased AS (SELECT doc_id, {sql_picked(PHRASES, 'doc_id')} AS p, {sql_picked(URLS, f'doc_id // {len(PHRASES)}')} AS u, text FROM documents)"


def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  "), F.replace(F.col("text"), F.lit(". "), F.lit(" .\r\n\r\n\r\n  ")), F.lit("\t \n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_chunk_input(raw)).alias("chunk_input"), F.md5(text.normalize_user_document(raw)).alias("user_document"), F.md5(text.normalize_page(raw)).alias("page"), F.md5(text.collapse(raw)).alias("collapsed"), text.estimated_tokens(F.col("text")).alias("est_tokens"))


def redact_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.redacted(F.col("text")).alias("redacted"))


def slugs_and_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    slug = text.slug(F.col("url"))
    return pages.select("page_id", slug.alias("slug"), text.anchor(html.title(F.col("html"))).alias("anchor"), text.language_of_url(F.col("url")).alias("language"), F.concat(slug, F.lit("-"), F.substring(F.sha1("url"), 1, 10), F.lit(".md")).alias("file_name"))


def canonical_url_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = urls.canonical(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", c.alias("canonical"), urls.source_id(c).alias("source_id"))


def url_dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", urls.dedupe_key(F.col("url")).alias("key"))
    return keep_first(pages.where("key is not null"), ["key"], ["page_id"]).select("page_id", "url")


def source_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = (*urls.ALLOWED_HOSTS[:6], *urls.BLOCKED_HOSTS)
    paths = ("/eng/acts/I-2.5/", "/fc-cf/decisions/1", "/eng/x", "/en/ircc/x", "/ads/x", "/wp-content/y", "/x/outbound/z", "/other")
    url = F.concat(F.lit("https://"), picked(hosts, F.col("page_id")), picked(paths, F.floor(F.col("page_id") / len(hosts))))
    url = F.when(F.col("page_id") % 11 == 3, F.col("url")).when(F.col("page_id") % 13 == 5, "no address").otherwise(url)
    return table(spark, sf_dir, "pages").select("page_id", urls.policy_reason(url).alias("reason"))


def family_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    families = (*urls.FAMILIES_ALLOWED, *urls.FAMILIES_DENIED, "PDI")
    own = picked(families, F.col("page_id"))
    return table(spark, sf_dir, "pages").select("page_id", own.alias("family"), urls.family_reason(own).alias("reason"), urls.max_live_fetches(own).alias("max_live_fetches"))


def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _phrased(spark, sf_dir)
    meta = rules.metadata(F.lit("Title"), F.col("u"), F.array(F.lit("Heading")), F.col("p"))
    return rows.select("doc_id", meta.alias("m")).select("doc_id", "m.*")


def doc_family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = chunk_metadata(spark, sf_dir).groupBy("doc_family", "authority_level", "jurisdiction").agg(F.count("*").alias("n"))
    return got


def case_law_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _phrased(spark, sf_dir)
    return rows.select("doc_id", rules.case_law_intent(F.col("p")).alias("case_law"), rules.domain_relevant(F.col("p")).alias("relevant"), rules.vague(F.col("p")).alias("vague"))


def injection_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.injected_lines(F.col("p"))
    return _phrased(spark, sf_dir).select("doc_id", F.size(found).alias("score"), F.array_join(found, "|").alias("lines"), rules.sanitized(F.col("p")).alias("sanitized"), blocked(F.col("p")).alias("blocked"))


def citation_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrased(spark, sf_dir).select("doc_id", F.array_join(citations.tokens(F.col("p")), ",").alias("tokens"), citations.validated(F.col("p"), F.array(F.lit("P1"), F.lit("C3"))).alias("validated"))


def citation_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("vec_id") % 5 != 0, (F.col("vec_id") % 130) / 100.0)
    ref = F.concat(picked(("P", "C", "D"), F.col("vec_id")), (F.col("vec_id") + 1).cast("string"))
    source = F.struct(
        F.lit("").alias("source_type"), F.when(F.col("vec_id") % 2 == 0, F.lit("Case A")).alias("title"), F.lit("Name B").alias("case_name"), F.lit("Src").alias("source"), F.lit("FC").alias("court"), F.lit("2020 FC 1").alias("neutral_citation"),
        F.lit("2020-01-01").alias("date"), F.lit("file.pdf").alias("document_name"), F.when(F.col("vec_id") % 3 == 1, F.lit("cit")).alias("citation"), F.lit("ENF").alias("manual"), F.lit("2").alias("chapter"), F.lit(None).cast("string").alias("url"), F.lit("http://x").alias("source_url"),
        F.lit(" snip ").alias("snippet"), F.lit("t").alias("text"), score.alias("score"), F.array(F.lit("1"), F.lit("2"), F.lit("2.8"), F.lit("x")).alias("paragraphs"),
    )
    c = citations.citation(ref, source)
    got = table(spark, sf_dir, "embeddings").select("vec_id", c.alias("c"))
    return got.select("vec_id", "c.reference_id", "c.source_type", "c.title", "c.locator", "c.citation", F.array_join(F.transform("c.paragraph_numbers", lambda x: x.cast("string")), ",").alias("paragraphs"), "c.relevance")


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrased(spark, sf_dir).select("doc_id", F.array_join(text.query_terms(F.col("p")), " ").alias("terms"), text.dataset_code(F.col("p")).alias("dataset"))


def decision_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.when(F.col("doc_id") % 4 == 0, F.concat(F.substring("text", 1, 700), F.lit(" The appeal is dismissed. "), F.expr("substring(text, 701)"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.excerpt(body, F.array(F.lit("tion"), F.lit("ment")), 400)).alias("excerpt"))


def points_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    levels = tuple(points.EDUCATION)
    p = F.struct(
        (k % 2 == 0).alias("has_spouse"), (k % 32 + 16).cast("int").alias("age"), picked(levels, k).alias("education"), *[(F.floor(k / d) % 10 + 3).cast("int").alias(f"clb_{s}") for s, d in zip(points.SKILLS, (1, 3, 5, 7))],
        (k % 8 - 1).cast("int").alias("local_work"), (F.floor(k / 2) % 5).cast("int").alias("foreign_work"), picked(levels, F.floor(k / 3)).alias("spouse_education"), *[(F.floor(k / d) % 8 + 3).cast("int").alias(f"spouse_clb_{s}") for s, d in zip(points.SKILLS, (2, 4, 6, 8))],
        (k % 3).cast("int").alias("spouse_work"), (k % 17 == 0).alias("nominated"), picked(tuple(points.LOCAL_EDUCATION), F.floor(k / 5)).alias("local_education"), (k % 12).cast("int").alias("french_clb"), (k % 7 == 0).alias("sibling"),
    )
    return table(spark, sf_dir, "customer").select("c_custkey", points.score(p).alias("s")).select("c_custkey", "s.*")


def _cases(values: dict, key: str, at: int | None = None) -> str:
    return f"(CASE {key} " + " ".join(f"WHEN {k!r} THEN {v if at is None else v[at]}" for k, v in values.items()) + " ELSE 0 END)"


def _both(values: dict, key: str) -> str:
    return f"(CASE WHEN sp THEN {_cases(values, key, 1)} ELSE {_cases(values, key, 0)} END)"


_STEP = lambda c: "(CASE " + " ".join(f"WHEN {c} >= {a} THEN {b}" for a, b in points.SPOUSE_LANGUAGE) + " ELSE 0 END)"
_CANON = r"""
parts AS (SELECT page_id, url, regexp_extract(trim(url), '^(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?', ['scheme', 'host', 'path', 'query']) AS r FROM pages),
cut AS (
  SELECT page_id, url, r.scheme AS scheme, lower(r.host) AS host, regexp_replace(CASE WHEN r.path = '' THEN '/' ELSE r.path END, '/{2,}', '/', 'g') AS path,
         list_sort(list_transform(list_filter(string_split(r.query, '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_') AND NOT list_contains({tracking}, lower(string_split(p, '=')[1]))), lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END)) AS params
  FROM parts),
canon AS (
  SELECT page_id, url, CASE WHEN host <> '' THEN scheme || '://' || regexp_replace(host, CASE WHEN scheme = 'http' THEN ':80$' ELSE ':443$' END, '') || CASE WHEN path = '/' THEN path ELSE rtrim(path, '/') END
         || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS canonical FROM cut)""".replace("{tracking}", "[" + ", ".join(f"'{t}'" for t in urls.TRACKING) + "]")
_RAW = "raw AS (SELECT doc_id, text, '  ' || replace(text, '. ', ' .' || chr(13) || chr(10) || chr(13) || chr(10) || chr(13) || chr(10) || '  ') || chr(9) || ' ' || chr(10) AS t FROM documents)"


def _replaced(expression: str, *steps: tuple[str, str]) -> str:
    for pattern, to in steps:
        expression = f"regexp_replace({expression}, '{pattern}', {to}, 'g')"
    return f"regexp_replace({expression}, '^\\s+|\\s+$', '', 'g')"


_LF, _TWO = "chr(10)", "chr(10) || chr(10)"
_LOW = "lower(p)"
_COMBINED = "lower('Title | ' || u || ' | Heading | ' || left(p, 200))"


def _family_sql() -> str:
    parts = []
    for family, pattern in rules.DOC_FAMILY:
        extra = "".join(f" OR contains(lower(u), '{x}')" for x in rules.DOC_FAMILY_URLS.get(family, ()))
        parts.append(f"WHEN {rules.sql_matches('c', pattern)}{extra} THEN '{family}'")
    return "CASE " + " ".join(parts) + f" ELSE '{rules.DOC_FAMILY_DEFAULT}' END"


_META = f"""{_PHRASED}, low AS (SELECT doc_id, p, u, {_COMBINED} AS c FROM phrased), fam AS (SELECT *, {_family_sql()} AS doc_family, regexp_extract(p, '(?i)\\b([RA])(\\d{{1,3}})((?:\\([a-z0-9]+\\))*)', ['m', 'n', 's']) AS tok FROM low),
meta AS (
  SELECT doc_id, doc_family, {rules.sql_lookup('doc_family', rules.AUTHORITY, rules.AUTHORITY_DEFAULT)} AS authority_level, {rules.sql_lookup('doc_family', rules.JURISDICTION, rules.JURISDICTION_DEFAULT)} AS jurisdiction,
    coalesce({rules.sql_first_match('c', rules.INSTRUMENT)}, CASE {' '.join(f"WHEN contains(lower(u), '{x}') THEN '{v}'" for v, x in rules.INSTRUMENT_URLS)} END, {rules.sql_lookup('doc_family', rules.INSTRUMENT_BY_FAMILY)}, '{rules.INSTRUMENT_DEFAULT}') AS instrument,
    CASE upper(tok.m) WHEN 'R' THEN 'IRPR_' || tok.n WHEN 'A' THEN 'IRPA_A' || tok.n ELSE '' END || CASE WHEN regexp_matches(tok.s, '^\\(\\d+\\)') THEN '_' ELSE '' END || lower(regexp_replace(tok.s, '[()]', '', 'g')) AS section_id,
    {rules.sql_first_match('c', rules.PROGRAM_STREAM, '')} AS program_stream, nullif(regexp_extract(p, '(?i)\\bNOC\\s*([0-9]{{4,5}})\\b', 1), '') AS noc_code, nullif(regexp_extract(p, '(?i)\\bTEER\\s*([0-5])\\b', 1), '') AS teer, {rules.sql_first_match('c', rules.TABLE_TYPE, '')} AS table_type
  FROM fam)"""
_POLICY_HOSTS = (*urls.ALLOWED_HOSTS[:6], *urls.BLOCKED_HOSTS)
_POLICY_PATHS = ("/eng/acts/I-2.5/", "/fc-cf/decisions/1", "/eng/x", "/en/ircc/x", "/ads/x", "/wp-content/y", "/x/outbound/z", "/other")
_QUOTE = lambda xs: ", ".join(f"'{x}'" for x in xs)
_FETCHES = rules.sql_lookup("family", {k: str(v) for k, v in urls.MAX_LIVE_FETCHES.items()}, "0")

QUERIES = {
    "normalized_text": normalized_text, "redact_pii": redact_pii, "slugs_and_titles": slugs_and_titles, "canonical_url_fast": canonical_url_fast, "url_dedupe_keep_first": url_dedupe_keep_first, "source_policy": source_policy,
    "family_policy": family_policy, "chunk_metadata": chunk_metadata, "doc_family_counts": doc_family_counts, "case_law_intent": case_law_intent, "injection_scan": injection_scan, "citation_tokens": citation_tokens,
    "citation_fields": citation_fields, "query_terms": query_terms, "decision_excerpt": decision_excerpt, "points_score": points_score,
}
SQL = {
    "normalized_text": f"""WITH {_RAW} SELECT doc_id,
  md5({_replaced('t', ('\\r\\n?', _LF), ('[ \\t]+\\n', _LF), ('\\n[ \\t]+', _LF), ('[ \\t]{2,}', "' '"), ('\\n{3,}', _TWO))}) AS chunk_input,
  md5({_replaced('t', ('\\r\\n?', _LF), ('[ \\t]+\\n', _LF), ('\\n{3,}', _TWO))}) AS user_document,
  md5({_replaced('t', ('\\r\\n?', _LF), ('\\n{3,}', _TWO), ('[ \\t]{2,}', "' '"))}) AS page,
  md5(trim(regexp_replace(t, '\\s+', ' ', 'g'))) AS collapsed, ceil(length(text) / 4.0)::INTEGER AS est_tokens FROM raw""",
    "redact_pii": r"SELECT doc_id, left(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[REDACTED_EMAIL]', 'g'), '\b[0-9]{6,}\b', '[REDACTED_NUMBER]', 'g'), 300) AS redacted FROM documents",
    "slugs_and_titles": r"""WITH s AS (SELECT *, coalesce(nullif(lower(regexp_replace(regexp_replace(regexp_replace(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', ''), '/')[-1], '\.html?$', ''), '[^A-Za-z0-9_-]+', '-', 'g'), '^[-_]+|[-_]+$', '', 'g')), ''), 'page') AS slug FROM pages)
SELECT page_id, slug, '#' || regexp_replace(regexp_replace(lower(coalesce(nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), ''), 'Untitled')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS anchor, CASE WHEN contains(lower(url), '/fr/') THEN 'fr' ELSE 'en' END AS language, slug || '-' || left(sha1(url), 10) || '.md' AS file_name FROM s""",
    "canonical_url_fast": f"WITH {_CANON} SELECT page_id, canonical, 'pdi_' || left(sha1(canonical), 12) AS source_id FROM canon",
    "url_dedupe_keep_first": f"WITH {_CANON} SELECT min(page_id) AS page_id, arg_min(url, page_id) AS url FROM canon WHERE canonical IS NOT NULL GROUP BY canonical",
    "source_policy": f"""WITH made AS (SELECT page_id, CASE WHEN page_id % 11 = 3 THEN url WHEN page_id % 13 = 5 THEN 'no address' ELSE 'https://' || {sql_picked(_POLICY_HOSTS, 'page_id')} || {sql_picked(_POLICY_PATHS, f'page_id // {len(_POLICY_HOSTS)}')} END AS url FROM pages),
cut AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]*)', 1)) AS h, coalesce(nullif(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), ''), '/') AS p FROM made)
SELECT page_id, CASE WHEN h = '' THEN 'INVALID_URL' WHEN h IN ({_QUOTE(urls.BLOCKED_HOSTS)}) THEN 'HOST_BLOCKED' WHEN {' OR '.join(f"contains(p, '{x}')" for x in urls.BLOCKED_PATHS)} THEN 'PATH_BLOCKED'
  WHEN h NOT IN ({_QUOTE(urls.ALLOWED_HOSTS)}) THEN 'HOST_NOT_ALLOWED' WHEN {' OR '.join(f"(h = '{k}' AND NOT (" + ' OR '.join(f"starts_with(p, '{x}')" for x in v) + '))' for k, v in urls.ALLOWED_PATHS.items())} THEN 'PATH_NOT_ALLOWED' ELSE 'ALLOWED' END AS reason FROM cut""",
    "family_policy": f"""WITH f AS (SELECT page_id, {sql_picked((*urls.FAMILIES_ALLOWED, *urls.FAMILIES_DENIED, 'PDI'), 'page_id')} AS family FROM pages)
SELECT page_id, family, CASE WHEN family IN ({_QUOTE(urls.FAMILIES_ALLOWED)}) THEN 'ALLOWED' {' '.join(f"WHEN family = '{k}' THEN '{v}'" for k, v in urls.FAMILIES_DENIED.items())} ELSE 'UNKNOWN_DOC_FAMILY' END AS reason, ({_FETCHES})::INTEGER AS max_live_fetches FROM f""",
    "chunk_metadata": f"WITH {_META} SELECT * FROM meta",
    "doc_family_counts": f"WITH {_META} SELECT doc_family, authority_level, jurisdiction, count(*) AS n FROM meta GROUP BY ALL",
    "case_law_intent": f"WITH {_PHRASED} SELECT doc_id, {rules.sql_matches(_LOW, rules.CASE_LAW_INTENT)} AS case_law, {rules.sql_matches(_LOW, rules.any_of(rules.DOMAIN))} AS relevant, length(trim(p)) < 16 OR {rules.sql_matches(_LOW, rules.VAGUE)} AS vague FROM phrased",
    "injection_scan": f"""WITH {_PHRASED}, l AS (SELECT doc_id, p, list_transform(string_split(p, chr(10)), lambda x: trim(x)) AS ls FROM phrased),
m AS (SELECT doc_id, p, list_filter(ls, lambda x: x <> '' AND {rules.sql_matches('lower(x)', rules.any_of(rules.INJECTION))}) AS bad, array_to_string(list_filter(ls, lambda x: x <> '' AND NOT {rules.sql_matches('lower(x)', rules.any_of(rules.INJECTION))}), chr(10)) AS kept FROM l)
SELECT doc_id, len(bad)::INTEGER AS score, array_to_string(bad, '|') AS lines, CASE WHEN trim(kept) = '' THEN trim(p) ELSE trim(kept) END AS sanitized, len(bad) > 0 AND NOT {rules.sql_matches(_LOW, rules.any_of(rules.DOMAIN))} AS blocked FROM m""",
    "citation_tokens": rf"""WITH {_PHRASED}, t AS (SELECT doc_id, p, list_transform(regexp_extract_all(p, '(?i)\[\s*([PCD]\d+)\s*\]', 1), lambda x: upper(x)) AS ids FROM phrased)
SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN list_position(ids, ids[i]) = i THEN ids[i] END), lambda x: x IS NOT NULL), ','), '') AS tokens,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p, '(?i)\[\s*(p1|c3)\s*\]', '{{\1}}', 'g'), '(?i)\[\s*[PCD]\d+\s*\]', '', 'g'), '\{{[pP](\d+)\}}', '[P\1]', 'g'), '\{{[cC](\d+)\}}', '[C\1]', 'g'), '\s+([,.;:!?])', '\1', 'g'), '[ \t]{{2,}}', ' ', 'g').trim() AS validated FROM t""",
    "citation_fields": f"""WITH v AS (SELECT vec_id, {sql_picked(('P', 'C', 'D'), 'vec_id')} || (vec_id + 1) AS reference_id, CASE WHEN vec_id % 5 <> 0 THEN (vec_id % 130) / 100.0::DOUBLE END AS score, CASE WHEN vec_id % 3 = 1 THEN 'cit' END AS citation FROM embeddings)
SELECT vec_id, reference_id, CASE left(reference_id, 1) WHEN 'D' THEN 'user_document' WHEN 'C' THEN 'a2aj_case' ELSE 'pinecone' END AS source_type, CASE WHEN vec_id % 2 = 0 THEN 'Case A' ELSE 'Name B' END AS title,
  CASE left(reference_id, 1) WHEN 'C' THEN 'FC | 2020 FC 1 | 2020-01-01' WHEN 'D' THEN concat_ws(' | ', 'file.pdf', citation) ELSE concat_ws(' | ', 'ENF', '2', citation) END AS locator, coalesce(citation, '2020 FC 1') AS citation, '1,2,2' AS paragraphs,
  CASE WHEN score IS NULL THEN 80 ELSE greatest(0, least(100, floor(score * 100 + 0.5))) END::INTEGER AS relevance FROM v""",
    "query_terms": f"""WITH {_PHRASED} SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(p), '[^a-z0-9]+'), lambda w: len(w) >= 4 AND NOT list_contains([{_QUOTE(text.STOPWORDS)}], w))[1:8], ' ') AS terms,
  CASE WHEN regexp_full_match(upper(trim(p)), '[A-Z0-9-]{{2,20}}') THEN upper(trim(p)) {' '.join(f"WHEN contains(trim(regexp_replace(lower(p), '[^a-z0-9]+', ' ', 'g')), '{n}') THEN '{v}'" for v, n, _ in text.DATASETS)} END AS dataset FROM phrased""",
    "decision_excerpt": f"""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN left(text, 700) || ' The appeal is dismissed. ' || substring(text, 701) ELSE text END AS t FROM documents),
f AS (SELECT doc_id, t, coalesce({', '.join(f"nullif(strpos(lower(t), '{m}'), 0)" for m in (*text.EXCERPT_MARKERS, 'tion', 'ment'))}, 1) AS k FROM b)
SELECT doc_id, md5(substring(t, greatest(k - 120, 1), 400)) AS excerpt FROM f""",
    "points_score": f"""WITH k AS (SELECT c_custkey, c_custkey AS k, c_custkey % 2 = 0 AS sp, c_custkey % 32 + 16 AS age, {sql_picked(tuple(points.EDUCATION), 'c_custkey')} AS ed, {sql_picked(tuple(points.EDUCATION), 'c_custkey // 3')} AS sed, {sql_picked(tuple(points.LOCAL_EDUCATION), 'c_custkey // 5')} AS led,
  c_custkey % 10 + 3 AS a, c_custkey // 3 % 10 + 3 AS b, c_custkey // 5 % 10 + 3 AS c, c_custkey // 7 % 10 + 3 AS d, c_custkey % 8 - 1 AS lw, c_custkey // 2 % 5 AS fw, c_custkey // 2 % 8 + 3 AS sa, c_custkey // 4 % 8 + 3 AS sb, c_custkey // 6 % 8 + 3 AS sc, c_custkey // 8 % 8 + 3 AS sd FROM customer),
x AS (SELECT *, least(a, b, c, d) AS lo, ed IN ({_QUOTE(points.ADVANCED)}) AS adv FROM k),
s AS (SELECT c_custkey, {_both(points.AGE, 'age')} AS age, {_both(points.EDUCATION, 'ed')} AS education, {' + '.join(_both(points.LANGUAGE, c) for c in 'abcd')} AS language, {_both(points.WORK, 'greatest(least(lw, 5), 0)')} AS work,
  CASE WHEN sp THEN {_cases(points.SPOUSE_EDUCATION, 'sed')} + {' + '.join(_STEP(c) for c in ('sa', 'sb', 'sc', 'sd'))} + CASE WHEN k % 3 >= 1 THEN 10 ELSE 0 END ELSE 0 END AS spouse,
  least(100, CASE WHEN adv AND lo >= 9 THEN 50 ELSE 0 END + CASE WHEN adv AND lw >= 1 THEN 50 ELSE 0 END + CASE WHEN fw >= 3 AND lo >= 9 THEN 50 ELSE 0 END + CASE WHEN fw >= 3 AND lw >= 1 THEN 50 ELSE 0 END) AS transfer,
  CASE WHEN k % 17 = 0 THEN 600 ELSE 0 END + {_cases(points.LOCAL_EDUCATION, 'led')} + CASE WHEN k % 12 >= 7 THEN CASE WHEN lo >= 5 THEN 50 ELSE 25 END ELSE 0 END + CASE WHEN k % 7 = 0 THEN 15 ELSE 0 END AS additional FROM x)
SELECT *, age + education + language + work + spouse + transfer + additional AS total FROM s""",
}
