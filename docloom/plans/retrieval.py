"""Registered retrieval queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import rules
from docloom.operators import retrieval
from docloom.plans.binding import PHRASES, SQL_CHUNKS, SQL_QUESTIONS, chunks, picked, questions, sql_picked, sql_profile
from docloom.sources.readers import table

K = 8
BINDING_K, GUIDANCE_K = retrieval.tier_sizes(K)


def _scores(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("query_id", "id", *columns, F.round("score", 6).alias("score"))


def single_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.top_k(questions(spark, sf_dir), chunks(spark, sf_dir), K)
    return _scores(found, "position")


def tiered_sources(spark: SparkSession, sf_dir: str, fallback: bool = False) -> DataFrame:
    return retrieval.tiered(questions(spark, sf_dir), chunks(spark, sf_dir), K, fallback)


def tiered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(retrieval.ranked(retrieval.deduplicated(tiered_sources(spark, sf_dir))), "tier", "rank")


def fallback_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(retrieval.ranked(retrieval.deduplicated(tiered_sources(spark, sf_dir, True))), "tier", "rank")


def compare_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(tiered_sources(spark, sf_dir).where(F.startswith("tier", F.lit("compare_"))), "tier", "position")


def filter_eq_in_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    test = retrieval.compiled({"$and": [{"doc_family": {"$in": ["IRPA", "MI", "PDI"]}}, {"jurisdiction": {"$eq": "federal"}}, {"instrument": {"$in": ["TRV", "WORK"]}}]})
    found = retrieval.top_k(questions(spark, sf_dir), chunks(spark, sf_dir).where(test), K, minimum=0.05)
    return _scores(found, "position")


def authority_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.counts_by(retrieval.deduplicated(tiered_sources(spark, sf_dir)), "authority_level")


def family_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.counts_by(retrieval.deduplicated(tiered_sources(spark, sf_dir)), "doc_family")


def no_binding_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = retrieval.summary(questions(spark, sf_dir), retrieval.deduplicated(tiered_sources(spark, sf_dir)))
    return got.select("query_id", "n_sources", "n_binding", F.array_join("top_ids", ",").alias("top_ids"), "no_binding_found")


def lexical_chunk_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text as a question to the documents of one source."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("owner"))
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("owner"), F.col("doc_id").alias("chunk_index"), "text")
    return retrieval.lexical_rank(asked, docs).select("query_id", "chunk_index", F.round("score", 6).alias("score"), "position")


def query_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of a phrase for every row."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), rules.query_profile(picked(PHRASES, F.col("vec_id"))).alias("profile"))
    got = rows.select("query_id", "profile.*")
    return got.select("query_id", "mode", "requires_binding", F.col("jurisdiction").alias("jurisdiction_asked"), F.col("doc_family").alias("family_asked"), F.array_join("instruments", ",").alias("instruments"), "compare_requested", F.array_join("compare_families", ",").alias("compare_families"), "case_law_requested")


def source_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of conversations, some without an id, of which the first of each id, or of each title and address, stays."""
    k = F.col("turn")
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("query_id"), F.when(k % 3 == 0, (k % 2).cast("string")).when(k % 3 == 1, "").alias("id"), F.col("role").alias("title"), F.when(k % 4 < 2, "u").alias("url"),
        picked(("guidance", "binding", "compare_MI"), k).alias("tier"), k.alias("position"),
    )
    key = retrieval.source_key(F.col("id"), F.col("title"), F.col("url"))
    return retrieval.deduplicated(rows, key).select("query_id", "position", key.alias("key"))


_LIST = lambda levels: "[" + ", ".join(f"'{x}'" for x in levels) + "]"
_LEVELS = {
    "binding": f"CASE mode WHEN 'reference' THEN {_LIST(rules.REFERENCE)} WHEN 'provincial' THEN {_LIST(rules.PROVINCIAL)} WHEN 'case_law' THEN {_LIST(rules.CASE_LAW)} ELSE {_LIST(rules.BINDING)} END",
    "guidance": f"CASE WHEN mode = 'provincial' THEN {_LIST(rules.PROVINCIAL + rules.GUIDANCE)} WHEN mode = 'case_law' THEN {_LIST(rules.CASE_LAW)} WHEN mode = 'reference' THEN {_LIST(rules.GUIDANCE)} WHEN case_law_requested THEN {_LIST(rules.GUIDANCE + rules.CASE_LAW)} ELSE {_LIST(rules.GUIDANCE)} END",
}
_SHARED = "(family_asked = '' OR doc_family = family_asked) AND (len(instruments) = 0 OR list_contains(instruments, instrument)) AND (jurisdiction_asked = 'federal' OR jurisdiction = jurisdiction_asked)"
_PAIRS = f"""{SQL_CHUNKS}, {SQL_QUESTIONS},
pairs AS (SELECT q.*, c.*, list_cosine_similarity(q.q_vector, c.vector) AS score FROM questions q CROSS JOIN chunks c)"""
_NAMES = "query_id, id, doc_family, authority_level, effective_date, score"


def _best(name: str, where: str, k: int, tier: str) -> str:
    return f"{name} AS (SELECT {_NAMES}, {tier} AS tier, position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS position FROM pairs WHERE {where}) WHERE position <= {k})"


def _tiers(fallback: bool = False) -> str:
    binding = f"{_SHARED} AND list_contains({_LEVELS['binding']}, authority_level)"
    guidance = f"{_SHARED} AND list_contains({_LEVELS['guidance']}, authority_level) AND (len(compare_families) < 2 OR list_contains(compare_families, doc_family))"
    parts = [_best("b", binding, BINDING_K, "'binding'"), _best("g", guidance, GUIDANCE_K, "'guidance'")]
    names = ["b", "g"]
    if fallback:
        parts += [_best("bf", "query_id NOT IN (SELECT query_id FROM b)", BINDING_K, "'binding'"), _best("gf", "query_id NOT IN (SELECT query_id FROM g)", GUIDANCE_K, "'guidance'")]
        names += ["bf", "gf"]
    for n in (1, 2):
        parts.append(_best(f"c{n}", f"compare_requested AND len(compare_families) > 1 AND doc_family = compare_families[{n}]", GUIDANCE_K, f"'compare_' || compare_families[{n}]"))
        names.append(f"c{n}")
    order = "CASE tier WHEN 'binding' THEN 0 WHEN 'guidance' THEN 1 ELSE 2 END"
    level = "coalesce(list_position(" + _LIST(rules.AUTHORITY_RANK) + ", authority_level), 99)"
    return ", ".join([
        _PAIRS, *parts, "sources AS (" + " UNION ALL ".join(f"SELECT * FROM {n}" for n in names) + ")",
        f"once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY {order}, tier, position) AS n FROM sources) WHERE n = 1)",
        f"ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {level}, effective_date DESC, id) AS rank FROM once)",
    ])


_RANKED = "SELECT query_id, id, tier, rank::INTEGER AS rank, round(score, 6) AS score FROM ranked"
QUERIES = {
    "tiered_topk": tiered_topk, "single_topk": single_topk, "fallback_topk": fallback_topk, "compare_topk": compare_topk, "filter_eq_in_and": filter_eq_in_and, "authority_mix": authority_mix, "family_mix": family_mix,
    "no_binding_flag": no_binding_flag, "lexical_chunk_rank": lexical_chunk_rank, "query_profile": query_profiles, "source_dedupe": source_dedupe,
}
SQL = {
    "tiered_topk": f"WITH {_tiers()} {_RANKED}",
    "fallback_topk": f"WITH {_tiers(True)} {_RANKED}",
    "single_topk": f"WITH {_PAIRS}, {_best('s', 'true', K, chr(39) + chr(39))} SELECT query_id, id, position::INTEGER AS position, round(score, 6) AS score FROM s",
    "compare_topk": f"WITH {_tiers()} SELECT query_id, id, tier, position::INTEGER AS position, round(score, 6) AS score FROM sources WHERE tier LIKE 'compare%'",
    "filter_eq_in_and": f"""WITH {_PAIRS}, {_best('s', "doc_family IN ('IRPA', 'MI', 'PDI') AND jurisdiction = 'federal' AND instrument IN ('TRV', 'WORK') AND score >= 0.05", K, chr(39) + chr(39))} SELECT query_id, id, position::INTEGER AS position, round(score, 6) AS score FROM s""",
    "authority_mix": f"WITH {_tiers()} SELECT query_id, authority_level AS key, count(*) AS n FROM once GROUP BY ALL",
    "family_mix": f"WITH {_tiers()} SELECT query_id, doc_family AS key, count(*) AS n FROM once GROUP BY ALL",
    "no_binding_flag": f"""WITH {_tiers()}, got AS (
  SELECT query_id, count(*) AS n_sources, count(*) FILTER (WHERE tier = 'binding' AND list_contains({_LIST(rules.BINDING)}, authority_level)) AS n_binding, string_agg(id::VARCHAR, ',' ORDER BY rank) FILTER (WHERE rank <= 10) AS top_ids FROM ranked GROUP BY query_id)
SELECT q.query_id, coalesce(n_sources, 0) AS n_sources, coalesce(n_binding, 0) AS n_binding, coalesce(top_ids, '') AS top_ids, q.requires_binding AND coalesce(n_binding, 0) = 0 AS no_binding_found FROM questions q LEFT JOIN got USING (query_id)""",
    "lexical_chunk_rank": """WITH asked AS (SELECT item_id AS query_id, 'src' || item_id % 20 AS owner, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: len(w) >= 3) AS words FROM benchmark),
scored AS (
  SELECT query_id, doc_id AS chunk_index, least(1.0, CASE WHEN len(words) > 0 THEN len(list_filter(words, lambda w: contains(lower(text), w)))::DOUBLE / len(words) ELSE 0 END
         + CASE WHEN len(words) > 0 AND contains(lower(text), array_to_string(words, ' ')) THEN 0.25 ELSE 0 END) AS score
  FROM asked JOIN documents d ON d.source = asked.owner WHERE trim(text) <> '')
SELECT query_id, chunk_index, round(score, 6) AS score, position::INTEGER AS position FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index) AS position FROM scored) WHERE position <= 4""",
    "source_dedupe": """WITH s AS (SELECT conv_id AS query_id, turn AS position, CASE WHEN turn % 3 = 0 THEN (turn % 2)::VARCHAR WHEN turn % 3 = 1 THEN '' END AS id, role AS title, CASE WHEN turn % 4 < 2 THEN 'u' END AS url, (['guidance', 'binding', 'compare_MI'])[turn % 3 + 1] AS tier FROM conversations),
k AS (SELECT *, coalesce(nullif(coalesce(trim(id), ''), ''), coalesce(title, '') || '|' || coalesce(url, '')) AS key FROM s)
SELECT query_id, position, key FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY CASE tier WHEN 'binding' THEN 0 WHEN 'guidance' THEN 1 ELSE 2 END, tier, position) AS n FROM k) WHERE n = 1""",
    "query_profile": f"WITH asked AS (SELECT vec_id AS query_id, trim(regexp_replace(lower({sql_picked(PHRASES, 'vec_id')}), '\\s+', ' ', 'g')) AS q FROM embeddings), questions AS (SELECT query_id, {', '.join(f'{v} AS {k}' for k, v in sql_profile('q').items())} FROM asked) SELECT query_id, mode, requires_binding, jurisdiction_asked, family_asked, array_to_string(instruments, ',') AS instruments, compare_requested, array_to_string(compare_families, ',') AS compare_families, case_law_requested FROM questions",
}
