"""Registered queries of joins, upserts, reports, guards and traces, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import rules
from docloom.operators import crawl, guards, remote, reports, tables
from docloom.plans.binding import FAMILIES, PHRASES, SQL_CHUNKS, chunks, picked, sql_picked
from docloom.sources import store
from docloom.sources.readers import table

PHASES = ("signup", "view", "click", "purchase", "error", "refund")


def owner_join_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of ready containers of owners, as chunks of documents of sessions."""
    items, boxes, owners = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    got = items.join(boxes.where("o_orderstatus = 'F'"), items["l_orderkey"] == boxes["o_orderkey"]).join(owners.where("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey"))
    return got.groupBy("c_custkey").agg(F.count("*").alias("n_items"), F.countDistinct("o_orderkey").alias("n_containers"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def owner_semi_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return tables.owned(new, table(spark, sf_dir, "customer").where("c_acctbal > 5000"), ["c_custkey"])


def orphan_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return tables.skip_existing(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, ["c_custkey"])


def recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.recent(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role")


def history_top_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("n"))
    return got.orderBy(F.desc("last_turn"), "conv_id").limit(40)


def history_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("conv_id"))
    got = tables.nested(parents, table(spark, sf_dir, "conversations"), "conv_id", "turn", ["role"], "messages")
    title = F.get(F.filter("messages", lambda m: m["role"] == "user"), F.lit(0))["turn"]
    return got.select("conv_id", F.size("messages").alias("n"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), title.alias("first_user_turn"))


def citation_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order asks for three parts and takes the first that a supplier's list has."""
    asked = table(spark, sf_dir, "orders").select("o_orderkey", F.array(*[(F.col("o_orderkey") * m % 3001).alias("x") for m in (7, 11, 13)]).alias("wanted"))
    known = table(spark, sf_dir, "part").where("p_size > 25").select("p_partkey", "p_brand")
    return tables.first_hit(asked, "o_orderkey", "wanted", known, "p_partkey").select("o_orderkey", "p_partkey", "p_brand")


def sync_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "part").where("p_partkey % 10 <> 1").select("p_partkey", "p_brand", "p_size")
    b = table(spark, sf_dir, "part").where("p_partkey % 9 <> 1").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 8 == 1, F.lit(0)).otherwise(F.col("p_size")).alias("p_size"))
    return tables.mismatches(a, b, "p_partkey", ["p_brand", "p_size"])


def content_hash_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.content_deduplicated(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "content_hash")


def duplicate_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.duplicate_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = reports.quality(table(spark, sf_dir, "documents"), "doc_id", "text")
    return got.withColumn("short_examples", F.array_join("short_examples", ","))


def top_first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_first_lines(table(spark, sf_dir, "documents"), "text", "doc_id")


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 400).alias("id"), F.md5("text").alias("hash"), F.col("n_chars").alias("version"))
    return docs.where("version % 2 = 0"), docs.where("version % 2 = 1")


def upsert_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return tables.upserted(old, new, ["id"], "version")


def skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return tables.skip_existing(new, old, ["id"]).groupBy("id").agg(F.count("*").alias("n"))


def replace_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return tables.replaced(old, new.where("version % 3 = 0"), "id").groupBy("id").agg(F.count("*").alias("n"), F.sum("version").alias("versions"))


def upsert_email_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select("c_custkey", F.col("c_name").alias("email"))
    new = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("new "), F.col("c_name"))).alias("email"))
    return tables.coalesce_upserted(old, new, "c_custkey", "email")


def session_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    at = F.col("turn").cast("bigint")
    old = c.where("conv_id % 2 = 0").groupBy(F.col("conv_id").alias("session_id")).agg(F.lit(1).alias("user_id"), F.when(F.col("session_id") % 4 == 0, "kept").otherwise("").alias("title"), F.min(at).alias("updated_at"))
    new = c.where("role = 'user'").select(F.col("conv_id").alias("session_id"), F.when(F.col("conv_id") % 10 == 6, 2).otherwise(1).alias("user_id"), F.concat(F.lit("t"), F.col("turn")).alias("title"), (at + 100).alias("updated_at"))
    return tables.touched_sessions(old, new)


def append_guarded(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), (F.col("conv_id") % 3).alias("user_id"), "turn")
    sessions = c.select("session_id", F.lit(1).cast("bigint").alias("user_id")).distinct()
    return tables.appended(c.where("turn < 2"), c.where("turn >= 2"), sessions).groupBy("session_id").agg(F.count("*").alias("n"))


def chat_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("chat_id"), F.floor(F.col("turn") / 2).alias("message_id"), F.col("turn").alias("ts"), "role")
    return tables.merged_chats(c.where("ts % 2 = 1"), c.where("ts % 2 = 0"))


def active_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    cited = F.array(*[F.struct((F.col("turn") * m % 4).cast("bigint").alias("id"), (F.col("turn") * 10 + m).cast("bigint").alias("value")) for m in (1, 3)])
    return tables.active_citations(c.select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("ts"), cited.alias("citations")))


def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each source, some without one, in an order with ties."""
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("source") != "src3", F.col("source")).alias("source_id"), "doc_id", F.floor(F.col("doc_id") / 2).alias("place"), (F.col("n_chars") * 100_000 + F.col("doc_id")).alias("size"))
    return tables.batches(docs, "source_id", "place", "size", 20, 2_000_000_000).select("source_id", "doc_id", "batch")


def stored_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of orders in storage, merged with later versions of every fourth and with new ones, then with all orders of some customers replaced."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lit(1).alias("version"), F.col("o_totalprice").alias("price"))
    path = f"{crawl.shared_folder(spark)}/orders-{uuid.uuid4().hex}"
    store.created(orders.where("o_orderkey % 5 <> 0"), path, ["o_orderkey"], 32)
    store.merged(orders.where("o_orderkey % 4 = 0 OR o_orderkey % 5 = 0").withColumn("version", F.when(F.col("o_orderkey") % 8 == 0, 0).otherwise(2)).withColumn("price", F.col("price") * 2), path, "version")
    store.sources_replaced(orders.where("o_custkey % 10 = 3 AND o_orderkey % 2 = 0").withColumn("version", F.lit(3)), path, "o_custkey")
    return store.read(spark, path)


def _counted(texts: list[str]) -> list[list[float]]:
    """Stands for a service that does not take all texts."""
    if any(len(t) % 50 == 0 for t in texts):
        raise ValueError("a text is refused")
    return [[float(len(t)), float(t.count(" "))] for t in texts]


def embedded_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    got = remote.embedded(docs, _counted, "source", "doc_id", "text", batch_size=8)
    return got.select("source", "doc_id", "place", "batch", F.col("vector")[0].alias("n_chars"), F.col("vector")[1].alias("n_spaces"), "error")


def embedding_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return remote.batch_errors(remote.embedded(docs, _counted, "source", "doc_id", "text", batch_size=8), "source")


def even_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.when(F.col("source") != "src3", F.col("source")).alias("source_id"), "doc_id", F.col("n_chars").alias("size"))
    return tables.even_batches(docs, "source_id", "doc_id", "size", 100, 20_000).select("source_id", "doc_id", "batch")


def chunk_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first items of each customer's finished orders, newest orders first."""
    boxes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("session_id"), F.when(F.col("o_orderstatus") == "F", "ready").otherwise("open").alias("status"), F.col("o_orderdate").alias("updated_at"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index"))
    return tables.chunk_pool(items, boxes, 10).select("session_id", "document_id", "chunk_index", "position")


def replaced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents after new chunks of some came."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), "turn")
    parents = c.groupBy("id").agg(F.max("turn").alias("updated_at"))
    new = c.where("turn % 3 = 1").withColumn("at", F.col("turn") + 2)
    chunks, touched = tables.chunks_replaced(c, new, parents, "id", "at")
    return chunks.groupBy("id").agg(F.count("*").alias("n_chunks")).join(touched, "id")


def appended_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions after their owners' later messages were appended."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), (F.col("conv_id") % 3).alias("user_id"), "turn")
    sessions = c.groupBy("session_id").agg(F.lit(1).cast("bigint").alias("user_id"), F.min("turn").alias("updated_at"))
    return tables.appended_and_touched(c.where("turn < 2"), c.where("turn >= 2"), sessions, "turn")[1]


def unique_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.unique_count(table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 9 != 0, F.col("source")).when(F.col("doc_id") % 2 == 0, "").alias("source")), "source")


def ingest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(k.alias("source"), picked(("ingested", "skipped", "failed", "ingested"), k).alias("status"), (k % 5).alias("n_sections"), (k % 11).alias("n_chunks"), F.when(k % 13 != 0, k % 11).alias("n_upserted"))
    return reports.ingest_stats(runs)


def page_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    section = lambda h: F.struct(h.alias("heading"))
    pages = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(k % 5 != 0, "2024-01-01").when(k % 2 == 0, "").alias("last_updated"), F.when(k % 7 == 0, F.array().cast("array<string>")).when(k % 7 != 1, F.array("lang")).alias("heading_path"), F.when(k % 11 != 0, F.array(section(F.col("lang")), section(F.when(k % 3 != 0, "h").otherwise("")))).alias("sections"))
    return reports.quality(pages, "doc_id", "text", last_updated="last_updated", heading_path="heading_path", sections="sections").drop("short_examples")


def trace_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.sampled_log(table(spark, sf_dir, "events"), "event_id", 0.1).select("event_id")


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    return c.withColumn("instruments", F.when(F.col("id") % 5 == 0, F.concat("instrument", F.lit(", BAD"))).when(F.col("id") % 3 == 0, "").otherwise(F.col("instrument")))


def validate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = {"authority_level": rules.AUTHORITY_RANK, "effective_date": None, "instruments": tuple(v for v, _ in rules.INSTRUMENT), "doc_family": FAMILIES[:8]}
    got = reports.field_presence(_fields(spark, sf_dir), allowed)
    return got.withColumn("presence_pct", F.round("presence_pct", 4)).withColumn("fails", reports.strict_failures(got, ["authority_level", "effective_date"], True))


def enum_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.value_distribution(chunks(spark, sf_dir), ["doc_family", "authority_level", "jurisdiction"])


def idempotency_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 50).alias("source_id"), "l_linenumber", "l_partkey")
    return reports.repeated_keys(lines, ["source_id", "l_linenumber", "l_partkey"])


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    guess = docs.select("doc_id", F.contains("text", F.lit("###")).cast("int").alias("guess"))
    joined = guess.join(labels.select("doc_id", (1 - F.col("quality")).alias("expected")), "doc_id", "left")
    return reports.evaluation(joined, "expected", "guess")


def budget_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.budget_counters(table(spark, sf_dir, "events"), "user_id", "event_type", {"tool_calls": ["click", "view"], "live_fetches": ["purchase"]})


def trace_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.phase_traces(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", F.col("value") < 20)


def trace_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guards.run_traces(trace_phases(spark, sf_dir), "user_id", "event_type", PHASES)


def trace_contract_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    trace = F.struct(F.when(k % 3 == 0, "bad").otherwise(F.upper(F.substring(F.translate(F.md5(k.cast("string")), "ilou", "0000"), 1, 26))).alias("trace_id"), F.when(k % 5 == 0, "2024-1-1").otherwise("2024-01-01").alias("as_of"), F.when(k % 7 == 0, "none").otherwise(F.col("event_type")).alias("phase"), F.when(k % 11 == 0, "soon").otherwise("2024-01-01T00:00:00").alias("started_at"), F.lit("2024-01-01 00:00:01").alias("completed_at"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(guards.trace_errors(trace, PHASES), "; ").alias("errors"))


def contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    record = F.map_filter(F.create_map(F.lit("id"), k.cast("string"), F.lit("kind"), F.col("event_type"), F.lit("extra"), F.when(k % 4 == 0, "x"), F.lit("day"), F.when(k % 3 != 0, F.date_format("ts", "yyyy-MM-dd"))), lambda a, b: b.isNotNull())
    errors = guards.contract_errors(record, ["id", "day"], {"kind": PHASES[:3]}, {"day": r"-0[1-9]$"}, ["id", "kind", "day"])
    return table(spark, sf_dir, "events").select("event_id", F.array_join(errors, "; ").alias("errors"))


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    answers = docs.select(F.col("doc_id").alias("run_id"), picked(PHRASES, F.col("doc_id")).alias("text"), (F.col("doc_id") % 3 != 0).alias("requires_binding"), (F.col("doc_id") % 4).alias("n_binding"))
    refs = F.explode(F.array(F.lit("P1"), F.lit("C2"), F.lit("C3"))).alias("ref_id")
    cited = docs.select(F.col("doc_id").alias("run_id"), refs).select("run_id", "ref_id", F.when((F.col("run_id") + F.length("ref_id")) % 2 == 0, "statute").otherwise("manual").alias("authority_level"), F.when(F.col("run_id") % 5 < 2, "2024-01-01").otherwise("").alias("effective_date"))
    return answers, cited


def authority_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = guards.answer_levels(*_answers(spark, sf_dir))
    got = answers.withColumn("issues", guards.guard_issues(F.col("text"), F.col("requires_binding"), F.col("n_binding"), F.col("n_cited"), F.col("has_binding"), F.col("has_date")))
    return got.select("run_id", "n_cited", F.array_join("issues", ",").alias("issues"), guards.guarded(F.col("text"), F.col("issues")).alias("guarded"))


def failure_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    issues = F.split("issues", ",")
    k = F.col("run_id")
    state = guards.failure_state(k % 13 == 0, k % 5, F.lit(3), k % 7, F.when(k % 2 == 0, 5).otherwise(0), issues, k % 3, F.col("n_cited"), picked(PHRASES, k))
    got = authority_guard(spark, sf_dir).select("run_id", state.alias("state"))
    return got.join(guards.failure_states(spark).select(F.col("code").alias("state"), "severity", "retryable"), "state")


_EVENTS = "SELECT user_id, event_type, count(*) AS n, count(*) FILTER (WHERE value < 20) AS bad, min(ts) AS started_at, max(ts) AS completed_at FROM events GROUP BY ALL"
_PHASED = f"phased AS (SELECT user_id, event_type, n, started_at, completed_at, round((epoch_us(completed_at) - epoch_us(started_at)) / 1000.0)::BIGINT AS duration_ms, CASE WHEN bad = 0 THEN 'SUCCESS' WHEN bad = n THEN 'FAILED' ELSE 'PARTIAL' END AS status FROM ({_EVENTS}))"
_VERSIONS = "docs AS (SELECT doc_id % 400 AS id, md5(text) AS hash, n_chars AS version FROM documents), olds AS (SELECT * FROM docs WHERE version % 2 = 0), news AS (SELECT * FROM docs WHERE version % 2 = 1)"
_GUARD = f"""answers AS (SELECT doc_id AS run_id, {sql_picked(PHRASES, 'doc_id')} AS text, doc_id % 3 <> 0 AS requires_binding, doc_id % 4 AS n_binding FROM documents),
refs AS (SELECT run_id, unnest(list_distinct(list_transform(regexp_extract_all(text, '(?i)\\[\\s*([PCD]\\d+)\\s*\\]', 1), lambda x: upper(x)))) AS ref_id FROM answers),
cited AS (SELECT run_id, count(*) AS n_cited, bool_or((run_id + length(ref_id)) % 2 = 0) AS has_binding, bool_or(run_id % 5 < 2) AS has_date FROM refs WHERE ref_id IN ('P1', 'C2', 'C3') GROUP BY run_id),
lev AS (SELECT a.*, coalesce(n_cited, 0) AS n_cited, coalesce(has_binding, false) AS has_binding, coalesce(has_date, false) AS has_date FROM answers a LEFT JOIN cited USING (run_id)),
iss AS (SELECT *, requires_binding AND n_binding = 0 AS i1, {rules.sql_matches('lower(text)', rules.BINDING_LANGUAGE)} AND NOT has_binding AS i2, {rules.sql_matches('lower(text)', rules.TEMPORAL_LANGUAGE)} AND n_cited > 0 AND NOT has_date AS i3 FROM lev)"""
_NOTE = lambda flag, notice: f"CASE WHEN {flag} THEN '{notice}' || chr(10) || chr(10) ELSE '' END"
_ASKED = sql_picked(PHRASES, "run_id")
_VAGUE = f"(length(trim({_ASKED})) < 16 OR {rules.sql_matches('lower(' + _ASKED + ')', rules.VAGUE)})"
_STATES = ", ".join(f"('{c}', '{s}', {str(r not in guards.NO_RETRY).lower()})" for c, s, r, _ in guards.FAILURE_STATES)

QUERIES = {f.__name__: f for f in (
    owner_join_chain, owner_semi_guard, orphan_anti, recent_messages, history_top_sessions, history_nested, citation_first_hit, sync_mismatches, content_hash_dedupe, duplicate_hash_groups, quality_report, top_first_lines,
    upsert_latest_wins, skip_existing, replace_source, upsert_email_coalesce, session_touch, append_guarded, chat_merge, active_citations, greedy_batches, even_batches, embedded_batches, embedding_errors, stored_merge, chunk_pool, replaced_chunks, appended_sessions, unique_sources, ingest_stats, page_quality_report, trace_sample, validate_fields, enum_distribution, idempotency_check,
    eval_summary, budget_counters, trace_phases, trace_runs, trace_contract_errors, contract_check, authority_guard, failure_state,
)}
_CALLED = """WITH p AS (SELECT source, doc_id, coalesce(text, '') AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place FROM documents),
b AS (SELECT *, bool_or(length(t) % 50 = 0) OVER (PARTITION BY source, place // 8) AS refused FROM p)"""
SQL = {
    "owner_join_chain": "SELECT c_custkey, count(*) AS n_items, count(DISTINCT o_orderkey) AS n_containers, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING' GROUP BY c_custkey",
    "owner_semi_guard": "SELECT o_custkey AS c_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
    "orphan_anti": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "recent_messages": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3",
    "history_top_sessions": "SELECT conv_id, max(turn) AS last_turn, count(*) AS n FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id LIMIT 40",
    "history_nested": "SELECT p.conv_id, count(c.turn)::INTEGER AS n, coalesce(string_agg(c.role, ',' ORDER BY c.turn), '') AS roles, min(c.turn) FILTER (WHERE c.role = 'user') AS first_user_turn FROM (SELECT c_custkey AS conv_id FROM customer) p LEFT JOIN conversations c USING (conv_id) GROUP BY p.conv_id",
    "citation_first_hit": """WITH w AS (SELECT o_orderkey, unnest([1, 2, 3]) AS pos, unnest([o_orderkey * 7 % 3001, o_orderkey * 11 % 3001, o_orderkey * 13 % 3001]) AS p_partkey FROM orders),
h AS (SELECT o_orderkey, p_partkey, p_brand, row_number() OVER (PARTITION BY o_orderkey ORDER BY pos) AS n FROM w JOIN part USING (p_partkey) WHERE p_size > 25)
SELECT o_orderkey, h.p_partkey, h.p_brand FROM orders LEFT JOIN (SELECT * FROM h WHERE n = 1) h USING (o_orderkey)""",
    "sync_mismatches": "SELECT p_partkey, CASE WHEN p_partkey % 10 = 1 THEN 'missing_left' WHEN p_partkey % 9 = 1 THEN 'missing_right' ELSE 'different' END AS problem FROM part WHERE (p_partkey % 10 = 1) <> (p_partkey % 9 = 1) OR (p_partkey % 10 <> 1 AND p_partkey % 9 <> 1 AND p_partkey % 8 = 1 AND p_size <> 0)",
    "content_hash_dedupe": "SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents GROUP BY sha256(text)",
    "duplicate_hash_groups": "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
    "quality_report": """WITH b AS (SELECT doc_id, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents), h AS (SELECT count(*) AS n FROM b GROUP BY sha256(text))
SELECT count(*) AS total, count(*) FILTER (WHERE t = '') AS empty, count(*) FILTER (WHERE t <> '' AND length(t) < 400) AS short, array_to_string(list_sort(list(DISTINCT doc_id) FILTER (WHERE length(t) < 400))[1:20], ',') AS short_examples,
  (SELECT count(*) FROM h WHERE n > 1) AS duplicate_groups, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM h WHERE n > 1) AS duplicates FROM b""",
    "top_first_lines": "SELECT line, count(*) AS n, min(doc_id) AS first FROM (SELECT doc_id, regexp_extract(text, '(?m)^\\s*(\\S.*?)\\s*$', 1) AS line FROM documents) WHERE line <> '' GROUP BY line ORDER BY n DESC, first LIMIT 10",
    "upsert_latest_wins": f"WITH {_VERSIONS} SELECT id, hash, version FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC, hash DESC) AS n FROM docs) WHERE n = 1",
    "skip_existing": f"WITH {_VERSIONS} SELECT id, count(*) AS n FROM news WHERE id NOT IN (SELECT id FROM olds) GROUP BY id",
    "replace_source": f"WITH {_VERSIONS}, n AS (SELECT * FROM news WHERE version % 3 = 0), u AS (SELECT * FROM olds WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n) SELECT id, count(*) AS n, sum(version)::BIGINT AS versions FROM u GROUP BY id",
    "upsert_email_coalesce": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new ' || c_name WHEN c_custkey % 3 <> 0 THEN c_name END AS email FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 2 = 0",
    "session_touch": """WITH olds AS (SELECT conv_id AS session_id, 1 AS user_id, CASE WHEN conv_id % 4 = 0 THEN 'kept' ELSE '' END AS title, min(turn) AS updated_at FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id),
reqs AS (SELECT conv_id AS session_id, CASE WHEN conv_id % 10 = 6 THEN 2 ELSE 1 END AS user_id, arg_min('t' || turn, turn) AS title, max(turn) + 100 AS ts FROM conversations WHERE role = 'user' GROUP BY ALL)
SELECT o.session_id, o.user_id, CASE WHEN o.title = '' THEN coalesce(r.title, o.title) ELSE o.title END AS title, greatest(o.updated_at, coalesce(r.ts, o.updated_at)) AS updated_at FROM olds o LEFT JOIN reqs r USING (session_id, user_id)
UNION ALL SELECT session_id, user_id, title, ts FROM reqs WHERE session_id NOT IN (SELECT session_id FROM olds)""",
    "append_guarded": "SELECT conv_id AS session_id, count(*) AS n FROM conversations WHERE turn < 2 OR conv_id % 3 = 1 GROUP BY conv_id",
    "chat_merge": "SELECT chat_id, message_id, ts, role FROM (SELECT conv_id AS chat_id, turn // 2 AS message_id, turn AS ts, role, row_number() OVER (PARTITION BY conv_id, turn // 2 ORDER BY 1 - turn % 2, turn) AS n FROM conversations) WHERE n = 1",
    "active_citations": """WITH f AS (SELECT conv_id AS chat_id, turn * m % 4 AS citation_id, turn * 10 + m AS value, turn * 2 + i AS spot FROM conversations, (VALUES (0, 1), (1, 3)) v(i, m)),
g AS (SELECT chat_id, citation_id, arg_max(value, spot) AS value, min(spot) AS first_spot FROM f GROUP BY ALL) SELECT chat_id, citation_id, value, row_number() OVER (PARTITION BY chat_id ORDER BY first_spot)::INTEGER AS place FROM g""",
    "stored_merge": """WITH o AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS p FROM orders),
merged AS (SELECT k, c, CASE WHEN k % 5 = 0 OR k % 4 = 0 AND k % 8 <> 0 THEN CASE WHEN k % 8 = 0 THEN 0 ELSE 2 END ELSE 1 END AS version, CASE WHEN k % 5 = 0 OR k % 4 = 0 AND k % 8 <> 0 THEN p * 2 ELSE p END AS price FROM o),
named AS (SELECT DISTINCT c FROM o WHERE c % 10 = 3 AND k % 2 = 0)
SELECT k AS o_orderkey, c AS o_custkey, version, price FROM merged WHERE c NOT IN (SELECT c FROM named) UNION ALL SELECT k, c, 3, p FROM o WHERE c % 10 = 3 AND k % 2 = 0""",
    "embedded_batches": f"{_CALLED} SELECT source, doc_id, place, place // 8 AS batch, CASE WHEN NOT refused THEN length(t)::DOUBLE END AS n_chars, CASE WHEN NOT refused THEN (length(t) - length(replace(t, ' ', '')))::DOUBLE END AS n_spaces, CASE WHEN refused THEN 'a text is refused' END AS error FROM b",
    "embedding_errors": f"{_CALLED} SELECT source, 'embed' AS stage, min(place) AS start_index, max(place) AS end_index, 'a text is refused' AS message FROM b WHERE refused GROUP BY source, place // 8",
    "even_batches": """WITH o AS (SELECT CASE WHEN source <> 'src3' THEN source END AS source_id, doc_id, n_chars AS size FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY doc_id) - 1 AS r, greatest(1, least(100, floor(20000 / avg(size) OVER (PARTITION BY source_id)))) AS fits FROM o)
SELECT source_id, doc_id, (r // fits::BIGINT)::BIGINT AS batch FROM n""",
    "chunk_pool": """SELECT o_custkey AS session_id, o_orderkey AS document_id, l_linenumber AS chunk_index, position::INTEGER AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey, l_linenumber) AS position FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F') WHERE position <= 10""",
    "replaced_chunks": """WITH n AS (SELECT conv_id AS id, count(*) AS n, max(turn) + 2 AS ts FROM conversations WHERE turn % 3 = 1 GROUP BY conv_id), p AS (SELECT conv_id AS id, count(*) AS n, max(turn) AS ts FROM conversations GROUP BY conv_id)
SELECT p.id, coalesce(n.n, p.n) AS n_chunks, greatest(p.ts, coalesce(n.ts, p.ts)) AS updated_at FROM p LEFT JOIN n USING (id)""",
    "appended_sessions": "SELECT conv_id AS session_id, 1::BIGINT AS user_id, CASE WHEN conv_id % 3 = 1 THEN greatest(min(turn), coalesce(max(turn) FILTER (WHERE turn >= 2), min(turn))) ELSE min(turn) END AS updated_at FROM conversations GROUP BY conv_id",
    "unique_sources": "SELECT count(DISTINCT source) AS n_unique, count(*) AS n_rows FROM documents WHERE doc_id % 9 <> 0 AND source <> ''",
    "ingest_stats": """WITH r AS (SELECT o_orderkey AS k, o_orderkey % 4 IN (0, 3) AS done FROM orders)
SELECT count(*) AS found, count(*) FILTER (WHERE done) AS ingested, count(*) FILTER (WHERE k % 4 = 1) AS skipped, count(*) FILTER (WHERE k % 4 = 2) AS failed,
  (sum(k % 5) FILTER (WHERE done))::BIGINT AS sections, (sum(k % 11) FILTER (WHERE done))::BIGINT AS chunks, (sum(k % 11) FILTER (WHERE done AND k % 13 <> 0))::BIGINT AS upserted FROM r""",
    "page_quality_report": """WITH b AS (SELECT doc_id AS k, text, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents), h AS (SELECT count(*) AS n FROM b GROUP BY sha256(text))
SELECT count(*) AS total, count(*) FILTER (WHERE t = '') AS empty, count(*) FILTER (WHERE t <> '' AND length(t) < 400) AS short, count(*) FILTER (WHERE k % 5 = 0) AS missing_last_updated, count(*) FILTER (WHERE k % 7 < 2) AS missing_heading_path,
  sum(CASE WHEN k % 11 = 0 THEN 1 WHEN k % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS bad_sections, (SELECT count(*) FROM h WHERE n > 1) AS duplicate_groups, (SELECT coalesce(sum(n - 1), 0)::BIGINT FROM h WHERE n > 1) AS duplicates FROM b""",
    "greedy_batches": """WITH RECURSIVE o AS (SELECT coalesce(source_id, '-') AS source_id, doc_id, size, row_number() OVER (PARTITION BY source_id ORDER BY doc_id // 2, size) AS r FROM (SELECT CASE WHEN source <> 'src3' THEN source END AS source_id, doc_id, n_chars * 100000 + doc_id AS size FROM documents)),
walk AS (
  SELECT source_id, doc_id, r, 0::BIGINT AS batch, 1::BIGINT AS n, size AS bytes FROM o WHERE r = 1
  UNION ALL SELECT o.source_id, o.doc_id, o.r, w.batch + (w.n + 1 > 20 OR w.bytes + o.size > 2000000000)::BIGINT, CASE WHEN w.n + 1 > 20 OR w.bytes + o.size > 2000000000 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n + 1 > 20 OR w.bytes + o.size > 2000000000 THEN o.size ELSE w.bytes + o.size END
  FROM walk w JOIN o ON o.source_id = w.source_id AND o.r = w.r + 1)
SELECT nullif(source_id, '-') AS source_id, doc_id, batch FROM walk""",
    "trace_sample": "SELECT event_id FROM events WHERE ('0x' || left(md5(event_id::VARCHAR), 8))::BIGINT < 429496729",
    "validate_fields": f"""WITH {SQL_CHUNKS}, f AS (SELECT *, CASE WHEN id % 5 = 0 THEN instrument || ', BAD' WHEN id % 3 = 0 THEN '' ELSE instrument END AS instruments FROM chunks),
l AS (SELECT 'authority_level' AS field, authority_level AS v, false AS bad FROM f UNION ALL SELECT 'effective_date', effective_date, false FROM f UNION ALL SELECT 'instruments', instruments, contains(instruments, 'BAD') FROM f
      UNION ALL SELECT 'doc_family', doc_family, doc_family IN ('NOC2021', 'OINP') FROM f),
g AS (SELECT field, count(*) FILTER (WHERE v <> '') AS present, count(*) FILTER (WHERE v = '') AS missing, count(*) FILTER (WHERE bad) AS invalid, count(*) AS total FROM l GROUP BY field)
SELECT field, present, missing, invalid, round(100.0::DOUBLE * present / total, 4) AS presence_pct, field IN ('authority_level', 'effective_date') AND (missing > 0 OR invalid > 0) AS fails FROM g""",
    "enum_distribution": f"WITH {SQL_CHUNKS} SELECT field, value, count(*) AS n FROM (SELECT unnest(['doc_family', 'authority_level', 'jurisdiction']) AS field, unnest([doc_family, authority_level, jurisdiction]) AS value FROM chunks) WHERE value <> '' GROUP BY ALL",
    "idempotency_check": "SELECT l_orderkey % 50 AS source_id, l_linenumber, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "eval_summary": "WITH j AS (SELECT contains(text, '###')::INTEGER AS guess, 1 - quality AS expected FROM documents LEFT JOIN labels USING (doc_id)) SELECT count(*) AS total, count(*) FILTER (WHERE expected = guess) AS passed, count(*) FILTER (WHERE expected <> guess) AS failed, count(*) FILTER (WHERE expected IS NULL) AS skipped FROM j",
    "budget_counters": "SELECT user_id, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS tool_calls, count(*) FILTER (WHERE event_type = 'purchase') AS live_fetches FROM events GROUP BY user_id",
    "trace_phases": f"WITH {_PHASED} SELECT * FROM phased",
    "trace_runs": f"""WITH {_PHASED} SELECT user_id, count(*) AS n_phases, string_agg(status, ',' ORDER BY started_at, event_type) AS statuses, array_to_string(list_sort(list_filter([{', '.join(f"'{p}'" for p in PHASES)}], lambda x: NOT list_contains(list(event_type), x))), ',') AS skipped,
  round((epoch_us(max(completed_at)) - epoch_us(min(started_at))) / 1000.0)::BIGINT AS duration_ms FROM phased GROUP BY user_id""",
    "trace_contract_errors": f"""SELECT event_id, concat_ws('; ', CASE WHEN event_id % 3 = 0 THEN 'trace_id must be a ULID' END, CASE WHEN event_id % 5 = 0 THEN 'as_of must be YYYY-MM-DD' END, CASE WHEN event_id % 7 = 0 OR event_type NOT IN ({', '.join(f"'{p}'" for p in PHASES)}) THEN 'phase is unknown' END, CASE WHEN event_id % 11 = 0 THEN 'started_at is no time' END) AS errors FROM events""",
    "contract_check": """SELECT event_id, concat_ws('; ', CASE WHEN event_id % 3 = 0 THEN 'day is required' END, CASE WHEN event_type NOT IN ('signup', 'view', 'click') THEN 'kind is not allowed' END, CASE WHEN event_id % 3 <> 0 AND NOT regexp_matches(strftime(ts, '%Y-%m-%d'), '-0[1-9]$') THEN 'day does not match' END, CASE WHEN event_id % 4 = 0 THEN 'extra is unexpected' END) AS errors FROM events""",
    "authority_guard": f"""WITH {_GUARD} SELECT run_id, n_cited, concat_ws(',', CASE WHEN i1 THEN '{guards.NO_BINDING[0]}' END, CASE WHEN i2 THEN '{guards.UNVERIFIED[0]}' END, CASE WHEN i3 THEN '{guards.UNDATED[0]}' END) AS issues,
  {_NOTE('i3', guards.UNDATED[1])} || {_NOTE('i2', guards.UNVERIFIED[1])} || {_NOTE('i1', guards.NO_BINDING[1])} || trim(text) AS guarded FROM iss""",
    "failure_state": f"""WITH {_GUARD}, st AS (SELECT run_id, CASE WHEN run_id % 13 = 0 THEN 'OUT_OF_SCOPE_SOURCE' WHEN run_id % 5 > 3 OR (run_id % 2 = 0 AND run_id % 7 > 5) THEN 'BUDGET_EXCEEDED' WHEN i2 THEN 'CITATION_MISMATCH' WHEN i3 THEN 'STALE_VOLATILE_SOURCE' WHEN i1 THEN 'NO_BINDING_AUTHORITY'
  WHEN run_id % 3 = 0 AND n_cited = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN {_VAGUE} THEN 'INSUFFICIENT_FACTS' ELSE 'NONE' END AS state FROM iss)
SELECT state, run_id, severity, retryable FROM st JOIN (VALUES {_STATES}) d(state, severity, retryable) USING (state)""",
}
