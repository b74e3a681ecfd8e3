"""Answer guards, failure states, budgets, run traces and contract checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import citations, rules
from docloom.functions.text import redacted, to_text, with_notice

# Failure states with severity, retry policy and notice, in order of precedence; the guard's notices; phases.
FAILURE_STATES = (
    ("OUT_OF_SCOPE_SOURCE", "ERROR", "RETRY_WITH_SCOPED_SOURCES", "The request is outside approved RCIC scope or includes blocked instructions/sources."),
    ("BUDGET_EXCEEDED", "WARNING", "RETRY_WITH_REDUCED_SCOPE", "The request could not be fully processed due to resource constraints."),
    ("CITATION_MISMATCH", "ERROR", "RETRY_WITH_CITATION_FIX", "Some citations in the response could not be verified against the retrieved sources."),
    ("STALE_VOLATILE_SOURCE", "ERROR", "RETRY_WITH_REFRESHED_SOURCES", "Date sensitivity note: retrieved sources did not include effective-date metadata for citation-level recency validation."),
    ("NO_BINDING_AUTHORITY", "ERROR", "RETRY_WITH_BETTER_SOURCES", "No binding authority found in indexed sources for this question."),
    ("INSUFFICIENT_EVIDENCE", "WARNING", "RETRY_WITH_EXPANDED_SEARCH", "Insufficient information available in retrieved sources to answer this query reliably."),
    ("INSUFFICIENT_FACTS", "INFO", "REQUEST_MORE_INFO", "Please provide more case facts (program, dates, status history, and target outcome)."),
    ("NONE", "N/A", "N/A", None),
)
SILENT_STATES = ("OUT_OF_SCOPE_SOURCE", "NONE")
NO_RETRY = ("N/A", "REQUEST_MORE_INFO")
NO_BINDING = ("no_binding_authority_found", "No binding authority found in indexed sources for this question.")
UNVERIFIED = ("binding_claim_without_binding_citation", "Binding legal claims could not be verified from statute/regulation/MI/public policy citations in the retrieved sources.")
UNDATED = ("temporal_claim_without_effective_date", "Date sensitivity note: retrieved sources did not include effective-date metadata for citation-level recency validation.")
ULID = "^[0-9A-HJKMNP-TV-Z]{26}$"
# End of fixed values.


def failure_states(spark: SparkSession) -> DataFrame:
    """The states as a dimension table, with their precedence and whether another try may help."""
    rows = [(k, *s, s[2] not in NO_RETRY) for k, s in enumerate(FAILURE_STATES)]
    return spark.createDataFrame(rows, "precedence int, code string, severity string, retry_policy string, message string, retryable boolean")


def answer_levels(answers: DataFrame, cited: DataFrame) -> DataFrame:
    """Adds n_cited, has_binding and has_date to answers (run_id, text) from cited sources (run_id, ref_id, authority_level, effective_date)."""
    refs = answers.select("run_id", F.explode(citations.tokens(F.col("text"))).alias("ref_id")).join(cited, ["run_id", "ref_id"])
    got = refs.groupBy("run_id").agg(F.count("*").alias("n_cited"), F.max(F.lower("authority_level").isin(*rules.BINDING)).alias("has_binding"), F.max(to_text(F.col("effective_date")) != "").alias("has_date"))
    return answers.join(got, "run_id", "left").fillna({"n_cited": 0, "has_binding": False, "has_date": False})


def guard_issues(text: Column, requires_binding: Column, n_binding: Column, n_cited: Column, has_binding: Column, has_date: Column) -> Column:
    """Issue codes in the order in which they are raised."""
    low = F.lower(text)
    return F.array_compact(F.array(
        F.when(requires_binding & (n_binding == 0), NO_BINDING[0]),
        F.when(F.coalesce(rules.matches(low, rules.BINDING_LANGUAGE), F.lit(False)) & ~has_binding, UNVERIFIED[0]),
        F.when(F.coalesce(rules.matches(low, rules.TEMPORAL_LANGUAGE), F.lit(False)) & (n_cited > 0) & ~has_date, UNDATED[0]),
    ))


def guarded(text: Column, issues: Column) -> Column:
    """The text under the notices of its issues, the last raised first."""
    for code, notice in (NO_BINDING, UNVERIFIED, UNDATED):
        text = F.when(F.array_contains(issues, code), with_notice(text, F.lit(notice))).otherwise(to_text(text))
    return text


def failure_state(blocked: Column, tool_calls: Column, most_tool_calls: Column, fetches: Column, most_fetches: Column, issues: Column, n_sources: Column, n_citations: Column, query: Column) -> Column:
    """The first state that applies; a limit of 0 is none."""
    over = ((most_tool_calls > 0) & (tool_calls > most_tool_calls)) | ((most_fetches > 0) & (fetches > most_fetches))
    has = lambda issue: F.array_contains(issues, issue[0])
    return (
        F.when(blocked, "OUT_OF_SCOPE_SOURCE").when(over, "BUDGET_EXCEEDED").when(has(UNVERIFIED), "CITATION_MISMATCH").when(has(UNDATED), "STALE_VOLATILE_SOURCE").when(has(NO_BINDING), "NO_BINDING_AUTHORITY")
        .when((n_sources == 0) & (n_citations == 0), "INSUFFICIENT_EVIDENCE").when(rules.vague(query), "INSUFFICIENT_FACTS").otherwise("NONE")
    )


def state_notice(text: Column, state: Column) -> Column:
    notice = F.coalesce(*[F.when(state == code, message) for code, _, _, message in FAILURE_STATES if code not in SILENT_STATES], F.lit(""))
    return with_notice(text, notice)


def budget_counters(events: DataFrame, run: str, kind: str, counted: Mapping[str, Sequence[str]]) -> DataFrame:
    """(run, one column for each counter): how many events of its kinds a run has."""
    return events.groupBy(run).agg(*[F.count_if(F.col(kind).isin(*kinds)).alias(name) for name, kinds in counted.items()])


def _milliseconds(start: str, end: str) -> Column:
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return F.round((micros(end) - micros(start)) / 1000).cast("bigint")


def phase_traces(events: DataFrame, run: str, phase: str, at: str, failed: Column) -> DataFrame:
    """(run, phase, n, started_at, completed_at, duration_ms, status): FAILED if all of a phase's events failed, PARTIAL if some did."""
    n, bad = F.count("*"), F.count_if(failed)
    got = events.groupBy(run, phase).agg(n.alias("n"), bad.alias("n_failed"), F.min(at).alias("started_at"), F.max(at).alias("completed_at"))
    status = F.when(F.col("n_failed") == 0, "SUCCESS").when(F.col("n_failed") == F.col("n"), "FAILED").otherwise("PARTIAL")
    return got.select(run, phase, "n", "started_at", "completed_at", _milliseconds("started_at", "completed_at").alias("duration_ms"), status.alias("status"))


def run_traces(phases: DataFrame, run: str, phase: str, known: Sequence[str]) -> DataFrame:
    """One row for each run: how many phases ran, their statuses in time order, its duration, and the known phases that were skipped."""
    order = F.array_sort(F.collect_list(F.struct("started_at", phase, "status")))
    got = phases.groupBy(run).agg(F.count("*").alias("n_phases"), F.concat_ws(",", F.transform(order, lambda x: x["status"])).alias("statuses"), F.array_sort(F.array_except(F.array(*map(F.lit, known)), F.collect_set(phase))).alias("skipped"), F.min("started_at").alias("a"), F.max("completed_at").alias("b"))
    return got.select(run, "n_phases", "statuses", F.array_join("skipped", ",").alias("skipped"), _milliseconds("a", "b").alias("duration_ms"))


def trace_errors(trace: Column, phases: Sequence[str]) -> Column:
    """What is wrong with a trace (trace_id, as_of, phase, started_at, completed_at)."""
    bad = lambda ok: ~F.coalesce(ok, F.lit(False))
    return F.array_compact(F.array(
        F.when(bad(trace["trace_id"].rlike(ULID)), "trace_id must be a ULID"),
        F.when(bad(trace["as_of"].rlike(r"^\d{4}-\d{2}-\d{2}$")), "as_of must be YYYY-MM-DD"),
        F.when(bad(trace["phase"].isin(*phases)), "phase is unknown"),
        F.when(bad(trace["started_at"].try_cast("timestamp").isNotNull()), "started_at is no time"),
        F.when(bad(trace["completed_at"].try_cast("timestamp").isNotNull()), "completed_at is no time"),
    ))


def contract_errors(record: Column, required: Sequence[str], enums: Mapping[str, Sequence[str]], patterns: Mapping[str, str], allowed: Sequence[str] | None = None) -> Column:
    """Top-level checks of a map<string,string> record: required fields, unexpected ones, enumerations and patterns."""
    tests = [F.when(~F.map_contains_key(record, name), f"{name} is required") for name in required]
    tests += [F.when(F.map_contains_key(record, name) & ~F.try_element_at(record, F.lit(name)).isin(*values), f"{name} is not allowed") for name, values in enums.items()]
    tests += [F.when(F.map_contains_key(record, name) & ~F.try_element_at(record, F.lit(name)).rlike(p), f"{name} does not match") for name, p in patterns.items()]
    found = F.array_compact(F.array(*tests))
    if allowed is None:
        return found
    extra = F.array_sort(F.array_except(F.map_keys(record), F.array(*map(F.lit, allowed))))
    return F.concat(found, F.transform(extra, lambda k: F.concat(k, F.lit(" is unexpected"))))


SOURCE_TYPE = "guidance_pdi"


def page_errors(page: Column, canonical: Column) -> Column:
    """Checks of a page's JSON: required texts, the fixed source type, addresses, and sections with headings and texts; ``canonical`` is the source's address as it should be."""
    texts = [F.when(to_text(page[f]) == "", f"{f} is required") for f in ("source_id", "source_url", "canonical_url", "title", "text")]
    http = [F.when((to_text(page[f]) != "") & ~page[f].rlike("^https?://"), f"{f} is not http") for f in ("source_url", "canonical_url")]
    source = F.when(~page["source_type"].eqNullSafe(SOURCE_TYPE), f"source_type is not {SOURCE_TYPE}")
    differs = F.when((to_text(page["canonical_url"]) != "") & canonical.isNotNull() & (canonical != page["canonical_url"]), "canonical_url differs")
    sections = F.transform(page["sections"], lambda s, i: F.when(to_text(s["heading"]) == "", F.concat(F.lit("section "), i.cast("string"), F.lit(" has no heading"))).when(s["text"].isNull(), F.concat(F.lit("section "), i.cast("string"), F.lit(" has no text"))))
    return F.array_compact(F.concat(F.array(*texts, source, *http, differs), F.coalesce(sections, F.array().cast("array<string>"))))


def vector_valid(record: Column, dims: int) -> Column:
    """An id, a vector of ``dims`` finite numbers, and a text in the metadata."""
    sound = F.forall(record["values"], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((to_text(record["id"]) != "") & (F.size(record["values"]) == dims) & sound & (to_text(record["text"]) != ""), F.lit(False))


def blocked(text: Column, filtered: bool = True) -> Column:
    """Whether a request is turned away: it holds an injection, is not of the domain, and such requests are filtered."""
    return (F.size(rules.injected_lines(text)) > 0) & ~rules.domain_relevant(text) & F.lit(filtered)


def redacted_log(messages: DataFrame, text: str) -> DataFrame:
    return messages.withColumn(text, redacted(F.col(text)))
