"""Quality, validation and run reports as aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import first_line, to_text


#: Ids that a report shows of each kind.
EXAMPLES = 20


def first_examples(rows: DataFrame, id_col: str, kinds: Mapping[str, Column], n: int = EXAMPLES) -> DataFrame:
    """(kind, examples): the least ``n`` ids of each kind; what leaves a task is cut to ``n`` a kind before the shuffle."""
    flags = F.explode(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), k) for k, c in kinds.items()]))).alias("kind")
    least = Window.partitionBy("kind").orderBy("id")
    kept = rows.select(F.col(id_col).alias("id"), flags).withColumn("place", F.row_number().over(least)).where(F.col("place") <= n)
    return kept.groupBy("kind").agg(F.array_sort(F.collect_list("id")).alias("examples"))


def quality(docs: DataFrame, id_col: str, text: str, short: int = 400, last_updated: str | None = None, heading_path: str | None = None, sections: str | None = None) -> DataFrame:
    """One row: how many documents there are, empty, short, in groups of equal texts and, where their columns are named, without a date, a heading path or sound sections.

    ``sections`` is an array of structs with a heading; a missing array counts once, and so does each
    section without one.  short_examples are the first ids of short or empty documents.
    """
    body = to_text(F.col(text))
    hashes = docs.groupBy(F.sha2(F.coalesce(text, F.lit("")), 256).alias("h")).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("duplicate_groups"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1).otherwise(0)), F.lit(0)).alias("duplicates"))
    more = []
    if last_updated:
        more.append(F.count_if(to_text(F.col(last_updated)) == "").alias("missing_last_updated"))
    if heading_path:
        more.append(F.count_if(F.coalesce(F.size(heading_path), F.lit(0)) <= 0).alias("missing_heading_path"))
    if sections:
        bad = F.when(F.col(sections).isNull(), 1).otherwise(F.size(F.filter(sections, lambda s: to_text(s["heading"]) == "")))
        more.append(F.coalesce(F.sum(bad), F.lit(0)).cast("bigint").alias("bad_sections"))
    totals = docs.agg(F.count("*").alias("total"), F.count_if(body == "").alias("empty"), F.count_if((body != "") & (F.length(body) < short)).alias("short"), *more)
    examples = first_examples(docs, id_col, {"short": F.length(body) < short}).agg(F.max("examples").alias("short_examples"))
    none = F.array().cast(T.ArrayType(docs.schema[id_col].dataType))
    one = F.lit(1).alias("one")
    found = totals.select(one, "*").join(hashes.select(one, "*"), "one").join(examples.select(one, "*"), "one").drop("one")  # one row each
    return found.withColumn("short_examples", F.coalesce("short_examples", none))


def unique_count(rows: DataFrame, column: str) -> DataFrame:
    """One row: how many different values that are not empty a column has, and in how many rows."""
    value = F.nullif(F.col(column).cast("string"), F.lit(""))
    return rows.agg(F.countDistinct(value).alias("n_unique"), F.count(value).alias("n_rows"))


def ingest_stats(outcomes: DataFrame) -> DataFrame:
    """One row of totals over outcomes (source, status, n_sections, n_chunks, n_upserted) of the sources of a run; what was not ingested adds nothing."""
    done = F.col("status") == "ingested"
    total = lambda c: F.coalesce(F.sum(F.when(done, F.col(c))), F.lit(0)).cast("bigint")
    return outcomes.agg(
        F.count("*").alias("found"), F.count_if(done).alias("ingested"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(F.col("status") == "failed").alias("failed"),
        total("n_sections").alias("sections"), total("n_chunks").alias("chunks"), total("n_upserted").alias("upserted"),
    )


def top_first_lines(docs: DataFrame, text: str, order: str, n: int = 10) -> DataFrame:
    """The most common first lines; of equally common ones the earlier."""
    lines = docs.select(first_line(F.col(text)).alias("line"), F.col(order).alias("_o")).where("line <> ''")
    return lines.groupBy("line").agg(F.count("*").alias("n"), F.min("_o").alias("first")).orderBy(F.desc("n"), "first").limit(n)


def duplicate_groups(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    got = docs.groupBy(F.sha2(F.col(text), 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"))
    return got.where("n > 1")


def field_presence(rows: DataFrame, allowed: Mapping[str, Sequence[str] | None]) -> DataFrame:
    """(field, present, missing, invalid, presence_pct) over the whole table; fields with allowed values may be comma lists."""
    stacked = None
    total = F.count("*")
    for name, values in allowed.items():
        value = to_text(F.col(name).cast("string"))
        invalid = F.lit(False) if values is None else (value != "") & ~F.forall(F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != ""), lambda x: x.isin(*values))
        one = F.struct(F.count_if(value != "").alias("present"), F.count_if(value == "").alias("missing"), F.count_if(invalid).alias("invalid"), total.alias("total"))
        stacked = [*(stacked or []), one.alias(name)]
    wide = rows.agg(*stacked)
    long = wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("s")) for n in allowed])).alias("x")).select("x.field", "x.s.*")
    return long.select("field", "present", "missing", "invalid", F.when(F.col("total") > 0, 100.0 * F.col("present") / F.col("total")).otherwise(0.0).alias("presence_pct"))


def value_distribution(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, value, n)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    return rows.select(pairs.alias("p")).where("p.value is not null and p.value <> ''").groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def repeated_keys(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, as a source's chunk numbers must not."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def strict_failures(presence: DataFrame, required: Sequence[str], strict: bool = False) -> Column:
    """A condition on one presence row that must not hold."""
    return F.col("field").isin(*required) & ((F.col("missing") > 0) | (F.lit(strict) & (F.col("invalid") > 0)))


def heading_distribution(sections: DataFrame, heading: str = "top_heading") -> DataFrame:
    return sections.groupBy(F.coalesce(F.nullif(F.col(heading), F.lit("")), F.lit("Unknown")).alias("heading")).agg(F.count("*").alias("n"))


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def evaluation(results: DataFrame, expected: str, actual: str) -> DataFrame:
    """One row: total, passed, failed and skipped (no expectation)."""
    skip, same = F.col(expected).isNull(), F.col(expected).eqNullSafe(F.col(actual))
    return results.agg(F.count("*").alias("total"), F.count_if(~skip & same).alias("passed"), F.count_if(~skip & ~same).alias("failed"), F.count_if(skip).alias("skipped"))


def gold_errors(entry: Column) -> Column:
    """What is wrong with a gold entry (query, as_of, expected_doc_families, expected_failure_state)."""
    return F.array_compact(F.array(
        F.when(to_text(entry["query"]) == "", "query is required"),
        F.when(~F.coalesce(entry["as_of"].rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)), "as_of must be YYYY-MM-DD"),
        F.when(entry["expected_doc_families"].isNull(), "expected_doc_families must be an array"),
        F.when(to_text(entry["expected_failure_state"]) == "", "expected_failure_state is required"),
    ))


def gold_outcomes(runs: DataFrame, gold: DataFrame) -> DataFrame:
    """Runs (query, doc_families, authority_levels, failure_state) against gold entries of the same query, with the reasons for a failure."""
    joined = gold.join(runs, "query", "left")
    missing = F.array_except("expected_doc_families", F.coalesce("doc_families", F.array().cast("array<string>")))
    barred = F.array_intersect("must_not_cite_doc_families", F.coalesce("doc_families", F.array().cast("array<string>")))
    levels = F.array_except("must_cite_authority_levels", F.coalesce("authority_levels", F.array().cast("array<string>")))
    reasons = F.array_compact(F.array(F.when(F.col("failure_state").isNull(), "not run"), F.when(F.size(missing) > 0, "missing family"), F.when(F.size(barred) > 0, "barred family"), F.when(F.size(levels) > 0, "missing level"), F.when(~F.col("failure_state").eqNullSafe(F.col("expected_failure_state")), "wrong state")))
    return joined.select("query", reasons.alias("reasons"), (F.size(reasons) == 0).alias("passed"))
