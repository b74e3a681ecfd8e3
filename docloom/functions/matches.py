"""Records of other services brought to one shape, and what requests and histories resolve to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import rules
from docloom.functions.text import comma_list, iso_date, parsed_list, snippet, to_text

# The names under which fields arrive, in order of preference, and defaults.
MATCH_FIELDS = {"text": ("text", "content", "chunk"), "title": ("title", "caseName", "name"), "source": ("source", "url", "docId"), "source_url": ("source_url", "url"), "authority_level": ("authority_level",), "doc_family": ("doc_family",), "jurisdiction": ("jurisdiction",), "effective_date": ("effective_date",), "section_id": ("section_id",)}
CASE_FIELDS = {
    "id": ("id", "citation_en", "citation_fr", "citation", "decision_id", "document_id", "uuid", "slug", "url_en", "url"), "title": ("name_en", "name", "name_fr", "title", "case_name", "caseName"), "court": ("court", "tribunal", "jurisdiction", "dataset"),
    "date": ("document_date_en", "document_date_fr", "date", "decision_date", "published_at", "year"), "neutral_citation": ("citation_en", "citation", "neutral_citation", "neutralCitation", "citation_fr"),
    "url": ("url_en", "url", "source_url", "sourceUrl", "link", "href", "url_fr"), "snippet": ("snippet", "excerpt", "summary", "text", "content"),
}
DEFAULT_USER, DEFAULT_DOCUMENT, DEFAULT_SESSION, DEFAULT_CASE = "dev-user", "Uploaded Document", "New Case Research", "Case law source"
DEFAULT_REASON = "default_no_case_law"
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
# End of fixed values.


def first_of(record: Column, names: Sequence[str]) -> Column:
    """The first field of a map<string,string> that is not empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(record, F.lit(n)), F.lit("")) for n in names])


def match(record: Column, score: Column) -> Column:
    """A search match from its metadata map, whatever the fields are called."""
    return F.struct(
        *[(F.coalesce(first_of(record, names), F.lit("")) if field == "text" else first_of(record, names)).alias(field) for field, names in MATCH_FIELDS.items()],
        parsed_list(F.coalesce(F.try_element_at(record, F.lit("heading_path")), F.try_element_at(record, F.lit("headingPath")))).alias("heading_path"),
        F.coalesce(comma_list(F.try_element_at(record, F.lit("instrument"))), F.array().cast("array<string>")).alias("instrument"), score.alias("score"),
    )


def good_enough(score: Column, least: float) -> Column:
    """Matches without a score pass."""
    return score.isNull() | (score >= least)


def case_source(record: Column) -> Column:
    """A case from a search result's map, null with neither title nor snippet; a missing id is the record's hash."""
    got = {field: first_of(record, names) for field, names in CASE_FIELDS.items()}
    shown = snippet(F.coalesce(got["snippet"], F.lit("")), "search")
    key = F.coalesce(got["id"], F.concat(F.lit("a2aj-"), F.substring(F.sha1(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(record))))), 1, 8)))
    made = F.struct(key.alias("id"), F.coalesce(got["title"], F.lit(DEFAULT_CASE)).alias("title"), *[got[c].alias(c) for c in ("court", "date", "neutral_citation", "url")], shown.alias("snippet"))
    return F.when(got["title"].isNotNull() | (shown != ""), made)


def identity(*candidates: Column) -> Column:
    """The first candidate that is given, stripped; a blank one stands for the default user."""
    given = F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates], F.lit(DEFAULT_USER))
    return F.coalesce(F.nullif(to_text(given), F.lit("")), F.lit(DEFAULT_USER))


def is_uuid(c: Column) -> Column:
    return F.coalesce(c.rlike(UUID), F.lit(False))


def document_title(c: Column) -> Column:
    return F.coalesce(F.nullif(to_text(c), F.lit("")), F.lit(DEFAULT_DOCUMENT))


def date_context(as_of: Column, application: Column, today: Column) -> Column:
    """(basis, date): an explicit date, else that of the application, else today."""
    explicit, applied = iso_date(to_text(as_of)), iso_date(to_text(application))
    return F.struct(F.when(explicit.isNotNull(), "explicit_as_of").when(applied.isNotNull(), "application_date").otherwise("today").alias("basis"), F.coalesce(explicit, applied, today).alias("date"))


def router_decision(reply: Column, message: Column) -> Column:
    """What a router's reply decides: JSON, or the largest part of it in braces; defaults otherwise."""
    schema = "useCaseLaw boolean, useLegislation boolean, query string, courts array<string>, yearFrom double, yearTo double, limit double, reason string"
    d = F.coalesce(F.from_json(F.when(F.startswith(F.trim(reply), F.lit("{")), reply), schema), F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit("")), schema))
    courts = F.filter(d["courts"], lambda c: to_text(c) != "")
    default = F.array(F.lit("Federal Court"), F.lit("Federal Court of Appeal"))
    limit = F.when(d["limit"].isNull(), 4).otherwise(F.greatest(F.lit(3), F.least(F.lit(5), F.floor(d["limit"] + 0.5)))).cast("int")
    return F.struct(
        F.coalesce(d["useCaseLaw"], F.lit(False)).alias("use_case_law"), F.coalesce(d["useLegislation"], F.lit(False)).alias("use_legislation"), F.coalesce(F.nullif(to_text(d["query"]), F.lit("")), message).alias("query"),
        F.when(F.coalesce(F.size(courts), F.lit(0)) > 0, courts).otherwise(default).alias("courts"), F.floor(d["yearFrom"]).cast("int").alias("year_from"), F.floor(d["yearTo"]).cast("int").alias("year_to"), limit.alias("limit"),
        F.coalesce(F.nullif(to_text(d["reason"]), F.lit("")), F.lit(DEFAULT_REASON)).alias("reason"),
    )


def history_title(title: Column, messages: Column) -> Column:
    """A session's title, else its first user message's first 40 characters, else the default; messages have role and text."""
    asked = F.get(F.filter(messages, lambda m: m["role"] == "user"), F.lit(0))["text"]
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(F.substring(asked, 1, 40), F.lit("")), F.lit(DEFAULT_SESSION))


def resolved_token(token: Column, ids: Column) -> Column:
    """The position in ``ids``, from 0, that a shown token names: by number, by id, else by the id's number; null if none."""
    raw = F.upper(F.trim(F.regexp_replace(token, r"[\[\]]", "")))
    number = F.regexp_extract(raw, r"^[PCD]?(\d+)$", 1).try_cast("int")
    by_id = F.nullif(F.array_position(F.transform(ids, lambda i: F.upper(i)), raw), F.lit(0)) - 1
    place = F.when((number >= 1) & (number <= F.size(ids)), number - 1)
    return F.when(raw.rlike(r"^\d+$"), place).when(raw.rlike(r"^[PCD]\d+$"), F.coalesce(by_id, place)).cast("int")


def enriched_markdown(c: Column) -> Column:
    """Two sections that readers cite most get their full names; a part that is not given is filled in."""
    for token, part, name in (("R205", "d", "Regulation 205"), ("A25", "1", "Act Section 25")):
        edge = r"(?i)(?<![A-Za-z0-9_])" + token
        c = F.regexp_replace(c, edge + r"\(?(\w+)\)?", f"{token}($1) ({name})")
        c = F.regexp_replace(c, edge + r"(?!\(?\w)\(?\)?", f"{token}({part}) ({name})")
    return c


def enriched_print(c: Column) -> Column:
    """Section tokens get their full names, unless these follow within 32 characters."""
    for letter, name in (("A", "Act Section"), ("R", "Regulation")):
        begin = f"({name.lower()}"
        pattern = rf"(?<![A-Z0-9]){letter}(\d{{1,3}}(?:\([^)]+\))?+)(?![A-Z0-9])(?![\s\S]{{0,{32 - len(begin)}}}\((?i:{name}))"
        c = F.regexp_replace(c, pattern, f"{letter}$1 ({name} $1)")
    return c


def effective_date_of(c: Column) -> Column:
    """The first ISO date of the first 5000 characters, else the date after one of three phrases."""
    sample, date = F.substring(c, 1, 5000), r"([A-Za-z]+\s+\d{1,2},\s+\d{4})"
    phrases = (rf"(?i)current to\s+{date}", rf"(?i)last amended on\s+{date}", rf"(?i)effective(?:\s+date)?\s*[:\-]?\s*{date}")

    def parsed(pattern: str) -> Column:
        raw = F.regexp_replace(F.nullif(F.regexp_extract(sample, pattern, 1), F.lit("")), r"\s+", " ")
        return F.coalesce(*[F.date_format(F.try_to_timestamp(raw, F.lit(f)), "yyyy-MM-dd") for f in ("MMMM d, yyyy", "MMM d, yyyy")])

    iso = F.nullif(F.regexp_extract(sample, r"(?<![A-Za-z0-9_])(\d{4}-\d{2}-\d{2})(?![A-Za-z0-9_])", 1), F.lit(""))
    return F.coalesce(iso, *map(parsed, phrases))


def markdown_family(text: Column, url: Column, manual: Column) -> Column:
    """The family by the variant for markdown files: a manual's code counts, a removal order does not."""
    low, at = F.lower(text), F.lower(url)
    tests = []
    for family, pattern in rules.DOC_FAMILY:
        hit = rules.matches(low, "enforcement manual" if family == "ENF" else pattern)
        for part in rules.DOC_FAMILY_URLS.get(family, ()):
            hit = hit | F.contains(at, F.lit(part))
        if family == "ENF":
            hit = hit | F.startswith(F.lower(manual), F.lit("enf"))
        tests.append(F.when(F.coalesce(hit, F.lit(False)), family))
    return F.coalesce(*tests, F.lit(rules.DOC_FAMILY_DEFAULT))


# Rules of the variant for printed documents that differ, and the codes that manuals begin with.
PRINT_RULES = {"IRPA": "immigration and refugee protection act", "IRPR": "immigration and refugee protection regulations|sor-2002-227"}
PRINT_CODES = {"VOI": "voi", "ENF": "enf", "IRPR": "sor-"}
# End of fixed values.


def print_family(text: Column, code: Column) -> Column:
    """The family by the variant for printed documents, which have no URL."""
    low = F.lower(text)
    tests = []
    for family, pattern in rules.DOC_FAMILY:
        hit = rules.matches(low, PRINT_RULES.get(family, pattern))
        if family in PRINT_CODES:
            hit = hit | F.startswith(F.lower(code), F.lit(PRINT_CODES[family]))
        tests.append(F.when(F.coalesce(hit, F.lit(False)), family))
    return F.coalesce(*tests, F.lit(rules.DOC_FAMILY_DEFAULT))


def whole_files_only(vectors: DataFrame, file: str, vector: str) -> DataFrame:
    """Drops all rows of a file if any of its vectors is missing."""
    bad = vectors.where(F.col(vector).isNull()).select(file).distinct()
    return vectors.join(bad, file, "left_anti")
