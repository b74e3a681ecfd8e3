"""Citation tokens of answers, and citations of sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.text import paragraph_numbers, to_text

TOKEN = r"(?i)\[\s*([PCD]\d+)\s*\]"


def tokens(text: Column) -> Column:
    """The different [P1], [C2], [D3] of a text in upper case, in order."""
    return F.coalesce(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 1), lambda t: F.upper(t))), F.array().cast("array<string>"))


def validated(text: Column, known: Column) -> Column:
    """A text without the tokens that ``known`` (an array of upper-case ids) lacks, and with its spaces put right."""
    pieces = F.split(text, TOKEN)
    found = F.regexp_extract_all(text, F.lit(TOKEN), 1)
    kept = F.transform(found, lambda t: F.when(F.array_contains(known, F.upper(t)), F.concat(F.lit("["), F.upper(t), F.lit("]"))).otherwise(""))
    joined = F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get(kept, i), F.lit("")))), "")
    for pattern, to in ((r"\s+([,.;:!?])", "$1"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")):
        joined = F.regexp_replace(joined, pattern, to)
    return to_text(joined)


def relevance(score: Column) -> Column:
    """0 to 100; 80 without a score."""
    return F.when(score.isNull() | F.isnan(score), 80).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.floor(score * 100 + 0.5)))).cast("int")


def source_type(reference_id: Column, given: Column) -> Column:
    return F.coalesce(F.nullif(to_text(given), F.lit("")), F.when(F.startswith(reference_id, F.lit("D")), "user_document").when(F.startswith(reference_id, F.lit("C")), "a2aj_case").otherwise("pinecone"))


def locator(kind: Column, source: Column) -> Column:
    """What tells where in its source a citation points, by the kind of source."""

    def joined(*names: str) -> Column:
        return F.concat_ws(" | ", *[F.nullif(to_text(source[n]), F.lit("")) for n in names])

    return F.when(kind == "a2aj_case", joined("court", "neutral_citation", "date")).when(kind == "user_document", joined("document_name", "citation")).otherwise(joined("manual", "chapter", "citation"))


def citation(reference_id: Column, source: Column) -> Column:
    """The citation of a source (a struct of its texts, with score and paragraphs); null for a blank id."""
    kind = source_type(reference_id, source["source_type"])
    first = lambda *names: F.coalesce(*[F.nullif(to_text(source[n]), F.lit("")) for n in names])
    made = F.struct(
        reference_id.alias("reference_id"), kind.alias("source_type"), F.coalesce(first("title", "case_name", "source"), F.lit("Source")).alias("title"), F.nullif(locator(kind, source), F.lit("")).alias("locator"),
        first("url", "source_url").alias("url"), F.coalesce(first("snippet", "text"), F.lit("")).alias("snippet"), F.coalesce(first("citation", "neutral_citation", "source"), reference_id).alias("citation"),
        paragraph_numbers(source["paragraphs"]).alias("paragraph_numbers"), relevance(source["score"]).alias("relevance"),
    )
    return F.when(to_text(reference_id) != "", made)


def shown_title(manual: Column, chapter: Column, title: Column, case_name: Column) -> Column:
    """A citation's title as it is shown: under its manual and chapter, unless it begins with them."""
    blank = lambda c: F.nullif(to_text(c), F.lit(""))
    prefix, base = F.concat_ws(" ", blank(manual), blank(chapter)), F.coalesce(F.nullif(title, F.lit("")), F.nullif(case_name, F.lit("")), F.lit("Source"))
    return F.when((prefix != "") & ~F.startswith(base, prefix), F.trim(F.concat(prefix, F.lit(" "), base))).otherwise(base)


def shown_locator(given: Column, manual: Column, chapter: Column, citation: Column, first_page: Column, last_page: Column) -> Column:
    """A citation's locator as it is shown: what is given, else its manual and chapter, citation and pages."""
    blank = lambda c: F.nullif(to_text(c), F.lit(""))
    pages = F.when(last_page.isNotNull(), F.concat(F.lit("pp. "), first_page.cast("string"), F.lit("-"), last_page.cast("string"))).otherwise(F.concat(F.lit("p. "), first_page.cast("string")))
    parts = F.concat_ws(" | ", F.nullif(F.concat_ws(" ", blank(manual), blank(chapter)), F.lit("")), F.nullif(citation, F.lit("")), F.when(first_page.isNotNull(), pages))
    return F.coalesce(F.nullif(given, F.lit("")), parts)
