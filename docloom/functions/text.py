"""Text normalisation and small scalar functions, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once for each row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _chained(c: Column, *steps: tuple[str, str]) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


#: White space of any kind.
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(SPACES))


def to_text(c: Column) -> Column:
    """Stripped; null is empty."""
    return F.coalesce(strip(c), F.lit(""))


def collapse(c: Column) -> Column:
    """White space runs become one space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize_query(c: Column) -> Column:
    return collapse(F.lower(c))


def normalize_chunk_input(c: Column) -> Column:
    """LF line ends without spaces around them, single spaces, at most one blank line."""
    return strip(_chained(c, (r"\r\n?", "\n"), (r"[ \t]+\n", "\n"), (r"\n[ \t]+", "\n"), (r"[ \t]{2,}", " "), (r"\n{3,}", "\n\n")))


def normalize_user_document(c: Column) -> Column:
    return strip(_chained(c, (r"\r\n?", "\n"), (r"[ \t]+\n", "\n"), (r"\n{3,}", "\n\n")))


def normalize_page(c: Column) -> Column:
    return strip(_chained(c, (r"\r\n?", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")))


def clean_markdown(c: Column) -> Column:
    """Images go, links keep their labels."""
    return strip(_chained(c, (r"!\[[^\]]*\]\([^)]*\)", ""), (r"(?<!!)\[([^\]]+)\]\([^)]+\)", "$1"), (r"\r\n?", "\n"), (r"\n{3,}", "\n\n"), (r"[ \t]{2,}", " ")))


def strip_tags(c: Column) -> Column:
    return collapse(F.regexp_replace(c, r"<[^>]+>", " "))


# Characters that are shown of each kind of text, and the bounds of the one that may be set.
SNIPPETS = {"search": 1200, "document": 1200, "decision": 1600, "error": 300, "injection": 220, "title": 80}
DECISION_BOUNDS = (500, 4000)
# End of fixed values.


def snippet(c: Column, kind: str, most: int | None = None) -> Column:
    """What is shown of a text: without tags and spare space if it is a search result, cut to its kind's length; a null text has none.

    ``most`` sets the length for decisions, within bounds; a kind that is not known is an error.
    """
    n = SNIPPETS[kind]
    if kind == "decision" and most is not None:
        n = max(DECISION_BOUNDS[0], min(DECISION_BOUNDS[1], most))
    return F.substring(strip_tags(c) if kind == "search" else F.trim(c), 1, n)


def slug(url: Column) -> Column:
    """The last path part without its suffix, in lower case with dashes; ``page`` if nothing is left."""
    last = F.element_at(F.split(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", ""), "/"), -1)
    bare = F.regexp_replace(F.regexp_replace(last, r"\.html?$", ""), "[^A-Za-z0-9_-]+", "-")
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(bare, "^[-_]+|[-_]+$", "")), F.lit("")), F.lit("page"))


def content_excerpt(c: Column, n: int = 300) -> Column:
    """The start of a text without its white space."""
    return F.substring(collapse(c), 1, n)


def path_key(path: Column) -> Column:
    """What a file is told by, whatever the case of its path."""
    return F.substring(F.md5(F.lower(F.trim(path))), 1, 12)


def query_key(query: Column) -> Column:
    return F.sha1(normalize_query(query))


def prompt_hashes(system: Column, user: Column) -> Column:
    """(prompt_hash, system_hash, user_hash) of the two parts of a prompt; a missing part is empty."""
    system, user = F.coalesce(system, F.lit("")), F.coalesce(user, F.lit(""))
    return F.struct(F.sha2(F.concat(system, F.lit("\n\n"), user), 256).alias("prompt_hash"), F.sha2(system, 256).alias("system_hash"), F.sha2(user, 256).alias("user_hash"))


def title_of_slug(c: Column) -> Column:
    return F.initcap(F.regexp_replace(c, "[-_]+", " "))


def anchor(heading: Column) -> Column:
    return F.concat(F.lit("#"), F.regexp_replace(F.regexp_replace(F.lower(heading), "[^a-z0-9]+", "-"), "^-+|-+$", ""))


def language_of_url(url: Column) -> Column:
    return F.when(F.contains(F.lower(url), F.lit("/fr/")), "fr").otherwise("en")


def manual_and_chapter(title: Column) -> Column:
    """(manual, chapter): the parts of a title before and after its first dash."""
    parts = F.filter(F.transform(F.split(title, "-"), lambda p: F.trim(p)), lambda p: p != "")
    return F.struct(F.get(parts, F.lit(0)).alias("manual"), F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), " - ")).alias("chapter"))


def manual_code(name: Column) -> Column:
    """``enf01``-like codes of file names, else the cleaned stem's first 48 characters."""
    found = F.regexp_extract(F.lower(name), r"\b([a-z]{2,4}\s?\d{1,3}[a-z]?)\b", 1)
    stem = F.regexp_replace(F.regexp_replace(F.lower(name), r"\.[a-z]+$", ""), "[^a-z0-9]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(found, r"\s", ""), F.lit("")), F.substring(F.regexp_replace(stem, "^_+|_+$", ""), 1, 48))


def estimated_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / 4).cast("int")


def redacted(c: Column, n: int = 300) -> Column:
    """Addresses and numbers of six digits or more are masked, and the text is cut."""
    masked = _chained(c, (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED_EMAIL]"), (r"(?<![A-Za-z0-9_])[0-9]{6,}(?![A-Za-z0-9_])", "[REDACTED_NUMBER]"))
    return F.substring(F.coalesce(masked, F.lit("")), 1, n)


def with_notice(text: Column, notice: Column) -> Column:
    """The notice before the text, unless it is there already."""
    clean = to_text(text)
    return F.when((notice == "") | notice.isNull() | F.contains(clean, notice), clean).when(clean == "", notice).otherwise(F.concat(notice, F.lit("\n\n"), clean))


def analysis_date_header(text: Column, as_of: Column, basis: str = "today") -> Column:
    """Puts ``Analysis date basis: <date> (<basis>)`` first, once."""
    header, body = F.concat(F.lit("Analysis date basis: "), as_of, F.lit(f" ({basis})")), to_text(text)
    return F.when(F.startswith(body, F.lit("Analysis date basis:")), body).when(body == "", header).otherwise(F.concat(header, F.lit("\n\n"), body))


def iso_date(c: Column) -> Column:
    """The text if it reads YYYY-MM-DD, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), c)


def analysis_date(explicit: Column, lock_in: Column, today: Column) -> Column:
    return F.coalesce(iso_date(explicit), iso_date(lock_in), today)


def year_range(first: Column, last: Column) -> Column:
    """(start_date, end_date) of two years in either order; years outside 1000 to 9999 are dropped."""
    a, b = (F.when(y.between(1000, 9999), y) for y in (first, last))
    low, high = F.least(a, b), F.greatest(a, b)
    both = a.isNotNull() & b.isNotNull()
    return F.struct(F.concat(F.when(both, low).otherwise(a).cast("string"), F.lit("-01-01")).alias("start_date"), F.concat(F.when(both, high).otherwise(b).cast("string"), F.lit("-12-31")).alias("end_date"))


# Words that query terms leave out, and where a decision's outcome stands, in order of preference.
STOPWORDS = (
    "what", "when", "where", "which", "with", "that", "this", "from", "about", "would", "could",
    "should", "there", "their", "have", "has", "had", "into", "than", "then", "they", "them",
    "outcome", "explain", "case", "law", "please", "under", "over", "after", "before", "between",
)
EXCERPT_MARKERS = (
    "appeal is allowed", "appeal allowed", "appeal is dismissed", "appeal dismissed", "application is allowed", "application allowed",
    "application is dismissed", "application dismissed", "is set aside", "disposition", "held:", "conclusion",
)
BLOCK_PAGES = ("enable javascript", "access denied", "request blocked", "captcha", "cloudflare")
DATASETS = (("FCA", "federal court of appeal", "fca"), ("FC", "federal court", "fc"), ("RAD", "refugee appeal division", "rad"), ("RPD", "refugee protection division", "rpd"), ("SCC", "supreme court", "scc"))
# End of fixed values.


def query_terms(c: Column, most: int = 8) -> Column:
    """The first terms of four letters or digits at least that are no stop words."""
    kept = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: (F.length(w) >= 4) & ~w.isin(*STOPWORDS))
    return F.slice(kept, 1, most)


def excerpt(text: Column, terms: Column, n: int = 1200) -> Column:
    """``n`` characters around the first marker found in list order, else the first term found, else the start."""
    low = F.lower(text)
    marks = [F.nullif(F.locate(m, low), F.lit(0)) for m in EXCERPT_MARKERS]
    term = F.get(F.filter(F.transform(terms, lambda t: F.position(t, low)), lambda p: p > 0), F.lit(0))
    at = F.coalesce(*marks, term, F.lit(1))
    return F.substring(text, F.greatest(at - F.lit(int(n * 0.3)), F.lit(1)), F.lit(n))


def block_page_reason(c: Column, least: int = 200) -> Column:
    """Why a page looks like a block page, or null."""
    clean = F.lower(collapse(c))
    short = F.when(F.length(clean) < least, F.concat(F.lit("content too short ("), F.length(clean).cast("string"), F.lit(" chars)")))
    return F.coalesce(short, *[F.when(F.contains(clean, F.lit(p)), f"blocked pattern detected: {p}") for p in BLOCK_PAGES])


def dataset_code(court: Column) -> Column:
    """A court's code: itself if it is one, else by its name; null if unknown."""
    upper, plain = F.upper(F.trim(court)), F.trim(F.regexp_replace(F.lower(F.trim(court)), "[^a-z0-9]+", " "))
    return F.when(upper.rlike("^[A-Z0-9-]{2,20}$"), upper).otherwise(F.coalesce(*[F.when(F.contains(plain, F.lit(name)) | (plain == code), value) for value, name, code in DATASETS]))


def citation_like(c: Column) -> Column:
    return ~c.rlike("(?i)^https?://") & c.rlike(r"(?<![A-Za-z0-9_])\d{4}\s+[A-Z]{2,12}\s+\d+(?![A-Za-z0-9_])")


def citation_candidates(*values: Column) -> Column:
    """The different values that look like neutral citations, in order."""
    return F.array_distinct(F.filter(F.transform(F.array(*values), lambda v: F.trim(v)), lambda v: v.isNotNull() & citation_like(v)))


def first_line(c: Column) -> Column:
    return F.regexp_extract(c, r"(?m)^\s*(\S.*?)\s*$", 1)


def last_iso_date(c: Column) -> Column:
    """The last date of the century in a text."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(r"(20\d{2}-\d{2}-\d{2})"), 1), F.lit(-1))


def parsed_list(c: Column) -> Column:
    """An array from a JSON array, or from the text itself."""
    return F.coalesce(F.from_json(c, "array<string>"), F.when(to_text(c) != "", F.array(strip(c))), F.array().cast("array<string>"))


def comma_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def paragraph_numbers(values: Column) -> Column:
    """Numbers of an array of texts, floored; others are dropped."""
    return F.transform(F.filter(F.transform(values, lambda v: v.try_cast("double")), lambda v: v.isNotNull() & ~F.isnan(v)), lambda v: F.floor(v).cast("int"))


def clamped_int(c: Column, fallback: int, low: int, high: int) -> Column:
    n = F.floor(c.try_cast("double"))
    return F.when(n.isNull(), fallback).otherwise(F.greatest(F.least(n, F.lit(high)), F.lit(low))).cast("int")


def meta_line(**parts: Column) -> Column:
    """``name=value`` of the parts that are not empty, comma-joined in the order given."""
    return F.concat_ws(", ", *[F.when(to_text(v) != "", F.concat(F.lit(f"{k}="), to_text(v))) for k, v in parts.items()])


def page_range(first: Column, last: Column) -> Column:
    return F.when(first.isNull(), None).when(first == F.coalesce(last, first), F.concat(F.lit("p. "), first.cast("string"))).otherwise(F.concat(F.lit("pp. "), first.cast("string"), F.lit("-"), last.cast("string")))


def salvaged_json(c: Column, schema: str) -> Column:
    """The text parsed, else its largest part in braces."""
    return F.coalesce(F.from_json(F.when(F.startswith(strip(c), F.lit("{")), c), schema), F.from_json(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")), schema))
