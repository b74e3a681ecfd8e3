"""Ordered rule tables, and the expressions and SQL that evaluate them.

A rule is (value, pattern).  Patterns use ``\\b`` in the sense of ASCII words; Spark's Java regular
expressions treat letters beyond ASCII as word characters, so ``spark_pattern`` spells it out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The classification rules, in order of precedence.
DOC_FAMILY = (
    ("OINP", r"ontario immigrant nominee|oinp"),
    ("BC_PNP", r"bc pnp|bcpnp|british columbia pnp"),
    ("AAIP", r"alberta advantage immigration|aaip"),
    ("NOC2021", r"noc 2021|\bnoc\b"),
    ("LICO_MNI", r"minimum necessary income|lico|\bmni\b"),
    ("MI", r"ministerial instruction|\bmi\b"),
    ("PUBLIC_POLICY", r"public policy"),
    ("VOI", r"visa office"),
    ("ENF", r"enforcement manual|removal order"),
    ("IRB_GUIDE", r"jurisprudential guide|irb guide"),
    ("IRPA", r"\birpa\b"),
    ("IRPR", r"\birpr\b|sor-2002-227"),
)
DOC_FAMILY_DEFAULT = "PDI"
#: Families that a part of the source's URL implies, at the rank of the family's own rule.
DOC_FAMILY_URLS = {"OINP": ("/ontario/",), "VOI": ("/visa-office-", "/visa-office/"), "ENF": ("/enforcement/",)}
AUTHORITY = {
    "IRPA": "statute", "IRPR": "regulation", "MI": "ministerial_instruction", "PUBLIC_POLICY": "public_policy", "PDI": "policy", "ENF": "manual", "VOI": "voi",
    "OINP": "provincial_program", "BC_PNP": "provincial_program", "AAIP": "provincial_program", "NOC2021": "reference", "LICO_MNI": "reference",
    "IRB_GUIDE": "jurisprudence", "CASE_LAW": "case_law",
}
AUTHORITY_DEFAULT = "policy"
AUTHORITY_RANK = ("statute", "regulation", "ministerial_instruction", "public_policy", "policy", "manual", "voi", "jurisprudence", "case_law", "reference", "provincial_program")
BINDING = ("statute", "regulation", "ministerial_instruction", "public_policy")
GUIDANCE = ("policy", "manual", "voi")
CASE_LAW = ("jurisprudence", "case_law")
REFERENCE = ("reference",)
PROVINCIAL = ("provincial_program",)
JURISDICTION = {"OINP": "ontario", "BC_PNP": "bc", "AAIP": "alberta"}
JURISDICTION_DEFAULT = "federal"
INSTRUMENT = (
    ("TRV", r"\btrv\b|temporary resident visa|visitor|super visa"),
    ("ETA", r"\beta\b|electronic travel authorization"),
    ("STUDY", r"study permit|student"),
    ("WORK", r"work permit|foreign workers|lmia|r205|r186"),
    ("PR_ECON", r"express entry|economic class|federal skilled|cec|fst|permanent residence.*economic"),
    ("PR_FAMILY", r"family sponsorship|spousal|parent sponsorship"),
    ("PR_REFUGEE", r"refugee|asylum|protected person"),
    ("INADMISSIBILITY", r"inadmissib|criminality|medical inadmissib|security inadmissib"),
    ("MISREP", r"misrep|misrepresentation|\ba40\b"),
    ("ENFORCEMENT", r"enforcement|removal order|detention|admissibility hearing"),
)
INSTRUMENT_URLS = (("TRV", "/temporary-residents/"), ("PR_ECON", "/permanent-residence/"), ("ENFORCEMENT", "/enforcement/"), ("PR_REFUGEE", "/refugees/"))
INSTRUMENT_BY_FAMILY = {"ENF": "ENFORCEMENT", "OINP": "PR_ECON", "BC_PNP": "PR_ECON", "AAIP": "PR_ECON", "NOC2021": "WORK", "LICO_MNI": "PR_FAMILY"}
INSTRUMENT_DEFAULT = "WORK"
PROGRAM_STREAM = (
    ("EXPRESS_ENTRY", r"express entry"),
    ("PNP", r"provincial nominee|oinp|bc pnp|aaip"),
    ("AIP", r"atlantic immigration"),
    ("CAREGIVER", r"caregiver"),
    ("AGRI_FOOD", r"agri[- ]food"),
    ("RURAL", r"rural and northern|rural northern"),
    ("OWP", r"open work permit|\bowp\b"),
    ("PGWP", r"post[- ]graduation|\bpgwp\b"),
    ("SPOUSAL", r"spousal sponsorship"),
)
TABLE_TYPE = (("MNI", r"minimum necessary income|\bmni\b"), ("LICO", r"low income cut-off|lico"))
PROFILE_INSTRUMENTS = (
    ("TRV", r"\btrv\b|\bvisitor visa\b|\bvisitor record\b"),
    ("ETA", r"\beta\b|\belectronic travel authorization\b"),
    ("STUDY", r"\bstudy permit\b|\bstudent\b"),
    ("WORK", r"\bwork permit\b|\blmia\b|\br205\b|\br186\b|\bopen work permit\b"),
    ("PR_ECON", r"\bexpress entry\b|\bcec\b|\bfsw\b|\bfst\b|\beconomic immigration\b"),
    ("PR_FAMILY", r"\bspousal\b|\bfamily sponsorship\b|\bparent sponsorship\b"),
    ("PR_REFUGEE", r"\brefugee\b|\basylum\b|\bprotected person\b"),
    ("INADMISSIBILITY", r"\binadmissib|\bcriminality\b|\bmedical inadmissib|\bsecurity inadmissib"),
    ("MISREP", r"\bmisrep\b|\ba40\b|\bmisrepresentation\b"),
    ("ENFORCEMENT", r"\benforcement\b|\bremoval order\b|\badmissibility hearing\b|\bdetention\b"),
)
PROFILE_FAMILY = (
    ("OINP", r"\boinp\b|\bontario immigrant nominee\b"),
    ("BC_PNP", r"\bbc pnp\b|\bbcpnp\b|\bbritish columbia pnp\b"),
    ("AAIP", r"\baaip\b|\balberta advantage immigration\b"),
    ("NOC2021", r"\bnoc\b|\bteer\b|\bnoc 2021\b"),
    ("LICO_MNI", r"\blico\b|\bmni\b|\blow income cut[- ]?off\b|\bminimum necessary income\b"),
    ("CASE_LAW", r"\bcase law only\b|\bonly case law\b"),
)
PROFILE_MODE = {"OINP": "provincial", "BC_PNP": "provincial", "AAIP": "provincial", "NOC2021": "reference", "LICO_MNI": "reference", "CASE_LAW": "case_law"}
COMPARE = r"\bcompare\b|\bvs\b|\bversus\b|\bdifference between\b"
COMPARE_FAMILIES = (("MI", r"\bministerial instruction\b|\bmi\b"), ("PDI", r"\bpdi\b|\bprogram delivery instruction\b"), ("ENF", r"\benf\b|\benforcement manual\b"), ("VOI", r"\bvoi\b|\bvisa office instruction\b"))
CASE_LAW_REQUESTED = r"\bcase\b|\bfederal court\b|\bjudicial review\b|\bprecedent\b|\bcanlii\b"
CASE_LAW_INTENT = r"\bcase( law)?\b|\bfederal court\b|\bjudicial review\b|\bcanlii\b|\bprecedent\b|\bauthorit(y|ies)\b|\bparagraphs?\b|\bcit(e|ation|ations)\b|\bfc\b|\bfca\b|\bjr\b"
INJECTION = (
    r"ignore\s+(all|any|the|previous|prior|above)\s+instructions?", r"disregard\s+(all|any|the|previous|prior|above)\s+instructions?", r"follow\s+these\s+instructions\s+instead", r"you\s+are\s+now",
    r"system\s+prompt", r"developer\s+message", r"reveal\s+.*\b(prompt|instruction|policy)\b", r"show\s+.*\b(prompt|instruction|policy)\b", r"print\s+.*\b(prompt|instruction|policy)\b",
    r"begin\s+system\s+prompt", r"end\s+system\s+prompt", r"jailbreak", r"\bdan\b", r"<\s*system\s*>", r"<\s*assistant\s*>",
)
DOMAIN = (
    r"\bircc\b", r"\bcanada(n)?\s+immigration\b", r"\bimmigration\b", r"\brefugee\b", r"\basylum\b", r"\bjudicial\s+review\b", r"\bfederal\s+court\b", r"\bfca\b", r"\birpa\b", r"\birpr\b", r"\bpdi\b",
    r"\bspousal\s+sponsorship\b", r"\bstudy\s+permit\b", r"\bwork\s+permit\b", r"\bvisitor\s+visa\b", r"\bpr\b", r"\bpermanent\s+residen(ce|t)\b", r"\bcitizenship\b", r"\bh&c\b", r"\bprocedural\s+fairness\b", r"\bvavilov\b",
)
BINDING_LANGUAGE = r"\b(must|required|legally required|the law requires|under irpa|under irpr|binding)\b"
TEMPORAL_LANGUAGE = r"\b(current|currently|as of today|most recent|latest|in force)\b"
VAGUE = r"\bhelp me\b|\bbest immigration pathway\b|\bbest pathway\b|\bwhat should i do\b|\badvise me\b|\bmy case\b"
# End of fixed values.

_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def spark_pattern(pattern: str) -> str:
    return pattern.replace(r"\b", _EDGE)


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(spark_pattern(pattern))


def any_of(patterns: Sequence[str]) -> str:
    return "|".join(f"({p})" for p in patterns)


def first_match(c: Column, rules: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The value of the first rule whose pattern a lower-case text has."""
    chain = F.coalesce(*[F.when(matches(c, p), v) for v, p in rules])
    return chain if default is None else F.coalesce(chain, F.lit(default))


def all_matches(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The values of all rules that match, in rule order."""
    return F.array_compact(F.array(*[F.when(matches(c, p), v) for v, p in rules]))


def looked_up(c: Column, table: dict[str, str], default: str | None = None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(pairs, c)
    return found if default is None else F.coalesce(found, F.lit(default))


def doc_family(text: Column, url: Column) -> Column:
    low, at = F.lower(text), F.lower(url)
    hits = []
    for family, pattern in DOC_FAMILY:
        by_url = [F.contains(at, F.lit(u)) for u in DOC_FAMILY_URLS.get(family, ())]
        test = F.coalesce(matches(low, pattern), F.lit(False))
        for b in by_url:
            test = test | F.coalesce(b, F.lit(False))
        hits.append(F.when(test, family))
    return F.coalesce(*hits, F.lit(DOC_FAMILY_DEFAULT))


def authority_level(family: Column) -> Column:
    return looked_up(family, AUTHORITY, AUTHORITY_DEFAULT)


def jurisdiction(family: Column) -> Column:
    return looked_up(family, JURISDICTION, JURISDICTION_DEFAULT)


def instrument(text: Column, url: Column, family: Column) -> Column:
    by_url = [F.when(F.contains(F.lower(url), F.lit(u)), v) for v, u in INSTRUMENT_URLS]
    return F.coalesce(first_match(F.lower(text), INSTRUMENT), *by_url, looked_up(family, INSTRUMENT_BY_FAMILY), F.lit(INSTRUMENT_DEFAULT))


def section_id(text: Column) -> Column:
    """``IRPR_179b`` or ``IRPA_A40_1a`` of the first section token, else empty."""
    token = F.regexp_extract(text, "(?i)" + _EDGE + r"([RA]\d{1,3}(?:\([a-z0-9]+\))*)", 1)
    base = F.regexp_extract(token, r"(?i)^[RA](\d{1,3})", 1)
    parts = F.transform(F.regexp_extract_all(token, F.lit(r"(?i)\(([a-z0-9]+)\)"), 1), lambda p: F.lower(p))
    joined = F.array_join(parts, "")
    suffix = F.when(F.get(parts, F.lit(0)).rlike(r"^\d+$"), F.concat(F.lit("_"), joined)).otherwise(joined)
    return F.when(token == "", "").when(F.upper(F.substring(token, 1, 1)) == "R", F.concat(F.lit("IRPR_"), base, suffix)).otherwise(F.concat(F.lit("IRPA_A"), base, suffix))


def noc_code(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "(?i)" + _EDGE + r"NOC\s*([0-9]{4,5})" + _EDGE, 1), F.lit(""))


def teer(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, "(?i)" + _EDGE + r"TEER\s*([0-5])" + _EDGE, 1), F.lit(""))


def metadata(title: Column, url: Column, heading_path: Column, text: Column) -> Column:
    """The canonical metadata of a chunk, by the variant that reads the title, URL, headings and 200 characters."""
    combined = F.concat_ws(" | ", title, url, F.array_join(heading_path, " | "), F.substring(text, 1, 200))
    family = doc_family(combined, url)
    return F.struct(
        family.alias("doc_family"), authority_level(family).alias("authority_level"), jurisdiction(family).alias("jurisdiction"), instrument(combined, url, family).alias("instrument"),
        section_id(text).alias("section_id"), first_match(F.lower(combined), PROGRAM_STREAM, "").alias("program_stream"), noc_code(text).alias("noc_code"), teer(text).alias("teer"),
        first_match(F.lower(combined), TABLE_TYPE, "").alias("table_type"),
    )


def query_profile(query: Column) -> Column:
    """What a question asks for: mode, jurisdiction, family, instruments, families to compare, and whether law must bind."""
    q = F.lower(F.trim(F.regexp_replace(query, r"\s+", " ")))
    family = first_match(q, PROFILE_FAMILY, "")
    compare = F.coalesce(matches(q, COMPARE), F.lit(False))
    return F.struct(
        looked_up(family, PROFILE_MODE, "default").alias("mode"), (family == "").alias("requires_binding"), jurisdiction(family).alias("jurisdiction"), family.alias("doc_family"),
        F.coalesce(all_matches(q, PROFILE_INSTRUMENTS), F.array().cast("array<string>")).alias("instruments"), compare.alias("compare_requested"),
        F.when(compare, all_matches(q, COMPARE_FAMILIES)).otherwise(F.array().cast("array<string>")).alias("compare_families"),
        F.coalesce(matches(q, CASE_LAW_REQUESTED), F.lit(False)).alias("case_law_requested"),
    )


def case_law_intent(message: Column) -> Column:
    return F.coalesce(matches(F.lower(message), CASE_LAW_INTENT), F.lit(False))


def injected_lines(message: Column) -> Column:
    """The different lines of a message, up to 220 characters of each, that try to instruct the model."""
    lines = F.filter(F.transform(F.split(message, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & matches(F.lower(x), any_of(INJECTION)))
    return F.array_distinct(F.transform(lines, lambda x: F.substring(x, 1, 220)))


def sanitized(message: Column, most: int = 4000) -> Column:
    """A message without such lines and blank ones; itself, if nothing would be left."""
    kept = F.array_join(F.filter(F.split(message, "\n"), lambda x: (F.trim(x) != "") & ~matches(F.lower(x), any_of(INJECTION))), "\n")
    return F.substring(F.when(F.trim(kept) == "", F.trim(message)).otherwise(F.trim(kept)), 1, most)


def domain_relevant(message: Column) -> Column:
    return F.coalesce(matches(F.lower(message), any_of(DOMAIN)), F.lit(False))


def vague(query: Column) -> Column:
    q = F.coalesce(F.trim(query), F.lit(""))
    return (F.length(q) < 16) | matches(F.lower(q), VAGUE)


# The same rules as SQL text, for engines whose \b is that of ASCII.


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_matches(expression: str, pattern: str) -> str:
    return f"regexp_matches({expression}, {_quoted(pattern)})"


def sql_first_match(expression: str, rules: Sequence[tuple[str, str]], default: str | None = None) -> str:
    return "CASE " + " ".join(f"WHEN {sql_matches(expression, p)} THEN {_quoted(v)}" for v, p in rules) + (f" ELSE {_quoted(default)}" if default is not None else "") + " END"


def sql_lookup(expression: str, table: dict[str, str], default: str | None = None) -> str:
    return f"CASE {expression} " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in table.items()) + (f" ELSE {_quoted(default)}" if default is not None else "") + " END"
