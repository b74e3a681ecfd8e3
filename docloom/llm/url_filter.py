"""URL filter: host and path rules first, then a weighted vocabulary.

A rule names a host and the start of a path; it fits the host itself and all its subdomains, and
the longest fitting rule decides.  Other URLs are scanned once by an Aho-Corasick automaton for
the terms of a vocabulary.  A hit counts only if no letter or digit adjoins it.  Each different term
that is hit adds its weight, and a URL is rejected from weight 1 on: by one strict term, which weighs
that much, or by several soft ones.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule and is
allowed unless its text has terms; URLs of any length are scanned whole; of rules of one length, which
can only fit together if they are equal, the first by code point decides; terms that are null, empty
or weigh nothing are left out, and one that is given twice has its larger weight; an empty table
gives no rows; repeated rows are judged alike; columns other than the URL are carried along,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Mapping
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.shared import ascii_lower

#: (rule, verdict): a host, a slash and the rest of a path's start.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
#: Terms that reject a URL alone, and terms of which several different ones do.
STRICT = ("adult", "casino", "escort", "hentai", "malware", "phishing", "porn", "sex", "spam", "viagra", "warez", "xxx")
SOFT = ("ad", "ads", "bet", "bets", "bonus", "cheap", "click", "coupon", "crack", "deal", "deals", "drugs", "farm", "free", "gambling", "jackpot", "keygen", "loan", "loans", "nude", "pharmacy", "pill", "pills", "poker", "popup", "slots", "torrent", "track", "tracker", "tracking", "win", "winner")
VOCABULARY = {term: 1.0 for term in STRICT} | {term: 0.5 for term in SOFT}
#: Characters of all terms that tasks get at most.
MOST_CHARACTERS = 5_000_000


def vocabulary_of(terms: DataFrame) -> dict[str, float]:
    """A table (term, weight) as a vocabulary; its size is checked before it is fetched."""
    kept = terms.where("term is not null and term <> '' and weight > 0").groupBy(F.lower("term").alias("term")).agg(F.max("weight").cast("double").alias("weight"))
    if (kept.agg(F.sum(F.length("term"))).first()[0] or 0) > MOST_CHARACTERS:
        raise ValueError(f"terms of over {MOST_CHARACTERS} characters do not fit into every task")
    return {r["term"]: r["weight"] for r in kept.collect()}


def host_of(url: Column) -> Column:
    """From after the first ``://`` to the next ``/``, ``?``, ``#`` or the end, in lower case; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, to the next ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, or null."""
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        own, _, rest = rule.partition("/")
        at = (host == own) | host.endswith(f".{own}")
        fits.append(F.when(at & path.startswith(f"/{rest}"), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits, F.lit(None).cast("struct<rule:string,verdict:string>"))


@lru_cache(maxsize=8)
def _automaton(terms: tuple[tuple[str, float], ...]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in terms:
        found.add_word(term, (term, weight))
    if terms:
        found.make_automaton()
    return found


def _hits(automaton: ahocorasick.Automaton, url: str) -> dict[str, float]:
    """The different terms, with their weights, that a URL in lower case has between its boundaries."""
    found = {}
    for end, (term, weight) in automaton.iter(url):
        start = end - len(term)
        if (start < 0 or not url[start].isalnum()) and (end + 1 == len(url) or not url[end + 1].isalnum()):
            found[term] = weight
    return found


def term_hits(url: Column, vocabulary: Mapping[str, float] = VOCABULARY) -> Column:
    """(terms, weight): the number of different terms in a URL, and what they weigh together."""
    terms = tuple(sorted((t.lower(), float(w)) for t, w in vocabulary.items() if t and w > 0))

    @F.pandas_udf("terms int, weight double")
    def count(urls: pd.Series) -> pd.DataFrame:
        automaton = _automaton(terms)
        found = [_hits(automaton, u.lower()) if u and terms else {} for u in urls]
        return pd.DataFrame({"terms": pd.Series([len(f) for f in found], dtype="int32"), "weight": pd.Series([math.fsum(f.values()) for f in found], dtype="float64")})

    return count(url)


def judged(pages: DataFrame, url_col: str = "url", rules: Iterable[tuple[str, str]] = RULES, vocabulary: Mapping[str, float] | DataFrame = VOCABULARY, limit: float = 1.0) -> DataFrame:
    """(page, host, path, rule, verdict, terms, weight) for each row; page holds the row's own columns.

    ``vocabulary`` maps terms to weights, or is a table (term, weight).
    """
    known = vocabulary_of(vocabulary) if isinstance(vocabulary, DataFrame) else vocabulary
    rows = pages.select(F.struct("*").alias("page"), F.col(url_col).alias("url"))
    rows = rows.select("page", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), term_hits(F.col("url"), known).alias("hits"))
    rows = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("hits.weight") >= limit, "block").otherwise("allow")
    return rows.select("page", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", own).alias("verdict"), "hits.terms", "hits.weight")
