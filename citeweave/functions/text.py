"""Scalar functions of the text side: normalising, comparing, scoring, and building request strings."""

from __future__ import annotations

import unicodedata
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from citeweave.functions import vocabulary as V


@F.pandas_udf(StringType())
def _folded(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else " ".join(v.casefold().split()))


@F.pandas_udf(StringType())
def _ascii(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode())


@F.pandas_udf(StringType())
def _quoted(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else quote(v))


def normalized_text(value: Column) -> Column:
    """Case folded, white space collapsed; ASCII text stays in the JVM's expressions."""
    plain = F.trim(F.regexp_replace(F.lower(value), r"[\t\n\x0b\f\r\x1c-\x1f ]+", " "))
    return F.when(value.rlike(r"^[\x00-\x7f]*$"), plain).otherwise(_folded(value))


def ascii_fold(value: Column) -> Column:
    """Compatibility decomposition without what is not ASCII."""
    return F.when(value.rlike(r"^[\x00-\x7f]*$"), value).otherwise(_ascii(value))


def url_quote(value: Column) -> Column:
    """Percent encoding that keeps slashes and writes a space as %20."""
    return F.when(value.rlike(r"^[A-Za-z0-9_.~/-]*$"), value).otherwise(_quoted(value))


def name_similarity(a: Column, b: Column) -> Column:
    """One less the edit distance's share of the longer name; 0 if either is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def _common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of the table at a time in the bits of an integer."""
    at: dict[str, int] = {}
    for k, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << k
    whole = (1 << len(b)) - 1
    row = whole
    for c in a:
        met = row & at.get(c, 0)
        row = (row + met | row - met) & whole
    return len(b) - row.bit_count()


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the longest common subsequence's share of both lengths (insertions and deletions only); 1 for two empty texts."""
    return pd.Series([None if x is None or y is None else 2 * _common_subsequence(x, y) / (len(x) + len(y)) if x or y else 1.0 for x, y in zip(a, b, strict=True)], dtype=object)


def agent_name(given: Column, family: Column) -> Column:
    """Given and family name without the full name."""
    return F.concat_ws(" ", given, family)


def agent_full_name(name: Column, given: Column, family: Column) -> Column:
    """The name, else given and family name, normalised; an empty text is no name."""
    return F.nullif(normalized_text(F.coalesce(name, F.nullif(F.concat_ws(" ", given, family), F.lit("")))), F.lit(""))


def clean_title(title: Column, stop_words: list[str], words: int = 4) -> Column:
    """The first words that aren't stop words; words are split at single spaces, case counts."""
    return F.array_join(F.slice(F.filter(F.split(title, " "), lambda w: ~F.array_contains(F.lit(stop_words), w)), 1, words), " ")


def usable_title(title: Column) -> Column:
    """Neither null nor empty nor a placeholder."""
    return title.isNotNull() & (title != "") & (F.lower(F.trim(title)) != "unknown")


def year_int(date: Column) -> Column:
    """The first part of four characters between hyphens as a number; null where there is none or it is no number."""
    return F.when(date.contains("-"), F.get(F.filter(F.split(date, "-"), lambda p: F.length(p) == 4), F.lit(0))).otherwise(date).try_cast("int")


def year_score(year: Column, issued: Column) -> Column:
    return F.when(year == issued, 3).otherwise(0)


def author_score(given: Column, family: Column, candidates: Column) -> Column:
    """Points for each candidate author (struct given, family) of the same family name.

    Two for the same given name, one for the same initial, one for a candidate without a given name.
    """
    points = lambda c: (
        F.when(c["family"].isNull() | (F.lower(c["family"]) != F.lower(family)), 0)
        .when(c["given"].isNull(), 1)
        .when(F.lower(c["given"]) == F.lower(given), 2)
        .when(F.lower(F.substring(c["given"], 1, 1)) == F.lower(F.substring(given, 1, 1)), 1)
        .otherwise(0)
    )
    return F.aggregate(candidates, F.lit(0), lambda total, c: total + F.coalesce(points(c), F.lit(0)))


def doi_case_variants(doi: Column) -> Column:
    return F.array_distinct(F.array(doi, F.lower(doi), F.upper(doi)))


def strip_prefix(value: Column, prefix: str = "https://openalex.org/") -> Column:
    return F.replace(value, F.lit(prefix), F.lit(""))


def short_scheme(iri: Column) -> Column:
    """What follows the last slash."""
    return F.element_at(F.split(iri, "/"), -1)


def bucket(number: Column, items: int) -> Column:
    """The upper end of the number's bucket of so many items."""
    return (F.ceil(number / items) * items).cast("long")


def orcid_search(given: Column, family: Column, identifiers: Column) -> Column:
    """A search for a name together with any of a resource's identifiers, or for one of both where the other is missing.

    identifiers: array of (scheme, literal); DOIs in every case variant, ISBNs and PMIDs are asked for, others not.
    Names are folded to ASCII. Null where there is nothing to search for.
    """
    term = lambda field, value: F.concat(F.lit(f'{field}:"'), value, F.lit('"'))
    terms = lambda i: (
        F.when(i["literal"].isNull(), F.array().cast("array<string>"))
        .when(i["scheme"] == V.DOI, F.transform(doi_case_variants(i["literal"]), lambda v: term("doi-self", v)))
        .when(i["scheme"] == V.ISBN, F.array(term("isbn", i["literal"])))
        .when(i["scheme"] == V.PMID, F.array(term("pmid-self", i["literal"])))
        .otherwise(F.array().cast("array<string>"))
    )
    ids = F.flatten(F.transform(identifiers, terms))
    found = F.when(F.size(ids) > 0, F.concat(F.lit("("), F.array_join(ids, " OR "), F.lit(")")))
    of_given = F.when(F.coalesce(given, F.lit("")) != "", F.concat(F.lit(" AND "), term("given-names", ascii_fold(given)))).otherwise("")
    name = F.concat(term("family-name", ascii_fold(family)), of_given)
    return F.coalesce(F.concat(found, F.lit(" AND ("), name, F.lit(")")), found, name)
