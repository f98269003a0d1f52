"""Facts read out of resume text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shortlist.functions import fixed
from shortlist.functions.fixed import java_pattern
from shortlist.functions.text import js_trim


def years_of_experience(text: Column) -> Column:
    """First of three patterns whose first match lies in 1..59, else 0. A number too long for an
    integer is out of range like any other."""
    candidates = []
    for pattern in fixed.YEARS_PATTERNS:
        years = F.regexp_extract(text, java_pattern(pattern), 1).try_cast("int")
        candidates.append(F.when(years.between(1, 59), years))
    return F.coalesce(*candidates, F.lit(0))


def _any_term() -> str:
    """One pattern for the whole dictionary, each term literal with an ASCII word boundary at both
    ends. After a symbol the boundary needs a word character to follow, so "C++ developer" does
    not tag while "C++11" does."""
    literals = ["".join(rf"\{ch}" if ch in ".+#" else ch for ch in term) for term in fixed.TECHNOLOGIES]
    return java_pattern(f"~<({'|'.join(literals)})~b")


def technologies(text: Column) -> Column:
    """Dictionary terms present, in dictionary order. One pass finds them all: no term can overlap
    another in a text, since every term starts and ends on a boundary and none holds another as
    a whole token."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(_any_term()), F.lit(1)))
    terms = F.array(*[F.lit(term) for term in fixed.TECHNOLOGIES])
    return F.array_intersect(terms, found)


def degrees(text: Column) -> Column:
    """At most one phrase per degree level, in level order."""
    found = [
        F.nullif(F.regexp_extract(text, java_pattern(pattern), 0), F.lit(""))
        for pattern in fixed.DEGREE_PATTERNS
    ]
    return F.transform(F.array_compact(F.array(*found)), js_trim)


def companies(experience: Column) -> Column:
    """Capitalised line starts, first-seen order. A bare header line counts as the first one."""
    names = F.transform(
        F.regexp_extract_all(experience, F.lit(java_pattern(fixed.COMPANY_PATTERN)), F.lit(1)), js_trim
    )
    long_enough = F.filter(names, lambda name: F.length(name) > 2)
    return F.slice(F.array_distinct(long_enough), 1, fixed.MAX_COMPANIES)


def roles(experience: Column) -> Column:
    titles = F.transform(
        F.regexp_extract_all(experience, F.lit(java_pattern(fixed.ROLE_PATTERN)), F.lit(0)),
        lambda title: js_trim(F.lower(title)),
    )
    return F.slice(F.array_distinct(titles), 1, fixed.MAX_ROLES)


def entities(text: Column, experience: Column) -> Column:
    return F.struct(
        years_of_experience(text).cast("int").alias("years_of_experience"),
        technologies(text).alias("technologies"),
        degrees(text).alias("degrees"),
        companies(experience).alias("companies"),
        roles(experience).alias("roles"),
    )
