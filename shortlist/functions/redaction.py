"""Personal-data redaction. `redact_text` applies the steps in the one order that is correct.

Every step names its input once, so the chain does not grow by copies of itself. A pass runs only over a text
that holds what each of its matches must hold, and tries only places where a match can begin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shortlist.functions import fixed
from shortlist.functions.fixed import java_pattern
from shortlist.functions.text import js_trim


def _replace(col: Column, pattern: str, mark: str) -> Column:
    return F.regexp_replace(col, java_pattern(pattern), mark)


def _where(col: Column, test, step) -> Column:
    """`step` of the texts that pass `test`, the others as they are."""
    return F.transform(F.array(col), lambda x: F.when(test(x), step(x)).otherwise(x))[0]


def _lower_holds(*words: str):
    """Whether a text holds one of the words in letters of any case."""

    def test(x: Column) -> Column:
        held = [F.contains(F.lower(x), F.lit(w)) for w in words]
        return held[0] if len(held) == 1 else held[0] | held[1]

    return test


def redact_email(col: Column) -> Column:
    """The part before the @ begins where its run of characters does, or where the last match ended."""
    return _where(col, lambda x: F.contains(x, F.lit("@")), lambda x: _replace(x, fixed.EMAIL_SEARCH, "[EMAIL]"))


def redact_phone(col: Column) -> Column:
    """Also takes any run of eight or more digits."""
    return _replace(col, r"(?=[+(\d])" + fixed.PHONE_PATTERN, "[PHONE]")


def redact_url(col: Column) -> Column:
    """Runs after the phone step: a digit run in a URL may be `[PHONE]` by then, the rest still goes."""
    return _where(col, lambda x: F.contains(x, F.lit("://")), lambda x: _replace(x, fixed.URL_PATTERN, "[URL]"))


def redact_address(col: Column) -> Column:
    named, numbered = fixed.ADDRESS_PATTERNS
    col = _where(col, _lower_holds("address"), lambda x: _replace(x, "(?=[aA])" + named, "[ADDRESS]"))
    return _replace(col, r"(?=\d)" + numbered, "[ADDRESS]")


def redact_birth(col: Column) -> Column:
    """In list order, one pass each: a replacement's closing bracket opens a word border for the next."""
    for word, pattern in zip(fixed.BIRTH_WORDS, fixed.BIRTH_PATTERNS):
        begin = f"(?=[{word[0]}{word[0].upper()}])(?i)"
        col = _where(col, _lower_holds(word), lambda x, p=begin + pattern: _replace(x, p, "[PERSONAL_DATA]"))
    return col


def strip_pronouns(col: Column) -> Column:
    """List order matters: "(she/they)" meets "he/they" first and leaves "(s"."""

    def strip(x: Column) -> Column:
        for tag in fixed.PRONOUN_TAGS:
            x = _replace(x, rf"(?=[({tag[0]}{tag[0].upper()}])(?i)\(?{tag}\)?", "")
        return x

    return _where(col, _lower_holds("he/", "they/"), strip)


def redact_name(col: Column) -> Column:
    """Replace the first non-blank line when it reads like a personal name."""
    return _replace(col, fixed.NAME_LINE, "$1[NAME]")


def redact_inline(col: Column) -> Column:
    """The steps that work inside a line; used alone on single sentences, which have no name line."""
    for step in (redact_email, redact_phone, redact_url, redact_address, redact_birth, strip_pronouns):
        col = step(col)
    return col


def redact_text(col: Column) -> Column:
    return js_trim(redact_name(redact_inline(col)))


def redact(df: DataFrame, col: str = "raw_text") -> DataFrame:
    """Add `anonymized_text`; a narrow projection with no shuffle."""
    return df.withColumn("anonymized_text", redact_text(F.col(col)))
