"""Text primitives with the screening rules' exact whitespace, length and rounding behaviour."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shortlist.functions import fixed
from shortlist.functions.fixed import java_pattern


def js_trim(col: Column) -> Column:
    """Strip every kind of blank from both ends (plain `trim` only strips spaces)."""
    return F.trim(col, F.lit(fixed.WHITESPACE))


def utf16_length(col: Column) -> Column:
    """Length in UTF-16 units; characters outside the basic plane count twice."""
    return (F.octet_length(F.encode(col, "UTF-16BE")) / 2).cast("int")


def normalize(col: Column) -> Column:
    """Lowercase, hyphens to spaces, blank runs to one space, trimmed. Single spaces are left to stand."""
    parted = F.replace(F.lower(col), F.lit("-"), F.lit(" "))
    return F.trim(F.regexp_replace(parted, rf"(?! ?[\x21-\x7e])[{fixed.WHITESPACE_CLASS}]+", " "))


def boundary_pattern(needle: Column) -> Column:
    """Regex that finds `needle` literally with no ASCII letter or digit touching it.

    A normalised needle is lowercase, so it can never hold the quote end mark.
    """
    return F.concat(F.lit(r"(?<![a-z0-9])\Q"), needle, F.lit(r"\E(?![a-z0-9])"))


def boundary_match(norm: Column, needle: Column, pattern: Column | None = None) -> Column:
    """Whole-token containment. The substring test runs first, so the regex, whose pattern
    differs per needle and is compiled per call, only runs on near-certain hits."""
    if pattern is None:
        pattern = boundary_pattern(needle)
    return (needle != "") & F.contains(norm, needle) & F.rlike(norm, pattern)


def split_sentences(col: Column) -> Column:
    """Sentences as an array: split on sentence ends, newlines and bullets; short ones dropped."""
    parts = F.transform(F.split(col, java_pattern(fixed.SENTENCE_BREAK)), js_trim)
    enough = fixed.MIN_SENTENCE_LENGTH
    return F.filter(parts, lambda s: (F.length(s) >= enough) | (utf16_length(s) >= enough))


def round_half_up(col: Column) -> Column:
    return F.floor(col + F.lit(0.5))


def one_decimal(col: Column) -> Column:
    """Half-up to one decimal, always printed with it."""
    tenths = F.floor(col * 10 + F.lit(0.5)).cast("long")
    whole = F.floor(F.abs(tenths) / 10).cast("long").cast("string")
    return F.concat(
        F.when(tenths < 0, F.lit("-")).otherwise(F.lit("")),
        whole,
        F.lit("."),
        F.pmod(F.abs(tenths), F.lit(10)).cast("string"),
    )


def json_string(col: Column) -> Column:
    """The value as a quoted JSON string."""
    wrapped = F.to_json(F.array(col))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)
