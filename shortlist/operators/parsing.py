"""Parsing: extraction confidence, outcome routing, sections, sentences, entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shortlist.functions import fixed
from shortlist.functions.entities import entities
from shortlist.functions.sections import section_positions, section_slices
from shortlist.functions.text import split_sentences, utf16_length


def classify_confidence(df: DataFrame) -> DataFrame:
    """From (format, raw_text): `parsing_confidence`, `parse_error`, and the text as kept.

    PDF needs 50 characters and a 0.6 share of ASCII letters; a failed one loses its text. A
    failed DOCX keeps its text. Plain text never fails.
    """
    text = F.coalesce(F.col("raw_text"), F.lit(""))
    size = utf16_length(text)
    short = size < fixed.MIN_TEXT_LENGTH
    letters = F.length(F.regexp_replace(text, "[^a-zA-Z]", ""))
    legible = F.try_divide(letters, size) >= F.lit(fixed.MIN_LETTER_RATIO)
    is_pdf, is_docx = F.col("format") == "pdf", F.col("format") == "docx"
    confidence = (
        F.when(is_pdf & short, "failed")
        .when(is_pdf, F.when(legible, "high").otherwise("low"))
        .when(is_docx, F.when(short, "failed").otherwise("high"))
        .otherwise(F.when(size > fixed.MIN_TEXT_LENGTH, "high").otherwise("low"))
    )
    error = F.when(is_pdf & short, fixed.PDF_NO_TEXT).when(is_docx & short, fixed.DOCX_NO_TEXT)
    return df.select(
        *[F.col(c) for c in df.columns if c != "raw_text"],
        F.when(is_pdf & short, F.lit("")).otherwise(text).alias("raw_text"),
        confidence.alias("parsing_confidence"),
        error.alias("parse_error"),
    )


def outcome_reason(df: DataFrame) -> DataFrame:
    """Add `failure_reason` (null = goes on). `read_error` is what reading the file raised, with
    unsupported formats reported the same way; neither ever stops the rest of the batch."""
    unsupported = F.when(
        F.col("format") == "unsupported",
        F.concat(
            F.lit("Unsupported file type: "), F.coalesce("mime_type", F.lit("")), F.lit(" / "), F.coalesce("original_filename", F.lit(""))
        ),
    )
    raised = F.coalesce(F.col("read_error"), unsupported)
    by_read = F.when(
        raised.isNotNull(),
        F.when(raised == "", F.lit("Could not read file.")).otherwise(
            F.concat(F.lit("Could not read file: "), raised)
        ),
    )
    by_text = F.when(
        F.col("parsing_confidence") == "failed",
        F.coalesce(F.col("parse_error"), F.lit(fixed.NO_TEXT_DEFAULT)),
    )
    return df.withColumn("failure_reason", F.coalesce(by_read, by_text))


def split_outcomes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that go on, rows that failed with their reason)."""
    routed = outcome_reason(df)
    return (
        routed.where(F.col("failure_reason").isNull()).drop("failure_reason"),
        routed.where(F.col("failure_reason").isNotNull()),
    )


def section_markers(df: DataFrame) -> DataFrame:
    """One row per section found, with its start in code points."""
    positions = section_positions(F.col("raw_text"))
    found = F.array(
        *[F.struct(F.lit(n).alias("section"), p.alias("position")) for n, p in positions.items()]
    )
    return df.select("cv_id", F.inline(found)).where(F.col("position").isNotNull())


def detect_sections(df: DataFrame) -> DataFrame:
    """Add the `sections` struct. Marker positions are computed once, in a step of their own."""
    positions = section_positions(F.col("raw_text"))
    marked = df.withColumns({f"_at_{name}": pos for name, pos in positions.items()})
    held = {name: F.col(f"_at_{name}") for name in positions}
    return marked.withColumn("sections", section_slices(F.col("raw_text"), held)).drop(
        *[f"_at_{name}" for name in positions]
    )


def sentences(df: DataFrame) -> DataFrame:
    return df.withColumn("sentences", split_sentences(F.col("raw_text")))


def explode_sentences(df: DataFrame, *carry: str) -> DataFrame:
    """(cv_id, carried columns, pos, sentence); positions count the kept sentences from 0.

    The split stands inside the explode on purpose: exploding a column of an earlier step makes
    the optimizer add a size filter below it, which would split every text twice.
    """
    return df.select(
        "cv_id", *carry, F.posexplode(split_sentences(F.col("raw_text"))).alias("pos", "sentence")
    )


def enrich(df: DataFrame) -> DataFrame:
    """Sections, sentences and entities of every row, without a shuffle."""
    sectioned = sentences(detect_sections(df))
    return sectioned.withColumn("entities", entities(F.col("raw_text"), F.col("sections.experience")))
