"""Resume sections found by header pattern."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from shortlist.functions import fixed
from shortlist.functions.fixed import java_pattern
from shortlist.functions.text import js_trim


def _position(text: Column, header: str) -> Column:
    """Code points before the first match, or null. Counted on the text before the match because
    `regexp_instr` counts UTF-16 units while `substring` counts code points."""
    pattern = java_pattern(fixed.SECTION_HEADER_PREFIX + header)
    return F.when(
        F.rlike(text, F.lit(pattern)), F.length(F.element_at(F.split(text, pattern, 2), 1))
    )


def section_positions(text: Column) -> dict[str, Column]:
    """Start of each section. Within a section the first *pattern* that matches wins, even where
    a later pattern would match further up."""
    return {
        name: F.coalesce(*[_position(text, header) for header in headers])
        for name, headers in fixed.SECTION_HEADERS.items()
    }


def section_slices(text: Column, positions: dict[str, Column]) -> Column:
    """Struct of five strings. Each section runs to the next marker; what stands before the first
    marker is dropped; with no marker at all the whole text is `other`."""
    slices = []
    for name, start in positions.items():
        later = [F.when(pos > start, pos) for other, pos in positions.items() if other != name]
        end = F.coalesce(F.least(*later), F.length(text))
        cut = js_trim(F.substring(text, start + 1, end - start))
        slices.append(F.coalesce(cut, F.lit("")).alias(name))
    unmarked = F.coalesce(*positions.values()).isNull()
    slices.append(F.when(unmarked, text).otherwise(F.lit("")).alias("other"))
    return F.struct(*slices)
