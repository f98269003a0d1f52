"""Text rebuilt from positioned page items, the form in which a PDF stores it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shortlist.functions import fixed
from shortlist.functions.text import js_trim


def clean_page(col: Column) -> Column:
    """Blanks before a newline go; three or more newlines become two."""
    return F.regexp_replace(F.regexp_replace(col, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")


def assemble_pages(items: DataFrame) -> DataFrame:
    """(doc_id, page, text) from items (doc_id, page, idx, str, y, height, has_eol).

    What separates two items depends on the vertical gap against the item's height (or the last known
    one), on the previous line end, and on whether the text so far already ends in a blank. All of it is
    read from the items before with windows: an item without text leaves the end of the text as it is
    unless a line break goes before it, and such a break does not depend on the end. The pieces are then
    joined once, so a page takes time in proportion to its items.
    """
    given = F.col("str").isNotNull()
    # items without text come last, so they are nobody's neighbour, but keep the place of a page of their own
    rows = items.select("doc_id", "page", "idx", "str", F.coalesce("y", F.lit(0.0)).alias("y"), "height", F.coalesce("has_eol", F.lit(False)).alias("has_eol"))
    order = [F.col("str").isNull().asc(), F.col("idx").asc(), F.col("str").asc(), F.col("y").asc(), F.col("height").asc(), F.col("has_eol").asc()]
    page = Window.partitionBy("doc_id", "page").orderBy(*order)
    to_here = page.rowsBetween(Window.unboundedPreceding, 0)
    before = page.rowsBetween(Window.unboundedPreceding, -1)

    sized = rows.select(
        "*",
        F.row_number().over(page).alias("_nth"),
        F.lag("y").over(page).alias("_y"),
        F.lag("has_eol").over(page).alias("_eol"),
        F.coalesce(F.last(F.when(F.col("height") > 0, F.col("height")), ignorenulls=True).over(to_here), F.lit(fixed.LAYOUT_START_HEIGHT)).alias("_height"),
    )
    gap = F.abs(F.col("_y") - F.col("y"))
    line_break = (
        F.when(F.col("_nth") == 1, F.lit(""))
        .when(gap > F.col("_height") * fixed.LAYOUT_PARAGRAPH_GAP, F.lit("\n\n"))
        .when(F.col("_eol") | (gap > F.col("_height") * fixed.LAYOUT_LINE_GAP), F.lit("\n"))
        .otherwise(F.lit(""))
    )
    broken = sized.withColumn("_break", line_break)
    ending = F.when(F.col("str") != "", F.col("str")).when(F.col("_break") != "", F.col("_break"))
    ended = broken.withColumn("_before", F.coalesce(F.last(ending, ignorenulls=True).over(before), F.lit("")))
    wants_space = (
        (F.col("_nth") > 1)
        & (F.col("_break") == "")
        & (F.col("_before") != "")
        & ~F.endswith("_before", F.lit(" "))
        & ~F.endswith("_before", F.lit("\n"))
        & (F.col("str") != "")
        & ~F.startswith("str", F.lit(" "))
    )
    piece = F.concat(F.when(wants_space, F.lit(" ")).otherwise(F.col("_break")), "str")
    pieces = F.array_sort(F.collect_list(F.when(given, F.struct("_nth", piece.alias("piece")))))
    text = F.array_join(F.transform(pieces, lambda p: p["piece"]), "")
    return ended.groupBy("doc_id", "page").agg(text.alias("text")).select("doc_id", "page", clean_page(F.col("text")).alias("text"))


def stitch_pages(pages: DataFrame) -> DataFrame:
    """One text per document: cleaned pages in order, a blank line between them, trimmed."""
    listed = pages.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("page", clean_page(F.col("text")).alias("text")))).alias("_pages")
    )
    joined = F.array_join(F.transform("_pages", lambda p: p["text"]), "\n\n")
    return listed.select("doc_id", js_trim(joined).alias("raw_text"))
