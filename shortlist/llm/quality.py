"""Quality rules: per-document counts and cross-document line frequency, in DataFrame functions only.

Method: each line is normalised (lower case, blank runs to one space, digits to 0) and hashed; per host
the distinct documents that hold a line are counted; lines above the limits are removed; a document
that keeps too little of its words is rejected. The limits are a share of the host's documents and a
floor of a few documents, so they act alike on hosts of any size from the floor on.

Defined results: null text has no words and no lines and fails the base rule; a null host is a host
of its own; rows with one doc_id are each returned but counted once behind a line, rows without doc_id
by their text; a table without rows gives no rows; extra columns pass through `clean_documents` untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from shortlist.cluster import salted_lookup
from shortlist.llm.common import BLANKS, apart, bound, cut_lineage, read
from shortlist.llm.registry import query

MIN_DOCS = 5  # a line is frequent from this many documents of its host ...
MAX_SHARE = 0.05  # ... if they are also more than this share of the host's documents
MIN_LEFT = 0.3  # a document is depleted when less than this share of its words is left

_TRIM = " \t\n\x0b\x0c\r"
_WORD = r"[^\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_TRIM))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANKS))


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more, the first included."""

    def covered(hits: Column) -> Column:
        three = F.transform(hits, lambda x: F.array(x["at"], x["at"] + 1, x["at"] + 2))
        return F.size(F.array_distinct(F.flatten(three)))

    def of_sorted(s: Column) -> Column:
        same = F.filter(
            s,
            lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]),
        )
        return covered(same)

    def of_words(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(
                F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("at")
            ),
        )
        return F.when(F.size(w) < 4, F.lit(0)).otherwise(bound(F.sort_array(windows), of_sorted))

    return bound(words, of_words).cast("long")


def normalise_line(line: Column) -> Column:
    return F.regexp_replace(F.btrim(F.regexp_replace(F.lower(line), BLANKS, " ")), "[0-9]", "0")


def lines_of(text: Column) -> Column:
    """(line as it is) of every line with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(_WORD))


def document_facts(docs: DataFrame, host: str = "source") -> DataFrame:
    """One narrow row per document: base counts, text hash, and its lines as (hash, words)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = lines_of(F.col("text"))
    per_line = F.transform(
        lines,
        lambda x: F.struct(
            F.xxhash64(normalise_line(x)).alias("h"),
            F.size(F.split(F.btrim(x, F.lit(_TRIM)), BLANKS)).alias("w"),
        ),
    )
    words = words_of(F.col("text"))
    return (
        docs.select(
            "doc_id",
            F.coalesce(F.col(host).cast("string"), F.lit("\x00none")).alias("host"),
            F.xxhash64(text, F.octet_length(text)).alias("th"),
            F.size(words).cast("long").alias("n_words"),
            F.coalesce(F.char_length(F.concat_ws("", words)), F.lit(0)).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(words).alias("n_repeat_words"),
            per_line.alias("lines"),
        )
        .withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
        .withColumn("row", F.monotonically_increasing_id())  # fixed by the write that follows
    )


def frequent_lines(facts: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, h) of the lines above the limits. Both counts are combined before their shuffles."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.col("th")).alias("doc")
    docs = facts.select("host", doc).groupBy("host").agg(F.count_distinct("doc").alias("host_docs"))
    held = facts.select("host", doc, F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counts = held.groupBy("host", "h").agg(F.count_distinct("doc").alias("n")).where(F.col("n") >= min_docs)
    known = salted_lookup(counts, docs, ["host"], spread_by=["h"])
    return known.where(F.col("n") > max_share * F.col("host_docs")).select("host", "h")


def line_hits(facts: DataFrame, frequent: DataFrame) -> DataFrame:
    """(row, doc_id, th, host, h, w) of every occurrence of a frequent line."""
    lines = facts.select("row", "doc_id", "th", "host", F.explode("lines").alias("l")).select(
        "row", "doc_id", "th", "host", "l.h", "l.w"
    )
    return salted_lookup(lines, frequent, ["host", "h"], spread_by=["row"])


def quality_report(
    docs: DataFrame,
    host: str = "source",
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
    min_left: float = MIN_LEFT,
) -> DataFrame:
    """Counts and verdict of every document; `n_line_words` are its words in frequent lines."""
    facts = cut_lineage(document_facts(docs, host))
    frequent = cut_lineage(frequent_lines(facts, min_docs, max_share))
    removed = line_hits(facts, frequent).groupBy("row").agg(F.sum("w").alias("n_line_words"))
    left = F.col("n_words") - F.col("n_line_words")
    return (
        facts.drop("lines")
        .join(removed, "row", "left")
        .withColumn("n_line_words", F.coalesce("n_line_words", F.lit(0)).cast("long"))
        .withColumn("kept", ~F.col("base_failed") & (left >= min_left * F.col("n_words")))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_line_words",
        )
    )


def clean_documents(
    docs: DataFrame,
    host: str = "source",
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
    min_left: float = MIN_LEFT,
) -> DataFrame:
    """The kept documents with their frequent lines taken out, all columns as they were.

    Verdicts and the lines to take out are narrow rows; they meet the texts in one join. Rows that
    agree in id, host and text share one verdict, so a repeated row is kept or dropped as a whole.
    """
    return apart(docs, ["doc_id", "text", "n_chars", host], lambda rows: _cleaned(rows, host, min_docs, max_share, min_left))


def _cleaned(docs: DataFrame, host: str, min_docs: int, max_share: float, min_left: float) -> DataFrame:
    # base counts that the verdict does not use are pruned before the facts are written
    facts = cut_lineage(document_facts(docs, host).select("row", "doc_id", "host", "th", "n_words", "base_failed", "lines"))
    frequent = cut_lineage(frequent_lines(facts, min_docs, max_share))
    hits = line_hits(facts, frequent).groupBy("row").agg(F.sum("w").alias("out"), F.collect_set("h").alias("hs"))
    verdicts = (
        facts.join(hits, "row", "left")
        .where(~F.col("base_failed"))
        .where(F.col("n_words") - F.coalesce("out", F.lit(0)) >= min_left * F.col("n_words"))
        .groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("host").alias("_host"))
        .agg(F.first("hs").alias("_hs"))
    )
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumn("_t", F.xxhash64(text, F.octet_length(text))).withColumn(
        "_h", F.coalesce(F.col(host).cast("string"), F.lit("\x00none"))
    )
    joined = keyed.join(
        verdicts, keyed["doc_id"].eqNullSafe(verdicts["_id"]) & (keyed["_t"] == verdicts["_th"]) & (keyed["_h"] == verdicts["_host"])
    )
    kept_lines = F.filter(
        F.split(text, "\n", -1),
        lambda x: ~x.rlike(_WORD) | ~F.array_contains("_hs", F.xxhash64(normalise_line(x))),
    )
    cleaned = F.when(F.col("_hs").isNull(), F.col("text")).otherwise(F.array_join(kept_lines, "\n"))
    out = joined.withColumn("text", cleaned)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_hs").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)


_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, host, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM win) WHERE k > 1),
cov AS (SELECT r, count(DISTINCT i + o) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY r),
li AS (SELECT r, doc_id, host, t, x AS line, regexp_replace(trim(regexp_replace(lower(x), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]', '0', 'g') AS nl,
              len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y <> '')) AS n
       FROM (SELECT r, doc_id, host, t, unnest(ls) AS x FROM w)),
fr AS (SELECT host, nl FROM (SELECT host, nl, count(DISTINCT coalesce(doc_id::VARCHAR, t)) AS n FROM li GROUP BY host, nl)
       JOIN (SELECT host, count(DISTINCT coalesce(doc_id::VARCHAR, t)) AS all_docs FROM d GROUP BY host) USING (host)
       WHERE n >= 5 AND n > 0.05 * all_docs),
rm AS (SELECT r, sum(n) AS n FROM li JOIN fr USING (host, nl) GROUP BY r),
b AS (SELECT w.r, w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
             CAST(coalesce(rm.n, 0) AS BIGINT) AS n_line_words
      FROM w LEFT JOIN cov ON w.r = cov.r LEFT JOIN rm ON w.r = rm.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - n_line_words >= 0.3 * n_words AS kept,
       n_line_words
FROM b
"""


@query("op6_quality_rules", _SQL)
def op6_quality_rules(spark, sf_dir):
    return quality_report(read(spark, sf_dir, "documents"))
