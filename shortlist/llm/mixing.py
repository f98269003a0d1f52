"""Mixing sources to target weights, in DataFrame functions only.

Method: words are summed per source; a source's target is its weight's part of `share` times all words,
but at most `most` times its own words, the excess being shared by weight among the others until none
is above (a water level: with sources sorted by limit over weight it follows from two running sums).
A source's rate is target over size; each document is emitted floor(rate) times and once more if a
number in [0, 1) drawn from a hash of its doc_id is below the rate's fraction. The draw depends on the
doc_id and the seed alone, so reruns and retried tasks give the same mix.

Sources are summed with partial aggregation before the shuffle and looked up by a counted broadcast
or a salted join, so a hot source is no hot task. Numbering and running sums over the sources use range
slices, so millions of sources (hosts, say) are not one task either.

Defined results: null or blank text has size 0 and is emitted like any other document of its source,
with 0 words; a null source is a source of its own and comes last; sources of size 0 have target 0; rows
with the same doc_id share one draw, and rows without doc_id draw by their text; no rows give no rows.
`mix` returns all columns of its input under their names and adds `copy` (1, 2, ...), with underscores
put before it where that name is taken.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from shortlist.cluster import distributed_row_number, distributed_running_sum, salted_lookup
from shortlist.llm.common import cut_lineage, read
from shortlist.llm.registry import query

WEIGHTS = (3, 1, 2)  # of the sources in code point order, repeating
SHARE = 1.5  # of all words the mix takes
MOST = 2.0  # times its words that a source may be taken
SEED = "mix"

_WORDS = r"[^\x20\x09-\x0D]+"
_KEY = ["no_source", "source"]


def with_sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Each input row packed as `row`, with its source, its size in words and its draw in [0, 1)."""
    drawn = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.col("text"), F.lit("")))
    return docs.select(
        F.struct("*").alias("row"),
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(_WORDS)), F.lit(0)).cast("long").alias("size"),
        (F.conv(F.substring(F.md5(drawn), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))).alias("draw"),
    )


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(no_source, source, source_size, target) of each source."""
    sums = cut_lineage(sized.groupBy(*_KEY).agg(F.sum("size").alias("source_size")))
    ranked = distributed_row_number(sums, [], [F.col("no_source").asc(), F.col("source").asc()], "place")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    limits = ranked.withColumn("weight", weight.cast("long")).withColumn("fill", F.lit(most) * F.col("source_size") / F.col("weight"))
    order = [F.col("fill").asc(), F.col("place").asc()]
    summed = distributed_running_sum(limits, [], order, F.col("source_size"), "size_so_far")
    summed = cut_lineage(distributed_running_sum(summed, [], order, F.col("weight"), "weight_so_far"))
    words, weighed = summed.agg(F.sum("source_size"), F.sum("weight")).first()
    # the level if every source before this one in the order stands at its limit
    level = (F.lit(share * (words or 0)) - F.lit(most) * (F.col("size_so_far") - F.col("source_size"))) / (
        F.lit(weighed or 0) - F.col("weight_so_far") + F.col("weight")
    )
    filled = summed.withColumn("level", level).where("level <= fill")
    reached = filled.agg(F.min_by("level", F.struct("fill", "place"))).first()[0]
    limit = F.lit(most) * F.col("source_size")
    target = limit if reached is None else F.least(limit, F.lit(reached) * F.col("weight"))
    return summed.select(*_KEY, "source_size", target.alias("target"))


def with_copies(sized: DataFrame, per_source: DataFrame) -> DataFrame:
    """Adds source_size, target and `copies`, how many times the mix has the row."""
    rows = salted_lookup(sized, per_source, _KEY, spread_by=["draw"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return rows.withColumn("copies", whole + (F.col("draw") < rate - whole).cast("long"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = SEED) -> DataFrame:
    """The rows of the mix, each as often as it is taken."""
    sized = with_sizes(docs, seed)
    placed = with_copies(sized, targets(sized.drop("row"), weights, share, most)).where("copies > 0")
    name = "copy"
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return placed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("nth")).select(
        *[F.col("row")[c].alias(c) for c in docs.columns], F.col("nth").cast("int").alias(name)
    )


SQL = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, text, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
    FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sums),
limits AS (
    SELECT *, [3, 1, 2][((place - 1) % 3 + 1)::INT]::BIGINT AS weight,
        2.0::DOUBLE * source_size / ([3, 1, 2][((place - 1) % 3 + 1)::INT]::DOUBLE) AS fill
    FROM ranked),
summed AS (
    SELECT *, sum(source_size) OVER (ORDER BY fill, place) - source_size AS size_before,
        sum(weight) OVER (ORDER BY fill, place) - weight AS weight_before,
        sum(source_size) OVER () AS words, sum(weight) OVER () AS weighed
    FROM limits),
levels AS (
    SELECT *, (1.5::DOUBLE * words::DOUBLE - 2.0::DOUBLE * size_before::DOUBLE) / (weighed - weight_before)::DOUBLE AS level FROM summed),
reached AS (SELECT arg_min(level, place_in_order) AS level FROM (
    SELECT level, row_number() OVER (ORDER BY fill, place) AS place_in_order FROM levels WHERE level <= fill)),
per_source AS (
    SELECT l.source, l.source_size, least(2.0::DOUBLE * l.source_size, r.level * l.weight) AS target FROM levels l, reached r),
rated AS (
    SELECT d.doc_id, d.size, d.draw, p.source_size, p.target,
        CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0.0::DOUBLE END AS rate
    FROM sized d JOIN per_source p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
    (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""


@query("op11_mixing", SQL)
def op11_mixing(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    sized = cut_lineage(with_sizes(docs).select(F.col("row.doc_id").alias("doc_id"), *_KEY, "size", "draw"))
    placed = with_copies(sized, targets(sized))
    return placed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
