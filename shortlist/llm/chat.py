"""Collapse of cumulative conversation snapshots, then rendering in a chat format.

Each turn has a rolling hash of the conversation up to it: the running sum of hashes that hold the
turn's place, role and text. A conversation whose last hash occurs inside a longer one is a logged
prefix of it and goes; of equal conversations the smallest conv_id stays. Turns are numbered and
summed in range slices, so one huge conversation is spread over tasks, and prefixes are grouped
before they are compared, so a first turn that very many conversations share is one row.

Rendering makes one row per `PART` turns, which bounds a row whatever the conversation's length.

Defined results: turns stand in the order of turn, role, text (nulls first); null role or text is
rendered empty and equals only null; turns repeated whole count as turns; a null conv_id is a
conversation of its own; no rows give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from shortlist.llm.common import blocks, cut_lineage, read
from shortlist.llm.registry import query

PART = 1000
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SLICE_ROWS = 200_000

_ORDER = ["turn", "role", "text"]
_KINDS = "decimal(38,0)"


def _over_slices(sliced: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Running sums per conversation in order; what earlier slices hold is added to those that go on."""
    inside = Window.partitionBy("slice", "conv_id").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    held = sliced.groupBy("slice", "conv_id").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = held.select("slice", "conv_id", *[F.sum(f"_{n}").over(earlier).alias(f"_{n}") for n in sums])
    before = before.where(F.col(f"_{next(iter(sums))}").isNotNull())  # at most one conversation per slice edge
    local = sliced.select("*", *[F.sum(c).over(inside).alias(n) for n, c in sums.items()])
    joined = local.alias("l").join(
        F.broadcast(before).alias("b"), (F.col("l.slice") == F.col("b.slice")) & F.col("l.conv_id").eqNullSafe(F.col("b.conv_id")), "left"
    )
    keep = [F.col(f"l.{c}") for c in sliced.columns]
    return joined.select(*keep, *[(F.col(f"l.{n}") + F.coalesce(F.col(f"b._{n}"), F.lit(0))).cast(_KINDS).alias(n) for n in sums])


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """Every turn with its place from 1 on and two rolling hashes of the conversation up to it."""
    rows = turns.select("conv_id", *_ORDER)
    slices = blocks(turns.count(), SLICE_ROWS, 8)
    # equal rows are told apart only by being counted, so any order among them is the same
    ranged = rows.repartitionByRange(slices, F.col("conv_id").asc(), *[F.col(c).asc() for c in _ORDER], F.rand(7))
    sliced = cut_lineage(ranged.withColumn("slice", F.spark_partition_id()))
    placed = _over_slices(sliced, {"place": F.lit(1).cast(_KINDS)})
    parts = [F.col("place").cast("long"), F.coalesce(F.xxhash64("role"), F.lit(0)), F.col("role").isNull(), F.col("text"), F.col("text").isNull()]
    hashed = cut_lineage(
        placed.select(
            "slice", "conv_id", *_ORDER, F.col("place").cast("long").alias("place"),
            F.xxhash64(F.lit(1), *parts).cast(_KINDS).alias("h1"), F.xxhash64(F.lit(2), *parts).cast(_KINDS).alias("h2"),
        )
    )
    return _over_slices(hashed, {"one": F.col("h1"), "two": F.col("h2")}).drop("slice", "h1", "h2")


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_equal) of the conversations that are no prefix of a longer one."""
    lengths = hashed.groupBy("conv_id").agg(F.max("place").alias("n_turns"))
    turns = hashed.select("conv_id", "place", "one", "two").join(
        lengths.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id"))
    )
    prefixes = turns.groupBy("place", "one", "two").agg(
        F.max("n_turns").alias("longest"),
        F.min(F.when(F.col("place") == F.col("n_turns"), F.struct(F.col("conv_id").isNull(), "conv_id"))).alias("ending"),
        F.count_if(F.col("place") == F.col("n_turns")).alias("n_equal"),
    )
    longer = prefixes.where(F.col("longest") > F.col("place")).select("place", "one", "two")
    ends = prefixes.where(F.col("n_equal") > 0)
    return ends.join(longer, ["place", "one", "two"], "left_anti").select(
        F.col("ending.conv_id").alias("conv_id"), F.col("place").alias("n_turns"), "n_equal"
    )


def render(hashed: DataFrame, kept: DataFrame, part: int = PART) -> DataFrame:
    """(conv_id, part, n_turns, text): the kept conversations in chat format, `part` turns a row."""
    piece = F.concat(F.lit(OPEN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(f"{CLOSE}\n"))
    marked = hashed.select("conv_id", "place", piece.alias("piece"), F.floor((F.col("place") - 1) / part).alias("part"))
    parts = marked.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("turns"))
    chosen = kept.select(F.col("conv_id").alias("_id"), "n_turns", "n_equal")
    return parts.join(chosen, F.col("conv_id").eqNullSafe(F.col("_id"))).select(
        "conv_id", "part", "n_turns", "n_equal", F.array_join(F.transform("turns", lambda x: x["piece"]), "").alias("text")
    )


def format_chats(turns: DataFrame, part: int = PART) -> DataFrame:
    hashed = cut_lineage(prefix_hashes(turns))
    return render(hashed, maximal_conversations(hashed), part)


_SQL = """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM conversations),
c AS (SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY place) AS turns,
             string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY place) AS text
      FROM t GROUP BY conv_id),
u AS (SELECT turns, n_turns, min(conv_id) AS conv_id, count(*) AS n_equal, any_value(text) AS text FROM c GROUP BY turns, n_turns),
p AS (SELECT DISTINCT list_slice(turns, 1, k) AS turns FROM (SELECT turns, unnest(range(1, n_turns)) AS k FROM u))
SELECT conv_id, CAST(0 AS BIGINT) AS part, CAST(n_turns AS BIGINT) AS n_turns, CAST(n_equal AS BIGINT) AS n_equal, text
FROM u WHERE turns NOT IN (SELECT turns FROM p)
"""


@query("op7_chat_formatting", _SQL)
def op7_chat_formatting(spark, sf_dir):
    return format_chats(read(spark, sf_dir, "conversations"))
