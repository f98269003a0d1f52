"""Cluster-facing helpers: spreading work, skew-safe lookups, lineage cuts, distributed ordering."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

BROADCAST_ROWS = 50_000
ROWS_A_TASK = 250_000  # narrow rows that a task sorts
LEAST_ROWS = 1000  # of a key before it is split


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use every core for heavy per-row work when a small input has fewer splits than cores.

    A large scan already has far more splits than cores and is left alone: no shuffle there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(2 * cores, *keys)


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether the table has at most `rows` rows, reading no more than that many and one."""
    return df.limit(rows + 1).count() <= rows


def measured_salts(rows: DataFrame, on: list[str]) -> DataFrame:
    """(on, _salts) of the keys that hold more than a task's fair share of the rows, each with as many salts
    as shares it holds. Fewer than 2 x shuffle partitions keys can, so the table is safe to broadcast."""
    held = cut_lineage(rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_held")))
    total = held.agg(F.sum("_held")).first()[0] or 0
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(total // (2 * tasks), LEAST_ROWS)
    return held.where(F.col("_held") > share).select(*on, F.ceil(F.col("_held") / F.lit(share)).cast("int").alias("_salts"))


def group_sizes(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, _size) of every group, written once, and (keys, _big) of those above a task's fair share:
    fewer than 2 x shuffle partitions, hence safe to broadcast."""
    sizes = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")))
    total = sizes.agg(F.sum("_size")).first()[0] or 0
    share = max(total // (2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), LEAST_ROWS)
    return sizes, sizes.where(F.col("_size") > share).select(*keys, F.lit(True).alias("_big"))


def salted_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "inner",
    bounded_by: DataFrame | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Equi-join many rows per key to a per-key table, whatever share of the rows one key holds.

    The lookup side is broadcast only when counted to be small; then the rows do not move. Beyond
    that, rows shuffle on (key, salt), where a key has as many salts as its measured number of rows
    calls for (one for most keys), and the lookup side has a copy per salt of its key. `bounded_by`
    names a table that is cheaper to count and has at least as many rows as `lookup`. `partitions` deals both
    sides to so many tasks (see `tasks_for`).
    """
    if at_most(lookup if bounded_by is None else bounded_by, BROADCAST_ROWS):
        return rows.join(F.broadcast(lookup), on, how)
    salts = F.broadcast(measured_salts(rows.select(*on), on))
    count = F.coalesce("_salts", F.lit(1))
    salted_rows = rows.join(salts, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread_by), count).cast("int")).drop("_salts")
    copies = lookup.join(salts, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), count - 1))).drop("_salts")
    if partitions is not None:
        salted_rows, copies = (side.repartition(partitions, *on, "_salt") for side in (salted_rows, copies))
    return salted_rows.join(copies.hint("merge"), [*on, "_salt"], how).drop("_salt")


def tasks_for(rows: int, spark: SparkSession) -> int:
    """Tasks for a shuffle of so many narrow rows: more of them, not bigger ones, as the table grows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK))


def latest(commands: DataFrame, *keys: str) -> DataFrame:
    """One command per key: the one with the greatest `seq` where there is such a column."""
    rest = [c for c in commands.columns if c not in keys]
    if not rest:
        return commands.distinct()
    order = F.col("seq") if "seq" in rest else F.xxhash64(*rest)
    chosen = commands.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_one"))
    return chosen.select(*keys, "_one.*").select(*commands.columns)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the session's `spark.checkpoint.dir`, or the checkpoint folder
    set on the context. Only a local session without either gets a temporary one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="shortlist-"))
        folder = context.getCheckpointDir()
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there, so that a lost executor
    never repeats (or changes the outcome of) the work above. Being columnar, the table lets each
    later reader take only its columns."""
    path = f"{shared_folder(df.sparkSession)}/shortlist-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _slices(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Range-partition on (keys, order) and number the ranges. The ranges come from sampling, so
    they are fixed in a written table before anything is derived from their numbers."""
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *[F.col(k).asc() for k in keys], *order)
    return cut_lineage(ranged.withColumn("_slice", F.spark_partition_id()))


def _same_group(keys: list[str], left: str, right: str) -> Column:
    same = F.col(f"{left}._slice") == F.col(f"{right}._slice")
    for key in keys:
        same = same & F.col(f"{left}.{key}").eqNullSafe(F.col(f"{right}.{key}"))
    return same


def distributed_running_sum(
    df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str
) -> DataFrame:
    """Running sum per group, current row included, where one group may be far too big for one task.

    Sums run inside each (slice, group); a group that spans slices adds what its earlier slices
    hold. Only groups that cross a slice edge need that, so the offset table has at most two rows
    per slice and is safe to broadcast.
    """
    sliced = _slices(df.withColumn("_value", value.cast("long")), keys, order)
    held = sliced.groupBy("_slice", *keys).agg(F.sum("_value").alias("_held"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        held.withColumn("_before", F.sum("_held").over(earlier))
        .where(F.col("_before").isNotNull())
        .drop("_held")
    )
    so_far = Window.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumn(name, F.sum("_value").over(so_far))
    joined = local.alias("l").join(F.broadcast(offsets).alias("o"), _same_group(keys, "l", "o"), "left")
    total = F.col(f"l.{name}") + F.coalesce(F.col("o._before"), F.lit(0))
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], total.alias(name))


def distributed_row_number(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """`row_number` per group under the same hot-group assumption."""
    return distributed_running_sum(df, keys, order, F.lit(1), name)


def distributed_lead(
    df: DataFrame, keys: list[str], order: list[Column], value: str, name: str
) -> DataFrame:
    """`lead(value)` per group likewise: the last row of a slice takes the first value of the
    group's next slice from a table of at most one row per slice edge."""
    sliced = _slices(df, keys, order)
    in_slice = Window.partitionBy("_slice", *keys).orderBy(*order)
    local = sliced.withColumn("_last", F.lead(F.lit(True)).over(in_slice).isNull()).withColumn(
        name, F.lead(value).over(in_slice)
    )
    first_position = sliced.withColumn("_at", F.row_number().over(in_slice)).where("_at = 1")
    following = (
        first_position.select("_slice", *keys, F.col(value).alias("_first"))
        .withColumn("_next", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_slice")))
        .where(F.col("_next").isNotNull())
        .drop("_first")
    )
    joined = local.alias("l").join(
        F.broadcast(following).alias("o"), _same_group(keys, "l", "o"), "left"
    )
    filled = F.when(F.col("l._last"), F.col("o._next")).otherwise(F.col(f"l.{name}"))
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], filled.alias(name))
