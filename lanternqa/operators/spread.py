"""Joins and numbering that keep a hot key or group off a single task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanternqa.session import materialize

HOT_ROWS = 1_000_000
# What one key's joined rows may weigh in one task, where they carry long values.
HOT_BYTES = 256 << 20
LEAST_HOT_ROWS = 1000
NULL_SUBS = 1024


def hot_keys(df: DataFrame, on: list[str], hot_rows: int | None = None) -> DataFrame:
    """Keys with more than `hot_rows` rows, and the sub-keys each is split into.

    Counts fold before the shuffle. At most one key per `hot_rows` rows of `df`
    can qualify, which is what bounds the broadcasts below.
    """
    limit = hot_rows or HOT_ROWS
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    hot = counts.select(*on, F.ceil(F.col("_n") / limit).cast("int").alias("_subs"))
    return F.broadcast(hot)


def rows_of_bytes(widest: int | None) -> int:
    """How many rows of a key make it hot if each carries a value of up to `widest` bytes."""
    return max(LEAST_HOT_ROWS, min(HOT_ROWS, HOT_BYTES // max(widest or 1, 1)))


def split_keys(left: DataFrame, hot: DataFrame, on: list[str], by: list[str], sub: str = "_sub") -> DataFrame:
    """Add `sub`: rows of a hot key are spread over its sub-keys by the `by` columns."""
    absent = F.lit(False)
    for key in on:
        absent = absent | F.col(key).isNull()
    subs = F.when(absent, NULL_SUBS).otherwise(F.coalesce("_subs", F.lit(1)))
    return (
        left.join(hot, on, "left").withColumn(sub, F.pmod(F.xxhash64(*by), subs).cast("int"))
        .drop("_subs")
    )


def copy_keys(right: DataFrame, hot: DataFrame, on: list[str], sub: str = "_sub") -> DataFrame:
    """Add `sub`: rows of a hot key are copied to each of its sub-keys, others stay single."""
    subs = F.sequence(F.lit(0), F.coalesce("_subs", F.lit(1)) - 1)
    return right.join(hot, on, "left").withColumn(sub, F.explode(subs)).drop("_subs")


def spread_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", by: list[str] | None = None,
    hot_rows: int | None = None,
) -> DataFrame:
    """Join a left side whose keys may be hot to a right side.

    Reads the left keys once to find the hot ones, so `left` should be cheap
    to read twice. Null keys match nothing and are spread too.
    """
    hot = hot_keys(left, on, hot_rows)
    spread = split_keys(left, hot, on, by or left.columns)
    return spread.join(copy_keys(right, hot, on), [*on, "_sub"], how).drop("_sub")


def grid_join(
    left: DataFrame, right: DataFrame, on: list[str], by_left: list[str], by_right: list[str],
    hot_rows: int | None = None,
) -> DataFrame:
    """Inner join where a key may be hot on both sides.

    Each side's hot keys are split, and the other side copied to the pieces, so
    the pairs of one key are shared out over a grid of tasks.
    """
    hot_left, hot_right = hot_keys(left, on, hot_rows), hot_keys(right, on, hot_rows)
    rows = copy_keys(split_keys(left, hot_left, on, by_left, "_row"), hot_right, on, "_column")
    columns = copy_keys(split_keys(right, hot_right, on, by_right, "_column"), hot_left, on, "_row")
    return rows.join(columns, [*on, "_row", "_column"]).drop("_row", "_column")


def with_position(df: DataFrame, keys: list[str], name: str = "position") -> DataFrame:
    """Number all rows from 0 in the order of unique keys.

    A global `row_number` would sort everything in one task. Here the rows are
    range-partitioned and each partition numbered as it is written out, which
    fixes the ranges; the counts of earlier partitions are then added.
    """
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(
        ranged.withColumn("_part", F.spark_partition_id())
        .withColumn("_inside", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "positions",
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before")
    )
