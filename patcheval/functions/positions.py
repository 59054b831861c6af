"""Dense row numbers over a total order, without a task that sees a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patcheval.functions.stage import staged


def positions(df: DataFrame, keys: list[str], order: list[str | Column], ranges: int | None = None, out: str = "position") -> DataFrame:
    """``df`` with ``out``, a row's place from 0 on among the rows of its ``keys`` in the order of ``order`` (nulls first unless
    it says otherwise), and ``group_size``, how many these are.

    Rows are sorted in ranges of the whole order, so a group of any size lies in as many ranges as it needs; rows that tie in all of it
    are told apart by a row number, so they spread, too. What is summed up is a row per range and group in it. Without
    keys all rows are one group. Ranges are ``ranges`` or ``spark.sql.shuffle.partitions``.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = [*[F.col(f"`{k}`").asc_nulls_first() for k in keys], *[F.col(o) if isinstance(o, str) else o for o in order]]
    numbered = df.withColumn("_tie", F.monotonically_increasing_id())
    by_range = numbered.repartitionByRange(ranges, *wanted, "_tie").sortWithinPartitions(*wanted, "_tie")
    # the lower bits of this id count the rows of a partition
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = staged(by_range.withColumn("_range", F.spark_partition_id()).withColumn("_inside", inside).drop("_tie"), "ranges")
    counts = rows.groupBy("_range", *keys).agg(F.min("_inside").alias("_first"), F.count(F.lit(1)).alias("_n"))
    within = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("_n").over(within.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counts.select("_range", *keys, (before - F.col("_first")).alias("_shift"), F.sum("_n").over(within).alias("group_size"))
    same = F.col("a._range") == F.col("b._range")
    for k in keys:
        same = same & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    return rows.alias("a").join(parts.alias("b"), same).select(
        *[F.col(f"a.`{c}`") for c in df.columns], (F.col("_inside") + F.col("_shift")).alias(out), "group_size"
    )
