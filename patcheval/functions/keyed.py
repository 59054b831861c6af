"""Keyed helpers that stay safe when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys, order) -> DataFrame:
    """One whole row per key: the first in ``order``. Spark puts a per-task limit of one row per
    key in front of the shuffle (WindowGroupLimit), so a hot key sends one row per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def last_per_key(df: DataFrame, keys, order) -> DataFrame:
    return first_per_key(df, keys, [_flip(o) for o in order])


def _flip(order) -> Column:
    col = F.col(order) if isinstance(order, str) else order
    return col.desc_nulls_last()


def competition_rank(df: DataFrame, value: str, out: str = "rank", parts=(), buckets: int = 1024) -> DataFrame:
    """Exact 1,1,3-style rank by ``value`` (in [0, 1], highest first), optionally inside ``parts``.

    Rows are first counted per distinct value, the distinct values ranked inside fixed value
    ranges, and ranges joined by their running totals: no task sees more than one range of
    distinct values, or the at most ``buckets`` totals of one part.
    """
    parts = list(parts)
    bucket = F.floor(F.col(value) * buckets).cast("int")
    counts = df.groupBy(*parts, value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", bucket)
    inner = Window.partitionBy(*parts, "_b").orderBy(F.col(value).desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    outer = Window.partitionBy(*parts).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        counts.groupBy(*parts, "_b")
        .agg(F.sum("_n").alias("_total"))
        .withColumn("_above", F.coalesce(F.sum("_total").over(outer), F.lit(0)))
        .drop("_total")
    )
    ranks = (
        counts.withColumn("_within", F.coalesce(F.sum("_n").over(inner), F.lit(0)))
        .join(totals, [*parts, "_b"])
        .select(*parts, value, (F.col("_above") + F.col("_within") + 1).cast("bigint").alias(out))
    )
    return df.join(ranks, [*parts, value])


def salted_semi(
    df: DataFrame, wanted: DataFrame, keys, spread: str, salts: int = 32, how: str = "left_semi"
) -> DataFrame:
    """Rows of ``df`` whose ``keys`` occur (or with left_anti do not occur) in ``wanted``. The rows of one key are spread over
    ``salts`` tasks by the value of ``spread``; ``wanted`` is repeated once per salt."""
    keys = list(keys)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    every = F.explode_outer(F.sequence(F.lit(0), F.lit(salts - 1)))
    spread_keys = wanted.select(*keys).distinct().withColumn("_salt", every)
    return salted.join(spread_keys, [*keys, "_salt"], how).drop("_salt")
