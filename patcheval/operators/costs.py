"""Token counts, text budgets, prices and running totals of model calls."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patcheval import constants as C


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("bigint")


def count_tokens(
    df: DataFrame, column: str, out: str = "tokens", encoder: Callable[[], Callable] | None = None
) -> DataFrame:
    """Adds the token count of a text column. ``encoder`` makes a function text -> tokens, once per
    batch stream on the executors; without it the count is estimated in the JVM."""
    if encoder is None:
        return df.withColumn(out, estimated_tokens(F.col(column)))

    @F.pandas_udf("bigint")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for batch in batches:
            yield batch.fillna("").map(lambda t: len(encode(t))).astype("int64")

    return df.withColumn(out, counted(F.col(column)))


def fit_to_budget(df: DataFrame, column: str, max_tokens: int, out: str | None = None) -> DataFrame:
    """Texts longer than four characters per token are cut there and end in '...'."""
    limit = 4 * max_tokens
    text = F.col(column)
    cut = F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)
    return df.withColumn(out or column, cut)


def price_of(model: Column, prices=C.PRICES, match: str = "first") -> Column:
    """struct(input, output) USD per 1000 tokens: the first table entry whose key occurs in the
    model name, or with ``match='longest'`` the longest such key; else the default price."""
    if match not in ("first", "longest"):
        raise ValueError("match must be 'first' or 'longest'")
    rows = prices if match == "first" else sorted(prices, key=lambda p: -len(p[0]))
    name = F.lower(model)
    out = F
    for key, price_in, price_out in rows:
        price = F.struct(F.lit(price_in).alias("input"), F.lit(price_out).alias("output"))
        out = out.when(F.contains(name, F.lit(key)), price)
    return out.otherwise(F.struct(*[F.lit(p).alias(n) for p, n in zip(C.DEFAULT_PRICE, ("input", "output"))]))


def cost_results(results: DataFrame, match: str = "first", out: str = "cost_usd") -> DataFrame:
    """Adds the cost of each call from model, input_tokens and output_tokens. The price table is a
    CASE over its eleven entries: no join, no shuffle."""
    price = price_of(F.col("model"), match=match)
    cost = F.col("input_tokens") / 1000 * price["input"] + F.col("output_tokens") / 1000 * price["output"]
    return results.withColumn(out, cost)


def cost_by_model(costed: DataFrame, by=("model",)) -> DataFrame:
    return costed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").cast("bigint").alias("input_tokens"),
        F.sum("output_tokens").cast("bigint").alias("output_tokens"),
        F.sum("cost_usd").alias("cost_usd"),
    )


def inference_stats(results: DataFrame, by=("run_id",)) -> DataFrame:
    """Eight additive counters; works on a batch and on a stream."""
    success = F.coalesce("success", F.lit(False))
    return results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_instances"),
        F.count_if(success).alias("successful"),
        F.count_if(~success).alias("failed"),
        F.sum("input_tokens").cast("bigint").alias("total_input_tokens"),
        F.sum("output_tokens").cast("bigint").alias("total_output_tokens"),
        F.sum("cost_usd").alias("total_cost_usd"),
        F.sum("latency_seconds").alias("total_latency_seconds"),
        F.count_if(F.length("extracted_patch") > 0).alias("patches_extracted"),
    )
