"""Exact histogram of encoded lengths, and what its sums say about every context limit."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from patcheval.functions.stage import staged
from patcheval.llm.common import text_of, tokenizer_file
from patcheval.llm.word_cache import word_encoder

#: Lengths that one task sums up.
RANGE = 1024


def _measure(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        wide = encoder.dtype.itemsize
        for batch in batches:
            for some in encoder.arrays(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(pc.binary_length(some).to_numpy() // wide, pa.int64())], ["n_tokens"])

    return run


def length_histogram(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(n_tokens, n_docs): how many rows have a text of so many ids. Null and empty texts have 0; an empty table has no rows.
    Only lengths leave the task that encodes, added up there before they are shuffled. The histogram is a written
    table, so that texts are encoded once however often it is read."""
    tokenizer = tokenizer or tokenizer_file("byte_bpe_50k.json")
    counted = (
        docs.select(text_of().alias("text")).mapInArrow(_measure(tokenizer), "n_tokens long").groupBy("n_tokens")
        .agg(F.count(F.lit(1)).alias("n_docs"))
    )
    return staged(counted, "lengths")


def limit_table(histogram: DataFrame) -> DataFrame:
    """A row for each length L of the histogram, as a context limit:

    n_docs with this length, docs_up_to (length <= L), docs_over, tokens_up_to (all ids of documents that fit),
    kept_tokens (ids left when every document is cut at L), lost_tokens, and quantile (share of documents
    that fit: L is the exact quantile of every share above that of the row before). Between two lengths,
    kept_tokens grows by docs_over for each id, so the rows answer every limit (:func:`at_limits`).

    Sums run over ranges of ``RANGE`` lengths, then over the ranges: no task sees all lengths.
    """
    h = histogram.withColumn("_b", F.floor(F.col("n_tokens") / RANGE)).withColumn("_t", F.col("n_tokens") * F.col("n_docs"))
    up = Window.partitionBy("_b").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    ranges = (
        h.groupBy("_b").agg(F.sum("n_docs").alias("_rd"), F.sum("_t").alias("_rt"))
        .select(
            "_b", F.coalesce(F.sum("_rd").over(before), F.lit(0)).alias("_d0"), F.coalesce(F.sum("_rt").over(before), F.lit(0)).alias("_t0"),
            F.sum("_rd").over(every).alias("_all"), F.sum("_rt").over(every).alias("_allt"),
        )
    )
    s = (
        h.withColumn("_d", F.sum("n_docs").over(up)).withColumn("_s", F.sum("_t").over(up)).join(ranges, "_b")
        .withColumn("docs_up_to", F.col("_d") + F.col("_d0")).withColumn("tokens_up_to", F.col("_s") + F.col("_t0"))
        .withColumn("docs_over", F.col("_all") - F.col("docs_up_to"))
    )
    kept = F.col("tokens_up_to") + F.col("docs_over") * F.col("n_tokens")
    return s.select(
        "n_tokens", "n_docs", "docs_up_to", "docs_over", "tokens_up_to", kept.alias("kept_tokens"),
        (F.col("_allt") - kept).alias("lost_tokens"), (F.col("docs_up_to") / F.col("_all")).alias("quantile"),
    )


def at_limits(limits_table: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, kept_tokens, docs_over) for any limits >= 0, from :func:`limit_table` alone."""
    spark = limits_table.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    ends = limits_table.select("n_tokens", "docs_over", "tokens_up_to", (F.col("docs_over") + F.col("docs_up_to")).alias("_all"))
    # the last length that fits, for each limit: one pass, a row per limit and task is shuffled
    each = ends.withColumn("context_limit", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])))
    best = (
        each.groupBy("context_limit").agg(
            F.max(F.when(F.col("n_tokens") <= F.col("context_limit"), F.struct("n_tokens", "docs_over", "tokens_up_to"))).alias("_r"),
            F.max("_all").alias("_all"),
        )
    )
    over = F.coalesce(F.col("_r.docs_over"), F.col("_all"), F.lit(0))
    return wanted.join(best, "context_limit", "left").select(
        "context_limit", (F.coalesce(F.col("_r.tokens_up_to"), F.lit(0)) + over * F.col("context_limit")).alias("kept_tokens"), over.alias("docs_over")
    )
