"""The incremental jobs: results and logs that keep arriving as files.

The checkpoint location carries the progress, so a restarted job goes on where it stopped. Ids that
were seen are kept in state; with ``late`` the state is bounded by a watermark on the event time,
and a duplicate later than that counts as new.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from patcheval.functions.stage import remove, written
from patcheval.operators.costs import inference_stats
from patcheval.operators.count_logs import count_logs
from patcheval.operators.grading import grade_counts
from patcheval.streaming import keyed_store


def stream_files(spark: SparkSession, path: str, schema, fmt: str = "json", **options) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).format(fmt).load(path)


def unseen(stream: DataFrame, keys=("run_id", "instance_id"), ts: str | None = None, late: str | None = None) -> DataFrame:
    """The first row of each key. Without ``late`` every key is remembered."""
    if ts and late:
        return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))
    return stream.dropDuplicates(list(keys))


def append_unseen(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
    keys=("run_id", "instance_id"), fmt: str = "parquet", **unseen_options,
) -> StreamingQuery:
    """Runs ``transform`` on unseen rows and appends the result; ends when all input is read."""
    return (
        transform(unseen(stream, keys, **unseen_options))
        .writeStream.format(fmt).option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def run_inference(
    stream: DataFrame, infer: Callable[[DataFrame], DataFrame], out: str, checkpoint: str,
    keys=("run_id", "instance_id"),
) -> StreamingQuery:
    """Model calls for unseen instances. A batch is written under its own number and a repeated
    batch replaces itself, so results are kept once even if calls were made twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        infer(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        unseen(stream, keys).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def running_stats(results: DataFrame, out: str, checkpoint: str, by=("run_id",)) -> StreamingQuery:
    """Running totals per run. Spark keeps the sums as state and hands on only the runs that a batch changed; these replace
    their rows in a keyed store, whose untouched buckets stay as they are."""

    def write(batch: DataFrame, batch_id: int) -> None:
        keyed_store.upsert(batch, out, by, checkpoint, batch_id)

    return (
        inference_stats(results, by).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def running_totals(spark: SparkSession, out: str) -> DataFrame:
    """The totals after the last batch."""
    return keyed_store.current(spark, out)


def grade_logs(
    logs: DataFrame, out: str, checkpoint: str,
    grade: Callable[[DataFrame], DataFrame] | None = None, keys=("run_id", "instance_id"), buckets: int = 64,
) -> StreamingQuery:
    """Grades logs as they arrive, into a keyed store: the grade of a later batch replaces that of an earlier one,
    of several in a batch the greatest stays. Only buckets of instances that came are written anew."""
    grade = grade or (lambda batch: grade_counts(count_logs(batch)))

    def write(batch: DataFrame, batch_id: int) -> None:
        keyed_store.upsert(grade(batch), out, keys, checkpoint, batch_id, buckets=buckets)

    return (
        logs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def merged_grades(spark: SparkSession, out: str) -> DataFrame:
    """The last grade of every instance."""
    return keyed_store.current(spark, out)


def windowed_costs(results: DataFrame, ts: str = "ts", size: str = "1 hour", late: str = "10 minutes", by=("model",)) -> DataFrame:
    """An addition of this library: calls, cost and latency per model and time window. As a stream, rows that come later than
    ``late`` are lost; :func:`stream_windowed_costs` hands them on."""
    rows = results.withWatermark(ts, late) if results.isStreaming else results
    return (
        rows.groupBy(F.window(ts, size).alias("w"), *by)
        .agg(
            F.count(F.lit(1)).alias("calls"),
            F.sum("cost_usd").alias("cost_usd"),
            F.sum("latency_seconds").alias("latency_seconds"),
        )
        .select(F.col("w.start").alias("window_start"), *by, "calls", "cost_usd", "latency_seconds")
    )


def _added(by):
    """Old and new rows of a window added up."""

    def combine(rows: DataFrame) -> DataFrame:
        sums = [F.sum(c).alias(c) for c in ("calls", "cost_usd", "latency_seconds")]
        return rows.groupBy("window_start", *by).agg(*sums)

    return combine


def stream_windowed_costs(
    results: DataFrame, out: str, checkpoint: str, ts: str = "ts", size: str = "1 hour", late: str = "10 minutes", by=("model",)
) -> StreamingQuery:
    """Windows as rows arrive, and the rows that came too late for theirs: ``out/windows`` is a keyed store, ``out/late`` has the late
    rows of every batch as they came. A row is late if its window ended at least ``late`` before the greatest ``ts`` of all
    batches before its own; rows without ``ts`` are in no window and no late row, as in the batch answer.
    Windows and late rows together are the batch answer, and a repeated batch changes neither."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, store = batch.sparkSession, f"{out}/windows"
        before = keyed_store.newest(spark, store)
        if keyed_store.is_done(before, checkpoint, batch_id):
            return
        seen = before.seen if before else None
        at = F.col(ts).cast("timestamp")
        rows, folder = written(batch, "arrived")
        newest = rows.agg(F.max(F.unix_micros(at))).first()[0]
        is_late = F.lit(False)
        if seen is not None:
            is_late = F.window(at, size)["end"] <= F.timestamp_micros(F.lit(seen)) - F.expr(f"INTERVAL {late}")
        marked = rows.where(F.col(ts).isNotNull()).withColumn("_late", is_late)
        # under the number the store is about to commit: a batch that is repeated replaces what it wrote
        number = before.number + 1 if before else 1
        marked.where("_late").drop("_late").write.mode("overwrite").parquet(f"{out}/late/version={number}")
        sums = windowed_costs(marked.where("NOT _late"), ts, size, late, by)
        moments = [m for m in (seen, newest) if m is not None]
        keyed_store.upsert(
            sums.withColumn("calls", F.col("calls").cast("bigint")), store, ("window_start", *by), checkpoint, batch_id,
            combine=_added(by), seen=max(moments, default=None),
        )
        remove(spark, folder)

    return (
        results.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def late_rows(spark: SparkSession, out: str) -> DataFrame:
    """Rows that came too late for their window, with the number of the version they came before."""
    last = keyed_store.newest(spark, f"{out}/windows")
    return spark.read.parquet(f"{out}/late").where(F.col("version") <= (last.number if last else 0))
