"""Logs with tests under test-file headers that are larger than a cell: rows of lines instead of one text.

A log is dealt out in ranges of lines. What is said of a range alone (headers, results since the last of them, the block that
is still open at its end) goes into one row; sums over the rows of the ranges of a log carry it into the ranges that follow.
So a log of any size is read by as many tasks as it has ranges. Only lines that say something are
shuffled, and of the others only that they are not blank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patcheval.functions import text as tx
from patcheval.functions.stage import staged
from patcheval.operators.file_logs import ERROR, EXPECTS, HEADER_NAME, RAN, RESULT, IN_WS, WS
from patcheval.operators.named_logs import KEYS

#: The three lines of a summary, one number each.
COUNT_LINES = {"passed": rf"(?dU)^{IN_WS}*(\d+){WS}+pass{WS}*$", "failed": rf"(?dU)^{WS}*(\d+){WS}+fail{WS}*$", "skipped": rf"(?dU)^{WS}*(\d+){WS}+skip"}


def lines_of_cells(logs: DataFrame, keys=KEYS, output: str = "output", size: int = 100_000) -> DataFrame:
    """(keys, range, row, line) of logs that are cells, in ranges of ``size`` lines."""
    lines = logs.select(*keys, F.posexplode_outer(tx.lines_of(F.col(output))).alias("row", "line"))
    return lines.select(*keys, F.floor(F.col("row") / size).alias("range"), "row", "line")


def read_log_lines(spark: SparkSession, path, run_id: str | None = None) -> DataFrame:
    """(run_id, instance_id, range, row, line) of log files, one per instance, which Spark splits. The lines of ``<id>.stderr`` come
    behind those of ``<id>.stdout``. Without ``run_id`` the name of the directory is taken. A file without a line has no rows."""
    file = F.col("_metadata.file_path")
    return spark.read.text(path, lineSep="\n").select(
        (F.lit(run_id) if run_id else F.regexp_extract(file, r"([^/]+)/[^/]+$", 1)).alias("run_id"),
        F.regexp_extract(file, r"([^/]+?)(?:\.(?:log|txt|stdout|stderr))?$", 1).alias("instance_id"),
        F.struct(file.endswith(".stderr").alias("err"), F.col("_metadata.file_block_start").alias("start")).alias("range"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("line"),
    )


def _carried(summaries: DataFrame, keys) -> DataFrame:
    """Per range what the ranges before it leave behind: headers so far, the last of them, the results since, and the last header
    or result."""
    order = Window.partitionBy(*keys).orderBy("range")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    segment = F.sum((F.col("headers") > 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    since = F.sum("tail").over(Window.partitionBy(*keys, "_segment").orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    return (
        summaries.withColumn("_segment", segment).withColumn("_since", since).select(
            *keys, "range", F.coalesce(F.sum("headers").over(before), F.lit(0)).alias("headers0"), F.last("file", ignorenulls=True).over(before).alias("file0"),
            F.coalesce(F.lag("_since").over(order), F.lit(0)).alias("since0"), F.last("owner", ignorenulls=True).over(before).alias("owner0"),
        )
    )


def file_test_results(lines: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, position, file_path, name, status PASS|FAIL|SKIP, duration_ms, error_message), as ``file_logs.file_test_results`` gives of the
    lines of each log put together. ``lines`` has (keys, range, row, line): ranges are in order, and rows are within a range."""
    keys = list(keys)
    line = F.col("line")
    header = F.nullif(F.regexp_extract(line, HEADER_NAME, 1), F.lit(""))
    is_result = line.rlike(f"(?dU)^{RESULT}")
    error = F.nullif(F.regexp_extract(line, ERROR, 1), F.lit(""))
    kind = F.when(header.isNotNull(), "header").when(is_result, "result").when(error.isNotNull(), "error")
    events = lines.select(*keys, "range", "row", "line", kind.alias("kind")).where("kind IS NOT NULL")
    is_header, is_result = F.col("kind") == "header", F.col("kind") == "result"
    so_far = Window.partitionBy(*keys, "range").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    in_section = Window.partitionBy(*keys, "range", "headers").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.when(F.col("kind") != "error", F.struct("range", "row", "kind"))
    marked = staged(
        events.withColumn("file", F.last(F.when(is_header, header), ignorenulls=True).over(so_far))
        .withColumn("headers", F.sum(is_header.cast("long")).over(so_far)).withColumn("owner", F.last(owner, ignorenulls=True).over(so_far))
        .withColumn("since", F.sum(is_result.cast("long")).over(in_section)),
        "log-events",
    )
    summaries = marked.groupBy(*keys, "range").agg(
        F.max("headers").alias("headers"), F.max_by("file", "row").alias("file"), F.max_by("since", "row").alias("tail"), F.max_by("owner", "row").alias("owner")
    )
    rows = marked.join(_carried(summaries, keys), [*keys, "range"])
    # the first error line of each result, wherever the range of the result ends
    owned = rows.where("kind = 'error'").withColumn("owner", F.coalesce("owner", "owner0")).where("owner.kind = 'result'")
    errors = owned.groupBy(*keys, F.col("owner.range").alias("range"), F.col("owner.row").alias("row")).agg(
        F.min_by(error, F.struct("range", "row")).alias("error_message")
    )
    parts = tx.cut(F.regexp_replace(tx.escaped(line), f"(?dU)^{RESULT}.*$", "$1" + tx.CUT + "$2" + tx.CUT + "$3"))
    results = rows.where(is_result).select(
        *keys, "range", "row",
        ((F.col("headers") + F.col("headers0")) * (1 << 31) + F.col("since") + F.when(F.col("headers") == 0, F.col("since0")).otherwise(0)).alias("position"),
        F.coalesce("file", "file0").alias("file_path"), parts.alias("parts"),
    )
    part = lambda i: F.get("parts", F.lit(i))
    return results.join(errors, [*keys, "range", "row"], "left").select(
        *keys, "position", "file_path", tx.strip(part(0)).alias("name"), part(1).alias("status"), part(2).cast("double").alias("duration_ms"),
        F.when(part(1) == "FAIL", F.col("error_message")).alias("error_message"),
    )


def file_log_summary(lines: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, passed, failed, skipped, total, pass_rate, expect_calls, total_duration_ms), as ``file_logs.file_log_summary`` gives of the
    lines put together; a number and the word behind it must be on one line. ``lines`` as in :func:`file_test_results`."""
    keys = list(keys)
    line = F.col("line")

    def number(pattern, kind="bigint"):
        found = F.coalesce(F.regexp_extract(line, pattern, 1).try_cast(kind), F.lit(0).cast(kind))
        return F.when(line.rlike(pattern), found)

    # lines that are not blank are numbered, so that neighbours are known in whichever range they are
    said = staged(
        lines.where(F.length(tx.strip(line)) > 0).select(*keys, "range", "row", *[number(p).alias(c) for c, p in COUNT_LINES.items()]), "log-lines"
    )
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    bases = said.groupBy(*keys, "range").agg(F.count(F.lit(1)).alias("n")).select(*keys, "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy(*keys, "range").orderBy("row"))
    some = said.withColumn("_i", inside).where(F.coalesce(*COUNT_LINES).isNotNull()).join(bases, [*keys, "range"]).withColumn("n", F.col("base") + F.col("_i"))

    def lines_with(c, back):
        return some.where(F.col(c).isNotNull()).select(*keys, (F.col("n") - back).alias("n"), c)

    found = lines_with("passed", 0).join(lines_with("failed", 1), [*keys, "n"]).join(lines_with("skipped", 2), [*keys, "n"])
    counts = found.groupBy(*keys).agg(F.min(F.struct("n", *COUNT_LINES)).alias("c")).select(*keys, "c.*")
    first = F.struct("range", "row")
    logs = lines.groupBy(*keys).agg(
        F.min_by(number(EXPECTS), F.when(line.rlike(EXPECTS), first)).alias("expect_calls"),
        F.min_by(number(RAN, "double"), F.when(line.rlike(RAN), first)).alias("total_duration_ms"),
    )
    zero = {c: F.coalesce(c, F.lit(0).cast("bigint")) for c in (*COUNT_LINES, "expect_calls")}
    total = F.col("passed") + F.col("failed") + F.col("skipped")
    rows = logs.join(counts, keys, "left").withColumns(zero).withColumn("total", total)
    rate = F.when(F.col("total") == 0, 0.0).otherwise(F.try_divide("passed", "total"))
    return rows.select(
        *keys, "passed", "failed", "skipped", "total", rate.alias("pass_rate"), "expect_calls", F.coalesce("total_duration_ms", F.lit(0.0)).alias("total_duration_ms")
    )
