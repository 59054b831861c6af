"""Logs whose tests sit under test-file headers, read into test-result rows and a summary row.

A pure projection: each log is cut before every file header, each section before every result
line, and every piece yields at most one row. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patcheval.functions import text as tx
from patcheval.operators.named_logs import KEYS

WS, IN_WS = tx.WS, tx.INLINE_WS

# fixed values: the shapes of header, result and summary lines
HEADER = rf"test/[^{r"\s\x1c-\x1f"}:]+\.test\.ts:$"
HEADER_NAME = rf"(?dU)^(test/[^{r"\s\x1c-\x1f"}:]+\.test\.ts):(?:\n|\z)"
# a name starts with a character that is not blank, and its end is found by the dots, as they are told from most characters
# at once; the blanks between come with the name
RESULT = rf"{IN_WS}++(?=\S)(.+?)\.\.\.(?<={IN_WS}\.\.\.){IN_WS}+\[(PASS|FAIL|SKIP)\]{IN_WS}+\((\d+\.?\d*)ms\)"
ERROR = rf"(?mdU)^{IN_WS}+Error:{IN_WS}+(.+)$"
COUNTS = rf"(?mdU)^{IN_WS}*(\d+){WS}+pass{WS}*\n{WS}*(\d+){WS}+fail{WS}*\n{WS}*(\d+){WS}+skip"
EXPECTS = rf"(?dU)(\d+){WS}+expect\(\){WS}+calls"
RAN = rf"(?dU)Ran{WS}+\d+{WS}+tests?{WS}+in{WS}+(\d+\.?\d*)ms"


def file_test_results(logs: DataFrame, keys=KEYS, output: str = "output") -> DataFrame:
    """(keys, position, file_path, name, status PASS|FAIL|SKIP, duration_ms, error_message)."""
    section, piece, parts = F.col("section_text"), F.col("piece"), F.col("parts")
    # name, status and duration of a result line are put behind a mark in the pass that finds it
    results = F.regexp_replace(tx.escaped(section), f"(?mdU)^{RESULT}.*+", tx.CUT + "$1" + tx.PART + "$2" + tx.PART + "$3")
    error = F.nullif(F.regexp_extract(tx.unescaped(tx.after_first_line(piece)), ERROR, 1), F.lit(""))
    # a marked text is a column of its own below each explode, which would compute it once for every place where it is used
    return (
        logs.select(*keys, tx.marked_before(F.col(output), HEADER).alias("marked"))
        .select(*keys, F.posexplode_outer(tx.cut(F.col("marked"))).alias("section", "section_text"))
        .select(
            *keys, "section",
            F.nullif(F.regexp_extract(section, HEADER_NAME, 1), F.lit("")).alias("file_path"), results.alias("marked"),
        )
        .select(*keys, "section", "file_path", F.posexplode_outer(F.split("marked", tx.CUT, -1)).alias("no", "piece"))
        .where("no > 0")  # what stands above the first result is no result
        .select(*keys, "section", "file_path", "no", "piece", F.split(F.substring_index(piece, "\n", 1), tx.PART, -1).alias("parts"))
        .select(
            *keys,
            (F.col("section").cast("bigint") * (1 << 31) + F.col("no")).alias("position"),
            "file_path",
            tx.strip(tx.unescaped(F.get(parts, F.lit(0)))).alias("name"),
            F.get(parts, F.lit(1)).alias("status"),
            F.get(parts, F.lit(2)).cast("double").alias("duration_ms"),
            F.when(F.get(parts, F.lit(1)) == "FAIL", error).alias("error_message"),
        )
    )


def file_log_summary(logs: DataFrame, keys=KEYS, output: str = "output") -> DataFrame:
    """(keys, passed, failed, skipped, total, pass_rate, expect_calls, total_duration_ms) as the
    log itself states them; 0 where it does not."""
    log = F.col(output)

    def number(text, pattern, group, kind="bigint"):
        return F.coalesce(F.nullif(F.regexp_extract(text, pattern, group), F.lit("")).try_cast(kind), F.lit(0).cast(kind))

    # the log is searched once for its three counts, which are then taken from what was found
    found = F.col("counts")
    return (
        logs.select(
            *keys,
            F.regexp_extract(log, COUNTS, 0).alias("counts"),
            number(log, EXPECTS, 1).alias("expect_calls"),
            number(log, RAN, 1, "double").alias("total_duration_ms"),
        )
        .select(
            *keys,
            number(found, COUNTS, 1).alias("passed"),
            number(found, COUNTS, 2).alias("failed"),
            number(found, COUNTS, 3).alias("skipped"),
            "expect_calls", "total_duration_ms",
        )
        .withColumn("total", F.col("passed") + F.col("failed") + F.col("skipped"))
        .withColumn(
            "pass_rate",
            F.when(F.col("total") == 0, 0.0).otherwise(F.try_divide(F.col("passed"), F.col("total"))),
        )
    )
