"""Whole evaluation jobs, composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patcheval.functions import text as tx
from patcheval.functions.stage import staged
from patcheval.operators import count_logs as counts
from patcheval.operators import file_logs, grading, matching, named_logs

RUN_KEYS = ("run_id", "instance_id")


def evaluate_counts(
    instances: DataFrame,
    predictions: DataFrame,
    logs: DataFrame,
    ids: DataFrame | None = None,
    error: str | None = None,
    duration: str | None = None,
    output_limit: int | None = None,
) -> DataFrame:
    """Evaluations by the counts rule: (run_id, instance_id, status, patch_applied, passed, failed,
    skipped, total, duration, error_message, output).

    ``instances`` has a row per run and instance. Without a prediction the status is skipped; a
    prediction without a log has run nothing and is unresolved. ``output_limit`` cuts the kept log
    before it is joined; then call ``report_instances`` with ``max_output_length=None``.
    """
    if ids is not None:
        instances = instances.join(ids.select("instance_id").distinct(), "instance_id", "left_semi")
    keys = list(RUN_KEYS)
    graded = grading.attach_predictions(instances.select(*keys), predictions, keys)
    # counting is a projection of the log, so it comes before the join: numbers are shuffled, not
    # logs, unless the log itself is asked for
    log = F.col("output") if output_limit is None else tx.truncate_log(F.col("output"), output_limit)
    shown = logs.withColumn("_shown", log)
    kept = ["_shown", *([duration] if duration else [])]
    counted = counts.count_logs(shown, (*keys, *kept), "output", error).withColumn(
        "_status", grading.count_status(F.col("passed"), F.col("failed"), F.col("error"))
    )
    rows = graded.join(counted, keys, "left")
    skipped = ~F.col("has_prediction")

    def unless_skipped(name):
        return F.when(skipped, F.lit(0)).otherwise(F.coalesce(name, F.lit(0))).cast("bigint").alias(name)

    lasted = F.coalesce(F.col(duration), F.lit(0.0)) if duration else F.lit(0.0)
    return rows.select(
        *keys,
        F.when(skipped, "skipped").otherwise(F.coalesce("_status", F.lit("unresolved"))).alias("status"),
        F.col("has_prediction").alias("patch_applied"),
        *[unless_skipped(c) for c in ("passed", "failed", "skipped", "total")],
        F.when(skipped, 0.0).otherwise(lasted).cast("double").alias("duration"),
        F.coalesce("error_message", "error").alias("error_message"),
        F.when(~skipped, F.col("_shown")).alias("output"),
    )


def evaluate_named(
    expected: DataFrame, logs: DataFrame, keys=RUN_KEYS, error: str | None = None, tiers=matching.TIERS, duration: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(grades, detail rows) by the named rule, from expected tests and logs."""
    # logs are the big input: they are read once, for the results and the summaries
    tests = staged(named_logs.log_tests(logs, keys), "log-tests")
    results = named_logs.named_test_results(logs, keys, tests=tests)
    summaries = named_logs.named_log_summary(logs, keys, tests=tests)
    matches = matching.match_expected(expected, results, keys, tiers=tiers)
    grades = grading.grade_named(logs, matches, summaries, keys, error, duration)
    return grades, matching.detail_results(matches, results, keys)


def evaluate_files(expected: DataFrame, logs: DataFrame, keys=RUN_KEYS) -> tuple[DataFrame, DataFrame]:
    """(grades, log summaries) by the file-scoped rule, from expected tests and logs. A log has one summary row, which also
    says what was run, so logs are read once for it and once for their results."""
    results = file_logs.file_test_results(logs, keys)
    summaries = staged(file_logs.file_log_summary(logs, keys), "log-summaries")
    matches = grading.match_files(expected, results, keys)
    return grading.grade_files(summaries, matches, summaries, keys), summaries


def files_as_evaluations(grades: DataFrame, summaries: DataFrame, keys=RUN_KEYS) -> DataFrame:
    """File-scoped grades as evaluations a run report takes."""
    status = F.when(F.col("resolved"), "resolved").otherwise("unresolved")
    facts = summaries.select(*keys, "passed", "failed", "skipped", "total", (F.col("total_duration_ms") / 1000).alias("duration"))
    return grades.select(*keys, status.alias("status")).join(facts, list(keys))
