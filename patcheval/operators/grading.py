"""The three grading rules. They disagree by design and are never mixed.

named   full / partial / no, from ``match_expected`` over named test results
files   resolved flag and two scores, exact ``file::name`` lookups
counts  resolved / unresolved / error, from counts alone
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patcheval import constants as C
from patcheval.operators.named_logs import KEYS

F2P, P2P = "fail_to_pass", "pass_to_pass"


def expected_tests(instances: DataFrame, keys=("instance_id",), runs: DataFrame | None = None) -> DataFrame:
    """(keys, category, ord, name) from the two array columns of an instance table. With ``runs``
    (rows of run_id and instance_id) the expectation is repeated for every run of an instance."""
    def listed(category):
        names = F.coalesce(F.col(category), F.array().cast("array<string>"))
        return F.transform(
            names,
            lambda x, i: F.struct(
                F.lit(category).alias("category"), i.cast("bigint").alias("ord"), x.alias("name")
            ),
        )

    both = F.concat(listed(F2P), listed(P2P))
    rows = instances.select(*keys, both.alias("both"))
    if runs is not None:
        rows = runs.select("run_id", *keys).join(rows, list(keys))
        keys = ("run_id", *keys)
    return rows.select(*keys, F.explode(F.col("both")).alias("e")).select(*keys, "e.*")


def _rate(passed: Column, total: Column) -> Column:
    return F.when(total == 0, 1.0).otherwise(F.try_divide(passed, total))


def grade_named(
    evaluated: DataFrame,
    matches: DataFrame,
    summaries: DataFrame | None = None,
    keys=KEYS,
    error: str | None = None,
    duration: str | None = None,
) -> DataFrame:
    """One row per evaluated (keys): counts, rates and ``resolved`` full|partial|no.

    ``evaluated`` lists what was run, so instances without expected tests are graded too. A
    non-empty ``error`` column short-circuits to 'no', zero passed, totals kept, no duration.
    ``summaries`` adds the parse warnings of the log as the error text.
    """
    keys = list(keys)
    passed = F.col("outcome") == C.PASSED

    def count_of(category, condition=None):
        of_category = F.col("category") == category
        return F.count_if(of_category if condition is None else of_category & condition)

    counted = matches.groupBy(*keys).agg(
        *[count_of(c).alias(f"{c}_total") for c in (F2P, P2P)],
        *[count_of(c, passed).alias(f"{c}_passed") for c in (F2P, P2P)],
        *[count_of(c, F.col("outcome") == "missing").alias(f"{c}_missing") for c in (F2P, P2P)],
    )
    rows = evaluated.select(
        *keys,
        (F.col(error) if error else F.lit(None).cast("string")).alias("_error"),
        (F.col(duration) if duration else F.lit(None).cast("double")).alias("_duration"),
    ).join(counted, keys, "left")
    if summaries is not None:
        warnings = F.when(
            F.size("parse_errors") > 0,
            F.concat(F.lit("Parse warnings: "), F.array_join("parse_errors", "; ")),
        )
        rows = rows.join(summaries.select(*keys, warnings.alias("_warning")), keys, "left")
    else:
        rows = rows.withColumn("_warning", F.lit(None).cast("string"))
    failed_run = F.coalesce(F.length("_error") > 0, F.lit(False))
    zero = F.lit(0).cast("bigint")
    for c in (F2P, P2P):
        rows = rows.withColumn(f"{c}_total", F.coalesce(f"{c}_total", zero)).withColumn(
            f"{c}_passed", F.when(failed_run, zero).otherwise(F.coalesce(f"{c}_passed", zero))
        ).withColumn(f"{c}_missing", F.coalesce(f"{c}_missing", zero))
    f_total, f_passed = F.col(f"{F2P}_total"), F.col(f"{F2P}_passed")
    p_total, p_passed = F.col(f"{P2P}_total"), F.col(f"{P2P}_passed")
    resolved = (
        F.when(failed_run, C.NO)
        .when(p_passed < p_total, C.NO)
        .when(f_total == 0, C.FULL)
        .when(f_passed == f_total, C.FULL)
        .when(f_passed > 0, C.PARTIAL)
        .otherwise(C.NO)
    )
    return rows.select(
        *keys, resolved.alias("resolved"),
        f_passed.alias("fail_to_pass_passed"), f_total.alias("fail_to_pass_total"),
        p_passed.alias("pass_to_pass_passed"), p_total.alias("pass_to_pass_total"),
        F.col(f"{F2P}_missing").alias("fail_to_pass_missing"),
        F.col(f"{P2P}_missing").alias("pass_to_pass_missing"),
        _rate(f_passed, f_total).alias("fail_to_pass_rate"),
        _rate(p_passed, p_total).alias("pass_to_pass_rate"),
        F.when(~failed_run, F.col("_duration")).alias("total_duration_ms"),
        F.when(failed_run, F.col("_error")).otherwise(F.col("_warning")).alias("error"),
    )


def evaluation_records(grades: DataFrame, details: DataFrame, failed: DataFrame | None = None, keys=KEYS) -> DataFrame:
    """The grades with ``fail_to_pass_results`` and ``pass_to_pass_results``: arrays of (name, status, duration_ms, error_message) in the
    order in which tests were expected, so that places in them are dense. Instances of ``failed`` (keys), whose run broke off, have
    empty ones. An array holds no more than the list of expected tests that it comes from, which was one cell."""
    keys = list(keys)
    result = F.struct("name", "status", "duration_ms", "error_message")

    def listed(category):
        rows = F.sort_array(F.collect_list(F.when(F.col("category") == category, F.struct("ord", result.alias("r")))))
        return F.transform(rows, lambda x: x["r"]).alias(f"{category}_results")

    if failed is not None:
        details = details.join(failed.select(*keys).distinct(), keys, "left_anti")
    lists = details.groupBy(*keys).agg(listed(F2P), listed(P2P))
    none = F.array().cast(lists.schema[f"{F2P}_results"].dataType)
    return grades.join(lists, keys, "left").withColumns({f"{c}_results": F.coalesce(f"{c}_results", none) for c in (F2P, P2P)})


def category_results(matches: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, category, expected, passed, failed, missing, pass_rate, all_passed, any_passed)."""
    outcome = F.col("outcome")
    counted = matches.groupBy(*keys, "category").agg(
        F.count(F.lit(1)).alias("expected"),
        *[F.count_if(outcome == o).alias(o) for o in ("passed", "failed", "missing")],
    )
    return counted.select(
        *keys, "category", "expected", "passed", "failed", "missing",
        _rate(F.col("passed"), F.col("expected")).alias("pass_rate"),
        (F.col("passed") == F.col("expected")).alias("all_passed"),
        (F.col("passed") > 0).alias("any_passed"),
    )


def match_files(expected: DataFrame, test_results: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, category, name, status, correct) for each distinct expected ``file::name``. The last
    result of a name counts; a name without result is NOT_FOUND."""
    keys = list(keys)
    full_name = F.when(
        F.length("file_path") > 0, F.concat("file_path", F.lit("::"), "name")
    ).otherwise(F.col("name"))
    actual = (
        test_results.select(*keys, full_name.alias("name"), "position", "status")
        .groupBy(*keys, "name")
        .agg(F.max_by("status", "position").alias("status"))
    )
    wanted = expected.select(*keys, "category", "name").distinct()
    return wanted.join(actual, [*keys, "name"], "left").select(
        *keys, "category", "name",
        F.coalesce("status", F.lit(C.NOT_FOUND)).alias("status"),
        F.coalesce(F.col("status") == "PASS", F.lit(False)).alias("correct"),
    )


def grade_files(
    evaluated: DataFrame, matches: DataFrame, summaries: DataFrame | None = None, keys=KEYS
) -> DataFrame:
    """(keys, resolved, fail_to_pass_score, pass_to_pass_score, total_tests_run, test_pass_rate)."""
    keys = list(keys)
    correct = F.col("correct")
    counted = matches.groupBy(*keys).agg(
        *[F.count_if(F.col("category") == c).alias(f"{c}_total") for c in (F2P, P2P)],
        *[F.count_if((F.col("category") == c) & correct).alias(f"{c}_passed") for c in (F2P, P2P)],
    )
    rows = evaluated.select(*keys).join(counted, keys, "left").na.fill(0)
    if summaries is not None:
        rows = rows.join(
            summaries.select(*keys, F.col("total").alias("total_tests_run"), F.col("pass_rate").alias("test_pass_rate")),
            keys, "left",
        )
    else:
        rows = rows.withColumns(
            {"total_tests_run": F.lit(None).cast("bigint"), "test_pass_rate": F.lit(None).cast("double")}
        )
    done = [F.col(f"{c}_passed") == F.col(f"{c}_total") for c in (F2P, P2P)]
    return rows.select(
        *keys, (done[0] & done[1]).alias("resolved"),
        *[_rate(F.col(f"{c}_passed"), F.col(f"{c}_total")).alias(f"{c}_score") for c in (F2P, P2P)],
        "total_tests_run", "test_pass_rate",
    )


def count_status(passed: Column, failed: Column, error: Column) -> Column:
    """error beats counts; resolved needs at least one pass and no failure."""
    return (
        F.when(F.length(error) > 0, "error")
        .when((failed == 0) & (passed > 0), "resolved")
        .otherwise("unresolved")
    )


def grade_counts(counts: DataFrame) -> DataFrame:
    return counts.withColumn("status", count_status(F.col("passed"), F.col("failed"), F.col("error")))


def attach_predictions(
    instances: DataFrame,
    predictions: DataFrame,
    keys=("instance_id",),
    message: str = C.NO_PREDICTION,
    position: str | None = None,
) -> DataFrame:
    """Every instance with its prediction. What counts is that a prediction row exists, not what is
    in it: without one the status is 'skipped' and the message is set. Of several predictions the last by ``position``
    counts (by default the column of that name; without it the greatest patch, so that one is taken for certain)."""
    keys = list(keys)
    if position is None and "position" in predictions.columns:
        position = "position"
    order = F.struct(*[F.col(c) for c in ([position] if position else [])], F.col("patch").isNotNull(), F.col("patch"))
    given = predictions.groupBy(*keys).agg(F.max_by("patch", order).alias("patch")).withColumn("has_prediction", F.lit(True))
    has = F.coalesce("has_prediction", F.lit(False))
    return (
        instances.join(given, keys, "left")
        .withColumn("has_prediction", has)
        .withColumn("status", F.when(~has, "skipped").otherwise("pending"))
        .withColumn("error_message", F.when(~has, F.lit(message)))
    )
