"""Run reports, run comparison, breakdowns, leaderboards, attempts and their text lines.

Everything is an aggregation with map-side merging or a join on a unique key. A report stays two
tables (one row per run, one row per instance); text is one row per line, never one cell per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patcheval import constants as C
from patcheval.functions import text as tx
from patcheval.functions.keyed import competition_rank, last_per_key
from patcheval.functions.positions import positions
from patcheval.functions.stage import staged


def report_instances(
    evaluations: DataFrame, include_test_output: bool = True, max_output_length: int | None = 10000
) -> DataFrame:
    """Instance rows of a report. Needs (run_id, instance_id, status) and fills in the rest."""
    have = set(evaluations.columns)

    def column(name, kind, default=None):
        value = F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
        return value if default is None else F.coalesce(value, F.lit(default).cast(kind))

    log = column("output", "string")
    shown = F.when(F.length(log) > 0, log)
    if max_output_length is not None:
        shown = tx.truncate_log(shown, max_output_length)
    return evaluations.select(
        "run_id", "instance_id", "status",
        column("patch_applied", "boolean", False).alias("patch_applied"),
        *[column(c, "bigint", 0).alias(f"tests_{c}") for c in ("passed", "failed", "skipped", "total")],
        column("duration", "double", 0.0).alias("duration"),
        column("error_message", "string").alias("error_message"),
        (shown if include_test_output else F.lit(None).cast("string")).alias("test_output"),
    )


def report_summary(evaluations: DataFrame, by=("run_id",)) -> DataFrame:
    """One row per run. The resolved rate leaves skipped instances out, the average duration does not."""
    status = F.col("status")
    total, skipped = F.col("total"), F.col("skipped")
    return (
        evaluations.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(status == "resolved").alias("resolved"),
            F.count_if(status == "unresolved").alias("unresolved"),
            F.count_if(status == "error").alias("errors"),
            F.count_if(status == "skipped").alias("skipped"),
            F.coalesce(F.sum("duration"), F.lit(0.0)).alias("total_duration"),
        )
        .withColumn("resolved_rate", F.coalesce(F.try_divide(F.col("resolved"), total - skipped), F.lit(0.0)))
        .withColumn("avg_duration", F.coalesce(F.try_divide("total_duration", "total"), F.lit(0.0)))
        .withColumn(
            "verdict",
            F.when(F.col("errors") > 0, 2).when(F.col("unresolved") > 0, 1).otherwise(0),
        )
    )


def _rank(status: Column) -> Column:
    out = F
    for value, rank in C.STATUS_RANK.items():
        out = out.when(status == value, rank)
    return out.otherwise(0)


def _changes(both: DataFrame) -> DataFrame:
    before, after = _rank(F.col("from_status")), _rank(F.col("to_status"))
    change = (
        F.when(F.col("to_status").isNull(), "only_in_base")
        .when(F.col("from_status").isNull(), "only_in_other")
        .when(after > before, "improvement")
        .when(after < before, "regression")
        .otherwise("unchanged")
    )
    return both.withColumn("change", change)


def run_changes(
    evaluations: DataFrame, base: str, other: str, position: str | None = None, keep_one_sided: bool = False
) -> DataFrame:
    """``status_changes`` of two runs of one table, which is read once: each instance is one row of an aggregation."""
    order = F.struct(F.col(position) if position else F.lit(0), F.col("status"))
    both = (
        evaluations.where(F.col("run_id").isin(base, other)).groupBy("instance_id")
        .agg(*[F.max(F.when(F.col("run_id") == r, F.struct(order.alias("o"), F.col("status")))).alias(c) for r, c in ((base, "_b"), (other, "_o"))])
        .select("instance_id", F.col("_b.status").alias("from_status"), F.col("_o.status").alias("to_status"))
    )
    if not keep_one_sided:
        both = both.where("from_status is not null and to_status is not null")
    return _changes(both)


def status_changes(
    base: DataFrame, other: DataFrame, position: str | None = None, keep_one_sided: bool = False
) -> DataFrame:
    """(instance_id, from_status, to_status, change). The last row of an instance in a run counts.
    Instances of one run only are left out, or shown as only_in_base / only_in_other."""

    def last(df, name):
        rows = df.select("instance_id", "status", (F.col(position) if position else F.lit(0)).alias("_p"))
        return last_per_key(rows, ["instance_id"], ["_p", "status"]).select(
            "instance_id", F.col("status").alias(name)
        )

    how = "full_outer" if keep_one_sided else "inner"
    return _changes(last(base, "from_status").join(last(other, "to_status"), "instance_id", how))


PAIRED = ("total", "resolved", "unresolved", "errors", "skipped", "resolved_rate")


def comparison(summaries: DataFrame, changes: DataFrame, base: str, other: str) -> DataFrame:
    """One row: paired metrics of two runs, their rate difference and the counts of changes."""

    run = F.col("run_id")
    kinds = {"improvement": "improvements", "regression": "regressions", "unchanged": "unchanged_count"}
    metrics = summaries.where(run.isin(base, other)).select("run_id", *PAIRED, F.lit(None).cast("string").alias("change"), F.lit(0).cast("bigint").alias("_n"))
    counted = changes.groupBy("change").agg(F.count(F.lit(1)).alias("_n"))
    nothing = [F.lit(None).cast(metrics.schema[c].dataType).alias(c) for c in ("run_id", *PAIRED)]
    # two rows of metrics and one of each kind of change meet in one aggregation
    both = metrics.unionByName(counted.select(*nothing, "change", "_n")).agg(
        *[F.max(F.when(run == r, F.col(c))).alias(f"{c}_{side}") for c in PAIRED for r, side in ((base, "base"), (other, "other"))],
        *[F.coalesce(F.sum(F.when(F.col("change") == k, F.col("_n"))), F.lit(0)).alias(v) for k, v in kinds.items()],
    )
    return both.withColumn("resolved_rate_diff", F.col("resolved_rate_other") - F.col("resolved_rate_base"))


def breakdown(evaluations: DataFrame, instances: DataFrame, dims, keys=("instance_id",)) -> DataFrame:
    """(run_id, dimension, value, resolved, total, rate): one pass for all dimensions.

    Each row is expanded to one (dimension, value) pair per dimension and merged map-side.
    """
    pairs = F.array(
        *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dims]
    )
    rows = evaluations.select("run_id", *keys, "status").join(instances.select(*keys, *dims), list(keys))
    return (
        rows.select("run_id", "status", F.explode_outer(pairs).alias("pair"))
        .groupBy("run_id", "pair.dimension", "pair.value")
        .agg(F.count_if(F.col("status") == "resolved").alias("resolved"), F.count(F.lit(1)).alias("total"))
        .withColumn("rate", F.try_divide("resolved", "total"))
    )


def task_metrics(attempts: DataFrame, by=("run_id",)) -> DataFrame:
    """Over final attempts: resolution over all tasks (skipped ones too), iterations per resolved
    task, time per task."""
    resolved = F.col("status") == "resolved"
    return attempts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("tasks"),
        F.count_if(resolved).alias("resolved"),
        F.try_divide(F.count_if(resolved), F.count(F.lit(1))).alias("resolution_rate"),
        F.avg(F.when(resolved, F.col("iterations"))).alias("avg_iterations"),
        F.avg("duration").alias("avg_time"),
    )


def final_attempts(attempts: DataFrame, keys=("run_id", "instance_id"), order=("ts",)) -> DataFrame:
    """The last attempt of each task with the number of attempts made (iterations): one merge per
    task, no sort of a task's attempts."""
    rest = [c for c in attempts.columns if c not in keys]
    packed = F.struct(*order, *[F.col(c).alias(f"v_{c}") for c in rest if c not in order])
    return (
        attempts.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("iterations"), F.max(packed).alias("last"))
        .select(
            *keys, "iterations", *[F.col(f"last.{c}") for c in order],
            *[F.col(f"last.v_{c}").alias(c) for c in rest if c not in order],
        )
    )


def numbered_attempts(attempts: DataFrame, keys=("run_id", "instance_id"), order=("ts",), chunk: str | None = None) -> DataFrame:
    """attempt = 1, 2, ... per task in ``order``. With ``chunk`` (an expression that never decreases
    along ``order``) the tasks of one hot key are numbered chunk by chunk and shifted by the sizes
    of the chunks before, so no task sorts a whole key."""
    from pyspark.sql import Window

    keys = list(keys)
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return attempts.withColumn("attempt", F.row_number().over(w).cast("bigint"))
    rows = attempts.withColumn("_chunk", F.expr(chunk))
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    return (
        rows.withColumn("_within", F.row_number().over(inner))
        .join(offsets, [*keys, "_chunk"])
        .withColumn("attempt", (F.col("_within") + F.col("_before")).cast("bigint"))
        .drop("_chunk", "_within", "_before")
    )


def leaderboard(summaries: DataFrame) -> DataFrame:
    """Rows of ``report_summary`` with their rank by resolved rate (ties share a rank)."""
    # ranks join the summaries twice: written once, so that what they sum up is read once
    return competition_rank(staged(summaries, "summaries"), "resolved_rate")


# --- text -------------------------------------------------------------------------------


def evaluation_text(grades: DataFrame, details: DataFrame, keys=("run_id", "instance_id")) -> DataFrame:
    """(keys, part, ord, sub, line): the readable summary of each graded instance, a row per line,
    to be read in the order of (part, ord, sub)."""
    keys = list(keys)

    def line(part, text, when=None):
        entry = F.struct(F.lit(part).alias("part"), text.alias("line"))
        return entry if when is None else F.when(when, entry)

    def ratio(name, prefix):
        return F.format_string(f"{name}: %d/%d passed", F.col(f"{prefix}_passed"), F.col(f"{prefix}_total"))

    head = F.array(
        line(0, F.concat(F.lit("Instance: "), F.col("instance_id"))),
        line(1, F.concat(F.lit("Resolution: "), F.upper("resolved"))),
        line(2, F.lit("")),
        line(3, ratio("FAIL_TO_PASS", "fail_to_pass")),
        line(4, ratio("PASS_TO_PASS", "pass_to_pass")),
        line(5, F.format_string("Duration: %.2fs", F.col("total_duration_ms") / 1000), F.col("total_duration_ms").isNotNull()),
        line(6, F.concat(F.lit("Error: "), F.col("error")), F.col("error").isNotNull()),
    )
    heads = grades.select(
        *keys, F.explode_outer(F.filter(head, lambda x: x.isNotNull())).alias("at")
    ).select(*keys, "at.part", F.lit(0).cast("bigint").alias("ord"), F.lit(0).alias("sub"), "at.line")
    bad = details.where(F.col("status") != C.PASSED)
    part = F.when(F.col("category") == "fail_to_pass", 10).otherwise(20)
    body = bad.select(
        *keys, part.alias("part"), "ord",
        F.explode_outer(
            F.filter(
                F.array(
                    F.struct(F.lit(0).alias("sub"), F.concat(F.lit("  - "), "name", F.lit(": "), "status").alias("line")),
                    F.when(
                        F.col("error_message").isNotNull(),
                        F.struct(F.lit(1).alias("sub"), F.concat(F.lit("    Error: "), "error_message").alias("line")),
                    ),
                ),
                lambda x: x.isNotNull(),
            )
        ).alias("at"),
    ).select(*keys, "part", "ord", "at.sub", "at.line")
    title = F.when(F.col("part") == 10, "Failed FAIL_TO_PASS tests:").otherwise(
        "Failed PASS_TO_PASS tests (regressions):"
    )
    titles = (
        bad.select(*keys, part.alias("part")).distinct()
        .select(
            *keys, "part", F.lit(-1).cast("bigint").alias("ord"),
            F.posexplode_outer(F.array(F.lit(""), title)).alias("sub", "line"),
        )
    )
    return heads.unionByName(titles).unionByName(body)


def _rule(char: str) -> Column:
    return F.lit(char * 70)


def report_text(summaries: DataFrame, instances: DataFrame, title: str = "EVALUATION REPORT") -> DataFrame:
    """(run_id, part, status, instance_id, sub, line): the printed report, a row per line, to be
    read in the order of the columns before ``line``. Instances come ordered by status; with a column ``position``, which is kept behind
    ``status``, by status and position."""
    place = ["position"] if "position" in instances.columns else []

    def money(fmt, col):
        return F.format_string(fmt, F.col(col))

    top = [
        F.lit(""), _rule("="), F.lit(title), _rule("="),
        F.concat(F.lit("Timestamp: "), F.coalesce("timestamp", F.lit(""))) if "timestamp" in summaries.columns
        else F.lit("Timestamp: "),
        _rule("-"), F.lit("SUMMARY"), _rule("-"),
        money("  Total Instances:    %d", "total"),
        F.format_string("  Resolved:           %d (%.1f%%)", F.col("resolved"), F.col("resolved_rate") * 100),
        money("  Unresolved:         %d", "unresolved"),
        money("  Errors:             %d", "errors"),
        money("  Skipped:            %d", "skipped"),
        money("  Avg Duration:       %.2fs", "avg_duration"),
        money("  Total Duration:     %.2fs", "total_duration"),
        _rule("-"),
    ]
    listing = [F.lit("INSTANCE DETAILS"), _rule("-")]
    no_text = F.lit("")

    def of_run(part, lines, when=None):
        rows = summaries if when is None else summaries.where(when)
        return rows.select(
            "run_id", F.lit(part).alias("part"), no_text.alias("status"), *[F.lit(0).cast("long").alias(p) for p in place],
            no_text.alias("instance_id"), F.posexplode_outer(F.array(*lines)).alias("sub", "line"),
        )

    ran = F.col("status").isin("resolved", "unresolved")
    details = F.array(
        F.struct(F.lit(0).alias("sub"), F.concat(F.lit("  "), tx.status_marker(F.col("status")), F.lit(" "), "instance_id").alias("line")),
        F.when(ran, F.struct(F.lit(1).alias("sub"), F.format_string(
            "           Tests: %d passed, %d failed, %d skipped", "tests_passed", "tests_failed", "tests_skipped").alias("line"))),
        F.when(F.length("error_message") > 0, F.struct(F.lit(2).alias("sub"), F.concat(
            F.lit("           Error: "), tx.preview(F.col("error_message"))).alias("line"))),
        F.struct(F.lit(3).alias("sub"), money("           Duration: %.2fs", "duration").alias("line")),
    )
    body = instances.select(
        "run_id", F.lit(2).alias("part"), "status", *place, "instance_id",
        F.explode_outer(F.filter(details, lambda x: x.isNotNull())).alias("at"),
    ).select("run_id", "part", "status", *place, "instance_id", "at.sub", "at.line")
    return (
        of_run(0, top)
        .unionByName(of_run(1, listing, F.col("total") > 0))
        .unionByName(body)
        .unionByName(of_run(3, [_rule("=")]))
    )


def comparison_text(compared: DataFrame, changes: DataFrame, base: str, other: str) -> DataFrame:
    """(part, instance_id, sub, line): the printed comparison, a row per line."""
    diff = F.col("resolved_rate_diff") * 100
    top = [
        F.lit(""), _rule("="), F.lit("REPORT COMPARISON"), _rule("="),
        F.lit(f"Report 1: {base}"), F.lit(f"Report 2: {other}"), _rule("-"),
        F.format_string(
            "Resolved Rate: %.1f%% -> %.1f%% (%+.1f%%)",
            F.col("resolved_rate_base") * 100, F.col("resolved_rate_other") * 100, diff,
        ),
        F.format_string("Improvements: %d", F.col("improvements")),
        F.format_string("Regressions:  %d", F.col("regressions")),
    ]

    def of(part, lines, when=None):
        rows = compared if when is None else compared.where(when)
        return rows.select(
            F.lit(part).alias("part"), F.lit("").alias("instance_id"),
            F.posexplode_outer(F.array(*lines)).alias("sub", "line"),
        )

    def listed(part, kind):
        text = F.concat(F.lit("  "), "instance_id", F.lit(": "), "from_status", F.lit(" -> "), "to_status")
        return changes.where(F.col("change") == kind).select(
            F.lit(part).alias("part"), "instance_id", F.lit(0).alias("sub"), text.alias("line")
        )

    return (
        of(0, top)
        .unionByName(of(1, [F.lit(""), F.lit("IMPROVEMENTS:")], F.col("improvements") > 0))
        .unionByName(listed(2, "improvement"))
        .unionByName(of(3, [F.lit(""), F.lit("REGRESSIONS:")], F.col("regressions") > 0))
        .unionByName(listed(4, "regression"))
        .unionByName(of(5, [_rule("=")]))
    )


def numbered_lines(lines: DataFrame, keys, order) -> DataFrame:
    """(keys, line_no, line): the lines of each text numbered from 0 on in ``order``, as they are printed. Lines are sorted in ranges, so
    a text of any length is numbered by many tasks."""
    return positions(lines, list(keys), list(order), out="line_no").select(*keys, "line_no", "line")


def failed_results(evaluations: DataFrame, preview_length: int = 200) -> DataFrame:
    """Instances that were not resolved, with the end of their log."""
    rows = evaluations.where(F.col("status") != "resolved")
    return rows.withColumn("output_tail", F.right(F.col("output"), F.lit(preview_length)))
