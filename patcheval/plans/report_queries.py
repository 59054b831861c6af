"""Queries over evaluations: reports, comparisons, breakdowns, leaderboards, attempts."""

from __future__ import annotations

from pyspark.sql import functions as F

from patcheval.functions import text as tx
from patcheval.functions.stage import staged
from patcheval.operators import grading, reports
from patcheval.plans import samples as S
from patcheval.plans.evaluate import evaluate_counts
from patcheval.plans.registry import query
from patcheval.sources import sinks

EVALUATED = f"WITH {S.EVALUATED_SQL}"


def evaluations(spark, sf, output_limit=None):
    return evaluate_counts(
        S.run_instances(spark, sf), S.predictions(spark, sf), S.count_logs(spark, sf), error="error", duration="duration",
        output_limit=output_limit,
    )


@query(EVALUATED + """SELECT run_id, instance_id, status, patch_applied, passed, failed, skipped, passed + failed + skipped AS total, duration, error_message FROM evaluated""")
def evaluate_runs(spark, sf):
    return evaluations(spark, sf).drop("output")


@query(EVALUATED + """SELECT run_id, instance_id, status, error_message FROM (
       SELECT run_id, instance_id, has_prediction, CASE WHEN has_prediction THEN 'pending' ELSE 'skipped' END AS status,
              CASE WHEN NOT has_prediction THEN 'No prediction provided' END AS error_message FROM runs)""")
def attach_predictions(spark, sf):
    joined = grading.attach_predictions(
        S.run_instances(spark, sf).select("run_id", "instance_id"), S.predictions(spark, sf), ("run_id", "instance_id")
    )
    return joined.select("run_id", "instance_id", "status", "error_message")


@query("""SELECT concat('cust-', c_custkey) AS instance_id, patch, CASE WHEN patch IS NULL THEN 'skipped' ELSE 'pending' END AS status,
       CASE WHEN patch IS NULL THEN 'No prediction provided' END AS error_message
       FROM customer LEFT JOIN (SELECT o_custkey, concat('patch ', max(o_orderkey)) AS patch FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def last_prediction_wins(spark, sf):
    """Customers are instances, each of their orders is a prediction; the last one counts."""
    given = S.table(spark, sf, "orders").select(
        F.expr("concat('cust-', o_custkey)").alias("instance_id"), F.expr("concat('patch ', o_orderkey)").alias("patch"), F.col("o_orderkey").alias("position")
    )
    instances = S.table(spark, sf, "customer").select(F.expr("concat('cust-', c_custkey)").alias("instance_id"))
    return grading.attach_predictions(instances, given).select("instance_id", "patch", "status", "error_message")


@query(EVALUATED + """, f AS (SELECT instance_id, status FROM evaluated WHERE run_id = 'F' AND instance_id NOT LIKE '%1'),
    o AS (SELECT instance_id, status FROM evaluated WHERE run_id = 'O' AND instance_id NOT LIKE '%2')
    SELECT instance_id, f.status AS from_status, o.status AS to_status, CASE WHEN o.status IS NULL THEN 'only_in_base' WHEN f.status IS NULL THEN 'only_in_other' ELSE 'both' END AS side
    FROM f FULL JOIN o USING (instance_id)""")
def one_sided_changes(spark, sf):
    rows = evaluations(spark, sf).where("(run_id = 'F' AND instance_id NOT LIKE '%1') OR (run_id = 'O' AND instance_id NOT LIKE '%2')")
    changes = reports.run_changes(rows, "F", "O", keep_one_sided=True)
    side = F.when(F.col("change").like("only_in_%"), F.col("change")).otherwise("both")
    return changes.select("instance_id", "from_status", "to_status", side.alias("side"))


@query(EVALUATED + "SELECT run_id, instance_id, status, CAST(NULL AS VARCHAR) AS test_output FROM evaluated")
def report_without_output(spark, sf):
    rows = reports.report_instances(evaluations(spark, sf), include_test_output=False)
    return rows.select("run_id", "instance_id", "status", "test_output")


SUMMARIES = EVALUATED + """, summaries AS (
    SELECT run_id, count(*) AS total, count(*) FILTER (WHERE status = 'resolved') AS resolved, count(*) FILTER (WHERE status = 'unresolved') AS unresolved,
           count(*) FILTER (WHERE status = 'error') AS errors, count(*) FILTER (WHERE status = 'skipped') AS skipped,
           sum(duration) AS total_duration, count(*) FILTER (WHERE status = 'resolved') / count(*) FILTER (WHERE status <> 'skipped') AS resolved_rate,
           sum(duration) / count(*) AS avg_duration
    FROM evaluated GROUP BY run_id)
"""


@query(SUMMARIES + """SELECT run_id, total, resolved, unresolved, errors, skipped, total_duration, round(resolved_rate, 9) AS resolved_rate,
       round(avg_duration, 6) AS avg_duration, CASE WHEN errors > 0 THEN 2 WHEN unresolved > 0 THEN 1 ELSE 0 END AS verdict FROM summaries""")
def run_report(spark, sf):
    return reports.report_summary(evaluations(spark, sf)).withColumns(
        {"resolved_rate": F.round("resolved_rate", 9), "avg_duration": F.round("avg_duration", 6)}
    )


@query(EVALUATED + """SELECT run_id, instance_id, status, passed AS tests_passed, failed AS tests_failed, skipped AS tests_skipped, duration,
       CASE WHEN patch_applied AND q IS NOT NULL THEN log END AS test_output
       FROM evaluated LEFT JOIN (
         SELECT run_id, instance_id, q, CASE WHEN length(whole) > 41 THEN concat(left(whole, 20), chr(10), '... [truncated] ...', chr(10), right(whole, 21)) ELSE whole END AS log
         FROM (SELECT *, CASE WHEN q > 25 THEN concat('run done', chr(10), '{"passed": ', p, ', "failed": ', f, ', "skipped": ', s, '}', chr(10), 'bye')
               ELSE concat('9 passed so far', chr(10), p, ' passed, ', f, ' Failed', chr(10), s, ' skipped (', p + f + s, ' tests)') END AS whole FROM counted))
       USING (run_id, instance_id)""")
def report_instances(spark, sf):
    rows = reports.report_instances(evaluations(spark, sf, output_limit=41), max_output_length=None)
    return rows.select("run_id", "instance_id", "status", "tests_passed", "tests_failed", "tests_skipped", "duration", "test_output")


@query(EVALUATED + """, changes AS (
    SELECT instance_id, a.status AS from_status, b.status AS to_status,
           CASE a.status WHEN 'resolved' THEN 3 WHEN 'unresolved' THEN 2 WHEN 'error' THEN 1 ELSE 0 END AS ra,
           CASE b.status WHEN 'resolved' THEN 3 WHEN 'unresolved' THEN 2 WHEN 'error' THEN 1 ELSE 0 END AS rb
    FROM evaluated a JOIN evaluated b USING (instance_id) WHERE a.run_id = 'F' AND b.run_id = 'O')
    SELECT instance_id, from_status, to_status, CASE WHEN rb > ra THEN 'improvement' WHEN rb < ra THEN 'regression' ELSE 'unchanged' END AS change FROM changes""")
def compare_runs(spark, sf):
    return reports.run_changes(evaluations(spark, sf), "F", "O")


@query(SUMMARIES + """, ranks AS (
    SELECT run_id, instance_id, CASE status WHEN 'resolved' THEN 3 WHEN 'unresolved' THEN 2 WHEN 'error' THEN 1 ELSE 0 END AS r FROM evaluated),
    changed AS (SELECT count(*) FILTER (WHERE b.r > a.r) AS improvements, count(*) FILTER (WHERE b.r < a.r) AS regressions, count(*) FILTER (WHERE b.r = a.r) AS unchanged_count
                FROM ranks a JOIN ranks b USING (instance_id) WHERE a.run_id = 'F' AND b.run_id = 'O')
    SELECT a.total AS total_base, b.total AS total_other, a.resolved AS resolved_base, b.resolved AS resolved_other, a.errors AS errors_base, b.errors AS errors_other,
           round(b.resolved_rate - a.resolved_rate, 9) AS resolved_rate_diff, improvements, regressions, unchanged_count
    FROM summaries a, summaries b, changed WHERE a.run_id = 'F' AND b.run_id = 'O'""")
def compare_run_summaries(spark, sf):
    rows = staged(evaluations(spark, sf).drop("output"), "evaluations")
    changes = reports.run_changes(rows, "F", "O")
    compared = reports.comparison(reports.report_summary(rows), changes, "F", "O")
    return compared.select(
        "total_base", "total_other", "resolved_base", "resolved_other", "errors_base", "errors_other",
        F.round("resolved_rate_diff", 9).alias("resolved_rate_diff"), "improvements", "regressions", "unchanged_count",
    )


@query(EVALUATED + """SELECT run_id, dimension, value, resolved, total, round(resolved / total, 9) AS rate FROM (
    SELECT run_id, 'difficulty' AS dimension, difficulty AS value, count(*) FILTER (WHERE status = 'resolved') AS resolved, count(*) AS total FROM evaluated GROUP BY ALL
    UNION ALL SELECT run_id, 'category', category, count(*) FILTER (WHERE status = 'resolved'), count(*) FROM evaluated GROUP BY ALL
    UNION ALL SELECT run_id, 'area', o_orderpriority, count(*) FILTER (WHERE status = 'resolved'), count(*) FROM evaluated GROUP BY ALL)""")
def result_breakdown(spark, sf):
    facts = S.table(spark, sf, "orders").select(
        F.expr("concat('ord-', o_orderkey)").alias("instance_id"), F.expr(S.CATEGORY).alias("category"),
        F.expr(S.DIFFICULTY).alias("difficulty"), F.col("o_orderpriority").alias("area"),
    )
    rows = reports.breakdown(evaluations(spark, sf), facts, ("difficulty", "category", "area"))
    return rows.withColumn("rate", F.round("rate", 9))


# a leaderboard of suppliers: their line items are results, the flag is the status
@query("""SELECT run_id, total, resolved, round(rate, 9) AS resolved_rate, rank() OVER (ORDER BY round(rate, 9) DESC) AS "rank" FROM (
    SELECT concat('model-', l_suppkey) AS run_id, count(*) AS total, count(*) FILTER (WHERE l_returnflag = 'A') AS resolved,
           count(*) FILTER (WHERE l_returnflag = 'A') / count(*) AS rate FROM lineitem GROUP BY l_suppkey)""")
def leaderboard(spark, sf):
    rows = S.table(spark, sf, "lineitem").select(
        F.expr("concat('model-', l_suppkey)").alias("run_id"), F.col("l_quantity").alias("duration"),
        F.expr("CASE WHEN l_returnflag = 'A' THEN 'resolved' ELSE 'unresolved' END").alias("status"),
    )
    summaries = reports.report_summary(rows).withColumn("resolved_rate", F.round("resolved_rate", 9))
    return reports.leaderboard(summaries).select("run_id", "total", "resolved", "resolved_rate", "rank")


ATTEMPTS = """WITH attempts AS (
    SELECT 'all' AS run_id, concat('task-', user_id) AS instance_id, ts, event_id, value AS duration,
           CASE WHEN event_type IN ('purchase', 'signup') THEN 'resolved' ELSE 'unresolved' END AS status FROM events)
"""


def _attempts(spark, sf):
    return S.table(spark, sf, "events").select(
        F.lit("all").alias("run_id"), F.expr("concat('task-', user_id)").alias("instance_id"), "ts", "event_id",
        F.col("value").alias("duration"),
        F.expr("CASE WHEN event_type IN ('purchase', 'signup') THEN 'resolved' ELSE 'unresolved' END").alias("status"),
    )


@query(ATTEMPTS + "SELECT run_id, instance_id, event_id, row_number() OVER (PARTITION BY run_id, instance_id ORDER BY ts, event_id) AS attempt FROM attempts")
def attempt_numbers(spark, sf):
    # a day is the chunk: tasks with very many attempts are numbered a day at a time
    rows = reports.numbered_attempts(_attempts(spark, sf), order=("ts", "event_id"), chunk="date_trunc('DAY', ts)")
    return rows.select("run_id", "instance_id", "event_id", "attempt")


@query(ATTEMPTS + """SELECT run_id, instance_id, count(*) AS iterations, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(status, (ts, event_id)) AS status,
       arg_max(duration, (ts, event_id)) AS duration FROM attempts GROUP BY ALL""")
def final_attempts(spark, sf):
    rows = reports.final_attempts(_attempts(spark, sf), order=("ts", "event_id"))
    return rows.select("run_id", "instance_id", "iterations", "event_id", "status", "duration")


@query(ATTEMPTS + """, final AS (SELECT run_id, instance_id, count(*) AS iterations, arg_max(status, (ts, event_id)) AS status, arg_max(duration, (ts, event_id)) AS duration FROM attempts GROUP BY ALL)
    SELECT run_id, count(*) AS tasks, count(*) FILTER (WHERE status = 'resolved') AS resolved, round(count(*) FILTER (WHERE status = 'resolved') / count(*), 9) AS resolution_rate,
           round(avg(iterations) FILTER (WHERE status = 'resolved'), 6) AS avg_iterations, round(avg(duration), 6) AS avg_time FROM final GROUP BY run_id""")
def task_metrics(spark, sf):
    rows = reports.task_metrics(reports.final_attempts(_attempts(spark, sf), order=("ts", "event_id")))
    return rows.withColumns(
        {"resolution_rate": F.round("resolution_rate", 9), "avg_iterations": F.round("avg_iterations", 6), "avg_time": F.round("avg_time", 6)}
    )


# --- text -------------------------------------------------------------------------------


@query(SUMMARIES + """, lines AS (
    SELECT run_id, 0 AS part, '' AS status, '' AS instance_id, 8 AS sub, printf('  Total Instances:    %d', total) AS line FROM summaries
    UNION ALL SELECT run_id, 0, '', '', 9, printf('  Resolved:           %d (%.1f%%)', resolved, resolved_rate * 100) FROM summaries
    UNION ALL SELECT run_id, 0, '', '', 14, printf('  Total Duration:     %.2fs', total_duration) FROM summaries
    UNION ALL SELECT run_id, 2, status, instance_id, 0, concat('  ', CASE status WHEN 'resolved' THEN '[PASS]' WHEN 'unresolved' THEN '[FAIL]' WHEN 'error' THEN '[ERR ]' ELSE '[SKIP]' END, ' ', instance_id) FROM evaluated
    UNION ALL SELECT run_id, 2, status, instance_id, 1, printf('           Tests: %d passed, %d failed, %d skipped', passed, failed, skipped) FROM evaluated WHERE status IN ('resolved', 'unresolved')
    UNION ALL SELECT run_id, 2, status, instance_id, 2, concat('           Error: ', error_message) FROM evaluated WHERE error_message IS NOT NULL
    UNION ALL SELECT run_id, 2, status, instance_id, 3, printf('           Duration: %.2fs', duration) FROM evaluated)
    SELECT * FROM lines
    UNION ALL SELECT run_id, 0, '', '', sub, line FROM summaries, (VALUES (0, ''), (1, repeat('=', 70)), (2, 'EVALUATION REPORT'), (3, repeat('=', 70)), (4, 'Timestamp: '),
        (5, repeat('-', 70)), (6, 'SUMMARY'), (7, repeat('-', 70)), (15, repeat('-', 70))) v(sub, line)
    UNION ALL SELECT run_id, 0, '', '', 10, printf('  Unresolved:         %d', unresolved) FROM summaries
    UNION ALL SELECT run_id, 0, '', '', 11, printf('  Errors:             %d', errors) FROM summaries
    UNION ALL SELECT run_id, 0, '', '', 12, printf('  Skipped:            %d', skipped) FROM summaries
    UNION ALL SELECT run_id, 0, '', '', 13, printf('  Avg Duration:       %.2fs', avg_duration) FROM summaries
    UNION ALL SELECT run_id, 1, '', '', sub, line FROM summaries, (VALUES (0, 'INSTANCE DETAILS'), (1, repeat('-', 70))) v(sub, line)
    UNION ALL SELECT run_id, 3, '', '', 0, repeat('=', 70) FROM summaries""")
def report_text_lines(spark, sf):
    rows = staged(evaluations(spark, sf).drop("output"), "evaluations")
    return reports.report_text(reports.report_summary(rows), reports.report_instances(rows, include_test_output=False))


@query(SUMMARIES + """, c AS (
    SELECT instance_id, a.status AS f, b.status AS t, CASE a.status WHEN 'resolved' THEN 3 WHEN 'unresolved' THEN 2 WHEN 'error' THEN 1 ELSE 0 END AS ra,
           CASE b.status WHEN 'resolved' THEN 3 WHEN 'unresolved' THEN 2 WHEN 'error' THEN 1 ELSE 0 END AS rb
    FROM evaluated a JOIN evaluated b USING (instance_id) WHERE a.run_id = 'F' AND b.run_id = 'O'),
    n AS (SELECT count(*) FILTER (WHERE rb > ra) AS better, count(*) FILTER (WHERE rb < ra) AS worse FROM c),
    r AS (SELECT 100 * f.resolved_rate AS a, 100 * o.resolved_rate AS b FROM summaries f, summaries o WHERE f.run_id = 'F' AND o.run_id = 'O')
    SELECT CASE WHEN rb > ra THEN 2 ELSE 4 END AS part, instance_id, 0 AS sub, concat('  ', instance_id, ': ', f, ' -> ', t) AS line FROM c WHERE ra <> rb
    UNION ALL SELECT part, '', sub, line FROM (VALUES (0, 0, ''), (0, 1, repeat('=', 70)), (0, 2, 'REPORT COMPARISON'), (0, 3, repeat('=', 70)), (0, 4, 'Report 1: F'), (0, 5, 'Report 2: O'),
        (0, 6, repeat('-', 70)), (5, 0, repeat('=', 70))) v(part, sub, line)
    UNION ALL SELECT 0, '', 7, printf('Resolved Rate: %.1f%% -> %.1f%% (%+.1f%%)', a, b, b - a) FROM r
    UNION ALL SELECT 0, '', 8, concat('Improvements: ', better) FROM n
    UNION ALL SELECT 0, '', 9, concat('Regressions:  ', worse) FROM n
    UNION ALL SELECT 1, '', sub, line FROM n, (VALUES (0, ''), (1, 'IMPROVEMENTS:')) v(sub, line) WHERE better > 0
    UNION ALL SELECT 3, '', sub, line FROM n, (VALUES (0, ''), (1, 'REGRESSIONS:')) v(sub, line) WHERE worse > 0""")
def comparison_text_lines(spark, sf):
    rows = staged(evaluations(spark, sf).drop("output"), "evaluations")
    changes = reports.run_changes(rows, "F", "O")
    compared = reports.comparison(reports.report_summary(rows), changes, "F", "O")
    return reports.comparison_text(compared, changes, "F", "O")


# the printed order: instances by status, then by their place in the run
@query(SUMMARIES + """, lines AS (
    SELECT run_id, 2 AS part, status, CAST(substr(instance_id, 5) AS BIGINT) AS place, 0 AS sub, concat('  ', CASE status WHEN 'resolved' THEN '[PASS]' WHEN 'unresolved' THEN '[FAIL]' WHEN 'error' THEN '[ERR ]' ELSE '[SKIP]' END, ' ', instance_id) AS line FROM evaluated
    UNION ALL SELECT run_id, 2, status, CAST(substr(instance_id, 5) AS BIGINT), 1, printf('           Tests: %d passed, %d failed, %d skipped', passed, failed, skipped) FROM evaluated WHERE status IN ('resolved', 'unresolved')
    UNION ALL SELECT run_id, 2, status, CAST(substr(instance_id, 5) AS BIGINT), 2, concat('           Error: ', error_message) FROM evaluated WHERE error_message IS NOT NULL
    UNION ALL SELECT run_id, 2, status, CAST(substr(instance_id, 5) AS BIGINT), 3, printf('           Duration: %.2fs', duration) FROM evaluated)
    SELECT run_id, 15 + CASE WHEN total > 0 THEN 2 ELSE 0 END + row_number() OVER (PARTITION BY run_id ORDER BY status, place, sub) AS line_no, line FROM lines JOIN summaries USING (run_id)""")
def report_lines_in_order(spark, sf):
    rows = staged(evaluations(spark, sf).drop("output"), "evaluations")
    instances = reports.report_instances(rows, include_test_output=False).withColumn("position", F.expr("CAST(substring(instance_id, 5) AS BIGINT)"))
    # numbered twice, and each time sampled for its ranges first
    text = staged(reports.report_text(reports.report_summary(rows), instances), "report-lines")
    # the head of a report does not depend on the order: its lines are those of report_text_lines
    lines = reports.numbered_lines(text, ["run_id"], ["part", "status", "position", "sub"])
    # how many they are does not depend on what they say
    body = reports.numbered_lines(text.where("part = 2").withColumn("line", F.lit("")), ["run_id"], ["status", "position", "sub"]).groupBy("run_id").agg(F.count("line_no").alias("n"))
    return lines.join(body, "run_id").where("line_no >= 18 AND line_no < 18 + n").drop("n")


@query(EVALUATED + """SELECT run_id, instance_id, status, CASE WHEN length(error_message) > 60 THEN concat(left(error_message, 60), '...') ELSE error_message END AS error_preview,
       CASE WHEN status <> 'skipped' THEN right(log, 30) END AS output_tail
       FROM evaluated LEFT JOIN (
         SELECT run_id, instance_id, CASE WHEN q > 25 THEN concat('run done', chr(10), '{"passed": ', p, ', "failed": ', f, ', "skipped": ', s, '}', chr(10), 'bye')
               ELSE concat('9 passed so far', chr(10), p, ' passed, ', f, ' Failed', chr(10), s, ' skipped (', p + f + s, ' tests)') END AS log FROM counted)
       USING (run_id, instance_id) WHERE status <> 'resolved'""")
def failed_results(spark, sf):
    rows = reports.failed_results(evaluations(spark, sf), preview_length=30)
    return rows.select("run_id", "instance_id", "status", tx.preview(F.col("error_message")).alias("error_preview"), "output_tail")


@query(EVALUATED + """SELECT run_id, count(*) AS rows, sum(CAST(concat('0x', substr(c, 1, 8)) AS BIGINT))::BIGINT AS first_words FROM (
    SELECT run_id, sha256(concat('{"run_id":"', run_id, '","instance_id":"', instance_id, '","status":"', status, '"}')) AS c FROM evaluated) GROUP BY run_id""")
def row_checksums(spark, sf):
    checked = sinks.row_checksums(evaluations(spark, sf).select("run_id", "instance_id", "status"))
    word = F.conv(F.substring("checksum", 1, 8), 16, 10).cast("bigint")
    return checked.groupBy("run_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(word).alias("first_words"))


_WORDS = ", ".join(f"CAST(sum(CAST(concat('0x', substr(c, {1 + 15 * i}, 15)) AS HUGEINT)) AS VARCHAR)" for i in range(4))


@query(EVALUATED + f"""SELECT run_id, count(*) AS rows, sha256(concat_ws(':', CAST(count(*) AS VARCHAR), {_WORDS})) AS run_checksum FROM (
    SELECT run_id, sha256(concat('{{"run_id":"', run_id, '","instance_id":"', instance_id, '","status":"', status, '"}}')) AS c FROM evaluated) GROUP BY run_id""")
def run_checksums(spark, sf):
    return sinks.run_checksums(sinks.row_checksums(evaluations(spark, sf).select("run_id", "instance_id", "status")))
