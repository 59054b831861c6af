"""Queries that match expected tests and grade instances."""

from __future__ import annotations

from pyspark.sql import functions as F

from patcheval.functions.stage import staged
from patcheval.operators import file_logs as files
from patcheval.operators import grading, matching, reports
from patcheval.plans import samples as S
from patcheval.plans.evaluate import evaluate_files, evaluate_named, files_as_evaluations
from patcheval.plans.log_queries import NAMED, NAMED_SUMMARIES
from patcheval.plans.registry import query

MATCH = f"WITH {S.ITEM_MATCH_SQL}"


def _matches(spark, sf, **options):
    return matching.match_expected(S.item_expected(spark, sf), S.item_results(spark, sf), **options)


@query(MATCH + "SELECT run_id, instance_id, category, ord, name, tier, actual_name, actual_status, outcome FROM matched")
def match_all_tiers(spark, sf):
    return _matches(spark, sf).drop("detail_status", "detail_name", "detail_position")


@query(MATCH + """SELECT run_id, instance_id, category, ord, name, CASE WHEN tier IN ('exact', 'normalised') THEN tier END AS tier,
       CASE WHEN tier IN ('exact', 'normalised') THEN outcome ELSE 'missing' END AS outcome FROM matched""")
def match_by_name(spark, sf):
    found = _matches(spark, sf, tiers=("exact", "normalised"))
    return found.select("run_id", "instance_id", "category", "ord", "name", "tier", "outcome")


@query(MATCH + "SELECT outcome, tier, count(*) AS expected FROM (SELECT tier, CASE WHEN tier IS NULL THEN 'missing' ELSE 'passed' END AS outcome FROM matched) GROUP BY ALL")
def match_existence_only(spark, sf):
    found = _matches(spark, sf, require_pass=False)
    return found.groupBy("outcome", "tier").agg(F.count(F.lit(1)).alias("expected"))


@query(MATCH + """SELECT run_id, instance_id, category, ord, name AS expected_name,
       CASE WHEN shown IS NULL THEN name ELSE actual_name END AS name, coalesce(shown, 'error') AS status,
       CASE WHEN shown IS NOT NULL THEN duration_ms END AS duration_ms,
       CASE WHEN shown IS NULL THEN 'Test not found in output' END AS error_message FROM matched""")
def match_details(spark, sf):
    results = staged(S.item_results(spark, sf), "results")  # read for the names and for what they show
    found = matching.match_expected(S.item_expected(spark, sf), results, tiers=("exact", "normalised"))
    return matching.detail_results(found, results).drop("stack_trace")


@query(MATCH + """SELECT run_id, instance_id, category, count(*) AS expected, count(*) FILTER (WHERE outcome = 'passed') AS passed,
       count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'missing') AS missing,
       round(count(*) FILTER (WHERE outcome = 'passed') / count(*), 9) AS pass_rate,
       count(*) FILTER (WHERE outcome = 'passed') = count(*) AS all_passed,
       count(*) FILTER (WHERE outcome = 'passed') > 0 AS any_passed FROM matched GROUP BY ALL""")
def category_results(spark, sf):
    return grading.category_results(_matches(spark, sf)).withColumn("pass_rate", F.round("pass_rate", 9))


GRADED = MATCH + """,
    ran AS (SELECT run_id, concat('ord-', o_orderkey) AS instance_id FROM orders, (VALUES ('F'), ('O')) r(run_id)),
    graded AS (
        SELECT ran.run_id, ran.instance_id,
               count(*) FILTER (WHERE category = 'fail_to_pass') AS ft, count(*) FILTER (WHERE category = 'fail_to_pass' AND outcome = 'passed') AS fp,
               count(*) FILTER (WHERE category = 'pass_to_pass') AS pt, count(*) FILTER (WHERE category = 'pass_to_pass' AND outcome = 'passed') AS pp
        FROM ran LEFT JOIN matched USING (run_id, instance_id) GROUP BY ALL),
    verdicts AS (
        SELECT *, CASE WHEN pp < pt THEN 'no' WHEN ft = 0 OR fp = ft THEN 'full' WHEN fp > 0 THEN 'partial' ELSE 'no' END AS resolved FROM graded)
"""


@query(GRADED + """SELECT run_id, instance_id, resolved, fp AS fail_to_pass_passed, ft AS fail_to_pass_total,
       pp AS pass_to_pass_passed, pt AS pass_to_pass_total,
       round(CASE WHEN ft = 0 THEN 1.0 ELSE fp / ft END, 9) AS fail_to_pass_rate,
       round(CASE WHEN pt = 0 THEN 1.0 ELSE pp / pt END, 9) AS pass_to_pass_rate FROM verdicts""")
def grade_by_names(spark, sf):
    grades = grading.grade_named(S.run_instances(spark, sf), _matches(spark, sf))
    return grades.select(
        "run_id", "instance_id", "resolved", "fail_to_pass_passed", "fail_to_pass_total", "pass_to_pass_passed",
        "pass_to_pass_total", F.round("fail_to_pass_rate", 9).alias("fail_to_pass_rate"),
        F.round("pass_to_pass_rate", 9).alias("pass_to_pass_rate"),
    )


def _document_run(spark, sf):
    """Every line of a document is expected as a test; the runs of one source broke off."""
    logs = S.named_logs(spark, sf).withColumn("error", F.expr("CASE WHEN run_id = 'src0' THEN 'container lost' ELSE '' END"))
    lines = S._doc_lines(spark, sf)
    expected = lines.select(
        "run_id", "instance_id", F.lit("fail_to_pass").alias("category"),
        F.explode(F.expr("transform(lines, s -> struct(CAST(s.i AS BIGINT) AS ord, s.n AS name))")).alias("e"),
    ).select("run_id", "instance_id", "category", "e.*")
    return expected, logs


# log to grade by the named rule, expecting of every document each line as its own test
DOC_GRADED = f"""
    WITH {S.DOC_LINES_SQL},
    best AS (
        SELECT doc_id, n, min(CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END) AS rnk FROM doc_lines
        WHERE lang IN ('en', 'fr') OR k <> 1 GROUP BY doc_id, n),
    graded AS (
        SELECT d.doc_id, d.source, d.lang, count(l.n) AS total, count(*) FILTER (WHERE b.rnk = 0) AS passed
        FROM documents d LEFT JOIN doc_lines l ON l.doc_id = d.doc_id LEFT JOIN best b ON b.doc_id = l.doc_id AND b.n = l.n GROUP BY ALL)
"""


@query(DOC_GRADED + """SELECT source AS run_id, concat('doc-', doc_id) AS instance_id,
       CASE WHEN source = 'src0' THEN 'no' WHEN passed = total AND total > 0 THEN 'full' WHEN total = 0 THEN 'full' WHEN passed > 0 THEN 'partial' ELSE 'no' END AS resolved,
       CASE WHEN source = 'src0' THEN 0 ELSE passed END AS fail_to_pass_passed, total AS fail_to_pass_total,
       CASE WHEN source = 'src0' THEN 'container lost' END AS stopped_by FROM graded""")
def grade_logs_by_names(spark, sf):
    expected, logs = _document_run(spark, sf)
    grades, _ = evaluate_named(expected, logs, error="error", tiers=("exact", "normalised"))
    return grades.select(
        "run_id", "instance_id", "resolved", "fail_to_pass_passed", "fail_to_pass_total",
        F.when(F.col("error") == "container lost", F.col("error")).alias("stopped_by"),
    )


# the whole record of an evaluation, its details in list order
@query(NAMED + f""", summaries AS ({NAMED_SUMMARIES}),
    details AS (
        SELECT concat('doc-', l.doc_id) AS instance_id, i, concat(n, '=', coalesce(status, 'error'), '@', coalesce(CAST(duration_ms AS VARCHAR), ''), '!',
               CASE WHEN status IS NULL THEN 'Test not found in output' ELSE coalesce(error_message, '') END) AS shown
        FROM doc_lines l LEFT JOIN results r ON r.instance_id = concat('doc-', l.doc_id) AND r.name = l.n),
    lists AS (SELECT instance_id, string_agg(shown, '|' ORDER BY i) AS shown FROM details GROUP BY instance_id)
    SELECT s.run_id, s.instance_id, CASE WHEN s.run_id = 'src0' THEN '' ELSE coalesce(shown, '') END AS fail_to_pass_results, '' AS pass_to_pass_results,
           CASE WHEN s.run_id <> 'src0' THEN length(s.instance_id) + CAST(0.5 AS DOUBLE) END AS total_duration_ms,
           CASE WHEN s.run_id = 'src0' THEN 'container lost' WHEN parse_errors <> '' THEN concat('Parse warnings: ', parse_errors) END AS error
    FROM summaries s LEFT JOIN lists USING (instance_id)""")
def evaluation_records(spark, sf):
    expected, logs = _document_run(spark, sf)
    logs = logs.withColumn("lasted", F.length("instance_id") + F.lit(0.5))
    grades, details = evaluate_named(expected, logs, error="error", tiers=("exact", "normalised"), duration="lasted")
    records = grading.evaluation_records(grades, details, logs.where("error <> ''"), ("run_id", "instance_id"))
    blank = lambda c: F.coalesce(c, F.lit(""))

    def shown(column):
        text = F.transform(column, lambda r: F.concat(
            r["name"], F.lit("="), r["status"], F.lit("@"), blank(r["duration_ms"].cast("string")), F.lit("!"), blank(r["error_message"])))
        return F.array_join(text, "|").alias(column)

    return records.select("run_id", "instance_id", shown("fail_to_pass_results"), shown("pass_to_pass_results"), "total_duration_ms", "error")


FILE_GRADED = f"""
    WITH {S.DOC_LINES_SQL},
    headed AS (
        SELECT *, coalesce(last_value(CASE WHEN length(n) % 4 = 0 THEN concat('test/l', length(n) % 16, '.test.ts') END IGNORE NULLS)
                             OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), concat('test/', source, '.test.ts')) AS file
        FROM doc_lines),
    actual AS (SELECT doc_id, concat(file, '::', n) AS full_name, arg_max(k, i) AS k FROM headed GROUP BY ALL),
    expected AS (
        SELECT DISTINCT doc_id, CASE WHEN length(n) % 2 = 0 THEN 'fail_to_pass' ELSE 'pass_to_pass' END AS category,
               concat(CASE WHEN length(n) % 5 = 0 THEN 'test/none.test.ts' WHEN length(n) % 4 = 0 THEN concat('test/l', length(n) % 16, '.test.ts')
                           ELSE concat('test/', source, '.test.ts') END, '::', n) AS full_name
        FROM doc_lines),
    found AS (
        SELECT e.doc_id, category, e.full_name, CASE WHEN k IS NULL THEN 'NOT_FOUND' WHEN k = 0 THEN 'FAIL' WHEN k = 1 THEN 'SKIP' ELSE 'PASS' END AS status
        FROM expected e LEFT JOIN actual a ON a.doc_id = e.doc_id AND a.full_name = e.full_name),
    scored AS (
        SELECT d.doc_id, d.source, d.n_chars, count(*) FILTER (WHERE category = 'fail_to_pass') AS ft, count(*) FILTER (WHERE category = 'fail_to_pass' AND status = 'PASS') AS fp,
               count(*) FILTER (WHERE category = 'pass_to_pass') AS pt, count(*) FILTER (WHERE category = 'pass_to_pass' AND status = 'PASS') AS pp
        FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id GROUP BY ALL),
    said AS (
        SELECT d.doc_id, count(l.n) AS total, count(*) FILTER (WHERE k > 1) AS passed FROM documents d LEFT JOIN doc_lines l ON l.doc_id = d.doc_id GROUP BY d.doc_id)
"""


@query(FILE_GRADED + "SELECT doc_id, category, full_name AS name, status, status = 'PASS' AS correct FROM found")
def match_file_tests(spark, sf):
    results = files.file_test_results(S.file_logs(spark, sf))
    found = grading.match_files(grading.expected_tests(S.file_instances(spark, sf), ("run_id", "instance_id")), results)
    return found.select(
        F.expr("CAST(substring(instance_id, 5) AS BIGINT)").alias("doc_id"), "category", "name", "status", "correct"
    )


@query(FILE_GRADED + """SELECT source AS run_id, concat('doc-', s.doc_id) AS instance_id, fp = ft AND pp = pt AS resolved,
       round(CASE WHEN ft = 0 THEN 1.0 ELSE fp / ft END, 9) AS fail_to_pass_score,
       round(CASE WHEN pt = 0 THEN 1.0 ELSE pp / pt END, 9) AS pass_to_pass_score, total AS total_tests_run,
       round(CASE WHEN total = 0 THEN 0.0 ELSE passed / total END, 9) AS test_pass_rate
       FROM scored s JOIN said USING (doc_id)""")
def grade_by_files(spark, sf):
    expected = grading.expected_tests(S.file_instances(spark, sf), ("run_id", "instance_id"))
    grades, _ = evaluate_files(expected, S.file_logs(spark, sf))
    return grades.withColumns(
        {c: F.round(c, 9) for c in ("fail_to_pass_score", "pass_to_pass_score", "test_pass_rate")}
    )


@query(FILE_GRADED + """SELECT source AS run_id, count(*) AS total, count(*) FILTER (WHERE fp = ft AND pp = pt) AS resolved,
       count(*) FILTER (WHERE NOT (fp = ft AND pp = pt)) AS unresolved,
       round(count(*) FILTER (WHERE fp = ft AND pp = pt) / count(*), 9) AS resolved_rate,
       round(sum(n_chars + 0.5) / 1000, 4) AS total_duration, round(sum(n_chars + 0.5) / 1000 / count(*), 4) AS avg_duration
       FROM scored GROUP BY source""")
def run_report_from_file_logs(spark, sf):
    """The flagship: test logs to run report. Per run, how many tasks are resolved, at what rate?"""
    expected = grading.expected_tests(S.file_instances(spark, sf), ("run_id", "instance_id"))
    summary = reports.report_summary(files_as_evaluations(*evaluate_files(expected, S.file_logs(spark, sf))))
    return summary.select(
        "run_id", "total", "resolved", "unresolved", F.round("resolved_rate", 9).alias("resolved_rate"),
        F.round("total_duration", 4).alias("total_duration"), F.round("avg_duration", 4).alias("avg_duration"),
    )
