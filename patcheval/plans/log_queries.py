"""Queries over test logs in the three dialects."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from patcheval.functions import text as tx
from patcheval.functions.positions import positions
from patcheval.operators import count_logs as counts
from patcheval.operators import file_logs as files
from patcheval.operators import grading, line_logs, named_logs as named
from patcheval.plans import samples as S
from patcheval.plans.registry import query

NAMED = f"""
    WITH {S.DOC_LINES_SQL},
    hits AS (
        SELECT *, lang IN ('en', 'fr') AS glyph, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS rnk
        FROM doc_lines WHERE lang IN ('en', 'fr') OR k <> 1),
    tests AS (
        SELECT source AS run_id, concat('doc-', doc_id) AS instance_id, n AS name, rnk, i, glyph,
               CASE rnk WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE 'skipped' END AS status,
               CASE WHEN rnk = 0 THEN length(n) + 0.5 WHEN rnk = 1 AND glyph THEN CAST(length(n) AS DOUBLE) END AS duration_ms,
               doc_id, last_bad
        FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY rnk, i) AS rn,
                     max(CASE WHEN k = 0 THEN i END) OVER (PARTITION BY doc_id, n) AS last_bad FROM hits)
        WHERE rn = 1),
    results AS (
        SELECT run_id, instance_id, name, status, CAST(duration_ms AS DOUBLE) AS duration_ms,
               CASE WHEN status = 'failed' AND glyph THEN concat('Error: bad line ', last_bad) END AS error_message,
               CASE WHEN status = 'failed' AND glyph THEN concat('at line ', last_bad, chr(10), 'in doc ', doc_id) END AS stack_trace,
               row_number() OVER (PARTITION BY run_id, instance_id ORDER BY rnk, i) AS list_position
        FROM tests)
"""


@query(NAMED + "SELECT run_id, instance_id, name, status, duration_ms, error_message, stack_trace FROM results")
def named_test_results(spark, sf):
    return named.named_test_results(S.named_logs(spark, sf)).drop("position")


@query(NAMED + "SELECT run_id, instance_id, name, list_position FROM results")
def named_list_positions(spark, sf):
    # the tests of one log, bounded by the one cell the log is in
    order = Window.partitionBy("run_id", "instance_id").orderBy("position")
    tests = named.test_names(named.named_test_results(S.named_logs(spark, sf)))
    return tests.select("run_id", "instance_id", "name", F.row_number().over(order).cast("bigint").alias("list_position"))


NAMED_SUMMARIES = """
    SELECT concat('doc-', d.doc_id) AS instance_id, source AS run_id, total, passed, failed, skipped,
           CASE WHEN raw IS NULL THEN NULL WHEN lang = 'fr' THEN n_chars * 1000.0 ELSE CAST(n_chars AS DOUBLE) END AS total_duration_ms,
           CASE WHEN raw IS NULL THEN 'Empty output received'
                ELSE concat_ws('; ', CASE WHEN passed <> raw_passed THEN concat('Parsed ', passed, ' passed tests, but summary shows ', raw_passed) END,
                                     CASE WHEN failed <> raw_failed THEN concat('Parsed ', failed, ' failed tests, but summary shows ', raw_failed) END)
           END AS parse_errors
    FROM documents d
    LEFT JOIN (SELECT doc_id, count(*) AS raw, count(*) FILTER (WHERE k > 1) AS raw_passed, count(*) FILTER (WHERE k = 0) AS raw_failed
               FROM doc_lines GROUP BY doc_id) l ON d.doc_id = l.doc_id
    JOIN (SELECT d2.doc_id, count(r.name) AS total, count(*) FILTER (WHERE r.status = 'passed') AS passed,
                 count(*) FILTER (WHERE r.status = 'failed') AS failed, count(*) FILTER (WHERE r.status = 'skipped') AS skipped
          FROM documents d2 LEFT JOIN results r ON r.instance_id = concat('doc-', d2.doc_id) GROUP BY d2.doc_id) c ON d.doc_id = c.doc_id
"""


@query(NAMED + NAMED_SUMMARIES)
def named_log_summary(spark, sf):
    summary = named.named_log_summary(S.named_logs(spark, sf))
    return summary.withColumn("parse_errors", F.array_join("parse_errors", "; "))


@query(NAMED + "SELECT run_id, instance_id, name, error_message, stack_trace FROM results WHERE status = 'failed'")
def named_failed_details(spark, sf):
    results = named.named_test_results(S.named_logs(spark, sf))
    return named.failed_details(results).select("run_id", "instance_id", "name", "error_message", "stack_trace")


@query(NAMED + "SELECT run_id, instance_id, name FROM results WHERE status = 'skipped'")
def named_skipped_names(spark, sf):
    results = named.named_test_results(S.named_logs(spark, sf))
    return named.names_with_status(results, "skipped").drop("position")


@query(NAMED + """
    SELECT run_id, instance_id, string_agg(concat(name, '=', status), '|' ORDER BY concat(name, '=', status)) AS statuses
    FROM results GROUP BY run_id, instance_id
""")
def named_status_maps(spark, sf):
    maps = named.status_maps(named.named_test_results(S.named_logs(spark, sf)))
    pairs = F.transform(F.map_entries("statuses"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return maps.select("run_id", "instance_id", F.array_join(F.array_sort(pairs), "|").alias("statuses"))


FILES = f"""
    WITH {S.DOC_LINES_SQL},
    results AS (
        SELECT source AS run_id, concat('doc-', doc_id) AS instance_id, doc_id, i, n AS name,
               coalesce(last_value(CASE WHEN length(n) % 4 = 0 THEN concat('test/l', length(n) % 16, '.test.ts') END IGNORE NULLS)
                          OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING),
                        concat('test/', source, '.test.ts')) AS file_path,
               CASE k WHEN 0 THEN 'FAIL' WHEN 1 THEN 'SKIP' ELSE 'PASS' END AS status,
               length(n) + 0.25 AS duration_ms,
               CASE WHEN k = 0 AND length(n) % 2 = 0 THEN concat('bad line ', i) END AS error_message
        FROM doc_lines)
"""


@query(FILES + "SELECT run_id, instance_id, file_path, name, status, CAST(duration_ms AS DOUBLE) AS duration_ms, error_message FROM results")
def file_test_results(spark, sf):
    return files.file_test_results(S.file_logs(spark, sf)).drop("position")


@query(FILES + "SELECT status, count(*) AS tests, CAST(sum(duration_ms) AS DOUBLE) AS duration_ms, count(error_message) AS errors FROM results GROUP BY status")
def file_status_counts(spark, sf):
    results = files.file_test_results(S.file_logs(spark, sf))
    return results.groupBy("status").agg(
        F.count(F.lit(1)).alias("tests"), F.sum("duration_ms").alias("duration_ms"), F.count("error_message").alias("errors")
    )


FILE_SUMMARIES = f"""
    WITH {S.DOC_LINES_SQL}
    SELECT d.source AS run_id, concat('doc-', d.doc_id) AS instance_id, passed, failed, skipped, passed + failed + skipped AS total,
           round(CASE WHEN passed + failed + skipped = 0 THEN 0.0 ELSE passed / (passed + failed + skipped) END, 9) AS pass_rate,
           2 * (passed + failed + skipped) AS expect_calls, d.n_chars + CAST(0.5 AS DOUBLE) AS total_duration_ms
    FROM documents d JOIN (
        SELECT d2.doc_id, count(*) FILTER (WHERE k > 1) AS passed, count(*) FILTER (WHERE k = 0) AS failed, count(*) FILTER (WHERE k = 1) AS skipped
        FROM documents d2 LEFT JOIN doc_lines l ON l.doc_id = d2.doc_id GROUP BY d2.doc_id) c ON c.doc_id = d.doc_id
"""


@query(FILE_SUMMARIES)
def file_log_summary(spark, sf):
    return files.file_log_summary(S.file_logs(spark, sf)).withColumn("pass_rate", F.round("pass_rate", 9))


# the same logs as lines, dealt out in ranges of a few lines
@query(FILES + "SELECT run_id, instance_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS position, file_path, name, status, CAST(duration_ms AS DOUBLE) AS duration_ms, error_message FROM results")
def line_test_results(spark, sf):
    lines = line_logs.lines_of_cells(S.file_logs(spark, sf), size=7)
    results = positions(line_logs.file_test_results(lines).withColumnRenamed("position", "at"), ["run_id", "instance_id"], ["at"])
    return results.drop("at", "group_size")


@query(FILE_SUMMARIES)
def line_log_summary(spark, sf):
    lines = line_logs.lines_of_cells(S.file_logs(spark, sf), size=7)
    return line_logs.file_log_summary(lines).withColumn("pass_rate", F.round("pass_rate", 9))


COUNTS = f"WITH {S.COUNTS_SQL} "


@query(COUNTS + """SELECT run_id, instance_id, p AS passed, f AS failed, s AS skipped, p + f + s AS total,
       CASE WHEN q = 50 THEN 'timeout' END AS error FROM counted""")
def count_log_results(spark, sf):
    return counts.count_logs(S.count_logs(spark, sf), error="error")


@query(COUNTS + """SELECT run_id, instance_id,
       CASE WHEN q = 50 THEN 'error' WHEN f = 0 AND p > 0 THEN 'resolved' ELSE 'unresolved' END AS status FROM counted""")
def grade_by_counts(spark, sf):
    graded = grading.grade_counts(counts.count_logs(S.count_logs(spark, sf), error="error"))
    return graded.select("run_id", "instance_id", "status")


# the text functions of test names and durations, over every line item and part
@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           concat('case ', l_linenumber, ' ', p_name) AS normalized,
           CASE WHEN l_returnflag = 'A' THEN l_quantity WHEN l_returnflag = 'N' THEN l_quantity * 1000 ELSE 0.0 END AS duration_ms,
           concat('test/s', l_suppkey, '.test.ts') AS file, concat('c::', p_name) <> p_name AS scoped,
           l_returnflag <> 'R' AS is_test_file
    FROM lineitem JOIN part ON l_partkey = p_partkey
""")
def test_name_functions(spark, sf):
    name = F.expr("concat(' Test  \"CASE\\t', l_linenumber, '\"  ', upper(p_name), ' ')")
    value = F.expr("CASE WHEN l_returnflag = 'R' THEN '1.2.3' ELSE CAST(l_quantity AS STRING) END")
    unit = F.expr("CASE WHEN l_returnflag = 'N' THEN 'S' ELSE 'ms' END")
    full = F.expr("concat('test/s', l_suppkey, '.test.ts::', p_name)")
    path = F.expr("CASE l_returnflag WHEN 'A' THEN concat('src/x', l_suppkey, '.spec.js') WHEN 'N' THEN concat('test/', l_suppkey, '.ts') ELSE concat('src/', l_suppkey, '.ts') END")
    return S.items(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        tx.normalize_test_name(name).alias("normalized"),
        tx.parse_duration_with_unit(value, unit).alias("duration_ms"),
        tx.test_file_of(full).alias("file"), (tx.test_name_of(full) == F.col("p_name")).alias("scoped"),
        tx.is_test_file(path).alias("is_test_file"),
    )
