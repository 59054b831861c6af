"""Queries that write the sample tables in a file shape, read them back and use what was read, and
queries that run as streams over files."""

from __future__ import annotations

from pyspark.sql import functions as F

from patcheval.functions.stage import new_path, staged
from patcheval.operators import costs, dataset as ds
from patcheval.operators.reports import report_instances, report_summary
from patcheval.plans import samples as S
from patcheval.plans.dataset_queries import INSTANCES, ISSUES
from patcheval.plans.inference_queries import CALLS, STATS_COLUMNS
from patcheval.plans.registry import query
from patcheval.plans.report_queries import EVALUATED, SUMMARIES, evaluations
from patcheval.sources import readers, sinks
from patcheval.sources.range_tree import range_tree, roots
from patcheval.streaming import jobs, keyed_store

READ_BACK = INSTANCES + """SELECT instance_id, problem_statement, category, difficulty, gold_patch, concat('orders,', tag) AS tags,
    CASE WHEN has_tests THEN concat('t', o_custkey) ELSE '' END AS tests FROM instances"""


def _shown(rows):
    return rows.select(
        "instance_id", "problem_statement", "category", "difficulty", "gold_patch", F.array_join("tags", ",").alias("tags"),
        F.array_join("fail_to_pass_tests", ",").alias("tests"),
    )


def _instances(spark, sf):
    return S.order_instances(spark, sf).drop("o_orderkey", "o_custkey")


@query(READ_BACK)
def read_instance_list(spark, sf):
    path = sinks.export_json(_instances(spark, sf), new_path(spark, "list"))
    return _shown(readers.read_instances(spark, path))


@query(READ_BACK)
def read_instance_wrapper(spark, sf):
    path = sinks.export_json(_instances(spark, sf), new_path(spark, "wrapped"), {"name": "orders", "version": "1.0.0"})
    return _shown(readers.read_instances(spark, path))


@query(READ_BACK)
def read_split_list(spark, sf):
    path = sinks.export_json(_instances(spark, sf), new_path(spark, "list"))
    return _shown(readers.read_instances(spark, path, split=True))


@query(READ_BACK)
def read_split_wrapper(spark, sf):
    path = sinks.export_json(_instances(spark, sf), new_path(spark, "wrapped"), {"name": "orders", "version": "1.0.0"})
    return _shown(readers.read_instances(spark, path, split=True))


@query("SELECT 'name' AS setting, 'orders' AS value UNION ALL SELECT 'version', '1.0.0'")
def read_dataset_metadata(spark, sf):
    path = sinks.export_json(_instances(spark, sf), new_path(spark, "wrapped"), {"name": "orders", "version": "1.0.0"})
    return readers.read_dataset_metadata(spark, path).select(F.explode("metadata").alias("setting", "value")).distinct()


@query(READ_BACK)
def convert_json_to_jsonl(spark, sf):
    listed = sinks.export_json(_instances(spark, sf), new_path(spark, "list"))
    lines = sinks.export_jsonl(readers.read_instances(spark, listed).drop("file", "position"), new_path(spark, "lines") + ".jsonl")
    return _shown(readers.read_instances(spark, lines))


@query(ISSUES + "SELECT instance_id, arg_min(o_orderkey, o_orderkey) AS o_orderkey FROM issued WHERE issues = '' GROUP BY instance_id")
def load_valid_instances(spark, sf):
    """Read, drop invalid records, keep the first of each id in file order."""
    path = new_path(spark, "raw") + ".jsonl"
    S.order_raw(spark, sf).orderBy("o_orderkey").select(
        F.concat(F.lit('{"o_orderkey": '), "o_orderkey", F.lit(", "), F.substring("raw", 2, F.length("raw"))).alias("value")
    ).write.text(path)
    valid = ds.validate_instances(readers.read_raw_lines(spark, path)).where("is_valid")
    ids = valid.select(
        "file", "position", F.get_json_object("raw", "$.instance_id").alias("instance_id"),
        F.get_json_object("raw", "$.o_orderkey").cast("bigint").alias("o_orderkey"),
    )
    return ds.dedup_first(ids, ["file", "position"]).select("instance_id", "o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'P'")
def read_hub_split(spark, sf):
    """Of the splits dev and train, train is preferred."""
    path = new_path(spark, "hub")
    split = F.expr("CASE WHEN o_orderstatus = 'P' THEN 'train' ELSE 'dev' END")
    S.table(spark, sf, "orders").withColumn("split", split).write.partitionBy("split").parquet(path)
    return readers.read_hub_split(spark, path).select("o_orderkey", "o_custkey")


PREDICTED = EVALUATED + """SELECT run_id, instance_id, CASE WHEN o_totalprice > 400000 THEN NULL WHEN o_totalprice > 300000 THEN '' ELSE concat('--- a/', instance_id) END AS patch
    FROM runs WHERE has_prediction"""


@query(PREDICTED)
def read_predictions_map(spark, sf):
    named = S.predictions(spark, sf).withColumn("instance_id", F.concat("run_id", F.lit("/"), "instance_id"))
    rows = readers.read_predictions_map(spark, sinks.export_predictions_map(named, new_path(spark, "map")))
    parts = F.split("instance_id", "/")
    return rows.select(parts[0].alias("run_id"), parts[1].alias("instance_id"), "patch")


@query(PREDICTED)
def read_prediction_records(spark, sf):
    rows = S.predictions(spark, sf).withColumnRenamed("patch", "model_patch")
    return readers.read_predictions(spark, sinks.export_json(rows, new_path(spark, "records"))).select("run_id", "instance_id", "patch")


def _saved_results(spark, sf):
    """Results appended in two steps, as a resumed run leaves them."""
    rows = S.inference_rows(spark, sf).select("instance_id", "model", "input_tokens", "output_tokens", "latency_seconds", "success", "extracted_patch")
    path = new_path(spark, "results")
    sinks.append_results(rows.where("success"), path)
    return sinks.append_results(rows.where("NOT success"), path)


@query("SELECT concat('ev-', event_id) AS instance_id FROM events")
def read_processed_ids(spark, sf):
    return readers.read_processed_ids(spark, _saved_results(spark, sf))


@query(f"""SELECT concat('ev-', event_id) AS instance_id, ({S.MODEL_LIST})[user_id % 12 + 1] AS model_name_or_path,
    CASE event_type WHEN 'click' THEN '--- a/x' WHEN 'purchase' THEN '+++ b/x' WHEN 'view' THEN '' END AS patch FROM events""")
def results_as_predictions(spark, sf):
    return readers.results_as_predictions(readers.read_inference_results(spark, _saved_results(spark, sf)))


@query("SELECT count(*) AS lines, count(*) FILTER (WHERE event_type = 'error') AS corrupt, count(*) FILTER (WHERE event_type = 'view') AS without_id FROM events")
def corrupt_lines(spark, sf):
    path = new_path(spark, "lines")
    line = F.expr("""CASE event_type WHEN 'error' THEN concat('{"instance_id": "', event_id) WHEN 'view' THEN '{}' ELSE concat('{"instance_id": "', event_id, '"}') END""")
    S.table(spark, sf, "events").select(line.alias("value")).write.text(path)
    return readers.count_corrupt_lines(spark, path)


@query("SELECT p_partkey AS id, CASE WHEN p_type = 'SMALL' THEN 'feature' ELSE 'bug_fix' END AS category, concat(p_name, ' [', p_brand, ']') AS title FROM part")
def read_catalogue(spark, sf):
    path = new_path(spark, "catalogue")
    line = F.expr("concat(p_partkey, '. [', CASE WHEN p_type = 'SMALL' THEN 'Feature' ELSE 'Bug Fix' END, '] ', p_name, ' [', p_brand, ']\\n')")
    S.table(spark, sf, "part").select(line.alias("value")).write.text(path)
    return readers.read_catalogue(spark, path)


@query("SELECT p_partkey AS id, p_name AS title, p_brand AS area FROM part WHERE p_brand IN ('Brand#1', 'Brand#2')")
def read_and_select_tasks(spark, sf):
    rows = S.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("area"), F.lit("feature").alias("category")
    )
    tasks = readers.read_tasks(spark, sinks.export_json(rows, new_path(spark, "tasks")))
    return ds.select_tasks(tasks, areas=("Brand#1", "Brand#2"), categories=("feature",)).select("id", "title", "area")


@query(SUMMARIES + "SELECT s.run_id, s.total, s.resolved, count(*) AS listed, count(*) FILTER (WHERE e.status = 'error') AS listed_errors FROM summaries s JOIN evaluated e USING (run_id) GROUP BY ALL")
def saved_report(spark, sf):
    rows = evaluations(spark, sf)
    path = sinks.save_report(report_summary(rows), report_instances(rows, include_test_output=False), new_path(spark, "report"))
    summary, instances = readers.read_report_tables(spark, path)
    listed = instances.groupBy("run_id").agg(F.count(F.lit(1)).alias("listed"), F.count_if(F.col("status") == "error").alias("listed_errors"))
    return summary.join(listed, "run_id").select("run_id", "total", "resolved", "listed", "listed_errors")


@query(EVALUATED + "SELECT run_id, instance_id, status, CAST(duration AS VARCHAR) AS duration FROM evaluated")
def csv_export(spark, sf):
    rows = evaluations(spark, sf).select("run_id", "instance_id", "status", "duration")
    return spark.read.option("header", True).csv(sinks.export_csv(rows, new_path(spark, "csv")))


@query(EVALUATED + """SELECT concat('| ', run_id, ' | ', instance_id, ' | ', status, ' | ', coalesce(error_message, ''), ' |') AS value FROM evaluated
       UNION ALL SELECT unnest(['| run_id | instance_id | status | error_message |', '| --- | --- | --- | --- |'])""")
def markdown_export(spark, sf):
    rows = evaluations(spark, sf).select("run_id", "instance_id", "status", "error_message")
    path = sinks.export_markdown(rows, new_path(spark, "markdown"))
    return spark.read.text([f"{path}/header", f"{path}/rows"])


@query(EVALUATED + "SELECT run_id, count(*) AS rows FROM evaluated GROUP BY run_id")
def submission_package(spark, sf):
    rows = evaluations(spark, sf).select("run_id", "instance_id", "status")
    path = sinks.submission(rows, new_path(spark, "submission"), {"timeout": 300})
    stored = spark.read.parquet(path + "/results")
    # what was stored still adds up to the stored run checksums
    return sinks.run_checksums(stored).join(spark.read.parquet(path + "/checksums"), ["run_id", "rows", "run_checksum"]).select("run_id", "rows")


_NUMBER = "CAST(substr(instance_id, 5) AS BIGINT) % 97"


@query(EVALUATED + f"""SELECT run_id, instance_id, 'missing' AS status, 1 AS rows_before, 0 AS rows_after FROM evaluated WHERE {_NUMBER} = 1
       UNION ALL SELECT run_id, instance_id, 'changed', 1, 1 FROM evaluated WHERE {_NUMBER} = 2
       UNION ALL SELECT run_id, concat(instance_id, '-x'), 'extra', 0, 1 FROM evaluated WHERE {_NUMBER} = 3
       UNION ALL SELECT run_id, instance_id, 'extra', 0, 2 FROM evaluated WHERE {_NUMBER} = 4""")
def verify_package(spark, sf):
    """A copy with rows taken out, changed, added and repeated, held against the package."""
    rows = staged(evaluations(spark, sf).select("run_id", "instance_id", "status"), "evaluated")
    path = sinks.submission(rows, new_path(spark, "submission"), {"timeout": 300})
    number = F.pmod(F.substring("instance_id", 5, 20).cast("bigint"), F.lit(97))
    copy = rows.where(number != 1).withColumn("status", F.when(number == 2, "altered").otherwise(F.col("status")))
    copy = copy.unionByName(rows.where(number == 3).withColumn("instance_id", F.concat("instance_id", F.lit("-x"))))
    copy = copy.unionByName(rows.where(number == 4)).unionByName(rows.where(number == 4))
    return sinks.verify_submission(copy, path)


_DIGEST = "concat('{\"run_id\":\"', run_id, '\",\"instance_id\":\"', instance_id, '\",\"status\":\"', status, '\"}')"
_DEEP = 6


def _tree_sql() -> str:
    """The roots level by level, from the deepest that fits any part."""
    depth = " + ".join(f"CAST(count(*) OVER (PARTITION BY run_id) > {256 * 16**d} AS INT)" for d in range(_DEEP))
    parts = [f"entries AS (SELECT run_id, c, count(*) AS n FROM (SELECT run_id, sha256({_DIGEST}) AS c FROM evaluated) GROUP BY ALL)",
             f"deep AS (SELECT *, {depth} AS depth FROM entries)",
             """leaves AS (SELECT run_id, depth, substr(c, 1, depth) AS place, sum(n) AS rows, sha256(concat('rows:', string_agg(concat(c, ':', n), ',' ORDER BY c))) AS digest
                FROM deep GROUP BY ALL)""", f"level_{_DEEP + 1} AS (SELECT * FROM leaves WHERE false)"]  # fmt: skip
    for level in range(_DEEP, -1, -1):
        parts.append(f"""level_{level} AS (SELECT * FROM leaves WHERE depth = {level} UNION ALL
            SELECT run_id, depth, substr(place, 1, {level}), sum(rows), sha256(concat('ranges:', string_agg(concat(place, ':', digest), ',' ORDER BY place)))
            FROM level_{level + 1} GROUP BY run_id, depth, substr(place, 1, {level}))""")
    return EVALUATED.rstrip() + ", " + ", ".join(parts) + " SELECT run_id, CAST(rows AS BIGINT) AS rows, digest AS root FROM level_0"


@query(_tree_sql())
def package_roots(spark, sf):
    checked = sinks.row_checksums(evaluations(spark, sf).select("run_id", "instance_id", "status"))
    return roots(range_tree(checked)).select(F.get_json_object("part", "$.run_id").alias("run_id"), "rows", "root")


# --- streams ----------------------------------------------------------------------------


def _event_stream(spark, sf):
    schema = S.table(spark, sf, "events").schema
    return jobs.stream_files(spark, sf, schema, "parquet", pathGlobFilter="events.parquet")


def _calls(events):
    return events.select(
        F.expr("concat('run-', user_id % 5)").alias("run_id"), F.expr("concat('ev-', event_id)").alias("instance_id"), "user_id", "ts",
        F.expr(f"element_at({S.MODEL_ARRAY}, CAST(user_id % 12 + 1 AS INT))").alias("model"),
        F.expr("CAST(floor(value * 100) AS BIGINT)").alias("input_tokens"), F.expr("CAST(floor(value * 10) AS BIGINT)").alias("output_tokens"),
        F.col("value").alias("latency_seconds"), F.expr("event_type <> 'error'").alias("success"),
        F.expr("CASE event_type WHEN 'click' THEN '--- a/x' WHEN 'purchase' THEN '+++ b/x' END").alias("extracted_patch"),
    )


@query("SELECT DISTINCT concat('run-', user_id % 5) AS run_id, user_id FROM events")
def stream_unseen(spark, sf):
    out = new_path(spark, "stream")
    stream = _calls(_event_stream(spark, sf))
    jobs.append_unseen(stream, lambda df: df.select("run_id", "user_id"), out + "/data", out + "/checkpoint", keys=("run_id", "user_id")).awaitTermination()
    return spark.read.parquet(out + "/data")


@query(CALLS + f"SELECT run_id, {STATS_COLUMNS} FROM calls GROUP BY run_id")
def stream_running_stats(spark, sf):
    out = new_path(spark, "stream")
    jobs.running_stats(costs.cost_results(_calls(_event_stream(spark, sf))), out + "/data", out + "/checkpoint").awaitTermination()
    return jobs.running_totals(spark, out + "/data").withColumns(
        {"total_cost_usd": F.round("total_cost_usd", 8), "total_latency_seconds": F.round("total_latency_seconds", 3)}
    )


@query(f"WITH {S.COUNTS_SQL} SELECT run_id, instance_id, CASE WHEN f = 0 AND p > 0 THEN 'resolved' ELSE 'unresolved' END AS status FROM counted")
def stream_grades(spark, sf):
    out = new_path(spark, "stream")
    S.count_logs(spark, sf).select("run_id", "instance_id", "output").write.parquet(out + "/logs")
    logs = jobs.stream_files(spark, out + "/logs", "run_id string, instance_id string, output string", "parquet")
    jobs.grade_logs(logs, out + "/grades", out + "/checkpoint").awaitTermination()
    return jobs.merged_grades(spark, out + "/grades").select("run_id", "instance_id", "status")


@query(f"WITH {S.COUNTS_SQL} SELECT run_id, instance_id, CASE WHEN run_id = 'O' THEN 'unresolved' WHEN f = 0 AND p > 0 THEN 'resolved' ELSE 'unresolved' END AS status FROM counted")
def stream_regrades(spark, sf):
    """Logs of all instances, then new logs of one run: the later grades replace the earlier ones."""
    out = new_path(spark, "stream")
    logs = S.count_logs(spark, sf).select("run_id", "instance_id", "output")
    again = logs.where("run_id = 'O'").withColumn("output", F.lit("3 passed, 1 failed"))
    for arrived in (logs, again):
        arrived.write.mode("append").parquet(out + "/logs")
        stream = jobs.stream_files(spark, out + "/logs", "run_id string, instance_id string, output string", "parquet")
        jobs.grade_logs(stream, out + "/grades", out + "/checkpoint").awaitTermination()
    return jobs.merged_grades(spark, out + "/grades").select("run_id", "instance_id", "status")


WINDOWS = CALLS + """SELECT date_trunc('hour', ts) AS window_start, model, count(*) AS calls, round(sum(cost_usd), 8) AS cost_usd, round(sum(latency), 3) AS latency_seconds
    FROM calls GROUP BY ALL"""


def _rounded_windows(rows):
    return rows.withColumns({"cost_usd": F.round("cost_usd", 8), "latency_seconds": F.round("latency_seconds", 3)})


@query(WINDOWS)
def windowed_costs(spark, sf):
    return _rounded_windows(jobs.windowed_costs(costs.cost_results(S.inference_rows(spark, sf))))


@query(WINDOWS)
def stream_windowed_costs(spark, sf):
    """Four deliveries that each span the whole time, so that many rows come late; windows and late rows together."""
    out = new_path(spark, "stream")
    calls = costs.cost_results(S.inference_rows(spark, sf)).select("user_id", "ts", "model", "cost_usd", "latency_seconds")
    calls = staged(calls, "calls")
    for k in range(4):
        calls.where(F.pmod(F.xxhash64("user_id"), F.lit(4)) == k).drop("user_id").write.mode("append").parquet(out + "/in")
        stream = jobs.stream_files(spark, out + "/in", calls.drop("user_id").schema, "parquet")
        jobs.stream_windowed_costs(stream, out + "/costs", out + "/checkpoint").awaitTermination()
    late = jobs.windowed_costs(jobs.late_rows(spark, out + "/costs"))
    both = keyed_store.current(spark, out + "/costs/windows").unionByName(late)
    return _rounded_windows(both.groupBy("window_start", "model").agg(*[F.sum(c).alias(c) for c in ("calls", "cost_usd", "latency_seconds")]))


def _report_parts(spark, sf):
    rows = staged(evaluations(spark, sf).drop("output"), "evaluations")
    instances = report_instances(rows, include_test_output=False)
    return readers.read_report_parts(spark, sinks.export_report_json(report_summary(rows), instances, new_path(spark, "report"), "F", {"by": "F"}, "now"))


@query(EVALUATED + """SELECT instance_id, status, patch_applied, passed AS tests_passed, failed AS tests_failed, skipped AS tests_skipped, passed + failed + skipped AS tests_total,
       duration, error_message FROM evaluated WHERE run_id = 'F'""")
def report_document_instances(spark, sf):
    return _report_parts(spark, sf)[1].drop("test_output")


@query(SUMMARIES + """SELECT total, resolved, unresolved, errors, skipped, round(resolved_rate, 9) AS resolved_rate, round(total_duration, 6) AS total_duration, 'now' AS "timestamp", 'F' AS by_run
    FROM summaries WHERE run_id = 'F'""")
def report_document_summary(spark, sf):
    head = _report_parts(spark, sf)[0]
    return head.select(
        "total", "resolved", "unresolved", "errors", "skipped", F.round("resolved_rate", 9).alias("resolved_rate"),
        F.round("total_duration", 6).alias("total_duration"), "timestamp", F.col("config")["by"].alias("by_run"),
    )
