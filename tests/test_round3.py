"""Steps that repeated work or held too much: what they give, and how often they do it."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from patcheval.functions.stage import spread
from patcheval.operators import dataset as ds
from patcheval.operators import file_logs, matching
from patcheval.plans.evaluate import evaluate_named
from patcheval.sources import range_tree as rt


def test_filter_on_issues_parses_a_text_once(spark):
    texts = ['{"instance_id": "a-1", "problem_statement": "p", "category": "bug_fix"}', '{"instance_id": "A b", "category": "x", "tags": 7}', "[1", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, raw string")
    checked = ds.validate_instances(df)
    got = {r.i: list(r.issues) for r in ds.invalid_instances(checked).collect()}
    assert sorted(got) == [1, 2, 3] and got[1] == ["missing_required:problem_statement", "invalid_category", "invalid_instance_id", "not_a_list:tags"]
    assert [r.i for r in checked.where("is_valid").collect()] == [0]
    plain, filtered = (len(re.findall("from_json", d._jdf.queryExecution().optimizedPlan().toString())) for d in (checked, ds.invalid_instances(checked)))
    assert filtered == plain


def test_small_and_large_runs_match_alike(spark, monkeypatch):
    names = ["alpha beta", "Alpha  Beta", 'test "alpha beta"', "beta", "gamma delta eps", "delta eps gamma zeta", "", "eta", None, "x alpha beta y"]
    expected = [(r, "i", c, o, n) for r in ("r1", "r2", None) for c, o, n in [("fail_to_pass", k, n) for k, n in enumerate(names)] + [("pass_to_pass", 0, "no such")] * 2]
    actual = [(r, "i", k, n, s) for r, some in (("r1", names[3:6] + ["ALPHA BETA", "zeta"]), ("r2", ["one two", "Beta"]), (None, ["beta"]))
              for k, (n, s) in enumerate(zip(some, ("passed", "failed", "skipped", "passed", "failed"), strict=False))]
    wanted = spark.createDataFrame(expected, "run_id string, instance_id string, category string, ord long, name string")
    results = spark.createDataFrame(actual, "run_id string, instance_id string, position long, name string, status string")
    for tiers in (matching.TIERS, ("exact", "normalised")):
        got = []
        for small in (32, 4, 0):
            monkeypatch.setattr(matching, "SMALL", small)
            got.append(sorted(map(repr, matching.match_expected(wanted, results, tiers=tiers).collect())))
        assert got[0] == got[1] == got[2] and len(got[0]) == 3 * 11


def test_digests_are_kept_as_bytes(spark):
    plain, other = "0f" * 32, "No Digest"
    rows = spark.createDataFrame([("r", plain), ("r", other), ("r", other)], "run_id string, checksum string")
    entries = rt._entries(rows, ("run_id",), "checksum")
    assert dict(entries.dtypes)["checksum"] == "binary"
    assert {(r.c, r.n) for r in entries.select(rt._unpacked(entries.checksum).alias("c"), "n").collect()} == {(plain, 1), (other, 2)}
    want = hashlib.sha256(f"rows:{plain}:1,{other}:2".encode()).hexdigest()
    assert [r.root for r in rt.roots(rt.range_tree(rows)).collect()] == [want]


def test_few_row_groups_are_dealt_out(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(20_000).selectExpr("id", "sha2(CAST(id AS STRING), 256) AS text").coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 20_000)
    try:
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() > 8  # one of them holds all rows
        dealt = spread(scan).groupBy(F.spark_partition_id()).count().collect()
        assert len(dealt) > 8 and sum(r["count"] for r in dealt) == 20_000
        even = spark.range(800)
        assert spread(even) is even
        assert spread(spark.range(0, 0, 1, 9)).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_log_is_searched_once(spark):
    logs = spark.createDataFrame(
        [("r", "a", "test/a.test.ts:\n  x  ... [PASS] (1ms)\n  a\x01b \xa0... y\xa0... [FAIL] (2.5ms) z\n   Error: e\x01\x02\n\n  n... [PASS] (1ms)\n 3 pass\n 1 fail\n 0 skip\n"), ("r", "b", None), ("r", "c", "")],
        "run_id string, instance_id string, output string",
    )
    results = file_logs.file_test_results(logs)
    got = sorted(tuple(r)[2:] for r in results.collect())
    at = 1 << 31
    assert got == [(at + 1, "test/a.test.ts", "x", "PASS", 1.0, None), (at + 2, "test/a.test.ts", "a\x01b \xa0... y", "FAIL", 2.5, "e\x01\x02")]
    assert _plan(results).count("PASS|FAIL|SKIP") == 1
    summary = file_logs.file_log_summary(logs)
    assert {r.instance_id: (r.passed, r.failed, r.skipped) for r in summary.collect()} == {"a": (3, 1, 0), "b": (0, 0, 0), "c": (0, 0, 0)}


def test_named_logs_are_read_once(spark):
    logs = spark.createDataFrame([("r", "a", "✓ x\n✗ y\n  Error: e\n3 pass, 1 fail"), ("r", "b", "")], "run_id string, instance_id string, output string")
    wanted = spark.createDataFrame([("r", "a", "fail_to_pass", 0, "x")], "run_id string, instance_id string, category string, ord long, name string")
    grades, details = evaluate_named(wanted, logs)
    got = {r.instance_id: (r.resolved, r.error) for r in grades.collect()}
    assert got == {"a": ("full", "Parse warnings: Parsed 1 passed tests, but summary shows 3"), "b": ("full", "Parse warnings: Empty output received")}
    assert [(r.name, r.status) for r in details.collect()] == [("x", "passed")]
    assert "✓" not in _plan(grades) and "✓" not in _plan(details)  # patterns of log lines: read before, into a stage


def test_expected_names_are_normalised_once(spark):
    wanted = spark.createDataFrame([("r", "i", "fail_to_pass", 0, " Test X")], "run_id string, instance_id string, category string, ord long, name string")
    actual = spark.createDataFrame([("r", "i", 0, "x", "passed", 1.0, "e", "s")], "run_id string, instance_id string, position long, name string, status string, duration_ms double, error_message string, stack_trace string")
    details = matching.detail_results(matching.match_expected(wanted, actual, tiers=("exact", "normalised")), actual)
    assert [(r.name, r.status) for r in details.collect()] == [("x", "passed")]
    steps = _plan(details.select("name", "status")).split("Project ")
    assert sum("array_min(" in s for s in steps) == 1 and not [s for s in steps if "array_min(" in s and "translate(" in s]
