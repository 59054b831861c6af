"""Reports, comparisons, ranks, dataset validation, filters and lookups."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import rows
from patcheval.functions import text as tx
from patcheval.functions.keyed import competition_rank, first_per_key, last_per_key, salted_semi
from patcheval.operators import dataset as ds
from patcheval.operators import reports

EVAL = "run_id string, instance_id string, status string, duration double, passed bigint, failed bigint, skipped bigint, total bigint, error_message string, output string"


def evaluations(spark):
    data = [
        ("a", "1", "resolved", 2.0, 3, 0, 0, 3, None, "x" * 11),
        ("a", "2", "unresolved", 4.0, 1, 1, 0, 2, None, "short"),
        ("a", "3", "error", 6.0, 0, 0, 0, 0, "e" * 61, None),
        ("a", "4", "skipped", 0.0, 0, 0, 0, 0, "No prediction provided", ""),
        ("b", "1", "error", 1.0, 0, 0, 0, 0, "e", None),
        ("b", "2", "resolved", 1.0, 1, 0, 0, 1, None, None),
        ("b", "3", "error", 1.0, 0, 0, 0, 0, "e", None),
        ("b", "9", "pending", 1.0, 0, 0, 0, 0, None, None),
    ]
    return spark.createDataFrame(data, EVAL)


def test_summary(spark):
    got = {r.run_id: r for r in reports.report_summary(evaluations(spark)).collect()}
    a, b = got["a"], got["b"]
    assert (a.total, a.resolved, a.unresolved, a.errors, a.skipped) == (4, 1, 1, 1, 1)
    assert (a.resolved_rate, a.avg_duration, a.total_duration, a.verdict) == (1 / 3, 3.0, 12.0, 2)
    # pending rows count in the total only
    assert (b.total, b.resolved, b.errors, b.skipped, b.resolved_rate) == (4, 1, 2, 0, 0.25)
    only_skipped = evaluations(spark).where("status = 'skipped'")
    assert reports.report_summary(only_skipped).first().resolved_rate == 0.0


def test_instances_and_truncation(spark):
    df = reports.report_instances(evaluations(spark), max_output_length=5).where("run_id = 'a'")
    mark = "\n... [truncated] ...\n"
    assert [r.test_output for r in df.orderBy("instance_id").collect()] == ["xx" + mark + "xxx", "short", None, None]
    none = reports.report_instances(evaluations(spark), include_test_output=False)
    assert none.where("test_output is not null").count() == 0
    whole = spark.range(1).select(tx.truncate_log(F.lit("abcdef"), 4).alias("a"), tx.truncate_log(F.lit("ab"), 0).alias("b")).first()
    assert whole == ("ab" + mark + "ef", mark + "ab")


def test_compare(spark):
    df = evaluations(spark)
    changes = reports.status_changes(df.where("run_id = 'a'"), df.where("run_id = 'b'"))
    assert rows(changes.select("instance_id", "change"), "instance_id") == [("1", "regression"), ("2", "improvement"), ("3", "unchanged")]
    both = reports.status_changes(df.where("run_id = 'a'"), df.where("run_id = 'b'"), keep_one_sided=True)
    assert rows(both.select("instance_id", "change"), "instance_id")[3:] == [("4", "only_in_base"), ("9", "only_in_other")]
    one = reports.comparison(reports.report_summary(df), changes, "a", "b").first()
    assert (one.total_base, one.total_other, one.improvements, one.regressions, one.unchanged_count) == (4, 4, 1, 1, 1)
    assert one.resolved_rate_diff == 0.25 - 1 / 3
    text = [r.line for r in reports.comparison_text(reports.comparison(reports.report_summary(df), changes, "a", "b"), changes, "a", "b").orderBy("part", "instance_id", "sub").collect()]
    assert "Resolved Rate: 33.3% -> 25.0% (-8.3%)" in text and "  2: unresolved -> resolved" in text


def test_report_text(spark):
    df = evaluations(spark).where("run_id = 'a'")
    text = reports.report_text(reports.report_summary(df), reports.report_instances(df), "REPORT")
    lines = [r.line for r in text.orderBy("part", "status", "instance_id", "sub").collect()]
    assert lines[8:10] == ["  Total Instances:    4", "  Resolved:           1 (33.3%)"]
    details = lines[lines.index("INSTANCE DETAILS") + 2 : -1]
    assert details == [
        "  [ERR ] 3", "           Error: " + "e" * 60 + "...", "           Duration: 6.00s",
        "  [PASS] 1", "           Tests: 3 passed, 0 failed, 0 skipped", "           Duration: 2.00s",
        "  [SKIP] 4", "           Error: No prediction provided", "           Duration: 0.00s",
        "  [FAIL] 2", "           Tests: 1 passed, 1 failed, 0 skipped", "           Duration: 4.00s",
    ]


def test_evaluation_text(spark):
    grades = spark.createDataFrame(
        [("r", "i", "partial", 1, 2, 0, 1, 1500.0, "Parse warnings: w")],
        "run_id string, instance_id string, resolved string, fail_to_pass_passed bigint, fail_to_pass_total bigint, pass_to_pass_passed bigint, pass_to_pass_total bigint, total_duration_ms double, error string",
    )
    details = spark.createDataFrame(
        [("r", "i", "fail_to_pass", 0, "a", "passed", None), ("r", "i", "fail_to_pass", 1, "b", "failed", "boom"), ("r", "i", "pass_to_pass", 0, "c", "skipped", None)],
        "run_id string, instance_id string, category string, ord bigint, name string, status string, error_message string",
    )
    lines = [r.line for r in reports.evaluation_text(grades, details).orderBy("part", "ord", "sub").collect()]
    assert lines == [
        "Instance: i", "Resolution: PARTIAL", "", "FAIL_TO_PASS: 1/2 passed", "PASS_TO_PASS: 0/1 passed", "Duration: 1.50s", "Error: Parse warnings: w",
        "", "Failed FAIL_TO_PASS tests:", "  - b: failed", "    Error: boom",
        "", "Failed PASS_TO_PASS tests (regressions):", "  - c: skipped",
    ]


def test_rank_like_brute_force(spark):
    rng = random.Random(3)
    values = [rng.choice([0.0, 1.0, 0.5, rng.random(), rng.randint(0, 7) / 7]) for _ in range(500)]
    df = spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "id string, resolved_rate double")
    got = {r.id: r.rank for r in competition_rank(df, "resolved_rate", buckets=16).collect()}
    assert got == {str(i): 1 + sum(o > v for o in values) for i, v in enumerate(values)}


def test_attempt_numbers_by_chunk(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([("r", str(rng.randint(0, 2)), rng.randint(0, 10**6), i) for i in range(600)], "run_id string, instance_id string, ts bigint, id bigint")
    plain = reports.numbered_attempts(df, order=("ts", "id"))
    chunked = reports.numbered_attempts(df, order=("ts", "id"), chunk="ts div 50000")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, chunked.select(plain.columns).collect()))
    last = {(r.instance_id): (r.iterations, r.id) for r in reports.final_attempts(df, order=("ts", "id")).collect()}
    assert last == {r.instance_id: (r.attempt, r.id) for r in last_per_key(plain, ["instance_id"], ["attempt"]).collect()}


def test_first_per_key_limits_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    first = first_per_key(df, ["k"], ["id"])
    assert rows(first, "k") == [(0, 0), (1, 1), (2, 2)]
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()
    kept = salted_semi(df, spark.createDataFrame([(1,)], "k bigint"), ["k"], "id")
    assert kept.count() == 333


# --- dataset ----------------------------------------------------------------------------

VALID = {"instance_id": "ab-1", "problem_statement": "p", "category": "bug_fix"}


@pytest.mark.parametrize("strict", [False, True])
def test_instance_issues(spark, strict):
    cases = [
        (VALID, []),
        ({**VALID, "instance_id": "AB-12"}, []),
        ({**VALID, "instance_id": "Ab 1"}, ["invalid_instance_id"]),
        ({**VALID, "instance_id": "BUG-1a2b3c4d"}, ["invalid_instance_id"]),
        ({**VALID, "instance_id": ""}, ["missing_required:instance_id"]),
        ({"instance_id": "a", "category": None}, ["missing_required:category", "missing_required:problem_statement"]),
        ({**VALID, "category": "x"}, ["invalid_category"]),
        ({**VALID, "difficulty": ""}, ["invalid_difficulty"]),
        ({**VALID, "difficulty": None}, ["invalid_difficulty"]),
        ({**VALID, "difficulty": "expert"}, []),
        ({**VALID, "tags": "x", "hints": None}, ["not_a_list:tags"]),
        ({**VALID, "gold_patch": "text", "fail_to_pass_tests": []}, []),
        ({**VALID, "gold_patch": "@@ -1", "fail_to_pass_tests": ["t"]}, []),
    ]
    extra = {11: ["missing_evaluation:fail_to_pass_tests", "gold_patch_not_a_diff"], 12: []}
    neither = ["missing_evaluation:fail_to_pass_tests", "missing_evaluation:gold_patch"]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, raw string")
    for r in ds.validate_instances(df, strict=strict).collect():
        want = set(cases[r.i][1]) | (set(extra.get(r.i, neither)) if strict else set())
        assert set(r.issues) == want, cases[r.i]
        assert r.is_valid == (not want)


def test_generated_ids_can_be_accepted(spark):
    df = spark.createDataFrame([(json.dumps({**VALID, "instance_id": "BUG-1a2b3c4d"}),)], "raw string")
    assert ds.validate_instances(df, accept_generated_ids=True).first().is_valid
    assert ds.validate_instances(spark.createDataFrame([("[1",)], "raw string")).first().issues[0] == "not_an_object"


def test_grading_field_issues(spark):
    ok = {"instance_id": "a", "repo": "r", "base_commit": "c", "problem_statement": "p", "FAIL_TO_PASS": ["t"], "PASS_TO_PASS": []}
    cases = [
        (ok, []),
        ({k: v for k, v in ok.items() if k != "instance_id"}, ["Missing required field: instance_id"]),
        ({**ok, "FAIL_TO_PASS": "t"}, ["FAIL_TO_PASS must be a list"]),
        ({**ok, "FAIL_TO_PASS": None}, ["FAIL_TO_PASS must be a list"]),
        ({**ok, "FAIL_TO_PASS": []}, ["FAIL_TO_PASS must not be empty"]),
        ({**ok, "instance_id": 7, "repo": None}, ["instance_id must be a string"]),
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, raw string")
    assert [r.issues for r in ds.validate_grading_fields(df).orderBy("i").collect()] == [w for _, w in cases]


def test_filters_and_tasks(spark):
    data = [("a", "bug_fix", "easy", ["x"], "p"), ("b", "feature", "easy", ["y"], ""), ("c", "bug_fix", "hard", ["x", "y"], None)]
    df = spark.createDataFrame(data, "instance_id string, category string, difficulty string, tags array<string>, gold_patch string")

    def ids(**options):
        return [r.instance_id for r in ds.filter_instances(df, **options).orderBy("instance_id").collect()]

    assert ids() == ids(category="", tags=[]) == ["a", "b", "c"]
    assert ids(category="bug_fix") == ["a", "c"] and ids(tags=["y", "z"]) == ["b", "c"]
    assert ids(has_gold_patch=True) == ["a"] and ids(has_gold_patch=False) == ["b", "c"]
    assert ds.lookup(df, "b").count() == 1 and ds.lookup(df, "q").count() == 0
    canonical = ds.canonical_instances(df.drop("difficulty"), default_repo="x/y").first()
    assert canonical.difficulty == "medium" and canonical.repo == "x/y" and canonical.hints == []


def test_text_functions(spark):
    def value(col):
        return spark.range(1).select(col.alias("v")).first().v

    assert value(tx.is_test_file(F.lit("src/a/b.test.ts"))) and value(tx.is_test_file(F.lit("tests/x.js")))
    assert value(tx.is_test_file(F.lit("pkg/__tests__/x.ts"))) and not value(tx.is_test_file(F.lit("src/latest/x.ts")))
    assert value(tx.looks_like_diff(F.lit("x\nIndex: a"))) and not value(tx.is_valid_patch(F.lit("x\nIndex: a")))
    assert value(tx.is_diff_line(F.lit("\\ No newline at end"))) and not value(tx.is_diff_line(F.lit("hello")))
    assert value(ds.runtime_version(F.lit("2026-07"))) == "1.1.17" and value(ds.runtime_version(F.lit("2026"))) == "1.1.0"
    assert value(ds.component_of(F.lit("The HTTP server drops a request"))) == "http_server"
    assert value(ds.component_of(F.lit("use $ and node:fs"))) in ("shell", "node_compat", "file_system")
    assert value(ds.component_of(F.lit("latest éit"))) == "other"
    assert value(tx.has_valid_id_format(F.lit("ab\n"))) is False
    assert value(tx.test_file_of(F.lit("a::b"))) == "a" and value(tx.test_name_of(F.lit("b"))) == "b"
    assert value(tx.percent(F.lit(0.5))) == "50.0%"
