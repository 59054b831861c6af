"""Log parsers: worked examples, and a random comparison with whole-text patterns."""

from __future__ import annotations

import random
import re

import pytest

from conftest import rows
from patcheval.operators import count_logs as counts
from patcheval.operators import file_logs as files
from patcheval.operators import named_logs as named

LOG = "run_id string, instance_id string, output string"

GLYPHS = "✓ alpha [1.5ms]\n✗ beta [2s]\n  Error: boom\n  at x.ts:1\n○ gamma (skipped)\n"
FILE_LOG = """runner v1

test/io/read.test.ts:
  reads a file ... [PASS] (1.5ms)
  reads an empty file ... [PASS] (2ms)
  rejects a missing file ... [FAIL] (3.25ms)
    at read (read.ts:10)
    Error: expected ENOENT
    Error: second message

test/io/write.test.ts:
  writes a file ... [PASS] (0.5ms)
  appends ... [PASS] (1ms)
  locks ... [SKIP] (0ms)
  writes twice ... [PASS] (1ms)
  syncs ... [PASS] (1ms)

 8 pass
 1 fail
 1 skip
 10 expect() calls
Ran 10 tests in 32.06ms
"""


def logs(spark, *outputs):
    return spark.createDataFrame([("r", str(i), o) for i, o in enumerate(outputs)], LOG)


def named_rows(spark, output):
    df = named.named_test_results(logs(spark, output))
    return [r[3:] for r in rows(df, "position")]


def test_named_golden(spark):
    assert named_rows(spark, GLYPHS + "1 pass, 1 fail") == [
        ("alpha", "passed", 1.5, None, None),
        ("beta", "failed", 2.0, "Error: boom", "at x.ts:1"),
        ("gamma", "skipped", None, None, None),
    ]


def test_named_pass_wins_and_summary_disagrees(spark):
    log = GLYPHS + "✓ beta\n1 pass, 1 fail"
    assert named_rows(spark, log) == [
        ("alpha", "passed", 1.5, None, None),
        ("beta", "passed", None, None, None),
        ("gamma", "skipped", None, None, None),
    ]
    summary = named.named_log_summary(logs(spark, log)).first()
    assert (summary.total, summary.passed, summary.failed, summary.skipped) == (3, 2, 0, 1)
    assert summary.parse_errors == [
        "Parsed 2 passed tests, but summary shows 1",
        "Parsed 0 failed tests, but summary shows 1",
    ]


@pytest.mark.parametrize(
    "log, want",
    [
        ("✔ a\n✓ a [3ms]", [("a", "passed", None, None, None)]),
        ("✗ x [bug]\n  why\n", [("x [bug]", "failed", None, None, None)]),
        ("✗ a [1.2.3ms]\n", [("a", "failed", 0.0, None, None)]),
        ("  ✗ a\n  ✗ b\n    why\n", [("a", "failed", None, "✗ b", "why"), ("b", "failed", None, None, None)]),
        ("✗ a\n\nloose text\n  more\nend\n", [("a", "failed", None, "loose text", "more")]),
        ("✗ a\nend\n  more\n", [("a", "failed", None, None, None)]),
        ("✗ a\n  one\n✗ a\n  two\n  deep\n", [("a", "failed", None, "two", "deep")]),
        ("one ... pass [2ms]\nTWO .... FAILED\n", [("one", "passed", 2.0, None, None), ("TWO", "failed", None, None, None)]),
        ("one ... pass\n✓ two\n", [("two", "passed", None, None, None)]),
        ("✓ d x\n", [("d x", "passed", None, None, None)]),
        ("○ (skipped)\n", [("(skipped)", "skipped", None, None, None)]),
        ("✓   \n", []),
        ("✓ a [5ms]\r\n✓ b\r\n", [("a [5ms]", "passed", None, None, None), ("b", "passed", None, None, None)]),
    ],
)
def test_named_edges(spark, log, want):
    assert named_rows(spark, log) == want


def test_named_empty_and_durations(spark):
    df = named.named_log_summary(logs(spark, "", " \n ", "Total time: 2 s", "duration 3m", "time: 1.2.3ms", "none"))
    got = [(r.total_duration_ms, r.parse_errors) for r in df.orderBy("instance_id").collect()]
    empty = ["Empty output received"]
    assert got == [(None, empty), (None, empty), (2000.0, []), (180000.0, []), (0.0, []), (None, [])]


def test_file_log_has_no_named_tests(spark):
    assert named_rows(spark, FILE_LOG) == []


def test_named_views(spark):
    results = named.named_test_results(logs(spark, GLYPHS))
    assert [r[3] for r in rows(named.test_names(results), "position")] == ["alpha", "beta", "gamma"]
    assert [r[3] for r in rows(named.names_with_status(results, "failed"), "position")] == ["beta"]
    assert named.failed_details(results).first().error_message == "Error: boom"
    assert named.status_maps(results).first().statuses == {"alpha": "passed", "beta": "failed", "gamma": "skipped"}


BLOCK = re.compile(r"^[\s]*[✗✘×][\s]+(.+?)(?:\s+\[.*?\])?\n((?:[\s]+.+\n?)+)", re.MULTILINE)


def _random_log(rng):
    lines = []
    for _ in range(rng.randint(1, 14)):
        name = rng.choice(["a", "b", "c d", "e"])
        pad = rng.choice(["", "", "  "])
        lines.append(
            rng.choice(
                [
                    f"{pad}✓ {name}", f"{pad}✗ {name}", f"{pad}✗ {name} [4ms]", f"{pad}○ {name} (skipped)",
                    "  Error: x", "    at y", "", "   ", "text", f"  tail {rng.randint(0, 9)}",
                ]
            )
        )
    return "\n".join(lines) + rng.choice(["", "\n"])


def test_error_blocks_like_whole_text_pattern(spark):
    rng = random.Random(7)
    texts = [_random_log(rng) for _ in range(400)]
    df = named.named_test_results(logs(spark, *texts)).where("status = 'failed'")
    got = {(int(r.instance_id), r.name): (r.error_message, r.stack_trace) for r in df.collect()}
    compared = 0
    for i, text in enumerate(texts):
        message, stack = {}, {}
        for name, block in BLOCK.findall(text):
            lines = [x.strip() for x in block.split("\n") if x.strip()]
            if lines:
                message[name.strip()] = lines[0]
                if len(lines) > 1:
                    stack[name.strip()] = "\n".join(lines[1:])
        for (j, name), (m, s) in got.items():
            if j == i:
                compared += 1
                assert (m, s) == (message.get(name), stack.get(name)), text
    assert compared > 200


def test_long_error_block(spark):
    log = "✗ big\n" + "".join(f"  line {i}\n" for i in range(20000)) + "end"
    row = named.named_test_results(logs(spark, log)).first()
    assert row.error_message == "line 0" and row.stack_trace.count("\n") == 19998


def test_file_results_golden(spark):
    got = [r[3:] for r in rows(files.file_test_results(logs(spark, FILE_LOG)), "position")]
    assert [(r[0], r[1], r[2]) for r in got][:3] == [
        ("test/io/read.test.ts", "reads a file", "PASS"),
        ("test/io/read.test.ts", "reads an empty file", "PASS"),
        ("test/io/read.test.ts", "rejects a missing file", "FAIL"),
    ]
    assert got[2][3:] == (3.25, "expected ENOENT")
    assert [r[0] for r in got[3:]] == ["test/io/write.test.ts"] * 5
    by_status = {s: sum(r[2] == s for r in got) for s in ("PASS", "FAIL", "SKIP")}
    assert by_status == {"PASS": 6, "FAIL": 1, "SKIP": 1}


def test_file_summary_golden(spark):
    r = files.file_log_summary(logs(spark, FILE_LOG)).first()
    assert (r.passed, r.failed, r.skipped, r.total, r.pass_rate) == (8, 1, 1, 10, 0.8)
    assert (r.expect_calls, r.total_duration_ms) == (10, 32.06)
    e = files.file_log_summary(logs(spark, "")).first()
    assert (e.total, e.pass_rate, e.expect_calls, e.total_duration_ms) == (0, 0.0, 0, 0.0)


@pytest.mark.parametrize(
    "log, want",
    [
        ("  loose ... [PASS] (1ms)\n", [(None, "loose", "PASS", None)]),
        ("test/a.test.ts:\nno indent ... [PASS] (1ms)\n", []),
        (" test/a.test.ts:\n  x ... [PASS] (1ms)\n", [(None, "x", "PASS", None)]),
        ("test/a.test.ts: \n  x ... [PASS] (1ms)\n", [(None, "x", "PASS", None)]),
        ("test/a.test.ts:\n  x ... [FAIL] (1ms)\ntest/b.test.ts:\n  Error: late\n", [("test/a.test.ts", "x", "FAIL", None)]),
        ("  x ... [FAIL] (1ms)\n  y ... [FAIL] (1ms)\n  Error: of y\n", [(None, "x", "FAIL", None), (None, "y", "FAIL", "of y")]),
        ("  x ... [PASS] (1ms)\n  Error: ignored\n", [(None, "x", "PASS", None)]),
    ],
)
def test_file_edges(spark, log, want):
    got = [(r.file_path, r.name, r.status, r.error_message) for r in files.file_test_results(logs(spark, log)).orderBy("position").collect()]
    assert got == want


@pytest.mark.parametrize(
    "log, want",
    [
        (FILE_LOG, (8, 1, 1, 10)),
        ('noise {"passed":3,"failed":0} noise', (3, 0, 0, 3)),
        ('{"passed": 3, "total": 9}', (3, 0, 0, 9)),
        ("{}", (0, 0, 0, 0)),
        ("{broken} 3 passed", (3, 0, 0, 3)),
        ("3 passed\n5 passed 4 passed\n", (5, 0, 0, 5)),
        ("x3 passed 2 Failed, 7 (skipped)", (0, 2, 7, 9)),
        ("} 1 pass {", (1, 0, 0, 1)),
        ("", (0, 0, 0, 0)),
    ],
)
def test_counts(spark, log, want):
    r = counts.count_logs(logs(spark, log)).first()
    assert (r.passed, r.failed, r.skipped, r.total) == want
