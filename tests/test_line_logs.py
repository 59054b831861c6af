"""Logs as lines in ranges against the same logs as cells; dense positions."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from patcheval.functions.positions import positions
from patcheval.operators import file_logs, line_logs

LOG = "run_id string, instance_id string, output string"


def random_log(r):
    lines = []
    for _ in range(r.randint(0, 40)):
        n = r.randint(0, 9)
        lines.append(r.choice([
            f"test/a{n}.test.ts:", f"  case {n} ... [PASS] (1.5ms)", f"  case {n} ... [FAIL] (2ms)", f"\tcase  {n} ... [SKIP] (0.25ms) x",
            f"  Error: bad {n}", "    at x", "", "  ", " 3 pass", " 4 fail", "  5 skip", f"{n} expect() calls", f"Ran {n} tests in {n}.5ms", "test/b.test.ts: no",
        ]))
    if r.random() < 0.5:
        lines[r.randint(0, len(lines)) :] = [" 7 pass", "", " 1 fail ", "2 skip", "9 expect() calls"]
    return "\n".join(lines)


@pytest.mark.parametrize("size", [1, 3, 100])
def test_ranges_of_any_size(spark, size):
    r = random.Random(size)
    logs = spark.createDataFrame([("r", f"i{i}", random_log(r)) for i in range(60)], LOG)
    lines = line_logs.lines_of_cells(logs, size=size)
    columns = ["run_id", "instance_id", "position", "file_path", "name", "status", "duration_ms", "error_message"]
    got, want = (Counter(tuple(x) for x in df.select(*columns).collect()) for df in (line_logs.file_test_results(lines), file_logs.file_test_results(logs)))
    assert got == want and len(want) > 100
    got, want = (Counter(tuple(x) for x in df.select(sorted(df.columns)).collect()) for df in (line_logs.file_log_summary(lines), file_logs.file_log_summary(logs)))
    assert got == want


def test_log_files_by_lines(spark, tmp_path):
    folder = tmp_path / "run1"
    folder.mkdir()
    (folder / "a.stdout").write_text("test/a.test.ts:\n  x ... [FAIL] (1ms)\n")
    (folder / "a.stderr").write_text("  Error: late\n  y ... [PASS] (2ms)\n 1 pass\n 1 fail\n 0 skip\n")
    lines = line_logs.read_log_lines(spark, str(folder))
    got = line_logs.file_test_results(lines).orderBy("position").collect()
    assert [(x.run_id, x.instance_id, x.file_path, x.name, x.status, x.error_message) for x in got] == [
        ("run1", "a", "test/a.test.ts", "x", "FAIL", "late"), ("run1", "a", "test/a.test.ts", "y", "PASS", None)
    ]
    s = line_logs.file_log_summary(lines).first()
    assert (s.passed, s.failed, s.skipped, s.total, s.pass_rate) == (1, 1, 0, 2, 0.5)


def test_positions(spark):
    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", "hot", "a", None]), r.choice([None, *range(30)]), r.randint(0, 5)) for _ in range(2000)] + [("hot", 7, 7)] * 700
    df = spark.createDataFrame(rows, "k string, x int, y int")
    got = positions(df, ["k"], ["x", F.desc("y")]).collect()
    groups = {}
    for k, x, y in rows:
        groups.setdefault(k, []).append((x is not None, x or 0, -y, x, y))
    for k, listed in groups.items():
        mine = sorted((g for g in got if g.k == k), key=lambda g: g.position)
        assert [g.position for g in mine] == list(range(len(listed))) and {g.group_size for g in mine} == {len(listed)}
        assert [(g.x, g.y) for g in mine] == [t[3:] for t in sorted(listed, key=lambda t: t[:3])]
    whole = positions(df.select("x"), [], ["x"], out="n").collect()
    assert sorted(g.n for g in whole) == list(range(len(rows)))
    assert positions(df.limit(0), ["k"], ["x"]).count() == 0
