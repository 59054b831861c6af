"""Matching against brute force on random names, and the three grading rules."""

from __future__ import annotations

import random

import pytest

from conftest import rows
from patcheval.operators import file_logs, grading, matching
from patcheval.plans.evaluate import evaluate_counts, evaluate_files, evaluate_named
from test_logs import FILE_LOG, GLYPHS, LOG

EXPECTED = "run_id string, instance_id string, category string, ord bigint, name string"
ACTUAL = "run_id string, instance_id string, position bigint, name string, status string"


def normal(name):
    name = name.strip().lower()
    name = name[5:] if name.startswith("test ") else name
    return " ".join(name.replace('"', "").replace("'", "").split())


def brute_force(expected, actual):
    """Tier and name one expected name finds among (position, name, status) rows."""
    actual = sorted(actual)
    for probe in (expected, normal(expected)):
        for tier, form in (("exact" if probe == expected else "normalised", lambda n: n), ("normalised", normal)):
            for a in actual:
                if form(a[1]) == probe:
                    return tier, a
    e = normal(expected)
    for a in actual:
        n = normal(a[1])
        if e in n or n in e:
            return "contains", a
    best, best_score = None, 0.5
    for a in actual:
        mine, other = set(e.split()), set(normal(a[1]).split())
        score = len(mine & other) / len(mine | other) if mine | other else 0
        if score > best_score:
            best, best_score = a, score
    return ("words", best) if best else (None, None)


def random_name(rng):
    words = [rng.choice(["a", "ab", "save", "file", "Test", "the", "x1", "don't", "é"]) for _ in range(rng.randint(0, 5))]
    text = rng.choice([" ", "  ", " "]).join(words)
    return rng.choice([text, text, text.upper(), f'"{text}"', "test " + text, f" {text} "])


def test_match_like_brute_force(spark):
    rng = random.Random(11)
    expected, actual = [], []
    for i in range(300):
        names = {random_name(rng) for _ in range(rng.randint(0, 6))}
        names = [n for n in names if n]
        for p, n in enumerate(names):
            actual.append(("r", str(i), p, n, rng.choice(["passed", "failed", "skipped"])))
        for o in range(rng.randint(1, 4)):
            expected.append(("r", str(i), rng.choice(["fail_to_pass", "pass_to_pass"]), o, random_name(rng)))
    found = matching.match_expected(spark.createDataFrame(expected, EXPECTED), spark.createDataFrame(actual, ACTUAL))
    got = {(r.instance_id, r.ord): r for r in found.collect()}
    assert len(got) == len(expected)
    tiers = set()
    for _, inst, category, o, name in expected:
        tier, hit = brute_force(name, [(a[2], a[3], a[4]) for a in actual if a[1] == inst])
        r = got[(inst, o)]
        assert (r.category, r.name) == (category, name)
        # an exact spelling of the normalised form may be told as either of the name tiers
        assert (r.tier, r.actual_name) == (tier, hit and hit[1]), (name, [a[3] for a in actual if a[1] == inst])
        outcome = "missing" if hit is None else "passed" if hit[2] == "passed" else "failed"
        assert r.outcome == outcome
        tiers.add(tier)
    assert tiers == {"exact", "normalised", "contains", "words", None}


@pytest.mark.parametrize(
    "expected, actual, tier, hit",
    [
        ("foo", ["Foo", "foo"], "exact", "foo"),
        ('Test "Foo"', ["foo"], "normalised", "foo"),
        ('"test foo"', ["foo"], "contains", "foo"),
        ("save file", ["can save file fast"], "contains", "can save file fast"),
        ("a b c d", ["a b c x"], "words", "a b c x"),
        ("a b c", ["a b x"], None, None),
        ("a b c d", ["a b c x", "z a b c d"], "contains", "z a b c d"),
        ("", ["q"], "contains", "q"),
        ("q r", ['""', "q r s"], "contains", '""'),
    ],
)
def test_match_golden(spark, expected, actual, tier, hit):
    e = spark.createDataFrame([("r", "i", "fail_to_pass", 0, expected)], EXPECTED)
    a = spark.createDataFrame([("r", "i", p, n, "passed") for p, n in enumerate(actual)], ACTUAL)
    r = matching.match_expected(e, a).first()
    assert (r.tier, r.actual_name) == (tier, hit)


def test_match_same_shape(spark):
    """All names of a large run share all words but one: no pair of them is looked at."""
    n = 20_000
    e = spark.range(n).selectExpr("'r' AS run_id", "'hot' AS instance_id", "'fail_to_pass' AS category", "id AS ord", "concat('the big case number ', id + 1000000) AS name")
    a = spark.range(n).selectExpr("'r' AS run_id", "'hot' AS instance_id", "id AS position", "concat('the big case number ', id + 2000000) AS name", "'passed' AS status")
    found = matching.match_expected(e, a)
    assert {tuple(r) for r in found.groupBy("tier", "actual_name").count().collect()} == {("words", "the big case number 2000000", n)}


def test_match_long_names(spark):
    r = random.Random(8)
    syllables = ["ab", "cd", "ef", "gh", "ij", "kl"]
    actual = ["/".join("".join(r.choice(syllables) for _ in range(5)) for _ in range(58))[:640] for _ in range(2000)]
    # pieces of 20 to 600 characters, longer texts around an actual name, and texts that nothing holds
    wanted = [actual[i][(k := r.randrange(0, 40)) : k + r.randrange(20, 600)] for i in range(900)]
    wanted += ["x" + actual[i] + "y" for i in range(900, 1300)] + [actual[i][:300] + "#" + actual[i][300:] for i in range(1300, 1600)]
    expected = spark.createDataFrame([("r", "i", "fail_to_pass", k, w) for k, w in enumerate(wanted)], "run_id string, instance_id string, category string, ord long, name string")
    results = spark.createDataFrame([("r", "i", k, a, "passed") for k, a in enumerate(actual)], "run_id string, instance_id string, position long, name string, status string")
    got = {x.ord: x.actual_name for x in matching.match_expected(expected, results, keys=("run_id", "instance_id"), tiers=("exact", "normalised", "contains")).collect()}
    for k, w in enumerate(wanted):
        w = " ".join(w.split())
        assert got[k] == next((a for a in actual if w in a or a in w), None)


@pytest.mark.parametrize("wanted, actual, hit", [
    ("common", ["x common y", "a common b"], "x common y"),  # of many that hold it the first
    ("abcdefg", ["abcd defg", "z abcdefg z"], "z abcdefg z"),  # the first with its windows does not hold it
    ("long name with tail", ["name with", "long"], "name with"),
    ("é日本語 x", ["y é日本語 x y"], "y é日本語 x y"),
])
def test_match_windows(spark, wanted, actual, hit):
    expected = spark.createDataFrame([("i", "fail_to_pass", 0, wanted)], "instance_id string, category string, ord long, name string")
    results = spark.createDataFrame([("i", k, a, "passed") for k, a in enumerate(actual)], "instance_id string, position long, name string, status string")
    assert matching.match_expected(expected, results, keys=("instance_id",)).first().actual_name == hit


def test_match_hot_group(spark):
    """One run and instance holds all rows; shared words and pieces are everywhere."""
    n = 2000
    expected = [("r", "hot", "fail_to_pass", i, f"should handle case {i} twice") for i in range(n)]
    actual = [("r", "hot", i, f"the module should handle case {i} twice indeed", "passed") for i in range(n)]
    e, a = spark.createDataFrame(expected, EXPECTED), spark.createDataFrame(actual, ACTUAL)
    found = matching.match_expected(e, a)
    assert found.where("tier = 'contains'").count() == n
    assert found.where("cast(regexp_extract(actual_name, 'case ([0-9]+)', 1) as bigint) <> ord").count() == 0


def test_detail_rows(spark):
    e = spark.createDataFrame(
        [("r", "i", "fail_to_pass", 0, "ALPHA"), ("r", "i", "fail_to_pass", 1, "alp"), ("r", "i", "fail_to_pass", 2, "beta")], EXPECTED
    )
    grades, details = evaluate_named(e, spark.createDataFrame([("r", "i", GLYPHS)], LOG))
    got = [(r.expected_name, r.name, r.status, r.error_message) for r in details.orderBy("ord").collect()]
    assert got == [
        ("ALPHA", "alpha", "passed", None),
        ("alp", "alp", "error", "Test not found in output"),
        ("beta", "beta", "failed", "Error: boom"),
    ]
    g = grades.first()
    # the partial match counts as passed although the listing shows it as not found
    assert (g.fail_to_pass_passed, g.fail_to_pass_total, g.resolved) == (2, 3, "partial")


@pytest.mark.parametrize(
    "f2p, p2p, want",
    [
        (["alpha"], ["alpha"], "full"),
        (["alpha", "beta"], ["alpha"], "partial"),
        (["beta"], ["alpha"], "no"),
        (["alpha"], ["gamma"], "no"),
        ([], ["alpha"], "full"),
        ([], [], "full"),
        (["nothing like it"], [], "no"),
        (["alpha", "alpha"], [], "full"),
    ],
)
def test_named_rule(spark, f2p, p2p, want):
    instances = spark.createDataFrame([("r", "i", f2p, p2p)], "run_id string, instance_id string, fail_to_pass array<string>, pass_to_pass array<string>")
    expected = grading.expected_tests(instances, ("run_id", "instance_id"))
    grades, _ = evaluate_named(expected, spark.createDataFrame([("r", "i", GLYPHS)], LOG))
    g = grades.first()
    assert (g.resolved, g.fail_to_pass_total, g.pass_to_pass_total) == (want, len(f2p), len(p2p))


def test_named_rule_with_errors(spark):
    instances = spark.createDataFrame([("i", ["alpha"], [])], "instance_id string, fail_to_pass array<string>, pass_to_pass array<string>")
    logs = spark.createDataFrame(
        [("a", "i", GLYPHS, "lost"), ("b", "i", GLYPHS, ""), ("c", "i", "", None), ("d", "i", GLYPHS + "5 pass 1 fail", None)],
        LOG + ", error string",
    )
    expected = grading.expected_tests(instances, runs=logs)
    grades, _ = evaluate_named(expected, logs, error="error")
    got = [(r.run_id, r.resolved, r.fail_to_pass_passed, r.fail_to_pass_total, r.error) for r in grades.orderBy("run_id").collect()]
    assert got == [
        ("a", "no", 0, 1, "lost"),
        ("b", "full", 1, 1, None),
        ("c", "no", 0, 1, "Parse warnings: Empty output received"),
        ("d", "full", 1, 1, "Parse warnings: Parsed 1 passed tests, but summary shows 5"),
    ]


FILE_NAMES = (
    ["test/io/read.test.ts::reads a file", "test/io/write.test.ts::appends"],
    ["test/io/read.test.ts::reads an empty file", "test/io/write.test.ts::syncs"],
)


@pytest.mark.parametrize(
    "change, want",
    [
        (("", ""), (True, 1.0, 1.0)),
        (("appends ... [PASS]", "appends ... [FAIL]"), (False, 0.5, 1.0)),
        (("syncs ... [PASS]", "syncs ... [FAIL]"), (False, 1.0, 0.5)),
        ((FILE_LOG, ""), (False, 0.0, 0.0)),
    ],
)
def test_files_rule(spark, change, want):
    instances = spark.createDataFrame([("r", "i", *FILE_NAMES)], "run_id string, instance_id string, fail_to_pass array<string>, pass_to_pass array<string>")
    log = spark.createDataFrame([("r", "i", FILE_LOG.replace(*change) if change[0] else FILE_LOG)], LOG)
    g = evaluate_files(grading.expected_tests(instances, ("run_id", "instance_id")), log)[0].first()
    assert (g.resolved, g.fail_to_pass_score, g.pass_to_pass_score) == want
    if change[0] != FILE_LOG:
        assert (g.total_tests_run, g.test_pass_rate) == (10, 0.8)


def test_files_rule_last_result_counts_and_names_without_file(spark):
    log = spark.createDataFrame([("r", "i", "  x ... [PASS] (1ms)\n  x ... [FAIL] (1ms)\n  y ... [PASS] (1ms)\n")], LOG)
    results = file_log_results = file_logs.file_test_results(log)
    e = spark.createDataFrame([("r", "i", "fail_to_pass", i, n) for i, n in enumerate(["x", "y", "y", "z"])], EXPECTED)
    got = rows(grading.match_files(e, file_log_results).select("name", "status", "correct"), "name")
    assert got == [("x", "FAIL", False), ("y", "PASS", True), ("z", "NOT_FOUND", False)]
    assert results.count() == 3


def test_counts_rule_and_predictions(spark):
    instances = spark.createDataFrame([("r", str(i)) for i in range(6)], "run_id string, instance_id string")
    predictions = spark.createDataFrame([("r", str(i), None if i == 4 else "") for i in range(5)], "run_id string, instance_id string, patch string")
    logs = spark.createDataFrame(
        [("r", "0", FILE_LOG, None), ("r", "1", "3 pass 0 fail", None), ("r", "2", '{"passed": 1}', "timeout"), ("r", "4", "{}", ""), ("r", "5", "9 pass", None)],
        LOG + ", error string",
    )
    got = rows(evaluate_counts(instances, predictions, logs, error="error").select("instance_id", "status", "passed", "error_message"), "instance_id")
    assert got == [
        ("0", "unresolved", 8, None), ("1", "resolved", 3, None), ("2", "error", 1, "timeout"),
        ("3", "unresolved", 0, None), ("4", "unresolved", 0, ""), ("5", "skipped", 0, "No prediction provided"),
    ]
