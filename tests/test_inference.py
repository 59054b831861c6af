"""Patches, prompts, costs, model calls."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from patcheval.operators import costs, inference, patches, prompts

DIFF = "--- a/x\n+++ b/x\n@@ -1,1 +1,1 @@\n-a\n+b"


@pytest.mark.parametrize(
    "response, stage, patch",
    [
        (f"Fix:\n```diff\n{DIFF}\n```\nok", "fence", DIFF),
        (f"```\nnot\n```\n```patch\n{DIFF}\n```", "fence", DIFF),
        (f"```DIFF\n{DIFF}\n```", "fence", DIFF),
        (f"<PATCH>{DIFF}</PATCH>", "patch_tag", DIFF),
        (f"<patch>none</patch><diff>\n{DIFF}\n</diff>", "diff_tag", DIFF),
        (f"Sure\n{DIFF}\nHope it helps\n-x", "raw", DIFF),
        (f"{DIFF}\n# note\n+c", "raw", DIFF + "\n# note\n+c"),
        ("Index: f\nold\n-x\n+y", "raw", "Index: f"),
        ("--- x\n+++ y\n", None, None),
        ("no patch", None, None),
        ("", None, None),
        (None, None, None),
        # the closing fence of another block is taken for an opening one; the raw stage finds the diff
        (f"```js\nlet a\n```\ntext\n{DIFF}\nend", "raw", DIFF),
    ],
)
def test_extract(spark, response, stage, patch):
    r = patches.extract_patches(spark.createDataFrame([(response,)], "response string")).first()
    assert (r.stage, r.patch) == (stage, patch)


@pytest.mark.parametrize(
    "patch, repaired, fixes",
    [
        ("", "", []),
        (DIFF, DIFF + "\n", ["final_newline"]),
        (DIFF + "\n", DIFF + "\n", []),
        ("--- x\t1\n+++ y\n", "--- a/x\t1\n+++ b/y\n", ["new_prefix", "old_prefix"]),
        ("--- /dev/null\n+++ b/y\n", "--- /dev/null\n+++ b/y\n", []),
        ("--- /dev/nullx\n", "--- a//dev/nullx\n", ["old_prefix"]),
        ("@@ -3 +4,2 @@ fn\nctx\nctx\n", "@@ -3,1 +4,2 @@ fn\n ctx\nctx\n", ["context_space", "hunk_header"]),
        ("@@ bad @@\n\\ No newline\n", "@@ bad @@\n\\ No newline\n", []),
        ("a\r\nb\rc", "a\nb\nc\n", ["final_newline", "line_endings"]),
        ("--- -- x\n", "--- a/-- x\n", ["old_prefix"]),
    ],
)
def test_repair(spark, patch, repaired, fixes):
    r = patches.repair_patches(spark.createDataFrame([(patch,)], "patch string")).first()
    assert (r.repaired, r.fixes) == (repaired, fixes)


@pytest.mark.parametrize(
    "patch, issues",
    [
        (DIFF, []),
        ("", [(None, "empty")]),
        (None, [(None, "empty")]),
        ("hello", [(None, "not_a_diff")]),
        ("--- x\n+++ y\n@@ -1 +1 @@\nodd\n+b", [(1, "old_prefix"), (2, "new_prefix"), (4, "unexpected_line")]),
        ("+++ b/y\n", [(None, "missing_header"), (None, "missing_hunk")]),
        ("--- a/x\n@@ nope\n", [(2, "hunk_header")]),
        ("--- a/x\n@@ -1 +1 @@\n+a\ndiff --git a b\nodd\n@@ -1 +1 @@\n\nodd\n\\ No newline", [(8, "unexpected_line")]),
        ("@@ -1 +1 @@\n--- a/x\n", []),
    ],
)
def test_validate(spark, patch, issues):
    r = patches.validate_patches(spark.createDataFrame([(patch,)], "patch string")).first()
    assert ([(i.line_no, i.code) for i in r.issues], r.is_valid) == (issues, not issues)


def test_hunk_state_like_line_by_line(spark):
    rng = random.Random(2)
    kinds = ["@@ -1 +1 @@", "odd", "+a", " c", "", "diff --git a b", "index 12", "--- a/x", "\\ No", "-b"]
    texts = ["--- a/x\n" + "\n".join(rng.choice(kinds) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    df = patches.validate_patches(spark.createDataFrame(list(enumerate(texts)), "i int, patch string"))
    for r in df.collect():
        inside, want = False, []
        for no, line in enumerate(texts[r.i].split("\n"), 1):
            if line.startswith("---"):
                continue
            if line.startswith("@@"):
                inside = True
            elif inside and re.match("diff |index ", line):
                inside = False
            elif inside and line and line[0] not in "+- \\":
                want.append(no)
        assert [x.line_no for x in r.issues if x.code == "unexpected_line"] == want


def test_prompts(spark):
    df = spark.createDataFrame([("p {context}", "")], "problem_statement string, code_context string")
    t = prompts.PromptTexts(system="S", user="<{problem}|{context}>", minimal="({problem})", example="E")
    made = {s: prompts.build_prompts(df, s, texts=t).first() for s in prompts.STYLES}
    assert made["default"].user == "<p {context}|No additional context provided.>" and made["default"].system == "S"
    assert made["minimal"].user == "(p {context})"
    assert made["detailed"].user == made["default"].user + "\n\n## Example Patch Format\n\nE"
    assert (made["chat"].system, made["chat"].user) == ("", "S\n\n---\n\n" + made["default"].user)
    with pytest.raises(ValueError):
        prompts.build_prompts(df, "other")
    with pytest.raises(Exception, match="Unknown prompt style"):
        prompts.build_prompts(df, F.lit("other")).collect()
    chat = prompts.build_prompts(df, "chat", texts=t)
    assert [m.role for m in prompts.as_messages(chat).first().messages] == ["user"]
    assert prompts.as_system_and_messages(chat).first().request.system == ""


def test_prices_and_tokens(spark):
    models = ["GPT-4o", "gpt-4-turbo", "claude-3-5-sonnet-x", "other"]
    df = spark.createDataFrame([(m, 1000, 1000) for m in models], "model string, input_tokens bigint, output_tokens bigint")
    first = [round(r.cost_usd, 6) for r in costs.cost_results(df).collect()]
    longest = [round(r.cost_usd, 6) for r in costs.cost_results(df, match="longest").collect()]
    assert first == [0.09, 0.09, 0.018, 0.04] and longest == [0.02, 0.04, 0.018, 0.04]
    texts = spark.createDataFrame([("abcdefgh",), ("abc",), (None,)], "t string")
    assert [r.tokens for r in costs.count_tokens(texts, "t").collect()] == [2, 0, 0]
    assert [r.tokens for r in costs.count_tokens(texts, "t", encoder=lambda: list).collect()] == [8, 3, 0]
    assert [r.t for r in costs.fit_to_budget(texts, "t", 1).collect()] == ["abcd...", "abc", None]


class Flaky:
    def __init__(self, fail):
        self.fail, self.calls, self.model = fail, 0, "m"

    def call(self, system, user, temperature, max_tokens):
        self.calls += 1
        if self.calls <= self.fail:
            raise RuntimeError(f"no {self.calls}")
        return {"content": "", "input_tokens": 1, "output_tokens": 1}


def test_retry():
    waits = []
    client = Flaky(2)
    inference.call_with_retry(client, "", "", 0.0, 1, 3, 1.0, waits.append)
    assert client.calls == 3 and waits == [1.0, 2.0]
    with pytest.raises(RuntimeError, match="no 3"):
        inference.call_with_retry(Flaky(5), "", "", 0.0, 1, 3, 1.0, lambda s: None)


def test_run_inference_and_resume(spark):
    rows = [(str(i), f"fix {i}" if i != 2 else "bad", i) for i in range(6)]
    df = spark.createDataFrame(rows, "instance_id string, problem_statement string, position int")
    done = spark.createDataFrame([("0", True), ("1", False)], "instance_id string, success boolean")

    def client():
        return inference.EchoClient(fail_on="bad")

    got = {r.instance_id: r for r in inference.run_inference(df, client, "r", done=done, max_instances=3, max_retries=1).collect()}
    assert sorted(got) == ["2", "3", "4"]
    assert (got["2"].success, got["2"].extracted_patch, got["2"].output_tokens, got["2"].error) == (False, None, 0, "refused: bad")
    assert got["3"].extracted_patch.endswith("+fix 3\n") and got["3"].metadata.prompt_style == "default"
    again = inference.pending_instances(df, done, retry_failed=True)
    assert sorted(r.instance_id for r in again.collect()) == ["1", "2", "3", "4", "5"]
    stats = costs.inference_stats(inference.run_inference(df, client, "r", max_retries=1)).first()
    assert (stats.total_instances, stats.successful, stats.failed, stats.patches_extracted) == (6, 5, 1, 5)
