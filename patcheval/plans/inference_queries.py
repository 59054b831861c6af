"""Queries over prompts, model responses, patches and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from patcheval.constants import DEFAULT_PRICE, PRICES
from patcheval.functions.stage import new_path
from patcheval.operators import costs, inference, patches, prompts
from patcheval.operators.call_ledger import call_with_ledger
from patcheval.plans import samples as S
from patcheval.plans.registry import query

STAGED = f"""
    WITH hunks AS (
        SELECT *, concat('--- a/doc', doc_id, '.md', chr(10), '+++ b/doc', doc_id, '.md', chr(10), '@@ -1 +1 @@', chr(10), '-old ', n_chars, chr(10), '+new ', n_chars) AS hunk,
               CASE n_chars % 6 WHEN 0 THEN 'fence' WHEN 1 THEN 'patch_tag' WHEN 2 THEN 'diff_tag' WHEN 3 THEN 'raw' END AS stage
        FROM documents)
"""


@query(STAGED + "SELECT doc_id, stage, CASE WHEN stage IS NOT NULL THEN hunk END AS patch FROM hunks")
def extract_patches(spark, sf):
    return patches.extract_patches(S.responses(spark, sf)).select("doc_id", "stage", "patch")


@query(STAGED + """SELECT source AS model, coalesce(stage, 'none') AS stage, count(*) AS responses,
       round(count(*) / sum(count(*)) OVER (PARTITION BY source), 9) AS share FROM hunks GROUP BY source, stage""")
def extraction_yield(spark, sf):
    rows = patches.extraction_yield(patches.extract_patches(S.responses(spark, sf)))
    return rows.withColumn("share", F.round("share", 9))


ADDED = "array_to_string(list_transform(string_split(text, chr(10)), lambda x: concat('+', x)), chr(10))"
REPAIRED = f"""
    WITH repaired AS (SELECT doc_id, source, n_chars % 6 AS flaw, text, CASE n_chars % 6
        WHEN 0 THEN concat('--- a/doc.md', chr(10), '+++ b/doc.md', chr(10), '@@ -0,0 +1,9 @@', chr(10), {ADDED}, chr(10))
        WHEN 1 THEN concat('--- a/doc.md', chr(10), '+++ b/doc.md', chr(10), '@@ -1,1 +1,1 @@', chr(10), {ADDED}, chr(10))
        WHEN 2 THEN concat('--- /dev/null', chr(10), '+++ b/doc.md', chr(10), '@@ -3,1 +4,5 @@ fn', chr(10), ' lost blank', chr(10), {ADDED}, chr(10))
        WHEN 3 THEN concat('--- a/doc.md', chr(10), '+++ b/doc.md', chr(10), '@@ -0,0 +1,9 @@', chr(10), {ADDED}, chr(10))
        WHEN 4 THEN concat('+++ b/doc.md', chr(10), {ADDED}, chr(10)) ELSE '' END AS repaired,
        CASE n_chars % 6 WHEN 0 THEN 'final_newline,new_prefix,old_prefix' WHEN 1 THEN 'hunk_header,line_endings' WHEN 2 THEN 'context_space,hunk_header'
             WHEN 4 THEN 'final_newline' ELSE '' END AS fixes FROM documents)
"""


@query(REPAIRED + "SELECT doc_id, fixes, md5(repaired) AS repaired FROM repaired")
def repair_patches(spark, sf):
    rows = patches.repair_patches(S.broken_patches(spark, sf))
    return rows.select("doc_id", F.array_join("fixes", ",").alias("fixes"), F.md5(F.col("repaired").cast("binary")).alias("repaired"))


@query(REPAIRED + """SELECT doc_id, line_no, code FROM repaired, (VALUES (0, 1, 'old_prefix'), (0, 2, 'new_prefix'), (2, 4, 'unexpected_line'),
       (4, NULL, 'missing_header'), (4, NULL, 'missing_hunk'), (5, NULL, 'empty')) i(kind, line_no, code) WHERE kind = flaw""")
def patch_issues(spark, sf):
    checked = patches.validate_patches(S.broken_patches(spark, sf))
    return patches.patch_issue_rows(checked, ["doc_id"]).drop("text")


@query(REPAIRED + "SELECT source AS model, flaw IN (1, 3) AS is_valid, count(*) AS patches FROM repaired GROUP BY ALL")
def patch_validity(spark, sf):
    checked = patches.validate_patches(S.broken_patches(spark, sf))
    return checked.groupBy("model", "is_valid").agg(F.count(F.lit(1)).alias("patches"))


@query(REPAIRED + """SELECT source AS model, code, count(*) AS issues FROM repaired, (VALUES (0, 'old_prefix'), (0, 'new_prefix'), (2, 'unexpected_line'),
       (4, 'missing_header'), (4, 'missing_hunk'), (5, 'empty')) i(kind, code) WHERE kind = flaw GROUP BY ALL""")
def patch_issue_histogram(spark, sf):
    return patches.issue_histogram(patches.validate_patches(S.broken_patches(spark, sf)))


# --- prompts ----------------------------------------------------------------------------


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _filled_sql(template: str) -> str:
    parts = template.replace("{problem}", "\0text\0").replace("{context}", "\0ctx\0").split("\0")
    return "concat(" + ", ".join(p if p in ("text", "ctx") else _sql_text(p) for p in parts) + ")"


_T = prompts.PromptTexts()
_USER = _filled_sql(_T.user)
PROMPTS = f"""
    WITH shown AS (SELECT conv_id, turn, role, text, CASE WHEN role = 'system' THEN {_sql_text(_T.no_context)} ELSE concat('by {{problem}} ', role) END AS ctx FROM conversations),
    prompts AS (
        SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '' ELSE {_sql_text(_T.system)} END AS system,
               CASE turn % 4 WHEN 0 THEN concat({_USER}, {_sql_text(_T.extra_heading)}, role) WHEN 1 THEN concat({_filled_sql(_T.minimal)}, {_sql_text(_T.extra_heading)}, role)
                    WHEN 2 THEN concat({_USER}, {_sql_text(_T.example_heading + _T.example)}, {_sql_text(_T.extra_heading)}, role)
                    ELSE concat({_sql_text(_T.system + _T.chat_separator)}, {_USER}) END AS user_text FROM shown)
"""


def _prompts(spark, sf):
    rows = S.table(spark, sf, "conversations").withColumn(
        "ctx", F.expr("CASE WHEN role = 'system' THEN '' ELSE concat('by {problem} ', role) END")
    )
    style = F.element_at(F.array(*[F.lit(s) for s in prompts.STYLES]), (F.col("turn") % 4 + 1).cast("int"))
    return prompts.build_prompts(rows, style, problem="text", context="ctx", extra="role")


@query(PROMPTS + "SELECT conv_id, turn, md5(system) AS system, md5(user_text) AS user_text FROM prompts")
def build_prompts(spark, sf):
    rows = _prompts(spark, sf)
    return rows.select("conv_id", "turn", F.md5("system").alias("system"), F.md5("user").alias("user_text"))


@query(PROMPTS + "SELECT conv_id, turn, CASE WHEN system = '' THEN 'user' ELSE 'system,user' END AS roles, length(system) + length(user_text) AS characters FROM prompts")
def prompt_messages(spark, sf):
    rows = prompts.as_messages(_prompts(spark, sf))
    characters = F.aggregate(F.transform("messages", lambda m: F.length(m["content"])), F.lit(0), lambda a, x: a + x)
    return rows.select("conv_id", "turn", F.array_join("messages.role", ",").alias("roles"), characters.cast("bigint").alias("characters"))


@query(PROMPTS + "SELECT conv_id, turn, length(system) AS system_length, length(user_text) AS user_length FROM prompts")
def prompt_requests(spark, sf):
    rows = prompts.as_system_and_messages(_prompts(spark, sf))
    first = F.get("request.messages", F.lit(0))["content"]
    return rows.select(
        "conv_id", "turn", F.length("request.system").cast("bigint").alias("system_length"), F.length(first).cast("bigint").alias("user_length")
    )


@query("SELECT source AS model, count(*) AS texts, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM documents GROUP BY source")
def token_totals(spark, sf):
    rows = costs.count_tokens(S.table(spark, sf, "documents"), "text")
    return rows.groupBy(F.col("source").alias("model")).agg(F.count(F.lit(1)).alias("texts"), F.sum("tokens").alias("tokens"))


def word_encoder():
    """Splits a text at single blanks; stands in for a tokenizer with a vocabulary."""
    return lambda text: text.split(" ")


@query("SELECT source AS model, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS tokens FROM documents GROUP BY source")
def token_totals_with_encoder(spark, sf):
    rows = costs.count_tokens(S.table(spark, sf, "documents"), "text", encoder=word_encoder)
    return rows.groupBy(F.col("source").alias("model")).agg(F.sum("tokens").alias("tokens"))


@query("SELECT doc_id, md5(CASE WHEN length(text) > 800 THEN concat(left(text, 800), '...') ELSE text END) AS fitted FROM documents")
def fit_to_budget(spark, sf):
    rows = costs.fit_to_budget(S.table(spark, sf, "documents"), "text", 200)
    return rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("fitted"))


# --- costs ------------------------------------------------------------------------------

_CASE_IN = " ".join(f"WHEN contains(lower(model), '{k}') THEN {i}" for k, i, _ in PRICES)
_CASE_OUT = " ".join(f"WHEN contains(lower(model), '{k}') THEN {o}" for k, _, o in PRICES)
CALLS = f"""
    WITH calls AS (SELECT *, input_tokens / 1000 * p_in + output_tokens / 1000 * p_out AS cost_usd FROM (
        SELECT *, CAST(CASE {_CASE_IN} ELSE {DEFAULT_PRICE[0]} END AS DOUBLE) AS p_in, CAST(CASE {_CASE_OUT} ELSE {DEFAULT_PRICE[1]} END AS DOUBLE) AS p_out FROM (
            SELECT concat('run-', user_id % 5) AS run_id, event_id, ts, ({S.MODEL_LIST})[user_id % 12 + 1] AS model, CAST(floor(value * 100) AS BIGINT) AS input_tokens,
                   CAST(floor(value * 10) AS BIGINT) AS output_tokens, value AS latency, event_type <> 'error' AS success, event_type IN ('click', 'purchase') AS has_patch, event_type FROM events)))
"""


@query(CALLS + "SELECT event_id, model, round(cost_usd, 9) AS cost_usd FROM calls")
def cost_results(spark, sf):
    rows = costs.cost_results(S.inference_rows(spark, sf))
    return rows.select("event_id", "model", F.round("cost_usd", 9).alias("cost_usd"))


@query(CALLS + """SELECT model, count(*) AS calls, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
       round(sum(cost_usd), 8) AS cost_usd FROM calls GROUP BY model""")
def cost_by_model(spark, sf):
    rows = costs.cost_by_model(costs.cost_results(S.inference_rows(spark, sf)))
    return rows.withColumn("cost_usd", F.round("cost_usd", 8))


STATS_COLUMNS = """count(*) AS total_instances, count(*) FILTER (WHERE success) AS successful, count(*) FILTER (WHERE NOT success) AS failed,
       CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens, round(sum(cost_usd), 8) AS total_cost_usd,
       round(sum(latency), 3) AS total_latency_seconds, count(*) FILTER (WHERE has_patch) AS patches_extracted"""


@query(CALLS + f"SELECT run_id, {STATS_COLUMNS} FROM calls GROUP BY run_id")
def inference_stats(spark, sf):
    rows = costs.inference_stats(costs.cost_results(S.inference_rows(spark, sf)))
    return rows.withColumns({"total_cost_usd": F.round("total_cost_usd", 8), "total_latency_seconds": F.round("total_latency_seconds", 3)})


def echo_client():
    return inference.EchoClient("gpt-4-echo", fail_on="et la")


_FIRST = "string_split(trim(text), chr(10))[1]"
_HEAD = len(_T.system)
_REST = len(_T.minimal.replace("{problem}", ""))


ANSWERED = f"""
    WITH calls AS (
        SELECT conv_id, turn, contains(text, 'et la') AS failed, concat('--- a/notes.txt', chr(10), '+++ b/notes.txt', chr(10), '@@ -0,0 +1,1 @@', chr(10), '+', {_FIRST}) AS patch,
               ({_HEAD} + {_REST} + length(text)) // 4 AS input_tokens FROM conversations)
    SELECT concat('c', conv_id, '-', turn) AS instance_id, NOT failed AS success, CASE WHEN failed THEN 'refused: et la' END AS error,
           CASE WHEN NOT failed THEN md5(concat(patch, chr(10))) END AS patch, input_tokens, CASE WHEN failed THEN 0 ELSE (length(patch) + 12) // 4 END AS output_tokens,
           round(input_tokens / 1000 * 0.03 + CASE WHEN failed THEN 0 ELSE (length(patch) + 12) // 4 END / 1000 * 0.06, 9) AS cost_usd FROM calls
"""


@query(ANSWERED)
def run_inference(spark, sf):
    """Prompts to results with a deterministic client that fails on some prompts."""
    instances = S.table(spark, sf, "conversations").select(
        F.expr("concat('c', conv_id, '-', turn)").alias("instance_id"), F.col("text").alias("problem_statement")
    )
    rows = inference.run_inference(instances, echo_client, "run", style="minimal", max_retries=1)
    return rows.select(
        "instance_id", "success", "error", F.md5(F.col("extracted_patch").cast("binary")).alias("patch"),
        "input_tokens", "output_tokens", F.round("cost_usd", 9).alias("cost_usd"),
    )


@query(f"SELECT *, 1 AS asked FROM ({ANSWERED})")
def ledger_inference(spark, sf):
    """The same by a ledger: a run over the first turns, then one over all, which asks only what is missing, chunk by chunk."""
    ledger = new_path(spark, "ledger")
    turns = S.table(spark, sf, "conversations").withColumn("instance_id", F.expr("concat('c', conv_id, '-', turn)"))

    def ask(prompts):
        return call_with_ledger(prompts, echo_client, "gpt-4-echo", ledger, chunk_calls=20_000, task_calls=2_000, retry_failed=False, max_retries=1)

    def run(rows):
        return inference.run_inference(rows.select("instance_id", F.col("text").alias("problem_statement"), "turn"), echo_client, "run", style="minimal", ask=ask)

    run(turns.where("turn = 1"))
    rows = run(turns)
    asked = spark.read.parquet(ledger).groupBy("call_key").count().agg(F.max("count")).first()[0]
    return rows.select(
        "instance_id", "success", "error", F.md5(F.col("extracted_patch").cast("binary")).alias("patch"),
        "input_tokens", "output_tokens", F.round("cost_usd", 9).alias("cost_usd"), F.lit(asked).cast("int").alias("asked"),
    )


class SecondTryClient(inference.EchoClient):
    """Fails on each prompt the first time."""

    def __init__(self):
        super().__init__("gpt-4-echo")
        self.seen = None

    def call(self, system, user, temperature, max_tokens):
        if self.seen != user:
            self.seen = user
            raise RuntimeError("busy")
        return super().call(system, user, temperature, max_tokens)


@query("""
    SELECT concat('c', conv_id, '-', turn) AS instance_id, true AS success, CAST(NULL AS VARCHAR) AS error FROM (
        SELECT conv_id, turn, row_number() OVER (ORDER BY conv_id, turn) AS n FROM conversations WHERE conv_id % 3 <> 0 AND turn <> 1) WHERE n <= (SELECT count(*) // 4 FROM conversations)
""")
def resume_inference(spark, sf):
    """Listed conversations that are not done, as many of the first as a quarter of all rows, by a client that answers at the second try."""
    turns = S.table(spark, sf, "conversations").withColumn("instance_id", F.expr("concat('c', conv_id, '-', turn)"))
    instances = turns.select("instance_id", F.col("text").alias("problem_statement"), "conv_id", "turn")
    rows = inference.run_inference(
        instances, SecondTryClient, "run", style="minimal", done=turns.where("turn = 1"), ids=turns.where("conv_id % 3 <> 0"), max_instances=turns.count() // 4,
        order=("conv_id", "turn"), max_retries=2, first_delay=0.0,
    )
    return rows.select("instance_id", "success", "error")
