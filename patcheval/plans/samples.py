"""Benchmark-shaped tables derived from the sample tables, always from all of their rows.

Logs are rendered inside the row they come from, so no rendering gathers rows of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patcheval.functions.stage import spread

MODELS = (
    "gpt-4-0613", "gpt-4-turbo-x", "gpt-4-turbo-preview-y", "GPT-4o-2024", "gpt-4o-mini", "gpt-3.5-turbo-16k",
    "claude-3-opus-1", "claude-3-sonnet-1", "claude-3-haiku-1", "claude-3-5-sonnet-2", "claude-opus-4-5-20251101",
    "in-house-7b",
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df) if name in ("documents", "pages") else df


# --- documents as logs: every line of a text is a test -------------------------------------

# kind of line i named n: 0 fails, 1 is skipped, anything else passes
KIND = "(length(n) + i) % 7"

DOC_LINES = """
    filter(transform(split(text, '\\n', -1), (x, i) -> struct(i AS i, trim(x) AS n)), s -> s.n <> '')
"""


def _doc_lines(spark, sf) -> DataFrame:
    kind = "transform(lines, s -> struct(s.i AS i, s.n AS n, (length(s.n) + s.i) % 7 AS k))"
    return (
        table(spark, sf, "documents")
        .withColumn("lines", F.expr(DOC_LINES))
        .withColumn("lines", F.expr(kind))
        .withColumn("run_id", F.col("source"))
        .withColumn("instance_id", F.expr("concat('doc-', doc_id)"))
    )


def named_logs(spark, sf) -> DataFrame:
    """(run_id, instance_id, output): glyph lines for English and French texts, worded lines else."""
    glyph = """
        CASE WHEN s.k = 0 THEN concat('✗ ', s.n, ' [', length(s.n), 'ms]\\n  Error: bad line ', s.i, '\\n    at line ', s.i, '\\n    in doc ', doc_id)
             WHEN s.k = 1 THEN concat('○ ', s.n, ' (skipped)')
             ELSE concat('✓ ', s.n, ' [', length(s.n), '.5ms]') END
    """
    worded = """
        CASE WHEN s.k = 0 THEN concat(s.n, ' .... FAILED')
             WHEN s.k = 1 THEN concat(s.n, ' (todo)')
             ELSE concat('  ', s.n, ' ... pass [', length(s.n), '.5ms]') END
    """
    body = f"transform(lines, s -> CASE WHEN lang IN ('en', 'fr') THEN {glyph} ELSE {worded} END)"
    head = """
        concat(size(filter(lines, s -> s.k > 1)), ' pass, ', size(filter(lines, s -> s.k = 0)), ' fail\\n',
               'Total time: ', n_chars, CASE WHEN lang = 'fr' THEN ' s' ELSE 'ms' END)
    """
    return _doc_lines(spark, sf).select(
        "run_id", "instance_id",
        F.expr(f"CASE WHEN size(lines) = 0 THEN '' ELSE array_join(concat(array({head}), {body}), '\\n') END").alias("output"),
    )


def file_logs(spark, sf) -> DataFrame:
    """(run_id, instance_id, output): result lines under file headers, with a summary."""
    line = """
        concat(CASE WHEN length(s.n) % 4 = 0 THEN concat('test/l', length(s.n) % 16, '.test.ts:\\n') ELSE '' END,
               '  ', s.n, ' ... [', CASE s.k WHEN 0 THEN 'FAIL' WHEN 1 THEN 'SKIP' ELSE 'PASS' END, '] (', length(s.n), '.25ms)',
               CASE WHEN s.k = 0 AND length(s.n) % 2 = 0 THEN concat('\\n    at x\\n    Error: bad line ', s.i) ELSE '' END)
    """
    foot = """
        concat('\\n ', size(filter(lines, s -> s.k > 1)), ' pass\\n ', size(filter(lines, s -> s.k = 0)), ' fail\\n ',
               size(filter(lines, s -> s.k = 1)), ' skip\\n ', 2 * size(lines), ' expect() calls\\nRan ', size(lines),
               ' tests in ', n_chars, '.5ms')
    """
    return _doc_lines(spark, sf).select(
        "run_id", "instance_id",
        F.expr(f"array_join(concat(array(concat('runner v1\\ntest/', source, '.test.ts:')), transform(lines, s -> {line}), array({foot})), '\\n')").alias("output"),
    )


def file_instances(spark, sf) -> DataFrame:
    """(run_id, instance_id, fail_to_pass, pass_to_pass) with names 'file::name'; names whose length
    divides by 5 are expected in a file that was never run."""
    # the file of a line is the last header at or above it; headers depend on the line alone
    name = """
        transform(lines, s -> struct(length(s.n) AS len, concat(
            CASE WHEN length(s.n) % 5 = 0 THEN 'test/none.test.ts'
                 WHEN length(s.n) % 4 = 0 THEN concat('test/l', length(s.n) % 16, '.test.ts')
                 ELSE concat('test/', source, '.test.ts') END, '::', s.n) AS full))
    """
    return _doc_lines(spark, sf).withColumn("names", F.expr(name)).select(
        "run_id", "instance_id",
        F.expr("transform(filter(names, x -> x.len % 2 = 0), x -> x.full)").alias("fail_to_pass"),
        F.expr("transform(filter(names, x -> x.len % 2 = 1), x -> x.full)").alias("pass_to_pass"),
    )


# SQL of the same lines: doc_id, source, lang, n_chars, i, n, k
DOC_LINES_SQL = """
    doc_lines AS (
        SELECT doc_id, source, lang, n_chars, i, n, (length(n) + i) % 7 AS k
        FROM (SELECT doc_id, source, lang, n_chars, idx - 1 AS i, trim(line) AS n
              FROM (SELECT doc_id, source, lang, n_chars, unnest(string_split(text, chr(10))) AS line,
                           generate_subscripts(string_split(text, chr(10)), 1) AS idx FROM documents))
        WHERE n <> ''
    )
"""

# --- line items as test results and expectations -------------------------------------------

ITEM_NAME = "concat('case ', l_linenumber, ' ', p_name)"
ITEM_POSITION = "l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey"


def items(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").join(
        table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), F.expr("l_partkey = p_partkey")
    )


def item_results(spark, sf) -> DataFrame:
    """(run_id, instance_id, position, name, status, duration_ms): a test per line item; a name that
    repeats in an order counts once, passed before failed before skipped."""
    rank = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END"
    best = F.min(F.struct(F.expr(rank).alias("rank"), F.expr(ITEM_POSITION).alias("position"), F.col("l_quantity").alias("duration_ms")))
    return (
        items(spark, sf)
        .groupBy(F.col("l_linestatus").alias("run_id"), F.expr("concat('ord-', l_orderkey)").alias("instance_id"), F.expr(ITEM_NAME).alias("name"))
        .agg(best.alias("b"))
        .select(
            "run_id", "instance_id", (F.col("b.rank") * F.lit(1 << 58) + F.col("b.position")).alias("position"), "name",
            F.expr("CASE b.rank WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE 'skipped' END").alias("status"),
            "b.duration_ms", F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("string").alias("stack_trace"),
        )
    )


ITEM_EXPECTED = """
    CASE WHEN p_size % 7 = 0 THEN concat('absent thing ', p_partkey)
         WHEN CAST(l_quantity AS INT) % 6 = 0 THEN {name}
         WHEN CAST(l_quantity AS INT) % 6 = 1 THEN upper({name})
         WHEN CAST(l_quantity AS INT) % 6 = 2 THEN concat('  test "', {name}, '" ')
         WHEN CAST(l_quantity AS INT) % 6 = 3 THEN p_name
         WHEN CAST(l_quantity AS INT) % 6 = 4 THEN concat({name}, ' again')
         ELSE concat('case x', l_linenumber, ' ', p_name) END
""".format(name=ITEM_NAME)
ITEM_CATEGORY = "CASE WHEN CAST(round(l_tax * 100) AS INT) % 2 = 1 THEN 'fail_to_pass' ELSE 'pass_to_pass' END"


def item_expected(spark, sf) -> DataFrame:
    """(run_id, instance_id, category, ord, name): an expectation per line item."""
    return items(spark, sf).select(
        F.col("l_linestatus").alias("run_id"), F.expr("concat('ord-', l_orderkey)").alias("instance_id"),
        F.expr(ITEM_CATEGORY).alias("category"), F.expr(ITEM_POSITION).alias("ord"), F.expr(ITEM_EXPECTED).alias("name"),
    )


# brute force in SQL: every expected name of an order against every actual one
ITEM_MATCH_SQL = f"""
    items AS (SELECT * FROM lineitem JOIN part ON l_partkey = p_partkey),
    results AS (
        SELECT * FROM (
            SELECT *, row_number() OVER (PARTITION BY run_id, instance_id, name ORDER BY rnk, position) AS rn FROM (
                SELECT l_linestatus AS run_id, concat('ord-', l_orderkey) AS instance_id, {ITEM_NAME} AS name, l_quantity AS duration_ms,
                       CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS rnk, {ITEM_POSITION} AS position
                FROM items))
        WHERE rn = 1),
    actual AS (
        SELECT run_id, instance_id, name, rnk, position, duration_ms,
               CASE rnk WHEN 0 THEN 'passed' WHEN 1 THEN 'failed' ELSE 'skipped' END AS status,
               lower(name) AS norm
        FROM results),
    expected AS (
        SELECT l_linestatus AS run_id, concat('ord-', l_orderkey) AS instance_id, {ITEM_CATEGORY} AS category,
               {ITEM_POSITION} AS ord, {ITEM_EXPECTED} AS name FROM items),
    wanted AS (
        SELECT *, replace(regexp_replace(lower(trim(name)), '^test ', ''), '"', '') AS norm FROM expected),
    pairs AS (
        SELECT w.run_id, w.instance_id, w.category, w.ord, w.name, a.name AS actual_name, a.status, a.duration_ms, a.rnk, a.position,
               CASE WHEN a.name = w.name THEN 0 WHEN a.norm = w.name THEN 1 WHEN a.name = w.norm THEN 2 WHEN a.norm = w.norm THEN 3
                    WHEN contains(a.norm, w.norm) OR contains(w.norm, a.norm) THEN 4
                    ELSE 5 END AS step,
               len(list_intersect(string_split(a.norm, ' '), string_split(w.norm, ' ')))
                 / len(list_distinct(list_concat(string_split(a.norm, ' '), string_split(w.norm, ' ')))) AS score
        FROM wanted w JOIN actual a USING (run_id, instance_id)),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY run_id, instance_id, ord
                                     ORDER BY step, CASE WHEN step = 5 THEN -score ELSE 0 END, rnk, position) AS rn
        FROM pairs WHERE step < 5 OR score > 0.5),
    matched AS (
        SELECT e.run_id, e.instance_id, e.category, e.ord, e.name,
               CASE WHEN r.step = 0 THEN 'exact' WHEN r.step < 4 THEN 'normalised' WHEN r.step = 4 THEN 'contains'
                    WHEN r.step = 5 THEN 'words' END AS tier,
               r.actual_name, r.status AS actual_status, r.duration_ms,
               CASE WHEN r.step IS NULL THEN 'missing' WHEN r.status = 'passed' THEN 'passed' ELSE 'failed' END AS outcome,
               CASE WHEN r.step <= 3 THEN r.status END AS shown
        FROM expected e LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r
          ON e.run_id = r.run_id AND e.instance_id = r.instance_id AND e.ord = r.ord)
"""

# --- orders as instances, two runs of them --------------------------------------------------

CATEGORY = "CASE WHEN o_totalprice > 450000 THEN 'unknown' WHEN o_orderstatus = 'F' THEN 'bug_fix' WHEN o_orderstatus = 'O' THEN 'feature' ELSE 'performance' END"
DIFFICULTY = "CASE o_orderpriority WHEN '1-URGENT' THEN 'expert' WHEN '2-HIGH' THEN 'hard' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'easy' ELSE '' END"
ORDER_ID = "CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'P' THEN concat('Ord ', o_orderkey) WHEN o_orderstatus = 'P' THEN concat('ORD-', o_orderkey) ELSE concat('ord-', o_orderkey) END"
GOLD = "CASE WHEN o_totalprice > 300000 THEN 'no diff' WHEN o_totalprice > 100000 THEN concat('--- a/f', o_custkey, '\\n+++ b/f\\n@@ -1 +1 @@') ELSE '' END"
GOLD_SQL = GOLD.replace("'\\n+++ b/f\\n@@ -1 +1 @@'", "chr(10), '+++ b/f', chr(10), '@@ -1 +1 @@'")
PROBLEM = "concat('Order of customer ', o_custkey, ' totals ', CAST(floor(o_totalprice) AS BIGINT))"
TAG = "CASE WHEN o_totalprice > 200000 THEN 'large' ELSE 'small' END"


def order_instances(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.expr(ORDER_ID).alias("instance_id"), F.expr(PROBLEM).alias("problem_statement"),
        F.expr(CATEGORY).alias("category"), F.expr(DIFFICULTY).alias("difficulty"), F.expr(GOLD).alias("gold_patch"),
        F.expr(f"array('orders', {TAG})").alias("tags"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN array(concat('t', o_custkey)) ELSE CAST(array() AS ARRAY<STRING>) END").alias("fail_to_pass_tests"),
        F.expr("CAST(array() AS ARRAY<STRING>)").alias("pass_to_pass_tests"),
        "o_orderkey", "o_custkey",
    )


# JSON text of the same instances, with some fields left out, null or of the wrong type
RAW_FIELDS = f"""
    '{{"instance_id": "', {ORDER_ID}, '", "problem_statement": "', CASE WHEN o_totalprice < 20000 THEN '' ELSE {PROBLEM} END,
    '", "category": "', {CATEGORY}, '"',
    CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE concat(', "difficulty": "', {DIFFICULTY}, '"') END,
    CASE WHEN o_totalprice > 400000 THEN ', "tags": "large"' WHEN o_totalprice > 390000 THEN ', "tags": null' ELSE concat(', "tags": ["', {TAG}, '"]') END,
    ', "gold_patch": "', CASE WHEN o_totalprice > 300000 THEN 'no diff' WHEN o_totalprice > 100000 THEN '--- a/f' ELSE '' END, '"',
    CASE WHEN o_orderstatus = 'F' THEN ', "fail_to_pass_tests": ["t"]' ELSE '' END,
    '}}'
"""


def order_raw(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        "o_orderkey", F.expr(ORDER_ID).alias("instance_id"), F.expr(f"concat({RAW_FIELDS})").alias("raw")
    )


def run_instances(spark, sf) -> DataFrame:
    """(run_id, instance_id) and facts of the order: every order in the runs F and O."""
    return table(spark, sf, "orders").select(
        F.explode_outer(F.array(F.lit("F"), F.lit("O"))).alias("run_id"),
        F.expr("concat('ord-', o_orderkey)").alias("instance_id"), "o_orderstatus", "o_orderpriority", "o_totalprice",
        F.expr(CATEGORY).alias("category"), F.expr(DIFFICULTY).alias("difficulty"),
    )


HAS_PREDICTION = "CASE WHEN run_id = 'F' THEN o_orderpriority <> '5-LOW' ELSE o_orderstatus <> 'P' END"


def predictions(spark, sf) -> DataFrame:
    """(run_id, instance_id, patch): low-priority orders have none in run F, pending ones none in run O."""
    patch = "CASE WHEN o_totalprice > 400000 THEN NULL WHEN o_totalprice > 300000 THEN '' ELSE concat('--- a/', instance_id) END"
    return run_instances(spark, sf).where(HAS_PREDICTION).select("run_id", "instance_id", F.expr(patch).alias("patch"))


def count_logs(spark, sf) -> DataFrame:
    """(run_id, instance_id, output, error, duration): counts per run and order, merged map-side."""
    flag = F.col("l_returnflag")
    counted = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_linestatus").alias("run_id"), "l_orderkey")
        .agg(
            *[F.count_if(flag == f).alias(n) for f, n in (("A", "p"), ("R", "f"), ("N", "s"))],
            F.max("l_quantity").alias("q"), F.sum("l_quantity").alias("duration"),
        )
    )
    as_json = "concat('run done\\n{\"passed\": ', p, ', \"failed\": ', f, ', \"skipped\": ', s, '}\\nbye')"
    as_text = "concat('9 passed so far\\n', p, ' passed, ', f, ' Failed\\n', s, ' skipped (', p + f + s, ' tests)')"
    return counted.select(
        "run_id", F.expr("concat('ord-', l_orderkey)").alias("instance_id"),
        F.expr(f"CASE WHEN q > 25 THEN {as_json} ELSE {as_text} END").alias("output"),
        F.expr("CASE WHEN q = 50 THEN 'timeout' END").alias("error"), "duration",
    )


COUNTS_SQL = """
    counted AS (
        SELECT l_linestatus AS run_id, concat('ord-', l_orderkey) AS instance_id,
               count(*) FILTER (WHERE l_returnflag = 'A') AS p, count(*) FILTER (WHERE l_returnflag = 'R') AS f,
               count(*) FILTER (WHERE l_returnflag = 'N') AS s, max(l_quantity) AS q, sum(l_quantity) AS duration
        FROM lineitem GROUP BY ALL)
"""
EVALUATED_SQL = f"""
    {COUNTS_SQL},
    runs AS (
        SELECT run_id, concat('ord-', o_orderkey) AS instance_id, o_orderkey, o_orderstatus, o_orderpriority, o_totalprice,
               {CATEGORY} AS category, {DIFFICULTY} AS difficulty, {HAS_PREDICTION} AS has_prediction
        FROM orders, (VALUES ('F'), ('O')) r(run_id)),
    evaluated AS (
        SELECT run_id, instance_id, category, difficulty, o_orderpriority,
               CASE WHEN NOT has_prediction THEN 'skipped' WHEN q = 50 THEN 'error' WHEN f = 0 AND p > 0 THEN 'resolved' ELSE 'unresolved' END AS status,
               has_prediction AS patch_applied,
               CAST(CASE WHEN has_prediction THEN coalesce(p, 0) ELSE 0 END AS BIGINT) AS passed,
               CAST(CASE WHEN has_prediction THEN coalesce(f, 0) ELSE 0 END AS BIGINT) AS failed,
               CAST(CASE WHEN has_prediction THEN coalesce(s, 0) ELSE 0 END AS BIGINT) AS skipped,
               CASE WHEN has_prediction THEN coalesce(duration, 0.0) ELSE 0.0 END AS duration,
               CASE WHEN NOT has_prediction THEN 'No prediction provided' WHEN q = 50 THEN 'timeout' END AS error_message
        FROM runs LEFT JOIN counted USING (run_id, instance_id))
"""

# --- events as model calls ------------------------------------------------------------------

MODEL_ARRAY = "array(" + ", ".join(f"'{m}'" for m in MODELS) + ")"
MODEL_LIST = "[" + ", ".join(f"'{m}'" for m in MODELS) + "]"
RUN_OF_EVENT = "concat('run-', event_type)"


def inference_rows(spark, sf) -> DataFrame:
    """(run_id, instance_id, model, tokens, latency, success, patch, ts): a model call per event."""
    return table(spark, sf, "events").select(
        F.expr("concat('run-', user_id % 5)").alias("run_id"), F.expr("concat('ev-', event_id)").alias("instance_id"),
        F.expr(f"element_at({MODEL_ARRAY}, CAST(user_id % 12 + 1 AS INT))").alias("model"),
        F.expr("CAST(floor(value * 100) AS BIGINT)").alias("input_tokens"),
        F.expr("CAST(floor(value * 10) AS BIGINT)").alias("output_tokens"),
        F.col("value").alias("latency_seconds"), F.expr("event_type <> 'error'").alias("success"),
        F.expr("CASE event_type WHEN 'click' THEN '--- a/x' WHEN 'purchase' THEN '+++ b/x' WHEN 'view' THEN '' END").alias("extracted_patch"),
        "ts", "event_id", "user_id",
    )


# --- documents as model responses -----------------------------------------------------------

HUNK = "concat('--- a/doc', doc_id, '.md\\n+++ b/doc', doc_id, '.md\\n@@ -1 +1 @@\\n-old ', n_chars, '\\n+new ', n_chars)"


def responses(spark, sf) -> DataFrame:
    """(doc_id, model, response): the whole text of a document, with a patch put in by one of the
    usual ways, or none."""
    text = f"""
        CASE n_chars % 6
          WHEN 0 THEN concat(text, '\\n```diff\\n', {HUNK}, '\\n```\\nDone.')
          WHEN 1 THEN concat(text, '\\n<patch>\\n', {HUNK}, '\\n</patch>')
          WHEN 2 THEN concat('<DIFF> ', {HUNK}, '</DIFF>\\n', text)
          WHEN 3 THEN concat(text, '\\n', {HUNK}, '\\nHope this helps\\n', text)
          WHEN 4 THEN concat('```js\\nlet a = 1;\\n```\\n', text)
          ELSE text END
    """
    return table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("model"), "n_chars", F.expr(text).alias("response")
    )


def broken_patches(spark, sf) -> DataFrame:
    """(doc_id, model, patch): a patch per document whose body is the whole text, with one flaw."""
    added = "concat_ws('\\n', transform(split(text, '\\n', -1), x -> concat('+', x)))"
    patch = f"""
        CASE n_chars % 6
          WHEN 0 THEN concat('--- doc.md\\n+++ doc.md\\n@@ -0,0 +1,9 @@\\n', {added})
          WHEN 1 THEN concat('--- a/doc.md\\r\\n+++ b/doc.md\\r\\n@@ -1 +1 @@\\r\\n', {added}, '\\n')
          WHEN 2 THEN concat('--- /dev/null\\n+++ b/doc.md\\n@@-3 +4,5@@ fn\\nlost blank\\n', {added}, '\\n')
          WHEN 3 THEN concat('--- a/doc.md\\n+++ b/doc.md\\n@@ -0,0 +1,9 @@\\n', {added}, '\\n')
          WHEN 4 THEN concat('+++ b/doc.md\\n', {added})
          ELSE '' END
    """
    return table(spark, sf, "documents").select(
        "doc_id", F.col("source").alias("model"), "n_chars", F.expr(patch).alias("patch")
    )
