"""Queries over dataset instances: validation, filters, merging, statistics, lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from patcheval.constants import RUNTIME_VERSIONS
from patcheval.functions import text as tx
from patcheval.operators import dataset as ds
from patcheval.operators import inference
from patcheval.plans import samples as S
from patcheval.plans.registry import query

ISSUES = f"""
    WITH base AS (
        SELECT *, {S.ORDER_ID} AS instance_id, {S.CATEGORY} AS category, {S.DIFFICULTY} AS difficulty,
               NOT (o_orderstatus = 'O' AND o_orderpriority = '4-NOT SPECIFIED') AS has_difficulty,
               CASE WHEN o_totalprice > 300000 THEN 'no diff' WHEN o_totalprice > 100000 THEN '--- a/f' ELSE '' END AS gold
        FROM orders),
    checked AS (
        SELECT *, concat_ws('|',
            CASE WHEN o_totalprice < 20000 THEN 'missing_required:problem_statement' END,
            CASE WHEN category = 'unknown' THEN 'invalid_category' END,
            CASE WHEN has_difficulty AND difficulty = '' THEN 'invalid_difficulty' END,
            CASE WHEN instance_id LIKE 'Ord %' THEN 'invalid_instance_id' END) AS plain,
            CASE WHEN o_totalprice > 400000 THEN 'not_a_list:tags' END AS lists,
        concat_ws('|',
            CASE WHEN o_orderstatus <> 'F' THEN 'missing_evaluation:fail_to_pass_tests' END,
            CASE WHEN gold = '' THEN 'missing_evaluation:gold_patch' END,
            CASE WHEN gold = 'no diff' THEN 'gold_patch_not_a_diff' END) AS strict_only
        FROM base),
    issued AS (SELECT *, concat_ws('|', nullif(plain, ''), lists) AS issues,
                      concat_ws('|', nullif(plain, ''), nullif(strict_only, ''), lists) AS strict_issues FROM checked)
"""


@query(ISSUES + "SELECT o_orderkey, instance_id, issues, issues = '' AS is_valid FROM issued")
def validate_instances(spark, sf):
    rows = ds.validate_instances(S.order_raw(spark, sf))
    return rows.select("o_orderkey", "instance_id", F.array_join("issues", "|").alias("issues"), "is_valid")


@query(ISSUES + "SELECT o_orderkey, strict_issues AS issues FROM issued WHERE strict_issues <> ''")
def validate_instances_strict(spark, sf):
    rows = ds.invalid_instances(ds.validate_instances(S.order_raw(spark, sf), strict=True))
    return rows.select("o_orderkey", F.array_join("issues", "|").alias("issues"))


@query(ISSUES + "SELECT count(*) FILTER (WHERE issues <> '') = 0 AS all_valid, count(*) AS checked, count(*) FILTER (WHERE issues <> '') AS invalid FROM issued")
def all_instances_valid(spark, sf):
    return ds.all_valid(ds.validate_instances(S.order_raw(spark, sf)))


@query(ISSUES + """, numbered AS (
        SELECT o_orderkey, code FROM (SELECT o_orderkey, unnest(string_split(issues, '|')) AS code FROM issued WHERE issues <> ''))
    SELECT o_orderkey, code, greatest((SELECT count(*) FROM numbered) - 10, 0) AS more FROM numbered ORDER BY o_orderkey, code LIMIT 10""")
def first_ten_issues(spark, sf):
    rows = ds.issue_rows(ds.validate_instances(S.order_raw(spark, sf)), ["o_orderkey"])
    return ds.first_issues(rows, ["o_orderkey", "code"])


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority = '2-HIGH' THEN '' ELSE 'x' END AS problem FROM orders)
       WHERE length(problem) > 0""")
def has_required_values(spark, sf):
    problem = F.expr("CASE WHEN o_orderpriority = '5-LOW' THEN NULL WHEN o_orderpriority = '2-HIGH' THEN '' ELSE problem_statement END")
    priority = S.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    rows = S.order_instances(spark, sf).join(priority, "o_orderkey").withColumn("problem_statement", problem)
    return ds.has_required_values(rows).select("o_orderkey")


@query(ISSUES + ", codes AS (SELECT unnest(string_split(strict_issues, '|')) AS code FROM issued WHERE strict_issues <> '') SELECT code, count(*) AS instances FROM codes GROUP BY code")
def issue_counts(spark, sf):
    rows = ds.validate_instances(S.order_raw(spark, sf), strict=True)
    return ds.issue_rows(rows, []).groupBy("code").agg(F.count(F.lit(1)).alias("instances"))


# a record for the file-scoped rule per line item, each with one of the flaws looked for
GRADING_RAW = """
    concat('{"instance_id": ', CASE WHEN l_quantity > 45 THEN '7' ELSE concat('"li-', l_partkey, '"') END,
           CASE WHEN l_discount > 0.08 THEN '' ELSE ', "repo": "r"' END, ', "base_commit": "c", "problem_statement": null',
           CASE l_returnflag WHEN 'A' THEN ', "FAIL_TO_PASS": ["t"]' WHEN 'R' THEN ', "FAIL_TO_PASS": []' ELSE ', "FAIL_TO_PASS": "t"' END,
           CASE WHEN l_linestatus = 'F' THEN ', "PASS_TO_PASS": []' ELSE ', "PASS_TO_PASS": null' END, '}')
"""


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws('|',
        CASE WHEN l_discount > 0.08 THEN 'Missing required field: repo' END,
        CASE WHEN l_quantity > 45 THEN 'instance_id must be a string' END,
        CASE WHEN l_returnflag = 'N' THEN 'FAIL_TO_PASS must be a list' END,
        CASE WHEN l_linestatus = 'O' THEN 'PASS_TO_PASS must be a list' END,
        CASE WHEN l_returnflag = 'R' THEN 'FAIL_TO_PASS must not be empty' END) AS issues
    FROM lineitem
""")
def validate_grading_fields(spark, sf):
    raw = S.table(spark, sf, "lineitem").withColumn("raw", F.expr(GRADING_RAW))
    rows = ds.validate_grading_fields(raw)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join("issues", "|").alias("issues"))


@query("""
    SELECT event_id, CASE WHEN event_type = 'error' THEN 'Missing instance_id in prediction'
                          WHEN event_type = 'view' THEN 'Missing patch in prediction' ELSE '' END AS issues FROM events
""")
def validate_predictions(spark, sf):
    raw = F.expr("""CASE event_type WHEN 'error' THEN concat('{"model_patch": "', event_id, '"}') WHEN 'view' THEN concat('{"instance_id": "', event_id, '"}')
        WHEN 'click' THEN concat('{"instance_id": "', event_id, '", "patch": null}') ELSE concat('{"instance_id": "', event_id, '", "model_patch": ""}') END""")
    rows = ds.validate_predictions(S.table(spark, sf, "events").withColumn("raw", raw))
    return rows.select("event_id", F.array_join("issues", "|").alias("issues"))


@query("""
    SELECT p_partkey, concat_ws('|', CASE WHEN p_size < 5 THEN 'missing_required:test_file' END,
        CASE WHEN p_size > 40 THEN 'title_too_long' END, CASE WHEN p_type NOT IN ('SMALL', 'ECONOMY') THEN 'invalid_area' END,
        CASE WHEN p_size BETWEEN 10 AND 20 THEN 'invalid_category' END, CASE WHEN p_size = 30 THEN 'invalid_difficulty' END) AS issues
    FROM part
""")
def validate_tasks(spark, sf):
    tasks = S.table(spark, sf, "part").select(
        "p_partkey", F.col("p_partkey").alias("id"),
        F.expr("CASE WHEN p_size > 40 THEN repeat(p_name, 20) ELSE p_name END").alias("title"),
        F.expr("CASE WHEN p_size BETWEEN 10 AND 20 THEN 'performance' ELSE 'feature' END").alias("category"),
        F.expr("CASE p_type WHEN 'SMALL' THEN 'shell' WHEN 'ECONOMY' THEN 'ffi' ELSE 'other' END").alias("area"),
        F.expr("CASE WHEN p_size = 30 THEN 'expert' ELSE 'easy' END").alias("difficulty"),
        F.col("p_name").alias("description"), F.col("p_brand").alias("expected_behavior"),
        F.expr("CASE WHEN p_size >= 5 THEN 'test/x.test.ts' END").alias("test_file"),
    )
    return ds.task_issues(tasks).select("p_partkey", F.array_join("issues", "|").alias("issues"))


@query("""
    SELECT c_custkey AS id, c_custkey IN (SELECT s_suppkey FROM supplier) AS id_taken,
           CASE WHEN c_mktsegment = 'BUILDING' THEN 'small ring' ELSE c_name END IN (SELECT p_name FROM part) AS title_taken
    FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier) OR c_mktsegment = 'BUILDING'
""")
def task_conflicts(spark, sf):
    tasks = S.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.expr("CASE WHEN c_mktsegment = 'BUILDING' THEN ' Small Ring' ELSE c_name END").alias("title"),
    )
    existing = (
        S.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))
        .unionByName(S.table(spark, sf, "part").select(F.lit(-1).cast("bigint").alias("id"), F.col("p_name").alias("title")))
    )
    return ds.task_conflicts(tasks, existing).select("id", "id_taken", "title_taken")


@query("SELECT concat('ord-', o_orderkey) AS instance_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def submission_gaps(spark, sf):
    tasks = S.table(spark, sf, "orders").select(F.expr("concat('ord-', o_orderkey)").alias("instance_id"))
    results = S.table(spark, sf, "lineitem").select(F.expr("concat('ord-', l_orderkey)").alias("instance_id"))
    return ds.submission_gaps(tasks, results)


INSTANCES = f"""
    WITH instances AS (
        SELECT o_orderkey, o_custkey, {S.ORDER_ID} AS instance_id, {S.PROBLEM} AS problem_statement, {S.CATEGORY} AS category,
               {S.DIFFICULTY} AS difficulty, {S.GOLD_SQL} AS gold_patch, {S.TAG} AS tag, o_orderstatus = 'F' AS has_tests FROM orders)
"""


@query(INSTANCES + "SELECT instance_id, category, difficulty FROM instances WHERE category = 'feature' AND difficulty = 'hard' AND tag = 'large' AND gold_patch <> ''")
def filter_instances(spark, sf):
    rows = ds.filter_instances(S.order_instances(spark, sf), "feature", "hard", ["huge", "large"], True)
    return rows.select("instance_id", "category", "difficulty")


@query(INSTANCES + "SELECT instance_id, category FROM instances WHERE gold_patch = ''")
def filter_without_gold(spark, sf):
    return ds.filter_instances(S.order_instances(spark, sf), "", None, [], False).select("instance_id", "category")


@query("SELECT concat('ord-', o_orderkey) AS instance_id, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def restrict_to_ids(spark, sf):
    orders = S.table(spark, sf, "orders").select(F.expr("concat('ord-', o_orderkey)").alias("instance_id"), "o_custkey", "o_totalprice")
    building = S.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return ds.restrict_to(orders, building, key="o_custkey").select("instance_id", "o_totalprice")


@query(INSTANCES + "SELECT instance_id, problem_statement FROM instances WHERE instance_id = 'ord-1' ORDER BY o_orderkey LIMIT 1")
def lookup_instance(spark, sf):
    return ds.lookup(S.order_instances(spark, sf), "ord-1", ["o_orderkey"]).select("instance_id", "problem_statement")


@query(INSTANCES + """SELECT section, value, count(*) AS instances, count(*) FILTER (WHERE gold_patch <> '') AS with_gold_patch, count(*) FILTER (WHERE has_tests) AS with_tests FROM (
    SELECT 'total' AS section, '' AS value, gold_patch, has_tests FROM instances UNION ALL SELECT 'category', category, gold_patch, has_tests FROM instances
    UNION ALL SELECT 'difficulty', difficulty, gold_patch, has_tests FROM instances) GROUP BY section, value""")
def dataset_stats(spark, sf):
    return ds.dataset_stats(S.order_instances(spark, sf))


@query(INSTANCES + """SELECT section, row_number() OVER (PARTITION BY section ORDER BY value) - 1 AS line_no, concat('    ', value, ': ', count(*)) AS line FROM (
    SELECT 'category' AS section, category AS value FROM instances UNION ALL SELECT 'difficulty', difficulty FROM instances) GROUP BY section, value""")
def dataset_stats_in_order(spark, sf):
    return ds.stats_lines(ds.dataset_stats(S.order_instances(spark, sf)))


@query(ISSUES + """, valid AS (SELECT instance_id FROM issued WHERE issues = '')
    SELECT (SELECT count(*) FROM issued) AS read, (SELECT count(*) FROM issued WHERE issues <> '') AS rejected,
           count(*) - count(DISTINCT instance_id) AS duplicates, count(DISTINCT instance_id) AS loaded FROM valid""")
def load_counts(spark, sf):
    return ds.load_counts(S.order_raw(spark, sf))


# customers order often: their id as instance id makes duplicates
@query("SELECT concat('c-', o_custkey) AS instance_id, arg_min(o_orderkey, o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def dedup_first(spark, sf):
    rows = S.table(spark, sf, "orders").select(F.expr("concat('c-', o_custkey)").alias("instance_id"), "o_orderkey")
    return ds.dedup_first(rows, ["o_orderkey"])


@query("""SELECT concat('c-', o_custkey) AS instance_id, o_orderkey,
    o_custkey NOT IN (SELECT s_suppkey FROM supplier) AND row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1 AS added FROM orders""")
def append_instances(spark, sf):
    incoming = S.table(spark, sf, "orders").select(F.expr("concat('c-', o_custkey)").alias("instance_id"), "o_orderkey")
    existing = S.table(spark, sf, "supplier").select(F.expr("concat('c-', s_suppkey)").alias("instance_id"))
    return ds.append_instances(existing, incoming, ["o_orderkey"])


@query(INSTANCES + """SELECT o_orderkey, left(sha256(concat('shop/orders:', problem_statement)), 12) AS content_id,
    concat(upper(left(replace(category, '_', ''), 3)), '-', left(sha256(problem_statement), 8)) AS generated_id,
    instance_id NOT LIKE 'Ord %' AS id_ok FROM instances""")
def instance_ids(spark, sf):
    problem = F.col("problem_statement")
    return S.order_instances(spark, sf).select(
        "o_orderkey", tx.content_id(F.lit("shop/orders"), problem).alias("content_id"),
        tx.generated_id(F.col("category"), problem).alias("generated_id"), tx.has_valid_id_format(F.col("instance_id")).alias("id_ok"),
    )


@query("SELECT concat('ord-', o_orderkey) AS instance_id, 'd' AS difficulty, CASE WHEN o_orderstatus = 'F' THEN 'h' ELSE '' END AS hint, concat('p', o_custkey) AS gold_patch, 'x/y' AS repo FROM orders")
def canonical_instances(spark, sf):
    rows = S.table(spark, sf, "orders").select(
        F.expr("concat('ord-', o_orderkey)").alias("instance_id"), F.lit("d").alias("difficulty"), F.expr("concat('p', o_custkey)").alias("patch"),
        F.expr("CASE WHEN o_orderstatus = 'F' THEN 'h' ELSE '' END").alias("hints_text"),
    )
    return ds.canonical_instances(rows, default_repo="x/y").select(
        "instance_id", "difficulty", F.coalesce(F.get("hints", F.lit(0)), F.lit("")).alias("hint"), "gold_patch", "repo"
    )


_VERSION_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in RUNTIME_VERSIONS.items())


@query(f"""SELECT event_id, coalesce(version, '1.1.0') AS version FROM (
    SELECT event_id, CASE event_type WHEN 'click' THEN strftime(ts + INTERVAL (user_id) MONTH, '%Y-%m') WHEN 'view' THEN concat('1.', user_id % 4)
           WHEN 'signup' THEN 'latest' ELSE 'none' END AS key FROM events) e
    LEFT JOIN (VALUES {_VERSION_VALUES}) v(key, version) USING (key)""")
def runtime_versions(spark, sf):
    key = F.expr("CASE event_type WHEN 'click' THEN date_format(add_months(ts, CAST(user_id AS INT)), 'yyyy-MM') WHEN 'view' THEN concat('1.', user_id % 4) WHEN 'signup' THEN 'latest' ELSE 'none' END")
    return S.table(spark, sf, "events").select("event_id", ds.runtime_version(key).alias("version"))


def _component_sql() -> str:
    from patcheval.constants import COMPONENT_KEYWORDS as K

    parts = [
        f"list_count(list_filter(tokens, lambda t: t IN ({', '.join(repr(w) for w in words)})))" for words in K.values()
    ]
    scores = ", ".join(f"{{'n': {p}, 'first': {-i}, 'component': '{c}'}}" for i, (c, p) in enumerate(zip(K, parts)))
    return f"""
        SELECT page_id, CASE WHEN best.n > 0 THEN best.component ELSE 'other' END AS component FROM (
            SELECT page_id, list_max([{scores}]) AS best FROM (
                SELECT page_id, list_concat(regexp_extract_all(lower(html), 'node:|[\\p{{L}}\\p{{N}}_]+'),
                                            regexp_extract_all(concat(' ', lower(html)), '\\s\\$')) AS tokens FROM pages))
    """.replace("'$'", "' $'")


@query(_component_sql())
def classify_components(spark, sf):
    return S.table(spark, sf, "pages").select("page_id", ds.component_of(F.col("html")).alias("component"))


@query("""SELECT concat('ord-', o_orderkey) AS instance_id FROM orders WHERE o_orderstatus = 'F'
    AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) ORDER BY o_orderkey LIMIT 20""")
def pending_after_resume(spark, sf):
    """The cap of a resumed run, here 20, counts only instances that are not done."""
    named = F.expr("concat('ord-', o_orderkey)").alias("instance_id")
    orders = S.table(spark, sf, "orders")
    done = S.table(spark, sf, "lineitem").select(F.expr("concat('ord-', l_orderkey)").alias("instance_id"))
    wanted = orders.where("o_orderstatus = 'F'").select(named)
    rows = orders.select(named, "o_orderkey")
    return inference.pending_instances(rows, done, wanted, 20, ("o_orderkey",)).select("instance_id")
