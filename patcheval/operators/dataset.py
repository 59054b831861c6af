"""Dataset building: canonical rows, validation, filters, merging, statistics, classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patcheval import constants as C
from patcheval.functions.positions import positions
from patcheval.functions import text as tx
from patcheval.functions.keyed import first_per_key

# a word, 'node:' in front of one, or a prompt sign on its own
TOKEN = r"node:|[\p{L}\p{N}_]+|(?<!\S)\$"

RENAMES = {
    "patch": "gold_patch",
    "FAIL_TO_PASS": "fail_to_pass_tests",
    "PASS_TO_PASS": "pass_to_pass_tests",
}
TEXT_DEFAULTS = {
    "repo": "", "base_commit": "", "version": "", "code_context": "", "gold_patch": "",
    "test_patch": "", "difficulty": "medium", "created_at": "", "source": "", "source_url": "",
    "notes": "",
}


def canonical_instances(df: DataFrame, default_repo: str = "") -> DataFrame:
    """Any instance table in the builder's columns: grading names renamed, ``hints_text`` as the
    first hint, absent columns and nulls replaced by their defaults."""
    have = set(df.columns)
    for old, new in RENAMES.items():
        if old in have and new not in have:
            df = df.withColumnRenamed(old, new)
    if "hints_text" in have and "hints" not in have:
        hint = F.when(F.length("hints_text") > 0, F.array("hints_text")).otherwise(
            F.array().cast("array<string>")
        )
        df = df.withColumn("hints", hint).drop("hints_text")
    have = set(df.columns)
    text = {**TEXT_DEFAULTS, "repo": default_repo}
    columns = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in C.REQUIRED_FIELDS]
    columns += [
        (F.coalesce(c, F.lit(d)) if c in have else F.lit(d)).alias(c) for c, d in text.items()
    ]
    none = F.array().cast("array<string>")
    columns += [(F.coalesce(c, none) if c in have else none).alias(c) for c in C.LIST_FIELDS]
    extra = [c for c in df.columns if c not in {*C.REQUIRED_FIELDS, *text, *C.LIST_FIELDS}]
    return df.select(*columns, *extra)


# --- validation -------------------------------------------------------------------------


def _is_empty(value: Column) -> Column:
    """A JSON value that is absent, null, '', 0, false, [] or {}."""
    # fixed values: how an empty value reads in JSON
    return value.isNull() | F.to_json(value).isin("null", '""', "0", "0.0", "false", "[]", "{}")


def _is_list(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("ARRAY")


def instance_issues(v: Column, strict: bool = False, accept_generated_ids: bool = False) -> Column:
    """Array of issue codes for one instance given as a variant (null if its JSON is unreadable).
    Codes are stable and listed in the order: required fields, category, difficulty, id format,
    evaluation fields, list fields."""

    def field(name):
        return F.try_variant_get(v, f"$.{name}", "variant")

    def text(name):
        return F.try_variant_get(v, f"$.{name}", "string")

    present = {n: ~_is_empty(field(n)) for n in (*C.REQUIRED_FIELDS, *C.EVALUATION_FIELDS)}
    instance_id = text("instance_id")
    id_ok = tx.has_valid_id_format(instance_id)
    if accept_generated_ids:
        id_ok = id_ok | tx.is_generated_id(instance_id)
    # an absent difficulty means the default; an explicit null or '' does not
    difficulty_bad = field("difficulty").isNotNull() & ~F.coalesce(
        text("difficulty").isin(*C.DIFFICULTIES), F.lit(False)
    )
    checks = [(v.isNull(), "not_an_object")]
    checks += [(~present[n], f"missing_required:{n}") for n in sorted(C.REQUIRED_FIELDS)]
    checks += [
        (present["category"] & ~text("category").isin(*C.CATEGORIES), "invalid_category"),
        (difficulty_bad, "invalid_difficulty"),
        (present["instance_id"] & ~id_ok, "invalid_instance_id"),
    ]
    if strict:
        checks += [(~present[n], f"missing_evaluation:{n}") for n in sorted(C.EVALUATION_FIELDS)]
        checks += [(present["gold_patch"] & ~tx.is_valid_patch(text("gold_patch")), "gold_patch_not_a_diff")]
    checks += [
        (field(n).isNotNull() & ~F.is_variant_null(field(n)) & ~_is_list(field(n)), f"not_a_list:{n}")
        for n in C.LIST_FIELDS
    ]
    return tx.codes_that_hold(*[(F.coalesce(cond, F.lit(False)), code) for cond, code in checks])


def validate_instances(
    df: DataFrame, raw: str = "raw", strict: bool = False, accept_generated_ids: bool = False
) -> DataFrame:
    """Adds ``issues`` (codes) and ``is_valid``. The JSON text is parsed once per row."""
    return _with_issues(df, raw, lambda v: instance_issues(v, strict, accept_generated_ids))


def _with_issues(df: DataFrame, raw: str, issues_of) -> DataFrame:
    parsed = df.withColumn("_v", tx.json_value(F.col(raw)))
    found = parsed.withColumn("issues", issues_of(F.col("_v"))).drop("_v")
    # a generated column: a filter on it stays above, where one on the issues themselves would parse the text again for every check
    return found.withColumn("issues", F.explode_outer(F.array("issues"))).withColumn("is_valid", F.size("issues") == 0)


def validate_grading_fields(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``issues`` (messages) and ``is_valid`` by the file-scoped rule."""
    return _with_issues(df, raw, grading_issues)


def validate_predictions(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds ``issues`` (messages) and ``is_valid`` for prediction records."""
    return _with_issues(df, raw, prediction_issues)


def invalid_instances(validated: DataFrame) -> DataFrame:
    return validated.where(~F.col("is_valid"))


def all_valid(validated: DataFrame) -> DataFrame:
    """One row: all_valid, checked, invalid."""
    invalid = F.count_if(~F.col("is_valid"))
    return validated.agg(
        (invalid == 0).alias("all_valid"), F.count(F.lit(1)).alias("checked"), invalid.alias("invalid")
    )


def issue_rows(validated: DataFrame, keys) -> DataFrame:
    """(keys, code): a row per issue."""
    # outer, so that Spark adds no filter that computes the issues a second time
    return validated.select(*keys, F.explode_outer("issues").alias("code")).where("code is not null")


def has_required_values(df: DataFrame) -> DataFrame:
    """Rows whose required fields are all given and not empty; the others are rejected."""
    condition = F.lit(True)
    for name in C.REQUIRED_FIELDS:
        condition = condition & (F.length(name) > 0)
    return df.where(condition)


def grading_issues(v: Column) -> Column:
    """Issue messages of an instance (a variant) for the file-scoped rule: six keys present, id a string, both
    lists lists, fail_to_pass not empty."""
    # FAIL_TO_PASS: null is a present key that is not a list
    fields = {n: F.try_variant_get(v, f"$.{n}", "variant") for n in C.GRADING_FIELDS}
    present = {n: f.isNotNull() for n, f in fields.items()}
    checks = [(~present[n], f"Missing required field: {n}") for n in C.GRADING_FIELDS]
    is_text = F.schema_of_variant(fields["instance_id"]) == "STRING"
    checks += [(present["instance_id"] & ~is_text, "instance_id must be a string")]
    for n in ("FAIL_TO_PASS", "PASS_TO_PASS"):
        checks += [(present[n] & ~_is_list(fields[n]), f"{n} must be a list")]
    empty = F.to_json(fields["FAIL_TO_PASS"]) == "[]"
    checks += [(present["FAIL_TO_PASS"] & empty, "FAIL_TO_PASS must not be empty")]
    return tx.codes_that_hold(*[(F.coalesce(cond, F.lit(False)), code) for cond, code in checks])


def prediction_issues(v: Column) -> Column:
    """Issues of one prediction record (a variant): no instance_id, or neither model_patch nor patch. A record
    without id is not looked at further."""

    def absent(name):
        return F.try_variant_get(v, f"$.{name}", "variant").isNull()

    no_id = absent("instance_id")
    return tx.codes_that_hold(
        (no_id, "Missing instance_id in prediction"),
        (~no_id & absent("model_patch") & absent("patch"), "Missing patch in prediction"),
    )


def first_issues(issues: DataFrame, order, limit: int = 10) -> DataFrame:
    """The first issues in ``order`` with ``more``, the number left out."""
    total = issues.agg(F.count(F.lit(1))).scalar()
    shown = issues.orderBy(*order).limit(limit)
    return shown.withColumn("more", F.greatest(total - limit, F.lit(0).cast("bigint")))


def task_issues(tasks: DataFrame) -> DataFrame:
    """Contributor task files: required fields, title length, area, category and difficulty."""
    have = set(tasks.columns)

    def given(n):
        return F.length(F.col(n).cast("string")) > 0 if n in have else F.lit(False)

    def outside(n, allowed):
        return given(n) & (~F.col(n).isin(*allowed) if n in have else F.lit(False))

    checks = [(~given(n), f"missing_required:{n}") for n in C.TASK_REQUIRED]
    if "title" in have:
        checks.append((F.length("title") > C.TASK_TITLE_MAX, "title_too_long"))
    checks += [
        (outside("area", C.TASK_AREAS), "invalid_area"),
        (outside("category", C.TASK_CATEGORIES), "invalid_category"),
        (outside("difficulty", C.TASK_DIFFICULTIES), "invalid_difficulty"),
    ]
    issues = tx.codes_that_hold(*[(F.coalesce(cond, F.lit(True)), code) for cond, code in checks])
    return tasks.withColumn("issues", issues).withColumn("is_valid", F.size("issues") == 0)


def task_conflicts(tasks: DataFrame, existing: DataFrame, key: str = "id", title: str = "title") -> DataFrame:
    """New tasks whose id or title (as normalised, by hash) is already taken, with what is."""
    title_key = F.sha2(F.lower(tx.strip(F.col(title))).cast("binary"), 256)
    ids = existing.select(key).distinct().withColumn("id_taken", F.lit(True))
    titles = existing.select(title_key.alias("_t")).distinct().withColumn("title_taken", F.lit(True))
    taken = [F.coalesce(c, F.lit(False)) for c in ("id_taken", "title_taken")]
    return (
        tasks.withColumn("_t", title_key).join(ids, key, "left").join(titles, "_t", "left").drop("_t")
        .withColumns({"id_taken": taken[0], "title_taken": taken[1]})
        .where("id_taken or title_taken")
    )


def submission_gaps(tasks: DataFrame, results: DataFrame, key: str = "instance_id") -> DataFrame:
    """Tasks without a result."""
    return tasks.join(results.select(key), key, "left_anti")


# --- filters ----------------------------------------------------------------------------


def filter_instances(
    df: DataFrame, category=None, difficulty=None, tags=None, has_gold_patch: bool | None = None
) -> DataFrame:
    """Empty arguments do not filter; ``tags`` matches any; ``has_gold_patch`` is three-valued."""
    if category:
        df = df.where(F.col("category") == category)
    if difficulty:
        df = df.where(F.col("difficulty") == difficulty)
    if tags:
        df = df.where(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    if has_gold_patch is not None:
        given = F.coalesce(F.length("gold_patch") > 0, F.lit(False))
        df = df.where(given if has_gold_patch else ~given)
    return df


def restrict_to(df: DataFrame, ids: DataFrame, key: str = "instance_id") -> DataFrame:
    """Rows whose id is listed. Spark broadcasts the list when its measured size allows, and
    shuffles both sides when not."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def lookup(df: DataFrame, instance_id: str, order=()) -> DataFrame:
    """The first row with an id, or none."""
    rows = df.where(F.col("instance_id") == instance_id)
    return (rows.orderBy(*order) if order else rows).limit(1)


def select_tasks(tasks: DataFrame, areas=None, categories=None, numbers=None) -> DataFrame:
    for column, allowed in (("area", areas), ("category", categories), ("id", numbers)):
        if allowed:
            tasks = tasks.where(F.col(column).isin(*allowed))
    return tasks


# --- merging and statistics ---------------------------------------------------------------


def dedup_first(df: DataFrame, order, key: str = "instance_id") -> DataFrame:
    """One row per id, the first in load order."""
    return first_per_key(df, [key], order)


def append_instances(existing: DataFrame, incoming: DataFrame, order, key: str = "instance_id") -> DataFrame:
    """Incoming rows with ``added``: true for the first row of an id the dataset does not have."""
    taken = existing.select(key).distinct().withColumn("_taken", F.lit(True))
    heads = first_per_key(incoming.select(key, *order), [key], order).withColumn("_head", F.lit(True))
    return (
        incoming.join(taken, key, "left").join(heads, [key, *order], "left")
        .withColumn("added", F.col("_taken").isNull() & F.coalesce("_head", F.lit(False)))
        .drop("_taken", "_head")
    )


def stats_lines(stats: DataFrame) -> DataFrame:
    """(section, line_no, line): the printed counts per category and per difficulty, by value."""
    text = F.concat(F.lit("    "), "value", F.lit(": "), F.col("instances").cast("string")).alias("line")
    return positions(stats.where("section <> 'total'"), ["section"], ["value"], out="line_no").select("section", "line_no", text)


def dataset_stats(df: DataFrame) -> DataFrame:
    """(section, value, instances, with_gold_patch, with_tests): totals, per category and per
    difficulty in one pass. Each row is expanded three-fold and merged map-side."""
    sections = F.array(
        F.struct(F.lit("total").alias("section"), F.lit("").alias("value")),
        F.struct(F.lit("category").alias("section"), F.col("category").alias("value")),
        F.struct(F.lit("difficulty").alias("section"), F.col("difficulty").alias("value")),
    )
    has_tests = (F.size("fail_to_pass_tests") > 0) | (F.size("pass_to_pass_tests") > 0)
    return (
        df.select(
            (F.length("gold_patch") > 0).alias("gold"), has_tests.alias("tests"),
            F.explode_outer(sections).alias("at"),
        )
        .groupBy("at.section", "at.value")
        .agg(
            F.count(F.lit(1)).alias("instances"),
            F.count_if("gold").alias("with_gold_patch"),
            F.count_if("tests").alias("with_tests"),
        )
    )


def load_counts(df: DataFrame, raw: str = "raw") -> DataFrame:
    """One row: read, rejected (invalid), duplicates, loaded."""
    checked = validate_instances(df, raw)
    # one merge per id, then one over ids; rejected rows travel as a count under no id
    per_id = checked.groupBy(F.when(F.col("is_valid"), F.col("instance_id")).alias("id"), "is_valid").agg(
        F.count(F.lit(1)).alias("n")
    )
    valid = F.col("is_valid")
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("read"),
        F.coalesce(F.sum(F.when(~valid, F.col("n"))), F.lit(0)).alias("rejected"),
        F.coalesce(F.sum(F.when(valid, F.col("n") - 1)), F.lit(0)).alias("duplicates"),
        F.count_if(valid).alias("loaded"),
    )


# --- lookups in the fixed tables ----------------------------------------------------------


def runtime_version(key: Column) -> Column:
    """Version of a release prefix, a YYYY-MM month or 'latest', by equality only."""
    out = F
    for name, version in C.RUNTIME_VERSIONS.items():
        out = out.when(key == name, version)
    return out.otherwise(C.DEFAULT_RUNTIME_VERSION)


def component_of(text: Column) -> Column:
    """Component with the most keyword hits, the first in table order on ties, 'other' without
    any. A keyword hits when it stands as a whole token; the text is cut into tokens once."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))
    every = sorted({k for ks in C.COMPONENT_KEYWORDS.values() for k in ks})
    known = F.filter(tokens, lambda t: t.isin(*every))

    def hits(kept: Column, ordinal: int, component: str) -> Column:
        keywords = C.COMPONENT_KEYWORDS[component]
        return F.struct(
            F.size(F.filter(kept, lambda t: t.isin(*keywords))).alias("n"),
            F.lit(-ordinal).alias("first"), F.lit(component).alias("component"),
        )

    def best_of(kept: Column) -> Column:
        return F.array_max(F.array(*[hits(kept, i, c) for i, c in enumerate(C.COMPONENT_KEYWORDS)]))

    # transform over a one-element array binds the token list once for all components
    best = F.get(F.transform(F.array(known), best_of), F.lit(0))
    return F.when(best["n"] > 0, best["component"]).otherwise(C.OTHER_COMPONENT)
