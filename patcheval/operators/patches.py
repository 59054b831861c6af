"""Patches in model responses: extract, repair, validate. Row in, row out; nothing is shuffled
except the final counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patcheval.functions import text as tx

# fixed values: where a patch can stand in a response
FENCE = r"(?isU)```(?:diff|patch|unified)?\s*\n(.*?)```"
PATCH_TAG = r"(?isU)<patch>\s*(.*?)\s*</patch>"
DIFF_TAG = r"(?isU)<diff>\s*(.*?)\s*</diff>"
RAW_START = r"(?:diff\s+--git|---\s+a/|Index:)"
RAW_ALLOWED = r"(?:\s*$|#|//)"
HUNK = r"(?dU)^@@\s*-(\d+)(?:,(\d+))?\s+\+(\d+)(?:,(\d+))?\s*@@"

STAGES = ("fence", "patch_tag", "diff_tag", "raw")


def _first_diff(response: Column, pattern: str) -> Column:
    blocks = F.regexp_extract_all(response, F.lit(pattern), F.lit(1))
    return tx.strip(F.get(F.filter(blocks, tx.looks_like_diff), F.lit(0)))


def _with_raw_diff(df: DataFrame, response: str, wanted: Column) -> DataFrame:
    """Adds ``_raw``: lines from the first diff start up to the first line that belongs to no diff,
    once what was taken so far reads as a diff. Each step is a column of its own, so that nothing is
    computed again per line."""
    text = F.col(response)
    starts = text.rlike("(?mdU)^(?:" + RAW_START + ")")
    # the text from its first diff start on
    rest = F.when(wanted & starts, F.regexp_replace(text, r"(?dmsU)\A.*?^(?=" + RAW_START + ")", ""))
    foreign = "(?dU)^(?!" + "|".join([*tx.DIFF_LINE_STARTS, RAW_ALLOWED]) + ")"
    return (
        df.withColumn("_lines", tx.lines_of(rest))
        .withColumn("_shown", tx.first_index(F.col("_lines"), lambda x, i: tx.looks_like_diff(x)))
        .withColumn(
            "_end",
            tx.first_index(F.col("_lines"), lambda x, i: (i > F.col("_shown")) & (x != "") & x.rlike(foreign)),
        )
        .withColumn(
            "_taken", F.array_join(F.slice("_lines", 1, F.coalesce("_end", F.size("_lines"))), "\n")
        )
        .withColumn("_raw", F.when(tx.looks_like_diff(F.col("_taken")), tx.strip(F.col("_taken"))))
        .drop("_lines", "_shown", "_end", "_taken")
    )


def extract_patches(responses: DataFrame, response: str = "response") -> DataFrame:
    """Adds ``patch`` (null if none) and ``stage`` (fence, patch_tag, diff_tag or raw)."""
    text = F.col(response)
    found = responses.withColumns(
        {"_fence": _first_diff(text, FENCE), "_patch_tag": _first_diff(text, PATCH_TAG), "_diff_tag": _first_diff(text, DIFF_TAG)}
    )
    tagged = F.coalesce("_fence", "_patch_tag", "_diff_tag")
    found = _with_raw_diff(found, response, tagged.isNull())
    stage = F.coalesce(*[F.when(F.col(f"_{s}").isNotNull(), F.lit(s)) for s in STAGES])
    return (
        found.withColumn("patch", F.coalesce(tagged, "_raw"))
        .withColumn("stage", stage)
        .drop(*[f"_{s}" for s in STAGES])
    )


def extraction_yield(extracted: DataFrame, by=("model",)) -> DataFrame:
    """(by, stage, responses, share): where the patches came from; stage 'none' has no patch."""
    stage = F.coalesce("stage", F.lit("none"))
    counted = extracted.groupBy(*by, stage.alias("stage")).agg(F.count(F.lit(1)).alias("responses"))
    totals = counted.groupBy(*by).agg(F.sum("responses").alias("_all"))
    return counted.join(totals, list(by)).select(
        *by, "stage", "responses", (F.col("responses") / F.col("_all")).alias("share")
    )


def _repaired_line(line: Column, previous: Column) -> Column:
    """struct(line, fix) for one line, given the line before it."""
    # fixed values: prefixes of the old and the new file
    old = r"(?dU)^---\s+(?!a/)\S"
    new = r"(?dU)^\+\+\+\s+(?!b/)\S"
    is_null_old = line.rlike(r"(?dU)^---\s+/dev/null(?!\S)")
    is_null_new = line.rlike(r"(?dU)^\+\+\+\s+/dev/null(?!\S)")

    def group(n, default=None):
        g = F.regexp_extract(line, HUNK, n)
        return g if default is None else F.when(g == "", default).otherwise(g)

    hunk = F.concat(
        F.lit("@@ -"), group(1), F.lit(","), group(2, "1"), F.lit(" +"), group(3), F.lit(","), group(4, "1"),
        F.lit(" @@"), F.regexp_extract(line, HUNK + "(.*)$", 5),
    )
    lost_blank = F.coalesce(previous.startswith("@@"), F.lit(False)) & line.rlike(r"(?s)^[^+\- @\\]")

    def fixed(text, fix):
        return F.struct(text.alias("line"), F.lit(fix).alias("fix"))

    same = F.struct(line.alias("line"), F.lit(None).cast("string").alias("fix"))
    return (
        F.when(line.rlike(old), F.when(is_null_old, same).otherwise(
            fixed(F.regexp_replace(line, r"(?dU)^---\s+(\S)", "--- a/$1"), "old_prefix")))
        .when(line.rlike(new), F.when(is_null_new, same).otherwise(
            fixed(F.regexp_replace(line, r"(?dU)^\+\+\+\s+(\S)", "+++ b/$1"), "new_prefix")))
        .when(line.rlike(r"(?d)^@@.*@@"), F.when(line.rlike(HUNK) & (hunk != line), fixed(hunk, "hunk_header")).otherwise(same))
        .when(lost_blank, fixed(F.concat(F.lit(" "), line), "context_space"))
        .otherwise(same)
    )


def repair_patches(patches: DataFrame, patch: str = "patch") -> DataFrame:
    """Adds ``repaired`` and ``fixes`` (distinct codes, sorted). Empty stays empty."""
    unix = F.regexp_replace(F.col(patch), r"\r\n?", "\n")
    rows = patches.withColumn("_lines", tx.lines_of(unix))
    fixed = F.transform(
        "_lines", lambda x, i: _repaired_line(x, F.when(i > 0, F.get("_lines", i - 1)))
    )
    rows = rows.withColumn("_fixed", fixed)
    text = F.array_join(F.transform("_fixed", lambda s: s["line"]), "\n")
    rows = rows.withColumn("_text", text)
    no_newline = ~F.col("_text").endswith("\n")
    had_cr = F.contains(F.col(patch), F.lit("\r"))
    fixes = F.filter(
        F.concat(
            F.transform("_fixed", lambda s: s["fix"]),
            F.array(F.when(no_newline, F.lit("final_newline")), F.when(had_cr, F.lit("line_endings"))),
        ),
        lambda x: x.isNotNull(),
    )
    given = F.length(patch) > 0
    return (
        rows.withColumn(
            "repaired",
            F.when(given, F.when(no_newline, F.concat("_text", F.lit("\n"))).otherwise(F.col("_text"))).otherwise(F.col(patch)),
        )
        .withColumn("fixes", F.when(given, F.sort_array(F.array_distinct(fixes))).otherwise(F.array().cast("array<string>")))
        .drop("_lines", "_fixed", "_text")
    )


def _hunk_issues(patch: Column) -> Column:
    """Issues of single lines. Lines carry their number; the text is cut before each hunk line, and
    in a section everything up to a 'diff ' or 'index ' line is inside the hunk."""
    number = lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"), x)
    numbered = F.array_join(F.transform(tx.lines_of(patch), number), "\n")
    sections = tx.cut_before(numbered, r"\d+:@@")

    def with_lines(section, section_no):
        lines = F.transform(
            F.filter(tx.lines_of(section), lambda x: x != ""),
            lambda x: F.struct(
                F.substring_index(x, ":", 1).cast("int").alias("no"),
                F.substring(x, F.instr(x, ":") + 1, F.length(x)).alias("text"),
            ),
        )
        return F.struct((section_no > 0).alias("hunk"), lines.alias("lines"))

    def with_end(s):
        # where the hunk is left; an element of its own, so it is found once per section
        left = tx.first_index(s["lines"], lambda x, i: x["text"].rlike("^(?:diff|index) "))
        return F.struct(
            F.when(s["hunk"], F.coalesce(left, F.size(s["lines"]))).otherwise(0).alias("end"), s["lines"].alias("lines")
        )

    def code_of(x, i, s):
        text = x["text"]
        return (
            F.when(text.startswith("---"), F.when(~text.rlike(r"(?dU)^---\s+(a/\S+|/dev/null)"), "old_prefix"))
            .when(text.startswith("+++"), F.when(~text.rlike(r"(?dU)^\+\+\+\s+(b/\S+|/dev/null)"), "new_prefix"))
            .when(text.startswith("@@"), F.when(~text.rlike(HUNK), "hunk_header"))
            .when((i < s["end"]) & (text != "") & ~F.left(text, F.lit(1)).isin("+", "-", " ", "\\"), "unexpected_line")
        )

    def issues_of(s):
        found = F.transform(
            s["lines"],
            lambda x, i: F.struct(
                x["no"].alias("line_no"), code_of(x, i, s).alias("code"), F.left(x["text"], F.lit(50)).alias("text")
            ),
        )
        return F.filter(found, lambda f: f["code"].isNotNull())

    return F.flatten(F.transform(F.transform(F.transform(sections, with_lines), with_end), issues_of))


def validate_patches(patches: DataFrame, patch: str = "patch") -> DataFrame:
    """Adds ``issues`` array<struct<line_no, code, text>> and ``is_valid``. Issues of the whole
    patch have no line number: empty, not_a_diff (either alone), missing_header, missing_hunk."""
    text = F.col(patch)

    def whole(code):
        return F.struct(
            F.lit(None).cast("int").alias("line_no"), F.lit(code).alias("code"), F.lit("").alias("text")
        )

    of_patch = F.filter(
        F.array(
            F.when(~text.rlike("(?m)^---"), whole("missing_header")),
            F.when(~text.rlike("(?m)^@@"), whole("missing_hunk")),
        ),
        lambda x: x.isNotNull(),
    )
    issues = (
        F.when(text.isNull() | (text == ""), F.array(whole("empty")))
        .when(~tx.looks_like_diff(text), F.array(whole("not_a_diff")))
        .otherwise(F.concat(_hunk_issues(text), of_patch))
    )
    return patches.withColumn("issues", issues).withColumn("is_valid", F.size("issues") == 0)


def patch_issue_rows(validated: DataFrame, keys) -> DataFrame:
    # outer, so that Spark adds no filter that computes the issues a second time
    rows = validated.select(*keys, F.explode_outer("issues").alias("issue")).where("issue is not null")
    return rows.select(*keys, "issue.*")


def issue_histogram(validated: DataFrame, by=("model",)) -> DataFrame:
    return (
        validated.select(*by, F.explode_outer("issues.code").alias("code"))
        .where("code is not null")
        .groupBy(*by, "code")
        .agg(F.count(F.lit(1)).alias("issues"))
    )
