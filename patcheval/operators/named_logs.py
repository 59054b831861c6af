"""Logs whose tests are glyph lines (pass, fail, skip), read into test-result rows.

Input: one row per log, with the columns in ``keys`` and the whole log in one text column.
Everything up to the last step is a projection of that row: the text is cut into sections and
lines inside the row, so no line is ever shuffled. Only the recognised test lines meet in one
hash aggregation per (log, test name), where every task first merges its own rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patcheval import constants as C
from patcheval.functions import text as tx

KEYS = ("run_id", "instance_id")
ALL_GLYPHS = C.PASS_GLYPHS + C.FAIL_GLYPHS + C.SKIP_GLYPHS

WS, IN_WS, NOT_WS = tx.WS, tx.INLINE_WS, tx.NOT_WS

# fixed values: the shapes of a test line
GLYPH_LINE = rf"(?dU)^{WS}*[{ALL_GLYPHS}]{WS}+{NOT_WS}"
FAIL_GLYPH_LINE = rf"(?dU)^{WS}*[{C.FAIL_GLYPHS}]{WS}+{NOT_WS}"
GLYPH_HEAD = rf"(?dU)^{WS}*[{ALL_GLYPHS}]{WS}+"
TIME_TAIL = rf"(?dU)^[0-9.]+{WS}*m?s\]$"
SKIPPED_TAIL = rf"(?dU){WS}+\(skipped\)$"
WORDED_PASS = rf"(?diU)^(.*{NOT_WS}){WS}+\.{{2,}}{WS}+(?:pass|passed|ok)$"
WORDED_FAIL = rf"(?diU)^(.*{NOT_WS}){WS}+\.{{2,}}{WS}+(?:fail|failed|error)$"
WORDED_LINE = rf"(?diU)\.{WS}+(?:pass|passed|ok|fail|failed|error)(?:{WS}+\[[0-9.]+{WS}*m?s\])?$"
FAIL_HEAD = rf"(?dU)^{WS}*[{C.FAIL_GLYPHS}]{WS}+(.+?)(?:{WS}+\[.*\])?$"
TOTAL_TIME = rf"(?diU)(?:time|duration)(?:{WS}|:)+([0-9.]+){WS}*(ms|s|m)"
COUNTS = rf"(?diU)(\d+){WS}+pass(?:ed)?.*?(\d+){WS}+fail(?:ed)?"
ANY_GLYPH_LINE = rf"(?mdU)^{IN_WS}*[{ALL_GLYPHS}]{IN_WS}+{NOT_WS}"

STATUS_OF_RANK = (C.PASSED, C.FAILED, C.SKIPPED)


def _timed(text: Column) -> Column:
    """struct(name, ms): a trailing ' [number ms]' taken off, if a name is left in front of it."""
    tail = F.substring_index(text, "[", -1)
    before = F.left(text, F.length(text) - F.length(tail) - 1)
    name = tx.strip(before)
    has_time = (
        text.endswith("s]") & tail.rlike(TIME_TAIL) & (F.length(before) < F.length(text))
        & (name != "") & before.rlike("(?U)" + WS + "$")
    )
    number = tx.parse_duration(F.regexp_extract(tail, "^([0-9.]+)", 1))
    return F.when(has_time, F.struct(name.alias("name"), number.alias("ms"))).otherwise(
        F.struct(text.alias("name"), F.lit(None).cast("double").alias("ms"))
    )


def _hits(rows: DataFrame) -> DataFrame:
    """Adds ``hit`` struct(rank, name, duration_ms), null for a line that is no test. Glyph lines are
    told by their first character, worded ones by their last word."""
    line = F.col("line")
    body = F.when(F.col("glyphs"), F.regexp_replace(line, GLYPH_HEAD, "")).otherwise(line)
    glyph = F.when(F.col("glyphs"), F.left(tx.strip(line), F.lit(1)))
    rows = rows.withColumn("body", body).withColumn("glyph", glyph).withColumn("timed", _timed(F.col("body")))
    name, ms = F.col("timed.name"), F.col("timed.ms")

    def hit(rank, name, ms):
        return F.struct(F.lit(rank).alias("rank"), tx.strip(name).alias("name"), ms.alias("duration_ms"))

    no_time = F.lit(None).cast("double")
    by_glyph = (
        F.when(F.contains(F.lit(C.PASS_GLYPHS), F.col("glyph")), hit(0, name, ms))
        .when(F.contains(F.lit(C.FAIL_GLYPHS), F.col("glyph")), hit(1, name, ms))
        .when(
            F.contains(F.lit(C.SKIP_GLYPHS), F.col("glyph")),
            hit(2, F.regexp_replace(F.col("body"), SKIPPED_TAIL, ""), no_time),
        )
    )
    passed, failed = F.regexp_extract(name, WORDED_PASS, 1), F.regexp_extract(name, WORDED_FAIL, 1)
    by_word = F.when(passed != "", hit(0, passed, ms)).when(failed != "", hit(1, failed, ms))
    return rows.withColumn(
        "hit", F.when(line.rlike(GLYPH_LINE) & F.col("glyphs"), by_glyph).when(~F.col("glyphs"), by_word)
    )


def _lines(logs: DataFrame, keys, output: str) -> DataFrame:
    """(keys, section, line_no, line, meta columns): every line that can be a test line, plus the
    first line of every log, which carries what is known about the log as a whole."""
    log = F.col(output)
    has_glyphs = log.rlike(ANY_GLYPH_LINE)
    # log-level columns are computed below the explode: once per log, not once per section
    per_log = logs.select(
        *keys,
        has_glyphs.alias("glyphs"),
        F.when(F.length(tx.strip(log)) == 0, True).otherwise(log.isNull()).alias("is_empty"),
        tx.parse_duration_with_unit(
            F.nullif(F.regexp_extract(log, TOTAL_TIME, 1), F.lit("")), F.regexp_extract(log, TOTAL_TIME, 2)
        ).alias("total_ms"),
        (F.regexp_extract(log, TOTAL_TIME, 2) != "").alias("has_total"),
        F.nullif(F.regexp_extract(log, COUNTS, 1), F.lit("")).try_cast("bigint").alias("said_passed"),
        F.nullif(F.regexp_extract(log, COUNTS, 2), F.lit("")).try_cast("bigint").alias("said_failed"),
        F.coalesce(tx.cut_at_outdent(log), F.array(F.lit(""))).alias("bodies"),
    )
    meta = ("glyphs", "is_empty", "total_ms", "has_total", "said_passed", "said_failed")
    # the first failing line of a section owns everything below it in the section
    fail_at = F.when(
        F.col("glyphs"), tx.first_index(F.col("lines"), lambda x, i: x.rlike(FAIL_GLYPH_LINE))
    )
    owned = F.filter(
        F.transform(tx.tail_from(F.col("lines"), F.col("fail_at") + 1), tx.strip), lambda x: x != ""
    )

    def with_block(line: Column, i: Column) -> Column:
        # only the owning line carries the block, so a section is never repeated per line
        owns = i == F.col("fail_at")
        return F.struct(
            i.alias("line_no"), line.alias("line"),
            F.when(owns, F.col("message")).alias("block_message"),
            F.when(owns, F.col("stack")).alias("block_stack"),
        )

    # outer explodes: the arrays are never empty, and plain ones would make Spark add a filter
    # that computes each array a second time
    rows = (
        per_log.select(*keys, *meta, F.posexplode_outer("bodies").alias("section", "body"))
        .select(*keys, *meta, "section", tx.lines_of(F.col("body")).alias("lines"))
        .withColumn("fail_at", fail_at)
        .withColumn("owned", F.when(F.col("fail_at").isNotNull(), owned))
        .select(
            *keys, *meta, "section", "lines", "fail_at",
            F.get("owned", F.lit(0)).alias("message"),
            F.when(F.size("owned") > 1, F.array_join(tx.tail_from(F.col("owned"), F.lit(1)), "\n")).alias("stack"),
        )
        .select(*keys, *meta, "section", F.explode_outer(F.transform("lines", with_block)).alias("at"))
        .select(*keys, *meta, "section", "at.*")
    )
    candidate = F.when(F.col("glyphs"), F.col("line").rlike(GLYPH_LINE)).otherwise(
        F.col("line").rlike(WORDED_LINE)
    )
    first = (F.col("section") == 0) & (F.col("line_no") == 0)
    return rows.where(candidate | first).withColumn("is_first", first)


def _events(logs: DataFrame, keys, output: str) -> DataFrame:
    """Rows (keys, name, rank, position, ...): test hits, error blocks and one row per log."""
    line = F.col("line")
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("double")
    order = F.col("section").cast("bigint") * (1 << 30) + F.col("line_no")

    def event(kind, name, rank, duration, message, stack):
        return F.struct(
            F.lit(kind).alias("kind"), name.alias("name"), rank.alias("rank"),
            duration.alias("duration_ms"), message.alias("message"), stack.alias("stack"),
        )

    found = F.col("hit")
    test = F.when(
        F.length(found["name"]) > 0,
        event("test", found["name"], found["rank"], found["duration_ms"], no_text, no_text),
    )
    block_name = tx.strip(F.regexp_extract(line, FAIL_HEAD, 1))
    block = F.when(
        F.col("block_message").isNotNull(),
        event("block", block_name, F.lit(None).cast("int"), no_number,
              F.col("block_message"), F.col("block_stack")),
    )
    log_row = F.when(
        F.col("is_first"), event("log", no_text, F.lit(None).cast("int"), no_number, no_text, no_text)
    )
    present = F.filter(F.array(test, block, log_row), lambda x: x.isNotNull())
    return (
        _hits(_lines(logs, keys, output))
        .withColumn("order", order)
        .withColumn("event", F.explode_outer(present))
        .where("event is not null")
        .select(*keys, "is_empty", "total_ms", "has_total", "said_passed", "said_failed", "order", "event.*")
    )


def log_tests(logs: DataFrame, keys=KEYS, output: str = "output") -> DataFrame:
    """What a log says: one row per (log, name), and one with a null name per log. Results and summaries both come from it."""
    is_test, is_block, is_log = (F.col("kind") == k for k in ("test", "block", "log"))
    position = F.col("rank").cast("bigint") * (1 << 60) + F.col("order")
    return (
        _events(logs, keys, output)
        .withColumn("position", F.when(is_test, position))
        .groupBy(*keys, "name")
        .agg(
            F.min("position").alias("position"),
            F.min_by("duration_ms", "position").alias("duration_ms"),
            F.max_by("message", F.when(is_block, F.col("order"))).alias("message"),
            F.max_by("stack", F.when(is_block & F.col("stack").isNotNull(), F.col("order"))).alias("stack"),
            *[
                F.max(F.when(is_log, F.col(c))).alias(c)
                for c in ("is_empty", "total_ms", "has_total", "said_passed", "said_failed")
            ],
        )
    )


def _status() -> Column:
    rank = F.shiftright(F.col("position"), 60).cast("int")
    return F.element_at(F.array(*[F.lit(s) for s in STATUS_OF_RANK]), rank + 1)


def named_test_results(logs: DataFrame, keys=KEYS, output: str = "output", tests: DataFrame | None = None) -> DataFrame:
    """(keys, position, name, status, duration_ms, error_message, stack_trace). ``tests``: the staged ``log_tests`` of the logs.

    A name counts once per log: as passed if any line passed it, else failed, else skipped, with
    the first such line deciding the duration. ``position`` sorts like the list of tests: passed
    before failed before skipped, each in text order.
    """
    failed = F.col("status") == C.FAILED
    return (
        (log_tests(logs, keys, output) if tests is None else tests)
        .where("position is not null")
        .withColumn("status", _status())
        .select(
            *keys, "position", "name", "status", "duration_ms",
            F.when(failed, F.col("message")).alias("error_message"),
            F.when(failed, F.col("stack")).alias("stack_trace"),
        )
    )


def named_log_summary(logs: DataFrame, keys=KEYS, output: str = "output", tests: DataFrame | None = None) -> DataFrame:
    """(keys, total, passed, failed, skipped, total_duration_ms, parse_errors), a row per log. ``tests``: the staged ``log_tests`` of the logs."""
    merged = log_tests(logs, keys, output) if tests is None else tests
    is_test = F.col("position").isNotNull()
    status = F.when(is_test, _status())
    counted = merged.withColumn("status", status).groupBy(*keys).agg(
        F.count_if(is_test).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in STATUS_OF_RANK],
        *[F.max(c).alias(c) for c in ("is_empty", "total_ms", "has_total", "said_passed", "said_failed")],
    )

    def mismatch(kind):
        message = F.format_string(
            f"Parsed %d {kind} tests, but summary shows %d", F.col(kind), F.col(f"said_{kind}")
        )
        return F.col(f"said_{kind}") != F.col(kind), message

    errors = F.when(F.col("is_empty"), F.array(F.lit(C.EMPTY_OUTPUT))).otherwise(
        tx.codes_that_hold(mismatch(C.PASSED), mismatch(C.FAILED))
    )
    return counted.select(
        *keys, "total", *STATUS_OF_RANK,
        F.when(F.col("has_total"), F.col("total_ms")).alias("total_duration_ms"),
        errors.alias("parse_errors"),
    )


def test_names(test_results: DataFrame, keys=KEYS) -> DataFrame:
    return test_results.select(*keys, "position", "name")


def names_with_status(test_results: DataFrame, status: str, keys=KEYS) -> DataFrame:
    return test_results.where(F.col("status") == status).select(*keys, "position", "name")


def failed_details(test_results: DataFrame) -> DataFrame:
    return test_results.where(F.col("status") == C.FAILED)


def status_maps(test_results: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, statuses map<name, status>). Names are unique per log, and a log is one cell of the
    input, so the map is bounded by that cell."""
    entry = F.struct("name", "status")
    return test_results.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("statuses"))
