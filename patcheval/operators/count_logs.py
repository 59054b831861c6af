"""Logs that only state counts: a JSON object, else words like '3 passed'. One row in, one row out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patcheval.functions import text as tx
from patcheval.operators.named_logs import KEYS

KINDS = (("passed", "pass"), ("failed", "fail"), ("skipped", "skip"))


def _last_count(log: Column, word: str) -> Column:
    """In the last line that has one: the first whole-number token whose next token contains word."""
    pattern = rf"(?iU)(?<!\S)([0-9]+)\s+[^\s]*{word}"
    lines = F.filter(tx.lines_of(log), lambda x: x.rlike(pattern))
    last = F.try_element_at(lines, F.lit(-1))
    return F.coalesce(F.regexp_extract(last, pattern, 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def count_logs(logs: DataFrame, keys=KEYS, output: str = "output", error: str | None = None) -> DataFrame:
    """(keys, passed, failed, skipped, total, error). One JSON object between the first '{' and the last '}'
    is used, whatever its keys; anything else there, two objects too, falls back to the text."""
    log = F.col(output)
    start = F.instr(log, "{")
    end = F.length(log) - F.instr(F.reverse(log), "}") + 1
    has_braces = (start > 0) & (F.instr(F.reverse(log), "}") > 0) & (end >= start)
    counts = "passed variant, failed variant, skipped variant, total variant"
    parsed = F.when(has_braces, tx.json_fields(F.substring(log, start, end - start + 1), counts))
    error_text = F.col(error) if error else F.lit(None).cast("string")

    def from_json(key):
        return F.try_variant_get(F.col(f"_json.{key}"), "$", "bigint")

    rows = logs.withColumn("_json", parsed)
    is_json = F.col("_json").isNotNull()
    counted = rows.select(
        *keys,
        *[
            F.when(is_json, F.coalesce(from_json(kind), F.lit(0).cast("bigint")))
            .otherwise(_last_count(log, word))
            .alias(kind)
            for kind, word in KINDS
        ],
        F.when(is_json, from_json("total")).alias("_total"),
        error_text.alias("error"),
    )
    summed = F.col("passed") + F.col("failed") + F.col("skipped")
    return counted.select(
        *keys, "passed", "failed", "skipped", F.coalesce("_total", summed).alias("total"), "error"
    )
