"""Writers. Every one of them writes in parallel, a file per task."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patcheval.functions.stage import staged
from patcheval.sources.range_tree import changed_rows, differing_ranges, range_tree


def export_jsonl(df: DataFrame, path: str, mode: str = "error") -> str:
    """One object per line."""
    df.write.mode(mode).json(path, ignoreNullFields=False)
    return path


def _export_documents(records: DataFrame, start: str, end: str, path: str, mode: str) -> str:
    """Writes a column ``value`` of JSON texts so that every file is start, records, end."""

    def document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # streams the batches of one task between the brackets of one document
        begun = False
        for batch in batches:
            n = batch.num_rows
            if n:
                before = pa.array([start if not begun else ","] + [","] * (n - 1), pa.string())
                lines = pc.binary_join_element_wise(before, batch.column(0).cast(pa.string()), "")
                yield pa.RecordBatch.from_arrays([lines], ["value"])
                begun = True
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([end], pa.string())], ["value"])

    records.mapInArrow(document, "value string").write.mode(mode).text(path)
    return path


def export_json(df: DataFrame, path: str, metadata: dict | None = None, mode: str = "error") -> str:
    """JSON documents: every file is a list of records or, with ``metadata``, an object with
    metadata and instances. Readers take the directory like one document per file."""
    start, end = "[", "]"
    if metadata is not None:
        start = '{"metadata": ' + json.dumps(metadata, ensure_ascii=False) + ', "instances": ['
        end = "]}"
    records = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))
    return _export_documents(records, start, end, path, mode)


def export_predictions_map(predictions: DataFrame, path: str, mode: str = "error") -> str:
    """JSON documents of the form {"<instance_id>": "<patch>"}, a null patch as null."""
    # to_json of a one-entry map, without its braces
    entry = F.to_json(F.create_map("instance_id", "patch"), {"ignoreNullFields": "false"})
    records = predictions.select(F.substring(entry, 2, F.length(entry) - 2).alias("value"))
    return _export_documents(records, "{", "}", path, mode)


def append_results(results: DataFrame, path: str) -> str:
    """Adds result rows to a JSON Lines directory."""
    return export_jsonl(results, path, mode="append")


def save_report(summary: DataFrame, instances: DataFrame, path: str, mode: str = "error") -> str:
    """A report as two Parquet tables, the instance rows split by run."""
    summary.write.mode(mode).parquet(f"{path}/report_summary")
    instances.write.mode(mode).partitionBy("run_id").parquet(f"{path}/report_instances")
    return path


def export_report_json(
    summary: DataFrame, instances: DataFrame, path: str, run_id: str, config: dict | None = None,
    timestamp: str = "", mode: str = "error",
) -> str:
    """One run's report as one nested document, cut into ordered text parts: the parts, put one
    behind the other in the order of their names, are the JSON document."""
    run = F.col("run_id") == run_id
    metadata = {"timestamp": timestamp, "config": config or {}}
    counts = [c for c in ("total", "resolved", "unresolved", "errors", "skipped", "resolved_rate", "avg_duration", "total_duration") if c in summary.columns]
    head = summary.where(run).select(
        F.lit(0).alias("part"), F.lit("").alias("instance_id"), F.lit(0).cast("long").alias("_id"),
        F.concat(
            F.lit('{"summary": '), F.to_json(F.struct(*counts)),
            F.lit(', "metadata": ' + json.dumps(metadata, ensure_ascii=False) + ', "instances": ['),
        ).alias("value"),
    )
    rows = instances.where(run).drop("run_id")
    record = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    # records get a number, written down with them; the separator goes in front of every one but the first in order
    body = staged(
        rows.select(F.lit(1).alias("part"), "instance_id", F.monotonically_increasing_id().alias("_id"), record.alias("value")), "report-rows"
    )
    place = F.struct("instance_id", "_id")
    first = body.agg(F.min(place)).scalar()
    body = body.select("part", "instance_id", "_id", F.when(place == first, F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"))
    foot = summary.where(run).select(F.lit(2).alias("part"), F.lit("").alias("instance_id"), F.lit(0).cast("long").alias("_id"), F.lit("]}").alias("value"))
    ordered = head.unionByName(body).unionByName(foot).orderBy("part", "instance_id", "_id")
    ordered.select("value").write.mode(mode).text(path)
    return path


def export_csv(df: DataFrame, path: str, mode: str = "error") -> str:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    return path


def markdown_rows(df: DataFrame) -> DataFrame:
    """(value): table rows, with bars and line ends escaped."""
    cells = []
    for name in df.columns:
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        cells.append(F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>")))
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def export_markdown(df: DataFrame, path: str, mode: str = "error") -> str:
    """A table in text parts. The two header lines go to ``header``, the rows to ``rows``."""
    names = "| " + " | ".join(df.columns) + " |"
    rule = "|" + "|".join([" --- "] * len(df.columns)) + "|"
    header = df.sparkSession.range(2).coalesce(1).select(
        F.when(F.col("id") == 0, names).otherwise(rule).alias("value")
    )
    header.write.mode(mode).text(f"{path}/header")
    markdown_rows(df).write.mode(mode).text(f"{path}/rows")
    return path


def export_text(lines: DataFrame, path: str, order, column: str = "line", mode: str = "error") -> str:
    """Text lines in ``order``: sorted by range, so that the parts in name order are the text."""
    lines.orderBy(*order).select(F.col(column).alias("value")).write.mode(mode).text(path)
    return path


def row_checksums(df: DataFrame, columns=None) -> DataFrame:
    """Adds ``checksum``: sha-256 of the row as JSON, nulls included."""
    names = list(columns or df.columns)
    text = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return df.withColumn("checksum", F.sha2(text.cast("binary"), 256))


def run_checksums(checked: DataFrame, by=("run_id",), column: str = "checksum") -> DataFrame:
    """(by, rows, run_checksum): one checksum per run that does not depend on the order of rows.

    The row checksums are summed in four words of 15 digits, which merges map-side in any order and keeps
    repeated rows apart from single ones; the run checksum is the sha-256 of the count and the sums. It shows accidents; against
    rows made to collide, and to see which rows differ, there is ``range_tree``.
    """
    words = [
        F.conv(F.substring(column, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)
    ]
    sums = checked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(w).alias(f"_w{i}") for i, w in enumerate(words)]
    )
    text = F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"_w{i}").cast("string") for i in range(4)])
    return sums.select(*by, "rows", F.sha2(text.cast("binary"), 256).alias("run_checksum"))


def submission(results: DataFrame, path: str, config: dict, mode: str = "error", by=("run_id",)) -> str:
    """Results with row checksums, run checksums, the settings of the run and a hash tree over ranges of the row checksums, against which
    :func:`verify_submission` holds a copy."""
    spark = results.sparkSession
    row_checksums(results).write.mode(mode).parquet(f"{path}/results")
    checked = spark.read.parquet(f"{path}/results")
    run_checksums(checked, by).write.mode(mode).parquet(f"{path}/checksums")
    range_tree(checked, by).write.mode(mode).partitionBy("level").parquet(f"{path}/tree")
    settings = spark.createDataFrame([(str(k), str(v)) for k, v in sorted(config.items())], "setting string, value string")
    settings.coalesce(1).write.mode(mode).json(f"{path}/config")
    return path


def _stored_tree(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part string, place string, depth int, rows bigint, digest string, level int").parquet(f"{path}/tree")


def verify_submission(results: DataFrame, path: str, keys=("run_id", "instance_id"), by=("run_id",)) -> DataFrame:
    """(keys, status, rows_before, rows_after): how ``results`` differ from those of the package, by key; no rows if they do not.
    Columns that the package lacks do not count; an error if one is missing."""
    spark = results.sparkSession
    stored = spark.read.parquet(f"{path}/results")
    copy = staged(row_checksums(results, [c for c in stored.columns if c != "checksum"]).select(*keys, "checksum"), "copy")
    nodes = _stored_tree(spark, path)
    return changed_rows(stored, nodes, copy, range_tree(copy, by, like=nodes), keys, by)


def damaged_ranges(spark: SparkSession, path: str, by=("run_id",)) -> DataFrame:
    """(part, place, depth): ranges of the stored results, their checksums computed anew, whose digest is not the one in the package's tree."""
    stored, nodes = spark.read.parquet(f"{path}/results"), _stored_tree(spark, path)
    rows = row_checksums(stored.drop("checksum"))
    return differing_ranges(nodes, range_tree(rows, by, like=nodes))
