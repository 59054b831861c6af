"""Readers for the file shapes benchmark data comes in.

A path may be a file, a directory or a glob. JSON documents (a list or an object per file) are read
one file per task; lists of records that are larger than a split are cut by ``large_json`` for many tasks. JSON Lines, text
and Parquet are split by Spark. Every
reader that has an order to keep adds ``file`` and ``position``.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patcheval import schemas as S
from patcheval.functions import text as tx
from patcheval.sources.large_json import read_field, read_list_records


def _documents(spark: SparkSession, path) -> DataFrame:
    """(file, doc): whole files as text."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("doc")
    )


def _kind(doc: Column) -> Column:
    """First character that is not blank: '[' a list, '{' an object."""
    return F.regexp_extract(doc, r"\A\s*+(\S)", 1)


def _field(doc: Column, name: str, kind: str) -> Column:
    """A field of a document that is a JSON object, however large; null of other documents and where it has another type."""
    read = F.from_json(doc, f"{name} {kind}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return F.when(read["_bad"].isNull(), read[name])


def _texts(variants: Column) -> Column:
    return F.transform(variants, lambda v: F.to_json(v))


def _elements(doc: Column, wrapper: str | None, single: bool) -> Column:
    """array<string>: the JSON text of each record of a document."""
    as_list = _texts(F.from_json(doc, "array<variant>"))
    out = F.when(_kind(doc) == "[", as_list)
    is_object = _kind(doc) == "{"
    if wrapper:
        inner = _texts(_field(doc, wrapper, "array<variant>"))
        out = out.when(is_object & inner.isNotNull(), inner)
    if single:
        whole = F.try_parse_json(doc)  # a record
        out = out.when(is_object & whole.isNotNull(), F.array(F.to_json(whole)))
    message = F.concat(F.lit("not a list"), F.lit(f" or an object with '{wrapper}'") if wrapper else F.lit(""))
    return out.otherwise(F.raise_error(message))


def _larger_than_a_split(spark: SparkSession, path) -> bool:
    limit = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = list(files.globStatus(target) or [])
    inside = [f for d in found if d.isDirectory() for f in files.listStatus(d.getPath())]
    return any(f.isFile() and f.getLen() > limit for f in [*found, *inside])


def read_raw_instances(spark, path, wrapper: bool = True, single: bool = False, split: bool | None = None) -> DataFrame:
    """(file, position, raw): each record as JSON text, so that absent, null and empty stay apart.

    ``wrapper=True`` takes a list or ``{"instances": [...]}``; ``single=True`` also takes an object
    as one record; ``wrapper=False, single=True`` takes any object as one record. ``split``: a document is read by many
    tasks; by default where one is larger than a split and ``single`` is off.
    """
    if split or split is None and not single and _larger_than_a_split(spark, path):
        return read_list_records(spark, path, "instances" if wrapper else None)
    records = _elements(F.col("doc"), "instances" if wrapper else None, single)
    return _documents(spark, path).select("file", F.posexplode_outer(records).alias("position", "raw")).where(
        "raw is not null"
    )


def read_instances(
    spark, path, schema: str = S.INSTANCE, wrapper: bool = True, single: bool = False, split: bool | None = None
) -> DataFrame:
    """Typed rows of ``read_raw_instances``; JSON Lines are told by the file name (.jsonl)."""
    raw = read_raw_lines(spark, path) if str(path).rstrip("/").endswith(".jsonl") else read_raw_instances(
        spark, path, wrapper, single, split
    )
    return raw.select("file", "position", F.from_json("raw", schema).alias("r")).select("file", "position", "r.*")


def read_dataset_metadata(spark, path, split: bool | None = None) -> DataFrame:
    """(file, metadata map): the metadata object of each wrapped document. ``split``: a document is read by many tasks, and only the field
    comes into one cell; by default where one is larger than a split."""
    whole = not split if split is not None else not _larger_than_a_split(spark, path)
    metadata = _field(F.col("doc"), "metadata", "map<string, string>")
    return (_documents(spark, path) if whole else read_field(spark, path, "metadata")).select("file", metadata.alias("metadata")).where("metadata is not null")


def read_raw_lines(spark, path) -> DataFrame:
    """(file, position, raw) of a JSON Lines file. Position rises with the place in the file and is
    assigned per split, without a pass over the data."""
    return (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
            F.col("value").alias("raw"),
        )
        .where(F.length(F.trim("raw")) > 0)
        # rows of one split are numbered in order, and splits are ordered by where they start
        .select("file", F.struct("block", "row").alias("position"), "raw")
    )


def read_hub_split(spark, path, preference=("test", "train")) -> DataFrame:
    """Rows of the preferred ``split=...`` partition of a Parquet directory, else of the first one.
    The directory's names are listed to choose, and only the chosen folder is read."""
    top = str(path).rstrip("/")
    names = [n.removeprefix("split=") for n in _names(spark, f"{top}/split=*")]
    if not names:
        return spark.read.parquet(path).limit(0).drop("split")
    # folder names are escaped, and Spark would infer a number from 01
    value = {n: unquote(n) for n in names}
    best = min(names, key=lambda n: (preference.index(value[n]) if value[n] in preference else len(preference), value[n]))
    return spark.read.parquet(f"{top}/split={best}").drop("split")


def read_predictions_map(spark, path) -> DataFrame:
    """(file, instance_id, patch) of ``{"<instance_id>": "<patch>"}`` documents; others are an error. The last entry of a
    repeated id counts."""
    entries = F.when(_kind(F.col("doc")) == "{", F.from_json("doc", "map<string, string>")).otherwise(
        F.raise_error(F.lit("predictions are not an object"))
    )
    listed = _documents(spark, path).select("file", F.posexplode_outer(F.map_entries(entries)).alias("position", "e"))
    return (
        listed.where("e is not null").groupBy("file", F.col("e.key").alias("instance_id"))
        .agg(F.max_by("e.value", "position").alias("patch"))
    )


def read_raw_predictions(spark, path) -> DataFrame:
    """(file, position, raw) of a list of prediction records, or of the values of an object of them."""
    doc = F.col("doc")
    values = F.map_values(F.from_json(doc, "map<string, variant>"))
    records = F.when(_kind(doc) == "[", F.from_json(doc, "array<variant>")).otherwise(values)
    return _documents(spark, path).select(
        "file", F.posexplode_outer(_texts(records)).alias("position", "raw")
    ).where("raw is not null")


def read_predictions(spark, path) -> DataFrame:
    """Prediction records; the patch is taken from model_patch, else from patch."""
    rows = read_raw_predictions(spark, path).select("file", "position", F.from_json("raw", S.PREDICTION).alias("r"))
    return rows.select(
        "file", "position", "r.instance_id", "r.model_name_or_path",
        F.coalesce("r.model_patch", "r.patch").alias("patch"), "r.full_output", "r.run_id",
    )


def read_inference_results(spark, path) -> DataFrame:
    return spark.read.schema(S.INFERENCE_RESULT).json(path)


def results_as_predictions(results: DataFrame) -> DataFrame:
    return results.select("instance_id", F.col("model").alias("model_name_or_path"), F.col("extracted_patch").alias("patch"))


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders that fit a path or glob."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(str(path))
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return [f.getPath().getName() for f in found or []]


def path_exists(spark: SparkSession, path: str) -> bool:
    return bool(_names(spark, path))


def read_processed_ids(spark, path) -> DataFrame:
    """(instance_id), distinct, of a result file; blank, unreadable and id-less lines are skipped and
    a file that does not exist has none."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "instance_id string")
    instance_id = F.get_json_object("value", "$.instance_id")
    readable = tx.json_value(F.col("value")).isNotNull()
    return spark.read.text(path).where(readable).select(instance_id.alias("instance_id")).where(
        "instance_id is not null"
    ).distinct()


def count_corrupt_lines(spark, path) -> DataFrame:
    """One row: lines, corrupt (not JSON), without_id."""
    parsed = tx.json_value(F.col("value"))
    return spark.read.text(path).where(F.length(F.trim("value")) > 0).agg(
        F.count(F.lit(1)).alias("lines"),
        F.count_if(parsed.isNull()).alias("corrupt"),
        F.count_if(parsed.isNotNull() & F.get_json_object("value", "$.instance_id").isNull()).alias("without_id"),
    )


def read_logs(spark, path, run_id: str | None = None) -> DataFrame:
    """(run_id, instance_id, output): one log file per instance. With both ``<id>.stdout`` and
    ``<id>.stderr`` the second is put behind the first. Without ``run_id`` the name of the
    directory is taken."""
    name = F.regexp_extract("file", r"([^/]+?)(?:\.(?:log|txt|stdout|stderr))?$", 1)
    parent = F.regexp_extract("file", r"([^/]+)/[^/]+$", 1)
    parts = _documents(spark, path).select(
        (F.lit(run_id) if run_id else parent).alias("run_id"), name.alias("instance_id"),
        F.col("file").endswith(".stderr").alias("is_err"), "doc",
    )
    # at most two files per instance
    out, err = F.max(F.when(~F.col("is_err"), F.col("doc"))), F.max(F.when(F.col("is_err"), F.col("doc")))
    return parts.groupBy("run_id", "instance_id").agg(
        F.concat(F.coalesce(out, F.lit("")), F.coalesce(err, F.lit(""))).alias("output")
    )


# fixed values: a line of the task catalogue
CATALOGUE_LINE = r"^(\d+)\. \[(Bug Fix|Feature)\] (.*)$"


def catalogue_tasks(lines: DataFrame, column: str = "value") -> DataFrame:
    """(id, category, title) of catalogue lines; other lines are left out."""
    line = F.col(column)
    category = F.when(F.regexp_extract(line, CATALOGUE_LINE, 2) == "Feature", "feature").otherwise("bug_fix")
    return lines.where(line.rlike(CATALOGUE_LINE)).select(
        F.regexp_extract(line, CATALOGUE_LINE, 1).cast("bigint").alias("id"),
        category.alias("category"), F.regexp_extract(line, CATALOGUE_LINE, 3).alias("title"),
    )


def read_catalogue(spark, path) -> DataFrame:
    return catalogue_tasks(spark.read.text(path))


def read_tasks(spark, path) -> DataFrame:
    """Contributor task files, one JSON object each."""
    return spark.read.schema(S.TASK).json(path, multiLine=True)


def _report_documents(spark, path) -> DataFrame:
    return _documents(spark, path).select("file", F.from_json("doc", S.REPORT).alias("r"))


def read_report_summary(spark, path) -> DataFrame:
    """(file, summary columns, timestamp, config) of report documents; absent values are 0 or ''."""
    zero = {c.split()[0]: c.split()[1] for c in S.REPORT_SUMMARY.split(", ")}
    return _report_documents(spark, path).select(
        "file",
        *[F.coalesce(F.col(f"r.summary.{c}"), F.lit(0).cast(t)).alias(c) for c, t in zero.items()],
        F.coalesce("r.metadata.timestamp", F.lit("")).alias("timestamp"),
        F.coalesce("r.metadata.config", F.create_map().cast("map<string, string>")).alias("config"),
    )


def read_report_instances(spark, path) -> DataFrame:
    """(file, position, instance columns) of report documents."""
    return (
        _report_documents(spark, path)
        .select("file", F.posexplode_outer("r.instances").alias("position", "i"))
        .where("i is not null")
        .select("file", "position", "i.*")
    )


def read_report_parts(spark, path) -> tuple[DataFrame, DataFrame]:
    """(summary, instances) of a nested report document in the ordered text parts that ``sinks.export_report_json`` writes: a line for its
    head, one for each record and one for its end. Lines are read by as many tasks as there are splits."""
    line = F.col("value")
    lines = spark.read.text(path)
    is_head = line.startswith('{"summary": ')
    head = lines.where(is_head).select(F.from_json(F.concat(line, F.lit("]}")), S.REPORT).alias("r"))
    records = lines.where(~is_head & (line != "]}")).select(F.from_json(F.regexp_replace(line, r"\A,", ""), S.REPORT_INSTANCE).alias("i"))
    return head.select("r.summary.*", "r.metadata.timestamp", "r.metadata.config"), records.select("i.*")


def read_report_tables(spark, path) -> tuple[DataFrame, DataFrame]:
    """(summary, instances) of a report saved by ``sinks.save_report``."""
    return spark.read.parquet(f"{path}/report_summary"), spark.read.parquet(f"{path}/report_instances")
