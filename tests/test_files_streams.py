"""File shapes and incremental jobs."""

from __future__ import annotations

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import rows
from patcheval.operators import reports
from patcheval.sources import readers, sinks
from patcheval.streaming import jobs
from test_reports_dataset import evaluations


def put(path: Path, value) -> str:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=1), encoding="utf-8")
    return str(path)


ONE, TWO = {"instance_id": "a", "tags": ["x"]}, {"instance_id": "b"}


def test_instance_shapes(spark, tmp_path):
    listed = put(tmp_path / "l.json", [ONE, TWO])
    wrapped = put(tmp_path / "w.json", {"metadata": {"name": "n"}, "instances": [ONE, TWO]})
    single = put(tmp_path / "s.json", ONE)
    for path in (listed, wrapped):
        assert rows(readers.read_instances(spark, path).select("position", "instance_id"), "position") == [(0, "a"), (1, "b")]
    assert readers.read_instances(spark, single, single=True).first().tags == ["x"]
    as_one = readers.read_raw_instances(spark, wrapped, wrapper=False, single=True).collect()
    assert len(as_one) == 1 and "metadata" in as_one[0].raw
    for bad in (single, put(tmp_path / "n.json", "7")):
        with pytest.raises(Exception, match="not a list"):
            readers.read_instances(spark, bad).collect()
    assert readers.read_dataset_metadata(spark, wrapped).first().metadata == {"name": "n"}


def test_jsonl_order_and_blank_lines(spark, tmp_path):
    path = put(tmp_path / "x.jsonl", "\n".join([json.dumps(ONE), "", json.dumps(TWO), "{}"]) + "\n")
    got = readers.read_instances(spark, path).orderBy("file", "position").collect()
    assert [r.instance_id for r in got] == ["a", "b", None]


def test_predictions(spark, tmp_path):
    as_map = put(tmp_path / "m.json", {"a": "p", "b": "", "c": None})
    assert rows(readers.read_predictions_map(spark, as_map).select("instance_id", "patch"), "instance_id") == [("a", "p"), ("b", ""), ("c", None)]
    with pytest.raises(Exception, match="not an object"):
        readers.read_predictions_map(spark, put(tmp_path / "bad.json", ["x"])).collect()
    records = [{"instance_id": "a", "model_patch": "p"}, {"instance_id": "b", "patch": "q"}]
    for doc in (records, {"k1": records[0], "k2": records[1]}):
        path = put(tmp_path / "r.json", doc)
        assert rows(readers.read_predictions(spark, path).select("instance_id", "patch"), "instance_id") == [("a", "p"), ("b", "q")]


def test_processed_ids(spark, tmp_path):
    assert readers.read_processed_ids(spark, str(tmp_path / "none.jsonl")).count() == 0
    path = put(tmp_path / "done.jsonl", '{"instance_id": "a"}\n\nbroken\n{"x": 1}\n{"instance_id": "a"}\n{"instance_id": "b"}\n')
    assert rows(readers.read_processed_ids(spark, path), "instance_id") == [("a",), ("b",)]
    assert tuple(readers.count_corrupt_lines(spark, path).first()) == (5, 1, 1)


def test_logs_and_catalogue(spark, tmp_path):
    put(tmp_path / "run1/a.stdout", "out\n")
    put(tmp_path / "run1/a.stderr", "err")
    put(tmp_path / "run1/b.log", "log")
    got = rows(readers.read_logs(spark, str(tmp_path / "run1")), "instance_id")
    assert got == [("run1", "a", "out\nerr"), ("run1", "b", "log")]
    path = put(tmp_path / "tasks.txt", "1. [Bug Fix] one [x]\n\n2. [Feature] two\n3. [Other] no\n")
    assert rows(readers.read_catalogue(spark, path), "id") == [(1, "bug_fix", "one [x]"), (2, "feature", "two")]


def test_hub_split(spark, tmp_path):
    for name, splits in (("a", ("train", "test")), ("b", ("x", "train")), ("c", ("y", "x"))):
        for s in splits:
            spark.createDataFrame([(s,)], "v string").write.parquet(str(tmp_path / name / f"split={s}"))
    assert [readers.read_hub_split(spark, str(tmp_path / n)).first().v for n in "abc"] == ["test", "train", "x"]


def test_report_document(spark, tmp_path):
    df = evaluations(spark)
    summary, instances = reports.report_summary(df), reports.report_instances(df)
    out = str(tmp_path / "report")
    sinks.export_report_json(summary, instances.repartition(4), out, "a", {"k": 1}, "t")
    whole = "".join(p.read_text() for p in sorted(Path(out).glob("part-*")))
    doc = json.loads(whole)
    assert doc["summary"]["total"] == 4 and [i["instance_id"] for i in doc["instances"]] == ["1", "2", "3", "4"]
    path = put(tmp_path / "one.json", whole)
    back = readers.read_report_summary(spark, path).first()
    assert (back.total, back.errors, back.timestamp, back.config) == (4, 1, "t", {"k": "1"})
    assert readers.read_report_instances(spark, path).where("status = 'error'").first().error_message == "e" * 61
    empty = put(tmp_path / "empty.json", {})
    assert readers.read_report_summary(spark, empty).first().resolved_rate == 0.0
    assert readers.read_report_instances(spark, empty).count() == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a|b", None), ("c\nd", 1)], "x string, n int")
    assert sorted(r.value for r in sinks.markdown_rows(df).collect()) == ["| a\\|b |  |", "| c<br>d | 1 |"]
    path = sinks.export_text(spark.range(50).select("id", F.col("id").cast("string").alias("line")).repartition(5), str(tmp_path / "t"), ["id"])
    text = "".join(p.read_text() for p in sorted(Path(path).glob("part-*")))
    assert text.split() == [str(i) for i in range(50)]
    a = sinks.run_checksums(sinks.row_checksums(spark.range(9).withColumn("run_id", F.lit("r"))))
    b = sinks.run_checksums(sinks.row_checksums(spark.range(9).orderBy(F.desc("id")).withColumn("run_id", F.lit("r"))))
    c = sinks.run_checksums(sinks.row_checksums(spark.range(9).union(spark.range(1)).withColumn("run_id", F.lit("r"))))
    assert a.first() == b.first() != c.first()
    lines = sinks.export_json(spark.range(3).coalesce(1), str(tmp_path / "j"))
    assert json.loads("".join(p.read_text() for p in Path(lines).glob("part-*"))) == [{"id": 0}, {"id": 1}, {"id": 2}]


def test_stream_resumes(spark, tmp_path):
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    schema = "run_id string, instance_id string, output string"

    def arrive(*ids):
        spark.createDataFrame([("r", i, f"{i} passed 0 failed") for i in ids], schema).write.mode("append").json(source)

    def run():
        jobs.append_unseen(jobs.stream_files(spark, source, schema), lambda df: df, out, check).awaitTermination()
        return sorted(r.instance_id for r in spark.read.parquet(out).collect())

    arrive("1", "2")
    assert run() == ["1", "2"]
    arrive("2", "3")
    assert run() == ["1", "2", "3"]

    def grade():
        jobs.grade_logs(jobs.stream_files(spark, source, schema), out + "-g", check + "-g").awaitTermination()
        return sorted((r.instance_id, r.status) for r in jobs.merged_grades(spark, out + "-g").collect())

    assert grade() == [(i, "resolved") for i in "123"]
    spark.createDataFrame([("r", "3", "1 failed")], schema).write.mode("append").json(source)
    assert grade()[2] == ("3", "unresolved")


def test_stream_watermark_and_inference(spark, tmp_path):
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    spark.sql("SELECT 'r' run_id, '1' instance_id, timestamp'2024-01-01' ts, 'p' problem_statement UNION ALL SELECT 'r', '1', timestamp'2024-01-01', 'p'").write.json(source)
    stream = jobs.stream_files(spark, source, "run_id string, instance_id string, ts timestamp, problem_statement string")
    jobs.append_unseen(stream, lambda df: df, out, check, ts="ts", late="1 hour").awaitTermination()
    assert spark.read.parquet(out).count() == 1
    jobs.run_inference(stream, lambda b: b.withColumn("answer", F.upper("problem_statement")), out + "-i", check + "-i").awaitTermination()
    assert [r.answer for r in spark.read.parquet(out + "-i").collect()] == ["P"]
