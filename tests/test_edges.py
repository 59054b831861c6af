"""Hand-made inputs that tidy data never has."""

from __future__ import annotations

import json
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from patcheval.functions import stage
from patcheval.functions import text as tx
from patcheval.operators import costs, count_logs, file_logs, grading, inference, named_logs, reports
from patcheval.sources import readers, sinks

LOG = "run_id string, instance_id string, output string"


def logs(spark, *texts):
    return spark.createDataFrame([("r", str(i), t) for i, t in enumerate(texts)], LOG)


def test_only_one_json_object_counts(spark):
    texts = ['x {"passed": 1} y', '{"passed": 1}\n{"passed": 2}', '{"passed": 1} junk }', '{"passed": 1}}', '{}],[{}', "{'passed': 4}", '{"a": {"passed": 9}} 3 passed']
    got = {r.instance_id: r.passed for r in count_logs.count_logs(logs(spark, *texts)).collect()}
    assert [got[str(i)] for i in range(len(texts))] == [1, 0, 0, 0, 0, 0, 0]


def test_json_values(spark):
    good = ["1", '"a"', "null", '{"a": [1, 2]}', " [] "]
    bad = ['{"a":1}{"a":2}', "1 2", "]", "1],[2", "", '{"a":1}]', "{"]
    df = spark.createDataFrame([(x,) for x in good + bad], "x string").select(tx.json_value(F.col("x")).isNotNull().alias("ok"))
    assert [r.ok for r in df.collect()] == [True] * len(good) + [False] * len(bad)


def test_torn_result_lines(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"instance_id": "a"}\n{"instance_id": "b"}{"instance_id": "c"}\n\n{"x": 1}\n')
    assert [r.instance_id for r in readers.read_processed_ids(spark, str(p)).collect()] == ["a"]
    assert tuple(readers.count_corrupt_lines(spark, str(p)).first()) == (3, 1, 1)


def test_last_prediction_wins(spark, tmp_path):
    given = spark.createDataFrame([("a", "p1", 0), ("a", "p2", 1), ("b", None, 5), ("b", "q", 4)], "instance_id string, patch string, position int")
    rows = grading.attach_predictions(spark.createDataFrame([("a",), ("b",), ("c",)], "instance_id string"), given)
    got = {r.instance_id: (r.patch, r.status) for r in rows.collect()}
    assert rows.count() == 3 and got == {"a": ("p2", "pending"), "b": (None, "pending"), "c": (None, "skipped")}
    p = tmp_path / "p.json"
    p.write_text('{"a": "p1", "b": "x", "a": "p2"}')
    assert {(r.instance_id, r.patch) for r in readers.read_predictions_map(spark, str(p)).collect()} == {("a", "p2"), ("b", "x")}


def test_blanks_in_front_of_a_list(spark, tmp_path):
    p = tmp_path / "i.json"
    p.write_text(" " * 5000 + "\n" + json.dumps([{"instance_id": "a"}, {"instance_id": "b"}]))
    assert readers.read_raw_instances(spark, str(p)).count() == 2
    q = tmp_path / "w.json"
    q.write_text(json.dumps({"metadata": {"n": 1}, "instances": [{"instance_id": "a"}]}))
    assert readers.read_raw_instances(spark, str(q)).count() == 1
    assert readers.read_dataset_metadata(spark, str(q)).first().metadata == {"n": "1"}


def test_marks_in_texts_survive(spark):
    named = named_logs.named_test_results(logs(spark, "✓ a\x01\x02b [3ms]\n✓ \x01\x03c [4ms]"))
    assert {(r.name, r.duration_ms) for r in named.collect()} == {("a\x01\x02b", 3.0), ("\x01\x03c", 4.0)}
    text = "test/x.test.ts:\n  n\x01\x02m ... [PASS] (1.5ms)\n"
    assert [(r.name, r.status) for r in file_logs.file_test_results(logs(spark, text)).collect()] == [("n\x01\x02m", "PASS")]


def test_blank_lines_are_cheap(spark):
    file_logs.file_test_results(logs(spark, "x")).collect()
    long = "test/x.test.ts:\n" + " " * 100_000 + "\nx" + " " * 100_000 + "y\n  a  b   ... [FAIL] (2ms)\n"
    began = time.time()
    assert [r.name for r in file_logs.file_test_results(logs(spark, long)).collect()] == ["a  b"]
    assert time.time() - began < 10


def test_capped_calls_are_spread(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("instance_id"), F.col("id").alias("position"))
    todo = inference.pending_instances(df, max_instances=100)
    assert todo.count() == 100 and todo.rdd.getNumPartitions() > 1


def test_encoder_is_made_once_a_stream(spark):
    made = spark.sparkContext.accumulator(0)

    def encoder():
        made.add(1)
        return list

    df = spark.range(0, 30_000, 1, 1).select(F.lit("abc").alias("t"))
    assert costs.count_tokens(df, "t", encoder=encoder).agg(F.sum("tokens")).first()[0] == 90_000 and made.value == 1


def test_one_separator_less(spark, tmp_path):
    rows = spark.createDataFrame([("r", "a", "x"), ("r", "a", "x"), ("r", "b", "y")], "run_id string, instance_id string, status string")
    path = sinks.export_report_json(spark.createDataFrame([("r", 3)], "run_id string, total int"), rows, str(tmp_path / "rep"), "r")
    text = "".join(p.read_text() for p in sorted((tmp_path / "rep").glob("part-*")))
    assert path and [i["instance_id"] for i in json.loads(text)["instances"]] == ["a", "a", "b"]


def test_hub_split(spark, tmp_path):
    for name in ("train", "dev"):
        spark.range(3).write.parquet(str(tmp_path / "h" / f"split={name}"))
    assert readers.read_hub_split(spark, str(tmp_path / "h")).count() == 3
    assert readers.read_hub_split(spark, str(tmp_path / "h"), ("dev",)).columns == ["id"]


def test_hub_split_names_that_are_no_words(spark, tmp_path):
    for k, name in enumerate(("01", "2024-01-02", "a:b")):
        spark.range(3 + k).selectExpr("id", f"'{name}' AS split").write.partitionBy("split").parquet(str(tmp_path / str(k)))
        got = readers.read_hub_split(spark, str(tmp_path / str(k)), (name,))
        assert got.columns == ["id"] and got.count() == 3 + k


def test_compared_runs_read_their_input_once(spark, tmp_path):
    path = str(tmp_path / "e")
    spark.createDataFrame([("F", "a", "resolved"), ("O", "a", "error"), ("F", "b", "error")], "run_id string, instance_id string, status string").write.parquet(path)
    changes = reports.run_changes(spark.read.parquet(path), "F", "O")
    assert [tuple(r) for r in changes.collect()] == [("a", "resolved", "error", "regression")]
    assert changes._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1


def test_no_local_stage_on_a_cluster():
    conf = SimpleNamespace(get=lambda key, default=None: default)
    context = SimpleNamespace(master="spark://host:7077", getConf=lambda: conf)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stage.shared_folder(SimpleNamespace(conf=conf, sparkContext=context))
