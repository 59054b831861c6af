"""Tables that batches change bucket by bucket, and the streams that write them."""

from __future__ import annotations

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from conftest import rows
from patcheval.streaming import jobs, keyed_store

SCHEMA = "k string, v bigint"


def batch(spark, pairs):
    return spark.createDataFrame(pairs, SCHEMA)


def folders(path) -> set[str]:
    return {f"{p.parent.name}/{p.name}" for p in Path(path, "data").glob("version=*/_bucket=*")}


def test_only_touched_buckets_are_written(spark, tmp_path):
    path, rng, want = str(tmp_path / "s"), random.Random(5), {}
    for number in range(6):
        pairs = [(f"k{rng.randrange(400)}", 1000 * number + i) for i in range(300 if number == 0 else 5)] + [(None, number)]
        keyed_store.upsert(batch(spark, pairs), path, ["k"], "q", number, buckets=16, keep=None)
        new = {}
        for k, v in pairs:
            new[k] = max(v, new.get(k, v))
        want |= new
        state = keyed_store.newest(spark, path)
        assert dict(rows(keyed_store.current(spark, path))) == want
        changed = [b for b, v in state.held_by.items() if v == number + 1]
        assert len(changed) <= (16 if number == 0 else 6) and set(state.held_by.values()) <= set(range(1, number + 2))
    assert keyed_store.compact(spark, path, keep=1) > 0
    state = keyed_store.newest(spark, path)
    assert folders(path) == {f"version={v}/_bucket={b}" for b, v in state.held_by.items()}
    assert dict(rows(keyed_store.current(spark, path))) == want
    assert keyed_store.compact(spark, path) == 0


def test_repeated_and_broken_batches(spark, tmp_path):
    path = str(tmp_path / "s")
    with pytest.raises(ValueError, match="no version"):
        keyed_store.current(spark, path)
    keyed_store.upsert(batch(spark, []), path, ["k"], "q", 0)
    assert keyed_store.current(spark, path).columns == ["k", "v"] and keyed_store.current(spark, path).count() == 0
    add = lambda r: r.groupBy("k").agg(F.sum("v").alias("v"))
    for _ in range(3):
        keyed_store.upsert(batch(spark, [("a", 1), ("a", 2), ("b", 5)]), path, ["k"], "q", 1, combine=add)
    assert rows(keyed_store.current(spark, path), "k") == [("a", 3), ("b", 5)]
    # data without a manifest, as a batch leaves it that failed before its commit
    batch(spark, [("a", 99)]).withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(f"{path}/data/version=3")
    Path(path, "manifest/version=3").mkdir()
    assert rows(keyed_store.current(spark, path), "k") == [("a", 3), ("b", 5)]
    keyed_store.upsert(batch(spark, [("a", 1)]), path, ["k"], "q", 2, combine=add)
    assert rows(keyed_store.current(spark, path), "k") == [("a", 4), ("b", 5)]
    # the same number of another job is another batch
    keyed_store.upsert(batch(spark, [("a", 1)]), path, ["k"], "r", 2, combine=add)
    assert rows(keyed_store.current(spark, path), "k") == [("a", 5), ("b", 5)]


def test_running_totals_write_changed_runs_only(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "run_id string, input_tokens bigint, output_tokens bigint, cost_usd double, latency_seconds double, success boolean, extracted_patch string"

    def arrive(*runs):
        spark.createDataFrame([(r, 1, 1, 0.5, 1.0, True, "p") for r in runs], schema).coalesce(1).write.mode("append").json(source)
        jobs.running_stats(jobs.stream_files(spark, source, schema), out, check).awaitTermination()
        return dict(rows(jobs.running_totals(spark, out).select("run_id", "total_instances")))

    first = [f"r{i}" for i in range(200)]
    assert arrive(*first) == dict.fromkeys(first, 1)
    before = keyed_store.newest(spark, out)
    assert arrive("r7", "r7") == {**dict.fromkeys(first, 1), "r7": 3}
    after = keyed_store.newest(spark, out)
    # the bucket of one run was written, with all others left where they are
    assert sum(before.held_by[b] != v for b, v in after.held_by.items()) == 1
    assert arrive("new")["new"] == 1


def test_regrading_after_a_restart(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema = "run_id string, instance_id string, output string"
    for outputs in ({"1": "1 passed 0 failed", "2": "1 failed"}, {"2": "2 passed 0 failed"}, {"1": "1 failed", "3": "1 passed 0 failed"}):
        spark.createDataFrame([("r", i, o) for i, o in outputs.items()], schema).write.mode("append").json(source)
        jobs.grade_logs(jobs.stream_files(spark, source, schema), out, check, buckets=4).awaitTermination()
    got = {r.instance_id: r.status for r in jobs.merged_grades(spark, out).collect()}
    assert got == {"1": "unresolved", "2": "resolved", "3": "resolved"}
    assert len(list(Path(out, "manifest").glob("version=*"))) == 2


def test_windows_and_late_rows(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    schema, rng, start = "ts timestamp, model string, cost_usd double, latency_seconds double", random.Random(3), dt.datetime(2024, 1, 1)
    seen, windows, late = None, {}, []
    for _ in range(4):
        arrived = [(start + dt.timedelta(minutes=rng.randrange(600)), rng.choice("ab"), 0.5, 2.0) for _ in range(40)] + [(None, "a", 1.0, 1.0)]
        spark.createDataFrame(arrived, schema).coalesce(1).write.mode("append").parquet(source)
        jobs.stream_windowed_costs(jobs.stream_files(spark, source, schema, "parquet"), out, check).awaitTermination()
        times = [t for t, *_ in arrived if t]
        for t, model, *_ in (r for r in arrived if r[0]):
            hour = t.replace(minute=0)
            if seen and hour + dt.timedelta(hours=1) <= seen - dt.timedelta(minutes=10):
                late.append((t, model))
            else:
                windows[hour, model] = windows.get((hour, model), 0) + 1
        seen = max([*times, *([seen] if seen else [])])
    assert late
    got = keyed_store.current(spark, out + "/windows")
    assert {(r.window_start, r.model): r.calls for r in got.collect()} == windows
    assert sorted(rows(jobs.late_rows(spark, out).select("ts", "model"))) == sorted(late)
    everything = spark.read.parquet(source).where("ts IS NOT NULL").count()
    assert got.agg(F.sum("calls")).first()[0] + jobs.late_rows(spark, out).count() == everything
