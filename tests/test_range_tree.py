"""Hash trees over ranges of row digests, and packages held against copies."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import rows
from patcheval.sources import range_tree as rt
from patcheval.sources import sinks

SCHEMA = "run_id string, instance_id string, status string"


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def tree(spark, data, like=None):
    return rt.range_tree(sinks.row_checksums(table(spark, data)), like=like)


def plain_root(entries: Counter, depth: int, place: str = "") -> str:
    here = {c: n for c, n in entries.items() if c.startswith(place)}
    if len(place) == depth:
        text = "rows:" + ",".join(f"{c}:{n}" for c, n in sorted(here.items()))
    else:
        below = sorted({c[: len(place) + 1] for c in here})
        text = "ranges:" + ",".join(f"{p}:{plain_root(entries, depth, p)}" for p in below)
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    return [(run, f"i{i}", rng.choice("abc")) for run, n in (("big", 5000), ("small", 40), (None, 3)) for i in range(n)] + [("big", "hot", str(i)) for i in range(2000)] + [("small", "same", "x")] * 500


def test_roots_against_plain(spark, data):
    shuffled = data[:]
    random.Random(1).shuffle(shuffled)
    got = rt.roots(tree(spark, data)).collect()
    assert sorted(got, key=str) == sorted(rt.roots(tree(spark, shuffled)).collect(), key=str)
    checked = sinks.row_checksums(table(spark, data)).collect()
    for r in got:
        run = {'{"run_id":"big"}': "big", '{"run_id":"small"}': "small", '{"run_id":null}': None}[r.part]
        entries = Counter(c.checksum for c in checked if c.run_id == run)
        assert r.rows == sum(entries.values())
        assert r.root == plain_root(entries, 2 if run == "big" else 0)
    assert tree(spark, []).count() == 0


def test_differences(spark, data, tmp_path):
    path = sinks.submission(table(spark, data), str(tmp_path / "p"), {"k": 1})
    assert sinks.verify_submission(table(spark, data[::-1]).repartition(3), path).count() == 0
    copy = [r for r in data if r[:2] not in {("big", "i7"), (None, "i0")}]
    copy.remove(("small", "same", "x"))
    copy = [("big", "i9", "other") if r[:2] == ("big", "i9") else ("big", "hot", "new") if r == ("big", "hot", "3") else r for r in copy]
    copy += [("big", "i7000", "a"), ("new", "i1", "a"), ("new", "i1", "a"), ("big", None, "a")]
    want = {
        ("big", "i7"): ("missing", 1, 0), (None, "i0"): ("missing", 1, 0), ("small", "same"): ("missing", 1, 0), ("big", "i9"): ("changed", 1, 1),
        ("big", "hot"): ("changed", 1, 1), ("big", "i7000"): ("extra", 0, 1), ("new", "i1"): ("extra", 0, 2), ("big", None): ("extra", 0, 1),
    }
    extra = table(spark, copy).withColumn("note", F.lit("a column of its own"))
    assert {(r[0], r[1]): tuple(r)[2:] for r in sinks.verify_submission(extra, path).collect()} == want
    # everything gone
    assert sinks.verify_submission(table(spark, []), path).agg(F.sum("rows_before")).first()[0] == len(data)


def test_few_ranges_are_read(spark, data):
    nodes = tree(spark, data)
    changed = [("big", "i9", "other") if r[:2] == ("big", "i9") else r for r in data]
    ranges = rows(rt.differing_ranges(nodes, tree(spark, changed, like=nodes)))
    assert 1 <= len(ranges) <= 2 and {r[2] for r in ranges} == {2}
    assert nodes.where("level = 2").count() > 200


def test_stored_rows_that_were_altered(spark, data, tmp_path):
    path = sinks.submission(table(spark, data), str(tmp_path / "p"), {})
    assert sinks.damaged_ranges(spark, path).count() == 0
    stored = spark.read.parquet(path + "/results").withColumn("status", F.when(F.col("instance_id") == "i12", "z").otherwise(F.col("status")))
    bad = str(tmp_path / "q")
    stored.write.parquet(bad + "/results")
    spark.read.parquet(path + "/tree").write.partitionBy("level").parquet(bad + "/tree")
    parts = {r.part for r in sinks.damaged_ranges(spark, bad).collect()}
    assert parts == {'{"run_id":"big"}', '{"run_id":"small"}'}
