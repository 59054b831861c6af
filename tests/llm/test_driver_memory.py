"""Exploded rows do not come to the driver, however small the table they come from is."""

from pyspark.sql import functions as F

from patcheval.functions.stage import staged
from patcheval.llm import decontaminate, exact_dedup, simhash


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark):
    return spark.createDataFrame([(1, "a b c d e f " * 4), (2, "a b c d e f " * 4), (3, None)], "doc_id long, text string")


def test_indexed_halves_are_not_broadcast(spark):
    plan = plan_of(simhash.links(spark.range(100).select(F.xxhash64("id").alias("fp"))))
    assert plan.count("SortMergeJoin") == 2 and "Broadcast" not in plan


def test_places_of_blocks_are_not_broadcast(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(exact_dedup, "staged", lambda df, name: plans.setdefault(name, plan_of(df)) and staged(df, name))
    found = plan_of(exact_dedup.identities(documents(spark), 8))
    assert plans["block-names"].count("SortMergeJoin") == 1 and plans["block-names"].count("BroadcastHashJoin") == 1  # the ranges
    assert found.count("SortMergeJoin") == 1 and "Broadcast" not in found


def test_shingles_beyond_the_limit_are_not_broadcast(spark):
    docs, index = staged(documents(spark)), staged(spark.createDataFrame([(2, 7)], "_k int, _s long"))
    assert "Broadcast" not in plan_of(decontaminate._joined(docs, index, [2], False))
    assert "Broadcast" in plan_of(decontaminate._joined(docs, index, [2], True))
