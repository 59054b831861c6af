"""Model calls that survive a job: answers go to a ledger by what was asked, and only what is missing there is asked."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patcheval.functions.stage import staged
from patcheval.operators.inference import CALL_FIELDS, ModelClient, call_models
from patcheval.sources.readers import path_exists

#: Columns of a ledger row besides its key.
ANSWER = [f.name for f in CALL_FIELDS]


def with_call_key(prompts: DataFrame, model: str, temperature: float = 0.0, max_tokens: int = 4096) -> DataFrame:
    """``prompts`` with ``call_key``: the digest of prompt, model and settings. Null parts count as empty."""
    parts = [F.lit(model), F.lit(repr(float(temperature))), F.lit(str(int(max_tokens))), F.coalesce("system", F.lit("")), F.coalesce("user", F.lit(""))]
    # each part with its length, so that no two lists of parts read alike
    said = [F.concat(F.octet_length(p).cast("string"), F.lit(":"), p) for p in parts]
    return prompts.withColumn("call_key", F.sha2(F.concat(*said).cast("binary"), 256))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame:
    """(call_key, answer columns): one row per key, an answer before a failure."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CALL_FIELDS)
    schema = f"call_key string, {kinds}"
    if not path_exists(spark, ledger):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(ledger)
    best = F.max_by(F.struct(*ANSWER), F.struct("success", "raw_response", "latency_seconds")).alias("a")
    return rows.groupBy("call_key").agg(best).select("call_key", "a.*")


def call_with_ledger(
    prompts: DataFrame, client_factory: Callable[[], ModelClient], model: str, ledger: str, keys=("run_id", "instance_id"),
    temperature: float = 0.0, max_tokens: int = 4096, chunk_calls: int = 100_000, task_calls: int = 200, retry_failed: bool = True, **retries,
) -> DataFrame:
    """Rows of ``inference.call_models`` for ``prompts``, asking only what the ledger does not answer yet.

    What is missing is dealt into chunks of about ``chunk_calls`` calls by its key, each one job of tasks with about ``task_calls`` calls. A
    chunk is in the ledger once its job has committed; a job that broke off, a repeated batch or another run with the same
    prompts then asks for the rest alone, and a repeated task repeats its own calls only. Prompts that are equal are asked once.
    ``retry_failed``: failures in the ledger are asked again.
    """
    spark = prompts.sparkSession
    keys = list(keys)
    keyed = staged(with_call_key(prompts.select(*keys, "system", "user"), model, temperature, max_tokens), "calls")
    known = read_ledger(spark, ledger)
    missing = keyed.join(known.where("success") if retry_failed else known, "call_key", "left_anti")
    missing = staged(missing.groupBy("call_key").agg(F.first(F.struct("system", "user")).alias("p")).select("call_key", "p.*"), "calls-missing")
    total = missing.count()
    chunks = -(-total // chunk_calls)
    for c in range(chunks):
        chunk = missing.where(F.pmod(F.xxhash64("call_key"), F.lit(chunks)) == c)
        tasks = max(1, -(-total // chunks // task_calls))
        calls = call_models(chunk.repartition(tasks, "call_key"), client_factory, ("call_key",), temperature, max_tokens, **retries)
        calls.write.mode("append").parquet(ledger)
    return keyed.join(read_ledger(spark, ledger), "call_key").select(*keys, *ANSWER)
