"""Batch inference: prompts in, results out, with a pluggable model client."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patcheval.operators.costs import cost_results
from patcheval.operators.patches import extract_patches, repair_patches
from patcheval.operators.prompts import PromptTexts, build_prompts


class ModelClient(Protocol):
    """What a client must offer. It is made on the executors, once per partition."""

    model: str

    def call(self, system: str, user: str, temperature: float, max_tokens: int) -> dict:
        """Returns content, input_tokens and output_tokens, or raises."""
        ...


def call_with_retry(
    client: ModelClient, system: str, user: str, temperature: float, max_tokens: int,
    max_retries: int = 3, first_delay: float = 1.0, sleep: Callable[[float], None] = time.sleep,
) -> dict:
    """Tries ``max_retries`` times with a doubling delay between tries; the last error is raised."""
    delay = first_delay
    for attempt in range(1, max_retries + 1):
        try:
            return client.call(system, user, temperature, max_tokens)
        except Exception:
            if attempt == max_retries:
                raise
            sleep(delay)
            delay *= 2
    raise ValueError("max_retries must be at least 1")


CALL_FIELDS = (
    T.StructField("model", T.StringType()),
    T.StructField("raw_response", T.StringType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
    T.StructField("latency_seconds", T.DoubleType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error", T.StringType()),
)


def call_models(
    prompts: DataFrame,
    client_factory: Callable[[], ModelClient],
    keys=("run_id", "instance_id"),
    temperature: float = 0.0,
    max_tokens: int = 4096,
    max_retries: int = 3,
    first_delay: float = 1.0,
) -> DataFrame:
    """(keys, model, raw_response, input_tokens, output_tokens, latency_seconds, success, error).

    A call that fails for good becomes a row with success=false, no response, the tokens of its
    prompt as estimated and the error text. Spark re-runs a failed task as a whole and so repeats
    its calls; keep partitions small, or write results through ``streaming.jobs.run_inference``.
    """
    keys = list(keys)
    narrow = prompts.select(*keys, "system", "user")
    schema = T.StructType([narrow.schema[k] for k in keys] + list(CALL_FIELDS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = client_factory()
        for batch in batches:
            out = {f.name: [] for f in CALL_FIELDS}
            for system, user in zip(batch["system"], batch["user"]):
                started = time.monotonic()
                try:
                    answer = call_with_retry(
                        client, system, user, temperature, max_tokens, max_retries, first_delay
                    )
                    row = (answer["content"], answer["input_tokens"], answer["output_tokens"], True, None)
                except Exception as error:  # noqa: BLE001 - every failure becomes a row
                    row = ("", len(system + user) // 4, 0, False, str(error))
                out["model"].append(client.model)
                out["latency_seconds"].append(time.monotonic() - started)
                for name, value in zip(("raw_response", "input_tokens", "output_tokens", "success", "error"), row):
                    out[name].append(value)
            yield pd.concat([batch[keys].reset_index(drop=True), pd.DataFrame(out)], axis=1)

    return narrow.mapInPandas(run, schema)


def inference_results(calls: DataFrame, metadata: dict, repair: bool = True, price_match: str = "first") -> DataFrame:
    """Calls with their patch, cost, time and metadata. Patch work runs in the JVM after the calls."""
    rows = extract_patches(calls, "raw_response").drop("stage")
    if repair:
        rows = repair_patches(rows).drop("fixes", "patch").withColumnRenamed("repaired", "patch")
    rows = cost_results(rows, match=price_match)
    patch = F.when(F.col("success") & (F.length("raw_response") > 0), F.col("patch"))
    return (
        rows.withColumn("extracted_patch", patch).drop("patch")
        .withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .withColumn(
            "metadata",
            F.struct(
                F.lit(float(metadata.get("temperature", 0.0))).alias("temperature"),
                F.lit(int(metadata.get("max_tokens", 4096))).alias("max_tokens"),
                F.lit(str(metadata.get("prompt_style", "default"))).alias("prompt_style"),
            ),
        )
    )


def pending_instances(
    instances: DataFrame,
    done: DataFrame | None = None,
    ids: DataFrame | None = None,
    max_instances: int | None = None,
    order=("position",),
    key: str = "instance_id",
    retry_failed: bool = False,
) -> DataFrame:
    """Instances still to run: listed ones only, without those already in ``done``, and the cap
    (a plain limit, 0 or None for all) applied after that. Failed results count as done unless
    ``retry_failed``."""
    if ids is not None:
        instances = instances.join(ids.select(key).distinct(), key, "left_semi")
    if done is not None:
        if retry_failed and "success" in done.columns:
            done = done.where("success")
        instances = instances.join(done.select(key).distinct(), key, "left_anti")
    if max_instances:
        # the cap leaves one partition; the calls that follow are dealt out again
        tasks = int(instances.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        instances = instances.orderBy(*order).limit(max_instances).repartition(min(max_instances, tasks))
    return instances


def run_inference(
    instances: DataFrame,
    client_factory: Callable[[], ModelClient],
    run_id: str,
    style: str = "default",
    done: DataFrame | None = None,
    ids: DataFrame | None = None,
    max_instances: int | None = None,
    order=("position",),
    temperature: float = 0.0,
    max_tokens: int = 4096,
    max_retries: int = 3,
    first_delay: float = 1.0,
    repair: bool = True,
    texts: PromptTexts = PromptTexts(),
    ask: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The whole job from instances to result rows. ``ask`` makes the calls instead of ``call_models``, as ``call_ledger.call_with_ledger`` does."""
    todo = pending_instances(instances, done, ids, max_instances, order)
    context = "code_context" if "code_context" in todo.columns else None
    prompts = build_prompts(todo.withColumn("run_id", F.lit(run_id)), style, context=context, texts=texts)
    calls = ask(prompts) if ask else call_models(
        prompts, client_factory, temperature=temperature, max_tokens=max_tokens,
        max_retries=max_retries, first_delay=first_delay,
    )
    settings = {"temperature": temperature, "max_tokens": max_tokens, "prompt_style": style}
    return inference_results(calls, settings, repair)


class EchoClient:
    """A deterministic client for tests and dry runs: answers with a one-line patch that adds the
    last line of the prompt's problem text; fails on prompts containing ``fail_on``."""

    def __init__(self, model: str = "echo", fail_on: str | None = None):
        self.model, self.fail_on = model, fail_on

    def call(self, system: str, user: str, temperature: float, max_tokens: int) -> dict:
        if self.fail_on and self.fail_on in user:
            raise RuntimeError(f"refused: {self.fail_on}")
        line = user.split("## Problem Statement", 1)[-1].strip().split("\n", 1)[0]
        content = f"```diff\n--- a/notes.txt\n+++ b/notes.txt\n@@ -0,0 +1,1 @@\n+{line}\n```"
        return {
            "content": content,
            "input_tokens": len(system + user) // 4,
            "output_tokens": len(content) // 4,
        }
