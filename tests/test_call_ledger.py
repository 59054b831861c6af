"""Answers survive a job that breaks off: what is in the ledger is not asked again."""

from __future__ import annotations

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from patcheval.operators.call_ledger import call_with_ledger, read_ledger, with_call_key
from patcheval.operators.inference import EchoClient


def counting_client(folder, deadly=None):
    """Notes each call in a file of its own; ends its worker at one prompt as long as a file is there."""

    class CountingClient(EchoClient):  # made here, so that workers need not find this file
        def call(self, system, user, temperature, max_tokens):
            if user == deadly and os.path.exists(f"{folder}/bomb"):
                os._exit(1)
            with open(f"{folder}/{os.getpid()}-{os.urandom(6).hex()}", "w") as f:
                f.write(user)
            if user == "fails":
                raise RuntimeError("no")
            return super().call(system, user, temperature, max_tokens)

    return lambda: CountingClient("m")


def calls(folder):
    return Counter(open(f"{folder}/{f}").read() for f in os.listdir(folder) if f != "bomb")


def prompts_of(spark, users):
    return spark.createDataFrame([("r", f"i{k}", "s", u) for k, u in enumerate(users)], "run_id string, instance_id string, system string, user string")


def test_broken_job_asks_the_rest(spark, tmp_path):
    folder, ledger = tmp_path / "calls", str(tmp_path / "ledger")
    folder.mkdir()
    (folder / "bomb").write_text("")
    users = [f"prompt {k}" for k in range(40)] + ["prompt 3", "fails"]
    prompts = prompts_of(spark, users)
    keyed = with_call_key(prompts, "m").withColumn("c", F.pmod(F.xxhash64("call_key"), F.lit(5)))
    last = keyed.where("c = 4").first()["user"]  # of the last of five chunks

    def run(**options):
        return call_with_ledger(prompts, counting_client(str(folder), last), "m", ledger, chunk_calls=9, task_calls=3, max_retries=1, **options)

    with pytest.raises(Exception):
        run()
    kept = {r.call_key for r in read_ledger(spark, ledger).collect()}
    assert kept == {r.call_key for r in keyed.where("c < 4").collect()}
    os.remove(folder / "bomb")
    got = {r.instance_id: r for r in run(retry_failed=False).collect()}
    assert len(got) == len(users) and all(got[f"i{k}"].success == (u != "fails") for k, u in enumerate(users))
    assert got["i3"].raw_response == got["i40"].raw_response
    made, early = calls(folder), {r.user for r in keyed.where("c < 4").collect()}
    assert set(made) == set(users) and all(made[u] == 1 for u in early)
    run(retry_failed=False).count()
    assert calls(folder) == made  # nothing is missing
    run().count()
    assert calls(folder)["fails"] == made["fails"] + 1 and sum(calls(folder).values()) == sum(made.values()) + 1


def test_settings_are_part_of_the_key(spark):
    prompts = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "x"), ("", "x")], "system string, user string")
    keys = [r.call_key for r in with_call_key(prompts, "m").collect()]
    assert len(set(keys)) == 3 and keys[2] == keys[3]
    others = [with_call_key(prompts, *a).first().call_key for a in (("n",), ("m", 0.5), ("m", 0.0, 7))]
    assert len({keys[0], *others}) == 4
