import json
import os
import sys
import time
import uuid

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from lakeseek.operators import calls, guard
from lakeseek.plans import judges

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't find test modules

FAST = {"pause": 0.01, "buckets": 3, "batch": 4, "workers": 4}


def counting(folder, act):
    """A client that leaves a file for each call, so that calls count over processes and attempts."""

    def client():
        def ask(request, seconds):
            with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                f.write(request)
            return act(request, seconds, folder)

        return ask

    return client


def made(folder):
    return sorted(open(os.path.join(folder, n)).read() for n in os.listdir(folder))


@pytest.fixture
def places(tmp_path):
    (tmp_path / "calls").mkdir()
    return str(tmp_path / "calls"), str(tmp_path / "ledger")


def echo(request, seconds, folder):
    return json.dumps({"told": request})


def test_equal_requests_cost_once_and_a_second_run_nothing(spark, places):
    folder, ledger = places
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else f"r{i % 5}") for i in range(60)], "_key int, request string").repartition(6)
    for _ in range(2):
        got = calls.replies(rows, "request", counting(folder, echo), ledger, "m", **FAST).collect()
        assert len(got) == 60 and all((r.reply is None) == (r.request is None) and r.reply_error is None for r in got)
        assert all(json.loads(r.reply)["told"] == r.request for r in got if r.request)
        assert made(folder) == [f"r{i}" for i in range(5)]
    calls.replies(rows, "request", counting(folder, echo), ledger, "another", **FAST)
    assert len(made(folder)) == 10
    assert calls.replies(rows.limit(0), "request", counting(folder, echo), ledger, "m", **FAST).count() == 0


def test_slow_failing_and_malformed_clients(spark, places):
    folder, ledger = places

    def act(request, seconds, folder):
        seen = made(folder).count(request)
        if request == "hangs":
            time.sleep(30)
        if request == "late":
            raise TimeoutError
        if request == "falls" or (request == "falls once" and seen == 1):
            raise OSError("no line")
        if request == "malformed" or (request == "malformed once" and seen == 1):
            return '{"injection": tr'
        return '{"injection": false, "supported": true}'

    names = ["fine", "hangs", "late", "falls", "falls once", "malformed", "malformed once"]
    rows = spark.createDataFrame([(n,) for n in names], "request string")
    began = time.time()
    told = calls.replies(rows, "request", counting(folder, act), ledger, "m", timeout=1.5, **FAST)
    verdict = calls.injection_verdict(F.col("reply"))
    score = calls.faithfulness(F.col("reply"), F.col("reply_error"), F.array(F.from_json("reply", "supported boolean")), lambda v: F.when(v[0]["supported"], 1.0).otherwise(0.0))
    no, weak = F.array().cast("array<string>"), F.array(F.lit("weak"))
    got = {r.request: r for r in told.select("*", guard.injection(no, weak, verdict)["action"].alias("injection"), guard.grounded(F.array(F.lit("c")), F.lit(False), score)["action"].alias("grounded")).collect()}
    assert time.time() - began < 25
    errors = {n: r.reply_error for n, r in got.items()}
    assert errors == {"fine": None, "hangs": "timeout", "late": "timeout", "falls": "failed: OSError", "falls once": None, "malformed": "malformed", "malformed once": None}
    assert {n for n, r in got.items() if r.injection == "block"} == {"hangs", "late", "falls", "malformed"}  # no verdict: closed
    assert {n for n, r in got.items() if r.grounded == "block"} == {"falls", "malformed"}  # a timeout passes unverified
    seen = made(folder)
    assert [seen.count(n) for n in names] == [1, 1, 1, 3, 2, 3, 2]
    tries = {r.key: r.tries for r in spark.read.parquet(ledger).collect()}
    assert sorted(tries.values()) == [1, 1, 1, 2, 2, 3, 3]
    healed = calls.replies(rows, "request", counting(folder, echo), ledger, "m", **FAST).collect()
    assert all(r.reply_error is None for r in healed) and len(made(folder)) == len(seen) + 4  # faults are asked anew


def test_a_task_that_starts_again_pays_for_its_last_batch_only(places):
    """The task body as Spark runs it, stopped between batches; local mode itself doesn't retry tasks."""
    import subprocess
    import sys

    folder, ledger = places
    code = f"""
import os, sys
sys.path[:0] = [{os.getcwd()!r}, {os.path.dirname(__file__)!r}]
from pyspark.sql import SparkSession
from lakeseek.operators import calls
import test_calls as t
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
def act(request, seconds, folder):
    n = len(os.listdir(folder))
    if n > 9 and not os.path.exists(folder + "-died"):
        open(folder + "-died", "w").close()
        os._exit(1)  # the Python worker is gone
    return t.echo(request, seconds, folder)
rows = spark.range(16).selectExpr("concat('q', id) AS request")
got = calls.replies(rows, "request", t.counting({folder!r}, act), {ledger!r}, "m", pause=0.01, buckets=1, batch=4, workers=1).collect()
assert len(got) == 16 and all(r.reply for r in got), got
"""
    env = dict(os.environ, PYTHONPATH=os.getcwd() + os.pathsep + os.path.dirname(__file__))
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120, env=env, capture_output=True)
    assert os.path.exists(folder + "-died")
    asked = made(folder)
    assert len(set(asked)) == 16 and len(asked) <= 16 + 4  # no more than one batch twice
    assert len([n for n in os.listdir(ledger) if n.endswith(".parquet") and not n.startswith("_")]) == 4


def test_judged_turns(spark, places):
    folder, ledger = places
    talk = spark.createDataFrame([(1, 0, "user", "red green blue"), (1, 1, "assistant", "Red green. violet mauve"), (1, 2, "user", None), (1, 3, "assistant", "red"), (2, 0, "assistant", None), (1, 1, "assistant", "Red green. violet mauve")], "conv_id long, turn int, role string, text string")
    got = sorted((r.conv_id, r.turn, r.faithfulness, r.action, r.reason) for r in judges.judged_turns(talk, ledger, **FAST).collect())
    assert got == [(1, 1, 0.5, "block", "not faithful")] * 2 + [(1, 3, 0.0, "block", "no context"), (2, 0, 0.0, "block", "no context")]
