import datetime as dt

import pytest
from pyspark.sql import functions as F

from parley.operators import integrity, jobs, transcript

NOW = dt.datetime(2025, 1, 1, 12)
AGO = lambda s: NOW - dt.timedelta(seconds=s)


def test_stale_jobs_have_failed(spark):
    rows = [("a", "running", AGO(500)), ("b", "running", AGO(10)), ("c", "running", AGO(500)), ("d", "queued", AGO(60)), ("e", "labeled", AGO(9999)), ("f", "running", None)]
    made = spark.createDataFrame(rows, "file_id string, status string, updated_at timestamp")
    signs = spark.createDataFrame([("a", AGO(59)), ("a", AGO(400)), ("c", AGO(61))], "file_id string, at timestamp")
    got = {r.file_id: r.status for r in jobs.observed(made, signs, F.lit(NOW)).collect()}
    assert got == {"a": "running", "b": "running", "c": "failed", "d": "failed", "e": "labeled", "f": "failed"}


def test_costs_take_the_upper_median_of_recent_jobs(spark):
    made = spark.createDataFrame([(i, "labeled" if i != 3 else "failed", AGO(i), 100.0) for i in range(8)], "file_id long, status string, updated_at timestamp, duration_s double")
    rows = [(i, stage, AGO(1000), AGO(1000 - took), code) for i, took in enumerate([10, 40, 20, 1, 30, 50, 60, 70]) for stage in ("asr", "index") for code in [int(i == 0 and stage == "index")]]
    stages = spark.createDataFrame(rows, "file_id long, stage string, started_at timestamp, finished_at timestamp, returncode int")
    assert {r.stage: r.cost for r in jobs.stage_costs(made, stages).collect()} == {"asr": 0.3, "index": 40.0}


def test_migrations_run_once_and_in_order(spark, tmp_path):
    ran = []
    step = lambda n: lambda *_: ran.append(n)

    def broken(*_):
        raise RuntimeError("no")

    root = str(tmp_path)
    first = jobs.Migrations(spark, root, {"002_b": step(2), "001_a": step(1)})
    assert first.pending() == ["001_a", "002_b"] and first.apply() == ["001_a", "002_b"] and first.apply() == [] and ran == [1, 2]
    later = jobs.Migrations(spark, root, {"002_b": step(2), "001_a": step(1), "003_c": step(3), "004_d": broken, "005_e": step(5)})
    with pytest.raises(RuntimeError):
        later.apply()
    assert ran == [1, 2, 3] and later.pending() == ["004_d", "005_e"]
    for wrong in ({"1_a": step(1)}, {"001_a": step(1), "001_b": step(1)}):
        with pytest.raises(ValueError):
            jobs.Migrations(spark, root, wrong)


def test_turn_rules(spark):
    rows = [("f", 1, "A", 0.0, 2.0, "x"), ("f", 2, "B", 2.0, 1.0, "x"), ("f", 3, "C", 2.5, float("nan"), "x"), ("f", 5, "A", 3.0, 4.0, " "), ("g", 1, "A", None, 1.0, "x")]
    turns = spark.createDataFrame(rows, "file string, turn_id long, speaker string, start_s double, end_s double, text string")
    speakers = spark.createDataFrame([("f", "A"), ("f", "B"), ("g", "A")], "file string, speaker string")
    got = {(r.file, r.turn_id, r.rule) for r in integrity.turn_rules(turns, speakers).collect()}
    assert got == {("f", 2, "length"), ("f", 2, "gap"), ("f", 3, "finite"), ("f", 3, "speaker"), ("f", 5, "sequence"), ("f", 5, "text"), ("g", 1, "finite")}


def test_shading(spark):
    words = spark.createDataFrame([([("a<", 0.0, 1.0), ("b", 1.0, 2.0), ("c", 2.0, 3.0), ("d", 3.0, 4.0)],)], "w array<struct<word:string,start_s:double,end_s:double>>")
    of = lambda a, b: words.select(transcript.shaded(F.col("w"), F.lit(a), F.lit(b)).alias("x")).first().x
    assert of(1.0, 3.0) == 'a&lt; <span class="clip">b c</span> d' and of(3.5, 9.0) == 'a&lt; b c <span class="clip">d</span>' and of(8.0, 9.0) == "a&lt; b c d"
