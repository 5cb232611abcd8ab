import random
import time

from pyspark.sql import functions as F

from parley.operators import transcript as T


def words(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "conv_id long, pos long, speaker string, word string, start_s double, end_s double")


def test_assignment_majority_then_nearest(spark):
    w = spark.createDataFrame([(1, 0, "a", 9.8, 10.8), (1, 1, "b", 11.2, 11.9), (1, 2, "c", 3.0, 3.5), (1, 3, "d", 40.0, 41.0)], "conv_id long, pos long, word string, start_s double, end_s double")
    iv = spark.createDataFrame([(1, 0, "S0", 0.0, 10.0), (1, 1, "S1", 12.0, 20.0)], "conv_id long, place long, speaker string, start double, end double")
    assert [r.speaker for r in T.assign_speakers(w, iv).orderBy("pos").collect()] == ["S0", "S1", "S0", "S1"]


def test_smoothing_has_no_cascade(spark):
    w = words(spark, [(s, "w", 0.5 * i, 0.5 * i + 0.4) for i, s in enumerate("BABAB")])
    assert "".join(r.speaker for r in T.smooth_isolated(w).orderBy("pos").collect()) == "BBABB"
    kept = words(spark, [("B", "w", 0.0, 0.4), ("A", "Yeah,", 0.5, 0.9), ("B", "w", 1.0, 1.4)])
    assert [r.speaker for r in T.smooth_isolated(kept).orderBy("pos").collect()] == ["B", "A", "B"]


def test_turns(spark):
    w = words(spark, [("A", "hello", 0.0, 0.5), ("B", "there", 0.6, 1.0), ("B", "hi", 2.6, 3.0), ("B", "again", 4.5, 5.0)])
    got = [(r.turn_id, r.speaker, r.split_reason, r.n_words) for r in T.sessionize(w).orderBy("turn_id").collect()]
    assert got == [(1, "A", "speaker_change", 1), (2, "B", "pause", 1), (3, "B", "end_of_audio", 2)]
    exact = words(spark, [("A", "a", 0.0, 0.5), ("A", "b", 2.0, 2.5)])
    assert T.sessionize(exact).count() == 1


def test_interpolation_keeps_given_times(spark):
    w = spark.createDataFrame([(1, 0, 0, "a", 0.0, 1.0), (1, 0, 1, "b", None, None), (1, 0, 2, "c", None, None), (1, 0, 3, "d", 2.0, 2.5)], "conv_id long, turn long, pos long, word string, start_s double, end_s double")
    got = T.interpolate(w.withColumn("bound_start", F.lit(0.0)).withColumn("bound_end", F.lit(3.0))).orderBy("pos").collect()
    assert [(r.start_s, r.end_s) for r in got] == [(0.0, 1.0), (1.0, 1.5), (1.5, 2.0), (2.0, 2.5)]
    assert [r.timing_source[:5] for r in got] == ["wav2v", "inter", "inter", "wav2v"]


def test_turns_at_times_against_every_turn(spark):
    r = random.Random(9)
    turns = [(c, i, s, s + r.choice((0.0, 1.0, 20.0, 90.0))) for c in range(3) for i in range(1, 60) for s in [r.randrange(5, 900) / 2]]
    times = sorted({(c, r.randrange(0, 1000) / 2) for c in range(4) for _ in range(150)})
    got = T.turn_at(spark.createDataFrame(times, "conv_id long, t double"), spark.createDataFrame(turns, "conv_id long, turn_id long, start_s double, end_s double"))
    want = []
    for c, t in times:
        begun = [(s, i, e) for k, i, s, e in turns if k == c and s <= t]
        want.append((c, t, min((i for s, i, e in begun if t < e), default=max(begun)[1] if begun else 0)))
    assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # turns and times meet in one pass over a recording


def test_shading_looks_at_neighbours_only(spark):
    words = "array<struct<word:string,start_s:double,end_s:double>>"
    html = lambda rows: spark.createDataFrame([(rows,)], f"words {words}").select(T.shaded(F.col("words"), F.lit(1.0), F.lit(3.0)).alias("h")).first().h
    assert html([("a", 0.0, 1.0), ("<b>", 0.9, 1.4), ("c", None, None), ("d", 2.0, 9.0), ("e", 3.0, 4.0)]) == 'a <span class="clip">&lt;b&gt;</span> c <span class="clip">d</span> e'
    began = time.perf_counter()
    assert html([("w", float(i), i + 0.5) for i in range(12_000)]).count("<span") == 1 and time.perf_counter() - began < 15  # looking at all words from each takes minutes
