import random
from itertools import permutations

from pyspark.sql import functions as F

from parley.functions import expressions as X
from parley.operators import evaluate as E


def test_strict_match(spark):
    hit = lambda *v: spark.range(1).select(X.strict_match(*[F.lit(float(x)) for x in v]).alias("h")).first().h
    assert hit(10, 14, 10, 14) and hit(8, 16, 10, 14) and not hit(14, 18, 10, 14) and not hit(0, 130, 0, 130) and not hit(5, 5, 0, 10)
    assert hit(10, 26, 11, 16) and not hit(3, 30, 11, 16)


def test_recall_with_alternatives_and_near_miss(spark):
    results = spark.createDataFrame([(1, "f", "Gary", 300.0, 304.0, 1), (1, "f", "Gary", 200.0, 204.0, 2)], "qid long, file string, speaker string, start_s double, end_s double, rank long")
    moments = spark.createDataFrame([(1, 0, "f", "Gary", 10.0, 14.0), (1, 0, "f", None, 200.0, 204.0), (1, 1, "f", "Ann", 300.0, 304.0)], "qid long, moment long, file string, speaker string, start_s double, end_s double")
    hits = E.moment_hits(results, moments)
    assert {r.moment: r.rank for r in hits.collect()} == {0: 2, 1: None}
    recalls = E.recall(hits)
    r = recalls.first()
    assert (r.recall_1, r.recall_3, r.recall_5, r.mrr) == (0.0, 0.5, 0.5, 0.5)
    bad = spark.createDataFrame([(1, "f", 300.0, 304.0)], "qid long, file string, start_s double, end_s double")
    assert not E.near_miss(results, bad, recalls).first().rejected and E.near_miss(results, bad.limit(0), recalls).first().rejected


def test_diarization_error(spark):
    turns = "file string, speaker string, start_s double, end_s double"
    ref = spark.createDataFrame([("f", "A", 0.0, 10.0), ("f", "B", 10.0, 20.0)], turns)
    hyp = spark.createDataFrame([("f", "A", 0.0, 12.0), ("f", "B", 12.0, 18.0), ("f", "A", 25.0, 26.0)], turns)
    r = E.diarization_error(ref, hyp).first()
    assert (r.spoken, r.missed, r.false_alarm, r.confusion) == (20.0, 2.0, 1.0, 2.0)
    assert E.diarization_error(ref, hyp, collar=0.5).first().confusion == 1.75


def plain_errors(ref, hyp, collar):
    """Seconds by trying every stretch between two boundaries against every turn."""
    marks = [t for x in ref for t in x[1:]] if collar else []
    times = sorted({t for x in ref + hyp for t in x[1:]} | {c + s * collar / 2 for c in marks for s in (-1, 1)})
    out = [0.0] * 4
    for t, u in zip(times, times[1:]):
        if any(c - collar / 2 < (t + u) / 2 < c + collar / 2 for c in marks):
            continue
        r, h = ({x[0] for x in side if x[1] <= t and x[2] >= u} for side in (ref, hyp))
        out = [a + (u - t) * n for a, n in zip(out, (len(r), max(0, len(r) - len(h)), max(0, len(h) - len(r)), min(len(r), len(h)) - len(r & h)), strict=True)]
    return tuple(round(x, 3) for x in out)


def test_diarization_error_against_every_turn(spark):
    r = random.Random(4)
    one = lambda: [(r.choice("ABC"), s / 4, (s + r.choice((0, 0, 1, 5, 40, 300))) / 4) for s in r.choices(range(400), k=25)]
    files = {f: (one(), one()) for f in range(6)}
    table = lambda side: spark.createDataFrame([(f, *x) for f, both in files.items() for x in both[side]], "file long, speaker string, start_s double, end_s double")
    for collar in (0.0, 0.25, 3.0):
        found = E.diarization_error(table(0), table(1), collar)
        assert {x.file: (x.spoken, x.missed, x.false_alarm, x.confusion) for x in found.collect()} == {f: plain_errors(*both, collar) for f, both in files.items()}
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()  # joins and their sorts hold a task's memory together


def test_mapping_and_bootstrap(spark):
    m = spark.createDataFrame([("f", "S0", "Al", 9.0), ("f", "S0", "Bo", 8.0), ("f", "S1", "Al", 8.5), ("f", "S1", "Bo", 1.0)], "file string, speaker string, other string, seconds double")
    assert {r.speaker: r.mapped for r in E.speaker_mapping(m).collect()} == {"S0": "Bo", "S1": "Al"}
    q = spark.createDataFrame([("r", i, 1, int(i < 6)) for i in range(10)], "measure string, qid long, weight long, found long")
    r = E.bootstrap(q, draws=500).first()
    assert r.recall == 0.6 and r.low < 0.6 < r.high and r == E.bootstrap(q, draws=500).first()


def test_assignment_of_many_speakers():
    r = random.Random(1)
    for _ in range(300):
        n = r.randrange(1, 5)
        m = r.randrange(n, 6)
        gain = [[r.randrange(4) for _ in range(m)] for _ in range(n)]
        best = max(permutations(range(m), n), key=lambda p: sum(g[j] for g, j in zip(gain, p, strict=True)))  # noqa: B023
        assert tuple(E.best_assignment(gain)) == best
    twelve = [[100 - abs(i - (j + 5) % 12) for j in range(12)] for i in range(12)]
    assert E.best_assignment(twelve) == [(i + 7) % 12 for i in range(12)]


def test_normal_texts(spark):
    of = lambda f, t: spark.range(1).select(f(F.lit(t)).alias("x")).first().x
    assert of(E.basic_text, " A  dog's [life],\n2nd_x ") == "a dog s life 2nd_x"
    assert of(E.english_text, "Um, we can’t [noise] use Pg Vector (yet) -- it's 1,200 rows; they won't") == "we can not use pgvector it is 1200 rows they will not"
    pairs = spark.createDataFrame([(1, "We don't know.", "uh we do not know")], "id long, reference string, hypothesis string")
    assert E.word_errors(pairs, E.english_text).first().wer == 0 and E.word_errors(pairs).first().wer > 0


def test_speaker_accuracy(spark):
    kind = "file string, place long, speaker string, text string"
    ref = spark.createDataFrame([("f", 1, "Ann", "so we ship it on friday"), ("f", 2, "Bob", "not before the tests pass"), ("g", 1, "Ann", "alone")], kind)
    hyp = spark.createDataFrame([("f", 1, "Ann", "So, we ship it on Friday not"), ("f", 2, "Bob", "before tests pass!")], kind)
    got = {r.file: r for r in E.speaker_accuracy(ref, hyp).collect()}
    assert (got["f"].n_aligned, got["f"].n_right, got["f"].accuracy, got["f"].coverage) == (10, 9, 0.9, round(10 / 11, 4)) and (got["g"].n_aligned, got["g"].accuracy) == (0, 0.0)


def test_assertions(spark):
    kind = "qid long, file string, start_s double, end_s double, rank long"
    results = spark.createDataFrame([(1, "f", 0.0, 5.0, 1), (1, "f", 50.0, 55.0, 2), (2, "f", 0.0, 5.0, 1), (3, "f", 0.0, 5.0, 1), (4, "f", 90.0, 95.0, 1)], kind).withColumn("speaker", F.lit("x"))
    queries = spark.createDataFrame([(1, "multi_file"), (2, "multi_file"), (3, "single_file"), (4, "single_file"), (5, "single_file")], "qid long, category string")
    moments = spark.createDataFrame([(q, m, "f", None, s, s + 5) for q, m, s in ((1, 0, 0.0), (1, 1, 50.0), (2, 0, 0.0), (2, 1, 70.0), (3, 0, 0.0), (3, 1, 70.0), (4, 0, 0.0), (5, 0, 0.0))], "qid long, moment long, file string, speaker string, start_s double, end_s double")
    bad = spark.createDataFrame([(3, "f", 0.0, 5.0)], "qid long, file string, start_s double, end_s double")
    none = bad.limit(0)
    of = lambda negatives: {r.qid: (r.passed, r.score, r.rule) for r in E.assertion(queries, results, E.moment_hits(results, moments), negatives).collect()}
    assert of(none) == {1: (True, 1.0, None), 2: (False, 0.5, None), 3: (True, 0.5, None), 4: (False, 0.0, "not_found"), 5: (False, 0.0, "no_results")}
    assert of(bad)[3] == (False, 0.0, "near_miss")


def test_quotations(spark):
    words = [("He", 1.0, 1.2), ("said", 1.3, 1.5), ('"no', None, None), ("way", 2.0, 2.2), ("ever", 2.4, 9.9)]
    rows = [(1, 'He said "no way" ever.', 'no way"', 1.0, 3.0, words), (2, 'He said "no way" ever.', "ever", 1.0, 3.0, words), (3, "He said", "absent", 1.0, 3.0, words), (4, None, None, 1.0, 3.0, None)]
    got = {r.id: (r.start_s, r.end_s) for r in E.tightened(spark.createDataFrame(rows, "id long, text string, matched_text string, start_s double, end_s double, words array<struct<word:string,start_s:double,end_s:double>>")).collect()}
    assert got == {1: (2.0, 2.2), 2: (2.4, 3.0), 3: (None, None), 4: (None, None)}


def test_rates(spark):
    errors = spark.createDataFrame([("f", 20.0, 2.0, 1.0, 3.0), ("g", 0.0, 0.0, 1.0, 0.0)], "file string, spoken double, missed double, false_alarm double, confusion double")
    got = {r.file: r for r in E.diarization_rates(errors).collect()}
    assert got["f"].error_rate == 0.3 and got["f"].attribution_error == round(3 / 18, 4) and got["g"].error_rate == 0.0


def test_gate():
    good = {"recall_1": 0.6, "recall_5": 0.85}
    assert E.gate({"hybrid": good, "lexical": {"recall_5": 0.8}, "dense": {"recall_5": 0.84}})
    assert not E.gate({"hybrid": good, "lexical": {"recall_5": 0.85}, "dense": {"recall_5": 0.8}})
    assert not E.gate({"hybrid": good, "lexical": {"recall_5": float("nan")}, "dense": {"recall_5": 0.8}})
