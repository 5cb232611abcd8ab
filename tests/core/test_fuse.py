from pyspark.sql import functions as F

from parley.operators import fuse


def fused(spark, lists, weights):
    rows = [(1, name, i, float(s)) for name, items in lists.items() for i, s in items]
    df = spark.createDataFrame(rows, "qid long, retriever string, id long, score double")
    ran = spark.createDataFrame([(1, n) for n in lists], "qid long, retriever string")
    return {r.id: r for r in fuse.convex(fuse.contributions(df, ran, weights)).collect()}


def test_convex(spark):
    got = fused(spark, {"bm25": [(1, 1), (2, 0)], "dense": [(2, 1), (3, 0)]}, {"bm25": 1.0, "dense": 1.0})
    assert {i: r.score for i, r in got.items()} == {1: 0.5, 2: 0.5, 3: 0.0}
    assert got[1].matched_by == "words" and got[2].matched_by == "meaning" and got[3].matched_by == "meaning"


def test_an_empty_list_that_ran_counts(spark):
    got = fused(spark, {"bm25": [(1, 3.0)], "trigram": [], "dense": [(1, 0.5)]}, {"bm25": 1.0, "trigram": 1.0, "dense": 2.0})
    assert got[1].score == 0.75 and got[1].matched_by == "both"


def spans(spark, rows, **options):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "g long, place long, start_s double, end_s double, score double, eligible boolean")
    return [(r.first, r.last) for r in fuse.grow(df, ["g"], **options).collect()]


def test_growth(spark):
    row = lambda *parts: [(a, b, s, e) for (a, b), s, e in parts]
    even = row(((0.0, 3.0), 0.85, True), ((3.0, 6.0), 0.2, True), ((6.0, 9.0), 0.95, True), ((9.0, 12.0), 0.8, True), ((12.0, 15.0), 0.9, True))
    assert spans(spark, even) == [(2, 4)]
    assert spans(spark, even, most=2) == [(2, 3)] and spans(spark, even, longest=5.0) == [(2, 2)]
    brief = row(((0.0, 0.5), 0.0, True), ((0.5, 1.2), 0.7, True), ((1.2, 1.6), 0.0, True))
    assert spans(spark, brief) == [(0, 2)]  # the left of equal neighbours first, and on while under two seconds
    assert spans(spark, row(((0.0, 12.0), 0.6, True), ((12.0, 23.0), 0.6, True))) == [(0, 0)]
    assert spans(spark, row(((0.0, 6.0), 0.4, True), ((6.0, 11.0), 0.9, False), ((11.0, 17.0), 0.3, True))) == [(0, 1)]


def test_overlaps(spark):
    rows = [(3, 1, "a", 20.0, 26.0), (3, 2, "b", 22.0, 30.0), (3, 3, "a", 12.0, 20.5), (3, 4, "a", 26.0, 31.0), (3, 5, "a", 40.0, 40.9), (3, 6, "b", 30.0, 33.0), (3, 7, "b", 10.0, 22.1)]
    clips = spark.createDataFrame(rows, "qid long, rank long, file string, start_s double, end_s double")
    kept = lambda k, **o: [r.rank for r in fuse.without_overlaps(clips, k, **o).orderBy("new_rank").collect()]
    assert kept(9) == [1, 2, 4, 6] and kept(3) == [1, 2, 4] and kept(9, least=0.5) == [1, 2, 4, 5, 6] and kept(9, least=6.5) == [2, 3]


def test_blend_of_missing_signals(spark):
    df = spark.createDataFrame([(1, 0, 0.2, 6.0), (1, 1, 0.6, 2.0), (1, 2, None, 4.0)], "g long, i long, dense double, keyword double")
    got = df.withColumn("s", fuse.blend(df, ["g"], {"dense": 1.5, "keyword": 0.5})).orderBy("i").collect()
    assert [r.s for r in got] == [0.25, 0.75, 0.125]
    flat = spark.createDataFrame([(5, 0.0), (5, None), (6, 0.3), (6, 0.3)], "g long, dense double")
    assert sorted(r.s for r in flat.select(fuse.blend(flat, ["g"], {"dense": 4.0}).alias("s")).collect()) == [0.0, 0.0, 1.0, 1.0]


def test_matched_by_quarter(spark):
    row = lambda w, m, in_list: spark.range(1).select(fuse.matched_by(F.lit(w), F.lit(m), F.lit(in_list)).alias("x")).first().x
    assert row(0.75, 0.25, True) == "both" and row(0.8, 0.2, True) == "words" and row(0.1, 0.9, True) == "meaning" and row(0.0, 0.0, False) == "words"
