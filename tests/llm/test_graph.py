import random

from parley.llm import graph


def test_long_paths_take_few_rounds(spark, monkeypatch):
    rounds, real = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, what: (rounds.append(what), real(df, what))[1])
    ids = random.Random(4).sample(range(1, 10**9), 900)
    paths = ids[:800], ids[800:]
    edges = [(a, b) for p in paths for a, b in zip(p, p[1:])] + [(5_000_000_000, None), (7_000_000_000, 7_000_000_000)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: min(p) for p in paths for i in p}
    assert rounds.count("labels") <= 20
