import random

from parley.operators import segment as S


def timed(tokens, pauses=None):
    t, start, end = 0.0, [], []
    for i, _ in enumerate(tokens):
        t += (pauses or {}).get(i, 0.05)
        start.append(t)
        t += 0.3
        end.append(t)
    return S.Timed(tokens, start, end)


def test_punctuation_and_fragments():
    t = timed("We asked Prof. Lind about it. Sure. Later on the whole group went out.".split())
    assert S.sentence_spans(t) == [(0, 7), (7, 14)]
    assert S.sentence_spans(timed("It rained all day long. No way. She said so twice.".split())) == [(0, 7), (7, 11)]
    assert S.sentence_spans(timed([])) == [] and S.sentence_spans(timed(["Hm."])) == [(0, 1)]


def test_long_runs_split_at_the_later_of_equal_pauses():
    words = [f"t{i}" for i in range(42)]
    assert S.sentence_spans(timed(words, {9: 0.9, 27: 0.9})) == [(0, 27), (27, 42)]
    assert S.sentence_spans(timed(words)) == [(0, 30), (30, 42)]
    assert S.sentence_spans(timed(words[:22], {12: 18.0})) == [(0, 12), (12, 22)]
    assert S.sentence_spans(timed(words[:33])) == [(0, 33)]  # what a cut after 30 words leaves over would be a fragment


def walked(starts, ends, seconds):
    """Windows by walking from sentence to sentence."""
    out, i, n = [], 0, len(starts)
    while i < n:
        j = max(i + 1, (out[-1][1] + 1) if out else 1)
        while j < n and ends[j] - starts[i] <= seconds:
            j += 1
        out.append((i, j))
        i = n if j == n else j - 1 if j - i > 1 else j
    if len(out) > 1 and ends[-1] - starts[out[-2][1]] < seconds / 3 and ends[-1] - starts[out[-2][0]] <= seconds * 4 / 3:
        out[-2:] = [(out[-2][0], n)]
    return out


def test_windows():
    eight = [8.0 * i for i in range(8)]
    assert S.window_spans(eight, [s + 7 for s in eight]) == [(0, 3), (2, 5), (4, 8)]
    assert S.window_spans([0.0, 36.0, 39.0], [36.0, 39.0, 42.0]) == [(0, 1), (1, 3)]
    assert S.window_spans([], []) == []
    r = random.Random(3)
    for _ in range(300):
        starts, ends, t = [], [], 0.0
        for _ in range(r.randrange(1, 25)):
            starts.append(t)
            t += r.choice([0.5, 3.0, 9.0, 14.0, 31.0, 45.0])
            ends.append(t)
            t += r.choice([0.0, 0.25, 2.0])
        assert S.window_spans(starts, ends) == walked(starts, ends, 30.0)


def test_sentences_partition_turns(spark):
    from parley.operators import transcript

    words = transcript.timed_words(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")).cache()
    sentences = S.sentences(words)
    assert sentences.agg({"n_words": "sum"}).first()[0] == words.count()
    chunks = S.chunks(words).collect()
    assert chunks and all(r.end_s > r.start_s and r.sentences == list(range(r.sentences[0], r.sentences[-1] + 1)) for r in chunks)
