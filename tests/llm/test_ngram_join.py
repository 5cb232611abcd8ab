import random

import numpy as np
import pytest

from parley.llm import ngram_join
from parley.llm.ngram_join import ngram_components


def brute(rows, n=3, percent=90):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return sorted((i, len(sets[i]), find(i)) for i in sets)


def corpus(seed, docs):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    out = []
    for i in range(docs):
        if out and r.random() < 0.7:
            w = r.choice(out)[1].split()
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                k = r.randrange(len(w)) if w else 0
                w[k : k + r.choice([0, 1])] = [r.choice(vocab)]
            t = (" " if r.random() < 0.5 else "\n").join(w).upper() if r.random() < 0.3 else " ".join(w)
        else:
            t = " ".join(r.choice(vocab) for _ in range(r.choice([1, 2, 5, 11, 40, 90, 250])))
        out.append((i, t))
    return out


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_against_brute_force(spark, n, percent):
    rows = corpus(5, 260) + [(1000, None), (1001, ""), (1002, " \t"), (1003, "One\x0btwo"), (1004, "one two")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, class_id string, component long")
    got = sorted(map(tuple, ngram_components(df, n, percent).collect()))
    assert got == brute(rows, n, percent)


def test_no_pair_at_the_threshold_misses_its_keys():
    """MinHash bands below CELLS_FROM: sets just at 80 % always share a key; cells at 90 % must."""
    r = np.random.default_rng(7)
    for percent, pairs in ((80, 3000), (90, 1000)):
        met = 0
        for _ in range(pairs):
            n = int(r.integers(30, 400))
            apart = n * (100 - percent) // (2 * percent)  # so many of n replaced on the one side and as many on the other
            both = n - apart
            whole = r.integers(0, 1 << 63, n + apart, dtype=np.uint64)
            a, b = np.unique(whole[:n]), np.unique(np.concatenate([whole[:both], whole[n:]]))
            shared = len(np.intersect1d(a, b))
            if 100 * shared < percent * (len(a) + len(b) - shared):
                a = b
            met += bool(np.isin(ngram_join.set_keys(a, percent), ngram_join.set_keys(b, percent)).any())
        assert met == pairs


def test_empty_table(spark):
    assert ngram_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_star_of_near_copies(spark):
    base = [f"b{i}" for i in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 60):
        w = list(base)
        w[i] = f"edit{i}"
        rows.append((i, " ".join(w)))
    got = sorted(map(tuple, ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows)


def test_large_keys_in_blocks(spark, monkeypatch):
    from parley.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "SMALL_KEY", 4)
    r = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(90):
        w = list(base)
        for k in r.sample(range(150), r.choice([1, 2, 3, 5])):
            w[k] = f"x{r.randrange(9)}"
        rows.append((i, " ".join(w)))
    got = sorted(map(tuple, ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == brute(rows)
    assert len({c for _, _, c in got}) > 3
