import math
import pickle
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from parley.llm import lm
from parley.llm import words as W


def rows_of(seed, n):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(120)]
    weights = [1 / (i + 1) for i in range(120)]
    return [(i, " ".join(r.choices(vocab, weights, k=r.choice([0, 1, 8, 40])))) for i in range(n)] + [(9001, None), (9002, "  \n"), (9003, "Zq V1\x0bV1")]


def test_base_score_against_brute_force(spark):
    rows = rows_of(3, 200)
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, n long")
    got = {r.doc_id: r for r in lm.lm_scores(df, head=40).collect()}
    toks = {i: [*(t or "").encode().lower().split(), b""] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    c = Counter(w for i in toks if not held[i] for w in toks[i])
    total, distinct = sum(c.values()), len(c)
    assert len(got) == len(rows)
    for i, ws in toks.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), total)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in ws), rel_tol=1e-9)
        assert r.score <= 0


def blank(blocks=1):
    m = lm.Model(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.ones(1), 0, 0, blocks)
    m.spread = np.ones(1 << 20, bool)
    return m


def test_the_most_frequent(spark):
    r = np.random.default_rng(2)
    rows = [(int(k), int(n)) for k, n in zip(r.permutation(4000), r.zipf(1.3, 4000).clip(1, 10**6), strict=True)]
    counts = spark.createDataFrame(rows, "key long, n long").repartition(5)
    order = sorted(rows, key=lambda x: (-x[1], x[0]))
    for most in (1, 7, 100, 5000):
        got = sorted(((x.key, x.n) for x in lm._frequent(counts, most).collect()), key=lambda x: (-x[1], x[0]))
        assert got == order[: len(got)] and (len(got) == min(most, 4000) or sum(n == order[len(got)][1] for _, n in rows) > most)


def test_packed():
    keys, counts = np.sort(np.random.default_rng(4).integers(0, 1 << 50, 999)), np.arange(1, 1000)
    assert all((x == y).all() for x, y in zip(lm.unpacked(lm.packed(keys, counts), 999), (keys, counts), strict=True))


def test_merged_counts():
    r = np.random.default_rng(7)
    loose = [r.integers(0, 50, n) for n in (0, 1, 300, 40)]
    want = Counter(np.concatenate(loose).tolist())
    parts = [lm._tally(loose[:2]), lm._tally(loose[2:3]), lm._tally(loose[3:])]
    keys, counts = lm._merge(parts)
    assert not parts and keys.tolist() == sorted(want) and dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want
    none = np.zeros(0, np.int64)
    assert all(len(x) == 0 for x in lm._merge([(none, none), (none, none)]))


def counted(texts, monkeypatch, flush=lm.FLUSH):
    """Counts of all texts' words, how many rows told them, and the most MB that were held meanwhile."""
    monkeypatch.setattr(W, "_powers", [np.ones(1, W.U), np.ones(1, W.U)])
    monkeypatch.setattr(lm, "FLUSH", flush)
    batch = pa.RecordBatch.from_pydict({"text": texts})
    tracemalloc.start()
    found, rows = Counter(), 0
    for x in lm._counted(lambda raw, offsets: lm.tokens(raw, offsets)[0], lm._words)(iter([batch, batch.slice(0, 0), batch])):
        rows += x.num_rows
        for k, n in zip(x.column("key").to_pylist(), x.column("n").to_pylist(), strict=True):
            found[k] += n
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return found, rows, most


def test_counting_takes_little_memory_however_large_the_batch(monkeypatch):
    r = np.random.default_rng(5)
    words = [f"word{i}" for i in range(3000)]
    texts = [" ".join(words[i] for i in r.integers(0, 3000, 1500)) for _ in range(800)] + [None, ""]
    found, _, most = counted(texts, monkeypatch)
    assert most < 110
    want = Counter(w for t in texts for w in [*(t or "").split(), None] for _ in range(2))
    assert sorted(found.values()) == sorted(want.values())
    often, rows, _ = counted(texts, monkeypatch, flush=5000)
    assert often == found and rows > len(found)


def test_what_counts_pairs_is_small_and_numbers_alike():
    r = np.random.default_rng(9)
    h = np.unique(r.integers(1, 1 << 63, 50_000)).astype(np.uint64)
    m = lm.Model(h[:20_000], np.arange(20_000)[::-1], np.ones(1 << 18), 10**9, len(h), 900)
    bare = pickle.loads(pickle.dumps(m.bare()))
    assert len(pickle.dumps(m.bare())) < 0.3 * len(pickle.dumps(m))
    numbers, first = m.numbers(h), np.array([0, 7, len(h)])
    keys = m.pair_keys(numbers, first)
    assert (bare.numbers(h) == numbers).all() and (bare.pair_keys(numbers, first) == keys).all() and (bare.block_of(keys) == m.block_of(keys)).all()


def test_filter_holds_every_level():
    r = np.random.default_rng(1)
    keys, counts = r.integers(1, 1 << 50, 20_000), r.integers(1, 3000, 20_000)
    counts[::2] = 1
    m = blank(16)
    block = m.block_of(keys)
    m = m.part({b: lm.build_block(keys[block == b].view(np.uint64), counts[block == b]).tobytes() for b in range(16)})
    found = m.levels(keys)
    assert (found >= lm.level_of(counts)).all()
    assert (found == lm.level_of(counts)).mean() > 0.98
    others = m.levels(r.integers(1 << 50, 1 << 51, 1_000_000))
    rates = [lm.false_rate(m.filter[m.at[b] : m.at[b] + int(m.sizes[b])]) for b in range(16)]
    assert (others > 0).mean() < 2e-4 and 0.5 < (others > 0).mean() / np.mean(rates) < 2
    assert blank(16).part({3: bytes(8)}).levels(keys).max() == 0 and (blank(16).part({3: bytes(8)}).levels(keys) == -1).sum() == (block != 3).sum()


def learned(spark, rows, **options):
    train = [(t,) for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    counts, model, blocks, parts = lm.train(spark.createDataFrame(train, "text string"), **options)
    whole = model.part({b: bytes(8) for b in range(model.blocks)} | {r.block: bytes(r.bits) for r in blocks.collect()})
    return whole, train


def test_no_pair_is_left_out_and_contexts_sum_to_one(spark):
    rows = rows_of(12, 3000) + [(8000 + i, f"rare{i} once{i} v1 other{i % 7}") for i in range(400)]
    m, train = learned(spark, rows, head=50)
    assert m.head == 50 and m.buckets > 32
    seen = Counter()
    for (t,) in train:
        raw, offsets = W.text_buffer(pa.array([t]))
        h, first = lm.tokens(raw, offsets)
        seen.update(m.pair_keys(m.numbers(h), first).tolist())
    keys = np.array(sorted(seen))
    found, true = m.levels(keys), lm.level_of(np.array([seen[k] for k in keys.tolist()]))
    assert (found >= true).all() and (found == true).mean() > 0.98
    every = np.arange(m.start)
    sums = np.array([(10 ** m.log_pairs((context << 32) | every)).sum() for context in range(m.start + 1)])
    frequent = m.sums > 150
    assert frequent.sum() > 10 and np.abs(sums[frequent] - 1).max() < 0.02
    # one false positive can be a tenth of a rare context, and hits few of them
    assert (np.abs(sums - 1) < 0.02).mean() > 0.95 and abs(sums.mean() - 1) < 0.01
    assert math.isclose(m.prior.sum(), 1)


def test_score_against_brute_force(spark):
    rows = rows_of(4, 300) + [(8000 + i, f"rare{i % 50} once{i} v1") for i in range(200)]
    m, train = learned(spark, rows, head=30)
    got = {r.doc_id: r for r in lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string"), head=30).collect()}
    split = lambda t: [*(t or "").lower().split(), "\x00"]

    def number(w):
        raw, offsets = W.text_buffer(pa.array(["" if w == "\x00" else w]))
        return int(m.numbers(lm.tokens(raw, offsets)[0])[0])

    words = Counter(w for (t,) in train for w in split(t))
    ids = {w: number(w) for _, t in rows for w in split(t)}
    mass = Counter({m.head + b: 1 for b in range(m.buckets)})
    for w, c in words.items():
        mass[ids[w]] += c + 1
    pairs = Counter((a, b) for (t,) in train for n in [[m.start, *(ids[w] for w in split(t))]] for a, b in zip(n, n[1:], strict=False))
    asked = {p for _, t in rows for n in [[m.start, *(ids[w] for w in split(t))]] for p in zip(n, n[1:], strict=False)} | {*pairs}
    quantised = {p: float(lm.count_of(m.levels(np.array([p[0] << 32 | p[1]])))[0]) for p in asked}
    plain = {p: float(lm.count_of(lm.level_of(np.array([c])))[0]) for p, c in pairs.items()}
    assert sum(quantised[p] == plain.get(p, 0.0) for p in asked) > 0.97 * len(asked)
    sums = Counter()
    for a, b in pairs:
        sums[a] += quantised[a, b]
    whole = sum(mass.values())
    for i, t in rows:
        want, n = 0.0, [m.start, *(ids[w] for w in split(t))]
        for w, (a, b) in zip(split(t), zip(n, n[1:], strict=False), strict=False):
            want += math.log10((quantised[a, b] + lm.PRIOR * mass[b] / whole) / (sums[a] + lm.PRIOR + m.false))
            want += math.log10((words[w] + 1) / mass[b]) if b >= m.head else 0.0
        assert abs(got[i].score - want) < 1e-6


def test_parts_of_the_filter_add_up(spark, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 64)
    rows = rows_of(6, 300) + [(8000 + i, f"rare{i} once{i} v1") for i in range(300)] + [(9900, "v1 v2 " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id: r for r in lm.lm_scores(df).collect()}
    parts = {r.doc_id: r for r in lm.lm_scores(df, max_filter_bits=1 << 15).collect()}
    monkeypatch.setattr(lm, "MOST_PASSES", 2)
    asked = {r.doc_id: r for r in lm.lm_scores(df, max_filter_bits=1 << 12).collect()}
    assert len(whole) == len(parts) == len(asked) == len(rows)
    for other in (parts, asked):
        assert all(math.isclose(whole[i].score, r.score, rel_tol=1e-9) and whole[i].base_score == r.base_score for i, r in other.items())


def test_a_block_that_many_ask_for(spark):
    m, _ = learned(spark, rows_of(3, 100), head=30)
    rows = spark.createDataFrame([(i, [0, 1, 0, 1, 2]) for i in range(200)], "row long, numbers array<int>")
    blocks = spark.createDataFrame([(0, bytearray(m.filter.tobytes()))], "block int, bits binary")
    sent = spark.sparkContext.broadcast(m.part({}))
    got = [r.more for r in lm._asked(rows, blocks, sent, most=100).groupBy("row").sum("more").withColumnRenamed("sum(more)", "more").collect()]
    want = m.log_probability(np.array([0, 1, 0, 1, 2]), np.array([0, 5])).sum()
    assert len(got) == 200 and np.allclose(got, want)


def test_better_than_its_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm.lm_scores(docs).where("held_out").selectExpr("sum(score) / sum(n_tokens) AS model", "sum(base_score) / sum(n_tokens) AS base").first()
    assert r.model > r.base


def test_context_helps(spark):
    rows = [(i, "a b " * 20 if i % 2 else "b c d " * 15) for i in range(200)]
    got = lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert got and all(r.score > r.base_score for r in got)


def test_empty_table(spark):
    assert lm.lm_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
