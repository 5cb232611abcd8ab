import random
from collections import Counter

from parley.llm.decontaminate import RADIUS, Index, clean, contamination


def bag(words, n):
    k = min(n, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def brute(docs, items, n=5, least=0.8):
    out = set()
    for d, t in docs:
        w = (t or "").encode().lower().split()
        for i, s in items:
            v = (s or "").encode().lower().split()
            if not v or not w:
                continue
            k, want = min(n, len(v)), bag(v, n)
            for a in range(max(1, len(w) - len(v) + 1)):
                part = w[a : a + len(v)]
                have = Counter(tuple(part[j : j + k]) for j in range(len(part) - k + 1)) if len(part) >= k else Counter([tuple(part)])
                both = sum((want & have).values())
                if both / (sum(want.values()) + sum(have.values()) - both) >= least:
                    out.add((d, i))
                    break
    return out


def test_against_brute_force(spark):
    r = random.Random(4)
    vocab = [f"q{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([3, 4, 5, 6, 15, 23, 40, 59])))) for i in range(40)] + [(90, None), (91, " ")]
    docs = [(500, None), (501, ""), (502, items[6][1].upper())]
    for d in range(220):
        w = [r.choice(vocab) for _ in range(r.choice([2, 10, 60, 200]))]
        for _ in range(r.choice([0, 1, 2])):
            v = r.choice(items[:40])[1].split()
            for _ in range(r.choice([0, 0, 1, 2])):
                v[r.randrange(len(v))] = r.choice(vocab)
            if r.random() < 0.3:
                v = v[r.randrange(3) :]
            a = r.randrange(len(w) + 1)
            w[a:a] = v
        docs.append((d, (" " if d % 2 else "\n").join(w)))
    left = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, item_id string")
    right = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    got = [(x.doc_id, x.item_id) for x in contamination(left, right).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    blocks = {(x.doc_id, x.item_id) for x in contamination(left, right, most_items=11).collect()}
    assert blocks == want
    kept = clean(left, right)
    assert kept.columns == left.columns and {x.doc_id for x in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_ties_repeats_and_long_texts(spark):
    item = " ".join(f"k{i}" for i in range(12))
    twice = f"a b {item} c {item} d"
    docs = spark.createDataFrame([(1, twice), (1, twice), (2, "x " * 150_000 + item), (3, item[:-4])], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (7, item), (7, "k0 k1 k2"), (8, item.upper()), (None, item)], "item_id long, text string")
    for limits in ({}, {"most_items": 1}):
        got = sorted((x.doc_id, x.item_id, x.similarity, x.word_start) for x in contamination(docs, items, **limits).collect())
        assert got[:4] == [(1, 7, 1.0, 2), (1, 7, 1.0, 2), (1, 8, 1.0, 2), (1, 8, 1.0, 2)] and got[4:6] == [(2, 7, 1.0, 150_000), (2, 8, 1.0, 150_000)]
        assert got[6][:2] == (3, 7) and got[6][2] == 1.0 and clean(docs, items, **limits).count() == 0  # k0 k1 k2 is an item's text too


def test_an_index_of_many_items_of_one_size():
    r = random.Random(1)
    texts = [(i, " ".join(f"m{r.randrange(5000)}" for _ in range(9))) for i in range(3000)]
    index = Index(texts, 5, 0.8)
    (group,) = index.groups.values()
    prints = [int(p) for p in group["prints"]]
    for p in prints[:40]:
        assert index.near(group, p) == [i for i, q in enumerate(prints) if (p ^ q).bit_count() <= RADIUS]


def test_empty_tables(spark):
    docs, items = (spark.createDataFrame([], f"{c} long, text string") for c in ("doc_id", "item_id"))
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert contamination(docs, items).collect() == [] and contamination(some, items).collect() == [] and clean(some, items).count() == 1
