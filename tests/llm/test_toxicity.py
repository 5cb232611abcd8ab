import random
import zlib

import numpy as np

from parley.llm import toxicity as T

BAD = ["wretch", "buffoon", "vermin"]


def rows_of(seed, n):
    r = random.Random(seed)
    vocab = ["".join(r.choice(["ka", "to", "mi", "sel", "bra", "nu"]) for _ in range(r.choice([1, 2, 3]))) for _ in range(150)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.choice([5, 30, 120]))]
        bad = r.random() < 0.3
        for _ in range(2 * bad):
            w.insert(r.randrange(len(w)), r.choice(BAD))
        docs.append((i, " ".join(w)))
        if r.random() < 0.8:
            labels.append((i, int(bad)))
    return docs, labels


def brute_kernel(a, b):
    def features(w):
        w, out = f"\x02{w}\x03", {}
        for i in range(len(w)):
            for j in range(i + 1, len(w)):
                for k in range(j + 1, min(len(w), i + 5)):
                    u = w[i] + w[j] + w[k]
                    out[u] = out.get(u, 0) + T.DECAY ** (k - i - 2)
        return out

    x, y = features(a), features(b)
    return sum(v * y.get(u, 0) for u, v in x.items()) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5


def test_kernel_against_brute_force():
    k = T.Kernel(["buffoon", "wretch", "banana"])
    words = ["buffoon", "bufxfoon", "wretched", "bananas", "b", "", "zzz", "wr3tch", "bufoon"]
    got = k.features(words)
    for w, row in zip(words, got, strict=True):
        for landmark, x in zip(k.landmarks, row, strict=True):
            want = brute_kernel(T.plain(w), landmark) if len(T.plain(w)) > 2 else 0.0
            assert np.isclose(x, want**T.POWER if want >= T.LEAST else 0.0, atol=2e-3), (w, landmark)


def test_kernel_in_many_scripts():
    scripts = [(0x61, 26), (0x430, 32), (0x3B1, 24), (0x4E00, 300)]
    landmarks = [*("".join(chr(start + (7 * k + i) % n) for i in range(6)) for start, n in scripts for k in range(n // 6)), "笨蛋"]
    for names in (landmarks[:5] + landmarks[-1:], landmarks[:13], landmarks):
        k = T.Kernel(names)
        got = k.features([*names, "zqzq"])
        assert np.allclose(np.diag(got), 1, atol=2e-3) and (k.norms > 0.1).all() and not got[-1].any()
        for w, row in zip(names[:20], got, strict=False):
            want = np.array([brute_kernel(w, x) for x in names])
            assert np.allclose(row, np.where(want >= T.LEAST, want**T.POWER, 0.0), atol=2e-3)
    assert T.units({"笨蛋", "a", "1b"}) == {"笨蛋"}


def test_held_out_and_gaps(spark):
    docs, labels = rows_of(7, 500)
    docs += [(9000, None), (9001, ""), (9002, "ka buf-foon to"), (9003, "ka w r e t c h mi"), (9004, "ka verxmin"), (9005, "KA VERMIN")]
    got = {x.doc_id: x for x in T.toxicity(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, toxic int"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(got) == len(docs) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.3) for x in got.values())
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, x in got.items())
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert sum(p == y for p, y in held) / len(held) > 0.97
    assert [got[i].predicted for i in (9000, 9001)] == [0, 0]
    assert all(got[i].score > 0.3 for i in (9002, 9003, 9005)) and got[9004].score > got[9001].score


def test_altered_insults_are_caught(spark):
    r = random.Random(3)
    docs, labels = rows_of(7, 500)
    clean = [t for (i, t), (j, y) in zip([d for d in docs if d[0] in dict(labels)], labels, strict=True) if i == j and not y]
    probes = {}

    def add(kind, text):
        probes[20_000 + len(probes)] = kind
        docs.append((19_999 + len(probes), text))

    for k in range(60):
        w, letters = BAD[k % 3], "aeikmoqstxz"
        i = r.randrange(1, len(w))
        words = " ".join(r.choices(docs[k][1].split() or ["ka"], k=8)) if docs[k][0] not in {i for i, y in labels if y} else "ka to mi"
        for kind, form in (("plain", w), ("put in", w[:i] + r.choice(letters) + w[i:]), ("left out", w[:i] + w[i + 1 :]), ("doubled", w[:i] + w[i - 1] + w[i:]), ("gapped", "*".join((w[:i], w[i:]))), ("spelled", " ".join(w))):
            add(kind, f"ka to {form} {words}")
    for k in range(100):
        add("clean", clean[k % len(clean)])
    add("long", "ka mi " * 60_000 + "vermin")
    got = {x.doc_id: x.predicted for x in T.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    share = {kind: np.mean([got[i] for i, k in probes.items() if k == kind]) for kind in set(probes.values())}
    assert share.pop("clean") <= 0.03 and share.pop("left out") >= 0.8 and all(v >= 0.9 for v in share.values()), share


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert T.toxicity(docs, none).first().predicted == 0
    assert T.toxicity(docs.limit(0), none).collect() == []
    ones = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert T.reject(docs, ones).collect() == docs.collect()
