import os
import threading

import numpy as np

from parley.llm import embedding_dedup as E
from parley.llm.common import shared_dir


def brute(rows, least=0.93):
    ok = {}
    for i, v, label in rows:
        if v is not None and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, np.float32).astype(float), label
    links = {i: [j for j in ok if j != i and ok[i][1] == ok[j][1] and len(ok[i][0]) == len(ok[j][0]) and ok[i][0] @ ok[j][0] / np.linalg.norm(ok[i][0]) / np.linalg.norm(ok[j][0]) >= least] for i in ok}
    out = {}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out[i] = (len(links.get(i, ())), min(seen), min(seen) == i)
    return out


def rows_of(seed, n, dims=16):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rows and r.random() < 0.5:
            _, v, label = rows[r.integers(len(rows))]
            v = (np.array(v) + r.standard_normal(dims) * r.choice([0, 0.02, 0.06, 0.1])) * r.choice([1, 1, 2])
        else:
            v, label = r.standard_normal(dims), int(r.integers(3))
        rows.append((i, [float(np.float32(x)) for x in v], label))
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(E, "LEAF", 40)
    monkeypatch.setattr(E, "BLOCK", 64)
    rows = rows_of(3, 700)
    rows += [(2000 + k, v, label) for k, (v, label) in enumerate([(None, 1), ([0.0] * 16, 1), ([float("nan")] * 16, 1), ([None] * 16, 1), ([1.0] * 16, None), ([1.0] * 16, None), ([], 1), ([1.0] * 3, 1), ([2.0] * 3, 1)])]
    df = spark.createDataFrame([(*x, 5) for x in rows], "vec_id long, embedding array<float>, label int, n long")
    got, want = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in E.near_duplicates(df).collect()}, brute(rows)
    assert len(got) == len(rows)
    assert sum(got[i][0] for i in got) >= 0.995 * sum(w[0] for w in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(got[i] == want[i] for i in want) / len(want) > 0.98


def test_large_dense_group_keeps_its_links():
    r = np.random.default_rng(5)
    n, dims = 6000, 64
    x = r.standard_normal((n, dims))
    x[: n // 3] = x[0] / np.linalg.norm(x[0]) + r.standard_normal((n // 3, dims)) * np.sqrt((1 / 0.97 - 1) / dims)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.triu(x @ x.T >= 0.93, 1)
    met = np.zeros((n, n), bool)
    for t in range(4):
        leaves = E.Tree(x, np.zeros(n, np.int64), E.LEAF, 0.93, t).leaves(x)
        for q in {q for v in leaves for q in v}:
            at = np.array([i for i, v in enumerate(leaves) if q in v])
            met[np.ix_(at, at)] = True
    assert near.sum() > 10**6 and (met & near).sum() >= 0.999 * near.sum()


def test_small_tables_go_through_the_trees(spark, monkeypatch):
    built = []
    tree = E.Tree

    def seen(*args):
        one = tree(*args)
        built.append(max((node.bit_length() for node in one.nodes), default=0))
        return one

    monkeypatch.setattr(E, "Tree", seen)
    rows = rows_of(8, 900)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got, want = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in E.near_duplicates(df).collect()}, brute(rows)
    assert len(built) == 4 and min(built) > 2
    assert sum(got[i][0] for i in got) >= 0.99 * sum(w[0] for w in want.values()) > 500 and all(got[i][0] <= want[i][0] for i in want)


def test_one_very_common_vector(spark):
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(3000)] + [(5000, [1.0, 2.0, 3.1], 0), (5001, [1.0, 2.0, 3.0], 1)]
    got = {x.vec_id: x for x in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got[0].n_links == got[2999].n_links == got[5000].n_links == 3000 and got[5000].component_id == 0
    assert (got[5001].n_links, got[5001].component_id, got[5001].kept) == (0, 5001, True)


def test_empty_table(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_rounds_parts_and_blocks_change_nothing(spark, monkeypatch):
    rows = rows_of(4, 600) + [(1000 + i, [1.0 + 0.001 * i] + [1.0] * 15, 0) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rounds = E._rounds
    seen = []
    monkeypatch.setattr(E, "_rounds", lambda *args: seen.append(rounds(*args)) or seen[-1])
    whole = sorted(E.near_duplicates(df).collect())
    monkeypatch.setattr(E, "BLOCK", 50)
    monkeypatch.setattr(E, "ROUND", 0.8)
    monkeypatch.setattr(E, "LEAST_ROUND", 0)
    assert sorted(E.near_duplicates(df).collect()) == whole
    assert len(seen[0]) == 1 and len(seen[1]) > 3 and any(parts > 1 for _, _, parts in seen[1])


def test_rounds_hold_every_leaf_once():
    weights = {(64, 5): 30, (64, 9): 60, (64, 12): 250, (3, 1): 10, (64, 13): 1}
    rounds = E._rounds(weights, 100)
    assert sorted((d, leaf) for leaves, part, _ in rounds if part == 0 for d in leaves for leaf in leaves[d]) == sorted(weights)
    assert all(sum(weights[d, leaf] for d in leaves for leaf in leaves[d]) <= 100 * parts for leaves, _, parts in rounds)
    assert [(part, parts) for leaves, part, parts in rounds if 12 in leaves.get(64, [])] == [(0, 3), (1, 3), (2, 3)]


def test_disk_stays_near_the_input(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(E, "LEAST_ROUND", 0)
    r = np.random.default_rng(6)
    n = 20_000
    x = r.standard_normal((n, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = r.integers(0, 10, n)
    x[1:2000:2], label[1:2000:2] = x[0:2000:2] + r.standard_normal((1000, 64)) * 0.04, label[0:2000:2]
    spark.createDataFrame([(i, v, int(k)) for i, (v, k) in enumerate(zip(x.tolist(), label, strict=True))], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/in")
    df = spark.read.parquet(f"{tmp_path}/in")
    folders = [*spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString(), shared_dir(spark).removeprefix("file://")]

    def files():
        found = {}
        for path in (os.path.join(at, f) for folder in folders for at, _, names in os.walk(folder) for f in names):
            try:
                found[path] = os.path.getsize(path)
            except OSError:
                pass
        return found

    before, peak, done = set(files()), [0], threading.Event()

    def watch():
        while not done.wait(0.1):
            peak[0] = max(peak[0], sum(size for path, size in files().items() if path not in before))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        E.near_duplicates(df).write.parquet(f"{tmp_path}/out")
    finally:
        done.set()
        watcher.join()
    assert x.nbytes < peak[0] < 4.5 * x.nbytes
    got = {v.vec_id: v.n_links for v in spark.read.parquet(f"{tmp_path}/out").collect()}
    x = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = np.zeros(n, int)
    for k in range(10):
        at = np.flatnonzero(label == k)
        want[at] = (x[at] @ x[at].T >= 0.93).sum(1) - 1
    assert want.sum() > 1500 and sum(got.values()) >= 0.995 * want.sum() and all(got[i] <= want[i] for i in range(n))


def test_bound_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(E, "LEAST_LEAF", 10_000)  # one leaf, so that every link is compared
    monkeypatch.setattr(E, "_basis", lambda sample: np.linalg.qr(np.random.default_rng(1).standard_normal((64, 24)))[0])
    for shift in (0.0, 0.8):
        rows = [(i, [float(np.float32(x + shift)) for x in v], label) for i, v, label in rows_of(12, 500, 64)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
        assert {x.vec_id: (x.n_links, x.component_id, x.kept) for x in E.near_duplicates(df).collect()} == brute(rows)
