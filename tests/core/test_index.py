import pytest

from parley.operators import index, retrieve

FILES = "workspace string, file_id string, sha256 string, settings string"


def test_changed(spark):
    now = spark.createDataFrame([("w", "a", "1", "s"), ("w", "b", "2", "s"), ("w", "c", "3", "s2"), ("w", "d", "4", "s")], FILES)
    was = spark.createDataFrame([("w", "a", "1", "s"), ("w", "b", "x", "s"), ("w", "c", "3", "s"), ("v", "d", "4", "s")], FILES)
    assert {r.file_id: r.reason for r in index.changed(now, was).collect()} == {"b": "transcript", "c": "settings", "d": "new"}
    assert index.changed(now, was, force=True).count() == 4


def test_prune_refuses_nothing(spark):
    was = spark.createDataFrame([("w", "a", "1", "s"), ("w", "b", "2", "s")], FILES)
    assert [r.file_id for r in index.pruned(was, was.where("file_id = 'a'")).collect()] == ["a"]
    with pytest.raises(ValueError):
        index.pruned(was, was.limit(0))


def test_names(spark):
    t = "file string, label string, name string"
    old = spark.createDataFrame([("f", "S0", "Ann"), ("f", "S1", None)], t)
    assert {r.label: r.name for r in index.synced_names(old, spark.createDataFrame([("f", "S1", "Bo"), ("f", "S2", "Cy")], t)).collect()} == {"S0": "Ann", "S1": "Bo", "S2": "Cy"}
    two = spark.createDataFrame([("f", "S0", "Ann"), ("f", "S1", "Bo"), ("g", "S0", "X")], t)
    assert {(r.file, r.label): r.name for r in index.swapped(two).collect()} == {("f", "S0"): "Bo", ("f", "S1"): "Ann", ("g", "S0"): "X"}
    odd = spark.createDataFrame([("f", "a", " Ann  B "), ("f", "b", "ann b"), ("f", "c", " "), ("f", "d", "x" * 81), ("f", "e", "ok")], t)
    assert {r.label: r.rule for r in index.valid_names(odd).collect()} == {"a": "repeated", "b": "repeated", "c": "empty", "d": "long", "e": None}


def test_store_replaces_a_recording_and_adds_missing_vectors(spark, tmp_path):
    store = index.Store(spark, str(tmp_path))
    rows = lambda *x: spark.createDataFrame([("w", f, i, t) for f, i, t in x], "workspace string, file_id string, id long, text string")
    store.write("chunks", rows(("a", 1, "one two"), ("b", 2, "three")))
    assert store.embed_missing("chunks", "vectors", "hash", retrieve.embed) == 2
    store.write("chunks", rows(("b", 3, "four")))
    assert sorted(r.id for r in store.read("chunks").collect()) == [1, 3]
    assert store.embed_missing("chunks", "vectors", "hash", retrieve.embed) == 1
    assert store.embed_missing("chunks", "vectors", "hash", retrieve.embed) == 0
    v = store.read("vectors").where("id = 1").first().embedding
    assert len(v) == 768 and abs(sum(x * x for x in v) - 1) < 1e-9


def test_cache_key_follows_settings_and_content(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "1")], "file_id string, sha256 string")
    keys = lambda **c: [r.cache_key for r in index.cache_key(c, files).orderBy("file_id").collect()]
    assert keys(x="1", y="2") == keys(y="2", x="1") and keys(x="1") != keys(x="2") and len(set(keys(x="1"))) == 2
