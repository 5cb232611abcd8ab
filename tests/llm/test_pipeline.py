import zlib

import corpus_pipeline as C
from parley.llm import secret_scan
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_ngram_join import brute as groups


def test_stages_against_plain_versions(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    one = docs.limit(100000)
    kept = C.toxicity(spark, one, sf)
    assert kept.columns == names
    rows = {r.doc_id: r for r in kept.collect()}
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    assert len(rows) < docs.count() and not {i for i in toxic if zlib.crc32(str(i).encode()) % 4 != 2 and "idiot" in docs.where(f"doc_id = {i}").first().text} & set(rows)
    two = C.near_duplicates(spark, kept, sf)
    assert two.columns == names
    after = {r.doc_id: r for r in two.collect()}
    assert set(after) == {i for i, _, c in groups([(i, r.text) for i, r in rows.items()], 5, 80) if i == c}
    three = C.decontamination(spark, two, sf)
    bad = {d for d, _ in contaminated([(i, r.text) for i, r in after.items()], [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])}
    left = {r.doc_id: r for r in three.collect()}
    assert three.columns == names and set(left) == set(after) - bad
    four = {r.doc_id: r for r in C.secrets(spark, three, sf).collect()}
    for i, r in left.items():
        assert four[i].text == r.text if not secret_scan.spans(r.text)[1] else not secret_scan.base_spans(four[i].text)
    last = C.tokens(spark, three, sf)
    assert last.columns == [*names, "n_ids", "ids", "round_trip"] and last.where("NOT round_trip").count() == 0 and last.count() == len(left)


def test_odd_rows_pass(spark):
    rows = [(1, None, "en", None), (2, "", None, "s"), (None, "some text here", "en", "s"), (3, "same text", "en", "s"), (3, "same text", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, component_id string")
    for name, stage in C.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        assert out.count() == len(rows), name
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
