import random

import pyarrow.parquet as pq
import pytest
import sentencepiece

from parley.llm import pieces as P


@pytest.fixture(scope="module")
def both():
    return P.Codec(P.read_model()), sentencepiece.SentencePieceProcessor(model_file=P.DEFAULT_MODEL)


def test_same_ids_as_the_library_on_random_texts(both):
    codec, library = both
    r = random.Random(6)
    bits = ["the", "a", " ", "  ", "\n", "\t", "é", "漢", "☃", "ing", "e", "xx", "aaaa", "=", "----", "1", "23", "Über", "ß", "'s", ".", "́", "𝄞", "▁", "ab", "int", "er", "n", "s"]
    for _ in range(4000):
        t = "".join(r.choice(bits) for _ in range(r.choice([0, 1, 2, 3, 8, 30])))
        assert codec.encode(t) == library.encode(t), repr(t)


def test_same_ids_as_the_library_on_documents(both):
    codec, library = both
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist()
    for t in texts:
        ids = codec.encode(t)
        assert ids == library.encode(t)
        assert codec.decode(ids) == t


def test_long_units_and_parts(both):
    codec, library = both
    r = random.Random(2)
    for n in (100, 3000, 20_000):
        t = "".join(r.choice("abcdeinrst=-x") for _ in range(n))
        want = library.encode(t)
        assert codec.encode(t) == want
        whole = P.BLANK + t
        assert list(codec.stream(iter([whole[i : i + 7] for i in range(0, len(whole), 7)]))) == want
    t = "e" * 5000
    assert codec.encode(t) == library.encode(t)


def test_whole_documents_as_streams(both):
    codec, library = both
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist()
    for t in texts[:40]:
        whole = P.BLANK + t.replace(" ", P.BLANK)
        assert list(codec.stream(iter([whole[i : i + 11] for i in range(0, len(whole), 11)]))) == library.encode(t)


def test_the_window_stays_bounded(both):
    codec, _ = both
    seen = []
    walk = codec.walk
    codec.walk = lambda last, size, end: (seen.append(len(size)), walk(last, size, end))[1]
    try:
        n = sum(1 for _ in codec.stream(iter(["the cat sat ".replace(" ", P.BLANK) * 20_000])))
    finally:
        del codec.walk
    assert n > 50_000 and len(seen) > 40 and max(seen) < 4096 + 4 * codec.longest


def test_other_models_are_refused(both):
    field = lambda n, v: bytes([n << 3, v]) if isinstance(v, int) else bytes([n << 3 | 2, len(v)]) + v
    assert P.model_type(field(1, b"piece") + field(2, field(1, b"in") + field(3, 1))) == P.model_type(b"") == 1 and P.model_type(field(2, field(3, 2))) == 2


def test_tables(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "two  words\n", None), (4, "a▁b", "z"), (None, "n", "z"), (4, "again", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = P.encode_table(docs)
    assert sorted(r.n_ids for r in got.collect())[:2] == [0, 0] and got.where("round_trip").count() == 6
    back = {r.doc_id: r.text for r in P.decode_table(got).collect()}
    assert back[3] == "two  words\n" and back[1] == ""
    assert P.encode_table(docs.limit(0)).collect() == []
