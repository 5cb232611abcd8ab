import math
import random
import re
import zlib

import zstandard

from parley.llm import language_id as L

SOUNDS = {"aa": ["ka", "ti", "mo", "ren"], "bb": ["sch", "ung", "heit", "ver"], "cc": ["eau", "oi", "que", "ment"]}


def rows_of(seed, n):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(SOUNDS))
        out.append((i, " ".join("".join(r.choices(SOUNDS[lang], k=r.choice([1, 2, 3]))) for _ in range(r.choice([8, 40, 400]))), lang))
    return out


def test_held_out_accuracy(spark):
    rows = rows_of(1, 300) + [(900, None, "aa"), (901, "", "bb"), (902, "12 34 !", None), (903, "que ment eau", None)]
    got = {x.doc_id: x for x in L.identify(spark.createDataFrame([(*x, 0.5) for x in rows], "doc_id long, text string, lang string, score double")).collect()}
    assert len(got) == len(rows)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, _, _ in rows)
    held = [(i, lang) for i, _, lang in rows[:300] if got[i].held_out]
    assert sum(got[i].lang_pred == lang for i, lang in held) / len(held) > 0.97
    assert [got[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3
    assert all(0 <= x.score <= 1 for x in got.values())


def test_own_label_is_no_input(spark):
    rows = rows_of(2, 120)
    other = [(i, t, "aa" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    first, second = ({x.doc_id: x.lang_pred for x in L.identify(spark.createDataFrame(r, "doc_id long, text string, lang string")).collect()} for r in (rows, other))
    assert first == second


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert L.identify(docs).first().lang_pred == "und"
    assert L.identify(docs.limit(0)).collect() == []


def test_narrow_margin_is_rejected():
    judge = L.Judge({"aa": (b"ka ti mo ren " * 50, 0.5), "bb": (b"ka ti mo ren " * 50, 0.5)}, 2048, 0.01)
    assert judge.judge("ka ti")[0] == "aa" and judge.judge("ka ti")[2]


def test_every_language_is_learned(spark, monkeypatch):
    r = random.Random(8)
    langs = {f"l{k:02}": ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(30)] for k in range(70)}
    rows = [(100 * k + i, " ".join(r.choices(words, k=30)), lang) for k, (lang, words) in enumerate(langs.items()) for i in range(8)]
    docs = spark.createDataFrame([*rows, (90_000, None, None)], "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in L.identify(docs).collect()}
    assert len(got) == len(rows) + 1 and got[90_000].lang_pred == "und"
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    monkeypatch.setattr(L, "LANGUAGES", 1000)
    once = {x.doc_id: x for x in L.identify(docs).collect()}
    assert all((x.lang_pred, x.rejected) == (got[i].lang_pred, got[i].rejected) and abs(x.score - got[i].score) < 1e-9 for i, x in once.items())


def plain_sizes(text, content, shares):
    """Bytes of each language's compression, block by block, and the language's own cost."""
    data = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()))
    out = {}
    for lang, raw in content.items():
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=6)
        press = zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        out[lang] = sum(len(press.compress(data[i : i + 512].encode())) for i in range(0, len(data), 512)) - math.log2(shares[lang]) / 8
    return out


def test_against_brute_force(spark):
    rows = rows_of(9, 160) + [(800, "ka ti " * 30_000, "aa"), (801, "Sch1ung--heit! VER", None), (802, "x", "cc"), (803, "x", None)]
    df = spark.createDataFrame([(*x, 3, "z") for x in rows], "doc_id long, text string, lang string, best int, name string")
    learning = df.where("crc32(cast(cast(doc_id AS STRING) AS BINARY)) % 4 <> 2").select("doc_id", "text", "lang")
    counts = L.learned(learning)
    found = L.dictionaries(learning, counts, list(counts))
    content, shares = {k: v[0] for k, v in found.items()}, {k: n / sum(counts.values()) for k, n in counts.items()}
    assert set(content) == {"aa", "bb", "cc"} and sum(counts.values()) < 160
    for x in L.identify(df).collect():
        sizes = plain_sizes(next(t for i, t, _ in rows if i == x.doc_id), content, shares)
        best = min(sizes.values())
        assert x.lang_pred == next(k for k in sorted(sizes) if sizes[k] == best)
        assert abs(x.score - 1 / sum(2 ** max(-60, best - s) for s in sizes.values())) < 1e-9
