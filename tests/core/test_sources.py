import json
import wave
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import index
from parley.sources import documents as D
from parley.streaming import live


def test_canonical(spark, tmp_path):
    doc = {"file_id": "a.wav", "audio_duration_seconds": 3.0, "speaker_labels": ["S0"], "turns": [{"turn_id": 1, "speaker_label": "S0", "words": [{"word": "hi", "start_seconds": 0.0, "end_seconds": 0.4}, {"word": "you", "start_seconds": 0.5, "end_seconds": 0.9}]}]}
    (tmp_path / "a_canonical.json").write_text(json.dumps(doc, indent=1))
    got = D.canonical(spark, str(tmp_path))
    assert got.count() == 1 and [r.word for r in D.transcript_words(got).orderBy("pos").collect()] == ["hi", "you"]
    assert D.canonical(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        D.canonical(spark, str(tmp_path), ["b"])


def test_rttm_round_trip(spark, tmp_path):
    iv = spark.createDataFrame([("f", "S0", 0.0, 1.25), ("f", "S1", 1.5, 2.0)], "file string, speaker string, start double, end double")
    D.write_rttm(iv, str(tmp_path / "r"))
    assert sorted(map(tuple, D.rttm(spark, str(tmp_path / "r")).collect())) == sorted(map(tuple, iv.collect()))


def test_moments_and_labels(spark, tmp_path):
    m = {"file_id": "f", "speaker": "A", "start_seconds": 1.0, "end_seconds": 2.0}
    q = {"split": "dev", "queries": [{"query_id": "q1", "category": "c", "query": "x", "relevant_moments": [m | {"alternatives": [m | {"start_seconds": 5.0, "end_seconds": 6.0}]}, m]}]}
    (tmp_path / "q.json").write_text(json.dumps(q))
    queries = D.qrels(spark, str(tmp_path / "q.json"))
    assert sorted((r.moment, r.start_s) for r in D.moments(queries).collect()) == [(0, 1.0), (0, 5.0), (1, 1.0)]
    assert D.write_evaluation_config(str(tmp_path / "config"), queries)["tests"][0]["vars"]["query"] == "x" and (tmp_path / "config.yaml").exists()
    (tmp_path / "l.json").write_text(json.dumps({"file_id": "f", "labels": {"S0": "Ann"}}))
    assert D.speaker_labels(spark, str(tmp_path / "l.json")).first().name == "Ann"


def tone(seconds, rate=16000):
    out = BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 2, rate, 0, "NONE", ""))
        w.writeframes((np.sin(np.arange(int(seconds * rate)) / 9) * 9000).astype("<i2").tobytes())
    return out.getvalue()


def test_audio(spark, tmp_path):
    for name, data in (("a.wav", tone(12)), ("b.wav", tone(2)), ("c.wav", tone(12, 8000)), ("d.wav", b"no"), ("e.txt", b"x"), ("f.wav", b""), ("g.wav", tone(12))):
        (tmp_path / name).write_bytes(data)
    rules = {r.path[-5:]: r.rule for r in D.wav_facts(spark, str(tmp_path / "*.wav")).collect()}
    assert rules == {"a.wav": None, "b.wav": "duration", "c.wav": "format", "d.wav": "wav", "f.wav": "wav", "g.wav": None}
    for place in (str(tmp_path), str(tmp_path / "*")):
        up = {r.path[-5:]: r for r in D.uploads(spark, place).collect()}
        assert {n: r.rule for n, r in up.items()} == {"a.wav": None, "b.wav": "duration", "c.wav": None, "d.wav": "audio", "e.txt": "type", "f.wav": "empty", "g.wav": None}
        assert up["a.wav"].file_id == up["g.wav"].file_id and up["a.wav"].seconds == 12.0
    assert [r.rule for r in D.uploads(spark, str(tmp_path / "f.wav")).collect()] == ["empty"] and D.uploads(spark, str(tmp_path / "no*")).collect() == []
    facts = D.wav_facts(spark, str(tmp_path / "*.wav"))
    sha = {r.path[-5:]: r.sha256 for r in facts.collect()}
    manifest = [("a.wav", 16000, 1, 12.0, sha["a.wav"]), ("b.wav", 16000, 1, 2.0, sha["b.wav"]), ("g.wav", 16000, 1, 12.5, sha["g.wav"]), ("a2.wav", 16000, 1, 12.0, sha["a.wav"]), ("f.wav", 16000, 1, 1.0, sha["f.wav"])]
    rules = D.verified(facts, spark.createDataFrame(manifest, "name string, rate long, channels long, seconds double, sha256 string"))
    assert {r.name: r.rule for r in rules.collect()} == {"a.wav": None, "b.wav": "duration", "g.wav": "seconds", "a2.wav": "missing", "f.wav": "wav"}
    with wave.open(BytesIO(D.clip_wav(tone(12), 1.0, 2.0))) as w:
        assert abs(w.getnframes() / 16000 - 1.3) < 0.01
    signal, noise = np.sin(np.arange(8000) / 5) * 0.2, np.random.default_rng(0).standard_normal(999) * 0.1
    added = D.mix_at_snr(signal, noise, 12) - signal
    assert abs(10 * np.log10(np.mean(signal**2) / np.mean(added**2)) - 12) < 0.1
    with pytest.raises(ValueError):
        D.mix_at_snr(signal, np.zeros(5), 12)


def test_standard_wav():
    for data, seconds in ((tone(12, 8000), 12.0), (tone(3, 44100), 3.0)):
        with wave.open(BytesIO(D.to_standard_wav(data))) as w:
            assert (w.getframerate(), w.getnchannels(), w.getsampwidth()) == (16000, 1, 2) and abs(w.getnframes() / 16000 - seconds) < 0.01
            assert abs(np.abs(np.frombuffer(w.readframes(w.getnframes()), "<i2")).max() - 9000) < 50
    stereo = BytesIO()
    with wave.open(stereo, "wb") as w:
        w.setparams((2, 3, 16000, 0, "NONE", ""))
        w.writeframes(np.array([[2**22, 0]] * 16000, "<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes())
    with wave.open(BytesIO(D.to_standard_wav(stereo.getvalue(), most_seconds=0.5))) as w:
        assert w.getnframes() == 8000 and abs(int(np.frombuffer(w.readframes(9), "<i2")[0]) - 8192) < 2


def test_names_of_results(tmp_path):
    place = lambda label=None: D.result_path(str(tmp_path), "blind", {"blind"}, label)
    assert place() == f"{tmp_path}/final_blind.json"
    (tmp_path / "final_blind.json").write_text("{}")
    with pytest.raises(FileExistsError):
        place()
    assert place("clean") == f"{tmp_path}/blind_rerun_clean.json" and D.result_path(str(tmp_path), "dev", {"blind"}) == f"{tmp_path}/final_dev.json"


def test_late_jobs_are_cancelled(spark):
    from parley.plans.session import within

    assert within(spark, 60, lambda: spark.range(9).count()) == 9
    slow = spark.range(8, numPartitions=8).select(F.expr("aggregate(sequence(1, 2000000), 0L, (t, x) -> t + pmod(hash(x, id), 7))").alias("x"))
    with pytest.raises(TimeoutError):
        within(spark, 0.2, lambda: slow.union(slow).union(slow).union(slow).agg({"x": "sum"}).collect())


def test_json_is_whole_or_absent(tmp_path):
    path = str(tmp_path / "x.json")
    D.write_json(path, {"b": 1, "a": "é"})
    assert json.load(open(path)) == {"a": "é", "b": 1}
    with pytest.raises(TypeError):
        D.write_json(path, {"a": object()})
    assert json.load(open(path))["b"] == 1 and len(list(tmp_path.iterdir())) == 1


def test_one_time_results(spark, tmp_path):
    rows = spark.range(2)
    D.write_results(rows, str(tmp_path / "r"), one_time=True)
    with pytest.raises(Exception, match="(?i)exist"):
        D.write_results(rows, str(tmp_path / "r"), one_time=True)


def test_streamed_turns(spark, tmp_path):
    rows = [(1, 0, "A", "hello", 0.0, 0.5), (1, 1, "B", "there", 0.6, 1.0), (1, 2, "B", "hi", 2.6, 3.0), (1, 3, "B", "again", 4.0, 4.5), (1, 4, None, None, 5.0, 5.0)]
    schema = "conv_id long, pos long, speaker string, word string, start_s double, end_s double"
    for i, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = live.live_turns(stream).writeStream.format("memory").queryName("turns_out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = [(r.turn_id, r.speaker, r.split_reason, r.text) for r in spark.sql("SELECT * FROM turns_out ORDER BY turn_id").collect()]
    assert got == [(1, "A", "speaker_change", "hello"), (2, "B", "pause", "there"), (3, "B", "end_of_audio", "hi again")]


def test_streamed_sessions_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events*.parquet")
    q = live.sessions(stream).writeStream.format("memory").queryName("sessions_out").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    closed = spark.table("sessions_out")
    both = live.sessions(events).join(closed, ["user_id", "start", "end", "n_events"])
    assert closed.count() == both.count() > 0


def test_streamed_index(spark, tmp_path):
    rows = spark.createDataFrame([("w", "a", 1), ("w", "b", 2)], "workspace string, file_id string, id long")
    rows.write.parquet(str(tmp_path / "in"))
    store = index.Store(spark, str(tmp_path / "store"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    live.index_batches(stream, store, "chunks", str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.id for r in store.read("chunks").collect()) == [1, 2]
    assert live.heartbeats(spark.sql("SELECT 1L user_id, timestamp'2024-01-01' ts")).select(F.col("last")).count() == 1
