"""Readers and writers of the document formats: canonical transcripts, ground truth, query sets, speaker labels, RTTM, WAV, result files."""

from __future__ import annotations

import json
import os
import tempfile
import wave
from collections.abc import Iterator
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "struct<word:string,start_seconds:double,end_seconds:double,confidence:double,timing_source:string>"
CANONICAL = f"file_id string, audio_duration_seconds double, speaker_labels array<string>, turns array<struct<turn_id:long,speaker_label:string,start_seconds:double,end_seconds:double,split_reason:string,is_short_turn:boolean,text:string,words:array<{WORD}>>>"
GROUND_TRUTH = "file_id string, title string, domain string, duration_seconds double, speakers array<struct<id:string,role:string>>, turns array<struct<turn_id:long,speaker:string,start_time:double,end_time:double,text:string>>"
_MOMENT = "file_id:string,turn_id:long,speaker:string,start_seconds:double,end_seconds:double,matched_text:string"
QRELS = f"split string, total_queries long, queries array<struct<query_id:string,category:string,query:string,style:string,relevant_moments:array<struct<{_MOMENT},alternatives:array<struct<{_MOMENT}>>>>,hard_negatives:array<struct<file_id:string,turn_id:long,speaker:string,start_seconds:double,end_seconds:double,reason:string>>>>"
# Types of audio and video that may be uploaded.
EXTENSIONS = ("wav", "mp3", "m4a", "flac", "ogg", "opus", "aac", "mp4", "webm")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def canonical(spark: SparkSession, folder: str, file_ids: list[str] | None = None) -> DataFrame:
    """Transcripts of a workspace folder with their path and hash, one row each. Named files must exist; an absent folder gives none."""
    if file_ids:
        paths = [f"{folder}/{f}_canonical.json" for f in file_ids]
        if absent := [p for p in paths if not _exists(spark, p)]:
            raise FileNotFoundError(f"canonical transcripts not found: {absent}")
    elif not _exists(spark, folder):
        return spark.createDataFrame([], f"{CANONICAL}, path string, sha256 string")
    else:
        paths = [f"{folder}/*_canonical.json"]
    files = spark.read.format("binaryFile").load(paths)
    parsed = files.select("path", F.sha2("content", 256).alias("sha256"), F.from_json(F.decode("content", "UTF-8"), CANONICAL).alias("d"))
    return parsed.select("d.*", "path", "sha256")


def transcript_words(docs: DataFrame) -> DataFrame:
    """Canonical transcripts as words(file_id, turn, role, pos, word, start_s, end_s)."""
    turns = docs.select("file_id", F.explode("turns").alias("t"))
    words = turns.select("file_id", F.col("t.turn_id").alias("turn"), F.col("t.speaker_label").alias("role"), F.posexplode("t.words").alias("pos", "w"))
    return words.select("file_id", "turn", "role", F.col("pos").cast("long").alias("pos"), F.col("w.word").alias("word"), F.col("w.start_seconds").alias("start_s"), F.col("w.end_seconds").alias("end_s"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Reference turns(file, turn_id, speaker, start_s, end_s, text)."""
    docs = spark.read.schema(GROUND_TRUTH).option("multiLine", True).json(path)
    t = docs.select(F.col("file_id").alias("file"), F.explode("turns").alias("t"))
    return t.select("file", "t.turn_id", "t.speaker", F.col("t.start_time").alias("start_s"), F.col("t.end_time").alias("end_s"), "t.text")


def qrels(spark: SparkSession, path: str) -> DataFrame:
    """Query sets: one row a query, with nested moments and hard negatives."""
    return spark.read.schema(QRELS).option("multiLine", True).json(path).select("split", F.explode("queries").alias("q")).select("split", "q.*")


def moments(queries: DataFrame) -> DataFrame:
    """(qid, moment, file, speaker, start_s, end_s): every moment and, under its number, its alternatives."""
    m = queries.select(F.col("query_id").alias("qid"), F.posexplode("relevant_moments").alias("moment", "m"))
    shape = lambda c: F.struct(*[c[x].alias(x) for x in ("file_id", "speaker", "start_seconds", "end_seconds")])
    own = F.array(shape(F.col("m")))
    others = F.transform(F.coalesce("m.alternatives", F.array()), shape)
    one = m.select("qid", "moment", F.explode(F.concat(own, others)).alias("x"))
    return one.select("qid", F.col("moment").cast("long").alias("moment"), F.col("x.file_id").alias("file"), "x.speaker", F.col("x.start_seconds").alias("start_s"), F.col("x.end_seconds").alias("end_s"))


def speaker_labels(spark: SparkSession, path: str) -> DataFrame:
    """(file, label, name) of label files."""
    docs = spark.read.schema("file_id string, labels map<string,string>").option("multiLine", True).json(path)
    return docs.select(F.col("file_id").alias("file"), F.explode("labels").alias("label", "name"))


def rttm(spark: SparkSession, path: str) -> DataFrame:
    """Intervals(file, speaker, start, end) of SPEAKER lines with eight fields or more."""
    parts = spark.read.text(path).select(F.split(F.btrim("value"), r"\s+").alias("p")).where((F.size("p") >= 8) & (F.get("p", F.lit(0)) == "SPEAKER"))
    field = lambda i: F.get("p", F.lit(i))
    begin = field(3).cast("double")
    return parts.select(field(1).alias("file"), field(7).alias("speaker"), begin.alias("start"), (begin + field(4).cast("double")).alias("end"))


def write_rttm(intervals: DataFrame, path: str) -> None:
    """Interval lines with three decimals, in order of file and start."""
    line = F.format_string("SPEAKER %s 1 %.3f %.3f <NA> <NA> %s <NA> <NA>", "file", "start", F.col("end") - F.col("start"), "speaker")
    intervals.orderBy("file", "start").select(line.alias("value")).write.text(path)


def write_results(results: DataFrame, path: str, one_time: bool = False) -> None:
    """Result rows as JSON; a one-time split's file is never overwritten."""
    results.write.mode("errorifexists" if one_time else "overwrite").json(path)


def write_json(path: str, value: object) -> None:
    """A driver-side JSON file that is there whole or not at all."""
    handle, name = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f, indent=2, sort_keys=True, ensure_ascii=False)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def evaluation_config(queries: DataFrame) -> dict:
    """An evaluation harness's config: a test for each query, with the query's own fields as variables."""
    rows = [json.loads(r[0]) for r in queries.orderBy("query_id").select(F.to_json(F.struct(*queries.columns))).toLocalIterator()]
    return {"prompts": ["{{query}}"], "tests": [{"description": r["query_id"], "vars": r} for r in rows]}


def files_with_content(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of every file that a path or pattern names. Spark's own listing leaves out empty files, so the file system is asked for the names."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(f.getPath().toString(), f.getLen()) for top in fs.globStatus(pattern) or [] for f in (fs.listStatus(top.getPath()) if top.isDirectory() else [top]) if f.isFile()]
    names = spark.createDataFrame(found, "path string, length long")
    if not any(size for _, size in found):
        return names.withColumn("content", F.lit(b""))
    read = spark.read.format("binaryFile").load(path).select(_plain("path").alias("p"), "content")
    return names.join(read, _plain("path") == F.col("p"), "left").select("path", "length", F.coalesce("content", F.lit(b"")).alias("content"))


def _plain(path: str):
    """A path without what differs between listings: the slashes after the scheme."""
    return F.regexp_replace(path, "^([A-Za-z0-9+.-]+):/+", "$1:/")


def write_evaluation_config(path: str, queries: DataFrame) -> dict:
    """The config as JSON and, beside it, as YAML (of which JSON text is a part), both read again and compared."""
    config = evaluation_config(queries)
    for name in (f"{path}.json", f"{path}.yaml"):
        write_json(name, config)
        with open(name, encoding="utf-8") as f:
            if json.load(f) != config:
                raise ValueError(f"{name} doesn't hold the queries")
    return config


def result_path(folder: str, split: str, one_time: set[str], label: str | None = None) -> str:
    """Where a split's results go. A one-time split has one official file; what is run after it needs a label and never takes its name."""
    official = f"{folder}/final_{split}.json"
    if split not in one_time or not os.path.exists(official):
        return official if label is None else f"{folder}/{split}_{label}.json"
    if not label:
        raise FileExistsError(f"{official}: {split} was run; name the rerun")
    return f"{folder}/{split}_rerun_{label}.json"


def uploads(spark: SparkSession, path: str, most_seconds: float = 600.0, least_seconds: float = 10.0) -> DataFrame:
    """(path, sha256, file_id, seconds, rule): files with an id from their content, so that files of equal content have one id, and the rule each breaks: type (of EXTENSIONS), empty, audio (a WAV that can't be read) or
    duration. Other audio than WAV needs a decoder outside Spark; its seconds are null."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    found = files_with_content(spark, path).withColumns({"kind": kind, "sha256": F.sha2("content", 256)})
    facts = found.where("kind = 'wav' AND length > 0").select("path", "content").mapInArrow(_wav_headers, WAV)
    joined = found.drop("content").join(facts.select("path", "rate", "seconds"), "path", "left")
    of_wav = F.col("kind") == "wav"
    rule = F.when(~F.col("kind").isin(*EXTENSIONS), "type").when(F.col("length") == 0, "empty").when(of_wav & F.col("rate").isNull(), "audio").when(of_wav & ~F.col("seconds").between(least_seconds, most_seconds), "duration")
    return joined.select("path", "sha256", F.concat(F.lit("upload_"), F.substring("sha256", 1, 16)).alias("file_id"), "seconds", rule.alias("rule"))


def to_standard_wav(content: bytes, most_seconds: float = 601.0, rate: int = 16_000) -> bytes:
    """A PCM WAV of 8, 16, 24 or 32 bits as 16 kHz, mono, 16 bits: channels averaged, linearly resampled, cut after most_seconds."""
    with wave.open(BytesIO(content)) as w:
        channels, width, was = w.getnchannels(), w.getsampwidth(), w.getframerate()
        raw = np.frombuffer(w.readframes(min(w.getnframes(), int(most_seconds * was))), np.uint8).reshape(-1, width)
    padded = np.zeros((len(raw), 4), np.uint8)
    padded[:, 4 - width :] = raw ^ 128 if width == 1 else raw
    mono = (padded.view("<i4")[:, 0] / 2**31).reshape(-1, channels).mean(1)
    n = int(len(mono) * rate / was)
    resampled = np.interp(np.arange(n) * was / rate, np.arange(len(mono)), mono) if len(mono) else mono
    out = BytesIO()
    with wave.open(out, "wb") as o:
        o.setparams((1, 2, rate, 0, "NONE", ""))
        o.writeframes(np.clip(np.rint(resampled * 32767), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


WAV = "path string, rate long, channels long, width long, seconds double"


def _wav_headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for p, data in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
            try:
                with wave.open(BytesIO(data or b"")) as w:
                    out.append((p, w.getframerate(), w.getnchannels(), w.getsampwidth(), w.getnframes() / w.getframerate()))
            except (wave.Error, EOFError, ZeroDivisionError):
                out.append((p, None, None, None, None))
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["path", "rate", "channels", "width", "seconds"])


def wav_facts(spark: SparkSession, path: str, most_seconds: float = 600.0, least_seconds: float = 10.0) -> DataFrame:
    """Rate, channels, bytes a sample, seconds and hash of WAV files, empty ones too, and the rule each breaks: wav, format (16 kHz, mono, 16 bit) or duration."""
    files = files_with_content(spark, path)
    facts = files.select("path", "content").mapInArrow(_wav_headers, WAV)
    rule = F.when(F.col("rate").isNull(), "wav").when((F.col("rate") != 16000) | (F.col("channels") != 1) | (F.col("width") != 2), "format").when(~F.col("seconds").between(least_seconds, most_seconds), "duration")
    return facts.join(files.select("path", F.sha2("content", 256).alias("sha256")), "path").withColumn("rule", rule)


def verified(facts: DataFrame, manifest: DataFrame) -> DataFrame:
    """wav_facts against manifest(name, rate, channels, seconds, sha256) by file name -> (name, rule): missing, hash, rate, channels or seconds (more than a hundredth off), or the file's own rule; null where all is well."""
    f = facts.withColumn("name", F.substring_index("path", "/", -1)).select("name", *[F.col(c).alias(f"f_{c}") for c in ("rate", "channels", "seconds", "sha256", "rule")], F.lit(True).alias("there"))
    m = manifest.join(f, "name", "left")
    rule = F.when(F.col("there").isNull(), "missing").when(F.col("f_rule").isNotNull(), F.col("f_rule")).when(F.col("sha256") != F.col("f_sha256"), "hash")
    rule = rule.when(F.col("rate") != F.col("f_rate"), "rate").when(F.col("channels") != F.col("f_channels"), "channels").when(F.abs(F.col("seconds") - F.col("f_seconds")) > 0.01, "seconds")
    return m.select("name", rule.alias("rule"))


def clip_wav(content: bytes, start: float, end: float, margin: float = 0.15) -> bytes:
    """The WAV of a part of a WAV, `margin` seconds wider on both sides and kept inside it."""
    with wave.open(BytesIO(content)) as w:
        rate, n = w.getframerate(), w.getnframes()
        a, b = max(0, int((start - margin) * rate)), min(n, int((end + margin) * rate))
        w.setpos(min(a, n))
        frames, out = w.readframes(max(0, b - a)), BytesIO()
        with wave.open(out, "wb") as o:
            o.setparams(w.getparams())
            o.writeframes(frames)
        return out.getvalue()


def mix_at_snr(signal: np.ndarray, noise: np.ndarray, snr_db: float) -> np.ndarray:
    """Noise, repeated or cut to the signal's length, added at a signal-to-noise ratio; the sum is clipped to [-1, 1]. Silent noise is refused."""
    level = lambda x: float(np.sqrt(np.mean(np.square(x, dtype=float)))) if len(x) else 0.0
    noise = np.resize(noise, len(signal))
    if not level(noise):
        raise ValueError("the noise is silent")
    return np.clip(signal + noise * (level(signal) / (level(noise) * 10 ** (snr_db / 20))), -1.0, 1.0)
