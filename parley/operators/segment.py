"""Sentences and search windows. Punctuation splitting is a window sum; the sequential passes run per turn over Arrow batches of whole turns."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.arrow import pieces

MOST_WORDS, MOST_SECONDS, LEAST_PAUSE, LEAST_WORDS = 30, 15.0, 0.4, 4
WINDOW_SECONDS, STRETCH = 30.0, 4 / 3
# Signs that may follow a sentence end, and abbreviations that aren't one.
CLOSERS = "\"')]”’"
ABBREVIATIONS = ["mr.", "mrs.", "ms.", "dr.", "prof.", "st.", "jr.", "sr.", "vs.", "etc.", "e.g.", "i.e.", "u.s.", "u.k.", "a.m.", "p.m.", "no.", "approx.", "inc.", "ltd.", "co."]


def ends_sentence(word: Column) -> Column:
    bare = F.rtrim(word, F.lit(CLOSERS))
    return bare.rlike(r"[.?!]$") & ~F.lower(bare).isin(ABBREVIATIONS)


def punctuation_sentences(words: DataFrame) -> DataFrame:
    """words(conv_id, turn, pos, word, start_s, end_s) -> sentences by punctuation alone."""
    order = Window.partitionBy("conv_id", "turn").orderBy("pos")
    number = F.coalesce(F.sum(ends_sentence(F.col("word")).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda w: w["word"]), " ")
    return words.withColumn("sentence", number).groupBy("conv_id", "turn", "sentence").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count(F.lit(1)).alias("n_words"), listed.alias("text"))


@dataclass(frozen=True)
class Timed:
    """The words of a turn, as parallel lists."""

    word: list[str]
    start: list[float]
    end: list[float]

    def seconds(self, a: int, b: int) -> float:
        return self.end[b - 1] - self.start[a]


def _ends(word: str) -> bool:
    bare = word.rstrip(CLOSERS)
    return bare[-1:] in (".", "?", "!") and bare.lower() not in ABBREVIATIONS


def sentence_spans(t: Timed) -> list[tuple[int, int]]:
    """Word ranges of a turn's sentences: at punctuation; too long ones at their longest pause (the later of equal ones), else after 30 words; fragments joined to what is before them."""
    n = len(t.word)
    cuts = {0, n, *(i + 1 for i, w in enumerate(t.word) if _ends(w))}
    open_ = list(pairwise(sorted(cuts)))
    while open_:  # every cut leaves two parts that may be too long again
        a, b = open_.pop()
        if (cut := _cut(t, a, b)) is not None:
            cuts.add(cut)
            open_ += (a, cut), (cut, b)
    kept = [0]
    for cut, after in pairwise(sorted(cuts)[1:]):  # a cut stays if neither what it ends nor what it begins is a fragment
        if min(cut - kept[-1], after - cut) >= LEAST_WORDS:
            kept.append(cut)
    return list(pairwise([*kept, n])) if n else []


def _cut(t: Timed, a: int, b: int) -> int | None:
    """Where words a to b are cut, None if they stay together."""
    many = b - a > MOST_WORDS
    if not many and t.seconds(a, b) <= MOST_SECONDS:
        return None
    longest = max(((t.start[i] - t.end[i - 1], i) for i in range(a + LEAST_WORDS, b - LEAST_WORDS + 1)), default=(0.0, 0))
    if longest[0] >= LEAST_PAUSE:
        return longest[1]
    return a + MOST_WORDS if many else None


def window_spans(starts: list[float], ends: list[float], seconds: float = WINDOW_SECONDS) -> list[tuple[int, int]]:
    """Sentence ranges (ends exclusive) of windows that fit in `seconds`, each beginning with the last sentence of the one before unless that one is a lone sentence; a short last window is folded in.

    Sentences end in order, so a window's end is found by bisection.
    """
    n, spans = len(starts), [(0, 0)]
    while (stop := spans[-1][1]) < n:
        begin = stop - 1 if stop - spans[-1][0] > 1 else stop
        spans.append((begin, max(stop + 1, bisect_right(ends, seconds, begin, key=lambda e: e - starts[begin]))))  # noqa: B023
    if len(spans) > 2:
        head, stop = spans[-2]
        if ends[-1] - starts[stop] < seconds / 3 and ends[-1] - starts[head] <= seconds * STRETCH:
            spans[-2:] = [(head, n)]
    return spans[1:]


def _turns(words: DataFrame) -> DataFrame:
    """One row for each turn with its words in order."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "word", "start_s", "end_s")))
    return words.groupBy("conv_id", "turn", "role").agg(listed.alias("w"))


def _of(row: list[dict]) -> Timed:
    return Timed([w["word"] for w in row], [w["start_s"] for w in row], [w["end_s"] for w in row])


def sentences(words: DataFrame, worded: bool = False) -> DataFrame:
    """words(conv_id, turn, role, pos, word, start_s, end_s) -> sentences(conv_id, turn, role, sentence, start_s, end_s, n_words, text, and, if worded, words array<struct<word,start_s,end_s>>) by all three passes."""
    fields = SENTENCE + [WORDS] if worded else SENTENCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for r in batch.to_pylist():
                t = _of(r["w"])
                for k, (a, b) in enumerate(sentence_spans(t)):
                    rows.append((r["conv_id"], r["turn"], r["role"], k, t.start[a], t.end[b - 1], b - a, " ".join(t.word[a:b]), [{"word": w, "start_s": s, "end_s": e} for w, s, e in zip(t.word[a:b], t.start[a:b], t.end[a:b], strict=True)] if worded else None))
            yield _batch(rows, fields)

    return _turns(words).mapInArrow(run, _ddl(fields))


def chunks(words: DataFrame) -> DataFrame:
    """words -> windows(conv_id, turn, role, window, start_s, end_s, sentences, text) of about 30 s within one turn, with the positions of their sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = []
            for r in batch.to_pylist():
                t = _of(r["w"])
                spans = sentence_spans(t)
                for k, (a, b) in enumerate(window_spans([t.start[x] for x, _ in spans], [t.end[y - 1] for _, y in spans])):
                    x, y = spans[a][0], spans[b - 1][1]
                    rows.append((r["conv_id"], r["turn"], r["role"], k, t.start[x], t.end[y - 1], list(range(a, b)), " ".join(t.word[x:y])))
            yield _batch(rows, CHUNK)

    return _turns(words).mapInArrow(run, _ddl(CHUNK))


_KEY = [("conv_id", pa.int64(), "long"), ("turn", pa.int64(), "long"), ("role", pa.string(), "string")]
_TIME = [("start_s", pa.float64(), "double"), ("end_s", pa.float64(), "double")]
SENTENCE = [*_KEY, ("sentence", pa.int64(), "long"), *_TIME, ("n_words", pa.int64(), "long"), ("text", pa.string(), "string")]
WORDS = ("words", pa.list_(pa.struct([("word", pa.string()), ("start_s", pa.float64()), ("end_s", pa.float64())])), "array<struct<word:string,start_s:double,end_s:double>>")
CHUNK = [*_KEY, ("window", pa.int64(), "long"), *_TIME, ("sentences", pa.list_(pa.int64()), "array<long>"), ("text", pa.string(), "string")]


def _ddl(fields: list) -> str:
    return ", ".join(f"`{n}` {t}" for n, _, t in fields)


def _batch(rows: list[tuple], fields: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t, _) in enumerate(fields)], [n for n, _, _ in fields])
