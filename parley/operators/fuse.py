"""Fusion of ranked lists and the choice of clips: convex scores, which side matched, blended signals, span growth, overlap removal, highlighting."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from parley.functions import expressions as X
from parley.functions import text as T
from parley.functions.arrow import pieces

WEIGHTS = {"bm25": 1.0, "trigram": 1.0, "dense": 2.0, "sentence": 1.0}
BY_WORDS, BY_MEANING = ["bm25", "trigram"], ["dense", "sentence"]
LEAST_SHARE = 0.25


def contributions(lists: DataFrame, ran: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """lists(qid, retriever, id, score), ran(qid, retriever) -> what each list adds to an item: its min-max score times the list's share of the weights
    of all lists that ran for the query, empty ones included."""
    table = weights or WEIGHTS
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.col("retriever"))
    total = ran.groupBy("qid").agg(F.sum(weight).alias("total"))
    norm = X.min_max(F.col("score"), Window.partitionBy("qid", "retriever"))
    return lists.withColumn("norm", norm).join(total, "qid").select("qid", "retriever", "id", F.round(weight / F.col("total") * F.col("norm"), 6).alias("part"))


def convex(parts: DataFrame) -> DataFrame:
    """Fused scores, and which side they come from: both where each side has a quarter."""
    side = lambda names: F.sum(F.when(F.col("retriever").isin(names), F.col("part")).otherwise(0.0))
    sums = parts.groupBy("qid", "id").agg(F.round(F.sum("part"), 6).alias("score"), side(BY_WORDS).alias("w"), side(BY_MEANING).alias("m"), F.bool_or(F.col("retriever").isin(BY_MEANING)).alias("meant"))
    return sums.select("qid", "id", "score", matched_by(F.col("w"), F.col("m"), F.col("meant")).alias("matched_by"))


def matched_by(words: Column, meaning: Column, in_meaning_list: Column) -> Column:
    share = F.try_divide(F.least(words, meaning), words + meaning)
    return F.when(words + meaning <= 0, F.when(in_meaning_list, "meaning").otherwise("words")).when(share >= LEAST_SHARE, "both").when(words > meaning, "words").otherwise("meaning")


def blend(signals: DataFrame, group: list[str], weights: dict[str, float]) -> Column:
    """Weighted mean of normalised signal columns within a group."""
    window, total = Window.partitionBy(*group), sum(weights.values()) or 1.0
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + X.signal_norm(F.col(name), window) * (w / total)
    return F.round(out, 6)


def grow(sentences: DataFrame, group: list[str], longest: float = 20.0, shortest: float = 2.0, ratio: float = 0.8, most: int = 3) -> DataFrame:
    """sentences(group..., place, start_s, end_s, score, eligible) -> one span for each group: from the best eligible sentence (the first of equal ones), up to `most` sentences, each time
    to the better neighbour (the left of equal ones), while it scores 0.8 of the best or the span is under `shortest`, and the result is not over `longest`."""
    listed = F.array_sort(F.collect_list(F.struct("place", "start_s", "end_s", "score", "eligible")))
    at = lambda i: F.get("s", i)
    seed = grown(sentences.groupBy(*group).agg(listed.alias("s")), longest, shortest, ratio, most)
    return seed.select(*group, at(F.col("best"))["place"].alias("best"), at(F.col("lo"))["place"].alias("first"), at(F.col("hi"))["place"].alias("last"), at(F.col("lo"))["start_s"].alias("start_s"), at(F.col("hi"))["end_s"].alias("end_s"))


def grown(rows: DataFrame, longest: float, shortest: float, ratio: float, most: int) -> DataFrame:
    """rows(s array<struct<place,start_s,end_s,score,eligible,...>>, ...) with an eligible sentence -> with the indices best, lo and hi of grow's spans."""
    rows = rows.where(F.exists("s", lambda x: x["eligible"]))
    at = lambda i: F.get("s", i)
    own = F.filter(F.transform("s", lambda x, i: F.struct((-x["score"]).alias("k"), i.alias("i"), x["eligible"].alias("e"))), lambda x: x["e"])
    seed = rows.withColumn("best", F.array_min(own)["i"]).withColumns({"lo": F.col("best"), "hi": F.col("best"), "go": F.lit(True)})
    for _ in range(most - 1):
        left, right = F.when(F.col("lo") > 0, at(F.col("lo") - 1)["score"]), F.when(F.col("hi") + 1 < F.size("s"), at(F.col("hi") + 1)["score"])
        take_left = left.isNotNull() & (right.isNull() | (left >= right))
        step = seed.withColumns({"nlo": F.when(take_left, F.col("lo") - 1).otherwise(F.col("lo")), "nhi": F.when(~take_left & right.isNotNull(), F.col("hi") + 1).otherwise(F.col("hi")), "next": F.when(take_left, left).otherwise(right)})
        fits = at(F.col("nhi"))["end_s"] - at(F.col("nlo"))["start_s"] <= longest
        short = at(F.col("hi"))["end_s"] - at(F.col("lo"))["start_s"] < shortest
        good = F.col("go") & F.col("next").isNotNull() & fits & (short | (F.col("next") >= F.lit(ratio) * at(F.col("best"))["score"]))
        seed = step.withColumn("go", F.coalesce(good, F.lit(False))).withColumns({"lo": F.when(F.col("go"), F.col("nlo")).otherwise(F.col("lo")), "hi": F.when(F.col("go"), F.col("nhi")).otherwise(F.col("hi"))}).drop("nlo", "nhi", "next")
    return seed.drop("go")


def without_overlaps(clips: DataFrame, top_k: int, least: float = 1.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """clips(qid, rank, file, start_s, end_s, and the columns to carry): clips under `least` seconds go first; then in rank order a clip stays unless it overlaps one that stayed in its file; then the first top_k, ranked anew."""
    order = F.array_sort(F.collect_list(F.struct("rank", "file", "start_s", "end_s", *carry)))
    long = clips.where(F.round(F.col("end_s") - F.col("start_s"), 6) >= least).groupBy("qid").agg(order.alias("c"))
    clash = lambda k, x: (k["file"] == x["file"]) & (x["start_s"] < k["end_s"]) & (k["start_s"] < x["end_s"])
    kept = F.aggregate("c", F.slice("c", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: clash(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return long.select("qid", F.posexplode(F.slice(kept, 1, top_k)).alias("place", "x")).select("qid", (F.col("place") + 1).cast("long").alias("new_rank"), F.col("x.rank").cast("long").alias("rank"), F.col("x.file").alias("file"), F.col("x.start_s").alias("start_s"), F.col("x.end_s").alias("end_s"), *[F.col(f"x.{c}").alias(c) for c in carry])


def keyword_clips(clips: DataFrame) -> DataFrame:
    """clips(id, query, words array<struct<word,start_s,end_s>>) -> matched positions, and the clip around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = []
            for i, q, words in zip(b.column("id").to_pylist(), b.column("query").to_pylist(), b.column("words").to_pylist(), strict=True):
                w = [(x["word"], x["start_s"], x["end_s"]) for x in words or []]
                clip = T.tightened(w, q or "")
                out.append((i, sorted(T.keyword_positions([x[0] for x in w], q or "")), w[clip[0]][1] if clip else None, w[clip[1]][2] if clip else None))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.float64()))], ["id", "matched", "start_s", "end_s"])

    return clips.select("id", "query", "words").mapInArrow(run, "id long, matched array<long>, start_s double, end_s double")


def rendered(spans: DataFrame, padding: float) -> DataFrame:
    """spans(s array<struct<place,start_s,end_s,score,eligible,text,words>>, best, lo, hi, query, tight, matched_by, ...) -> with start_s, end_s, text and html in place of s, best, lo, hi, query and tight.

    A tight span with words narrows to those that match the query and `padding` seconds around them, and its html marks them; others keep their sentences, whose stems
    are marked. The best sentence is set off unless words alone matched.
    """
    used = ("s", "best", "lo", "hi", "query", "tight")
    kept = [f for f in spans.schema if f.name not in used]

    def one(r: dict) -> tuple:
        span, query, meant = r["s"][r["lo"] : r["hi"] + 1], r["query"], r["matched_by"] != "words"
        best = r["best"] - r["lo"]
        words = [(w["word"], w["start_s"], w["end_s"], i == best) for i, x in enumerate(span) for w in x["words"] or ()]
        clip = T.tightened([w[:3] for w in words], query, padding) if r["tight"] and words else None
        if clip is None:
            texts = [x["text"] for x in span]
            return span[0]["start_s"], span[-1]["end_s"], " ".join(texts), T.highlight(texts, query, best, meant)
        low, high = clip
        part = words[low : high + 1]
        hit = {i - low for i in T.keyword_positions([w[0] for w in words], query) if low <= i <= high}
        return part[0][1], part[-1][2], " ".join(w[0] for w in part), T.clip_html([w[0] for w in part], hit, [w[3] for w in part], meant)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = [one(r) for r in b.select(["matched_by", *used]).to_pylist()]
            new = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.float64(), pa.float64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *new], [*(f.name for f in kept), "start_s", "end_s", "text", "html"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return spans.mapInArrow(run, f"{fields}, start_s double, end_s double, text string, html string")


@F.udf(DoubleType(), useArrow=True)
def word_similarity(query: str, text: str) -> float:
    return T.word_similarity(query or "", text or "")


@F.udf(StringType(), useArrow=True)
def marked(text: str, query: str) -> str:
    return T.marked(text or "", query or "")


@F.udf(DoubleType(), useArrow=True)
def cover_density(text: str, query: str) -> float:
    return T.cover_density(text or "", query or "")
