"""Transcript dataflow: timed words, speaker assignment, smoothing, turns, interpolation, lookups by time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import expressions as X

PAUSE, SMOOTH_GAP, SHORT_TURN = 1.5, 0.4, 0.8
BUCKET = 30.0
# Makes halves of a millisecond round up whatever the last bits of a sum are.
HALF = 1e-9


def timed_words(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) -> words(conv_id, pos, turn, role, word, start_s, end_s), one every 0.4 s and 0.35 s long,
    with a pause of 1 s after a sentence end and of 2 s before each turn. Times are whole milliseconds before division."""
    split = turns.where("text IS NOT NULL").select("conv_id", "turn", "role", F.posexplode(F.split(F.btrim("text"), r"[ \t\n\r]+")).alias("at", "word")).where("word <> ''")
    order = Window.partitionBy("conv_id").orderBy("turn", "at")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = F.coalesce(F.sum(F.col("word").rlike("[.?!]$").cast("long")).over(before), F.lit(0))
    pos = F.row_number().over(order).cast("long") - 1
    changes = F.coalesce(F.sum((F.col("at") == 0).cast("long")).over(order), F.lit(0)) - 1
    start = pos * 400 + ends * 1000 + changes * 2000
    return split.select("conv_id", pos.alias("pos"), "turn", "role", "word", (start / 1000.0).alias("start_s"), ((start + 350) / 1000.0).alias("end_s"))


def clean_words(words: DataFrame) -> DataFrame:
    """Trimmed words with times rounded to milliseconds; a confidence stays null where it is missing."""
    out = words.withColumns({"word": F.btrim("word"), "start_s": F.round("start_s", 3), "end_s": F.round("end_s", 3)})
    return out.withColumn("confidence", F.round("confidence", 3)) if "confidence" in words.columns else out


def _buckets(start, end):
    return F.explode(F.sequence(F.floor(start / BUCKET), F.floor(F.greatest(start, end) / BUCKET)))


def assign_speakers(words: DataFrame, intervals: DataFrame) -> DataFrame:
    """words(conv_id, pos, word, start_s, end_s), intervals(conv_id, place, speaker, start, end) -> words with speaker.

    The speaker with more than half of a word's duration wins (the greatest total, the earliest interval among equal ones); other
    words take the interval at the least distance, the first of equal ones. Overlaps meet by recording and
    time bucket, so a long recording isn't compared with itself whole; words without a majority take the first interval that they meet or touch, else the nearer one of the last
    before and the first after them, which running windows know.
    """
    w = words.withColumn("bucket", _buckets(F.col("start_s"), F.col("end_s")))
    iv = intervals.withColumn("bucket", _buckets(F.col("start"), F.col("end")))
    shared = X.overlap(F.col("start_s"), F.col("end_s"), F.col("start"), F.col("end"))
    first_bucket = F.col("bucket") == F.greatest(F.floor(F.col("start_s") / BUCKET), F.floor(F.col("start") / BUCKET))
    met = w.join(iv, ["conv_id", "bucket"]).where((F.col("start") < F.col("end_s")) & (F.col("start_s") < F.col("end")) & first_bucket)
    totals = met.groupBy("conv_id", "pos", "start_s", "end_s", "speaker").agg(F.sum(shared).alias("shared"), F.min("place").alias("place"))
    best = totals.groupBy("conv_id", "pos", "start_s", "end_s").agg(F.max_by("speaker", F.struct("shared", (-F.col("place")).alias("p"))).alias("speaker"), F.max("shared").alias("shared"))
    major = best.where(F.col("shared") / F.greatest(F.col("end_s") - F.col("start_s"), F.lit(0.001)) > 0.5).select("conv_id", "pos", "speaker")
    others = words.join(major, ["conv_id", "pos"], "left_anti").select("conv_id", "pos", "start_s", "end_s")
    touch = others.withColumn("bucket", _buckets(F.col("start_s"), F.col("end_s"))).join(iv, ["conv_id", "bucket"]).where((F.col("start") <= F.col("end_s")) & (F.col("start_s") <= F.col("end")))
    at_hand = touch.select("conv_id", "pos", F.lit(0.0).alias("d"), "place", "speaker")
    edge = lambda there, sign: F.struct((sign * F.col(there)).alias("edge"), F.col("place").alias("place"), F.col("speaker").alias("speaker"))
    marks = lambda there, here, sign: intervals.select("conv_id", F.lit(None).cast("long").alias("pos"), (sign * F.col(there)).alias("t"), edge(there, -sign).alias("edge")).unionByName(others.select("conv_id", "pos", (sign * F.col(here)).alias("t"), F.lit(None).alias("edge")))

    def beside(there: str, here: str, sign: int) -> DataFrame:
        """The interval whose edge is the last one not after a word's, in the direction of sign."""
        passed = Window.partitionBy("conv_id").orderBy("t", F.col("pos").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        near = marks(there, here, sign).withColumn("near", F.min("edge").over(passed)).where("pos IS NOT NULL AND near IS NOT NULL")
        return near.select("conv_id", "pos", (F.col("t") + F.col("near.edge")).alias("d"), F.col("near.place").alias("place"), F.col("near.speaker").alias("speaker"))

    every = at_hand.unionByName(beside("end", "start_s", 1)).unionByName(beside("start", "end_s", -1))
    nearest = every.groupBy("conv_id", "pos").agg(F.min_by("speaker", F.struct("d", "place")).alias("speaker"))
    return words.join(major.unionByName(nearest), ["conv_id", "pos"], "left")


def smooth_isolated(assigned: DataFrame) -> DataFrame:
    """A word between two of another, equal speaker takes that speaker when both gaps are under 0.4 s and it is no back-channel; judged on the speakers as given."""
    order = Window.partitionBy("conv_id").orderBy("pos")
    before, after = F.lag("speaker").over(order), F.lead("speaker").over(order)
    near = (F.col("start_s") - F.lag("end_s").over(order) < SMOOTH_GAP) & (F.lead("start_s").over(order) - F.col("end_s") < SMOOTH_GAP)
    change = (before == after) & (F.col("speaker") != before) & ~X.is_backchannel(F.col("word")) & near
    return assigned.withColumn("speaker", F.when(change, before).otherwise(F.col("speaker")))


def sessionize(assigned: DataFrame, pause: float = PAUSE) -> DataFrame:
    """Words with speaker -> turns: a new one on a change of speaker, else on a pause over `pause`; each has the reason why it ends."""
    order = Window.partitionBy("conv_id").orderBy("pos")
    before = F.lag("speaker").over(order)
    reason = F.when(before.isNotNull() & (F.col("speaker") != before), "speaker_change").when(before.isNotNull() & (F.col("start_s") - F.lag("end_s").over(order) > pause), "pause")
    marked = assigned.withColumn("reason", reason)
    numbered = marked.withColumn("turn_id", F.sum(F.col("reason").isNotNull().cast("long")).over(order) + 1)
    sorted_words = F.array_sort(F.collect_list(F.struct("pos", "word")))
    text = F.btrim(F.array_join(F.transform(sorted_words, lambda w: w["word"]), " "))
    turns = numbered.groupBy("conv_id", "turn_id").agg(F.min_by("speaker", "pos").alias("speaker"), F.min("start_s").alias("start"), F.max_by("end_s", "pos").alias("end"), text.alias("text"), F.count(F.lit(1)).alias("n_words"), F.min_by("reason", "pos").alias("began"))
    ended = F.coalesce(F.lead("began").over(Window.partitionBy("conv_id").orderBy("turn_id")), F.lit("end_of_audio"))
    short = (F.col("end") - F.col("start") < SHORT_TURN) & X.is_backchannel(F.col("text"))
    return turns.select("conv_id", "turn_id", "speaker", F.round("start", 3).alias("start_s"), F.round("end", 3).alias("end_s"), ended.alias("split_reason"), short.alias("is_short_turn"), "text", "n_words")


def interpolate(words: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """words(conv_id, turn, pos, word, start_s?, end_s?) -> with times for all: a run of words without both times is spread evenly between the end before it and the start
    after it (the turn's bounds at its ends), each at least 0.05 s long. timing_source tells which were given."""
    timed = F.col("start_s").isNotNull() & F.col("end_s").isNotNull()
    order = Window.partitionBy("conv_id", "turn").orderBy("pos")
    upto, onward = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    w = words if bounds is None else words.join(bounds, ["conv_id", "turn"])
    w = w.withColumn("timed", timed).withColumn("island", F.sum(timed.cast("long")).over(upto))
    w = w.withColumns({"from": F.coalesce(F.last(F.when(timed, F.round("end_s", 3)), ignorenulls=True).over(upto), F.col("bound_start")), "to": F.coalesce(F.first(F.when(timed, F.col("start_s")), ignorenulls=True).over(onward), F.col("bound_end"))})
    run = Window.partitionBy("conv_id", "turn", "island", "timed")
    place, n = F.row_number().over(run.orderBy("pos")) - 1, F.count(F.lit(1)).over(run)
    step = F.greatest(F.lit(0.0), (F.col("to") - F.col("from")) / n)
    start = F.when(F.col("timed"), F.col("start_s")).otherwise(F.col("from") + place * step)
    end = F.when(F.col("timed"), F.col("end_s")).otherwise(F.col("from") + place * step + F.greatest(step, F.lit(0.05)))
    source = F.when(F.col("timed"), "wav2vec2_aligned").otherwise("interpolated_fallback")
    return w.select("conv_id", "turn", "pos", "word", F.round(start + HALF, 3).alias("start_s"), F.round(end + HALF, 3).alias("end_s"), source.alias("timing_source"))


def turn_bounds(words: DataFrame) -> DataFrame:
    return words.groupBy("conv_id", "turn").agg(F.min("start_s").alias("bound_start"), F.max("end_s").alias("bound_end"))


def telemetry(interpolated: DataFrame) -> DataFrame:
    """Word counts for each recording and the rate of interpolated words, rounded to 4 digits."""
    fallback = F.count_if(F.col("timing_source") == "interpolated_fallback")
    total = F.count(F.lit(1))
    return interpolated.groupBy("conv_id").agg(total.alias("total_words"), fallback.alias("fallback_words"), F.round(fallback / total, 4).alias("fallback_rate"))


def speaking_time(turns: DataFrame, speakers: DataFrame) -> DataFrame:
    """speakers(conv_id, speaker) left-joined with their turns' total duration, rounded to 0.1 s; silent speakers have 0."""
    spoken = turns.groupBy("conv_id", "speaker").agg(F.sum(F.col("end_s") - F.col("start_s")).alias("s"))
    return speakers.join(spoken, ["conv_id", "speaker"], "left").select("conv_id", "speaker", F.round(F.round(F.coalesce("s", F.lit(0.0)), 3), 1).alias("seconds"))


def speaker_labels(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("speaker")), ",").alias("labels"))


def turn_at(times: DataFrame, turns: DataFrame) -> DataFrame:
    """times(conv_id, t) as of turns: the first started turn that still plays, else the last started, else turn 0."""
    began = F.struct(F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"), "turn_id")
    marks = turns.select("conv_id", F.col("start_s").cast("double").alias("at"), began.alias("turn")).unionByName(times.select("conv_id", F.col("t").cast("double").alias("at"), F.lit(None).alias("turn")))
    upto = Window.partitionBy("conv_id").orderBy("at", F.col("turn").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("turn").isNotNull(), F.struct("turn.start_s", "turn.turn_id"))).over(upto)
    when = F.when(F.col("turn").isNull(), F.array(F.floor(F.col("at") / BUCKET))).otherwise(F.sequence(F.floor(F.col("turn.start_s") / BUCKET), F.floor(F.greatest("turn.start_s", "turn.end_s") / BUCKET)))
    # a time and the turns that may play then meet in its bucket
    spread = marks.repartition("conv_id").withColumn("last", last).select("conv_id", "at", "turn", F.col("last.turn_id").alias("last"), F.explode(when).alias("bucket"))
    asked = F.collect_set(F.when(F.col("turn").isNull(), F.struct(F.col("at").alias("t"), "last")))
    met = spread.groupBy("conv_id", "bucket").agg(F.collect_list("turn").alias("turns"), asked.alias("asked")).select("conv_id", "turns", F.explode("asked").alias("a"))
    playing = F.array_min(F.transform(F.filter("turns", lambda x: (x["start_s"] <= F.col("a.t")) & (F.col("a.t") < x["end_s"])), lambda x: x["turn_id"]))
    return met.select("conv_id", F.col("a.t").alias("t"), F.coalesce(playing, F.col("a.last"), F.lit(0)).alias("turn_id"))


def clip_to_turn(clips: DataFrame, turns: DataFrame) -> DataFrame:
    """clips(conv_id, clip_id, clip_start, clip_end, speaker) -> the turn with most overlap, then of the same speaker, then the first."""
    t = turns.select("conv_id", "turn_id", F.col("speaker").alias("turn_speaker"), "start_s", "end_s", _buckets(F.col("start_s"), F.col("end_s")).alias("bucket"))
    shared = F.round(X.overlap(F.col("clip_start"), F.col("clip_end"), F.col("start_s"), F.col("end_s")), 6)
    rank = F.struct(shared.alias("shared"), (F.col("turn_speaker") == F.col("speaker")).alias("same"), (-F.col("turn_id")).alias("p"))
    met = clips.withColumn("bucket", _buckets(F.col("clip_start"), F.col("clip_end"))).join(t, ["conv_id", "bucket"]).where(shared > 0)
    most = met.groupBy("conv_id", "clip_id").agg(F.max_by("turn_id", rank).alias("turn_id"))
    # clips that no turn overlaps: the first turn of their speaker, else the first
    rest = clips.join(most, ["conv_id", "clip_id"], "left_anti")
    own = turns.groupBy("conv_id", "speaker").agg(F.min("turn_id").alias("own"))
    any_ = turns.groupBy("conv_id").agg(F.min("turn_id").alias("first"))
    other = rest.join(any_, "conv_id").join(own, ["conv_id", "speaker"], "left").select("conv_id", "clip_id", F.coalesce("own", "first").alias("turn_id"))
    return most.unionByName(other)


def context(turns: DataFrame) -> DataFrame:
    """Each turn with the text lengths of the turns before and after it."""
    order = Window.partitionBy("conv_id").orderBy("turn_id")
    return turns.select("conv_id", "turn_id", F.lag("turn_id").over(order).alias("previous_turn"), F.lead("turn_id").over(order).alias("next_turn"), F.lag("n_words").over(order).alias("previous_words"), F.lead("n_words").over(order).alias("next_words"))


def speaker_samples(turns: DataFrame, slices: int = 3, least: float = 1.0) -> DataFrame:
    """Up to `slices` sample turns for each speaker: the longest of each equal slice of the recording, then the longest remaining, in order of time."""
    long = turns.where(~F.col("is_short_turn") & (F.col("n_words") > 0) & (F.round(F.col("end_s") - F.col("start_s"), 6) >= least))
    whole = Window.partitionBy("conv_id")
    slot = F.least(F.floor(F.col("start_s") / F.max("end_s").over(whole) * slices), F.lit(slices - 1)).cast("int")
    length = F.round(F.col("end_s") - F.col("start_s"), 6)
    spot = long.withColumn("length", length).withColumn("slot", slot)
    in_slot = F.row_number().over(Window.partitionBy("conv_id", "speaker", "slot").orderBy(F.desc("length"), "turn_id"))
    ranked = spot.withColumn("later", (in_slot > 1).cast("int"))
    place = F.row_number().over(Window.partitionBy("conv_id", "speaker").orderBy("later", F.desc("length"), "turn_id"))
    return ranked.withColumn("place", place).where(F.col("place") <= slices).select("conv_id", "speaker", "turn_id", "slot", "length")


def wildcard_words(words: DataFrame, alphabet: str = "abcdefghijklmnopqrstuvwxyz'") -> DataFrame:
    """Words that have letters, none of which the aligner knows."""
    letters = F.lower(F.col("word"))
    return words.where(letters.rlike(r"\p{L}") & ~letters.rlike(f"[{alphabet}]")).select("conv_id", "pos", "word")


def segment_words(segments: DataFrame) -> DataFrame:
    """segments(conv_id, turn, text, start_s, end_s, words array<struct<word,start_s,end_s>>) -> (conv_id, turn, pos, word, start_s, end_s, bound_start, bound_end): a segment's words, or, where the aligner gave none, the
    words of its text without times, for interpolate to spread."""
    empty = F.transform(F.filter(F.split(F.btrim("text"), r"\s+"), lambda w: w != ""), lambda w: F.struct(w.alias("word"), F.lit(None).cast("double").alias("start_s"), F.lit(None).cast("double").alias("end_s")))
    words = F.when(F.size("words") > 0, F.transform("words", lambda w: F.struct(w["word"].alias("word"), w["start_s"].alias("start_s"), w["end_s"].alias("end_s")))).otherwise(empty)
    flat = segments.select("conv_id", "turn", F.col("start_s").alias("bound_start"), F.col("end_s").alias("bound_end"), F.posexplode(words).alias("pos", "w"))
    return flat.select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), "w.word", "w.start_s", "w.end_s", "bound_start", "bound_end")


def sample_windows(turns: DataFrame, per_speaker: int = 3, least: float = 4.0, most: float = 15.0, fallback: float = 1.0) -> DataFrame:
    """turns(conv_id, turn_id, speaker, is_short_turn, words array<struct<word,start_s,end_s,confidence>>) -> sample windows of each speaker: a turn's words until `most` seconds from its start (one
    at least), with their mean confidence (0 without any). Windows of `least` seconds count; where a speaker has fewer than per_speaker of them, the longest shorter ones
    of `fallback` seconds come too."""
    begin = F.get("words", F.lit(0))["start_s"]
    fitting = F.filter("words", lambda w: w["end_s"] - begin <= most)
    picked = turns.where(~F.col("is_short_turn") & (F.size("words") > 0)).withColumn("picked", F.when(F.size(fitting) > 0, fitting).otherwise(F.slice("words", 1, 1)))
    known = F.filter(F.transform("picked", lambda w: w["confidence"].cast("double")), lambda c: c.isNotNull())
    mean = F.coalesce(F.try_divide(F.aggregate(known, F.lit(0.0), lambda t, c: t + c), F.size(known)), F.lit(0.0))
    window = picked.select("conv_id", "speaker", "turn_id", F.round(begin, 3).alias("start_s"), F.round(F.element_at("picked", -1)["end_s"], 3).alias("end_s"), F.array_join(F.transform("picked", lambda w: w["word"]), " ").alias("text"), F.round(mean, 6).alias("score"))
    length = F.round(F.col("end_s") - F.col("start_s"), 6)
    own = Window.partitionBy("conv_id", "speaker")
    sized = window.withColumn("full", length >= least).where(length >= fallback).withColumn("n_full", F.count_if(F.col("full")).over(own))
    place = F.row_number().over(own.orderBy(F.desc("full"), F.desc(F.when(~F.col("full"), length)), "turn_id"))
    return sized.withColumn("place", place).where(F.col("full") | (F.col("place") <= per_speaker)).drop("full", "n_full", "place")


def shaded(words: Column, start: Column, end: Column) -> Column:
    """HTML of words (an array of structs word, start_s, end_s): signs escaped, runs that a clip overlaps in <span class="clip">; a word that only touches the clip isn't in it. A word looks at those beside it
    only; words must be a column, since an expression would be computed for each of them."""
    escaped = lambda w: F.replace(F.replace(F.replace(F.replace(F.replace(w, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    inside = lambda w: F.coalesce((w["start_s"] < end) & (start < w["end_s"]), F.lit(False))
    at = lambda i: inside(F.get(words, i))
    piece = lambda w, i: F.concat(F.when(inside(w) & ~at(i - 1), '<span class="clip">').otherwise(""), escaped(w["word"]), F.when(inside(w) & ~at(i + 1), "</span>").otherwise(""))
    return F.array_join(F.transform(words, piece), " ")
