"""Evaluation: moment matching, recall and reciprocal rank, near misses, bootstrap intervals, transcript quality, data rules."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions import expressions as X
from parley.functions import text as T
from parley.functions.arrow import pieces

BUCKET = 30.0


def moment_hits(results: DataFrame, moments: DataFrame) -> DataFrame:
    """results(qid, file, speaker, start_s, end_s, rank), moments(qid, moment, file, speaker?, start_s, end_s) -> (qid, moment, first rank that hits, or null).
    Alternatives of a moment are rows with its number."""
    r = results.select("qid", "file", F.col("speaker").alias("r_speaker"), F.col("start_s").alias("r_start"), F.col("end_s").alias("r_end"), "rank")
    hit = X.strict_match(F.col("r_start"), F.col("r_end"), F.col("start_s"), F.col("end_s")) & (F.col("speaker").isNull() | (F.col("speaker") == F.col("r_speaker")))
    return moments.join(r, ["qid", "file"], "left").groupBy("qid", "moment").agg(F.min(F.when(hit, F.col("rank"))).alias("rank"))


def recall(hits: DataFrame, any_of: Column | None = None) -> DataFrame:
    """Recall at 1, 3, 5 and the reciprocal rank of the first hit for each query; any_of marks queries for which one hit is all."""
    any_ = F.max(any_of.cast("int")) == 1 if any_of is not None else F.lit(False)
    at = lambda k: F.when(any_, F.max(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0)))).otherwise(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))))
    return hits.groupBy("qid").agg(*[F.round(at(k), 6).alias(f"recall_{k}") for k in (1, 3, 5)], F.round(F.coalesce(1.0 / F.min("rank"), F.lit(0.0)), 6).alias("mrr"))


def near_miss(results: DataFrame, negatives: DataFrame, recalls: DataFrame) -> DataFrame:
    """Whether the first result is no hard negative (file and interval; the speaker doesn't matter) and something is found by rank 5."""
    top = results.where("rank = 1").select("qid", "file", F.col("start_s").alias("r_start"), F.col("end_s").alias("r_end"))
    hit = X.strict_match(F.col("r_start"), F.col("r_end"), F.col("start_s"), F.col("end_s"))
    bad = top.join(negatives, ["qid", "file"]).where(hit).select("qid").distinct().withColumn("bad", F.lit(True))
    return recalls.join(bad, "qid", "left").select("qid", (F.col("bad").isNull() & (F.col("recall_5") > 0)).alias("rejected"))


def macro(per_query: DataFrame, by: list[str]) -> DataFrame:
    """Means by category and over all (rollup)."""
    return per_query.rollup(*by).agg(F.count(F.lit(1)).alias("n_queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall_1", "recall_3", "recall_5", "mrr")])


def micro(hits: DataFrame) -> DataFrame:
    found = lambda k: F.round(F.count_if(F.col("rank") <= k) / F.count(F.lit(1)), 6)
    return hits.agg(F.count(F.lit(1)).alias("n_moments"), *[found(k).alias(f"micro_{k}") for k in (1, 3, 5)])


def gate(by_mode: dict[str, dict[str, float]]) -> bool:
    """Hybrid recall at 5 of 0.85 and at 1 of 0.60, and above both ablations at 5; numbers must be finite."""
    hybrid, others = by_mode["hybrid"], [by_mode["lexical"], by_mode["dense"]]
    finite = all(v == v and abs(v) != float("inf") for m in by_mode.values() for v in m.values())
    return finite and hybrid["recall_5"] >= 0.85 and hybrid["recall_1"] >= 0.60 and all(hybrid["recall_5"] > o["recall_5"] for o in others)


def bootstrap(per_query: DataFrame, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """per_query(measure, qid, weight, found): 95 % interval of weighted recall by resampling whole queries, for each measure; a measure's queries are one small group."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("qid").to_pylist(), group.column("weight").to_pylist(), group.column("found").to_pylist(), strict=True))
        r, n, sums = random.Random(seed), len(rows), []
        for _ in range(draws):
            picks = r.choices(rows, k=n)
            weight = sum(w for _, w, _ in picks)
            sums.append(sum(f for _, _, f in picks) / weight if weight else 0.0)
        sums.sort()
        whole = sum(w for _, w, _ in rows)
        return pa.table({"measure": group.column("measure")[:1], "recall": [sum(f for _, _, f in rows) / whole if whole else 0.0], "low": [sums[int(0.025 * draws)]], "high": [sums[int(0.975 * draws) - 1]]})

    return per_query.groupBy("measure").applyInArrow(run, "measure string, recall double, low double, high double")


def overlap_matrix(a: DataFrame, b: DataFrame) -> DataFrame:
    """Seconds that each pair of speakers of two turn tables(file, speaker, start_s, end_s) shares."""
    buckets = lambda x, y: F.explode(F.sequence(F.floor(F.col(x) / BUCKET), F.floor(F.greatest(x, y) / BUCKET)))
    left = a.withColumn("bucket", buckets("start_s", "end_s"))
    right = b.select("file", F.col("speaker").alias("other"), F.col("start_s").alias("o_start"), F.col("end_s").alias("o_end")).withColumn("bucket", buckets("o_start", "o_end"))
    first = F.col("bucket") == F.floor(F.greatest("start_s", "o_start") / BUCKET)  # a pair counts in the first bucket that both are in
    met = left.join(right, ["file", "bucket"]).where((F.col("start_s") < F.col("o_end")) & (F.col("o_start") < F.col("end_s")) & first)
    return met.groupBy("file", "speaker", "other").agg(F.round(F.sum(X.overlap(F.col("start_s"), F.col("end_s"), F.col("o_start"), F.col("o_end"))), 3).alias("seconds"))


def best_assignment(gain: list[list[int]]) -> list[int]:
    """The column of each row (no more rows than columns) with the greatest total gain, all columns different; of equal totals the first in order of columns.

    Shortest augmenting paths with potentials; a row's place in the order is a fraction of the least difference of gains, in whole numbers.
    """
    n, m = len(gain), len(gain[0]) if gain else 0
    cost = [[-g * (m + 1) ** n + j * (m + 1) ** (n - 1 - i) for j, g in enumerate(row)] for i, row in enumerate(gain)]
    u, v, row_of = [0] * (n + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        row_of[0], at = i, 0
        least: list[int | None] = [None] * (m + 1)
        back, done = [0] * (m + 1), [False] * (m + 1)
        while row_of[at]:
            done[at], row, step, to = True, row_of[at], None, 0
            for j in range(1, m + 1):
                if done[j]:
                    continue
                here = cost[row - 1][j - 1] - u[row] - v[j]
                if least[j] is None or here < least[j]:
                    least[j], back[j] = here, at
                if step is None or least[j] < step:
                    step, to = least[j], j
            for j in range(m + 1):
                if done[j]:
                    u[row_of[j]] += step
                    v[j] -= step
                elif least[j] is not None:
                    least[j] -= step
            at = to
        while at:
            row_of[at] = row_of[back[at]]
            at = back[at]
    return [j - 1 for _, j in sorted((row_of[j], j) for j in range(1, m + 1) if row_of[j])]


def speaker_mapping(matrix: DataFrame) -> DataFrame:
    """matrix(file, speaker, other, seconds) -> the assignment of hypothesis speakers to reference ones with the greatest total overlap, in whole milliseconds; with
    fewer references each takes its best (the first of equal ones). One file's speakers are one small group."""

    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        shared = {(r["speaker"], r["other"]): round(1000 * r["seconds"]) for r in rows}
        hyps, refs = sorted({r["speaker"] for r in rows}), sorted({r["other"] for r in rows})
        gain = [[shared.get((h, o), 0) for o in refs] for h in hyps]
        pick = [g.index(max(g)) for g in gain] if len(refs) < len(hyps) else best_assignment(gain)
        return pa.table({"file": group.column("file")[:1].to_pylist() * len(hyps), "speaker": hyps, "mapped": [refs[j] for j in pick]}, schema=pa.schema([("file", group.schema.field("file").type), ("speaker", pa.string()), ("mapped", pa.string())]))

    kind = matrix.schema["file"].dataType.simpleString()
    return matrix.groupBy("file").applyInArrow(run, f"file {kind}, speaker string, mapped string")


def diarization_error(reference: DataFrame, hypothesis: DataFrame, collar: float = 0.0) -> DataFrame:
    """(file, speaker, start_s, end_s) twice, speakers already mapped -> missed, false alarm and confusion seconds by a sweep over all boundaries; half a collar around reference boundaries is left out.

    Each file's boundaries meet in one task, sorted and summed as they go: how often a speaker is heard on either side by then, from that how many speakers are, and in how many collars it is.
    """
    edge = lambda t, r, h, c: F.struct(t.cast("double").alias("t"), r.cast("int").alias("r"), h.cast("int").alias("h"), F.lit(c).alias("c"))
    none = F.lit(0)

    def edges(d: DataFrame, sides: Callable[[Column], tuple[Column, Column]], around: float) -> DataFrame:
        held = F.coalesce((F.col("end_s") > F.col("start_s")).cast("int"), none)  # a turn without length is no one's, but its times are boundaries
        rows = [edge(F.col("start_s"), *sides(held), 0), edge(F.col("end_s"), *sides(-held), 0)]
        rows += [edge(F.col(t) + s * around / 2, none, none, s * -1) for t in ("start_s", "end_s") for s in (-1, 1)] if around else []
        return d.select("file", "speaker", F.inline(F.array(*rows)))

    every = edges(reference, lambda n: (n, none), collar).unionByName(edges(hypothesis, lambda n: (none, n), 0.0)).where("t IS NOT NULL")
    own = Window.partitionBy("file", "speaker").orderBy("t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    each = every.repartition("file").select("file", "speaker", "t", "c", (F.sum("r").over(own) > 0).cast("int").alias("r"), (F.sum("h").over(own) > 0).cast("int").alias("h"))
    known = F.col("speaker").isNotNull().cast("int")
    before = Window.partitionBy("file", "speaker").orderBy("t")
    change = lambda c: c - F.coalesce(F.lag(c).over(before), none)
    changes = each.select("file", "t", "c", change(F.col("r")).alias("r"), change(F.col("h")).alias("h"), change(F.col("r") * F.col("h") * known).alias("ok"))
    upto = Window.partitionBy("file").orderBy("t")
    running = upto.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = changes.select("file", "t", F.lead("t").over(upto).alias("u"), *[F.sum(c).over(running).alias(n) for c, n in (("r", "nr"), ("h", "nh"), ("ok", "ok"), ("c", "near"))])
    heard = swept.where((F.col("u") > F.col("t")) & (F.col("nr") + F.col("nh") > 0) & (F.col("near") == 0))
    length = F.col("u") - F.col("t")
    total = lambda c: F.round(F.sum(length * c), 3)
    return heard.groupBy("file").agg(total(F.col("nr")).alias("spoken"), total(F.greatest(none, F.col("nr") - F.col("nh"))).alias("missed"), total(F.greatest(none, F.col("nh") - F.col("nr"))).alias("false_alarm"), total(F.least("nr", "nh") - F.col("ok")).alias("confusion"))


def diarization_rates(errors: DataFrame) -> DataFrame:
    """Errors in seconds -> shares of the spoken time, their sum (the error rate), and confusion against the time that was detected at all; 0 where nothing was spoken."""
    share = lambda c, of: F.round(F.coalesce(F.try_divide(c, of), F.lit(0.0)), 4)
    spoken, detected = F.nullif("spoken", F.lit(0.0)), F.when(F.col("spoken") > F.col("missed"), F.col("spoken") - F.col("missed"))
    parts = {f"{n}_rate": share(F.col(n), spoken) for n in ("missed", "false_alarm", "confusion")}
    return errors.select("file", share(F.col("missed") + F.col("false_alarm") + F.col("confusion"), spoken).alias("error_rate"), *[c.alias(n) for n, c in parts.items()], share(F.col("confusion"), detected).alias("attribution_error"))


def basic_text(text: Column) -> Column:
    """Lower case, signs as blanks, blanks collapsed."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


# What spoken English contracts, fillers, and names of products that recognisers write apart.
CONTRACTIONS = [("won't", "will not"), ("can't", "can not"), ("let's", "let us"), ("n't", " not"), ("'re", " are"), ("'ll", " will"), ("'ve", " have"), ("'m", " am"), ("'d", " would"), ("'s", " is")]
FILLERS = ["hmm", "mm", "mhm", "mmm", "uh", "um"]
COMPOUNDS = [("pg vector", "pgvector"), ("pg mustard", "pgmustard"), ("hypr land", "hyprland"), ("hyper land", "hyprland"), ("co wos", "cowos"), ("cap ex", "capex"), ("open ai", "openai")]


def english_text(text: Column) -> Column:
    """A text as a listener would write it, for error rates: without what is in brackets, fillers, and commas in numbers; contractions in full; compounds together. Numbers and spellings stay as they are."""
    out = F.regexp_replace(F.lower(text), "[’‘`]", "'")
    out = F.regexp_replace(F.regexp_replace(out, r"[<\[][^>\]]*[>\]]|\([^)]*\)", ""), rf"\b(?:{'|'.join(FILLERS)})\b", "")
    for short, full in CONTRACTIONS:
        out = F.regexp_replace(out, rf"{short}\b", full)
    out = basic_text(F.regexp_replace(out, r"(?<=[0-9]),(?=[0-9])", ""))
    for apart, name in COMPOUNDS:
        out = F.regexp_replace(out, rf"\b{apart.replace(' ', ' +')}\b", name)
    return out


def word_errors(pairs: DataFrame, normal=None) -> DataFrame:
    """pairs(id, reference, hypothesis) -> substitutions, deletions, insertions and the error rate of lower-case word tokens, or of the blank-separated words that normal(column) leaves."""
    if normal is not None:
        pairs = pairs.select("id", *[normal(F.col(c)).alias(c) for c in ("reference", "hypothesis")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = T.WORD.findall if normal is None else str.split
        for b in pieces(batches):
            out = []
            for i, r, h in zip(*(b.column(c).to_pylist() for c in ("id", "reference", "hypothesis")), strict=True):
                ref = words((r or "").lower())
                s, d, n = T.word_errors(ref, words((h or "").lower()))
                out.append((i, s, d, n, (s + d + n) / len(ref) if ref else 0.0))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.float64() if k == 4 else pa.int64()) for k in range(5)], ["id", "substitutions", "deletions", "insertions", "wer"])

    return pairs.select("id", "reference", "hypothesis").mapInArrow(run, "id long, substitutions long, deletions long, insertions long, wer double")


def speaker_words(turns: DataFrame) -> Column:
    """Aggregate: a file's tokens (with apostrophes) as structs of place, word and speaker, in order; turns(file, place, speaker, text)."""
    found = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"([\p{L}\p{N}_'’]+)"), F.lit(1))
    return F.array_sort(F.collect_list(F.struct("place", F.col("speaker").alias("speaker"), found.alias("words"))))


def speaker_accuracy(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """(file, place, speaker, text) twice, hypothesis speakers already mapped -> how many of the words that align have the right speaker, and how much of the reference aligns."""
    side = lambda d, name: d.groupBy("file").agg(speaker_words(d).alias(name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = []
            for file, ref, hyp in zip(*(b.column(c).to_pylist() for c in ("file", "ref", "hyp")), strict=True):
                r, h = ([(w, t["speaker"]) for t in side or () for w in t["words"]] for side in (ref, hyp))
                pairs = T.aligned_pairs([w for w, _ in r], [w for w, _ in h])
                right = sum(r[i][1] == h[j][1] for i, j in pairs)
                out.append((file, len(r), len(h), len(pairs), right, round(right / len(pairs), 4) if pairs else 0.0, round(len(pairs) / len(r), 4) if r else 0.0))
            kinds = (b.schema.field("file").type, *(pa.int64(),) * 4, *(pa.float64(),) * 2)
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], ["file", "n_reference", "n_hypothesis", "n_aligned", "n_right", "accuracy", "coverage"])

    both = side(reference, "ref").join(side(hypothesis, "hyp"), "file", "left")
    return both.mapInArrow(run, f"file {both.schema['file'].dataType.simpleString()}, n_reference long, n_hypothesis long, n_aligned long, n_right long, accuracy double, coverage double")


def assertion(queries: DataFrame, results: DataFrame, hits: DataFrame, negatives: DataFrame) -> DataFrame:
    """queries(qid, category), results and negatives as in near_miss, hits of moment_hits -> each query's score, whether it passes, and the first rule it fails: no results, a hard negative
    first, or no moment found. The score is the share of moments found; a multi_file query passes with all of them, others with one."""
    top = results.where("rank = 1").select("qid", "file", F.col("start_s").alias("r_start"), F.col("end_s").alias("r_end"))
    met = X.strict_match(F.col("r_start"), F.col("r_end"), F.col("start_s"), F.col("end_s"))
    bad = top.join(negatives, ["qid", "file"]).where(met).select("qid").distinct().withColumn("bad", F.lit(True))
    found = hits.groupBy("qid").agg(F.count("rank").alias("found"), F.count(F.lit(1)).alias("moments"), F.min("rank").alias("first"))
    joined = queries.join(top.select("qid", F.lit(True).alias("any")), "qid", "left").join(bad, "qid", "left").join(found, "qid", "left")
    n = F.coalesce("found", F.lit(0))
    rule = F.when(F.col("any").isNull(), "no_results").when(F.col("bad"), "near_miss").when(n == 0, "not_found")
    passed = rule.isNull() & ((F.col("category") != "multi_file") | (n == F.col("moments")))
    score = F.when(rule.isNull(), F.round(n / F.col("moments"), 6)).otherwise(0.0)
    return joined.select("qid", F.coalesce(passed, F.lit(False)).alias("passed"), score.alias("score"), rule.alias("rule"), F.when(rule.isNull(), F.col("first")).alias("first_rank"))


PUNCTUATION = ".,!?;:\"'“”‘’()[]…-–—"


def located(text: str, words: list[str]) -> list[tuple[int, int]] | None:
    """Character ranges of words that stand in a text in order, without their outer signs where only that is found; null if one isn't there."""
    out, at = [], 0
    for word in words:
        place = next(((p, w) for w in (word, word.strip(PUNCTUATION)) if w and (p := text.find(w, at)) >= 0), None)
        if place is None:
            return None
        at = place[0] + len(place[1])
        out.append((place[0], at))
    return out


def tightened(moments: DataFrame) -> DataFrame:
    """moments(id, text, matched_text, start_s, end_s, words array<struct<word,start_s,end_s>>): a turn's text, times and aligned words, and the words of it that a moment quotes
    -> id, start_s, end_s: the time of the quoted words, inside the turn, to a hundredth. Null where the quotation or a word isn't in the text, or no quoted word has times."""

    def span(row: dict) -> tuple[float, float] | None:
        text, quoted, words = row["text"] or "", row["matched_text"] or "", row["words"] or []
        low = text.find(quoted)
        ranges = located(text, [w["word"] for w in words]) if quoted and low >= 0 else None
        inside = [w for w, (a, b) in zip(words, ranges or (), strict=False) if a < low + len(quoted) and b > low]
        since, until = [w["start_s"] for w in inside if w["start_s"] is not None], [w["end_s"] for w in inside if w["end_s"] is not None]
        return (round(max(min(since), row["start_s"]), 2), round(min(max(until), row["end_s"]), 2)) if since and until else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = [span(r) or (None, None) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), *(pa.array([f[k] for f in found], pa.float64()) for k in (0, 1))], ["id", "start_s", "end_s"])

    return moments.select("id", "text", "matched_text", "start_s", "end_s", "words").mapInArrow(run, "id long, start_s double, end_s double")


def aligned(pairs: DataFrame) -> DataFrame:
    """pairs(id, reference, hypothesis) -> the number of aligned tokens and the share of the reference that they cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = []
            for i, r, h in zip(*(b.column(c).to_pylist() for c in ("id", "reference", "hypothesis")), strict=True):
                ref = T.WORD.findall((r or "").lower())
                n = len(T.aligned_pairs(ref, T.WORD.findall((h or "").lower())))
                out.append((i, n, n / len(ref) if ref else 0.0))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.float64() if k == 2 else pa.int64()) for k in range(3)], ["id", "n_aligned", "coverage"])

    return pairs.select("id", "reference", "hypothesis").mapInArrow(run, "id long, n_aligned long, coverage double")


def upper_median(costs: DataFrame, last: int = 5) -> DataFrame:
    """costs(stage, done_at, seconds) -> the upper median of each stage's last jobs."""
    order = Window.partitionBy("stage").orderBy(F.desc("done_at"), F.desc("job"))
    recent = costs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= last)
    values = F.array_sort(F.collect_list("seconds"))
    return recent.groupBy("stage").agg(values.alias("v")).select("stage", F.get("v", F.floor(F.size("v") / 2).cast("int")).alias("seconds"))


def normalized(text: Column) -> Column:
    """Lower case, letters, digits and blanks only, blanks collapsed: the key by which repeated queries are found."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N} \n\t]", ""), r"[ \n\t]+", " "))


def repeated(queries: DataFrame) -> DataFrame:
    """queries(split, qid, text) -> normalised texts that occur in more than one split."""
    return queries.select(normalized(F.col("text")).alias("key"), "split").where("key <> ''").groupBy("key").agg(F.count_distinct("split").alias("n_splits"), F.count(F.lit(1)).alias("n_queries")).where("n_splits > 1")


def continuity(turns: DataFrame) -> DataFrame:
    """turns(file, turn_id, start_s, end_s) -> rows that break a rule: ids in sequence, positive finite length, no start before the last end."""
    order = Window.partitionBy("file").orderBy("turn_id")
    rule = F.when(F.col("turn_id") != F.row_number().over(order), "sequence").when(F.isnan("start_s") | F.isnan("end_s") | (F.col("end_s") <= F.col("start_s")), "duration").when(F.col("start_s") < F.lag("end_s").over(order), "overlap")
    return turns.select("file", "turn_id", rule.alias("rule")).where("rule IS NOT NULL")
