"""Integrity rules of reference transcripts and query sets: each function gives a row for every rule that a row breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLACK = 0.05
# Categories of queries, and the bounds of short keyword queries.
CATEGORIES = ["single_file", "multi_file", "short_keyword"]
MOST_KEYWORD_WORDS, LEAST_KEYWORD_SECONDS = 3, 2.0


def broken(rows: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """A row (keys, rule) for each rule whose condition holds; unknown conditions count as not broken."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return rows.select(*keys, F.explode(found).alias("rule"))


def finite(*times: Column) -> Column:
    ok = F.lit(True)
    for t in times:
        ok = ok & t.isNotNull() & ~F.isnan(t) & (F.abs(t) != float("inf"))
    return F.coalesce(ok, F.lit(False))


def turn_rules(turns: DataFrame, speakers: DataFrame) -> DataFrame:
    """turns(file, turn_id, speaker, start_s, end_s, text), speakers(file, speaker) -> (file, turn_id, rule): ids are 1, 2, ...; times are finite, from 0 on, of positive length, and end where
    the next turn starts; the speaker is declared; there is text."""
    order = Window.partitionBy("file").orderBy("turn_id", "start_s")
    declared = speakers.select("file", "speaker").distinct().withColumn("declared", F.lit(True))
    t = turns.withColumns({"place": F.row_number().over(order), "next": F.lead("start_s").over(order)}).join(declared, ["file", "speaker"], "left")
    sound = finite(F.col("start_s"), F.col("end_s"))
    rules = {
        "sequence": ~F.col("turn_id").eqNullSafe(F.col("place").cast("long")),
        "finite": ~sound,
        "length": sound & ((F.col("start_s") < 0) | (F.col("end_s") <= F.col("start_s"))),
        "speaker": F.col("declared").isNull(),
        "text": F.coalesce(F.btrim("text"), F.lit("")) == "",
        "gap": sound & (F.col("next") != F.col("end_s")),
    }
    return broken(t, ["file", "turn_id"], rules)


def recording_rules(files: DataFrame, turns: DataFrame, speakers: DataFrame, audio: DataFrame, n_speakers: int = 2) -> DataFrame:
    """files(file, seconds), audio(file, seconds) -> (file, rule): there is audio of the declared length within a second, two declared speakers and some turns."""
    n = speakers.groupBy("file").agg(F.count_distinct("speaker").alias("n"))
    some = turns.select("file").distinct().withColumn("some", F.lit(True))
    heard = audio.select("file", F.col("seconds").alias("heard"))
    f = files.join(n, "file", "left").join(some, "file", "left").join(heard, "file", "left")
    rules = {"audio": F.col("heard").isNull(), "seconds": F.abs(F.col("seconds") - F.col("heard")) > 1.0, "speakers": F.coalesce("n", F.lit(0)) != n_speakers, "turns": F.col("some").isNull()}
    return broken(f, ["file"], rules)


def query_rules(queries: DataFrame, moments: DataFrame) -> DataFrame:
    """queries(qid, category, text, declared_files), moments(qid, file, alternative) -> (qid, rule): one id a query, a known category, some moments, as many files as declared and as the
    category has, and short keyword queries of three words at most. Alternatives aren't counted."""
    own = moments.where("NOT alternative").groupBy("qid").agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("moments"))
    times = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    q = queries.withColumn("times", times).join(own, "qid", "left").withColumn("files", F.coalesce("files", F.lit(0)))
    kind = F.col("category")
    rules = {
        "id": (F.coalesce("qid", F.lit("")) == "") | (F.col("times") > 1) if dict(queries.dtypes)["qid"] == "string" else F.col("qid").isNull() | (F.col("times") > 1),
        "category": ~F.coalesce(kind.isin(CATEGORIES), F.lit(False)),
        "moments": F.col("moments").isNull(),
        "declared_files": ~F.col("declared_files").eqNullSafe(F.col("files")),
        "single_file": (kind == "single_file") & (F.col("files") != 1),
        "multi_file": (kind == "multi_file") & (F.col("files") < 2),
        "keyword_words": (kind == "short_keyword") & (F.size(F.split(F.btrim("text"), r"\s+")) > MOST_KEYWORD_WORDS),
    }
    return broken(q, ["qid"], rules)


def moment_rules(moments: DataFrame, turns: DataFrame, verbatim: bool = True) -> DataFrame:
    """moments(qid, category, file, turn_id, speaker?, start_s, end_s, matched_text, alternative) against turns -> (qid, file, turn_id, rule): the file and the turn exist; the speaker is the turn's; times are finite, of
    positive length and inside the turn by SLACK; a keyword's own moment lasts two seconds; the quoted text stands in the turn word for word (not asked of hard negatives: verbatim false)."""
    t = turns.select("file", "turn_id", F.col("speaker").alias("t_speaker"), F.col("start_s").alias("t_start"), F.col("end_s").alias("t_end"), F.col("text").alias("t_text"), F.lit(True).alias("known"))
    files = turns.select("file").distinct().withColumn("heard", F.lit(True))
    m = moments.join(files, "file", "left").join(t, ["file", "turn_id"], "left")
    known, sound = F.col("known").isNotNull(), finite(F.col("start_s"), F.col("end_s"))
    length = F.col("end_s") - F.col("start_s")
    timed = known & sound & (length > 0)
    rules = {
        "file": F.col("heard").isNull(),
        "turn": F.col("heard").isNotNull() & ~known,
        "speaker": known & (F.coalesce("speaker", F.lit("")) != "") & (F.col("speaker") != F.col("t_speaker")),
        "finite": known & ~sound,
        "length": known & sound & (length <= 0),
        "outside": timed & ((F.col("start_s") < F.col("t_start") - SLACK) | (F.col("end_s") > F.col("t_end") + SLACK)),
    }
    if verbatim:
        quoted = F.coalesce(F.btrim("matched_text"), F.lit("")) != ""
        rules["keyword_seconds"] = timed & (F.col("category") == "short_keyword") & ~F.col("alternative") & (length < LEAST_KEYWORD_SECONDS)
        rules["quotation_empty"] = timed & ~quoted
        rules["quotation"] = timed & quoted & ~F.contains("t_text", "matched_text")
    return broken(m, ["qid", "file", "turn_id"], rules)


def split_rules(splits: DataFrame, queries: DataFrame, files: DataFrame, expected: DataFrame) -> DataFrame:
    """splits(split, declared, total, files), queries(split, qid, category), files(file), expected(split, category, n) -> (split, rule): the declared name, the number of queries and the files are
    the true ones, and so is the number of queries of each category."""
    n = queries.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    wanted = expected.withColumnRenamed("n", "wanted").join(queries.groupBy("split", "category").agg(F.count(F.lit(1)).alias("had")), ["split", "category"], "full")
    odd = wanted.groupBy("split").agg(F.bool_or(F.coalesce("wanted", F.lit(0)) != F.coalesce("had", F.lit(0))).alias("odd"), F.sum("wanted").alias("all"))
    there = files.agg(F.array_sort(F.collect_set("file")).alias("there"))
    s = splits.join(n, "split", "left").join(odd, "split", "left").crossJoin(F.broadcast(there)).withColumn("n", F.coalesce("n", F.lit(0)))
    rules = {"name": F.col("declared") != F.col("split"), "total": ~F.col("total").eqNullSafe(F.col("n")), "files": F.array_sort(F.array_distinct("files")) != F.col("there"), "breakdown": F.col("odd"), "expected": F.col("all") != F.col("n")}
    return broken(s, ["split"], rules)


def shared_turns(used: DataFrame, allowed: list[tuple[str, str]]) -> DataFrame:
    """used(split, file, turn_id) -> (file, turn_id, a, b): turns that two splits refer to, but for the pairs that may."""
    one = used.select("file", "turn_id", F.col("split").alias("a")).distinct()
    both = one.join(one.withColumnRenamed("a", "b"), ["file", "turn_id"]).where("a < b")
    for x, y in allowed:
        both = both.where(~((F.col("a") == min(x, y)) & (F.col("b") == max(x, y))))
    return both
