"""Queries of integrity rules, job states, speakers' names and transcript quality over the driver's tables, each with its SQL twin where SQL can express it. Importing this module adds them to the registry."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parley.operators import evaluate as E
from parley.operators import integrity, jobs, segment, transcript
from parley.plans import oracles as O
from parley.plans import search as S
from parley.plans.registry import EVALUATED, RECALLS, items, query, results_and_moments, turn_tables, turns_of, vectors, words_of
from parley.plans.session import spread, table

# Diarization


def der_sql(collar: str | None) -> str:
    """CTEs that end in der(file, spoken, missed, false_alarm, confusion)."""
    marks = f"mk2 AS (SELECT file, unnest([s, e]) AS c FROM r), ed AS (SELECT file, t FROM ev UNION SELECT file, unnest([c - {collar} / 2, c + {collar} / 2]) FROM mk2)," if collar else "ed AS (SELECT file, t FROM ev),"
    near = f"WHERE NOT EXISTS (SELECT 1 FROM mk2 m WHERE m.file = g.file AND (t + u) / 2 > c - {collar} / 2 AND (t + u) / 2 < c + {collar} / 2)" if collar else ""
    return f"""WITH {O.WORDS}, {O.TURNS}, {O.INTERVALS},
r AS (SELECT conv_id AS file, speaker, start_s AS s, end_s AS e FROM turns), h AS (SELECT conv_id AS file, speaker, istart AS s, iend AS e FROM iv),
ev AS (SELECT file, unnest([s, e]) AS t FROM r UNION SELECT file, unnest([s, e]) FROM h),
{marks}
g AS (SELECT * FROM (SELECT file, t, lead(t) OVER (PARTITION BY file ORDER BY t) AS u FROM ed) WHERE u > t),
gs AS (SELECT * FROM g {near}),
ra AS (SELECT DISTINCT gs.file, t, u, speaker FROM gs JOIN r ON r.file = gs.file AND s <= t AND e >= u), ha AS (SELECT DISTINCT gs.file, t, u, speaker FROM gs JOIN h ON h.file = gs.file AND s <= t AND e >= u),
b AS (SELECT coalesce(ra.file, ha.file) AS file, coalesce(ra.t, ha.t) AS t, coalesce(ra.u, ha.u) AS u, count(ra.speaker) AS nr, count(ha.speaker) AS nh, count(*) FILTER (ra.speaker IS NOT NULL AND ha.speaker IS NOT NULL) AS ok FROM ra FULL JOIN ha ON ra.file = ha.file AND ra.t = ha.t AND ra.u = ha.u AND ra.speaker = ha.speaker GROUP BY 1, 2, 3),
der AS (SELECT file, round(sum((u - t) * nr), 3) AS spoken, round(sum((u - t) * greatest(0, nr - nh)), 3) AS missed, round(sum((u - t) * greatest(0, nh - nr)), 3) AS false_alarm, round(sum((u - t) * (least(nr, nh) - ok)), 3) AS confusion FROM b GROUP BY file)"""


@query(f"{der_sql(None)} SELECT * FROM der")
def diarization_error(spark, sf):
    return E.diarization_error(*turn_tables(spark, sf))


@query(f"{der_sql('25e-2')} SELECT * FROM der")
def diarization_error_collar(spark, sf):
    return E.diarization_error(*turn_tables(spark, sf), collar=0.25)


@query(f"""{der_sql(None)} SELECT file, round(coalesce((missed + false_alarm + confusion) / nullif(spoken, 0), 0), 4) AS error_rate, round(coalesce(missed / nullif(spoken, 0), 0), 4) AS missed_rate, round(coalesce(false_alarm / nullif(spoken, 0), 0), 4) AS false_alarm_rate,
round(coalesce(confusion / nullif(spoken, 0), 0), 4) AS confusion_rate, round(CASE WHEN spoken > missed THEN confusion / (spoken - missed) ELSE 0e0 END, 4) AS attribution_error FROM der""")
def diarization_rates(spark, sf):
    return E.diarization_rates(E.diarization_error(*turn_tables(spark, sf)))


@query(f"""WITH RECURSIVE {O.WORDS}, {O.TURNS}, {O.INTERVALS},
ov AS (SELECT t.conv_id AS file, t.speaker, i.speaker AS other, round(1000 * round(sum(least(end_s, iend) - greatest(start_s, istart)), 3))::BIGINT AS ms FROM turns t JOIN iv i ON t.conv_id = i.conv_id AND start_s < iend AND istart < end_s GROUP BY ALL),
sides AS (SELECT file, list_sort(list(DISTINCT speaker)) AS hyps, list_sort(list(DISTINCT other)) AS refs FROM ov GROUP BY file),
rec AS (SELECT file, 1 AS k, []::VARCHAR[] AS picks, 0::BIGINT AS total FROM sides WHERE len(refs) >= len(hyps)
  UNION ALL SELECT x.file, x.k + 1, list_append(x.picks, x.other), x.total + coalesce(ov.ms, 0) FROM (SELECT rec.*, sides.hyps[rec.k] AS hyp, unnest(sides.refs) AS other FROM rec JOIN sides USING (file) WHERE rec.k <= len(sides.hyps)) x LEFT JOIN ov ON ov.file = x.file AND ov.speaker = x.hyp AND ov.other = x.other WHERE NOT list_contains(x.picks, x.other)),
full_ AS (SELECT rec.* FROM rec JOIN sides USING (file) WHERE k = len(hyps) + 1), best AS (SELECT file, picks FROM full_ QUALIFY row_number() OVER (PARTITION BY file ORDER BY total DESC, picks) = 1),
own AS (SELECT file, speaker, other FROM ov QUALIFY row_number() OVER (PARTITION BY file, speaker ORDER BY ms DESC, other) = 1)
SELECT file, unnest(hyps) AS speaker, unnest(picks) AS mapped FROM best JOIN sides USING (file) UNION ALL SELECT file, speaker, other FROM own WHERE file NOT IN (SELECT file FROM best)""")
def speaker_mapping(spark, sf):
    return E.speaker_mapping(E.overlap_matrix(*turn_tables(spark, sf)))


@query()
def word_error_rate_english(spark, sf):
    turns = spread(table(spark, sf, "conversations"), "conv_id", "turn")
    heard = F.regexp_replace(F.col("text"), r"\bis not\b", "isn't")
    return E.word_errors(turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("reference"), heard.alias("hypothesis")), E.english_text)


@query(r"SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM conversations")
def basic_text(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", E.basic_text(F.col("text")).alias("plain"))


@query()
def speaker_accuracy(spark, sf):
    """Each conversation's turns against themselves, every seventh turn given to another speaker and cut after 40 signs."""
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("file"), F.col("turn").alias("place"), F.col("role").alias("speaker"), "text")
    odd = F.col("place") % 7 == 3
    return E.speaker_accuracy(turns, turns.select("file", "place", F.when(odd, "other").otherwise(F.col("speaker")).alias("speaker"), F.when(odd, F.substring("text", 1, 40)).otherwise(F.col("text")).alias("text")))


# Assertions and quotations


@query(f"""{EVALUATED}, {RECALLS}, q AS (SELECT DISTINCT qid, CASE WHEN qid % 3 = 0 THEN 'multi_file' ELSE 'single_file' END AS category FROM mo),
an AS (SELECT DISTINCT qid FROM rs WHERE rank = 1), bd AS (SELECT DISTINCT qid FROM mt WHERE rank = 1 AND hit AND role = 'user'),
fd AS (SELECT qid, count(rank) AS found, count(*) AS moments, min(rank) AS first FROM hits WHERE role = 'assistant' GROUP BY qid),
j AS (SELECT q.qid, category, coalesce(found, 0) AS found, moments, first, CASE WHEN an.qid IS NULL THEN 'no_results' WHEN bd.qid IS NOT NULL THEN 'near_miss' WHEN coalesce(found, 0) = 0 THEN 'not_found' END AS rule FROM q LEFT JOIN an USING (qid) LEFT JOIN bd USING (qid) LEFT JOIN fd USING (qid))
SELECT qid, rule IS NULL AND (category <> 'multi_file' OR found = moments) AS passed, CASE WHEN rule IS NULL THEN round(found / moments, 6) ELSE 0e0 END AS score, rule, CASE WHEN rule IS NULL THEN first END AS first_rank FROM j""")
def assertion_scores(spark, sf):
    results, moments = results_and_moments(spark, sf)
    queries = moments.select("qid", F.when(F.col("qid") % 3 == 0, "multi_file").otherwise("single_file").alias("category")).distinct()
    hits = E.moment_hits(results, moments.where("role = 'assistant'"))
    return E.assertion(queries, results, hits, moments.where("role = 'user'").select("qid", "file", "start_s", "end_s"))


QUOTED = f"""WITH {O.WORDS}, tw AS (SELECT conv_id * 1000 + turn AS id, list(word ORDER BY pos) AS ws, list(start_s ORDER BY pos) AS ss, list(end_s ORDER BY pos) AS es, min(start_s) AS ts, max(end_s) AS te FROM words GROUP BY conv_id, turn),
tq AS (SELECT *, array_to_string(ws, ' ') AS text, array_to_string(ws[3:7], ' ') AS quoted FROM tw WHERE len(ws) >= 3),
tl AS (SELECT *, instr(text, quoted) - 1 AS lo FROM tq),
tu AS (SELECT id, lo, lo + length(quoted) AS hi, ts, te, unnest(ws) AS w, unnest(ss) AS s, unnest(es) AS e, unnest(range(1, len(ws) + 1)) AS k FROM tl),
tp AS (SELECT *, coalesce(sum(length(w) + 1) OVER (PARTITION BY id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM tu)"""


@query(f"{QUOTED} SELECT id, round(greatest(min(s), min(ts)), 2) AS start_s, round(least(max(e), max(te)), 2) AS end_s FROM tp WHERE a < hi AND a + length(w) > lo GROUP BY id")
def quotation_spans(spark, sf):
    """The third to seventh word of each turn as a quotation."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "word", "start_s", "end_s")))
    turns = words_of(spark, sf).groupBy((F.col("conv_id") * 1000 + F.col("turn")).alias("id")).agg(listed.alias("w"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).where(F.size("w") >= 3)
    words = F.transform("w", lambda w: F.struct(w["word"].alias("word"), w["start_s"].alias("start_s"), w["end_s"].alias("end_s")))
    text = F.transform("w", lambda w: w["word"])
    return E.tightened(turns.select("id", F.array_join(text, " ").alias("text"), F.array_join(F.slice(text, 3, 5), " ").alias("matched_text"), "start_s", "end_s", words.alias("words")))


# Integrity


REFERENCE = f"""WITH {O.WORDS}, {O.TURNS}, rt AS (SELECT conv_id AS file, CASE WHEN turn_id % 11 = 0 THEN turn_id + 1 ELSE turn_id END AS turn_id, CASE WHEN turn_id % 5 = 0 THEN 'ghost' ELSE speaker END AS speaker, CASE WHEN turn_id % 7 = 0 THEN 'NaN'::DOUBLE ELSE start_s END AS start_s,
CASE WHEN turn_id % 3 = 0 THEN start_s ELSE end_s END AS end_s, CASE WHEN turn_id % 4 = 0 THEN ' ' ELSE text END AS text FROM turns)"""


def reference_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with flaws: numbers that are missing or repeated, an undeclared speaker, times that are no numbers, turns of no length, blank texts."""
    n = F.col("turn_id")
    return turns_of(spark, sf).select(F.col("conv_id").alias("file"), F.when(n % 11 == 0, n + 1).otherwise(n).alias("turn_id"), F.when(n % 5 == 0, "ghost").otherwise(F.col("speaker")).alias("speaker"), F.when(n % 7 == 0, float("nan")).otherwise(F.col("start_s")).alias("start_s"), F.when(n % 3 == 0, F.col("start_s")).otherwise(F.col("end_s")).alias("end_s"), F.when(n % 4 == 0, " ").otherwise(F.col("text")).alias("text"))


def roles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("file"), F.col("role").alias("speaker")).distinct()


@query(f"""{REFERENCE}, p AS (SELECT *, row_number() OVER o AS place, lead(start_s) OVER o AS nx, NOT isnan(start_s) AS sound FROM rt WINDOW o AS (PARTITION BY file ORDER BY turn_id, start_s)),
x AS (SELECT file, turn_id, unnest([CASE WHEN turn_id <> place THEN 'sequence' END, CASE WHEN NOT sound THEN 'finite' END, CASE WHEN sound AND (start_s < 0 OR end_s <= start_s) THEN 'length' END, CASE WHEN speaker = 'ghost' THEN 'speaker' END, CASE WHEN trim(text) = '' THEN 'text' END,
CASE WHEN sound AND nx IS NOT NULL AND nx <> end_s THEN 'gap' END]) AS rule FROM p) SELECT * FROM x WHERE rule IS NOT NULL""")
def turn_rules(spark, sf):
    return integrity.turn_rules(reference_turns(spark, sf), roles(spark, sf))


@query("""WITH f AS (SELECT conv_id AS file, count(*)::DOUBLE AS seconds, count(DISTINCT role) AS n FROM conversations GROUP BY conv_id), a AS (SELECT file, seconds + (file % 4) AS heard FROM f WHERE file % 5 <> 0),
x AS (SELECT file, unnest([CASE WHEN heard IS NULL THEN 'audio' END, CASE WHEN abs(seconds - heard) > 1 THEN 'seconds' END, CASE WHEN n <> 2 THEN 'speakers' END, CASE WHEN file % 7 = 0 THEN 'turns' END]) AS rule FROM f LEFT JOIN a USING (file)) SELECT * FROM x WHERE rule IS NOT NULL""")
def recording_rules(spark, sf):
    turns = table(spark, sf, "conversations").select(F.col("conv_id").alias("file"), "turn")
    files = turns.groupBy("file").agg(F.count(F.lit(1)).cast("double").alias("seconds"))
    audio = files.where("file % 5 <> 0").select("file", (F.col("seconds") + F.col("file") % 4).alias("seconds"))
    return integrity.recording_rules(files, turns.where("file % 7 <> 0"), roles(spark, sf), audio)


def kinds() -> F.Column:
    return F.element_at(F.array(*[F.lit(k) for k in (*integrity.CATEGORIES, "odd")]), (F.col("qid") % 4 + 1).cast("int"))


@query("""WITH q AS (SELECT item_id // 2 AS qid, text, ['single_file', 'multi_file', 'short_keyword', 'odd'][(item_id // 2) % 4 + 1] AS category, item_id % 3 AS declared FROM benchmark),
m AS (SELECT doc_id % 60 AS qid, doc_id % 2 AS file, doc_id % 3 = 0 AS alt FROM labels), o AS (SELECT qid, count(DISTINCT file) AS files, count(*) AS moments FROM m WHERE NOT alt GROUP BY qid),
j AS (SELECT q.*, coalesce(files, 0) AS files, moments, count(*) OVER (PARTITION BY qid) AS times FROM q LEFT JOIN o USING (qid)),
x AS (SELECT qid, unnest([CASE WHEN times > 1 THEN 'id' END, CASE WHEN category = 'odd' THEN 'category' END, CASE WHEN moments IS NULL THEN 'moments' END, CASE WHEN declared <> files THEN 'declared_files' END, CASE WHEN category = 'single_file' AND files <> 1 THEN 'single_file' END,
CASE WHEN category = 'multi_file' AND files < 2 THEN 'multi_file' END, CASE WHEN category = 'short_keyword' AND len(string_split_regex(trim(text), '\\s+')) > 3 THEN 'keyword_words' END]) AS rule FROM j) SELECT * FROM x WHERE rule IS NOT NULL""")
def query_rules(spark, sf):
    halved = items(spark, sf).withColumn("declared_files", F.col("qid") % 3).withColumn("qid", F.floor(F.col("qid") / 2))
    moments = table(spark, sf, "labels").select((F.col("doc_id") % 60).alias("qid"), (F.col("doc_id") % 2).alias("file"), (F.col("doc_id") % 3 == 0).alias("alternative"))
    return integrity.query_rules(halved.withColumn("category", kinds()), moments)


@query(f"""WITH {O.WORDS}, {O.TURNS}, t AS (SELECT conv_id AS file, turn_id, speaker AS ts, start_s AS tst, end_s AS tet, text AS tt FROM turns),
m AS (SELECT turn_id AS qid, ['single_file', 'multi_file', 'short_keyword', 'odd'][turn_id % 4 + 1] AS category, CASE WHEN turn_id % 9 = 0 THEN -1 ELSE file END AS file, CASE WHEN turn_id % 8 = 0 THEN 0 ELSE turn_id END AS turn_id, CASE WHEN turn_id % 2 = 0 THEN 'user' END AS speaker, CASE WHEN turn_id % 10 = 0 THEN NULL ELSE tst - (turn_id % 3) * 4e-2 END AS start_s,
CASE WHEN turn_id % 7 = 0 THEN tst - 1 WHEN turn_id % 4 = 2 THEN tst + 15e-1 ELSE tet END AS end_s, CASE WHEN turn_id % 6 = 0 THEN '' WHEN turn_id % 6 = 1 THEN upper(tt) ELSE substr(tt, 2, 20) END AS mt, turn_id % 5 = 0 AS alt FROM t),
j AS (SELECT m.*, ts, tst, tet, tt, t.file IS NOT NULL AS known, m.file IN (SELECT file FROM t) AS heard, start_s IS NOT NULL AS sound, coalesce(trim(mt), '') <> '' AS quoted FROM m LEFT JOIN t ON t.file = m.file AND t.turn_id = m.turn_id),
k AS (SELECT *, known AND sound AND end_s > start_s AS timed FROM j),
x AS (SELECT qid, file, turn_id, unnest([CASE WHEN NOT heard THEN 'file' END, CASE WHEN heard AND NOT known THEN 'turn' END, CASE WHEN known AND speaker <> ts THEN 'speaker' END, CASE WHEN known AND NOT sound THEN 'finite' END, CASE WHEN known AND sound AND end_s <= start_s THEN 'length' END,
CASE WHEN timed AND (start_s < tst - 5e-2 OR end_s > tet + 5e-2) THEN 'outside' END, CASE WHEN timed AND category = 'short_keyword' AND NOT alt AND end_s - start_s < 2 THEN 'keyword_seconds' END, CASE WHEN timed AND NOT quoted THEN 'quotation_empty' END, CASE WHEN timed AND quoted AND NOT contains(tt, mt) THEN 'quotation' END]) AS rule FROM k)
SELECT * FROM x WHERE rule IS NOT NULL""")
def moment_rules(spark, sf):
    """A moment for each turn, with flaws by its number."""
    turns = turns_of(spark, sf).select(F.col("conv_id").alias("file"), "turn_id", "speaker", "start_s", "end_s", "text")
    n = F.col("turn_id")
    flawed = turns.select(
        n.alias("qid"),
        F.when(n % 9 == 0, -1).otherwise(F.col("file")).alias("file"),
        F.when(n % 8 == 0, 0).otherwise(n).alias("turn_id"),
        F.when(n % 2 == 0, "user").alias("speaker"),
        F.when(n % 10 != 0, F.col("start_s") - (n % 3) * 0.04).alias("start_s"),
        F.when(n % 7 == 0, F.col("start_s") - 1).when(n % 4 == 2, F.col("start_s") + 1.5).otherwise(F.col("end_s")).alias("end_s"),
        F.when(n % 6 == 0, "").when(n % 6 == 1, F.upper("text")).otherwise(F.substring("text", 2, 20)).alias("matched_text"),
        (n % 5 == 0).alias("alternative"),
    ).withColumn("category", kinds())
    return integrity.moment_rules(flawed, turns)


@query("""WITH u AS (SELECT source AS split, doc_id % 50 AS file, doc_id % 40 AS turn_id FROM documents WHERE source IN ('src1', 'src2', 'src3') AND doc_id % 3 = 0), o AS (SELECT DISTINCT * FROM u)
SELECT a.file, a.turn_id, a.split AS a, b.split AS b FROM o a JOIN o b ON a.file = b.file AND a.turn_id = b.turn_id AND a.split < b.split WHERE NOT (a.split = 'src1' AND b.split = 'src3')""")
def shared_turns(spark, sf):
    used = table(spark, sf, "documents").where("source IN ('src1', 'src2', 'src3') AND doc_id % 3 = 0").select(F.col("source").alias("split"), (F.col("doc_id") % 50).alias("file"), (F.col("doc_id") % 40).alias("turn_id"))
    return integrity.shared_turns(used, [("src3", "src1")])


@query("""WITH q AS (SELECT source AS split, doc_id AS qid, lang AS category FROM documents), n AS (SELECT split, count(*) AS n FROM q GROUP BY split),
x AS (SELECT split, unnest([CASE WHEN split = 'src2' THEN 'name' END, CASE WHEN split = 'src4' THEN 'total' END, CASE WHEN split = 'src6' THEN 'files' END, CASE WHEN split = 'src8' THEN 'breakdown' END, CASE WHEN split = 'src8' THEN 'expected' END]) AS rule FROM n) SELECT * FROM x WHERE rule IS NOT NULL""")
def split_rules(spark, sf):
    """Sources as splits; in some the name, the total, the files or what is expected of a category is wrong."""
    queries = table(spark, sf, "documents").select(F.col("source").alias("split"), F.col("doc_id").alias("qid"), F.col("lang").alias("category"))
    files = table(spark, sf, "region").select(F.col("r_name").alias("file"))
    every = F.array(*[F.lit(r.file) for r in files.orderBy("file").collect()])
    splits = queries.groupBy("split").agg(F.count(F.lit(1)).alias("total")).select("split", F.when(F.col("split") == "src2", "other").otherwise(F.col("split")).alias("declared"), (F.col("total") + (F.col("split") == "src4").cast("int")).alias("total"), F.when(F.col("split") == "src6", F.slice(every, 1, 2)).otherwise(every).alias("files"))
    first = F.row_number().over(Window.partitionBy("split").orderBy("category")) == 1
    expected = queries.groupBy("split", "category").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.col("n") + F.when((F.col("split") == "src8") & first, 1).otherwise(0))
    return integrity.split_rules(splits, queries, files, expected)


# Words, samples, clips


@query(f"""WITH {O.WORDS}, g AS (SELECT conv_id, turn, min(start_s) AS bs, max(end_s) AS be FROM words GROUP BY conv_id, turn)
SELECT w.conv_id, w.turn, (row_number() OVER (PARTITION BY w.conv_id, w.turn ORDER BY pos) - 1)::BIGINT AS pos, word, CASE WHEN w.turn % 3 <> 1 THEN start_s END AS start_s, CASE WHEN w.turn % 3 <> 1 THEN end_s END AS end_s, bs AS bound_start, be AS bound_end FROM words w JOIN g USING (conv_id, turn)""")
def segment_words(spark, sf):
    """Turns as segments; the aligner gave no words for every third one."""
    listed = F.array_sort(F.collect_list(F.struct("pos", "word", "start_s", "end_s")))
    rows = words_of(spark, sf).groupBy("conv_id", "turn").agg(listed.alias("w"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    words = F.transform("w", lambda w: F.struct(w["word"].alias("word"), w["start_s"].alias("start_s"), w["end_s"].alias("end_s")))
    text = F.array_join(F.transform("w", lambda w: w["word"]), "  ")
    return transcript.segment_words(rows.select("conv_id", "turn", text.alias("text"), "start_s", "end_s", F.when(F.col("turn") % 3 != 1, words).alias("words")))


def worded_turns(spark: SparkSession, sf: str) -> DataFrame:
    """Turns with words, whose confidence follows from their length; words of one letter have none."""
    words = words_of(spark, sf)
    listed = F.array_sort(F.collect_list(F.struct("pos", "word", "start_s", "end_s")))
    rows = words.groupBy("conv_id", F.col("turn").alias("turn_id"), F.col("role").alias("speaker")).agg(listed.alias("w"))
    confidence = lambda w: F.when(F.length(w["word"]) > 1, F.length(w["word"]) / 20.0)
    typed = F.transform("w", lambda w: F.struct(w["word"].alias("word"), w["start_s"].alias("start_s"), w["end_s"].alias("end_s"), confidence(w).alias("confidence")))
    return rows.select("conv_id", "turn_id", "speaker", (F.col("turn_id") % 6 == 5).alias("is_short_turn"), typed.alias("words"))


@query(f"""WITH {O.WORDS}, b AS (SELECT conv_id, turn, role, pos, word, start_s, end_s, min(start_s) OVER (PARTITION BY conv_id, turn) AS s0 FROM words WHERE turn % 6 <> 5),
p AS (SELECT * FROM b WHERE end_s - s0 <= 15),
w AS (SELECT conv_id, role AS speaker, turn AS turn_id, round(min(s0), 3) AS start_s, round(max_by(end_s, pos), 3) AS end_s, string_agg(word, ' ' ORDER BY pos) AS text, round(coalesce(avg(CASE WHEN length(word) > 1 THEN length(word) / 20e0 END), 0), 6) AS score FROM p GROUP BY conv_id, turn, role),
z AS (SELECT *, round(end_s - start_s, 6) AS l, round(end_s - start_s, 6) >= 4 AS f FROM w WHERE round(end_s - start_s, 6) >= 1),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, speaker ORDER BY f DESC, CASE WHEN NOT f THEN l END DESC NULLS LAST, turn_id) AS k FROM z)
SELECT conv_id, speaker, turn_id, start_s, end_s, text, score FROM r WHERE f OR k <= 3""")
def sample_windows(spark, sf):
    return transcript.sample_windows(worded_turns(spark, sf))


@query(f"""WITH {O.WORDS}, g AS (SELECT conv_id, turn, min(start_s) + 1 AS a, min(start_s) + 3 AS b FROM words GROUP BY conv_id, turn),
i AS (SELECT w.conv_id, w.turn, pos, replace(replace(replace(replace(replace(word, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS x, start_s < b AND a < end_s AS n FROM words w JOIN g USING (conv_id, turn)),
m AS (SELECT *, coalesce(lag(n) OVER o, false) AS p, coalesce(lead(n) OVER o, false) AS q FROM i WINDOW o AS (PARTITION BY conv_id, turn ORDER BY pos))
SELECT conv_id, turn AS turn_id, string_agg(CASE WHEN n AND NOT p THEN '<span class="clip">' ELSE '' END || x || CASE WHEN n AND NOT q THEN '</span>' ELSE '' END, ' ' ORDER BY pos) AS html FROM m GROUP BY conv_id, turn""")
def clip_shading(spark, sf):
    """Two seconds of each turn, from its first second on."""
    begin = F.get("words", F.lit(0))["start_s"]
    return worded_turns(spark, sf).select("conv_id", "turn_id", transcript.shaded(F.col("words"), begin + 1, begin + 3).alias("html"))


# Names, files, jobs


@query("""WITH s AS (SELECT DISTINCT conv_id AS file, role AS label, CASE WHEN conv_id % 3 > 0 THEN upper(role) END AS name FROM conversations), f AS (SELECT DISTINCT conv_id AS file, CASE WHEN conv_id % 2 = 0 THEN 'talk ' || conv_id END AS title FROM conversations WHERE conv_id % 5 <> 0),
c AS (SELECT coalesce(name, label || ' (' || coalesce(title, file::VARCHAR) || ')') AS speaker, file FROM f JOIN s USING (file)) SELECT speaker, count(DISTINCT file) AS n_files FROM c GROUP BY speaker""")
def speaker_options(spark, sf):
    speakers = roles(spark, sf).select("file", F.col("speaker").alias("label"), F.when(F.col("file") % 3 > 0, F.upper("speaker")).alias("name"))
    files = roles(spark, sf).select("file").distinct().select("file", F.when(F.col("file") % 5 == 0, "other").otherwise("dataset").alias("workspace"), F.when(F.col("file") % 2 == 0, F.concat(F.lit("talk "), F.col("file").cast("string"))).alias("title"))
    return S.speaker_options(files, speakers, ["dataset"]).select("speaker", "n_files")


@query("""WITH r AS (SELECT conv_id AS file, turn, CASE WHEN role = 'user' THEN 'SPEAKER_00' WHEN role = 'assistant' THEN 'SPEAKER_01' ELSE role END AS speaker FROM conversations)
SELECT file, turn, CASE WHEN speaker = 'SPEAKER_00' AND file % 2 = 0 THEN 'Ann ' || file ELSE speaker END AS speaker FROM r""")
def resolved_names(spark, sf):
    """Roles as anonymous labels; the first one has a name in every second conversation, others have names that don't count."""
    label = F.when(F.col("role") == "user", "SPEAKER_00").when(F.col("role") == "assistant", "SPEAKER_01").otherwise(F.col("role"))
    results = table(spark, sf, "conversations").select(F.col("conv_id").alias("file"), "turn", label.alias("speaker"))
    some = results.select("file").distinct().where("file % 2 = 0")
    names = some.select("file", F.lit("SPEAKER_00").alias("label"), F.concat(F.lit("Ann "), F.col("file").cast("string")).alias("name")).unionByName(some.select("file", F.lit("system").alias("label"), F.lit("Nobody").alias("name")))
    return S.named(results, names)


JOBS = """jb AS (SELECT user_id AS file_id, ['queued', 'running', 'awaiting_labels', 'labeled', 'failed'][user_id % 5 + 1] AS status, max(ts) AS updated_at, min(ts) AS created_at, (user_id % 4)::DOUBLE * 100 AS duration_s, CASE WHEN user_id % 3 = 0 THEN 'rec ' || user_id END AS source_filename FROM events WHERE user_id % 2 = 0 GROUP BY user_id),
fl AS (SELECT DISTINCT user_id AS file_id FROM events), nw AS (SELECT max(ts) AS now FROM events)"""


def job_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Users with even ids as files with a job, whose state follows from the id; all events, all files."""
    events = table(spark, sf, "events").select(F.col("user_id").alias("file_id"), F.col("ts").cast("timestamp").alias("at"), "event_id", "event_type", "value")
    state = F.element_at(F.array(*[F.lit(x) for x in ("queued", "running", "awaiting_labels", "labeled", "failed")]), (F.col("file_id") % 5 + 1).cast("int"))
    made = events.where("file_id % 2 = 0").groupBy("file_id").agg(F.max("at").alias("updated_at"), F.min("at").alias("created_at"))
    named = made.select("file_id", state.alias("status"), "updated_at", "created_at", ((F.col("file_id") % 4).cast("double") * 100).alias("duration_s"), F.when(F.col("file_id") % 3 == 0, F.concat(F.lit("rec "), F.col("file_id").cast("string"))).alias("source_filename"))
    return named, events, events.select("file_id").distinct()


@query(f"""WITH {JOBS}, hb AS (SELECT user_id AS file_id, max(ts) AS last FROM events WHERE event_id % 3 = 0 GROUP BY user_id)
SELECT jb.file_id, CASE WHEN status IN ('queued', 'running') AND epoch_us(now) - epoch_us(greatest(updated_at - INTERVAL 1 DAY, coalesce(last, updated_at - INTERVAL 1 DAY))) >= 60000000 THEN 'failed' ELSE status END AS status FROM jb LEFT JOIN hb USING (file_id), nw""")
def job_states(spark, sf):
    """Jobs last updated a day before their last event, with every third event as a sign of life, at the time of the last event of all."""
    made, events, _ = job_tables(spark, sf)
    aged = made.withColumn("updated_at", F.col("updated_at") - F.expr("INTERVAL 1 DAY"))
    now = F.lit(events.agg(F.max("at")).first()[0])
    return jobs.observed(aged, events.where("event_id % 3 = 0").select("file_id", "at"), now).select("file_id", "status")


STATES = f"WITH {JOBS}, st AS (SELECT fl.file_id, coalesce(status, CASE WHEN fl.file_id % 3 <> 1 THEN 'not_processed' WHEN fl.file_id % 6 = 1 THEN 'labeled' ELSE 'awaiting_labels' END) AS status, created_at, source_filename FROM fl LEFT JOIN jb USING (file_id))"


def file_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    made, _, files = job_tables(spark, sf)
    return files, made, files.where("file_id % 3 = 1"), files.where("file_id % 6 = 1")


@query(f"{STATES} SELECT file_id, status FROM st")
def file_status(spark, sf):
    return jobs.statuses(*file_tables(spark, sf))


@query(f"{STATES} SELECT row_number() OVER (ORDER BY coalesce(created_at::VARCHAR, '') DESC, file_id DESC) AS place, file_id, coalesce(source_filename, file_id::VARCHAR) AS display_name, status FROM st")
def file_listing(spark, sf):
    return jobs.listing(*file_tables(spark, sf)).select(F.col("place").cast("long").alias("place"), "file_id", "display_name", "status")


@query("""WITH k AS (SELECT event_id AS file_id, event_type AS stage, (event_id % 7)::VARCHAR AS cache_key FROM events), a AS (SELECT event_id AS file_id, event_type AS stage, CASE WHEN event_id % 5 = 0 THEN (event_id % 7 + event_id % 2)::VARCHAR WHEN event_id % 5 < 4 THEN (event_id % 7)::VARCHAR END AS had FROM events WHERE event_id % 4 > 0)
SELECT k.file_id, k.stage, k.cache_key, coalesce(had = k.cache_key, false) AS valid FROM k LEFT JOIN a USING (file_id, stage)""")
def cache_validity(spark, sf):
    """Artifacts as JSON: some absent, some of other inputs, some broken."""
    e = table(spark, sf, "events").select(F.col("event_id").alias("file_id"), F.col("event_type").alias("stage"))
    key = (F.col("file_id") % 7).cast("string")
    made = lambda k: F.concat(F.lit('{"cache_key": "'), k, F.lit('", "words": []}'))
    content = F.when(F.col("file_id") % 5 == 0, made((F.col("file_id") % 7 + F.col("file_id") % 2).cast("string"))).when(F.col("file_id") % 5 < 4, made(key)).otherwise('{"cache_key": "')
    return jobs.valid_caches(e.where("file_id % 4 > 0").select("file_id", "stage", content.alias("content")), e.withColumn("cache_key", key))


@query(f"""WITH {JOBS}, dn AS (SELECT * FROM jb WHERE status IN ('awaiting_labels', 'labeled') AND duration_s > 0 ORDER BY updated_at DESC, file_id DESC LIMIT 5),
sg AS (SELECT user_id AS file_id, CASE event_type WHEN 'click' THEN 'asr' WHEN 'view' THEN 'diarize' ELSE event_type END AS stage, value, event_id FROM events WHERE value > 0 AND event_id % 6 <> 0),
c AS (SELECT stage, CASE WHEN stage IN ('asr', 'diarize') THEN round(value, 3) / duration_s ELSE round(value, 3) END AS cost FROM sg JOIN dn USING (file_id))
SELECT stage, round(list_sort(list(cost))[len(list(cost)) // 2 + 1], 6) AS cost FROM c GROUP BY stage""")
def stage_costs(spark, sf):
    """Events as stages that took as many seconds as their value; every sixth one failed."""
    made, events, _ = job_tables(spark, sf)
    stage = F.when(F.col("event_type") == "click", "asr").when(F.col("event_type") == "view", "diarize").otherwise(F.col("event_type"))
    took = F.timestamp_micros((F.round("value", 3) * 1_000_000).cast("long"))
    stages = events.where("value > 0").select("file_id", stage.alias("stage"), F.timestamp_micros(F.lit(0).cast("long")).alias("started_at"), took.alias("finished_at"), (F.col("event_id") % 6 == 0).cast("int").alias("returncode"))
    return jobs.stage_costs(made, stages)


@query("SELECT label AS model, max(len(embedding))::INTEGER AS dims FROM embeddings GROUP BY label")
def vector_dims(spark, sf):
    return vectors(spark, sf).groupBy(F.col("label").alias("model")).agg(F.max(F.size("embedding")).alias("dims"))


@query(f"WITH {O.WORDS}, {O.SENT} SELECT conv_id, count(*) AS n_sentences, count(DISTINCT turn) AS n_turns FROM sentences GROUP BY conv_id")
def sentence_counts(spark, sf):
    return segment.punctuation_sentences(words_of(spark, sf)).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.count_distinct("turn").alias("n_turns"))


# Search


def corpus_of(spark: SparkSession, sf: str) -> S.Corpus:
    """Conversations as recordings: windows as chunks, full sentences with their words. Both are kept on disk, since every list of a search reads them."""
    words = words_of(spark, sf)
    number = lambda at: F.col("conv_id") * 1_000_000 + F.col("turn") * 1_000 + at
    sentences = segment.sentences(words, worded=True).select(number(F.col("sentence")).alias("id"), F.col("conv_id").alias("file"), "turn", "start_s", "end_s", "text", "words")
    chunks = segment.chunks(words).select(number(F.col("window")).alias("id"), F.col("conv_id").alias("file"), F.col("role").alias("speaker"), "turn", "start_s", "end_s", F.transform("sentences", lambda i: number(i)).alias("sentence_ids"), "text", F.lit("dataset").alias("workspace"))
    return S.Corpus(chunks.persist(StorageLevel.DISK_ONLY), sentences.persist(StorageLevel.DISK_ONLY))


@query()
def search_hybrid(spark, sf):
    """The first two words of each benchmark item."""
    short = items(spark, sf).select("qid", F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("text"))
    return S.search(short, corpus_of(spark, sf))
