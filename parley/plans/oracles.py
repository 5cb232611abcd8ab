"""SQL twins of the core queries, for DuckDB."""

TOK = r"regexp_extract_all(lower(coalesce({0}, '')), '[\p{{L}}\p{{N}}_]+')"

WORDS = r"""
raw AS (SELECT conv_id, turn, role, string_split_regex(trim(text), '[ \t\n\r]+') AS ws FROM conversations WHERE text IS NOT NULL),
sp AS (SELECT * FROM (SELECT conv_id, turn, role, unnest(ws) AS word, unnest(range(0, len(ws))) AS ix FROM raw) WHERE word <> ''),
wn AS (SELECT *, row_number() OVER o - 1 AS pos, coalesce(sum(CASE WHEN regexp_matches(word, '[.?!]$') THEN 1 ELSE 0 END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ends,
  sum(CASE WHEN ix = 0 THEN 1 ELSE 0 END) OVER o - 1 AS changes FROM sp WINDOW o AS (PARTITION BY conv_id ORDER BY turn, ix)),
words AS (SELECT conv_id, pos, turn, role, word, (pos * 400 + ends * 1000 + changes * 2000)::BIGINT / 1000.0::DOUBLE AS start_s, (pos * 400 + ends * 1000 + changes * 2000 + 350)::BIGINT / 1000.0::DOUBLE AS end_s FROM wn)"""

INTERVALS = """
iv AS (SELECT conv_id, turn AS place, role AS speaker, min(start_s) + 3e-1 AS istart, max(end_s) + 3e-1 AS iend FROM words GROUP BY conv_id, turn, role)"""

ASSIGNED = """
tot AS (SELECT w.conv_id, w.pos, w.start_s, w.end_s, i.speaker, sum(least(end_s, iend) - greatest(start_s, istart)) AS shared, min(place) AS place FROM words w JOIN iv i ON w.conv_id = i.conv_id AND i.istart < w.end_s AND w.start_s < i.iend GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY conv_id, pos ORDER BY shared DESC, place) AS r FROM tot),
major AS (SELECT conv_id, pos, speaker FROM best WHERE r = 1 AND shared / greatest(end_s - start_s, 1e-3) > 5e-1),
near AS (SELECT w.conv_id, w.pos, i.speaker, row_number() OVER (PARTITION BY w.conv_id, w.pos ORDER BY CASE WHEN end_s < istart THEN istart - end_s WHEN start_s > iend THEN start_s - iend ELSE 0e0 END, place) AS r FROM words w JOIN iv i USING (conv_id) WHERE NOT EXISTS (SELECT 1 FROM major m WHERE m.conv_id = w.conv_id AND m.pos = w.pos)),
assigned AS (SELECT w.*, coalesce(m.speaker, n.speaker) AS speaker FROM words w LEFT JOIN major m USING (conv_id, pos) LEFT JOIN near n ON n.conv_id = w.conv_id AND n.pos = w.pos AND n.r = 1)"""

BACK = "trim(lower({0}), '.,!?;:\"''') IN ('yeah','right','okay','sure','yep','mm-hmm','uh-huh','yes','i see','exactly')"


def turns_sql(source: str, speaker: str, pause: str = "15e-1") -> str:
    return f"""
mk AS (SELECT *, {speaker} AS spk, lag({speaker}) OVER o AS prev, lag(end_s) OVER o AS prev_end FROM {source} WINDOW o AS (PARTITION BY conv_id ORDER BY pos)),
rs AS (SELECT *, CASE WHEN prev IS NOT NULL AND spk <> prev THEN 'speaker_change' WHEN prev IS NOT NULL AND start_s - prev_end > {pause} THEN 'pause' END AS reason FROM mk),
nb AS (SELECT *, (sum(CASE WHEN reason IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) + 1)::BIGINT AS turn_id FROM rs),
tg AS (SELECT conv_id, turn_id, min_by(spk, pos) AS speaker, min(start_s) AS s0, max_by(end_s, pos) AS e0, trim(string_agg(word, ' ' ORDER BY pos)) AS text, count(*) AS n_words, max(CASE WHEN reason IS NOT NULL THEN reason END) AS began FROM nb GROUP BY conv_id, turn_id),
turns AS (SELECT conv_id, turn_id, speaker, round(s0, 3) AS start_s, round(e0, 3) AS end_s, coalesce(lead(began) OVER (PARTITION BY conv_id ORDER BY turn_id), 'end_of_audio') AS split_reason, (e0 - s0 < 8e-1) AND ({BACK.format('text')}) AS is_short_turn, text, n_words FROM tg)"""


TURNS = turns_sql("words", "role")

SENT = r"""
bare AS (SELECT *, rtrim(word, '"'')]”’') AS b FROM words),
flag AS (SELECT *, regexp_matches(b, '[.?!]$') AND lower(b) NOT IN ('mr.','mrs.','ms.','dr.','prof.','st.','jr.','sr.','vs.','etc.','e.g.','i.e.','u.s.','u.k.','a.m.','p.m.','no.','approx.','inc.','ltd.','co.') AS ends_here FROM bare),
sn AS (SELECT *, coalesce(sum(CASE WHEN ends_here THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sentence FROM flag),
sentences AS (SELECT conv_id, turn, sentence, min(start_s) AS start_s, max(end_s) AS end_s, count(*) AS n_words, string_agg(word, ' ' ORDER BY pos) AS text FROM sn GROUP BY conv_id, turn, sentence)"""

KEYWORDS = f"""
kt AS (SELECT item_id AS qid, unnest({TOK.format('text')}) AS term FROM benchmark),
kw AS (SELECT qid, term AS text FROM (SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY length(term) DESC, term) AS r FROM (SELECT DISTINCT qid, term FROM kt)) WHERE r = 1)"""


def bm25_sql(queries: str, scope: str = "true") -> str:
    """CTEs that end in bm25(qid, id, score); queries is a relation (qid, text)."""
    return f"""
tok AS (SELECT doc_id AS id, {TOK.format('text')} AS t, lang FROM documents),
st AS (SELECT count(*) AS n, avg(len(t)) AS m FROM tok),
q AS (SELECT DISTINCT qid, unnest({TOK.format('text')}) AS term FROM {queries}),
post AS (SELECT id, lang, len(t) AS dl, unnest(t) AS term FROM tok),
tf AS (SELECT id, lang, dl, term, count(*) AS tf FROM post WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm25 AS (SELECT q.qid, tf.id, round(sum(ln(1 + (n - df + 5e-1) / (df + 5e-1)) * tf * 22e-1 / (tf + 12e-1 * (25e-2 + 75e-2 * dl / m))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term), st WHERE {scope} GROUP BY q.qid, tf.id)"""


def grams(text: str) -> str:
    return f"list_distinct(flatten(list_transform({TOK.format(text)}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


TRIGRAM = f"""
dg AS (SELECT doc_id AS id, {grams('text')} AS g FROM documents),
qg AS (SELECT qid, {grams('text')} AS g FROM kw),
dp AS (SELECT id, len(g) AS n_d, unnest(g) AS gram FROM dg),
qp AS (SELECT qid, len(g) AS n_q, unnest(g) AS gram FROM qg),
trigram AS (SELECT qid, id, round(count(*) / (any_value(n_q) + any_value(n_d) - count(*)), 6) AS score FROM dp JOIN qp USING (gram) GROUP BY qid, id)"""

COS = "round(list_dot_product({0}::DOUBLE[], {1}::DOUBLE[]) / (sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])) * sqrt(list_dot_product({1}::DOUBLE[], {1}::DOUBLE[]))), 6)"


def top(source: str, k: int, by: str = "qid") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, id) AS rank FROM {source} QUALIFY rank <= {k}"


FUSION = f"""
WITH {KEYWORDS}, {bm25_sql('kw')}, {TRIGRAM},
dense AS (SELECT a.vec_id AS qid, b.vec_id AS id, {COS.format('a.embedding', 'b.embedding')} AS score FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT item_id FROM benchmark)),
lists AS (SELECT 'bm25' AS retriever, qid, id, score FROM ({top('bm25', 50)}) UNION ALL SELECT 'trigram', qid, id, score FROM ({top('trigram', 50)}) UNION ALL SELECT 'dense', qid, id, score FROM ({top('dense', 50)})),
ran AS (SELECT item_id AS qid, 'bm25' AS retriever FROM benchmark UNION ALL SELECT item_id, 'trigram' FROM benchmark UNION ALL SELECT item_id, 'dense' FROM benchmark),
tw AS (SELECT qid, sum(CASE WHEN retriever = 'dense' THEN 2e0 ELSE 1e0 END) AS total FROM ran GROUP BY qid),
nm AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM lists WINDOW w AS (PARTITION BY qid, retriever)),
parts AS (SELECT qid, retriever, id, round(CASE WHEN retriever = 'dense' THEN 2e0 ELSE 1e0 END / total * CASE WHEN hi = lo THEN 1e0 ELSE (score - lo) / (hi - lo) END, 6) AS part FROM nm JOIN tw USING (qid)),
fused AS (SELECT qid, id, round(sum(part), 6) AS score, sum(CASE WHEN retriever <> 'dense' THEN part ELSE 0e0 END) AS w, sum(CASE WHEN retriever = 'dense' THEN part ELSE 0e0 END) AS m, bool_or(retriever = 'dense') AS meant FROM parts GROUP BY qid, id)"""
