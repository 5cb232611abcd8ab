"""URL filters as a temporal list join, in DataFrame operations only.

Dated additions and removals of list entries become intervals in which an entry is valid. A capture (url, fetch date) is asked for every key
that could list it: its host and the host's parents, and the host with each leading part of its path. Captures meet intervals by
key, keeping those valid when the capture was fetched (from inclusive, to exclusive). The most specific key decides, the longest one;
of equal ones a block wins.

The intervals are broadcast when there are at most BROADCAST_ROWS of them, with keys of at most BROADCAST_BYTES together; beyond, captures
and intervals are shuffled by key, where adaptive execution splits a common key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?(/[^?#]*)?"


def intervals(entries: DataFrame) -> DataFrame:
    """entries(key, action, dated), action being block, allow or remove -> key, action, valid_from, valid_to.

    The last entry of a date counts (in the order remove, block, allow: later ones win); an entry is valid until the key's next one, the last one for
    good (valid_to null). Entries with a null or empty field or other actions are left out.
    """
    order = F.array_position(F.array(F.lit("remove"), F.lit("block"), F.lit("allow")), F.col("action"))
    known = entries.select(F.lower("key").alias("key"), "action", "dated").where((F.length("key") > 0) & (order > 0) & F.col("dated").isNotNull())
    daily = known.groupBy("key", "dated").agg(F.max_by("action", order).alias("action"))
    until = F.lead("dated").over(Window.partitionBy("key").orderBy("dated"))
    return daily.select("key", "action", F.col("dated").alias("valid_from"), until.alias("valid_to")).where("action <> 'remove'")


def deepest(lists: DataFrame) -> tuple[int, int, int, int]:
    """(intervals, bytes of their keys, most labels of a host key, most sections of a path key)."""
    host, path = F.substring_index("key", "/", 1), F.instr("key", "/") > 0
    labels = F.when(~path, F.size(F.split("key", r"\.")))
    steps = F.when(path, F.size(F.split("key", "/")) - 1)
    return tuple(lists.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("key")), F.lit(0)), F.coalesce(F.max(labels), F.lit(0)), F.coalesce(F.max(steps), F.lit(0))).first())


def keys_of(url: Column, labels: int, sections: int) -> Column:
    """Every key that could list a url where no listed host has more labels and no listed path more sections than given: the host and its parents, and host plus
    each leading part of the path. What is deeper is listed nowhere, so a long url costs no more than the list's own depth."""
    host = F.lower(F.regexp_extract(url, URL, 1))
    parts = F.split(host, r"\.")
    first = F.greatest(F.lit(1), F.size(parts) - (labels - 1))
    parents = F.transform(F.sequence(first, F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")) if labels else None
    steps = F.slice(F.filter(F.split(F.lower(F.regexp_extract(url, URL, 2)), "/"), lambda s: s != ""), 1, max(1, sections))
    paths = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")))) if sections else None
    every = [F.coalesce(k, F.array().cast("array<string>")) for k in (parents, paths) if k is not None]
    return F.when(host != "", F.concat(*every) if every else F.array().cast("array<string>"))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures(page_id, url, fetched_on), entries(key, action, dated) -> page_id, url, fetched_on, host, n_active, rule, blocked.

    One row for each different (page_id, url, fetched_on). n_active counts the intervals that held at fetch time, rule is the
    deciding key (null: none) and blocked whether it blocks. Null urls, urls without a host and null dates match nothing (host
    null where there is none). Other columns are ignored; empty tables give empty results or no rules.
    """
    lists = intervals(entries).where(~F.startswith("key", F.lit("/")))
    n, size, labels, sections = deepest(lists)
    few = n <= BROADCAST_ROWS and size <= BROADCAST_BYTES
    held = F.broadcast(lists) if few else lists
    asked = captures.select("page_id", "url", "fetched_on", F.posexplode_outer(keys_of(F.col("url"), labels, sections)).alias("at", "asked"))
    active = (F.col("asked") == F.col("key")) & (F.col("valid_from") <= F.col("fetched_on")) & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to")))
    best = F.max(F.when(F.col("key").isNotNull(), F.struct(F.length("key").alias("length"), (F.col("action") == "block").alias("block"), F.col("key").alias("key"))))
    # rows that repeat a capture meet the list before they are put together: a key has one interval at most at a time, so its first key tells how many they are
    copies = F.count_if(F.coalesce("at", F.lit(0)) == 0)
    met = asked.join(held, active, "left").groupBy("page_id", "url", "fetched_on")
    found = met.agg((F.count("key") / copies).cast("long").alias("n_active"), best.alias("best"))
    host = F.nullif(F.lower(F.regexp_extract("url", URL, 1)), F.lit(""))
    return found.select("page_id", "url", "fetched_on", host.alias("host"), "n_active", F.col("best.key").alias("rule"), F.coalesce("best.block", F.lit(False)).alias("blocked"))


def drawn(text: Column, start: int, modulo: int) -> Column:
    """A number below modulo from four hex digits of the text's MD5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), start, 4), 16, 10).cast("int") % modulo


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' own hosts, for tables that bring none: which hosts, host parents and host sections are listed, when they are
    added, removed and added again, follows from their MD5."""
    host = F.lower(F.regexp_extract("url", URL, 1))
    section = F.lower(F.regexp_extract("url", URL.replace("(/[^?#]*)?", "(/[^/?#]+)"), 2))
    hosts = pages.where(F.col("url").isNotNull()).select(host.alias("host"), section.alias("section")).where("host <> ''").distinct()
    keys = hosts.select(F.explode(F.array("host", F.regexp_replace("host", r"^[^.]*\.", ""), F.concat("host", "section"))).alias("key")).where("key <> ''").distinct()
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    first, action = drawn(F.col("key"), 5, 300), F.when(drawn(F.col("key"), 9, 4) == 0, "allow").otherwise("block")
    listed = keys.where(drawn(F.col("key"), 1, 3) == 0)
    added = listed.select("key", action.alias("action"), day(first).alias("dated"))
    removed = listed.where(drawn(F.col("key"), 13, 2) == 0).select("key", F.lit("remove").alias("action"), day(first + 40).alias("dated"))
    again = listed.where(drawn(F.col("key"), 17, 2) == 0).select("key", F.lit("block").alias("action"), day(first + 90).alias("dated"))
    return added.unionByName(removed).unionByName(again)


def captures_of(pages: DataFrame) -> DataFrame:
    """pages(page_id, url) with a fetch date that follows from the id."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int")).alias("fetched_on"))


ORACLE = r"""
WITH parsed AS (
  SELECT DISTINCT page_id, url, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched_on,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)', 1), '/'), lambda s: s <> '') AS steps
  FROM pages),
hosts AS (SELECT DISTINCT host, CASE WHEN len(steps) > 0 THEN '/' || lower(steps[1]) ELSE '' END AS section FROM parsed WHERE host <> ''),
keys AS (
  SELECT DISTINCT key FROM (
    SELECT host AS key FROM hosts UNION ALL SELECT regexp_replace(host, '^[^.]*\.', '') FROM hosts UNION ALL SELECT host || section FROM hosts)
  WHERE key <> ''),
listed AS (
  SELECT key, ('0x' || substr(md5(key), 5, 4))::INT % 300 AS first_day, CASE WHEN ('0x' || substr(md5(key), 9, 4))::INT % 4 = 0 THEN 'allow' ELSE 'block' END AS action,
         ('0x' || substr(md5(key), 13, 4))::INT % 2 = 0 AS removed, ('0x' || substr(md5(key), 17, 4))::INT % 2 = 0 AS again
  FROM keys WHERE ('0x' || substr(md5(key), 1, 4))::INT % 3 = 0),
events AS (
  SELECT key, action, DATE '2024-01-01' + first_day AS dated FROM listed
  UNION ALL SELECT key, 'remove', DATE '2024-01-01' + first_day + 40 FROM listed WHERE removed
  UNION ALL SELECT key, 'block', DATE '2024-01-01' + first_day + 90 FROM listed WHERE again),
spans AS (SELECT key, action, dated AS valid_from, lead(dated) OVER (PARTITION BY key ORDER BY dated) AS valid_to FROM events),
asked AS (
  SELECT page_id, url, fetched_on, unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS key FROM parsed WHERE host <> ''
  UNION ALL SELECT page_id, url, fetched_on, unnest(list_transform(range(1, len(steps) + 1), lambda i: host || '/' || lower(array_to_string(steps[1:i], '/')))) FROM parsed WHERE host <> '' AND len(steps) > 0),
active AS (
  SELECT a.page_id, a.url, a.fetched_on, s.key, s.action FROM asked a JOIN spans s ON a.key = s.key AND s.action <> 'remove' AND s.valid_from <= a.fetched_on AND (s.valid_to IS NULL OR a.fetched_on < s.valid_to)),
best AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, url, fetched_on ORDER BY length(key) DESC, action = 'block' DESC, key DESC) AS place, count(*) OVER (PARTITION BY page_id, url, fetched_on) AS n FROM active)
SELECT p.page_id, p.url, p.fetched_on, nullif(p.host, '') AS host, coalesce(b.n, 0)::BIGINT AS n_active, b.key AS rule, coalesce(b.action = 'block', false) AS blocked
FROM parsed p LEFT JOIN best b ON b.place = 1 AND b.page_id = p.page_id AND b.url = p.url AND b.fetched_on = p.fetched_on
"""
