import datetime as dt

from parley.llm import url_filter as U

D = dt.date


def run(spark, captures, entries):
    c = spark.createDataFrame([(*x, 1) for x in captures], "page_id long, url string, fetched_on date, key int")
    e = spark.createDataFrame(entries, "key string, action string, dated date")
    return {(r.page_id, r.fetched_on): (r.n_active, r.rule, r.blocked) for r in U.evaluate(c, e).collect()}


def test_as_of(spark):
    entries = [("bad.org", "block", D(2024, 2, 1)), ("bad.org", "remove", D(2024, 3, 1)), ("ok.bad.org", "allow", D(2024, 1, 1)), ("bad.org", "block", D(2024, 5, 1)), ("site.net/a/b", "block", D(2024, 1, 1)), (None, "block", D(2024, 1, 1)), ("x.net", "what", D(2024, 1, 1))]
    url = "http://u@sub.BAD.org:80/p?q"
    captures = [(1, url, D(2024, 1, 31)), (1, url, D(2024, 2, 1)), (1, url, D(2024, 2, 29)), (1, url, D(2024, 3, 1)), (1, url, D(2024, 6, 1)), (2, "https://ok.bad.org/", D(2024, 2, 2)), (3, "http://site.net/A/B/c", D(2024, 1, 1)), (4, "http://site.net/a/bc", D(2024, 1, 1)), (5, None, D(2024, 1, 1)), (6, "no url", D(2024, 1, 1)), (7, url, None)]
    got = run(spark, [*captures, captures[0]], entries)
    assert len(got) == len(captures)
    assert [got[1, d][2] for d in (D(2024, 1, 31), D(2024, 2, 1), D(2024, 2, 29), D(2024, 3, 1), D(2024, 6, 1))] == [False, True, True, False, True]
    assert got[2, D(2024, 2, 2)] == (2, "ok.bad.org", False)
    assert got[3, D(2024, 1, 1)] == (1, "site.net/a/b", True) and got[4, D(2024, 1, 1)] == (0, None, False)
    assert all(got[k] == (0, None, False) for k in ((5, D(2024, 1, 1)), (6, D(2024, 1, 1)), (7, None)))


def test_long_keys(spark, monkeypatch):
    long = f"track.net/{'s' * 3000}"
    captures = [(1, f"http://track.net/{'S' * 3000}/a", D(2024, 2, 1)), (2, f"http://track.net/{'s' * 2999}", D(2024, 2, 1))]
    entries = [(long, "block", D(2024, 1, 1)), ("track.net", "allow", D(2024, 1, 1))]
    want = {(1, D(2024, 2, 1)): (2, long, True), (2, D(2024, 2, 1)): (1, "track.net", False)}
    assert run(spark, captures, entries) == want
    monkeypatch.setattr(U, "BROADCAST_BYTES", 2000)
    assert run(spark, captures, entries) == want


def test_urls_of_many_sections_and_labels(spark):
    deep, wide = "/s" * 100_000, "h." * 50_000
    captures = [(1, f"http://site.net{deep}", D(2024, 1, 1)), (2, f"http://{wide}site.net/x", D(2024, 1, 1)), (3, "http://a.site.net/s", D(2024, 1, 1))]
    entries = [("site.net", "block", D(2024, 1, 1)), ("site.net/s/s/s", "allow", D(2024, 1, 1)), ("/s", "block", D(2024, 1, 1))]
    first = D(2024, 1, 1)
    assert run(spark, captures, entries) == {(1, first): (2, "site.net/s/s/s", False), (2, first): (1, "site.net", True), (3, first): (1, "site.net", True)}
    assert run(spark, captures, entries[1:2])[1, first] == (1, "site.net/s/s/s", False)


def test_repeated_captures_count_once(spark):
    captures = [(1, "http://a.b.c/d", D(2024, 2, 1))] * 7 + [(2, None, None)] * 3
    entries = [(k, "block", D(2024, 1, 1)) for k in ("b.c", "a.b.c/d", "c")]
    assert run(spark, captures, entries) == {(1, D(2024, 2, 1)): (3, "a.b.c/d", True), (2, None): (0, None, False)}


def test_without_broadcast(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    first = U.evaluate(U.captures_of(pages), U.dated_list(pages)).collect()
    monkeypatch.setattr(U, "BROADCAST_ROWS", 0)
    assert sorted(map(str, U.evaluate(U.captures_of(pages), U.dated_list(pages)).collect())) == sorted(map(str, first))


def test_empty(spark):
    assert run(spark, [], []) == {}
    assert run(spark, [(1, "http://a.b/", D(2024, 1, 1))], []) == {(1, D(2024, 1, 1)): (0, None, False)}
