import hashlib
import random
import re

from parley.llm import pii as P


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (P.KINDS.index(s[0]), s[1]))


def check(spark, rows):
    got = {r.doc_id: r for r in P.detect(spark.createDataFrame([(*x, "q") for x in rows], "doc_id long, text string, found string")).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        want, x = brute(t or ""), got[i]
        line = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert (x.n_email, x.n_ip, x.n_card, x.n_phone) == tuple(sum(k == kind for k, _, _ in want) for kind in P.KINDS), repr(t)
        assert x.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), repr(t)
        assert {*filter(None, line.split(","))} <= {*filter(None, x.spans.split(","))}
    return got


def test_base_against_brute_force(spark):
    r = random.Random(8)
    bits = ["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 555-1234", "+", "1.2.3.4", "300.1.1.1", "0001.2.3.255", "a.b@c.de", "@", "x@y", ".", "-", " ", "é", "7", "12345678901234567890123", "word", "\n", "𝄞", "(", ")", "a@b.c_d@e.f", "user at host dot com", "5", "_"]
    rows = [(i, "".join(r.choice(bits) for _ in range(r.choice([0, 2, 6, 20])))) for i in range(500)]
    rows += [(900, None), (901, ""), (902, "9" * 50_000), (903, "a" * 50_000 + "@x.yz"), (904, "+1" + " " * 20_000), (905, "10.0.0.1 " * 3000), (906, "x@y.zz " * 200 + "é" * 10)]
    check(spark, rows)


def test_added_spans(spark):
    rows = [(1, "contact ana.m [at] host [dot] org now"), (2, "phone (212) 555-0187 ok"), (3, "they met at noon. Then left at two"), (4, "order no. 212-555-0187"), (5, "no data here 12:30:45:10")]
    got = check(spark, rows)
    spans = lambda i: [s.split(":")[0] for s in got[i].spans.split(",") if s]
    assert spans(1) == ["email"] and spans(2) == ["phone"]
    assert spans(3) == [] and spans(4) == [] and spans(5) == []


def test_trees_as_expression(spark):
    model, _ = P.train(spark)
    flat = P.candidates(spark.createDataFrame(P.sentences(200, 3), "row long, text string, label int")).select("label", P.F.explode("found").alias("c"))
    rows = flat.select("label", P.scored(model, P.F.col("c")).alias("s"), *[f"c.{f}" for f in P.FEATURES]).collect()
    assert all(abs(r.s - P.predicted(model, tuple(r[f] for f in P.FEATURES))) < 1e-9 for r in rows)
    assert sum((r.s > 0) == (r.label == 1) for r in rows) / len(rows) > 0.9


def test_empty_table(spark):
    assert P.detect(spark.createDataFrame([], "doc_id long, text string")).collect() == []
