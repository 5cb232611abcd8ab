"""Personal data: high-recall span generators, boosted trees over format and context, calibrated thresholds; DataFrame operations only.

Four base patterns give spans that always stay. Wider generators propose more, overlapping them: e-mail addresses written out
("name at host dot org", "name [at] host.org"), IPv6 and spaced IPv4 addresses, card numbers in odd groups, phone numbers
without a plus. Each candidate has small whole-number features of its form and of the characters before and after it. Boosted trees
are trained on labelled sentences that this module generates by rule (`training_rows` of them, seeded), whose candidates pass
through the same expressions and are counted by feature vector before they reach the driver. Half of the sentences fits the trees, the
other half sets for each kind the least score from which its precision is at least PRECISION. The trees become one
SQL expression. Proposals from there on are added unless a base span holds them or a better proposal overlaps them.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# The base patterns, in the possessive form that can't backtrack, then the wider generators.
GENERATORS = [
    ("email", True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", True, r"[0-9](?:[ -]?+[0-9]){12,}+", None),
    ("phone", True, r"\+[0-9][ ().0-9-]+[0-9]", "+"),
    ("email", False, r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?[\[({]? ?(?:at|@) ?[\])}]? ?[a-z0-9-]{1,63}+(?: ?[\[({]? ?(?:dot|\.) ?[\])}]? ?[a-z0-9-]{2,63}+){1,5}+", None),
    ("ip", False, r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}+[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])", ":"),
    ("ip", False, r"(?<![0-9.])[0-9]{1,3}+ ?(?:\.|\[\.\]|\(dot\)) ?[0-9]{1,3}+ ?(?:\.|\[\.\]|\(dot\)) ?[0-9]{1,3}+ ?(?:\.|\[\.\]|\(dot\)) ?[0-9]{1,3}+(?![0-9.])", None),
    ("card", False, r"(?<![0-9])[0-9]{4}(?:[ ./_-]{1,3}[0-9]{4}){2}[ ./_-]{1,3}[0-9]{1,7}+(?![0-9])", None),
    ("phone", False, r"(?<![0-9.+])(?:00[1-9][0-9]{0,2}[ ./-]?)?\(?[0-9]{3}\)?[ ./-][0-9]{3}[ ./-][0-9]{4}(?![0-9.])", None),
]
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|address)",
    "ip": r"(?i)(?:\bip\b|addr|host|server|client|login|from)",
    "card": r"(?i)(?:card|visa|amex|master|credit|debit|payment)",
    "phone": r"(?i)(?:phone|call|tel|mobile|cell|fax|dial|whatsapp)",
}
AGAINST = r"(?i)(?:version|release|build|isbn|order|invoice|serial|part|chapter|section|id|no)[.:# ]*$"
FEATURES = ("kind", "wide", "digits", "luhn", "octets", "mark", "before", "after", "cue", "against", "dots", "written")
TREES, DEPTH, RATE, PRECISION = 24, 3, 0.4, 0.95
CONTEXT = 24


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, i, F.lit(1)).cast("int")
    doubled = lambda i: F.when((n - i) % 2 == 0, value(i)).otherwise(F.when(value(i) > 4, value(i) * 2 - 9).otherwise(value(i) * 2))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda total, i: total + doubled(i)) % 10 == 0).otherwise(False)


def side(c: Column) -> Column:
    """0 nothing or white space, 1 a letter, 2 a digit, 3 another sign."""
    return F.when((c == "") | c.rlike(r"^\s"), 0).when(c.rlike(r"^[\p{L}_]"), 1).when(c.rlike("^[0-9]"), 2).otherwise(3)


def _described(kind: str, base: bool, found: Column, start: Column, left: Column, right: Column) -> Column:
    """A candidate as a struct: kind, whether it is a valid base match, span and features."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    n = F.length(digits)
    parts = F.filter(F.split(found, "[^0-9]+"), lambda p: p != "")
    octets = F.forall(parts, lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    passes = luhn(F.when(n <= 19, digits).otherwise(F.lit("")))
    valid = {"email": F.lit(True), "ip": octets, "card": n.between(13, 19) & passes, "phone": n.between(9, 15)}[kind]
    number = lambda b: b.cast("int")
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"),
        (F.lit(base) & valid).alias("base"),
        start.cast("long").alias("start"),
        (start + F.length(found)).cast("long").alias("end"),
        F.lit(int(not base)).alias("wide"),
        F.least(n, F.lit(20)).alias("digits"),
        number(passes).alias("luhn"),
        number(octets).alias("octets"),
        F.when(found.contains("@"), 1).when(found.startswith("+"), 2).when(found.contains("("), 3).when(found.contains(":"), 4).when(found.contains("-"), 5).when(found.contains(" "), 6).otherwise(0).alias("mark"),
        side(F.right(left, F.lit(1))).alias("before"),
        side(F.left(right, F.lit(1))).alias("after"),
        number(left.rlike(CUES[kind])).alias("cue"),
        number(left.rlike(AGAINST)).alias("against"),
        F.least(F.size(F.split(found, r"\.")) - 1, F.lit(5)).alias("dots"),
        F.when(found.rlike(r"(?i)[\[({] ?(?:at|dot|@|\.) ?[\])}]"), 2).when(found.rlike(r"(?i) at | dot "), 1).otherwise(0).alias("written"),
    )


def candidates(docs: DataFrame) -> DataFrame:
    """docs with text, and a column found: an array of every generator's candidates in the text. Null texts count as empty.

    A match's position is the total length of what is before it: the pieces between matches and the matches, summed in two levels, 64 at a time.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    hits = docs.withColumns({f"_h{g}": F.when(text.contains(need) if need else F.lit(True), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))) for g, (_, _, pattern, need) in enumerate(GENERATORS)})
    some = lambda g: F.size(f"_h{g}") > 0
    gaps = hits.withColumns({f"_g{g}": F.when(some(g), F.split(text, pattern, -1)) for g, (_, _, pattern, _) in enumerate(GENERATORS)})
    steps = gaps.withColumns({f"_s{g}": F.zip_with(F.slice(f"_g{g}", F.lit(1), F.size(f"_h{g}")), f"_h{g}", lambda a, b: F.length(a) + F.length(b)) for g in range(len(GENERATORS))})
    summed = lambda c: F.aggregate(c, F.lit(0), lambda t, x: t + x)

    def prefixes(g: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.expr(f"cast(size(_h{g}) div 64 AS INT)")), lambda b: summed(F.slice(f"_s{g}", F.lit(1), b * 64)))

    blocks = steps.withColumns({f"_b{g}": F.when(some(g), prefixes(g)) for g in range(len(GENERATORS))})

    def described(g: int, kind: str, base: bool) -> Column:
        def one(found: Column, k: Column) -> Column:
            within = summed(F.slice(f"_s{g}", (F.floor(k / 64) * 64 + 1).cast("int"), k % 64))
            left, right = F.get(f"_g{g}", k), F.get(f"_g{g}", k + 1)
            start = F.get(f"_b{g}", F.floor(k / 64).cast("int")) + within + F.length(left)
            return _described(kind, base, found, start, F.right(left, F.lit(CONTEXT)), right)

        return F.when(some(g), F.transform(f"_h{g}", one))

    listed = blocks.withColumns({f"_c{g}": described(g, kind, base) for g, (kind, base, _, _) in enumerate(GENERATORS)})
    every = F.flatten(F.filter(F.array(*[F.col(f"_c{g}") for g in range(len(GENERATORS))]), lambda c: c.isNotNull()))
    return listed.withColumn("found", every).drop(*[f"_{c}{g}" for c in "hgsbc" for g in range(len(GENERATORS))])


def sentences(rows: int, seed: int = 17) -> list[tuple[int, str, int]]:
    """Generated (row, sentence, label): whether the sentence's candidate is personal data."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["ka", "to", "rin", "mel", "sa", "ver", "no"]) for _ in range(r.choice([1, 2, 3])))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = r.choice("3456") + digits(14)
        total = sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(body))
        return body + str(-total % 10)

    def grouped(d: str, by: str) -> str:
        return by.join(d[i : i + 4] for i in range(0, len(d), 4))

    octet = lambda: str(r.randrange(256))
    makers = [
        (1, "email", lambda: f"{word()}.{word()} {r.choice(['[at]', '(at)', '{at}'])} {word()} {r.choice(['[dot]', '(dot)'])} {r.choice(['com', 'org', 'net'])}"),
        (1, "email", lambda: f"{word()}[at]{word()}.{r.choice(['com', 'org', 'de'])}"),
        (1, "email", lambda: f"{word()}{digits(2)} at {word()} dot {r.choice(['com', 'org', 'net'])}"),
        (1, "email", lambda: f"{word()}@{word()}.example.{r.choice(['com', 'org'])}"),
        (0, None, lambda: f"{word()} at {word()}.{word().capitalize()}"),
        (0, None, lambda: f"{word()} at {word()}. {word()} {word()}"),
        (0, None, lambda: f"{word()} at the dot {word()}"),
        (1, "ip", lambda: ".".join(octet() for _ in range(4))),
        (1, "ip", lambda: "[.]".join(octet() for _ in range(4))),
        (1, "ip", lambda: ":".join(f"{r.randrange(65536):x}" for _ in range(8))),
        (0, None, lambda: ":".join(digits(2) for _ in range(4))),
        (0, None, lambda: " . ".join(digits(3) for _ in range(4))),
        (1, "card", lambda: grouped(card(), r.choice(["-", " "]))),
        (1, "card", lambda: grouped(card(), r.choice([".", "/", " - "]))),
        (0, None, lambda: grouped(digits(15) + "x", r.choice([".", "/", "-"]))[:-1]),
        (0, None, lambda: digits(16)),
        (1, "phone", lambda: f"+{digits(2)} ({digits(3)}) {digits(3)}-{digits(4)}"),
        (1, "phone", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}"),
        (0, "against", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}"),
        (0, None, lambda: f"{digits(3)}.{digits(3)}.{digits(4)}"),
    ]
    cues = {"email": ["email", "contact", "write to"], "ip": ["ip", "host", "server"], "card": ["card", "visa", "payment"], "phone": ["phone", "call", "tel"], "against": ["order no. ", "serial ", "part "]}
    out = []
    for i in range(rows):
        label, cue, maker = makers[i % len(makers)]
        lead = r.choice(cues[cue]) + r.choice([" ", ": "]) if cue and (cue == "against" or r.random() < 0.6) else ""
        out.append((i, f"{word()} {word()} {lead}{maker()}{r.choice(['', ' ', ', ', '. '])}{word() if r.random() < 0.7 else ''}", label))
    return out


def boost(vectors: Sequence[tuple[tuple[int, ...], float, float]], trees: int = TREES) -> list:
    """Boosted regression trees on (features, zeros, ones): a list whose first item is the first score, then nested (feature, cut, low, high) or leaf values."""
    ones, zeros = sum(v[2] for v in vectors) + 1.0, sum(v[1] for v in vectors) + 1.0
    first = math.log(ones / zeros)
    scores, model = [first] * len(vectors), [first]

    def grow(rows: list[int], depth: int, g: list[float], h: list[float]):
        sg, sh = sum(g[i] for i in rows), sum(h[i] for i in rows)
        value = RATE * sg / (sh + 1.0)
        if not depth:
            return value
        best = None
        for f in range(len(FEATURES)):
            for cut in sorted({vectors[i][0][f] for i in rows})[:-1]:
                lg, lh = (sum(x[i] for i in rows if vectors[i][0][f] <= cut) for x in (g, h))
                gain = lg * lg / (lh + 1) + (sg - lg) ** 2 / (sh - lh + 1) - sg * sg / (sh + 1)
                if gain > 1e-6 and (best is None or gain > best[0] + 1e-12):
                    best = gain, f, cut
        if best is None:
            return value
        _, f, cut = best
        return f, cut, grow([i for i in rows if vectors[i][0][f] <= cut], depth - 1, g, h), grow([i for i in rows if vectors[i][0][f] > cut], depth - 1, g, h)

    for _ in range(trees):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        g = [v[2] - (v[1] + v[2]) * q for v, q in zip(vectors, p, strict=True)]
        h = [(v[1] + v[2]) * q * (1 - q) for v, q in zip(vectors, p, strict=True)]
        tree = grow(list(range(len(vectors))), DEPTH, g, h)
        model.append(tree)
        scores = [s + leaf(tree, v[0]) for s, v in zip(scores, vectors, strict=True)]
    return model


def leaf(tree, features: Sequence[int]) -> float:
    while isinstance(tree, tuple):
        f, cut, low, high = tree
        tree = low if features[f] <= cut else high
    return tree


def predicted(model: list, features: Sequence[int]) -> float:
    return model[0] + sum(leaf(t, features) for t in model[1:])


def scored(model: list, candidate: Column) -> Column:
    """The model as an expression over a candidate's fields."""

    def of(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        f, cut, low, high = tree
        return F.when(candidate[FEATURES[f]] <= cut, of(low)).otherwise(of(high))

    total = F.lit(float(model[0]))
    for t in model[1:]:
        total = total + of(t)
    return total


def train(spark: SparkSession, training_rows: int = 2400) -> tuple[list, list[float]]:
    """(trees, least score by kind), from generated sentences."""
    rows = spark.createDataFrame(sentences(training_rows), "row long, text string, label int")
    flat = candidates(rows).select((F.floor(F.col("row") / len(KINDS) / 5) % 2).cast("int").alias("half"), "label", F.inline("found"))
    counted = flat.groupBy("half", *FEATURES).agg(F.sum(1 - F.col("label")).alias("zeros"), F.sum("label").alias("ones"))
    halves: tuple[list, list] = [], []
    for r in counted.orderBy("half", *FEATURES).collect():
        halves[r.half].append((tuple(r[f] for f in FEATURES), float(r.zeros), float(r.ones)))
    model = boost(halves[0])
    least = []
    for k in range(len(KINDS)):
        ranked = sorted(((predicted(model, v), z, o) for v, z, o in halves[1] if v[0] == k and v[1] == 1), reverse=True)
        cut, zeros, ones = math.inf, 0.0, 0.0
        for i, (s, z, o) in enumerate(ranked):
            zeros, ones = zeros + z, ones + o
            if ones >= PRECISION * (zeros + ones) and (i + 1 == len(ranked) or ranked[i + 1][0] < s):
                cut = s - 1e-9
        least.append(max(cut, 0.0))
    return model, least


def joined(found: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(found, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda c: F.concat_ws(":", F.get(name, c["kind"]), c["start"], c["end"])), ",")


def detect(docs: DataFrame, training_rows: int = 2400) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans: a row for each row.

    The counts and base_sha256 are of base spans; spans lists those and the added ones, by kind, then start. Positions are code points, ends
    exclusive. Null and empty texts have none (the empty string, and its SHA-256). Repeated and null doc_ids keep their rows; other columns are
    ignored; an empty table gives none.
    """
    model, least = train(docs.sparkSession, training_rows)
    cuts = F.array(*[F.lit(float(x) if math.isfinite(x) else 1e9) for x in least])
    found = candidates(docs.select("doc_id", "text")).select("doc_id", F.filter("found", lambda c: c["base"]).alias("base"), F.filter("found", lambda c: c["wide"] == 1).alias("wide"))
    overlaps = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    rated = F.transform("wide", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), scored(model, c).alias("score")))
    kept = found.select("doc_id", "base", F.when(F.size("wide") > 0, rated).alias("rated"))
    free = F.filter("rated", lambda c: (c["score"] >= F.get(cuts, c["kind"])) & ~F.exists("base", lambda b: overlaps(b, c)))
    rows = kept.select("doc_id", "base", F.when(F.size("rated") > 0, free).alias("free"))
    better = lambda a, b: (a["score"] > b["score"]) | ((a["score"] == b["score"]) & ((a["start"] < b["start"]) | ((a["start"] == b["start"]) & ((a["end"] > b["end"]) | ((a["end"] == b["end"]) & (a["kind"] < b["kind"]))))))
    best = F.filter("free", lambda c: ~F.exists("free", lambda o: overlaps(o, c) & better(o, c)))
    span = lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    every = F.concat(F.transform("base", span), F.coalesce(F.transform(best, span), F.array().cast("array<struct<kind:int,start:bigint,end:bigint>>")))
    count = lambda k: F.size(F.filter("base", lambda c: c["kind"] == k)).cast("long")
    return rows.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(every).alias("spans"))
