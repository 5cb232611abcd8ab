"""Toxicity: a support vector machine over a gap-weighted subsequence kernel with Nystrom landmarks.

The kernel compares words by their subsequences of three characters (word ends count as characters)
that span at most five, each weighted by DECAY for every character it skips, normalised and raised to POWER.
So an insult with a character put in, or with gaps, still resembles its plain form; besides, a word is also taken
without its punctuation, if two letters are left, and a run of single characters is also taken as one word.
A text's similarity to a landmark is that of its most similar word; whole texts are read.

A second fit also learns the rows of label 1 as they would be with a letter put into, or left out of, the landmarks in them, which is what weighs near words; the greater of both scores counts.

Learning: of the labelled rows, at most about `sample_rows` (by hash of the id, half of them of each label where there are
enough) are used. Their words are counted by label; the words most associated with label 1 (by a log-likelihood
gain of at least `least_gain`), unlike each other, become the `landmarks`. All their letters count, in any number of scripts: subsequences
are looked up in a table, or by bisection where there are more than DIRECT letters. Nystrom's map turns similarities to landmarks into features, a linear support vector machine (squared hinge,
Newton steps) is fitted on the driver on sample_rows x landmarks numbers, and a logistic fit makes scores of margins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import fold, materialize

DECAY, POWER, LEAST = 0.6, 3, 0.47
PATTERNS = [((0, 1, 2), 1.0), ((0, 1, 3), DECAY), ((0, 2, 3), DECAY), ((0, 1, 4), DECAY**2), ((0, 2, 4), DECAY**2), ((0, 3, 4), DECAY**2)]
ENDS = "\x02", "\x03"
SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_]\W){3,}[^\W\d_](?!\S)")
MARKS = re.compile(r"[\W\d_]+")
CACHE = 1 << 20
SHARE = 0.25
DIRECT = 160


def plain(word: str) -> str:
    """A word's letters only."""
    return word if word.isalpha() else MARKS.sub("", word)


def norm(word: str) -> float:
    """The length of a word's vector of subsequences; equal ones count together."""
    w, sums = f"{ENDS[0]}{word}{ENDS[1]}", {}
    for (a, b, c), weight in PATTERNS:
        for i in range(len(w) - c):
            u = w[i + a], w[i + b], w[i + c]
            sums[u] = sums.get(u, 0.0) + weight
    return max(1e-9, sum(x * x for x in sums.values()) ** 0.5)


def words_of(text: str | None) -> set[str]:
    low = (text or "").lower()
    found = set(low.split())
    found.update(plain(m[0]) for m in SPELLED.finditer(low))
    return found


def units(words: set[str]) -> set[str]:
    return {p for w in words if len(p := plain(w)) > 1}


class Kernel:
    """Similarities of words to landmarks."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        letters = sorted({c for w in landmarks for c in w} - {*ENDS})
        self.ids = np.zeros(0x110000, np.int32)
        self.ids[[ord(c) for c in (*ENDS, *letters)]] = np.arange(1, len(letters) + 3)
        self.base = len(letters) + 3
        self.cache: dict[str, np.ndarray | None] = {}
        grams: dict[int, dict[int, float]] = {}
        for j, w in enumerate(landmarks):
            word, code, weight = self._codes([w])
            keep = code > 0
            for c, x in zip(code[keep].tolist(), weight[keep].tolist(), strict=True):
                grams.setdefault(c, {})[j] = grams.get(c, {}).get(j, 0.0) + x
        self.codes = np.array(sorted(grams), np.int64)
        self.index = np.full(self.base**3 if self.base <= DIRECT else 0, -1, np.int32)
        self.table = np.zeros((len(grams), len(landmarks)), np.float32)
        for u, (c, row) in enumerate(sorted(grams.items())):
            if len(self.index):
                self.index[c] = u
            for j, x in row.items():
                self.table[u, j] = x
        self.norms = np.maximum(1e-9, np.sqrt((self.table.astype(float) ** 2).sum(0)))
        self.most = (self.table / self.norms).max(1, initial=0.0)

    def _codes(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, code, weight) of every subsequence; the code of one with a letter that no landmark has is below 0."""
        joined = "".join(f"{ENDS[0]}{w}{ENDS[1]}" for w in words)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ids = self.ids[points].astype(np.int32 if self.base <= DIRECT else np.int64)
        lengths = np.array([len(w) + 2 for w in words])
        owner, n = np.repeat(np.arange(len(words)), lengths), len(points)
        out = []
        for (a, b, c), weight in PATTERNS:
            if n <= c:
                continue
            same = owner[: n - c] == owner[c:]
            x, y, z = ids[a : n - c + a][same], ids[b : n - c + b][same], ids[c:][same]
            code = (x * self.base + y) * self.base + z
            code[(x == 0) | (y == 0) | (z == 0)] = -1
            out.append((owner[: n - c][same], code, np.full(len(code), weight, np.float32)))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]

    def _rows(self, code: np.ndarray) -> np.ndarray:
        """The table's row of each code, -1 for codes of no landmark."""
        if len(self.index) or not len(self.codes):
            return self.index[code] if len(self.index) else np.full(len(code), -1, np.int32)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, at, -1)

    def _block(self, words: list[str]) -> np.ndarray:
        owner, code, weight = self._codes(words)
        row = np.where(code > 0, self._rows(np.maximum(code, 0)), -1)
        hit = np.flatnonzero(row >= 0)
        square = np.bincount(owner, weight**2, len(words))
        # no landmark can be nearer than the sum of what each of a word's subsequences adds to the landmark it adds most to
        most = np.bincount(owner[hit], weight[hit] * self.most[row[hit]], len(words))
        hit = hit[(most >= LEAST * np.sqrt(square) - 1e-6)[owner[hit]]]
        hit = hit[np.argsort(owner[hit], kind="stable")]
        dots = np.zeros((len(words), len(self.landmarks)), np.float32)
        if len(hit):
            at = np.flatnonzero(np.diff(owner[hit], prepend=-1))
            dots[owner[hit][at]] = np.add.reduceat(self.table[row[hit]] * weight[hit, None], at, axis=0)
        like = dots / (np.sqrt(np.maximum(square, 1e-9))[:, None] * self.norms).astype(np.float32)
        hot = np.flatnonzero(like.max(1, initial=0.0) >= LEAST)
        for i in hot.tolist():
            like[i] = dots[i] / (norm(words[i]) * self.norms)
        return np.where(like >= LEAST, np.minimum(like, 1.0), 0.0)

    def similar(self, words: set[str]) -> None:
        """Puts the similarities of words in the cache: None where no landmark is near."""
        if len(self.cache) > CACHE:
            self.cache.clear()
        new = sorted({w for w in words if w not in self.cache})
        for a in range(0, len(new), 8_000):
            part = new[a : a + 8_000]
            pure = [plain(w) for w in part]
            like = self._block(pure)
            any_ = like.any(1)
            for w, p, x, yes in zip(part, pure, like, any_, strict=True):
                self.cache[w] = x**POWER if yes and len(p) > 1 else None

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Each text's greatest similarity to each landmark."""
        out = np.zeros((len(texts), len(self.landmarks)), np.float32)
        if not self.landmarks:
            return out
        for a in range(0, len(texts), 512):
            sets = [words_of(t) for t in texts[a : a + 512]]
            self.similar(set().union(*sets))
            for i, found in enumerate(sets):
                near = [x for w in found if (x := self.cache[w]) is not None]
                if near:
                    out[a + i] = np.max(near, axis=0)
        return out


class Machine:
    """Nystrom's map, the linear machine and the logistic fit of its margins."""

    def __init__(self, kernel: Kernel, x: np.ndarray, y: np.ndarray, more: np.ndarray, cost: float = 10.0):
        """x, y: the labelled rows' features and labels; more: features of further rows of label 1, which a second margin learns too. In that one's scale they have SHARE of a labelled row's weight."""
        self.kernel = kernel
        base = kernel.features(list(kernel.landmarks)).astype(float)
        values, vectors = np.linalg.eigh((base + base.T) / 2 + 1e-3 * np.eye(len(base))) if len(base) else (np.ones(0), np.zeros((0, 0)))
        keep = values > 1e-3
        self.map = vectors[:, keep] / np.sqrt(values[keep])
        self.fits = [(np.zeros(keep.sum() + 1), 1.0, -4.0)]
        ones = int((y == 1).sum())
        if 0 < ones < len(y):
            z, signs = self._expand(x), np.where(y == 1, 1.0, -1.0)
            self.fits = [self._scaled(self._fit(z, signs, cost), z, y == 1)]
            if len(more):
                both = np.concatenate([z, self._expand(more)])
                ones = np.ones(len(more))
                self.fits.append(self._scaled(self._fit(both, np.append(signs, ones), cost), both, np.append(y == 1, ones), np.append(np.ones(len(y)), SHARE * ones)))
        elif len(y):
            rate = min(max((ones + 0.5) / (len(y) + 1), 1e-3), 1 - 1e-3)
            self.fits = [(self.fits[0][0], 0.0, float(np.log(rate / (1 - rate))))]

    def _expand(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x.astype(float) @ self.map, np.ones((len(x), 1))], 1)

    def _fit(self, z: np.ndarray, y: np.ndarray, cost: float) -> np.ndarray:
        w, ridge = np.zeros(z.shape[1]), np.eye(z.shape[1])
        ridge[-1, -1] = 1e-6
        for _ in range(30):
            active = y * (z @ w) < 1
            new = np.linalg.solve(ridge / cost + z[active].T @ z[active], z[active].T @ y[active])
            if np.abs(new - w).max() < 1e-6:
                break
            w = new
        return w

    def _scaled(self, w: np.ndarray, z: np.ndarray, t: np.ndarray, weight: np.ndarray | float = 1.0) -> tuple[np.ndarray, float, float]:
        m = z @ w
        ab = np.array([1.0, 0.0])
        design = np.stack([m, np.ones_like(m)], 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ ab, -30, 30)))
            step = np.linalg.solve((design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2), design.T @ (weight * (t - p)) - 1e-3 * ab)
            ab = ab + np.clip(step, -2, 2)
        return w, float(ab[0]), float(ab[1])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        z = self._expand(self.kernel.features(texts))
        return np.max([1 / (1 + np.exp(-np.clip(slope * (z @ w) + offset, -30, 30))) for w, slope, offset in self.fits], axis=0)


def _sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """(text, toxic) of about sample_rows labelled rows, chosen by hash."""
    toxic = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    counts = {r.toxic: r.n for r in toxic.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    half = max(sample_rows // 2, 1)
    share = F.when(F.col("toxic") == 1, min(1.0, half / max(1, counts.get(1, 0)))).otherwise(min(1.0, half / max(1, counts.get(0, 0))))
    chosen = toxic.where((F.shiftrightunsigned(F.xxhash64("doc_id"), 1) / F.lit(float(1 << 63))) < share)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tally: dict[str, list[int]] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for w in units(words_of(text)):
                tally.setdefault(w, [0, 0])[toxic] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.string()), pa.array([v[0] for v in tally.values()], pa.int64()), pa.array([v[1] for v in tally.values()], pa.int64())], ["word", "zeros", "ones"])


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, landmarks: int = 64, least_gain: float = 5.0) -> Machine:
    """docs(doc_id, text) and labels(doc_id, toxic) to learn from -> a machine. Rows without text, label or id teach nothing; of several labels the highest counts."""
    sample = materialize(_sample(docs.where("text IS NOT NULL"), labels, sample_rows), "labelled")
    words = sample.mapInArrow(_count, "word string, zeros long, ones long").groupBy("word").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    ones, zeros = (max(1, v) for v in sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first())
    share = F.lit(ones / (ones + zeros)) * (F.col("ones") + F.col("zeros"))
    rest = F.lit(zeros / (ones + zeros)) * (F.col("ones") + F.col("zeros"))
    gain = F.col("ones") * F.log((F.col("ones") + 0.1) / (share + 0.1)) + F.col("zeros") * F.log((F.col("zeros") + 0.1) / (rest + 0.1))
    top = words.where((gain >= least_gain) & (F.col("ones") > share)).select("word", gain.alias("gain")).orderBy(F.desc("gain"), "word").limit(8 * landmarks).collect()
    names = [r.word for r in top]
    chosen: list[str] = []
    if names:
        like = Kernel(names).features(list(names)) ** (1 / POWER)
        picked: list[int] = []
        for i in range(len(names)):
            if len(picked) < landmarks and all(like[i, j] < 0.7 for j in picked):
                picked.append(i)
        chosen = [names[i] for i in picked]
    sent = docs.sparkSession.sparkContext.broadcast(chosen)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = Kernel(sent.value)
        for batch in batches:
            x = kernel.features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column("toxic")], ["x", "toxic"])

    rows = sample.mapInArrow(features, "x binary, toxic int").toArrow().sort_by([("x", "ascending"), ("toxic", "ascending")])
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(rows.num_rows, len(chosen))
    kernel, y = Kernel(chosen), rows.column("toxic").to_numpy()
    return Machine(kernel, x, y, disguised(kernel, x[y == 1]))


def disguised(kernel: Kernel, x: np.ndarray) -> np.ndarray:
    """Features of labelled rows as they would be with one letter put into, or left out of, each landmark that stands in them; rows without one are left out."""
    if not len(x) or not kernel.landmarks:
        return x[:0]
    stands, weak = x > 0.999, []
    for j, w in enumerate(kernel.landmarks):
        near = kernel.features([w[:i] + mark + w[i + skip :] for i in range(1, len(w)) for mark, skip in (("x", 0), ("", 1))])
        weak.append(near[np.argsort(np.where(near[:, j] > 0, near[:, j], 2.0), kind="stable")[:4]])  # those that are least like it
    out = [np.max([weak[j][k % len(weak[j])] for j in np.flatnonzero(s)], axis=0) for k, s in enumerate(stands) if s.any()]
    return np.array(out, np.float32).reshape(-1, x.shape[1])


def _scorer(sent, finish):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = sent.value
        for batch in batches:
            yield finish(batch, machine.scores(batch.column("text").to_pylist()) if batch.num_rows else np.zeros(0))

    return run


def learning_rows(docs: DataFrame, folds: int, held: int) -> DataFrame:
    return docs.where(F.coalesce(fold(docs.doc_id, folds) != held, F.lit(False)))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.3, **limits) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, toxic) -> doc_id, held_out, score, predicted: a row for each row of docs.

    Learns from rows whose crc32(doc_id) mod folds is not held; labels, lang, source and doc_id are not inputs of a
    score. Null and empty texts score as texts without an insult. With labels of one kind only the score is their rate;
    without labels it is near 0. Repeated and null doc_ids keep their rows; other columns are ignored; an empty table gives none.
    """
    docs = docs.select("doc_id", "text")
    machine = learn(learning_rows(docs, folds, held), labels, **limits)
    marked = docs.select("doc_id", F.coalesce(fold(docs.doc_id, folds) == held, F.lit(False)).alias("held_out"), "text")

    def finish(batch, scores):
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return marked.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(machine), finish), "doc_id long, held_out boolean, score double, predicted int")


def reject(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, threshold: float = 0.3, **limits) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns, whatever their names; nothing is shuffled but the sample.

    Null and empty texts score as texts without an insult, rows without doc_id teach nothing; repeated rows go or stay alike; without labels all stay; an empty table gives none.
    """
    machine = learn(learning_rows(docs.select("doc_id", "text"), folds, held), labels, **limits)
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    return docs.mapInArrow(_scorer(sent, lambda batch, scores: batch.filter(pa.array(scores < threshold))), docs.schema)
