"""Language identification by compression: the language whose dictionary compresses a text best.

Each learned language has a zstandard raw-content dictionary of at most `dictionary_bytes`, cut from a bounded
sample: for each of BUCKETS hash buckets the learning row with the least hash, at most BUCKETS rows a language.
Every language that occurs is learned; dictionaries of LANGUAGES at a time are broadcast, with a pass over the texts for each such block. A text is compressed whole (lower-cased, with a blank for whatever isn't a letter), in blocks of `block` characters,
with every dictionary; sizes are summed, the language's share of the learning rows adds its cost (the negative binary logarithm, in bytes), and
the smallest wins (ties: the first language in order). The score compares the sizes; margins under `margin` of the best size are marked as rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import fold, materialize

BUCKETS = 256
LANGUAGES = 64
LEVEL = 6
LETTER = re.compile(r"[^\W\d_]")
OTHERS = re.compile(r"[\W\d_]+")


def normal(text: str) -> str:
    return OTHERS.sub(" ", text.lower())


def learned(rows: DataFrame) -> dict[str, int]:
    """rows(doc_id, text, lang) to learn from -> rows by language, in order of its name. Rows without text, lang or id teach nothing."""
    full = rows.where("lang IS NOT NULL AND doc_id IS NOT NULL AND length(text) > 0")
    return dict(sorted((r.lang, r.n) for r in full.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()))


def dictionaries(rows: DataFrame, counts: dict[str, int], names: list[str], dictionary_bytes: int = 112_640) -> dict[str, tuple[bytes, float]]:
    """rows(doc_id, text, lang) to learn from and their number by language -> raw dictionary content and share of the languages in names."""
    rows = rows.where("lang IS NOT NULL AND doc_id IS NOT NULL").where(F.col("lang").isin(names))
    marked = rows.select("lang", F.xxhash64("doc_id").alias("h"), "text")
    bucket = F.shiftrightunsigned("h", 56).alias("bucket")
    full = marked.where("length(text) > 0")
    least = full.groupBy("lang", bucket).agg(F.min("h").alias("h"))
    chosen = least.select("lang", "h")
    each = 16 * dictionary_bytes // BUCKETS
    cut = F.expr(f"substring(text, greatest(1, int(length(text) / 2) - {each // 2}), {each})")
    sample: dict[str, dict[int, str]] = {}
    for r in full.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min(cut).alias("text")).orderBy("lang", "h").toLocalIterator():
        sample.setdefault(r.lang, {})[r.h] = r.text
    out = {}
    for lang, texts in sorted(sample.items()):
        share = max(64, dictionary_bytes // len(texts))
        pieces = dict.fromkeys(normal(t)[: 4 * share].encode()[:share] for t in texts.values())
        rest = dict.fromkeys(normal(t).encode()[share : 8 * share] for t in texts.values())
        content = b" ".join(pieces)
        content = (b" ".join(rest) + b" ")[: max(0, dictionary_bytes - len(content))] + content
        if len(content) >= 8:
            out[lang] = content[-dictionary_bytes:], counts[lang] / sum(counts.values())
    return out


class Judge:
    """Compressors for each language; made once in each worker."""

    def __init__(self, content: dict[str, tuple[bytes, float]], block: int, margin: float):
        self.block, self.margin, self.names = block, margin, sorted(content)
        self.prior = [-math.log2(content[name][1]) / 8 for name in self.names]
        self.compressors = []
        for name in self.names:
            d = zstandard.ZstdCompressionDict(content[name][0], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def sizes(self, text: str) -> list[float]:
        data = normal(text)
        blocks = [data[i : i + self.block].encode("utf-8", "surrogatepass") for i in range(0, len(data), self.block)]
        return [p + sum(len(c.compress(b)) for b in blocks) for p, c in zip(self.prior, self.compressors, strict=True)]

    def weigh(self, text: str | None) -> tuple[str, float, float, float] | None:
        """(best language, its size, the second size, the sum of all languages' weights against the best); None where nothing can be said."""
        if not text or not self.names or not LETTER.search(text):
            return None
        sizes = self.sizes(text)
        best = min(sizes)
        at = sizes.index(best)
        return self.names[at], best, min((s for i, s in enumerate(sizes) if i != at), default=math.inf), sum(2.0 ** max(-60, best - s) for s in sizes)

    def judge(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score from 0 to 1, whether the margin is too narrow)."""
        return verdict(self.weigh(text), self.margin)


def merged(a: tuple | None, b: tuple | None) -> tuple | None:
    """What two blocks of languages say together; a's come first in order."""
    if not a or not b:
        return a or b
    best = min(a[1], b[1])
    return (a if a[1] <= b[1] else b)[0], best, min(a[2], b[2], max(a[1], b[1])), sum(x[3] * 2.0 ** max(-60, best - x[1]) for x in (a, b))


def verdict(found: tuple | None, margin: float) -> tuple[str, float, bool]:
    return (found[0], 1 / found[3], found[2] - found[1] < margin * found[1]) if found else ("und", 0.0, True)


def identify(docs: DataFrame, folds: int = 4, held: int = 2, block: int = 512, margin: float = 0.01, **limits) -> DataFrame:
    """docs(doc_id, text, lang) -> doc_id, held_out, lang_pred, score, rejected: a row for each row.

    Rows whose crc32(doc_id) mod folds is held teach nothing (rows with null ids don't either); lang, source and doc_id are not inputs of a prediction.
    Null texts and texts without a letter get und, score 0. Equal texts get equal results. If nothing can be
    learned, all get und. Other columns are ignored; an empty table gives none.
    """
    marked = docs.select("doc_id", "text", "lang", F.coalesce(fold(docs.doc_id, folds) == held, F.lit(False)).alias("held_out"))
    learning = marked.where("NOT held_out")
    counts = learned(learning)
    names = list(counts)
    rows, state = marked.select("doc_id", "held_out", "text"), ("name", "best", "second", "weight")

    def judged(sent, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            judge = Judge(sent.value, block, margin)
            for batch in batches:
                found = [judge.weigh(t.as_py()) for t in batch.column("text")]
                if "name" in batch.schema.names:
                    before = zip(*(batch.column(k).to_pylist() for k in state), strict=True)
                    found = [merged(b if b[0] is not None else None, f) for b, f in zip(before, found, strict=True)]
                if last:
                    found, types, out, keep = [verdict(f, margin) for f in found], (pa.string(), pa.float64(), pa.bool_()), ("lang_pred", "score", "rejected"), 2
                else:
                    found, types, out, keep = [f or (None,) * 4 for f in found], (pa.string(), *(pa.float64(),) * 3), state, 3
                columns = [pa.array([f[k] for f in found], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:keep], *columns], [*batch.schema.names[:keep], *out])

        return run

    for a in range(0, max(1, len(names)), LANGUAGES):
        last = a + LANGUAGES >= len(names)
        sent = docs.sparkSession.sparkContext.broadcast(dictionaries(learning, counts, names[a : a + LANGUAGES], **limits) if names else {})
        if last:
            return rows.mapInArrow(judged(sent, True), "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
        rows = materialize(rows.mapInArrow(judged(sent, False), "doc_id long, held_out boolean, text string, name string, best double, second double, weight double"), "languages")
