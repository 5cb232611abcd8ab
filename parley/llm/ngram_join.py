"""N-gram Jaccard self-join: size-banded tiles, bitmap bounds, exact sorted-array intersection.

Documents link when the Jaccard similarity of their shingle sets reaches `percent` / 100.

1. Equal sets are one class from the start (a 64-bit sum over the set names the class), so a group of
   copies costs one row, however large.
2. Sizes fall in bands whose upper end is 1.5 times the lower; a band is a tile. Linked sets of sizes
   a <= b have a >= b * percent / 100, so a set near the top of its band also joins the next tile, and every
   linked pair meets in the tile of the larger set. Within a tile linked sets differ in at most k elements. The
   tile deals hashed elements into k + 3 cells: at least three cells of a linked pair agree, and equal
   (tile, cell, content) keys bring the pair together. Nothing is lost by this (pigeonhole). Common
   passages make no large groups unless a whole cell, about 7 to 10 shingles dealt over the whole text,
   is common.
   Below CELLS_FROM percent cells would hold three shingles or fewer, so that common passages alone fill them. There, a tile's
   keys are BANDS bands of MinHash values, as many rows in each as keep the chance that a pair at the threshold has no key in
   common under MISS, one in ten million.
3. Per key with two or more classes, a pivot (the class with the largest share of keys that others
   have too) is compared with the others: a group of near copies costs rows in proportion to its size. Pairs
   that then are in one component need no more comparison. Of the keys that still hold several components, small
   ones give their pairs as rows, and large ones are dealt into blocks of at most about BLOCK classes; a
   task compares two blocks by their bitmaps and gives only the pairs that may link.
4. A pair is tried on bitmaps of the sets first (4 bits or more for each element, folded to the smaller one's width):
   their differing bits bound the overlap from above. Survivors are decided by intersecting the sorted hash arrays.
   For those, texts are read again; a bitmap of the wanted ids, of bounded size, keeps most others out of the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm import words as W
from parley.llm.common import materialize
from parley.llm.graph import components

U = np.uint64
LEAST_BITS, MOST_BITS = 64, 1 << 14
SPARE_CELLS = 2
CELLS_FROM, BANDS, MISS = 88, 32, 1e-7
SMALL_KEY = 16
BLOCK = 1024
WANTED_BITS = 1 << 28


def band_edges(limit: int = 1 << 40) -> np.ndarray:
    """Lower ends of the size bands: 1, 2, 3, 4, 6, 9, ... each 1.5 times the one before."""
    edges = [1]
    while edges[-1] < limit:
        edges.append(max(edges[-1] + 1, edges[-1] * 3 // 2))
    return np.array(edges, np.int64)


EDGES = band_edges()


def cells_of(band: int, percent: int) -> int:
    """Cells of a tile: one more than the differences a linked pair can have, and spare ones."""
    most = int(EDGES[band + 1]) - 1
    return 2 * most * (100 - percent) // (100 + percent) + 1 + SPARE_CELLS


def tiles_of(n: int, percent: int) -> tuple[int, ...]:
    """The bands whose tiles a set of n elements joins: its own, and the next one if a set there can be linked with it."""
    band = int(np.searchsorted(EDGES, n, "right")) - 1
    return (band, band + 1) if 100 * n >= percent * int(EDGES[band + 1]) else (band,)


def rows_of(percent: int) -> int:
    """MinHash values in a band: the most with (1 - t ** rows) ** BANDS under MISS."""
    return max(1, int(np.log(1 - MISS ** (1 / BANDS)) / np.log(percent / 100)))


_random = np.random.Generator(np.random.PCG64(20240611))
_TIMES = _random.integers(0, 1 << 63, 4096, dtype=np.uint64) * U(2) + U(1)
_PLUS = _random.integers(0, 1 << 63, 4096, dtype=np.uint64)


def band_keys(u: np.ndarray, percent: int) -> np.ndarray:
    """The (tile, band, MinHash values) keys of a shingle set."""
    rows = rows_of(percent)
    least = np.full(BANDS * rows, np.iinfo(np.uint64).max, U)
    for a in range(0, len(u), 256):
        least = np.minimum(least, (u[a : a + 256, None] * _TIMES[: len(least)] + _PLUS[: len(least)]).min(0))
    bands = np.zeros(BANDS, U)
    for column in least.reshape(BANDS, rows).T:
        bands = W.mix(bands ^ column) + U(0x9E3779B97F4A7C15)
    return np.concatenate([W.mix(bands ^ W.mix((U(tile + 1) << U(40)) + np.arange(BANDS).astype(U))) for tile in tiles_of(len(u), percent)])


def set_keys(u: np.ndarray, percent: int) -> np.ndarray:
    """The keys by which a set meets those it may be linked with."""
    return cell_keys(u, percent) if percent >= CELLS_FROM else band_keys(u, percent)


def cell_keys(u: np.ndarray, percent: int) -> np.ndarray:
    """The (tile, cell, content) keys of a sorted shingle set.

    At least SPARE_CELLS + 1 cells of a linked pair agree, so up to SPARE_CELLS empty cells give no key;
    a set with more empty cells gives keys for them too.
    """
    mixed, out = W.mix(u), []
    for tile in tiles_of(len(u), percent):
        cells = cells_of(tile, percent)
        cell = ((u >> U(32)) * U(cells) >> U(32)).astype(np.int64)
        # u is sorted, so the elements of a cell are neighbours
        at = np.flatnonzero(np.diff(cell, prepend=-1))
        key = W.mix(np.add.reduceat(mixed, at)) ^ W.mix((U(tile + 1) << U(40)) + cell[at].astype(U))
        out.append(W.mix(key))
        if cells - len(at) > SPARE_CELLS:
            empty = np.setdiff1d(np.arange(cells), cell[at]).astype(U)
            out.append(W.mix(W.mix((U(tile + 1) << U(40)) + empty) ^ U(0x5851F42D4C957F2D)))
    return np.concatenate(out)


def bitmap(u: np.ndarray) -> bytes:
    """A bit for each element's low hash bits, in a width that is a power of two of at least 4 bits an element, MOST_BITS at most."""
    width = min(MOST_BITS, max(LEAST_BITS, 1 << (4 * len(u) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(u & U(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def fold(maps: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of uint64) folded to `width` words: an element's bit is at its low hash bits there too."""
    while maps.shape[1] > width:
        half = maps.shape[1] // 2
        maps = maps[:, :half] | maps[:, half:]
    return maps


def may_link(na, nb, apart, percent: int):
    """Whether sets of sizes na and nb that differ in `apart` elements or more can link."""
    both = np.minimum((na + nb - apart) // 2, np.minimum(na, nb))
    return 100 * both >= percent * (na + nb - both)


def _sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    raw, offsets = W.text_buffer(batch.column("text"))
    for a, b in W.chunks(offsets):
        h, _, _, first = W.word_hashes(raw, offsets[a : b + 1])
        s, cut = W.shingle_hashes(h, first, n)
        for i in range(b - a):
            yield a + i, np.unique(s[cut[i] : cut[i + 1]])


def _profile(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, classes, maps, keys = [], [], [], []
            for _, u in _sets(batch, n):
                sizes.append(len(u))
                classes.append(int(W.mix(W.mix(u).sum(dtype=U, keepdims=True) + U(len(u)) * U(0x9E3779B97F4A7C15)).view(np.int64)[0]) if len(u) else None)
                maps.append(bitmap(u) if len(u) else None)
                keys.append(set_keys(u, percent).view(np.int64) if len(u) else np.zeros(0, np.int64))
            cut = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(maps, pa.binary()), pa.ListArray.from_arrays(cut, flat)], ["doc_id", "n_shingles", "class_id", "bitmap", "keys"])

    return run


def _shingle_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("class_id"), pa.array([u.tobytes() for _, u in _sets(batch, n)], pa.binary())], ["class_id", "shingles"])

    return run


def _decide(percent: int):
    """Keeps the pairs that link, by intersecting the sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                p, q = np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            mask = pa.array(keep, pa.bool_())
            yield batch.select(["a", "b"]).filter(mask)

    return run


def _bound(percent: int):
    """Drops pairs whose bitmaps rule the link out: the sets differ in at least as many elements as their bitmaps in bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "map_a", "map_b")), strict=True):
                p, q = np.frombuffer(x, U)[None], np.frombuffer(y, U)[None]
                width = min(p.shape[1], q.shape[1])
                keep.append(bool(may_link(na, nb, int(np.bitwise_count(fold(p, width) ^ fold(q, width)).sum()), percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _tile(percent: int):
    """Pairs of different components, from one block or from two blocks of a key, that may link by their bitmaps."""

    def run(group: pa.Table) -> pa.Table:
        own = group.column("own").to_numpy()
        sizes, parts, ids = (group.column(c).to_numpy() for c in ("n_shingles", "component", "class_id"))
        maps = [np.frombuffer(m, U) for m in group.column("bitmap").to_pylist()]
        one, two = bool(group.column("one_block")[0].as_py()), np.flatnonzero(own == 1)
        width = min(len(m) for m in maps)
        folded = np.concatenate([fold(m[None], width) for m in maps])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for place, i in enumerate(np.flatnonzero(own == 0).tolist()):
            other = np.flatnonzero(own == 0)[place + 1 :] if one else two
            other = other[parts[other] != parts[i]]
            apart = np.bitwise_count(folded[other] ^ folded[i]).sum(1, dtype=np.int64)
            hit = other[may_link(sizes[i], sizes[other], apart, percent)]
            a.append(np.minimum(ids[hit], ids[i]))
            b.append(np.maximum(ids[hit], ids[i]))
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return run


def _wanted(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """docs(doc_id, text) without most of those that are not in reps(rep), by a bitmap of ids of at most WANTED_BITS bits."""
    bits = min(WANTED_BITS, max(1 << 20, 1 << (16 * reps.count()).bit_length()))
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    words = reps.select(spot("rep").alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS INT))")).alias("mask")).toArrow()
    mask = np.zeros(bits // 64, U)
    mask[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(U)
    sent = docs.sparkSession.sparkContext.broadcast(mask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy().astype(U)
            yield batch.select(["doc_id", "text"]).filter(pa.array((sent.value[at >> U(6)] >> (at & U(63))) & U(1) == 1))

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text", spot("doc_id").alias("at")).mapInArrow(run, "doc_id long, text string")


def _links(near: DataFrame, classes: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The linked ones of the pairs near(a, b) of class ids, by their sorted arrays."""
    ids = near.select(F.col("a").alias("class_id")).unionByName(near.select(F.col("b").alias("class_id"))).distinct()
    chosen = materialize(classes.join(ids, "class_id").select("class_id", F.col("doc_id").alias("rep")), "wanted")
    texts = _wanted(docs, chosen)
    found = texts.join(chosen.hint("merge"), texts.doc_id == chosen.rep).select("class_id", "text")
    sets = materialize(found.mapInArrow(_shingle_sets(n), "class_id long, shingles binary").dropDuplicates(["class_id"]), "shingle-sets")
    first = sets.select(F.col("class_id").alias("a"), F.col("shingles").alias("set_a"))
    second = sets.select(F.col("class_id").alias("b"), F.col("shingles").alias("set_b"))
    return materialize(near.join(first, "a").join(second, "b").mapInArrow(_decide(percent), "a long, b long"), "class-links")


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) that may link by their bitmaps."""
    one = classes.select(F.col("class_id").alias("a"), F.col("n_shingles").alias("n_a"), F.col("bitmap").alias("map_a"))
    two = classes.select(F.col("class_id").alias("b"), F.col("n_shingles").alias("n_b"), F.col("bitmap").alias("map_b"))
    sized = pairs.join(one, "a").join(two, "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return sized.mapInArrow(_bound(percent), "a long, b long")


def _labels(links: DataFrame, classes: DataFrame) -> DataFrame:
    joined = components(links)
    return classes.select("class_id").join(joined, classes.class_id == joined.id, "left").select("class_id", F.coalesce("component", "class_id").alias("component"))


def ngram_components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id.

    n_shingles is the size of the document's set of n-word shingles (a shorter text has its whole word
    sequence as one). component_id is the smallest doc_id reachable over links. Null, empty and blank
    texts have an empty set and component_id = doc_id. doc_ids are taken as unique; a repeated
    doc_id gives a row for each of its rows. Rows with a null doc_id are kept, with a component of the others of
    their class, or null. Other columns are ignored whatever their names. An empty table
    gives an empty result.
    """
    docs = docs.select("doc_id", "text")
    profile = materialize(docs.mapInArrow(_profile(n, percent), "doc_id long, n_shingles long, class_id long, bitmap binary, keys array<long>"), "profile")
    small = profile.where("class_id IS NOT NULL")
    reps = small.where("doc_id IS NOT NULL").groupBy("class_id").agg(F.min("doc_id").alias("doc_id"))
    keyed = small.select(F.explode("keys").alias("key"), "class_id")
    same = Window.partitionBy("key")  # one shuffle of the keys; a key's rows stream through a buffer that spills
    marked = keyed.withColumns({"low": F.min("class_id").over(same), "high": F.max("class_id").over(same)})
    members = materialize(marked.where("low <> high").select("key", "class_id").distinct(), "members")
    share = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("shared"))
    wide = small.join(share, "class_id").select("doc_id", "class_id", "n_shingles", "bitmap", (F.col("shared") / F.size("keys")).alias("weight"))
    classes = materialize(wide.join(reps, ["class_id", "doc_id"]).select("class_id", "doc_id", "n_shingles", "bitmap", "weight").dropDuplicates(["class_id"]), "classes")
    ordered = lambda pairs: pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    weighed = members.join(classes.select("class_id", "weight"), "class_id")
    pivots = weighed.groupBy("key").agg(F.max(F.struct("weight", "class_id")).alias("pivot")).select("key", F.col("pivot.class_id").alias("x"))
    spokes = ordered(members.join(pivots, "key").where("class_id <> x").select("x", F.col("class_id").alias("y")))
    links = _links(materialize(_near(spokes, classes, percent), "near-pairs"), classes, docs, n, percent)

    at = members.join(_labels(links, classes), "class_id")
    mixed = at.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high").select("key", "size")
    rest = materialize(at.join(mixed, "key").select("key", "size", "class_id", "component"), "open-keys")
    small = rest.where(F.col("size") <= SMALL_KEY)
    other = small.select("key", F.col("class_id").alias("y"), F.col("component").alias("other"))
    apart = ordered(small.join(other, "key").where("component < other").select(F.col("class_id").alias("x"), "y"))
    blocks = rest.where(F.col("size") > SMALL_KEY).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    dealt = blocks.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(classes.select("class_id", "n_shingles", "bitmap"), "class_id")
    tiles = dealt.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), (F.col("block") > F.col("with")).cast("int").alias("own"), (F.col("block") == F.col("with")).alias("one_block"), "n_shingles", "component", "class_id", "bitmap")
    tiled = tiles.groupBy("key", "i", "j").applyInArrow(_tile(percent), "a long, b long")
    near = materialize(_near(apart, classes, percent).unionByName(tiled).distinct(), "near-pairs")
    label = _labels(materialize(links.unionByName(_links(near, classes, docs, n, percent)), "class-links"), classes)
    named = reps.join(label, "class_id", "left").select("class_id", F.coalesce("component", "class_id").alias("component"), F.col("doc_id").alias("rep"))
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    final = named.join(lowest, "component").select("class_id", "component_id")
    return profile.select("doc_id", "n_shingles", "class_id").join(final, "class_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
