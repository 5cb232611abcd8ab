"""Near duplicates among embeddings of equal label: a forest of random-projection trees with overlapping splits.

Equal vectors of a label are one class with a multiplicity, so a very common vector costs one row. Each tree splits by
random directions at a quantile of a bounded sample (`sample_rows` vectors by hash; every vector is indexed); vectors whose
projection is near it go to both sides: at least those between the SPILL quantiles, and at least as many as keep a pair at the
threshold together unless its projected distance exceeds REACH standard deviations (such distances are normal, or bounded by the pair's own distance).
Of TRIES directions and CUTS the one that leaves the fewest pairs is taken; a node that all leave with more than WHOLE of its rows on one side
isn't split: a dense group stays in one leaf.
Otherwise nodes are split until an eighth of the most frequent label's classes is in a leaf, LEAF at most and LEAST_LEAF at least, so that small tables go through the trees too;
in larger tables until a thirty-second is, CELL at most, since each further level costs copies that have to be shuffled, more than it saves in comparisons.
Classes that share a leaf and a label are compared exactly: a bound on the cosine from three eighths of a rotated vector's dimensions and the length of the rest, in single precision with a margin, then what passes in double precision. Leaves
with more than BLOCK classes are dealt into blocks that meet two by two, so no task holds more than two blocks and no
pair is left out. A pair that meets in several leaves counts in the first only; a class's other leaves follow from its vector, so they needn't be shuffled: links are counted
in place, never listed, and each leaf gives one row for each class in it that has a link. Leaves are taken in rounds of at most ROUND copies a class (or LEAST_ROUND rows),
whose shuffle files go before the next round: disk doesn't grow with the number of trees or levels.
"""

from __future__ import annotations

from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import materialize
from parley.llm.graph import components

LEAF, LEAST_LEAF, CELL, BLOCK = 256, 16, 16384, 32768  # CELL and BLOCK for 64 dimensions, fewer beyond
SPILL = 0.05
FEWEST = 8
REACH, WHOLE, TRIES, DEEPEST = 1.25, 0.8, 4, 40
CUTS = 0.3, 0.4, 0.5, 0.6, 0.7
ROUND, LEAST_ROUND = 1.5, 400_000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _walk(nodes: dict, x: np.ndarray, within: set[int] | None = None) -> list[tuple[int, np.ndarray]]:
    """Each leaf (of those whose path is within) with its rows. A row's projection doesn't depend on the rows beside it, so every task finds the same leaves."""
    out, todo = [], [(1, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows) or (within is not None and node not in within):
            continue
        if node not in nodes:
            out.append((node, rows))
            continue
        direction, low, high = nodes[node]
        p = np.einsum("ij,j->i", x[rows], direction)
        todo += [(2 * node, rows[p <= high]), (2 * node + 1, rows[p >= low])]
    return out


def _paths(leaves) -> set[int]:
    return {leaf >> k for leaf in leaves for k in range(leaf.bit_length())}


def _of_tree(keys, t: int) -> list[int]:
    return [key & ((1 << 48) - 1) for key in keys if key >> 48 == t]


class Tree:
    """Nodes in heap order: a direction and the two spill thresholds, or none where a leaf is."""

    def __init__(self, sample: np.ndarray, labels: np.ndarray, leaf: float, least: float, seed: int):
        """leaf: how many sampled rows of a label a leaf can have."""
        self.nodes: dict[int, tuple[np.ndarray, float, float]] = {}
        random = np.random.Generator(np.random.PCG64(seed))
        near = sqrt(max(0.0, 2 - 2 * least)) * min(1.0, REACH / sqrt(max(1, sample.shape[1]))) / 2
        todo = [(1, np.arange(len(sample)), 0)]
        while todo:
            node, rows, level = todo.pop()
            if level >= DEEPEST or len(rows) < FEWEST or np.bincount(labels[rows]).max() <= leaf:
                continue
            best = None
            for _ in range(TRIES):
                direction = random.standard_normal(sample.shape[1])
                direction /= np.linalg.norm(direction)
                p = sample[rows] @ direction
                marks = np.quantile(p, [cut + side for cut in CUTS for side in (-SPILL, 0, SPILL)]).reshape(-1, 3)
                for low, middle, high in marks:
                    low, high = min(low, middle - near), max(high, middle + near)
                    left, right = int((p <= high).sum()), int((p >= low).sum())
                    if max(left, right) <= WHOLE * len(rows) and (best is None or left**2 + right**2 < best[0]):
                        best = left**2 + right**2, direction, float(low), float(high), rows[p <= high], rows[p >= low]
            if best:
                self.nodes[node] = best[1:4]
                todo += [(2 * node, best[4], level + 1), (2 * node + 1, best[5], level + 1)]

    def leaves(self, x: np.ndarray) -> list[list[int]]:
        """The leaves that each row falls into."""
        out: list[list[int]] = [[] for _ in range(len(x))]
        for leaf, rows in _walk(self.nodes, x):
            for i in rows.tolist():
                out[i].append(leaf)
        return out


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))
    return x / np.linalg.norm(x, axis=1, keepdims=True) if len(x) else x.reshape(0, 0)


def _basis(sample: np.ndarray) -> np.ndarray | None:
    """The directions that hold most of a sample; what the others add to a cosine is at most the product of the rests' lengths."""
    return np.linalg.eigh(sample.T @ sample)[1][:, -(3 * sample.shape[1] // 8) :] if len(sample) and sample.shape[1] >= 32 else None


class _Earlier:
    """Which leaves before one each row falls into, as bits, found for the rows that are asked for."""

    def __init__(self, x: np.ndarray, here: int, forest: list[dict], keys: list[int]):
        self.x, self.forest = x, forest
        self.place = {key: k for k, key in enumerate(key for key in keys if key < here)}
        self.paths = [_paths(_of_tree(self.place, t)) for t in range(len(forest))]
        self.bits = np.zeros((len(x), -(-len(self.place) // 64)), np.uint64)
        self.known = np.zeros(len(x), bool)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the rows of each pair have no earlier leaf in common."""
        if not self.place:
            return np.ones(len(i), bool)
        asked = np.zeros(len(self.x), bool)
        asked[i] = asked[j] = True
        new = np.flatnonzero(asked & ~self.known)
        if len(new):
            self.known[new] = True
            x = self.x[new]
            for t, nodes in enumerate(self.forest):
                for leaf, rows in _walk(nodes, x, self.paths[t]):
                    k = self.place[(t << 48) + leaf]
                    self.bits[new[rows], k // 64] |= np.uint64(1 << k % 64)
        step = max(1024, (1 << 20) // self.bits.shape[1])
        return np.concatenate([~(self.bits[i[a : a + step]] & self.bits[j[a : a + step]]).any(1) for a in range(0, len(i), step)])


def _join(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unite the rows of each pair in root, which gives each row the first row of its group."""
    while True:
        i, j = root[i], root[j]
        apart = i != j
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
        while (root[root] != root).any():
            root[:] = root[root]


def _leaf(least: float, sent):
    """The links within one leaf, or between two blocks of one, of pairs that share no earlier leaf. sent: the forests by dimensions, each with the keys of its leaves in order and a basis."""

    def run(group: pa.Table) -> pa.Table:
        own, here = group.column("own").to_numpy(), group.column("leaf")[0].as_py()
        x, ids, times = _matrix(group.column("embedding")), group.column("id").to_numpy(), group.column("n").to_numpy()
        one = group.column("one_block")[0].as_py()
        rows, cols = (np.arange(len(x)),) * 2 if one else (np.flatnonzero(own == 0), np.flatnonzero(own == 1))
        forest, keys, basis = sent.value[x.shape[1]]
        short = x if basis is None else x @ basis
        if basis is not None:
            short = np.column_stack([short, np.sqrt(np.maximum(0, 1 - (short * short).sum(1)))])
        short = short.astype(np.float32)
        margin = least - max(1e-4, 2e-7 * x.shape[1])
        links, root, earlier = np.zeros(len(x)), np.arange(len(x)), None
        for a in range(0, len(rows), 512):
            for b in range(a if one else 0, len(cols), 2048):
                r, c = rows[a : a + 512], cols[b : b + 2048]
                near = short[r] @ short[c].T  # the cosine or a bound above it
                if one and a == b:
                    np.fill_diagonal(near, -1)
                some = np.flatnonzero(near.max(1) >= margin)
                if not len(some):
                    continue
                i, j = np.nonzero(near[some] >= margin)
                if 200 * len(i) > near.size:
                    i, j = np.nonzero(x[r] @ x[c].T >= least)
                    i, j = r[i], c[j]
                else:
                    i, j = r[some[i]], c[j]
                    linked = np.einsum("ij,ij->i", x[i], x[j]) >= least
                    i, j = i[linked], j[linked]
                if one:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                earlier = earlier or _Earlier(x, here, forest, keys)
                first = earlier.apart(i, j)
                i, j = i[first], j[first]
                links += np.bincount(i, times[j], len(x)) + np.bincount(j, times[i], len(x))
                _join(root, i, j)
        there = np.flatnonzero(links)
        return pa.table({"id": pa.array(ids[there], pa.int64()), "links": pa.array(links[there].astype(np.int64)), "root": pa.array(ids[root[there]], pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.93, trees: int = 4, sample_rows: int = 50_000, seed: int = 11) -> DataFrame:
    """vectors(vec_id, embedding, label) -> vec_id, n_links, component_id, kept: a row for each row.

    Vectors link when their labels are equal and not null, their dimensions are equal and their cosine is at least `least`. Vectors that are
    null, empty, zero or hold nulls or non-finite numbers link with nothing, and so do rows without vec_id. Rows that repeat a
    vec_id count as vectors of their own. Other columns are ignored; an empty table gives none.
    """
    spark = vectors.sparkSession
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")  # what is written here is read from the shared folder, so its shuffle files can go
    try:
        return _near_duplicates(vectors, least, trees, sample_rows, seed)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def _rounds(weights: dict[tuple[int, int], int], most: float) -> list[tuple[dict[int, list[int]], int, int]]:
    """weights: copies of each (dims, leaf) -> rounds of at most `most` copies: leaves by dims, and the part of how many parts of their blocks. Only a leaf above `most` has several parts."""
    rounds, size = [], 0
    for (d, leaf), weight in sorted(weights.items()):
        parts = -(-weight // max(1, int(most)))
        if parts > 1:
            rounds += [({d: [leaf]}, part, parts) for part in range(parts)]
            size = most
            continue
        if not rounds or size + weight > most:
            rounds.append(({}, 0, 1))
            size = 0
        rounds[-1][0].setdefault(d, []).append(leaf)
        size += weight
    return rounds


def _near_duplicates(vectors: DataFrame, least: float, trees: int, sample_rows: int, seed: int) -> DataFrame:
    spark = vectors.sparkSession
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"  # as it is stored, so that half as much is shuffled; compared in double precision
    vectors = vectors.select("vec_id", "label", F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    sound = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0) & ~bad & F.exists("embedding", lambda v: v != 0))
    classes = materialize(sound.groupBy("label", "embedding").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")).withColumn("dims", F.size("embedding")), "vector-classes")
    mine = vectors.withColumn("label_key", F.when(F.col("vec_id").isNotNull(), F.col("label"))).withColumn("mark", F.xxhash64("embedding"))
    each = classes.withColumn("mark", F.xxhash64("embedding"))  # sorting by the mark first saves comparing vectors
    same = (mine.mark == each.mark) & (mine.label_key == each.label) & (mine.embedding == each.embedding)
    own = materialize(mine.join(each, same, "left").select("vec_id", "id", "n"), "classes-of-rows")  # the only join by vectors; later ones take ids
    total = classes.count()
    share = min(1.0, sample_rows / max(1, total))
    forests: dict[int, tuple[list[dict], list[int], np.ndarray | None]] = {}
    smaller = {}
    for r in classes.groupBy("label", "dims").count().groupBy("dims").agg(F.max("count").alias("most")).collect():
        chosen = classes.where((F.col("dims") == r.dims) & (F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 1) / F.lit(float(1 << 63)) < share))
        smaller[r.dims] = max(64, r.dims) / 64
        leaf = max(LEAST_LEAF, min(LEAF, r.most // 8), min(int(CELL / smaller[r.dims]), r.most // 32))
        split = r.most > leaf
        sample = chosen.orderBy("id").select("embedding", "label").toArrow() if split else None
        x, labels = (_matrix(sample.column(0)), np.unique(sample.column(1).to_numpy(), return_inverse=True)[1]) if split else (np.zeros((0, r.dims)), np.zeros(0, np.int64))
        forest = [Tree(x.reshape(-1, r.dims), labels, leaf * share, least, seed + t).nodes for t in range(trees if split else 1)]
        forests[r.dims] = forest, sorted((t << 48) + q for t, nodes in enumerate(forest) for q in ({2 * k + side for k in nodes for side in (0, 1)} | {1}) - set(nodes)), _basis(x)
    sent = spark.sparkContext.broadcast(forests)
    label = classes.schema["label"].dataType.simpleString()

    def placed(batch, wanted):
        """Each tree's rows and leaf keys, for the leaves that are wanted: dims, rows, keys."""
        dims = batch.column("dims").to_numpy()
        for d in np.unique(dims).tolist():
            at = np.flatnonzero(dims == d)
            x = _matrix(batch.column("embedding").take(pa.array(at)))
            for t, nodes in enumerate(sent.value[d][0]):
                for leaf, rows in _walk(nodes, x, wanted and wanted.get((d, t), set())):
                    yield d, at[rows], (t << 48) + leaf

    def count(batches):
        for batch in batches:
            found = list(placed(batch, None))
            rows = np.concatenate([np.zeros(0, np.int64), *(f[1] for f in found)])
            lengths = [len(f[1]) for f in found]
            table = pa.table({"label": batch.column("label").take(pa.array(rows)), "dims": pa.array(np.repeat([f[0] for f in found], lengths), pa.int32()), "leaf": pa.array(np.repeat([f[2] for f in found], lengths), pa.int64())})
            yield from table.group_by(["label", "dims", "leaf"]).aggregate([([], "count_all")]).rename_columns(["label", "dims", "leaf", "rows"]).to_batches()

    counts = classes.select("label", "dims", "embedding").mapInArrow(count, f"label {label}, dims int, leaf long, rows long").groupBy("label", "dims", "leaf").agg(F.sum("rows").alias("rows"))
    most = F.greatest(F.lit(1), F.floor(F.lit(BLOCK * 64) / F.greatest(F.lit(64), "dims")))
    counts = materialize(counts.withColumn("blocks", F.ceil(F.col("rows") / most).cast("int")), "leaf-sizes")
    large = counts.where("blocks > 1").select("label", "dims", "leaf", "blocks")
    weights = {(r.dims, r.leaf): r.copies for r in counts.groupBy("dims", "leaf").agg(F.sum(F.col("rows") * F.col("blocks")).alias("copies")).collect()}

    def links_of(leaves: dict[int, list[int]], part: int, parts: int) -> DataFrame:
        def place(batches):
            wanted = {(d, t): _paths(_of_tree(keys, t)) for d, keys in leaves.items() for t in {key >> 48 for key in keys}}
            for batch in batches:
                found = list(placed(batch, wanted))
                rows = np.concatenate([np.zeros(0, np.int64), *(f[1] for f in found)])
                keys = np.repeat(np.array([f[2] for f in found], np.int64), [len(f[1]) for f in found])
                ends = np.concatenate([[0], np.bincount(rows, minlength=batch.num_rows).cumsum()])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[np.argsort(rows, kind="stable")], pa.int64()))
                some = pa.array(ends[1:] > ends[:-1])
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "leaves"]).filter(some)

        spread = classes.mapInArrow(place, f"label {label}, embedding array<{kind}>, id long, n long, dims int, leaves array<long>").select("label", "embedding", "id", "n", "dims", F.explode("leaves").alias("leaf"))
        dealt = spread.join(F.broadcast(large), ["label", "dims", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = dealt.select("label", "dims", "leaf", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), (F.col("block") > F.col("with")).cast("int").alias("own"), (F.col("block") == F.col("with")).alias("one_block"), "id", "n", "embedding")
        if parts > 1:
            cells = cells.where(F.pmod(F.xxhash64("label", "i", "j"), F.lit(parts)) == part)
        return materialize(cells.groupBy("label", "dims", "leaf", "i", "j").applyInArrow(_leaf(least, sent), "id long, links long, root long"), "leaf-links")

    found = spark.createDataFrame([], "id long, links long, root long")
    for leaves, part, parts in _rounds(weights, max(ROUND * total, LEAST_ROUND)):
        found = found.unionByName(links_of(leaves, part, parts))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    linked = links.join(joined, "id")
    out = own.join(linked, "id", "left")
    return out.select("vec_id", (F.coalesce("links", F.lit(0)) + F.coalesce("n", F.lit(1)) - 1).cast("long").alias("n_links"), F.coalesce("component", "id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id") == F.col("component_id"))
