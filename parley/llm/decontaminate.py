"""Benchmark decontamination: SimHash of item-sized windows, a multi-index of Hamming blocks, exact verification.

An item of w words is compared with every window of w words of every document (a shorter document is one
window). Items and windows are bags of 5-word shingles weighted by how often they occur; a shorter item has its
whole sequence as one. Similarity is the weighted Jaccard: sum of minima over sum of maxima.

Per document: shingles are looked up among all benchmark shingles. By the similarity asked for, a match needs
at least ceil(2 t / (1 + t) * size) of a window's shingles there, so windows with fewer are passed over without loss. The
others get 64-bit SimHash fingerprints, weighted the same way. The fingerprints of items of that size
are split into 8 blocks of 8 bits: two fingerprints within RADIUS = 23 bits agree in at least one block up to
2 bits, so listing each item under the 37 nearby values of each of its blocks finds all of them. A pair at similarity 0.8 differs in about 10 bits
with a standard deviation under 3. Candidates are then decided by exact similarity.

The benchmark is read in blocks of bounded size, one after the other, each broadcast on its own (from the second on with a pass over the documents for each); documents aren't shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import words as W
from parley.llm.common import materialize

U = np.uint64
RADIUS = 23
PARTS = 8
NEAR = [m for m in range(256) if m.bit_count() <= RADIUS // PARTS]
GATE_BITS = 24


def fingerprints(shingles: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of `size` shingles that begin at starts."""
    signs = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1
    sums = np.zeros((len(shingles) + 1, 64), np.int32)
    np.cumsum(signs, axis=0, out=sums[1:])
    bits = (sums[starts + size] - sums[starts]) > 0
    return np.packbits(bits, axis=1, bitorder="little").view(U)[:, 0]


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


def better(a: tuple[float, int] | None, b: tuple[float, int]) -> tuple[float, int]:
    """The more similar match, the earlier of equal ones."""
    return b if a is None or (-b[0], b[1]) < (-a[0], a[1]) else a


class Index:
    """Benchmark items by size, with the Hamming blocks of their fingerprints."""

    def __init__(self, items: list[tuple[int, str]], shingle: int, least: float):
        self.shingle, self.least = shingle, least
        raw, offsets = W.text_buffer(pa.array([t for _, t in items], pa.large_string()))
        h, _, _, first = W.word_hashes(raw, offsets)
        counts = np.diff(first)
        self.groups: dict[tuple[int, int], dict] = {}
        known: dict[int, list] = {}
        for i, (item, _) in enumerate(items):
            words = int(counts[i])
            if not words:
                continue
            n = min(shingle, words)
            s, _ = W.shingle_hashes(h[first[i] : first[i + 1]], np.array([0, words]), n)
            known.setdefault(n, []).append(s)
            group = self.groups.setdefault((n, words), {"ids": [], "bags": [], "prints": [], "size": words - n + 1})
            group["ids"].append(item)
            group["bags"].append(Counter(s.tolist()))
            group["prints"].append(fingerprints(s, np.array([0]), len(s))[0])
        for group in self.groups.values():
            prints = group["prints"] = np.array(group["prints"], U)
            at = np.arange(len(prints))
            group["table"] = np.zeros((PARTS, 256, -(-len(prints) // 64)), U)  # items near a block's value, as bits
            for part in range(PARTS):
                block = (prints >> U(8 * part) & U(255)).astype(np.int64)
                for mask in NEAR:
                    np.bitwise_or.at(group["table"][part], (block ^ mask, at >> 6), U(1) << (at & 63).astype(U))
            group["need"] = ceil(2 * least / (1 + least) * group["size"] - 1e-9)
        self.known, self.gates, self.fewest = {}, {}, {}
        for n, parts in known.items():
            self.known[n] = np.unique(np.concatenate(parts))
            gate = np.zeros(1 << GATE_BITS, bool)
            gate[(self.known[n] >> U(64 - GATE_BITS)).astype(np.int64)] = True
            self.gates[n] = gate
            # a document shorter than the item may be one smaller window
            self.fewest[n] = min(ceil(least * g["size"] - 1e-9) for (m, _), g in self.groups.items() if m == n)

    def near(self, group: dict, print_: int) -> list[int]:
        """Items whose fingerprints are within RADIUS."""
        found = np.bitwise_or.reduce([row[print_ >> 8 * part & 255] for part, row in enumerate(group["table"])])
        at = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little"))
        return at[np.bitwise_count(group["prints"][at] ^ U(print_)) <= RADIUS].tolist()

    def search(self, s: np.ndarray, n: int) -> dict[int, tuple[float, int]]:
        """item -> (similarity, first word of the best window) for one document's n-word shingles."""
        there = np.concatenate([[0], np.cumsum(np.isin(s, self.known[n]))])
        best: dict[int, tuple[float, int]] = {}
        for (m, _), group in self.groups.items():
            if m != n:
                continue
            size = min(group["size"], len(s))
            need = group["need"] if size == group["size"] else ceil(self.least * group["size"] - 1e-9)
            starts = np.flatnonzero(there[size:] - there[:-size] >= need) if size else np.zeros(0, np.int64)
            if not len(starts):
                continue
            low, high = int(starts[0]), int(starts[-1]) + size
            seen: dict[int, list[int]] = {}
            for start, print_ in zip(starts.tolist(), fingerprints(s[low:high], starts - low, size).tolist(), strict=True):
                if print_ not in seen:
                    seen[print_] = self.near(group, print_)
                if not len(seen[print_]):
                    continue
                bag = Counter(s[start : start + size].tolist())
                for at in seen[print_]:
                    found, item = similarity(bag, group["bags"][at]), group["ids"][at]
                    if found >= self.least:
                        best[item] = better(best.get(item), (found, start))
        return best

    def rows(self, column: pa.Array) -> Iterator[tuple[int, dict[int, tuple[float, int]]]]:
        """(row, matches) for the rows that have any."""
        raw, offsets = W.text_buffer(column)
        for a, b in W.chunks(offsets):
            h, _, _, first = W.word_hashes(raw, offsets[a : b + 1])
            merged: dict[int, dict] = {}
            for n, gate in self.gates.items():
                s, cut = W.shingle_hashes(h, first, n)
                hits = np.concatenate([[0], np.cumsum(gate[(s >> U(64 - GATE_BITS)).astype(np.int64)])])
                for i in np.flatnonzero(hits[cut[1:]] - hits[cut[:-1]] >= max(1, self.fewest[n])).tolist():
                    for item, match in self.search(s[cut[i] : cut[i + 1]], n).items():
                        of = merged.setdefault(a + i, {})
                        of[item] = better(of.get(item), match)
            yield from merged.items()


def indexes(benchmark: DataFrame, shingle: int = 5, least: float = 0.8, most_items: int = 50_000, most_bytes: int = 64 << 20) -> Iterator[Index]:
    """Indexes of blocks of the benchmark, made one at a time; an item_id's texts are in one block, items without words or id in none."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct()
    rows, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, ceil(rows / most_items), ceil(size / most_bytes))
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        yield Index(sorted((r.item_id, r.text) for r in part.collect()), shingle, least)


def contamination(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, least: float = 0.8, **limits) -> DataFrame:
    """docs(doc_id, text), benchmark(item_id, text) -> doc_id, item_id, similarity, word_start: one row per document row and item it holds.

    similarity is that of the best window and word_start its first word (the earliest of equal ones). Documents or
    items with null, empty or blank texts match nothing; repeated items count once for each item_id; repeated documents
    give their rows again. Other columns are ignored. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    schema = "doc_id long, item_id long, similarity double, word_start long"

    def finder(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id")
                found = [(ids[i].as_py(), item, x, at) for i, m in sent.value.rows(batch.column("text")) for item, (x, at) in m.items()]
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["doc_id", "item_id", "similarity", "word_start"])

        return run

    found, last = [], None
    for index in indexes(benchmark, shingle, least, **limits):  # one block of the benchmark is held at a time
        if last is not None:
            found.append(materialize(docs.mapInArrow(finder(last), schema), "contamination"))
            last.destroy()
        last = spark.sparkContext.broadcast(index)
    return reduce(DataFrame.unionByName, [*found, docs.mapInArrow(finder(last), schema)])


def clean(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, least: float = 0.8, **limits) -> DataFrame:
    """The rows of docs that match no item, with all their columns, whatever their names; nothing is shuffled. Null, empty and blank texts match nothing and stay, as do repeated rows and rows without doc_id."""
    spark = docs.sparkSession

    def keeper(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[i for i, _ in sent.value.rows(batch.column("text"))]] = False
                yield batch.filter(pa.array(keep))

        return run

    last = None
    for index in indexes(benchmark, shingle, least, **limits):
        if last is not None:
            docs = materialize(docs.mapInArrow(keeper(last), docs.schema), "clean")
            last.destroy()
        last = spark.sparkContext.broadcast(index)
    return docs.mapInArrow(keeper(last), docs.schema)
