"""Language-model scoring with a log-frequency Bloom filter.

Training tokens are counted over all training rows. The `head` most frequent tokens have numbers of their own. The others
fall into buckets by hash, about four words in each (at most MOST_BUCKETS buckets: a larger vocabulary shares them more), within which
a word keeps its exact share of the bucket's count: P(w | v) = P(bucket | v) * (c(w) + 1) / (the bucket's mass). So pairs of any words count, and what the corpus says
of a rare word isn't dropped.

Counts of adjacent pairs of numbers go into a Bloom filter by their logarithm: a pair whose count has level q is inserted as (pair, 1) ... (pair, q), and a reader finds q by
asking for levels 1, 2, ... until the filter denies one. Level 1 sets HASHES bits in each of two 64-bit words of its block, a further level in one word. Every counted pair goes in;
a block has as many words as its entries need (ROOM), and the number of blocks grows with the tokens, about BLOCK_TOKENS in each. The pairs of a context are in one block, but for
contexts that are a quarter of a block alone: theirs are spread over all blocks. Tasks send a block's counted pairs together, as compressed differences of sorted numbers.

P(number | v) = (count + PRIOR * P(number)) / (S(v) + PRIOR + false), where S(v) is the sum of v's counts as the filter tells them, taken when it
is built, and `false` what the filter's false positives add up to over all numbers, by its measured fill. So the probabilities of a context sum to one, whatever
the quantisation, but for the context's own luck with false positives (level 1: about 2 in 100,000 pairs).

The filter is broadcast in parts of at most `max_filter_bits` (64 MB by default; besides, there are the numbers' counts, of bounded size). The first part is asked while words are
counted; each of up to MOST_PASSES - 1 further ones takes a pass over the texts' numbers, a text's score being the sum over the parts. A larger filter is asked by a
shuffle: each text's pairs meet their block, and a block that many pairs ask for is held by several tasks.
Counts of words outside the head are never broadcast: they join by word hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import words as W
from parley.llm.common import fold, materialize

U = np.uint64
END = W.mix(np.array([0x656E64], U))[0]
BASE = 1.6
HASHES, ROOM = 8, 0.6
PRIOR = 8.0
MOST_BUCKETS = 1 << 20
BLOCK_TOKENS = 1 << 20
MOST_PASSES = 8
FLUSH = 1 << 21
EMPTY = bytes(8)


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first) of each text's words followed by one end."""
    h, _, _, first = W.word_hashes(raw, offsets)
    return np.insert(h, first[1:], END), first + np.arange(len(first))


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of a level's counts; 0 for level 0."""
    low, high = BASE ** (levels - 1.0), BASE ** levels.astype(float)
    return np.where(levels > 0, np.where(levels == 1, 1.0, (low + high) / 2), 0.0)


def _spot(keys: np.ndarray, level: int, word: int, size: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """(word's place in a block of `size` words, its bits) of an entry."""
    h = W.mix(keys * U(0x9E3779B97F4A7C15) + U((level * 0xD1B54A32D192ED03 + word * 0xA24BAED4963EE407) & 0xFFFFFFFFFFFFFFFF))
    bits = np.zeros(len(h), U)
    for i in range(HASHES):
        bits |= U(1) << ((h >> U(6 * i)) & U(63))
    return (W.mix(h) >> U(32)) * size >> U(32), bits


def build_block(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One block of the filter: every pair with each level up to its own."""
    levels = level_of(counts)
    block = np.zeros(max(1, ceil((len(levels) + levels.sum()) * HASHES / (64 * ROOM))), U)
    for level in range(1, int(levels.max(initial=0)) + 1):
        there = keys[levels >= level]
        for word in (0, 1) if level == 1 else (0,):
            np.bitwise_or.at(block, *_spot(there, level, word, U(len(block))))
    return block


def held(words: np.ndarray, at: np.ndarray, sizes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Levels of pairs by repeated membership probes of their blocks, which begin at `at` and have `sizes` words."""
    out, alive, level = np.zeros(len(keys), np.int64), np.arange(len(keys)), 1
    while len(alive) and level < 64:
        for word in (0, 1) if level == 1 else (0,):
            spot, bits = _spot(keys[alive], level, word, sizes[alive])
            alive = alive[(words[at[alive] + spot.astype(np.int64)] & bits) == bits]
        out[alive] = level
        level += 1
    return out


def false_rate(block: np.ndarray) -> float:
    """How often the filter says yes to level 1 of a pair that isn't there, by the fill of the block's words."""
    return float(np.mean((np.bitwise_count(block) / 64.0) ** HASHES) ** 2)


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts: differences, byte planes, compressed."""
    planes = np.diff(keys, prepend=0).view(np.uint8).reshape(-1, 8).T.tobytes() + counts.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(pa.decompress(data, 16 * n, codec="zstd", asbytes=True), np.uint8).reshape(2, 8, n)
    deltas, counts = (np.ascontiguousarray(x.T).view(np.int64)[:, 0] for x in planes)
    return np.cumsum(deltas), counts


class Model:
    """What workers need: the numbers with their counts, sums over contexts, totals, and the filter or a part of it."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, masses: np.ndarray, total: int, distinct: int, blocks: int):
        """keys, counts: the head; masses: the sum of count + 1 over each bucket's words, and one for all unseen words there."""
        self.keys, self.total, self.distinct, self.blocks = keys, total, distinct, blocks
        self.head, self.buckets = len(keys), len(masses)
        self.start = self.head + self.buckets
        size = 1 << max(4, (4 * len(keys)).bit_length())
        self.slots, self.mask = np.full(size, -1, np.int32), U(size - 1)
        for number, at in enumerate((keys & self.mask).astype(np.int64).tolist()):
            while self.slots[at] >= 0:
                at = (at + 1) % size
            self.slots[at] = number
        self.log_share = np.log10(total + distinct + 1.0)
        self.log_count, self.log_mass = np.log10(counts + 1.0), np.log10(masses)
        mass = np.concatenate([counts + 1.0, masses])
        self.prior = mass / max(1.0, mass.sum())
        self.spread = np.append(mass >= BLOCK_TOKENS // 4, True)
        self.sums, self.false = np.zeros(self.start + 1), 0.0
        self.filter, self.held, self.at, self.sizes = np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)

    def block_of(self, keys: np.ndarray) -> np.ndarray:
        at = W.mix(np.where(self.spread[keys >> 32], keys, keys >> 32).view(U) ^ U(0x5851F42D4C957F2D))
        return ((at >> U(32)) * U(self.blocks) >> U(32)).astype(np.int64)

    def bare(self) -> Model:
        """What numbers, pair_keys and block_of need: a fifth of the whole, for the tasks that count pairs."""
        out = copy(self)
        out.log_count = out.log_mass = out.prior = out.sums = np.zeros(0)
        return out

    def part(self, blocks: dict[int, bytes]) -> Model:
        """The model with these blocks of the filter only, which are taken out of the dict; pairs of other blocks add nothing to its scores."""
        out, held = copy(self), sorted(blocks)
        sizes = np.array([len(blocks[b]) // 8 for b in held], np.int64)
        out.held, out.sizes, out.at = np.array(held, np.int64), sizes.astype(U), np.cumsum(sizes) - sizes
        out.filter = np.empty(int(sizes.sum()), U)
        for b, at, size in zip(held, out.at.tolist(), sizes.tolist(), strict=True):
            out.filter[at : at + size] = np.frombuffer(blocks.pop(b), U)  # each is let go once it is in place
        return out

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the head's words, and of the buckets of others."""
        out = self.head + ((h >> U(20)) & U(self.buckets - 1)).astype(np.int64)
        if not self.head:
            return out
        open_, at = np.arange(len(h)), h & self.mask
        while len(open_):
            slot = self.slots[at]
            used = slot >= 0
            hit = used & (self.keys[np.maximum(slot, 0)] == h[open_])
            out[open_[hit]] = slot[hit]
            more = used & ~hit
            open_, at = open_[more], (at[more] + U(1)) & self.mask
        return out

    def pair_keys(self, numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
        before = np.empty_like(numbers)
        before[1:] = numbers[:-1]
        before[first[:-1]] = self.start
        return (before << 32) | numbers

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels that the filter holds; -1 where another part has the pair."""
        block, out = self.block_of(keys), np.full(len(keys), -1)
        place = np.minimum(np.searchsorted(self.held, block), max(0, len(self.held) - 1))
        mine = np.flatnonzero(self.held[place] == block) if len(self.held) else np.zeros(0, np.int64)
        out[mine] = held(self.filter, self.at[place[mine]], self.sizes[place[mine]], keys[mine].view(U))
        return out

    def log_pairs(self, keys: np.ndarray) -> np.ndarray:
        """log10 P(number | context) of pairs; 0 where another part has the pair."""
        levels = self.levels(keys)
        p = (count_of(levels) + PRIOR * self.prior[keys & 0xFFFFFFFF]) / (self.sums[keys >> 32] + PRIOR + self.false)
        return np.where(levels >= 0, np.log10(np.minimum(1.0, p)), 0.0)

    def log_probability(self, numbers: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 of each token's number's probability after the one before it."""
        unique, where = np.unique(self.pair_keys(numbers, first), return_inverse=True)
        return self.log_pairs(unique)[where]


def _starts(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def _tally(loose: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their counts; empties the list."""
    keys = np.concatenate(loose)
    loose.clear()
    keys.sort()
    new = _starts(keys)
    return keys[new], np.diff(new, append=len(keys))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and the sums of their counts; empties the list, so that its parts don't stay beside the result."""
    if len(parts) == 1:
        return parts.pop()
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    order = np.argsort(keys, kind="stable")  # the parts are sorted runs
    keys, counts = keys[order], counts[order]
    del order
    new = _starts(keys)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def _counted(keys_of, batch_of):
    """Counts what keys_of gives for each chunk; counts are combined within a task while they fit FLUSH keys, and go out as batch_of makes them.
    Two workers share an executor's memory with its JVM, so texts are hashed by the chunk and only keys are held to be counted together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose: list[np.ndarray] = []
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = held = 0
        for batch in batches:
            raw, offsets = W.text_buffer(batch.column("text"))
            for a, b in W.chunks(offsets):
                loose.append(keys_of(raw, offsets[a : b + 1]))
                waiting += len(loose[-1])
                if waiting <= FLUSH // 4:
                    continue
                parts.append(_tally(loose))
                waiting, held = 0, held + len(parts[-1][0])
                if held > FLUSH:
                    parts.append(_merge(parts))
                    held = len(parts[0][0])
                    if held > FLUSH // 2:
                        yield from batch_of(*parts.pop())
                        held = 0
            del batch, raw, offsets  # before the next one is read
        if loose:
            parts.append(_tally(loose))
        if parts:
            yield from batch_of(*_merge(parts))

    return run


def _words(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(keys), 1 << 18):
        yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + (1 << 18)].view(np.int64)), pa.array(counts[a : a + (1 << 18)])], ["key", "n"])


def _pairs(model: Model):
    """Counted pairs, packed by block."""

    def run(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        block = np.empty(len(keys), np.int32)
        for a in range(0, len(keys), 1 << 18):
            block[a : a + (1 << 18)] = model.block_of(keys[a : a + (1 << 18)])
        order = np.argsort(block, kind="stable")
        keys, counts, block = keys[order], counts[order], block[order]
        del order
        at = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(keys)).tolist()
        for a in range(0, len(at) - 1, 1000):
            cuts = list(zip(at[a : a + 1000], at[a + 1 : a + 1001], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array(block[[x for x, _ in cuts]], pa.int32()), pa.array([y - x for x, y in cuts], pa.int32()), pa.array([packed(keys[x:y], counts[x:y]) for x, y in cuts], pa.binary())], ["block", "n", "pairs"])

    return run


def _built(group: pa.Table) -> pa.Table:
    """A block's filter, its false positive rate, and what its pairs add to the sums of their contexts."""
    keys, counts = _merge([unpacked(x, n) for x, n in zip(group.column("pairs").to_pylist(), group.column("n").to_pylist(), strict=True)])
    block = build_block(keys.view(U), counts)
    levels = held(block, np.zeros(len(keys), np.int64), np.full(len(keys), len(block), U), keys.view(U))
    contexts, where = np.unique(keys >> 32, return_inverse=True)
    sums = np.bincount(where, count_of(levels), len(contexts))
    return pa.table({"block": group.column("block")[:1], "bits": pa.array([block.tobytes()], pa.binary()), "rate": [false_rate(block)], "contexts": pa.array([contexts], pa.list_(pa.int32())), "sums": pa.array([sums], pa.list_(pa.float64()))})


def _frequent(counts: DataFrame, most: int) -> DataFrame:
    """The `most` most frequent rows of counts(key, n); of as frequent ones those of the least keys, or none where more than `most` are about as frequent as the last one. Nothing but
    what is about as frequent as the last one is sorted."""
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.02)) + 1e-9)
    sizes = {r.step: r.rows for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect()}
    room, last = most, None
    for last in sorted(sizes, reverse=True):
        if sizes[last] > room:
            break
        room -= sizes[last]
    else:
        return counts
    above, at = counts.where(step > last), counts.where(step == last)
    return above.unionByName(at.orderBy(F.desc("n"), "key").limit(room)) if room and sizes[last] <= most else above


def train(docs: DataFrame, head: int = 1 << 18, max_filter_bits: int = 1 << 29) -> tuple[DataFrame, Model, DataFrame, list[list[int]] | None]:
    """docs(text) -> counts(key, n) of all tokens by hash, the model without filter, the filter's blocks and which of them make a part (None: too many parts to pass over the texts for each). Null texts count as empty ones."""
    spark = docs.sparkSession
    docs = docs.select("text")
    raw_counts = docs.mapInArrow(_counted(lambda raw, offsets: tokens(raw, offsets)[0], _words), "key long, n long")
    counts = materialize(raw_counts.groupBy("key").agg(F.sum("n").alias("n")), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = _frequent(counts, head).toArrow()
    keys, found = top.column("key").to_numpy().astype(np.int64).view(U), top.column("n").to_numpy().astype(np.int64)
    buckets = min(MOST_BUCKETS, 1 << max(0, (distinct - len(keys)) // 4).bit_length())
    bucket = F.shiftrightunsigned("key", 20).bitwiseAND(F.lit(buckets - 1)).alias("bucket")
    whole = counts.groupBy(bucket).agg(F.sum(F.col("n") + 1).alias("mass")).toArrow()
    masses = np.ones(buckets)
    masses[whole.column("bucket").to_numpy()] += whole.column("mass").to_numpy()
    masses -= np.bincount(((keys >> U(20)) & U(buckets - 1)).astype(np.int64), found + 1.0, buckets)
    model = Model(keys, found, masses, total, distinct, max(1, ceil(total / BLOCK_TOKENS)))
    sent = spark.sparkContext.broadcast(model.bare())

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys_of(raw, offsets):
            h, first = tokens(raw, offsets)
            return sent.value.pair_keys(sent.value.numbers(h), first)

        yield from _counted(keys_of, _pairs(sent.value))(batches)

    seen = docs.mapInArrow(pairs, "block int, n int, pairs binary")
    blocks = materialize(seen.groupBy("block").applyInArrow(_built, "block int, bits binary, rate double, contexts array<int>, sums array<double>"), "filter")
    sent.destroy()
    sums = blocks.select(F.explode(F.arrays_zip("contexts", "sums")).alias("x")).groupBy("x.contexts").agg(F.sum("x.sums").alias("sum")).toArrow()
    model = copy(model)
    model.sums = np.zeros(model.start + 1)
    model.sums[sums.column(0).to_numpy().astype(np.int64)] = sums.column(1).to_numpy()
    size, rates = blocks.agg(F.coalesce(F.sum(F.length("bits")), F.lit(0)), F.coalesce(F.sum("rate"), F.lit(0.0))).first()
    model.false = rates / model.blocks * (model.start + 1)
    most = max_filter_bits // 8
    if size > MOST_PASSES * most:
        return counts, model, blocks.select("block", "bits"), None
    sizes = {r.block: r.size for r in blocks.select("block", F.length("bits").alias("size")).toLocalIterator()}
    parts, room = [[]], most
    for b in range(model.blocks):
        size = sizes.get(b, len(EMPTY))
        if parts[-1] and size > room:
            parts.append([])
            room = most
        parts[-1].append(b)
        room -= size
    return counts, model, blocks.select("block", "bits"), parts


def _distinct(h: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, times, cut) of the different values h of each row."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])])) if len(h) else np.zeros(0, np.int64)
    return h[new], np.diff(np.append(new, len(h))), np.searchsorted(owner[new], np.arange(rows + 1))


def score(docs: DataFrame, counts: DataFrame, model: Model, blocks: DataFrame, parts: list[list[int]] | None) -> DataFrame:
    """docs(doc_id, held_out, text) -> one row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    base_score is the sum of log10((c + 1) / (N + V + 1)) over the tokens, score the model's log10
    probability. Null and empty texts have one token, the end. Repeated and null doc_ids keep their rows.
    """
    spark, several = docs.sparkSession, parts is None or len(parts) > 1

    def broadcast(part: list[int]):
        found = {r.block: r.bits for r in blocks.where(F.col("block").isin(part)).toLocalIterator()} if part else {}
        return spark.sparkContext.broadcast(model.part(dict.fromkeys(part, EMPTY) | found))

    sent = broadcast(parts[0] if parts else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, number = sent.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            rare, times, cut, every, ends = [], [], [0], [], [0]
            raw, offsets = W.text_buffer(batch.column("text"))
            for a, b in W.chunks(offsets):
                h, first = tokens(raw, offsets[a : b + 1])
                numbers = m.numbers(h)
                if several:
                    every.append(numbers.astype(np.int32))
                    ends += (ends[-1] + first[1:]).tolist()
                known = numbers < m.head
                bucket = numbers[~known] - m.head
                base, logs = np.full(len(h), -m.log_share), m.log_probability(numbers, first)
                base[known] += m.log_count[numbers[known]]
                logs[~known] -= m.log_mass[bucket]
                for out, values in zip(columns, (np.diff(first), *(np.add.reduceat(x, first[:-1]) for x in (known.astype(np.int64), base, logs))), strict=False):
                    out.append(values)
                words, n, at = _distinct(h[~known], np.repeat(np.arange(b - a), np.diff(first))[~known], b - a)
                rare.append(words.view(np.int64)), times.append(n)
                cut += (cut[-1] + at[1:]).tolist()
            n = batch.num_rows
            join = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
            items = pa.StructArray.from_arrays([join(rare, pa.int64()), join(times, pa.int64())], ["key", "times"])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(number, number + n)), batch.column("doc_id"), batch.column("held_out"), *(join(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=False)), pa.ListArray.from_arrays(np.array(cut, np.int32), items), pa.ListArray.from_arrays(np.array(ends if several else [0] * (n + 1), np.int32), join(every, pa.int32()))], ["row", "doc_id", "held_out", "n_tokens", "n_head", "head_score", "model_score", "rare", "numbers"])
            number += n

    rows = materialize(docs.select("doc_id", "held_out", "text").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_head long, head_score double, model_score double, rare array<struct<key:long,times:long>>, numbers array<int>"), "scored")

    def further(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, at, numbers in _numbers(batches):
                yield pa.RecordBatch.from_arrays([batch, pa.array(np.add.reduceat(sent.value.log_probability(numbers, at), at[:-1]))], ["row", "more"])

        return run

    added = None
    if parts is None:
        added = _asked(rows.select("row", "numbers"), blocks, sent)
    else:
        sent.destroy()
        for part in parts[1:]:
            more = broadcast(part)
            one = materialize(rows.select("row", "numbers").mapInArrow(further(more), "row long, more double"), "scored-part")
            added = one if added is None else added.unionByName(one)
            more.destroy()
    rows = rows.drop("numbers")
    if added is not None:
        more = added.groupBy("row").agg(F.sum("more").alias("more"))
        rows = rows.join(more, "row").withColumn("model_score", F.col("model_score") + F.col("more")).drop("more")
    tails = rows.select("row", F.inline("rare")).join(counts, "key", "left")
    tails = tails.select("row", (F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("part"), F.when(F.col("n") > 0, F.col("times")).alias("known"))
    summed = tails.groupBy("row").agg(F.sum("part").alias("part"), F.sum("known").alias("known"))
    part, known = F.coalesce("part", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return rows.drop("rare").join(summed, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_head") + known).alias("n_known"), F.lit(int(model.total)).cast("long").alias("train_tokens"), (F.col("head_score") + part).alias("base_score"), (F.col("model_score") + part).alias("score"))


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(rows, first, numbers) of parts of the batches."""
    for batch in batches:
        column = batch.column("numbers")
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
        for a in range(0, batch.num_rows, 256):
            at = offsets[a : a + 257].astype(np.int64)
            yield batch.column("row").slice(a, 256), at - at[0], values[at[0] : at[-1]].astype(np.int64)


def _asked(rows: DataFrame, blocks: DataFrame, sent, most: int = BLOCK_TOKENS) -> DataFrame:
    """rows(row, numbers) -> row, more: each text's pairs, shuffled to their block; a block that more than `most` pairs ask for has several tasks."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for ids, at, numbers in _numbers(batches):
            keys, times, cut = _distinct(m.pair_keys(numbers, at), np.repeat(np.arange(len(ids)), np.diff(at)), len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(m.block_of(keys), pa.int32()), pa.array(np.repeat(ids.to_numpy(), np.diff(cut))), pa.array(keys), pa.array(times)], ["block", "row", "key", "times"])

    queries = materialize(rows.mapInArrow(ask, "block int, row long, key long, times long"), "queries")
    tasks = queries.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("tasks"))
    held = blocks.join(tasks, "block").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).select("block", "task", "bits")
    dealt = queries.join(tasks.where("tasks > 1"), "block", "left").withColumn("task", F.pmod(F.xxhash64("row"), F.coalesce("tasks", F.lit(1))).cast("int")).drop("tasks")

    def answer(asked: pa.Table, block: pa.Table) -> pa.Table:
        if not asked.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "more": pa.array([], pa.float64())})
        part = sent.value.part({asked.column("block")[0].as_py(): block.column("bits")[0].as_py() if block.num_rows else EMPTY})
        unique, where = np.unique(asked.column("key").to_numpy(), return_inverse=True)
        owner, at = np.unique(asked.column("row").to_numpy(), return_inverse=True)
        return pa.table({"row": owner, "more": np.bincount(at, part.log_pairs(unique)[where] * asked.column("times").to_numpy(), len(owner))})

    return dealt.groupBy("block", "task").cogroup(held.groupBy("block", "task")).applyInArrow(answer, "row long, more double")


def lm_scores(docs: DataFrame, folds: int = 7, held: int = 2, **options) -> DataFrame:
    """docs(doc_id, text): learns from rows whose crc32(doc_id) mod folds is not held (a null doc_id learns), scores all."""
    marked = docs.select("doc_id", "text", F.coalesce(fold(docs.doc_id, folds) == held, F.lit(False)).alias("held_out"))
    return score(marked, *train(marked.where("NOT held_out"), **options))
