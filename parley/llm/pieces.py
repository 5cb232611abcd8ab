"""SentencePiece encoding and decoding by a streaming Viterbi search.

The model's pieces were merged by rank, so its segmentation of a text is the one path in which every two
neighbouring pieces would also come out as those two on their own. That makes it a Viterbi search with path scores
of zero and minus infinity: at each position one piece can end, found by trying the pieces that match there (their number is bounded by the
longest piece) against the piece that ends where they start. Only backpointers since the last commit are
kept; whenever the paths of all positions in a window of the longest piece's length share a boundary, the ids before it are final and go out.

Two pieces are compatible when no merge across their border comes first. While a piece is built, its edge at the
border is a chain of ever larger pieces, each alive from its own rank until that of the next; a merge of two
edges alive together is in the way if its rank is before the ends of both (at equal ranks the left one goes first).

Characters that no piece holds become their UTF-8 bytes' pieces and are borders for certain. A blank after another
character is one too where no piece holds such a pair: all surviving paths converge there, so that each such border is a commit point, which needs no search for it. What stands between
two of them, the window's whole content then, is remembered with its ids (up to CACHE of LONG characters or fewer).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
CACHE = 1 << 20
PAIRS = 1 << 21
LONG = 64
NEVER = 1 << 60


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer's fields."""

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at, out, shift = at + 1, out | (byte & 127) << shift, shift + 7
            if byte < 128:
                return out

    at = 0
    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


def model_type(data: bytes) -> int:
    """The trainer's model type: 1 unigram (also where none is stated), 2 byte-pair merges, 3 words, 4 characters."""
    trainer = next((v for n, v in _fields(data) if n == 2), b"")
    return next((v for n, v in _fields(trainer) if n == 3), 1)


def read_model(path: str = DEFAULT_MODEL) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id; kind 0 ordinary, 1 byte, 2 control, unknown or unused. Scores must be merge ranks: other models than those of byte-pair merges are refused."""
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    if (found := model_type(p.serialized_model_proto())) != 2:
        raise ValueError(f"{path} is no model of byte-pair merges (its type is {found})")
    kind = lambda i: 1 if p.is_byte(i) else 2 if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else 0
    return [(p.id_to_piece(i), p.get_score(i), kind(i)) for i in range(p.get_piece_size())]


class Codec:
    """Encodes and decodes with a model's pieces. The text is taken as it is: blanks become the blank sign, with one put in front."""

    def __init__(self, model: list[tuple[str, float, int]]):
        self.names = [p for p, _, _ in model]
        self.ids = {p: i for i, (p, _, kind) in enumerate(model) if kind == 0}
        self.byte_ids = [0] * 256
        self.bytes_of = []
        for i, (p, _, kind) in enumerate(model):
            if kind == 1:
                self.byte_ids[int(p[3:5], 16)] = i
            self.bytes_of.append(bytes([int(p[3:5], 16)]) if kind == 1 else b"" if kind == 2 else p.replace(BLANK, " ").encode())
        order = sorted(self.ids.values(), key=lambda i: (-model[i][1], i))
        self.rank = dict(zip(order, range(len(order)), strict=True))
        self.tails = {p[i:]: -1 for p in self.ids for i in range(len(p))}  # every end of a piece, with the id where it is one itself
        self.tails.update(self.ids)
        self.longest = max(map(len, self.ids), default=1)
        self.edges: tuple[dict[int, list[tuple[str, int, int]]], dict[int, list[tuple[str, int, int]]]] = {}, {}
        self.pairs: dict[int, bool] = {}
        self.cache: dict[str, tuple[int, ...]] = {}
        inner = any(BLANK in p.lstrip(BLANK) for p in self.ids)
        stops = "".join(c for c in "\n\t" if not any(c in p for p in self.ids))
        self.units = re.compile("(?s).+" if inner else f"[{stops}]|{BLANK}+[^{BLANK}{stops}]*|[^{BLANK}{stops}]+" if stops else f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")

    def halves(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes this one, None for a single character; unreachable pieces give ('', '')."""
        if len(piece) == 1:
            return None
        parts = list(piece)
        while len(parts) > 2:
            best = min((self.rank[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None) if any(parts[k] + parts[k + 1] in self.ids for k in range(len(parts) - 1)) else None
            if best is None:
                return "", ""
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else ("", "")

    def edge(self, piece: int, side: int) -> list[tuple[str, int, int]]:
        """(piece, first rank, end rank) of what stands at the left (0) or right (1) edge while a piece is built; empty if it can't be."""
        found = self.edges[side].get(piece)
        if found is None:
            name, end, found = self.names[piece], NEVER, []
            while name:
                i = self.ids.get(name)
                here = self.rank[i] if i is not None and len(name) > 1 else -1
                found.append((name, here, end))
                split = self.halves(name)
                if split is None:
                    break
                if split == ("", ""):
                    found = []
                    break
                name, end = split[side], here
            self.edges[side][piece] = found
        return found

    def compatible(self, a: int, b: int) -> bool:
        """Whether pieces a and b next to each other stay so. Ids below 0 are bytes' characters, which merge with nothing."""
        if b < 0:
            return True
        key = (a << 32) + b
        known = self.pairs.get(key)
        if known is None:
            known = bool(left := self.edge(b, 0))
            for r, r_from, r_end in self.edge(a, 1) if known and a >= 0 else ():
                for w, w_from, w_end in left:
                    if max(r_from, w_from) < min(r_end, w_end) and (i := self.ids.get(r + w)) is not None and self.rank[i] < r_end and self.rank[i] <= w_end:
                        known = False
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def stream(self, parts: Iterator[str]) -> Iterator[int]:
        """Ids for a text that comes in parts, already with blank signs; only what isn't committed is kept."""
        text, last, size = "", [-1], [0]  # last[i]: the piece that ends at i, size[i]: its length
        wait = 2 * self.longest
        for part in parts:
            for at in range(0, len(part), 4096):
                text += part[at : at + 4096]
                self.extend(text, last, size)
                if len(text) >= wait:
                    done = self.common(size)
                    yield from self.walk(last, size, done)
                    first = last[done]
                    text, last, size = text[done:], [first, *last[done + 1 :]], [0, *size[done + 1 :]]
                    wait = max(2 * self.longest, 2 * len(text))
        yield from self.walk(last, size, len(text))

    def extend(self, text: str, last: list[int], size: list[int]) -> None:
        """Backpointers for the rest of text: the first piece that ends at a position and is compatible with the one before it is the only one."""
        tails, longest, pairs = self.tails.get, self.longest, self.pairs
        for i in range(len(last), len(text) + 1):
            n = 1
            while n <= i and n <= longest and (piece := tails(text[i - n : i])) is not None:
                if piece >= 0:
                    before = last[i - n]
                    known = pairs.get((before << 32) + piece)
                    if known if known is not None else self.compatible(before, piece):
                        last.append(piece)
                        size.append(n)
                        break
                n += 1
            if len(last) == i:  # a character that no piece holds, or that only stands in longer ones
                last.append(-ord(text[i - 1]) - 2)
                size.append(1)

    def short(self, text: str) -> list[int]:
        """Ids of a unit that is kept whole."""
        last, size = [-1], [0]
        self.extend(text, last, size)
        return self.walk(last, size, len(text))

    def common(self, size: list[int]) -> int:
        """The last boundary that the paths to all positions of the window share."""
        n, counts = len(size) - 1, {}
        window = range(max(0, n - self.longest + 1), n + 1)
        for i in window:
            while i > 0:
                counts[i] = counts.get(i, 0) + 1
                i -= size[i]
        return max((i for i, c in counts.items() if c == len(window)), default=0)

    def walk(self, last: list[int], size: list[int], end: int) -> list[int]:
        out: list[int] = []
        while end > 0:
            piece = last[end]
            out += [piece] if piece >= 0 else [self.byte_ids[b] for b in reversed(chr(-piece - 2).encode("utf-8", "replace"))]
            end -= size[end]
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out, cache = [], self.cache
        for unit in self.units.findall(BLANK + text.replace(" ", BLANK)):
            found = cache.get(unit)
            if found is None:
                found = tuple(self.short(unit) if len(unit) <= LONG else self.stream(iter((unit,))))
                if len(unit) <= LONG:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[unit] = found
            out += found
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        table = self.bytes_of
        data = b"".join([table[i] for i in ids])
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def encode_table(docs: DataFrame, path: str = DEFAULT_MODEL, keep: bool = False) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_ids, ids, round_trip (and the other columns too with keep, whatever their names, but that a caller's own n_ids, ids and round_trip are replaced): a row for each row.

    Null and empty texts have no ids. round_trip says that decoding gives the text back; the blank sign itself decodes as a
    blank. Null and repeated doc_ids keep their rows. An empty table gives none. The model, of
    bounded size, is read by the driver from path and broadcast.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_model(path))
    docs = docs.drop("n_ids", "ids", "round_trip") if keep else docs.select("doc_id", "text")
    names = docs.columns if keep else ["doc_id"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                flat, cut, same = [], [0], []
                for t in part.column("text").to_pylist():
                    text = t or ""
                    ids = codec.encode(text)
                    same.append(codec.decode(ids) == text.replace(BLANK, " "))
                    flat.append(np.array(ids, np.int32))
                    cut.append(cut[-1] + len(ids))
                ids_column = pa.ListArray.from_arrays(np.array(cut, np.int32), np.concatenate(flat) if flat else np.zeros(0, np.int32))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(np.diff(cut), pa.int64()), ids_column, pa.array(same, pa.bool_())], [*names, "n_ids", "ids", "round_trip"])

    return docs.mapInArrow(run, f"{fields}, n_ids long, ids array<int>, round_trip boolean")


def decode_table(encoded: DataFrame, path: str = DEFAULT_MODEL) -> DataFrame:
    """encoded(doc_id, ids) -> doc_id, text. Null ids give null."""
    sent = encoded.sparkSession.sparkContext.broadcast(read_model(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if v is None else codec.decode(v) for v in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
