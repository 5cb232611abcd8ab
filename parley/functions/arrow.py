"""Arrow batches in pieces, and the best rows of many queries over all batches of a task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

# Bytes of a piece: its rows as Python objects take some ten times as much.
PIECE = 2 << 20


def pieces(batches: Iterable[pa.RecordBatch], most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """The rows of batches, in order, a few at a time: halved until a piece has at most so many bytes, or is one row."""
    for batch in batches:
        waiting = [batch]
        while waiting:
            b = waiting.pop()
            if b.num_rows > 1 and b.nbytes > most:
                half = b.num_rows // 2
                waiting += b.slice(half), b.slice(0, half)
            else:
                yield b


def six(x: np.ndarray) -> np.ndarray:
    """Rounded to six digits, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + (0.5 + 1e-7)) / 1e6, x)


class Best:
    """The k best rows of each of n queries, by score to six digits, then id; at most about 2 k rows a query are kept at a time, apart from those of one piece."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.full(n, -np.inf)
        self.kept, self.more, self.waiting = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)], [], 0

    def add(self, ids: np.ndarray, scores: np.ndarray, valid: np.ndarray | None = None) -> None:
        """scores: a row for each query, a column for each id."""
        rounded = six(scores)
        good = rounded >= self.floor[:, None]
        q, at = np.nonzero(good if valid is None else good & valid)
        self.more.append((q, ids[at], rounded[q, at], scores[q, at]))
        self.waiting += len(q)
        if self.waiting > len(self.kept[0]):
            self._cut()

    def _cut(self) -> None:
        q, i, rounded, score = (np.concatenate(x) for x in zip(self.kept, *self.more, strict=True))
        order = np.lexsort((i, -rounded, q))
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        some = order[place < self.k]
        last = order[place == self.k - 1]
        self.floor[q[place == self.k - 1]] = rounded[last]
        self.kept, self.more, self.waiting = [q[place < self.k], i[some], rounded[some], score[some]], [], 0

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the best."""
        self._cut() if self.more else None
        return self.kept[0], self.kept[1], self.kept[3]
