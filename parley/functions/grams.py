"""Trigrams of many texts at once, as whole numbers, and the word similarity of short queries to all of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain
from math import inf

import numpy as np

from parley.functions import text as T

# Positions that are looked at together, and the longest stretch of positions that is.
SEGMENT, WIDEST = 20_000, 256


def coded(lists: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The trigrams of T.trigrams of each list's words in order, as three characters of 21 bits, and the number of the list of each."""
    words = list(chain.from_iterable(lists))
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = np.frombuffer(f"  {'   '.join(words)} ".encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    code = c[:-2] << 42 | c[1:-1] << 21 | c[2:]
    own = np.ones(len(code) + 2, bool)
    ends = np.cumsum(lengths + 3)
    own[ends - 1] = own[ends - 2] = False
    return code[own[: len(code)]], np.repeat(np.repeat(np.arange(len(lists)), [len(x) for x in lists]), lengths + 1)


class Similar:
    """Word similarity (T.word_similarity) of some queries to texts, exactly, for pairs at or over a threshold.

    A text's trigrams are numbered once for all queries. A stretch of the text that reaches the threshold holds few trigrams besides the query's, so for each place of a query's trigram only the next
    places within that bound are looked at, for all queries and many texts in one step.
    """

    def __init__(self, queries: Sequence[str], threshold: float):
        codes, owner = coded([T.WORD.findall(q.lower()) for q in queries])
        self.queries, self.threshold, self.least = queries, threshold, threshold - 1e-6
        self.known = np.unique(codes)
        self.wants = np.zeros((len(queries), len(self.known)), np.float32)
        self.wants[owner, np.searchsorted(self.known, codes)] = 1
        self.sizes = self.wants.sum(1).astype(np.int64)

    def scores(self, texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[float]]]:
        """(text, query, score to six digits) by groups of texts."""
        group, words, n = [], [], 0
        for i, t in enumerate(texts):
            found = T.WORD.findall((t or "").lower())
            group.append(i)
            words.append(found)
            n += sum(map(len, found)) + len(found)
            if n >= SEGMENT:
                yield self._group(texts, group, words)
                group, words, n = [], [], 0
        yield self._group(texts, group, words)

    def _group(self, texts: Sequence[str], group: list[int], words: list[list[str]]) -> tuple[np.ndarray, np.ndarray, list[float]]:
        codes, owner = coded(words)
        if not len(codes) or not len(self.known):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), []
        gram = np.searchsorted(self.known, codes).clip(max=len(self.known) - 1)
        hit = np.flatnonzero(self.known[gram] == codes)
        have = np.zeros((len(words), len(self.known)), np.float32)
        have[owner[hit], gram[hit]] = 1
        shared = have @ self.wants.T
        text, query = np.nonzero((shared > 0) & (shared >= self.least * self.sizes))
        present, size = shared[text, query].astype(np.int64), self.sizes[query]
        # more trigrams than this in a stretch, and it stays under the threshold whatever it shares
        limit = np.floor(present * (1 + 1 / self.least) - size + 1e-6) if self.least > 0 else np.full(len(text), inf)
        best = np.zeros(len(text))
        if len(text):
            again = self._stretches(codes, owner, gram, hit, text, query, size, limit, best)
            for k in np.flatnonzero(again):
                best[k] = T.word_similarity(self.queries[query[k]], texts[group[text[k]]])
        score = [round(x, 6) for x in best.tolist()]
        kept = np.flatnonzero(np.array(score) >= self.threshold) if score else np.zeros(0, np.int64)
        return np.array(group)[text[kept]], query[kept], [score[k] for k in kept]

    def _stretches(self, codes, owner, gram, hit, text, query, size, limit, best) -> np.ndarray:
        """Puts the pairs' scores into best; returns which pairs need a plain look, because a stretch within the bound is longer than WIDEST."""
        n, again = len(codes), np.zeros(len(text), bool)
        order = np.lexsort((codes, owner))
        same = (codes[order[1:]] == codes[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
        before = np.full(n, -1)
        before[order[1:][same]] = order[:-1][same]
        width = int(min(WIDEST, 2 * limit.max() + 16))
        padded = np.concatenate([before, np.full(width, n)])
        stop = np.searchsorted(owner, owner, "right")
        pairs, first_pair = np.bincount(text, minlength=int(owner[-1]) + 1), np.searchsorted(text, np.arange(int(owner[-1]) + 2))
        for a in range(0, n, SEGMENT):
            b = min(a + SEGMENT, n)
            view = np.lib.stride_tricks.sliding_window_view(padded[a : b + width - 1], width)
            places = np.arange(a, b)[:, None]
            extent = np.cumsum((view < places) & (np.arange(width) < (stop[a:b, None] - places)), axis=1, dtype=np.int16)
            near = hit[np.searchsorted(hit, a) : np.searchsorted(hit, min(b + width, n))]
            times = pairs[owner[near]]
            at = np.repeat(near, times)
            pair = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times) + first_pair[owner[at]]
            wanted = self.wants[query[pair], gram[at]] > 0
            at, pair = at[wanted], pair[wanted]
            order = np.argsort(pair, kind="stable")
            at, pair = at[order], pair[order]
            low = np.flatnonzero(at < b)
            # a stretch that ends at the last place looked at, but may go on within the bound
            open_ = (extent[at[low] - a, -1] <= limit[pair[low]]) & (stop[at[low]] - at[low] > width)
            again[pair[low[open_]]] = True
            # a stretch must hold so many of the query's trigrams within the bound
            last = low + np.maximum(np.ceil(self.least * size[pair[low]]).astype(np.int64), 1) - 1
            low, last = low[last < len(at)], last[last < len(at)]
            length = at[last] - at[low]
            fits = (pair[last] == pair[low]) & (length < width)
            low, length = low[fits], length[fits]
            low = low[extent[at[low] - a, length] <= limit[pair[low]]]
            seen, high = np.zeros(len(low), np.int64), low.copy()
            while len(low):
                length = at[high] - at[low]
                inside = length < width
                low, high, seen, length = low[inside], high[inside], seen[inside], length[inside]
                p, x = pair[low], extent[at[low] - a, length]
                alive = x <= limit[p]
                low, high, seen, p, x = low[alive], high[alive], seen[alive], p[alive], x[alive]
                seen = seen + (before[at[high]] < at[low])
                np.maximum.at(best, p, seen / (size[p] + x - seen))
                high = high + 1
                on = high < len(at)
                on[on] = pair[high[on]] == p[on]
                low, high, seen = low[on], high[on], seen[on]
        return again
