import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from parley.functions.arrow import PIECE, Best, pieces
from parley.operators import evaluate, fuse, segment


def test_pieces_are_small_and_whole():
    r = random.Random(1)
    batch = pa.record_batch({"id": pa.array(range(5000)), "t": pa.array(["x" * r.randrange(4000) for _ in range(4999)] + ["y" * 2 * PIECE])})
    parts = list(pieces([batch, batch.slice(0, 0)]))
    assert [i for b in parts for i in b.column("id").to_pylist()] == list(range(5000))
    assert all(b.nbytes <= PIECE or b.num_rows == 1 for b in parts) and len(parts) < 40


def test_sequential_routines_take_pieces(monkeypatch):
    """Every Python routine over whole turns turns a piece of a batch into objects at a time, not all of it."""
    largest = []
    words = [{"pos": i, "word": "word.", "start_s": float(i), "end_s": i + 0.5} for i in range(40)]
    rows = {"conv_id": [1] * 4000, "turn": list(range(4000)), "role": ["a"] * 4000, "w": [words] * 4000, "id": list(range(4000)), "query": ["word"] * 4000, "words": [words] * 4000, "text": ["word. " * 40] * 4000, "matched_text": ["word."] * 4000, "start_s": [0.0] * 4000, "end_s": [40.0] * 4000}
    batch = pa.record_batch(rows)
    seen = lambda batches: (largest.append(b.nbytes) or b for b in pieces(batches))
    for module in (segment, evaluate, fuse):
        monkeypatch.setattr(module, "pieces", seen)
    frame = SimpleNamespace(select=lambda *_: frame, mapInArrow=lambda run, _: sum(b.num_rows for b in run(iter([batch]))))
    monkeypatch.setattr(segment, "_turns", lambda _: frame)
    for found in (segment.chunks(frame), segment.sentences(frame), fuse.keyword_clips(frame), evaluate.tightened(frame)):
        assert found >= 4000
    assert len(largest) > 20 and max(largest) <= PIECE


def test_best_of_many_batches():
    r, best = np.random.default_rng(3), Best(5, 4)
    every = []
    for b in range(30):
        ids, scores = np.arange(100 * b, 100 * b + 100)[::-1], np.round(r.integers(0, 6, (5, 100)) / 3, 6)
        best.add(ids, scores, scores > 0)
        every += [(q, -scores[q, j], ids[j]) for q in range(5) for j in range(100) if scores[q, j] > 0]
        assert len(best.kept[0]) <= 20
    q, ids, scores = best.rows()
    assert sorted(zip(q.tolist(), (-scores).tolist(), ids.tolist())) == [x for k in range(5) for x in sorted(e for e in every if e[0] == k)[:4]]
