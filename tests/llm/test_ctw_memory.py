"""Weighing of runs of bytes holds a part of a large group of contexts at a time."""

import tracemalloc

import numpy as np
import pyarrow as pa

from shelfmark.llm import ctw


def hot_runs(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of six bytes that all end with the same two context bytes, and their counts."""
    mixed = np.arange(n, dtype=np.int64) * 2654435761 % (1 << 32)
    codes = np.unique((mixed & 255) | 97 << 8 | 98 << 16 | (mixed >> 8) << 24)
    return codes, (codes % 5).astype(float)


def predicted(codes, counts):
    top = ctw.Top(np.array([97]), np.array([1]), np.array([-3.0]), np.array([2.0]), np.array([3.0]))
    return ctw.log10_predictions(codes, counts, 5, top)


def test_memory_of_a_hot_group():
    codes, counts = hot_runs(400_000)
    tracemalloc.start()
    predicted(codes, counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6  # 619 MB when the group was weighted as a whole


def test_parts_of_a_group_give_the_same(monkeypatch):
    codes, counts = hot_runs(20_000)
    whole, level = predicted(codes, counts), ctw.levels(codes, counts, 5)[-1]
    monkeypatch.setattr(ctw, "STEP_RUNS", 1000)
    assert len(ctw.pieces(codes, 5)) > 3
    np.testing.assert_allclose(predicted(codes, counts), whole, rtol=0, atol=1e-12)
    np.testing.assert_allclose(ctw.level_two(codes, counts, 5).weighted, level.weighted, rtol=1e-12)


def test_asking_and_reading_hold_no_second_copy_of_the_texts():
    rng = np.random.default_rng(7)
    texts = [" ".join(map(str, rng.integers(0, 400, 700))) for _ in range(4000)]
    table = pa.table({"text": texts, "learn": [i % 7 != 2 for i in range(len(texts))], "copies": [1 + i % 2 for i in range(len(texts))]})
    del texts
    tracemalloc.start()
    rows = ctw._ask(ctw.Batch(table), 3, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * table.nbytes
    told = dict(zip(ctw.unpacked(rows[-1][1]).tolist(), ctw.unpacked(rows[-1][2]).tolist()))
    expected: dict[int, int] = {}
    for row in table.to_pylist():
        for code in ctw.runs([ctw.lowered(row["text"])], 5)[0].tolist():
            expected[code] = expected.get(code, 0) + row["copies"] * row["learn"]
    assert told == expected
