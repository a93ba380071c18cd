"""op5: what training costs follows the text, not the table; sums stay right where a slot's counter fills up."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import maxent
from plumbline.llm.textkit import Words


def small(seed=6):
    rng = np.random.default_rng(seed)
    words = Words(pa.array([" ".join(rng.choice(list("abcdefg"), 900)) for _ in range(20)]))
    model = maxent.grow_tree(np.bincount(maxent._buckets(words, 64), minlength=64))
    model.slots = rng.normal(0, 0.3, 10 * maxent.LEVELS).astype(np.float32)
    return model, words


def test_large_table_costs_no_more_a_text():
    model = maxent.grow_tree(np.zeros(1 << 16, np.int64))
    words, took = Words(pa.array(["a few words of text"])), []
    for slots in (1 << 10, 1 << 20):
        model.slots = np.zeros(maxent.LEVELS * slots, np.float32)
        to = maxent.Tally(len(model.slots))
        maxent.tally(model, words, to)
        began = time.process_time()
        for _ in range(5):
            maxent.tally(model, words, to)
        took.append(time.process_time() - began)
    assert took[1] < 5 * took[0] + 0.1  # passes over the parts would take seconds


def test_full_counters(monkeypatch):
    """Parts taken out as they fill up, and the rest, are the plain sums."""
    model, words = small()
    want = {k: np.zeros(len(model.slots)) for k in ("seen", "upper", "expected")}
    bucket, hashes = maxent.encode(words, len(model.rank))
    for _, _, node, up, slot in maxent.decisions(model, bucket, hashes):
        p = 1 / (1 + np.exp(-maxent._chance(model, node, slot).astype(float)))
        for j in range(slot.shape[1]):
            for k, x in (("seen", 1), ("upper", up), ("expected", p)):
                np.add.at(want[k], slot[:, j], x)
    for big in (1 << 26, 1 << 17):
        monkeypatch.setattr(maxent, "BIG", big)
        to, sums = maxent.Tally(len(model.slots)), {k: np.zeros(len(model.slots)) for k in want}
        for _ in range(20):
            maxent.tally(model, words, to)
        assert bool(to.full) == (big == 1 << 17)
        for at, got in to.all():
            for k, x in zip(("seen", "upper", "expected"), got):
                sums[k][at:at + len(x)] += x
        assert (sums["seen"] == 20 * want["seen"]).all() and (sums["upper"] == 20 * want["upper"]).all()
        assert sums["expected"] == pytest.approx(20 * want["expected"], rel=1e-5)


def test_full_counters_in_a_fit(spark, monkeypatch):
    """A fit whose tasks send parts early, which begin amid the pieces that travel, is the same fit."""
    docs = spark.createDataFrame([(" ".join(np.random.default_rng(k).choice(list("abcdefg"), 9000)),) for k in range(40)], "text string")
    models = []
    for big in (1 << 26, 1 << 17):
        monkeypatch.setattr(maxent, "BIG", big)
        models.append(maxent.train(spark, docs, shape=(256, 1500 * maxent.LEVELS), tasks=2))
    assert models[0].slots.any() and models[1].slots == pytest.approx(models[0].slots, abs=1e-5)


def test_whole_waves():
    for n_bytes in (0, 10**6, 863_738_755, 9_900_000_000, 49_500_000_000):
        tasks, size = maxent.task_count(n_bytes, maxent.sizes(n_bytes)[1], 6), maxent.sizes(n_bytes)[1]
        assert tasks % 6 == 0 and tasks >= 6 and n_bytes / tasks <= maxent.TASK_BYTES * size


def test_driver_clusters_in_parts():
    rng = np.random.default_rng(0)
    counts, total = rng.integers(0, 1000, 1 << 19), rng.integers(-10**6, 10**6, (maxent.DIRECTIONS, 1 << 19))
    tracemalloc.start()
    points = maxent.next_directions(total, counts)
    of = maxent.cluster(points, counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(np.unique(of)) == maxent.CLASSES and peak < 100 * len(counts)
