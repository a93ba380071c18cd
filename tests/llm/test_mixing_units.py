"""Mixing of ids that stand in several sources."""

from collections import Counter

from plumbline.llm import mixing


def test_ids_in_several_sources(spark, monkeypatch):
    rows = [(i, f"a{i}", "a") for i in range(60)] + [(i, f"b{i}", "b") for i in range(40, 80)] + [(None, "a null", "a"), (5, "d5", "d")] + [(None, f"c{i}", "c") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    counts = {"a": 61, "b": 40, "c": 1, "d": 1}
    want = mixing.quotas(counts, {s: n ** mixing.TEMPER for s, n in counts.items()})
    found = []
    for limit in (mixing.BROADCAST_BYTES, 0):
        monkeypatch.setattr(mixing, "BROADCAST_BYTES", limit)
        got = mixing.mix(spark, df, shard_docs=20, block_docs=4).select("doc_id", "source", "shard", "epoch", "text").collect()
        assert {(r.doc_id, r.text, r.source) for r in got} == set(rows)
        assert Counter(s for _, s, _ in {(r.doc_id, r.source, r.epoch) for r in got}) == want
        found.append(Counter(map(tuple, got)))
    assert found[0] == found[1]


def test_large_draws_are_hypergeometric():
    import numpy as np

    rng = np.random.default_rng(1)
    for good, total, n in ((50, 88, 11), (3, 10, 9), (5, 5, 3), (0, 9, 4), (900, 1000, 990)):
        mine = np.array([mixing._hypergeometric(rng, good, total, n) for _ in range(4000)])
        theirs = rng.hypergeometric(good, total - good, n, 4000)
        assert abs(mine.mean() - theirs.mean()) < 0.15 and abs(mine.std() - theirs.std()) < 0.1 and mine.min() >= max(0, n - total + good) and mine.max() <= min(n, good)
    got = mixing.deal(np.array([3 * 10**9, 10**9, 7]), 5)
    assert got.sum(0).tolist() == [3 * 10**9, 10**9, 7] and got.sum(1).max() - got.sum(1).min() <= 1 and (got >= 0).all()


def test_names_ids_and_odd_texts(spark):
    rows = [(f"id{i}", "" if i % 3 else None, "abc"[i % 3], "myshard") for i in range(90)] + [("id1", "x" * 300000, "b", "other")]
    df = spark.createDataFrame(rows, "doc_id string, text string, source string, shard string")
    got = mixing.mix(spark, df, outputs=("s", "e", "k"))
    assert got.columns == ["doc_id", "text", "source", "shard", "s", "e", "k"] and {r.shard for r in got.collect()} == {"myshard", "other"}
    assert {r.doc_id for r in got.collect()} == {r[0] for r in rows}
    assert mixing.mix(spark, df.limit(0), outputs=("s", "e", "k")).columns == got.columns
