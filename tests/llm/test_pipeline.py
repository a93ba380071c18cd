"""The corpus pipeline against a brute-force version of each stage."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import bpe, mixing, simhash, toxicity

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(spark, docs, model).where("is_toxic").collect()}
    left = {i: r for i, r in rows.items() if i not in toxic}
    first: dict[str, int] = {}
    for i in sorted(left):
        first.setdefault(left[i].text, i)
    left = {i: r for i, r in left.items() if first[r.text] == i}
    codes = simhash.codes(docs.where(F.col("doc_id").isin(list(left)))).collect()
    code = np.array([[r.hi, r.lo] for r in codes], np.int64).view(np.uint64)
    dist = np.bitwise_count(code[:, None, 0] ^ code[:, 0]) + np.bitwise_count(code[:, None, 1] ^ code[:, 1])
    ids = [r.doc_id for r in codes]
    up = {i: i for i in left}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in zip(*np.nonzero(np.triu(dist <= simhash.BUDGET, 1))):
        x, y = root(ids[a]), root(ids[b])
        up[max(x, y)] = min(x, y)
    left = {i: r for i, r in left.items() if root(i) == i}
    counts = Counter(r.source for r in left.values())
    want = mixing.quotas(dict(counts), {s: n ** mixing.TEMPER for s, n in counts.items()})
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in got} == set(left)  # nobody clean is lost, and nothing else is left
    assert Counter(rows[r.doc_id].source for r in got) == want
    enc = bpe.encoding(bpe.read_ranks(bpe.RANK_FILE))
    assert all(r.round_trip and r.token_ids == enc.encode(rows[r.doc_id].text, disallowed_special=()) for r in got)


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "mixing", "bpe"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    empty = docs.limit(0)
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, empty, SF).count() == 0
    for _, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs, SF).columns == docs.columns
