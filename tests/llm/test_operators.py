"""The corpus operators against brute force, exact round trips and held-out labels, with odd rows in every table."""

import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import bpe, chat, hnsw, maxent, mixing, queries, radix, secrets, simhash, substring, toxicity
from plumbline.llm.components import connected_components
from plumbline.llm.shelf import Shelf
from plumbline.llm.textkit import Words

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "lorem ipsum dolor sit amet " * 40000  # a megabyte


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], DOCS)


ODD = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "", None, None), (4, "same text here", "en", "b"), (4, "same text here", "en", "b"), (5, "same text here", "de", "c"), (None, "same text here", "en", "a"),
       (None, None, None, None), (6, LONG, "en", "a"), (7, LONG + "x", "en", "b"), (8, LONG, "fr", "c"), (9, "!!! ---", "en", "a"), (10, "ünïcödé ✓ \U0001F600 text", "en", "a")]


def clashing(df):
    """Columns whose names the operators use themselves."""
    for c in ("key", "copies", "kept", "keep_id", "raw", "shard", "__id", "__text", "__key", "mark", "d1", "n"):
        df = df.withColumn(c, F.lit("x"))
    return df


def components(edges, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, x) for x in range(2001, 2100)]
    want = {n: c for n, c in components(edges, {x for e in edges for x in e}).items()}
    got = {r[0]: r[1] for r in connected_components(spark, spark.createDataFrame([*edges, (None, 1), (5, 5)], "a bigint, b bigint"), Shelf(spark)).collect()}
    assert got == {n: want[n] for n in got} and set(got) == {x for a, b in edges if a != b for x in (a, b)}
    assert connected_components(spark, spark.createDataFrame([], "a bigint, b bigint"), Shelf(spark)).count() == 0


# 1: secrets

KEY = "AKIA" + "ABCDEFGH12345QRS"


def test_secrets(spark):
    rows = ODD + [(20, f"x {KEY} y {KEY}", "en", "a"), (21, f"z {KEY}", "en", "b"), (22, "password = hunter2hunter2", "en", "c"), (22, "password = hunter2hunter2", "en", "c"), (23, "token: abcdefgh", "en", "c"),
                  (24, "api_key='EXAMPLE12345678'", "en", "d"), (None, "secret=q1w2e3r4t5y6", None, None), (25, LONG + " ghp_" + "a1" * 18, "en", "z")]
    got = {(r.doc_id, r.kind): r for r in secrets.scan(clashing(frame(spark, rows))).collect()}
    a = got[20, "aws_access_key"]
    assert (a.occurrences, a.n_docs, a.n_repositories, a.n_owners, a.verdict) == (2, 2, 2, 2, "shared")
    assert got[22, "assigned_secret"].verdict == "live" and got[22, "assigned_secret"].occurrences == 2 and got[22, "assigned_secret"].n_docs == 1
    assert got[23, "assigned_secret"].verdict == "weak" and got[24, "assigned_secret"].verdict == "example" and got[None, "assigned_secret"].verdict == "live"
    assert got[25, "github_token"].verdict == "live" and len(got) == 7
    assert all(KEY not in str(r) for r in got.values())
    assert secrets.scan(frame(spark, [])).count() == 0


# 2: BPE

def test_bpe(spark):
    df = clashing(frame(spark, ODD + [(11, "a" * 100000, "en", "a"), (12, "<|endoftext|>", "en", "a"), (13, " \n\t  " * 20000, "en", "a")]))
    got = bpe.encode(spark, df, piece_chars=1000)
    rows = got.collect()
    assert len(rows) == len(ODD) + 3
    for r in rows:
        assert (r.token_ids is None) == (r.n_tokens is None) == (r.round_trip is None)
        if r.token_ids is not None:
            assert r.round_trip and r.n_tokens == len(r.token_ids)
    texts = {(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()}
    assert {(r.doc_id, r.text) for r in bpe.decode(spark, got).collect()} == texts
    assert bpe.encode(spark, frame(spark, [])).count() == 0
    whole = bpe.encoding(bpe.read_ranks(bpe.RANK_FILE))
    rng = np.random.default_rng(0)
    for _ in range(40):
        t = "".join(rng.choice(list("ab1 .\n'’é✓ s"), 600))
        assert bpe.encode_text(whole, t, 37).tolist() == whole.encode(t, disallowed_special=())
    broken = spark.createDataFrame([(1, whole.encode("✓")[:1])], "doc_id bigint, token_ids array<int>")
    assert bpe.decode(spark, broken).first().text is None


# 3: substring

def _brute_chunks(text):
    """The rules of cutting, byte by byte."""
    raw = text.encode()
    cands = []
    for p in range(substring.GEAR_WINDOW, len(raw)):
        h = 0
        for b in raw[p - substring.GEAR_WINDOW:p]:
            h = ((h << 1) + int(substring._GEAR[b])) & 0xFFFF
        if h & substring.GATE_BITS == 0:
            cands.append(p)
    cuts = [0] + [p for i, p in enumerate(cands) if not i or p - cands[i - 1] >= substring.MIN_GAP] + [len(raw)]
    full = [cuts[0]]
    for c in cuts[1:]:
        while c - full[-1] > substring.MAX_CHUNK:
            full.append(full[-1] + substring.MAX_CHUNK)
        full.append(c)
    out = []
    for c in full[:-1]:
        end = next((e for e in full if e >= c + substring.MIN_CHUNK), None)
        if end is not None:
            out.append((c, raw[c:end]))
        elif c == 0 and len(raw) >= substring.MIN_CHUNK // 2:
            out.append((0, raw))
    return out


def test_chunks_like_brute_force():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdefgh é"), n)) for n in (0, 1, 31, 40, 200, 900, 5000)] + ["z" * 5000]
    row, start, size, d1, d2 = substring.chunks(pa.array(texts))
    got = defaultdict(list)
    for r, s, n in zip(row, start, size):
        got[int(r)].append((int(s), texts[r].encode()[s:s + n]))
    assert [got.get(i, []) for i in range(len(texts))] == [_brute_chunks(t) for t in texts]
    by = defaultdict(set)
    for r, s, n, a, b in zip(row, start, size, d1, d2):
        by[texts[r].encode()[s:s + n]].add((a, b))
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)


def test_repeated_passages(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(52) for _ in range(30)]
    rows = [(100 + i, prose(int(rng.integers(20, 80))), "en", "a") for i in range(60)]
    holders = set()
    for k, p in enumerate(passages):
        for i in (2 * k, 2 * k + 1):
            rows[i] = (rows[i][0], rows[i][1] + " " + p + " " + prose(30), "en", "a")
            holders.add(rows[i][0])
    clean = [(500 + i, prose(200), "en", "a") for i in range(60)]
    got = substring.repeated_passages(spark, clashing(frame(spark, rows + clean + ODD))).collect()
    found = {r.doc_id for r in got}
    assert holders <= found and not found & {c[0] for c in clean}
    text = {i: t for i, t, _, _ in rows}
    for r in got:
        if r.doc_id in text:
            span = text[r.doc_id].encode()[r.start:r.end]
            assert any(span in p.encode() or p.encode() in span or len(span) > 40 for p in passages) and r.kept == (r.doc_id == r.keep_id)
    assert {6, 7, 8} <= found and substring.repeated_passages(spark, frame(spark, [])).count() == 0


def _brute_passages(rows):
    """Passages from the brute-force chunks of all texts, by the definition."""
    seen = defaultdict(list)
    for i, t, _, _ in rows:
        if i is not None and t is not None:
            for start, raw in _brute_chunks(t):
                seen[raw].append((i, start, start + len(raw)))
    by = defaultdict(list)
    for places in seen.values():
        if len(places) > 1:
            first = min(places)
            for i, a, b in places:
                by[i, first[0], (i, a) == first[:2]].append((a, b, len(places)))
    out = []
    for (i, keep, kept), spans in by.items():
        spans.sort()
        begin, end, most = spans[0]
        for a, b, n in spans[1:]:
            if a > end:
                out.append((i, begin, end, keep, most, kept))
                begin, end, most = a, b, n
            end, most = max(end, b), max(most, n)
        out.append((i, begin, end, keep, most, kept))
    return Counter(out)


def test_passages_like_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(12)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghé"), rng.integers(2, 8))) for _ in range(n))
    shared = [prose(40) for _ in range(6)]
    rows = [(i, prose(int(rng.integers(0, 40))) + shared[i % 6] + prose(int(rng.integers(5, 40))) + (shared[0] if i % 4 else ""), "en", "a") for i in range(40)]
    rows += [(3, rows[3][1], "en", "a"), (90, "", "en", "a"), (91, None, "en", "a"), (None, shared[0], "en", "a"), (92, rows[5][1], "en", "b")]
    df = clashing(frame(spark, rows))
    want = _brute_passages(rows)
    for hot, least in ((substring.HOT_KEYS, None), (10**9, 8)):  # once more with every half that repeats a few times counted as frequent
        monkeypatch.setattr(substring, "HOT_KEYS", hot)
        if least:
            monkeypatch.setattr(substring, "LEAST_HOT", least)
        got = substring.repeated_passages(spark, df).collect()
        assert Counter((r.doc_id, r.start, r.end, r.keep_id, r.copies, r.kept) for r in got) == want


def test_drop_passages(spark):
    rng = np.random.default_rng(13)
    prose = lambda n: " ".join("".join(rng.choice(list("abcdefghé"), rng.integers(2, 8))) for _ in range(n))
    shared = prose(120)
    rows = [(21, "one " + shared + " end", "en", "a"), (22, prose(50) + shared + prose(50), "en", "a"), (23, prose(100), "en", "a"), *ODD[:5], (None, shared, "en", "a")]
    df = clashing(frame(spark, rows))
    kept = substring.drop_passages(spark, df)
    assert kept.columns == df.columns
    got = {r.doc_id: r.text for r in kept.collect() if r.doc_id in (21, 22, 23)}
    assert got[21] == rows[0][1] and got[23] == rows[2][1] and len(got[22].encode()) < len(rows[1][1].encode()) - len(shared.encode()) + 300
    assert rows[1][1].startswith(got[22][:40]) and rows[1][1].endswith(got[22][-40:])
    assert kept.count() == len(rows) and substring.drop_passages(spark, df.limit(0)).count() == 0


# 4: toxicity

def test_toxicity(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = docs.join(F.broadcast(labels.select("doc_id")), "doc_id").select(docs.columns)
    fit, rest = labels.where("doc_id % 3 > 0"), labels.where("doc_id % 3 = 0")
    model = toxicity.fit(docs, fit)
    got = toxicity.score(spark, docs, model).join(rest, "doc_id").collect()
    bad, good = [r.is_toxic for r in got if r.toxic], [r.is_toxic for r in got if not r.toxic]
    assert np.mean(bad) >= 0.85 and np.mean(good) <= 0.02
    odd = toxicity.score(spark, clashing(frame(spark, ODD)), model).collect()
    assert len(odd) == len(ODD) and all(r.toxicity == 0 and not r.n_windows for r in odd if r.doc_id in (1, 2, 3, 9))
    assert next(r.n_windows for r in odd if r.doc_id == 6) == math.ceil((200000 - toxicity.WINDOW) / toxicity.STRIDE) + 1
    kept = toxicity.drop_toxic(spark, docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count() - toxicity.score(spark, docs, model).where("is_toxic").count()
    assert toxicity.fit(docs, labels.limit(0)) is None and toxicity.score(spark, docs, None).where("is_toxic or toxicity > 0").count() == 0
    # The last window counts as much as the first.
    toxic = docs.join(labels.where("toxic = 1"), "doc_id").select("text").first()[0]
    tail = frame(spark, [(1, " ".join(["the of and"] * 5000) + " " + toxic, "en", "a"), (2, " ".join(["the of and"] * 5000), "en", "a")])
    assert {r.doc_id: r.is_toxic for r in toxicity.score(spark, tail, model).collect()} == {1: True, 2: False}


def test_toxicity_gradient():
    """The hand-written backward pass against finite differences."""
    rng = np.random.default_rng(9)
    model = toxicity.Model(np.arange(1, 6, dtype=np.uint64), np.arange(1, 8, dtype=np.uint64), np.zeros(5, np.float32), np.zeros(7, np.float32))
    model.p = {k: v.astype(np.float64) + rng.normal(0, 0.2, v.shape) for k, v in model.p.items()}
    pre = rng.normal(size=(3, toxicity.WINDOW, 6 * toxicity.HIDDEN))
    mask = (np.arange(toxicity.WINDOW) < np.array([[32], [5], [1]])).astype(np.float64)
    weight = rng.normal(size=3)
    out = model.forward(pre, mask, keep=True)
    grads, dpre = model.backward(weight, *out[1:])
    loss = lambda: float(model.forward(pre, mask) @ weight)

    def slope(a, at, h=1e-3):
        a[at] += h
        up = loss()
        a[at] -= 2 * h
        down = loss()
        a[at] += h
        return (up - down) / (2 * h)

    for name in ("v", "o", "c", "U"):
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in model.p[name].shape)
            assert grads[name][at] == pytest.approx(slope(model.p[name], at), rel=0.02, abs=2e-3), name
    for at in ((0, 0, 3), (0, 31, 40), (1, 4, 17), (1, 2, 30), (2, 0, 25)):
        assert dpre[at] == pytest.approx(slope(pre, at), rel=0.02, abs=2e-3)
    assert not dpre[1, 5:].any()


def test_features_by_slices(monkeypatch):
    """Gathered slice by slice, the words of a column and their n-grams are those of the whole."""
    texts = pa.array(["some words are here, some elsewhere", None, "words", "", "elsewhere are others"] * 3)
    whole = toxicity.Features(texts)
    real = toxicity.slices
    monkeypatch.setattr(toxicity, "slices", lambda batch, text: real(batch, text, 10))
    parts = toxicity.Features(texts)
    assert (whole.hash[whole.word] == parts.hash[parts.word]).all() and (whole.count == parts.count).all()
    for a, b in zip(whole.pieces, parts.pieces):
        assert {*zip(whole.hash[a[0]].tolist(), a[1].tolist())} == {*zip(parts.hash[b[0]].tolist(), b[1].tolist())} and len(a[0]) == len(b[0])


def test_models_travel(tmp_path):
    """Workers need not have the package: models go to them as arrays."""
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
from plumbline.llm import maxent, toxicity
s = SparkSession.builder.master("local-cluster[1,1,1024]").config("spark.executor.memory", "900m").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").getOrCreate()
d = s.read.parquet("{SF}/documents.parquet")
assert maxent.score(s, d, maxent.train(s, d)).where("perplexity > 1").count() > 100
assert toxicity.score(s, d, toxicity.fit(d, s.read.parquet("{SF}/labels.parquet"))).where("n_windows > 0").count() > 100
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300, env={k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr[-2000:]


def test_windows():
    for n in (0, 1, 31, 32, 33, 48, 49, 500):
        start, size, row = toxicity.windows(np.array([n]))
        covered = sorted({w for s, k in zip(start, size) for w in range(s, s + k)})
        assert covered == list(range(n)) and (not n or max(size) <= toxicity.WINDOW)


# 5: language model

def test_lm(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = maxent.train(spark, docs)
    got = {r.doc_id: r for r in maxent.score(spark, docs, model).collect()}
    assert len(got) == docs.count()
    # Every distribution sums to one: over all buckets for some histories; brute force walks the tree word by word.
    words = Words(pa.array(["the cat sat on the mat", "a"]))
    bucket, hashes = maxent.encode(words, len(model.rank))
    every = np.arange(len(model.rank))
    for i in (0, 4, 6):
        p = np.zeros(len(every))
        for _, at, node, up, slot in maxent.decisions(model, every, np.repeat(hashes[i:i + 1], len(every), axis=0)):
            x = maxent._chance(model, node, slot).astype(float)
            p[at] += np.where(up, -np.log1p(np.exp(-x)), -np.log1p(np.exp(x)))
        assert np.exp(p).sum() == pytest.approx(1, abs=1e-4)
        assert maxent.log_probs(model, words)[i] == pytest.approx(p[bucket[i]], abs=1e-4)

    def brute(rank, row):
        node, out, level, part = 0, 0.0, 0, len(model.slots) // maxent.LEVELS
        while node >= 0:
            up = rank >= model.split[node]
            key = (node + 1) * int(maxent._STEP) % 2**64
            slots = [(((int(h) ^ key) * 0xD6E8FEB86659FD93 % 2**64 >> 32) * part >> 32) + min(level, maxent.LEVELS - 1) * part for h in (row if level < maxent.SKIP_LEVELS else row[:2])]
            level += 1
            x = float(model.bias[node]) + sum(float(model.slots[s]) for s in slots)
            out -= math.log1p(math.exp(-x if up else x))
            node = int((model.high if up else model.low)[node])
        return out

    assert maxent.log_probs(model, words) == pytest.approx([brute(model.rank[bucket[i]], hashes[i]) for i in range(len(bucket))], abs=1e-4)
    odd = maxent.score(spark, clashing(frame(spark, ODD)), model).collect()
    assert len(odd) == len(ODD) and all((r.perplexity is None) == (r.n_words == 0) for r in odd)
    empty = maxent.train(spark, frame(spark, []))
    assert maxent.score(spark, frame(spark, [(1, "a b", "en", "a")]), empty).first().perplexity > 100
    assert maxent.score(spark, docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), empty).schema["doc_id"].dataType.simpleString() == "string"
    odd_model = maxent.train(spark, clashing(frame(spark, ODD)))
    assert odd_model.slots.any()


def test_lm_gradient():
    """Observed less expected counts are the gradient of the log likelihood."""
    rng = np.random.default_rng(6)
    words = Words(pa.array([" ".join(rng.choice(list("abcdefg"), 60)) for _ in range(20)]))
    model = maxent.grow_tree(np.bincount(maxent._buckets(words, 64), minlength=64))
    model.slots = rng.normal(0, 0.3, 10 * maxent.LEVELS).astype(np.float32)
    sums = {k: np.zeros(len(model.slots)) for k in ("expected", "seen", "upper")}
    maxent.gather(model, words, sums)
    for k in range(0, len(model.slots), 7):
        both = []
        for h in (0.01, -0.01):
            model.slots[k] += h
            both.append(maxent.log_probs(model, words).sum())
            model.slots[k] -= h
        assert (both[0] - both[1]) / 0.02 == pytest.approx(sums["upper"][k] - sums["expected"][k], rel=0.02, abs=0.1)


def test_lm_held_out(spark):
    """Far below a unigram on unseen documents, whatever the number of tasks."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    part = F.pmod(F.xxhash64(F.substring("text", 1, 40)), F.lit(5))  # copies share their beginning and fall on one side
    fit, rest = docs.where(part < 2), docs.where(part == 4)
    models = [maxent.train(spark, fit.repartition(n), tasks=n) for n in (4, 64)]
    scores = [{r.doc_id: r for r in maxent.score(spark, rest, m).collect()} for m in models]
    assert all(abs(scores[1][i].log_prob - r.log_prob) <= 1e-3 * max(1, abs(r.log_prob)) for i, r in scores[0].items())
    buckets = len(models[0].rank)
    count = lambda df: sum(np.bincount(maxent._buckets(Words(b.column(0)), buckets), minlength=buckets) for b in df.select("text").toArrow().to_batches(500))
    seen, wanted = count(fit) + 1, count(rest)
    unigram = -(wanted * np.log(seen / seen.sum())).sum() / wanted.sum()
    for s in scores:
        ours = -sum(r.log_prob for r in s.values()) / sum(r.n_words for r in s.values())
        assert math.exp(ours) <= 0.7 * math.exp(unigram)


# 6: vectors

def test_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(1500, 32))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    for k in range(200):
        rows.append((2000 + k, (v[k] * 3 + rng.normal(scale=0.05, size=32)).tolist()))
    rows += [(5000 + k, v[300].tolist()) for k in range(120)]  # more copies than a beam holds
    rows += [(7000, None), (7001, []), (7002, [0.0] * 32), (7003, [float("nan")] * 32), (None, v[0].tolist()), (7004, [1.0, 2.0]), (7005, [2.0, 4.0]), (7006, [1.0, None]), (0, v[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("shard", F.lit(1)).withColumn("id", F.lit(2))
    got = {r.vec_id: r for r in hnsw.near_groups(spark, df, shard_rows=500).collect()}
    ids = [i for i, x in rows if i is not None and i < 7000]
    m = np.array([x for i, x in rows if i is not None and i < 7000])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    a, b = np.nonzero(np.triu(m @ m.T >= hnsw.COSINE, 1))
    want = components([(ids[x], ids[y]) for x, y in zip(a, b)] + [(7004, 7005)], {*ids, 7004, 7005})
    groups = {n: c for n, c in want.items() if sum(1 for x in want.values() if x == c) > 1}
    right = sum(1 for n, c in groups.items() if got[n].keep_id == c)
    assert right >= 0.98 * len(groups) and set(got) == set(want) and all(got[n].copies == 1 and got[n].kept for n in want if n not in groups)
    assert got[300].copies == 121 and got[5000].keep_id == 300 and not got[5000].kept and got[300].kept
    assert hnsw.near_groups(spark, df.limit(0)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(4)
    v = rng.normal(size=(3000, 24)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    g = hnsw.Graph.load(hnsw.Graph(v).dump())
    s = v @ v.T
    want = np.argsort(-s, axis=1)[:, :10]
    got, _ = g.find(v, 96)
    assert np.mean([len(set(a) & set(b)) for a, b in zip(want.tolist(), got.tolist())]) >= 9
    for n in (1, 2, 5, 70):
        ids, sims = hnsw.Graph(v[:n]).find(v[:n], 3)
        assert (ids == np.arange(n)[:, None]).any(1).all()


# 7: mixing

def test_quotas_and_deal():
    assert mixing.quotas({"a": 100, "b": 50, "c": 0}, {"a": 1, "b": 1, "c": 5, "d": 1}) == {"a": 100, "b": 100}
    assert mixing.quotas({"a": 100, "b": 50}, {"a": 3, "b": 1}, 10) == {"a": 8, "b": 2} or sum(mixing.quotas({"a": 100, "b": 50}, {"a": 3, "b": 1}, 10).values()) == 10
    blocks = np.array([50, 30, 7, 1])
    got = mixing.deal(blocks, 9)
    assert (got.sum(0) == blocks).all() and got.sum(1).max() - got.sum(1).min() <= 1 and (got >= 0).all()
    # A shard's share of a source is hypergeometric: its mean and variance over many deals.
    draws = np.array([mixing.deal(blocks, 8, seed)[3, 0] for seed in range(600)])
    total, n = blocks.sum(), 11
    mean, var = n * 50 / total, n * (50 / total) * (38 / total) * (total - n) / (total - 1)
    assert draws.mean() == pytest.approx(mean, abs=0.25) and draws.var() == pytest.approx(var, rel=0.25)


def test_mix(spark, monkeypatch):
    rows = [(i, f"text {i}", "en", "abc"[min(i % 5, 2)]) for i in range(1000)] + [(2000, "", None, None), (None, None, None, "a"), (5, "text 5", "en", "abc"[min(5 % 5, 2)])]
    df = clashing(frame(spark, rows))
    counts = {"a": 201, "b": 200, "c": 600, None: 1}
    for kw in ({}, {"weights": {"a": 2, "b": 1, "c": 1}}, {"weights": {"a": 1, "b": 1, None: 1}, "size": 100}, {"temper": 0.5}):
        got = mixing.mix(spark, df, shard_docs=100, block_docs=8, **kw).select("doc_id", "source", "shard", "epoch", "text", "n").collect()
        units = Counter(r.source for r in {(r.doc_id, r.source, r.epoch): r for r in got}.values())
        weights = kw.get("weights") or {s: n ** kw.get("temper", mixing.TEMPER) for s, n in counts.items()}
        want = mixing.quotas({str(s): n for s, n in counts.items()}, {str(s): w for s, w in weights.items()}, kw.get("size"))
        assert {str(s): n for s, n in units.items()} == want, kw
        assert max(Counter((r.doc_id, r.epoch) for r in got).values()) <= 2  # the repeated row goes with its id
        if "size" not in kw:
            assert {r.doc_id for r in got} >= {i for i, _, _, s in rows if s in weights}
        monkeypatch.setattr(mixing, "BROADCAST_BYTES", 0)
        again = mixing.mix(spark, df, shard_docs=100, block_docs=8, **kw).select("doc_id", "shard", "epoch").collect()
        monkeypatch.undo()
        assert Counter(map(tuple, again)) == Counter((r.doc_id, r.shard, r.epoch) for r in got)
    assert mixing.mix(spark, frame(spark, [])).count() == 0 and mixing.mix(spark, df, weights={"z": 1}).count() == 0
    order = mixing.mix(spark, df, shard_docs=5000).select("doc_id").toPandas()["doc_id"].tolist()
    assert order != sorted(order, key=lambda x: (x != x, x))


# 8: chat

def test_chat(spark):
    rows = [(1, 2, "user", "b"), (1, 1, "user", "a"), (1, 3, "assistant", "c"), (1, 3, "assistant", "c"), (2, 1, None, ""), (2, 2, "user", None), (3, 1, "user", None), (None, 1, "user", "x"), (None, None, "user", "w"),
            (4, 1, "user", "t" * 1000000), (5, 1, "b", "2"), (5, 1, "a", "9"), (5, 1, "b", "1")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("turns", F.lit(1)).withColumn("places", F.lit(1))
    got = {r.conv_id: r for r in chat.format_chats(df).collect()}

    def brute(conv):
        turns = sorted(((-1 if t is None else t, r or "unknown", x) for c, t, r, x in rows if c == conv and x is not None))
        return "".join(f"<|{role}|>\n" + "\n".join(x for _, _, x in run) + "<|end|>\n" for role, run in ((k, list(g)) for k, g in itertools.groupby(turns, key=lambda t: t[1])))

    assert set(got) == {1, 2, None, 4, 5} and all(r.chat == brute(c) for c, r in got.items())
    assert (got[1].n_turns, got[1].n_messages) == (4, 2) and chat.format_chats(df.limit(0)).count() == 0
    plan = chat.format_chats(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Exchange") <= 2


# 9: SimHash

def test_trie_join_like_brute_force():
    rng = np.random.default_rng(5)
    hi, lo = rng.integers(0, 1 << 63, (2, 400), dtype=np.uint64)
    for k in range(150):  # neighbours at all distances
        flips = rng.choice(128, rng.integers(0, 40), replace=False)
        i = rng.integers(0, 250)
        h, l = int(hi[i]), int(lo[i])
        for f in flips:
            h, l = (h ^ (1 << (63 - f)), l) if f < 64 else (h, l ^ (1 << (127 - f)))
        hi[250 + k], lo[250 + k] = h, l
    dist = np.bitwise_count(hi[:, None] ^ hi) + np.bitwise_count(lo[:, None] ^ lo)
    want = set(zip(*np.nonzero(np.triu(dist <= simhash.BUDGET, 1))))
    for m in (1, 2, 3, 6):
        width, small, found = 128 // m, simhash.BUDGET // m, set()
        for walk in range(m):
            h, l = simhash.rotate(hi, lo, walk * width)
            order = np.lexsort((l, h))
            for i, j in simhash.trie_pairs(h[order], l[order], h[order], l[order], width=width, small=small, budget=simhash.BUDGET, same=True):
                found |= {(min(a, b), max(a, b)) for a, b in zip(order[i].tolist(), order[j].tolist())}
        assert found == want


def test_simhash(spark):
    docs = frame(spark, [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(i + 100000 if i else i, t, a, b) for i, t, a, b in ODD])
    got = {r.doc_id: r.keep_id for r in simhash.near_groups(spark, clashing(docs), tile_codes=64).collect()}
    rows = simhash.codes(docs).collect()
    code = np.array([[r.hi, r.lo] for r in rows], np.int64).view(np.uint64)
    dist = np.bitwise_count(code[:, None, 0] ^ code[:, 0]) + np.bitwise_count(code[:, None, 1] ^ code[:, 1])
    ids = [r.doc_id for r in rows]
    want = components([(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(dist <= simhash.BUDGET, 1)))], set(ids))
    size = Counter(want.values())
    assert got == {n: c for n, c in want.items() if size[c] > 1}
    assert got[100006] == got[100008] == 100006 and got[100005] == 100004 and 100001 not in got and 100009 not in got
    kept = simhash.drop_near_duplicates(spark, docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - sum(1 for r in docs.collect() if r.doc_id in got and got[r.doc_id] != r.doc_id)
    assert simhash.near_groups(spark, docs.limit(0)).count() == 0


# 10: exact

def test_radix(spark):
    rows = ODD + [(30, "p" * 300 + "a", "en", "a"), (31, "p" * 300 + "b", "en", "a"), (32, "p" * 300 + "a", "en", "a"), (33, "p" * 32, "en", "a"), (34, "p" * 32, "en", "a"), (35, "p" * 31, "en", "a"), (36, "é" * 20, "en", "a"),
                  (37, "é" * 20, "en", "b"), (38, "e" * 20, "en", "b")]
    df = clashing(frame(spark, rows))
    by = defaultdict(list)
    for i, t, _, _ in rows:
        if t is not None:
            by[t].append(i)
    want = Counter((i, min((x for x in m if x is not None), default=None), len(m)) for m in by.values() if len(m) > 1 for i in m)
    for first, growth in ((32, 8), (1, 2)):
        got = radix.exact_groups(spark, df, first=first, growth=growth).collect()
        assert Counter((r.doc_id, r.keep_id, r.copies) for r in got) == want and all(r.kept == (r.doc_id == r.keep_id) for r in got)
    kept = radix.drop_exact_duplicates(spark, df)
    assert kept.columns == df.columns
    texts = Counter(r.text for r in kept.collect())
    assert texts == Counter({**{t: 1 for t in by}, None: 2}) and {r.doc_id for r in kept.where("text = 'same text here'").collect()} == {4}
    # An id may carry several texts: only the repeated one goes.
    twice = frame(spark, [(1, "a", "x", "s"), (2, "a", "x", "s"), (2, "b", "x", "s")])
    assert sorted((r.doc_id, r.text) for r in radix.drop_exact_duplicates(spark, twice).collect()) == [(1, "a"), (2, "b")]
    assert radix.exact_groups(spark, df.limit(0)).count() == 0 and radix.drop_exact_duplicates(spark, df.limit(0)).count() == 0


def test_registered():
    names = set(queries.queries())
    assert {int(n[2:].split("_")[0]) for n in names} == set(range(1, 11)) and set(queries.oracle_sql()) <= names
