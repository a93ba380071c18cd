"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into blocks of a random permutation of its documents.
The tree splits the blocks of all sources among the output shards: a node
holds the number of blocks of each source that its shards receive, and gives
its left half a multivariate-hypergeometric draw of them.  Thus every shard
gets exactly its share of blocks, every source exactly its quota, and the
composition of a shard is that of a uniformly random deal.  A shard then owns
disjoint runs of permuted blocks and is shuffled by itself.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shelf import BROADCAST_BYTES, Shelf, fresh

TEMPER = 0.9  #: without given weights, a source weighs its number of documents to this power
BLOCK_DOCS = 16
SHARD_DOCS, SHARDS = 8192, 1 << 16  #: without a given size shards hold so many documents; more, if there were more than so many shards
SEED = 20240601
BUCKET_DOCS = 4096  #: documents ranked together in one piece of a source's permutation


def quotas(counts: dict[str, int], weights: dict[str, float], size: int | None = None) -> dict[str, int]:
    """Documents to draw from each source: exact shares of ``size`` by largest remainders.

    Without ``size`` the mix is the smallest one that leaves no document of a
    weighted source out: sources that fall short of their share are drawn
    more than once.  Sources without documents or weight get none.
    """
    live = {s: float(weights.get(s, 0)) for s, n in counts.items() if n and weights.get(s, 0) > 0}
    total = sum(live.values())
    if not live:
        return {}
    if size is None:
        size = max(math.ceil(counts[s] * total / w - 1e-9) for s, w in live.items())
    share = {s: size * w / total for s, w in live.items()}
    out = {s: math.floor(x + 1e-9) for s, x in share.items()}
    rest = sorted(live, key=lambda s: (out[s] - share[s], s))
    for s in rest[: size - sum(out.values())]:
        out[s] += 1
    return out


def deal(blocks: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources): the splitting tree's allocation of ``blocks`` per source; shard totals differ by at most one."""
    out = np.zeros((shards, len(blocks)), np.int64)
    total = int(blocks.sum())
    ends = [total * k // shards for k in range(shards + 1)]
    todo = [(0, shards, blocks.astype(np.int64))]
    while todo:
        a, b, have = todo.pop()
        if b - a == 1:
            out[a] = have
            continue
        m = (a + b) // 2
        rng = np.random.default_rng((seed, a, b))  # a node's draw depends on nothing but its place
        left = rng.multivariate_hypergeometric(have, ends[m] - ends[a], method="marginals") if have.sum() < 10**9 else _large(rng, have, ends[m] - ends[a])
        todo += [(a, m, left), (m, b, have - left)]
    return out


def _large(rng: np.random.Generator, have: np.ndarray, n: int) -> np.ndarray:
    """The same draw for more blocks than numpy's generator takes: source by source, each by inversion of its hypergeometric distribution."""
    out, rest = np.zeros_like(have), int(have.sum())
    for i, h in enumerate(have):
        out[i] = _hypergeometric(rng, int(h), rest, n)
        n, rest = n - int(out[i]), rest - int(h)
    return out


def _hypergeometric(rng: np.random.Generator, good: int, total: int, n: int) -> int:
    """How many of ``good`` among ``total`` are in a draw of ``n``.

    The probabilities around the mode, as far as forty standard deviations,
    follow from one another by their ratios; what lies beyond has less than
    the rounding error of a double.
    """
    low, high = max(0, n - (total - good)), min(n, good)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    share = good / total
    reach = 40 * math.sqrt(max(1.0, n * share * (1 - share) * (total - n) / max(1, total - 1))) + 40
    a, b = max(low, mode - int(reach)), min(high, mode + int(reach))
    k = np.arange(a, b, dtype=np.float64)
    step = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(total - good - n + k + 1)
    log = np.r_[0.0, np.cumsum(step)]
    mass = np.cumsum(np.exp(log - log.max()))
    return a + int(np.searchsorted(mass, rng.random() * mass[-1], side="right"))


def _key(column: Column) -> Column:
    """Source as a non-null string: null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("0"))


def mix(spark: SparkSession, docs: DataFrame, *, weights: dict[str | None, float] | None = None, size: int | None = None, doc_id: str = "doc_id",
        source: str = "source", block_docs: int = BLOCK_DOCS, shard_docs: int | None = None, seed: int = SEED, temper: float = TEMPER,
        outputs: tuple[str, str, str] = ("shard", "epoch", "order_key")) -> DataFrame:
    """The mixed corpus: all columns of ``docs`` and ``shard``, ``epoch`` and ``order_key`` (or other ``outputs``).

    A source's share of the rows is its weight's share, exact to the document;
    without ``weights`` a source weighs its number of documents to the power
    ``temper``.  Without ``size`` every document of a weighted source comes at
    least once; a source short of its share is drawn again in a new
    permutation (``epoch`` 1, 2, ...), never twice in one epoch.  Each shard
    is one partition, sorted by ``order_key``, a random number.

    The unit is a document id in a source: repeated rows and null ids go
    where their id goes and count once in each source that holds them (a null
    id is one unit of its source).  A null source is a source of its own.  Ids
    are of any type.  Empty, null and very long texts are documents like
    others.  An empty table, or weights that name none of its sources, give an
    empty result.  Ties in the random order go by id.  Columns that clash with
    the three new ones are replaced by them; no other name matters.

    Work: one pass over the ids ranks each source's permutation (buckets of
    about ``BUCKET_DOCS`` ids are sorted apart and offset by the counts
    before them), which yields the hashes at which one shard ends and the
    next begins.  Given these, a document finds its shard where it is read,
    so texts move once, to their shard.  The driver holds a number for each
    source, epoch and shard, of which there are SHARDS at most.
    """
    shelf = Shelf(spark)
    unit, src, slot, hash_, bounds = fresh(docs, "unit", "src", "slot", "hash", "bounds")
    ids = docs.select(_key(docs[source]).alias(src), docs[doc_id].cast("string").alias(unit)).distinct()
    ids = shelf.put(ids)
    counts = {r[0]: r[1] for r in ids.groupBy(src).count().collect()}
    if weights is None:
        wanted = {s: n ** temper for s, n in counts.items()}
    else:
        wanted = {"0" if s is None else f"={s}": w for s, w in weights.items()}
    quota = quotas(counts, wanted, size)
    plain = [c for c in docs.columns if c.lower() not in {n.lower() for n in outputs}]
    if not quota:
        return docs.limit(0).select(*[F.col(f"`{c}`") for c in plain], F.lit(0).alias(outputs[0]), F.lit(0).alias(outputs[1]), F.lit(0).cast("bigint").alias(outputs[2]))
    slots = [(s, e, min(counts[s], q - e * counts[s])) for s, q in sorted(quota.items()) for e in range(-(-q // counts[s]))]
    shards = max(1, -(-sum(quota.values()) // (shard_docs or max(SHARD_DOCS, sum(quota.values()) // SHARDS))))
    dealt = deal(np.array([-(-n // block_docs) for _, _, n in slots]), shards, seed).cumsum(axis=0)
    # A slot is a source in one epoch.  It has a boundary where a shard with blocks of it begins.
    names, epochs, places, owners = [], [], [], []
    for k, (s, e, n) in enumerate(slots):
        ends = np.minimum(dealt[:, k] * block_docs, n)
        begins = np.r_[0, ends[:-1]]
        has = np.flatnonzero(ends > begins)
        beyond = [n] if n < counts[s] else []  # what lies beyond the quota belongs to no shard
        places += [begins[has], np.array(beyond, np.int64)]
        owners += [has, np.full(len(beyond), -1)]
        names.append(np.full(len(has) + len(beyond), s, object))
        epochs.append(np.full(len(has) + len(beyond), e, np.int32))
    marks = pd.DataFrame({src: np.concatenate(names), "epoch": np.concatenate(epochs), "place": np.concatenate(places).astype(np.int64), "shard": np.concatenate(owners).astype(np.int32)})
    spread = {s: -(-quota[s] // counts[s]) for s in quota}
    plan = spark.createDataFrame(pd.DataFrame([(s, spread[s], -(-counts[s] // BUCKET_DOCS)) for s in quota], columns=[src, "epochs", "buckets"]))
    cuts = spark.createDataFrame(marks)
    drawn = (ids.join(F.broadcast(plan) if len(quota) <= 100_000 else plan, src)
             .withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs").cast("int") - 1)))
             .withColumn(hash_, F.xxhash64(F.lit(seed), F.col("epoch"), F.col(unit))))
    piece = F.floor((F.shiftrightunsigned(hash_, 32) * F.col("buckets")) / F.lit(1 << 32))
    # Offset-binary order: the hash's top bit is flipped, so signed order follows the buckets.
    drawn = drawn.withColumn("piece", piece).withColumn(hash_, F.col(hash_).bitwiseXOR(F.lit(-(1 << 63))))
    slot_ = [src, "epoch"]
    before = drawn.groupBy(*slot_, "piece").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.coalesce(F.sum("n").over(Window.partitionBy(*slot_).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = drawn.withColumn("at", F.row_number().over(Window.partitionBy(*slot_, "piece").orderBy(hash_, unit)) - 1)
    found = (ranked.join(before, [*slot_, "piece"]).withColumn("place", F.col("before") + F.col("at"))
             .join(cuts, [*slot_, "place"]).select(src, "epoch", "shard", hash_, "place"))
    found = shelf.put(found)
    body = docs.select(*[F.col(f"`{c}`") for c in plain], _key(docs[source]).alias(src), docs[doc_id].cast("string").alias(unit))
    lookup = found.groupBy(*slot_).agg(F.sort_array(F.collect_list(F.struct(F.col(hash_).alias("h"), F.col("shard").alias("s")))).alias(bounds))
    if len(marks) * 96 <= BROADCAST_BYTES:
        table = {}
        for r in lookup.collect():
            table.setdefault(r[0], []).append((r[1], np.array([x[0] for x in r[2]]), np.array([x[1] for x in r[2]])))
        shared = spark.sparkContext.broadcast(table)

        @F.arrow_udf("array<struct<epoch:int,shard:int>>")
        def place(of: pa.Array, *hashes: pa.Array) -> pa.Array:
            name, code = np.unique(np.asarray(of.to_pylist(), object).astype(str), return_inverse=True)
            row, epochs, to = [], [], []
            for k, source_ in enumerate(name.tolist()):
                at = np.flatnonzero(code == k)
                for epoch, first, shard in shared.value.get(source_, ()):
                    s = shard[np.searchsorted(first, hashes[epoch].to_numpy(zero_copy_only=False)[at], side="right") - 1]
                    row.append(at[s >= 0]), to.append(s[s >= 0]), epochs.append(np.full(int((s >= 0).sum()), epoch, np.int32))
            none = [np.zeros(0, np.int32)]
            row, epochs, to = (np.concatenate(x + none) for x in (row, epochs, to))
            by = np.argsort(row, kind="stable")
            ends = np.r_[0, np.cumsum(np.bincount(row.astype(np.int64), minlength=len(of)))].astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(epochs[by].astype(np.int32)), pa.array(to[by].astype(np.int32))], names=["epoch", "shard"])
            return pa.ListArray.from_arrays(pa.array(ends), pairs)

        hashes = [F.xxhash64(F.lit(seed), F.lit(e), F.col(unit)).bitwiseXOR(F.lit(-(1 << 63))) for e in range(max(spread.values()))]
        placed = body.withColumn(slot, F.explode(place(F.col(src), *hashes))).select(
            *[F.col(f"`{c}`") for c in plain], F.col(f"{slot}.shard").alias(outputs[0]), F.col(f"{slot}.epoch").alias(outputs[1]), F.col(unit))
    else:
        # Too many boundaries to broadcast: each unit's shard is found by a running maximum and joined by source and id.
        run = Window.partitionBy(*slot_, "piece").orderBy(hash_, unit)
        cut = ranked.join(before, [*slot_, "piece"]).withColumn("place", F.col("before") + F.col("at")).join(cuts, [*slot_, "place"], "left")
        last = cut.groupBy(*slot_, "piece").agg(F.max_by("shard", F.when(F.col("shard").isNotNull(), F.col("place"))).alias("last"))
        carried = last.withColumn("carried", F.last("last", True).over(Window.partitionBy(*slot_).orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
        to = cut.withColumn("to", F.last("shard", True).over(run)).join(carried, [*slot_, "piece"]).select(
            F.col(unit).alias(slot), F.col(src).alias(hash_), "epoch", F.coalesce("to", "carried").cast("int").alias("shard")).where("shard >= 0")
        to = to.select(slot, hash_, F.col("epoch").alias("__epoch"), F.col("shard").alias("__shard"))
        placed = body.join(to, (body[src] == to[hash_]) & body[unit].eqNullSafe(to[slot])).select(
            *[F.col(f"`{c}`") for c in plain], to["__shard"].alias(outputs[0]), to["__epoch"].alias(outputs[1]), F.col(unit))
    return (placed.withColumn(outputs[2], F.xxhash64(F.lit(seed + 1), outputs[0], outputs[1], F.col(unit)))
            .repartitionById(shards, F.col(outputs[0])).sortWithinPartitions(outputs[2], unit).drop(unit))
