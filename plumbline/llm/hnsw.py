"""Embedding near-deduplication with a hierarchical navigable small-world graph per shard.

Equal vectors are one node.  The nodes are dealt to shards by a hash of the
vector.  Each shard builds its graph; every vector is then searched in every
shard (each pair of shards once).  Searches run for many queries together: a
beam per query, a step of which expands its best open nodes by array
operations.  Beams are widened until audits pass: sampled queries against
brute force, and probes made to lie exactly at the threshold from sampled
nodes.  A query whose whole beam lies within the threshold has more partners
than the beam holds and is compared with the whole shard; of those partners
only the ones that are not yet in its group are looked at, so a cluster of a
million near copies never becomes pairs.  Every link has its cosine verified,
and links are joined to components.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .components import connected_components
from .shelf import Shelf
from .simhash import merge_labels

COSINE = 0.92  #: vectors at least this alike are near copies
LINKS = 12  #: links of a node on the upper levels; twice as many on the lowest
EF_BUILD, EF_SEARCH = 32, 24
#: Without a given size, shards hold the geometric mean of the number of vectors and MEAN_ROWS, within these bounds: the number of searches
#: (vectors times shards) then grows with the power 1.5 of the input until shards are as large as a task's memory allows.
MEAN_ROWS, LEAST_SHARD, LARGEST_SHARD = 4096, 8192, 1 << 18
AUDIT, RECALL = 96, 0.97  #: queries and probes audited for each pair of shards; share of their partners that must be found
_BLOCK = 512  #: queries that walk together


def search(vec: np.ndarray, adj: np.ndarray, query: np.ndarray, start: np.ndarray, ef: int, expand: int = 4, known: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, cosines) of the ``ef`` best nodes each query meets, best first; -1 pads.  ``start``: entry nodes (queries, k)."""
    n = len(vec) if known is None else known
    ids = np.full((len(query), ef), -1, np.int32)
    sims = np.full((len(query), ef), -np.inf, np.float32)
    for at in range(0, len(query), _BLOCK):
        q = query[at:at + _BLOCK]
        m = len(q)
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True
        rows = np.arange(m)[:, None]
        first = start[at:at + _BLOCK]
        seen[rows, first] = True
        i, s = first.astype(np.int32), np.einsum("qkd,qd->qk", vec[first], q)
        open_ = np.ones(i.shape, bool)
        pad = max(ef, i.shape[1])
        I, S, O = np.full((m, pad), n, np.int32), np.full((m, pad), -np.inf, np.float32), np.zeros((m, pad), bool)
        I[:, :i.shape[1]], S[:, :i.shape[1]], O[:, :i.shape[1]] = i, s, open_
        live = np.arange(m)
        while len(live):
            score = np.where(O[live], S[live], -np.inf)
            k = min(expand, pad)
            pick = np.argpartition(-score, k - 1, axis=1)[:, :k]
            good = np.take_along_axis(score, pick, 1) > -np.inf
            more = good.any(1)
            live, pick, good = live[more], pick[more], good[more]
            if not len(live):
                break
            node = np.where(good, I[live[:, None], pick], n)
            O[live[:, None], pick] = False
            nbr = np.where((node < n)[:, :, None], adj[np.minimum(node, n - 1)], n).reshape(len(live), -1)
            nbr = np.where((nbr < 0) | (nbr > n), n, nbr)
            nbr.sort(axis=1)
            nbr[:, 1:][nbr[:, 1:] == nbr[:, :-1]] = n
            nbr[seen[live[:, None], nbr]] = n
            seen[live[:, None], nbr] = True
            r, c = np.nonzero(nbr < n)
            s = np.full(nbr.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("kd,kd->k", vec[nbr[r, c]], q[live[r]])
            allS = np.concatenate([S[live], s], 1)
            allI = np.concatenate([I[live], nbr], 1)
            allO = np.concatenate([O[live], nbr < n], 1)
            top = np.argpartition(-allS, pad - 1, axis=1)[:, :pad]
            S[live], I[live], O[live] = (np.take_along_axis(x, top, 1) for x in (allS, allI, allO))
        order = np.argsort(-S, axis=1, kind="stable")[:, :ef]
        best = np.take_along_axis(I, order, 1)
        ids[at:at + _BLOCK] = np.where(best < n, best, -1)
        sims[at:at + _BLOCK] = np.take_along_axis(S, order, 1)
    return ids, sims


def _select(vec: np.ndarray, me: np.ndarray, ids: np.ndarray, sims: np.ndarray, links: int) -> np.ndarray:
    """Diverse neighbours: a candidate is taken if it is nearer to the node than to every one taken before."""
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    ok = (ids >= 0) & (ids != me[:, None])
    taken = np.zeros(ids.shape, bool)
    count = np.zeros(len(ids), np.int64)
    nearest = np.full(ids.shape, -np.inf, np.float32)  # of each candidate to those taken
    out = np.full((len(ids), links), -1, np.int32)
    for j in range(ids.shape[1]):
        t = ok[:, j] & (count < links) & (sims[:, j] > nearest[:, j])
        at = np.flatnonzero(t)
        if not len(at):
            continue
        out[at, count[at]] = ids[at, j]
        count[at] += 1
        taken[at, j] = True
        if j + 1 < ids.shape[1]:
            near = np.einsum("qkd,qd->qk", vec[np.maximum(ids[at, j + 1:], 0)], vec[ids[at, j]])
            nearest[at, j + 1:] = np.maximum(nearest[at, j + 1:], near)
    # Links left free go to the best candidates passed over, so a tight cluster hangs together.
    for j in range(ids.shape[1]):
        at = np.flatnonzero(ok[:, j] & ~taken[:, j] & (count < max(1, links * 2 // 3)))
        out[at, count[at]] = ids[at, j]
        count[at] += 1
    return out


class Graph:
    """Levels from the top: (node numbers, links by place in the level); the vectors stand beside."""

    def __init__(self, vec: np.ndarray, seed: int = 11):
        self.vec = vec
        rng = np.random.default_rng(seed)
        n = len(vec)
        height = np.floor(-np.log(rng.random(n) + 1e-300) / np.log(LINKS)).astype(int)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for level in range(min(int(height.max(initial=0)), 6), -1, -1):
            nodes = np.flatnonzero(height >= level)
            self.levels.append((nodes, self._level(nodes, LINKS * (2 if level == 0 else 1))))

    def _entries(self, query: np.ndarray, k: int = 1) -> np.ndarray | None:
        """Node numbers where the queries enter the level below those built."""
        at = None
        for nodes, adj in self.levels:
            place = np.zeros((len(query), 1), np.int64) if at is None else np.searchsorted(nodes, at)
            ids, _ = search(self.vec[nodes], adj, query, place, max(k, 4), 1)
            at = nodes[np.where(ids[:, :k] < 0, ids[:, :1], ids[:, :k])]
        return at

    def _level(self, nodes: np.ndarray, links: int) -> np.ndarray:
        vec, n = self.vec[nodes], len(nodes)
        adj = np.full((n, links), -1, np.int32)
        enter = self._entries(vec)
        upper = nodes[:0] if not self.levels else self.levels[-1][0]
        # Nodes of the level above come first, so that every entry is in the graph when it is used.
        order = np.concatenate([np.searchsorted(nodes, upper), np.setdiff1d(np.arange(n), np.searchsorted(nodes, upper))])
        back = np.argsort(order)
        vec = vec[order]
        enter = np.zeros((n, 1), np.int64) if enter is None else back[np.searchsorted(nodes, enter)][order]
        done = 0
        while done < n:
            to = min(n, done + max(64, min(1024, done)))
            new = np.arange(done, to)
            own = vec[new] @ vec[new].T
            k = min(len(new), EF_BUILD)
            near = np.argpartition(-own, k - 1, axis=1)[:, :k]
            ids, sims = (done + near).astype(np.int32), np.take_along_axis(own, near, 1)
            if done:
                got, s = search(vec, adj, vec[new], np.where(enter[new] < done, enter[new], 0), EF_BUILD, known=done)
                ids, sims = np.concatenate([ids, got], 1), np.concatenate([sims, s], 1)
            adj[new] = _select(vec, new, ids, sims, links)
            self._reverse(vec, adj, new, links)
            done = to
        out = np.full_like(adj, -1)
        out[order] = np.where(adj >= 0, order[np.maximum(adj, 0)], -1)
        return out

    @staticmethod
    def _reverse(vec: np.ndarray, adj: np.ndarray, new: np.ndarray, links: int) -> None:
        """Link the chosen neighbours back; a full node chooses again among its old and new links."""
        src = np.repeat(new, links)
        dst = adj[new].ravel()
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        first = np.flatnonzero(np.r_[True, dst[1:] != dst[:-1]]) if len(dst) else np.zeros(0, int)
        count = np.diff(np.r_[first, len(dst)])
        node = dst[first]
        width = int(count.max(initial=0))
        for block in range(0, len(node), 4096):
            b = slice(block, block + 4096)
            m = min(width, int(count[b].max(initial=0)))
            more = np.full((len(node[b]), m), -1, np.int32)
            r = np.repeat(np.arange(len(node[b])), count[b])
            c = np.arange(len(r)) - np.repeat(np.cumsum(count[b]) - count[b], count[b])
            more[r, c] = src[first[b][0]:first[b][0] + len(r)] if len(r) else []
            ids = np.concatenate([adj[node[b]], more], 1)
            ids.sort(axis=1)
            ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
            sims = np.einsum("qkd,qd->qk", vec[np.maximum(ids, 0)], vec[node[b]])
            sims[ids < 0] = -np.inf
            adj[node[b]] = _select(vec, node[b], ids, sims, links)

    def find(self, query: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``ef`` nodes of each query, from the level above the lowest down."""
        nodes, adj = self.levels[-1]
        above = Graph.__new__(Graph)
        above.vec, above.levels = self.vec, self.levels[:-1]
        at = above._entries(query, 2)
        return search(self.vec, adj, query, np.zeros((len(query), 1), np.int64) if at is None else at, ef)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, vec=self.vec, **{f"{x}{i}": a for i, pair in enumerate(self.levels) for x, a in zip("na", pair)})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Graph:
        z = np.load(io.BytesIO(raw))
        out = cls.__new__(cls)
        out.vec, out.levels = z["vec"], [(z[f"n{i}"], z[f"a{i}"]) for i in range((len(z.files) - 1) // 2)]
        return out


def _hits(vec: np.ndarray, query: np.ndarray, cosine: float) -> Iterator[tuple[int, np.ndarray]]:
    """(first query, (queries, nodes) whether the cosine reaches the threshold) in blocks of bounded memory."""
    block = max(1, (1 << 23) // max(1, len(vec)))
    for at in range(0, len(query), block):
        yield at, query[at:at + block] @ vec.T >= cosine


def beam(graph: Graph, query: np.ndarray, cosine: float, seed: int = 3, own: bool = False) -> int:
    """The beam that passes the audit; as many as the nodes if none less does.

    ``own``: query i is node i, and that finding proves nothing about the
    beams, so the audit leaves it out.  Besides sampled queries, whose partners
    may be few, probes are searched: vectors at just the threshold from a
    sampled node, in a random direction, the hardest that must be found.
    """
    rng = np.random.default_rng(seed)
    n = len(graph.vec)
    sample = np.sort(rng.choice(len(query), min(AUDIT, len(query)), replace=False))
    wanted = {(int(sample[at + r]), int(c)) for at, hit in _hits(graph.vec, query[sample], cosine) for r, c in zip(*np.nonzero(hit))}
    if own:
        wanted = {(q, i) for q, i in wanted if q != i}
    target = rng.choice(n, min(AUDIT, n), replace=False)
    node = graph.vec[target]
    aside = rng.normal(size=node.shape).astype(np.float32)
    aside -= (aside * node).sum(1, keepdims=True) * node
    aside /= np.maximum(1e-20, np.sqrt((aside * aside).sum(1, keepdims=True)))
    c = min(1.0, cosine + 1e-4)
    probe = (c * node + np.sqrt(1 - c * c) * aside).astype(np.float32)
    ef = min(n, EF_SEARCH)
    while ef < n:
        ids, sims = graph.find(query[sample], ef)
        full = sims[:, -1] >= cosine
        got = {(int(sample[r]), int(i)) for r in range(len(sample)) for i in ids[r][sims[r] >= cosine]}
        missed = sum(1 for q, i in wanted if (q, i) not in got and not full[np.searchsorted(sample, q)])
        ids, sims = graph.find(probe, ef)
        seen = (ids == target[:, None]).any(1) | (sims[:, -1] >= cosine)
        if missed <= (1 - RECALL) * len(wanted) and seen.mean() >= RECALL:
            break
        ef = min(n, ef * 2)
    return ef


def link(graph: Graph, query: np.ndarray, cosine: float, own: bool = False, seed: int = 3) -> np.ndarray:
    """Least-member labels of the nodes (numbered first) and the queries, joined wherever a cosine reaches the threshold; with ``own`` query i is node i."""
    n = len(graph.vec)
    first = 0 if own else n
    label = np.arange(n if own else n + len(query))
    ef = beam(graph, query, cosine, seed, own)
    if ef < n:
        ids, sims = graph.find(query, ef)
        full = sims[:, -1] >= cosine
        q, c = np.nonzero(sims >= cosine)
        label = merge_labels(label, first + q, ids[q, c].astype(np.int64))
        left = np.flatnonzero(full)
        del ids, sims
    else:
        left = np.arange(len(query))
    for at, hit in _hits(graph.vec, query[left], cosine):
        rows = first + left[at:at + len(hit)]
        hit &= label[rows][:, None] != label[:n]
        if not hit.any():
            continue
        # One link to each group is enough: the first partner's group first, then whatever is still apart.
        some = np.flatnonzero(hit.any(1))
        label = merge_labels(label, rows[some], hit[some].argmax(1))
        hit &= label[rows][:, None] != label[:n]
        q, j = np.nonzero(hit)
        label = merge_labels(label, rows[q], j)
    return label


def partners(graph: Graph, query: np.ndarray, cosine: float, seed: int = 3, own: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs with at least ``cosine``, every pair by itself: for audits and small inputs."""
    ef = beam(graph, query, cosine, seed, own)
    if ef >= len(graph.vec):
        left, a, b = np.arange(len(query)), [], []
    else:
        ids, sims = graph.find(query, ef)
        full = sims[:, -1] >= cosine
        q, c = np.nonzero((sims >= cosine) & ~full[:, None])
        left, a, b = np.flatnonzero(full), [q], [ids[q, c].astype(np.int64)]
    for at, hit in _hits(graph.vec, query[left], cosine):
        q, j = np.nonzero(hit)
        a.append(left[q + at]), b.append(j)
    return np.concatenate(a), np.concatenate(b)


def near_groups(spark: SparkSession, vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = COSINE,
                shard_rows: int | None = None) -> DataFrame:
    """Every vector with its group of near-equal ones: ``vec_id``, ``keep_id``, ``copies``, ``kept``.

    Two vectors are linked if their cosine is at least ``cosine``; a group is
    a connected component and keeps its smallest id; a vector without a near
    copy is a group by itself (``copies`` 1).  The search is approximate: the
    audits hold its recall, and what it reports is exact.

    Null or empty vectors, vectors of length 0 or with a null, NaN or infinite
    part, and rows without an id have no row.  Vectors of different dimension
    are never linked.  Rows that repeat an id count as one with all their
    vectors.  Ids are integers of any width.  Ties cannot arise; an empty table
    gives an empty result; further columns are ignored, whatever their names.

    Work: equal vectors are combined within tasks and travel once.  A shard's
    graph and its vectors travel once for each shard.
    """
    shelf = Shelf(spark)

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, raws = [], [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = x.values
                if x is None or not len(x) or x.null_count:
                    continue
                v = x.to_numpy(zero_copy_only=False).astype(np.float64)
                top = np.abs(v).max()
                if np.isfinite(top) and top > 0:
                    v = v / top
                    ids.append(i), dims.append(len(v)), raws.append((v / np.sqrt(v @ v) + 0.0).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], names=["id", "dim", "raw"])

    rows = vectors.where(vectors[vec_id].isNotNull() & vectors[embedding].isNotNull()).select(
        vectors[vec_id].cast("bigint").alias("id"), vectors[embedding].alias("v"))
    units = shelf.put(rows.mapInArrow(unit, "id bigint, dim int, raw binary"))
    nodes = shelf.put(units.groupBy("dim", "raw").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    sizes = {r[0]: r[1] for r in nodes.groupBy("dim").count().collect()}
    if not sizes:
        return units.select(F.col("id").alias("vec_id"), F.col("id").alias("keep_id"), F.lit(1).cast("bigint").alias("copies"), F.lit(True).alias("kept"))
    rows_of = lambda n: shard_rows or min(LARGEST_SHARD, max(LEAST_SHARD, int((n * MEAN_ROWS) ** 0.5)))
    of = F.coalesce(*[F.when(F.col("dim") == d, F.lit(-(-n // rows_of(n)))) for d, n in sizes.items()])
    dealt = shelf.put(nodes.withColumn("of", of).withColumn("shard", F.pmod(F.xxhash64("raw"), F.col("of")).cast("int")))

    def stack(table: pa.Table) -> np.ndarray:
        raw = table.column("raw").to_pylist()
        return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1)

    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("raw", "ascending")])
        return pa.table({"dim": table.column("dim")[:1], "of": table.column("of")[:1], "shard": table.column("shard")[:1],
                         "graph": pa.array([Graph(stack(table)).dump()], pa.binary()), "ids": pa.array([table.column("id").to_pylist()], pa.list_(pa.int64()))})

    graphs = shelf.put(dealt.groupBy("dim", "shard").applyInArrow(build, "dim int, of int, shard int, graph binary, ids array<bigint>"))

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        graph = Graph.load(left.column("graph")[0].as_py())
        ids = np.array(left.column("ids")[0].as_py(), np.int64)
        right = right.sort_by([("id", "ascending"), ("raw", "ascending")])
        same = key[1].as_py() == key[2].as_py()
        label = link(graph, stack(right), cosine, own=same)
        all_ids = ids if same else np.concatenate([ids, right.column("id").to_numpy()])
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": all_ids[moved], "b": all_ids[label[moved]]})

    left = graphs.withColumn("with", F.explode(F.sequence("shard", F.col("of") - 1)))
    right = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), "shard"))).select("dim", F.col("with").alias("g"), F.col("shard").alias("q"), "id", "raw")
    pairs = left.select("dim", F.col("shard").alias("g"), F.col("with").alias("q"), "graph", "ids").groupBy("dim", "g", "q").cogroup(
        right.groupBy("dim", "g", "q")).applyInArrow(meet, "a bigint, b bigint")
    # Equal vectors: only the ids of repeated ones meet their node's id.
    again = nodes.where("n > 1").select("dim", "raw", F.col("id").alias("rep"))
    alike = units.join(again.hint("shuffle_hash"), ["dim", "raw"]).select(F.col("id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    parts = shelf.put(connected_components(spark, pairs.union(alike), shelf))
    size = parts.groupBy("component").agg(F.count(F.lit(1)).alias("copies"))
    found = parts.join(size, "component")
    return units.select("id").distinct().join(found, F.col("id") == F.col("node"), "left").select(
        F.col("id").alias("vec_id"), F.coalesce("component", "id").alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def near_groups_sql() -> str:
    """DuckDB SQL for :func:`near_groups` over ``embeddings`` with its default parameters: every pair of vectors, then least ids passed on to a fixed point."""
    return f"""
WITH RECURSIVE v AS (
  SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)),
u AS (SELECT * FROM v WHERE list_dot_product(e, e) > 0 AND isfinite(list_dot_product(e, e))),
pair AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM u a JOIN u b ON a.id <> b.id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e)
    >= {COSINE} * sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e))),
reach AS (SELECT DISTINCT id AS a, id AS b FROM u UNION SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a),
part AS (SELECT a AS vec_id, min(b) AS keep_id, count(*) AS copies FROM reach GROUP BY a)
SELECT vec_id, keep_id, copies, vec_id = keep_id AS kept FROM part"""
