"""The audit of a shard that is searched against itself."""

import numpy as np

from plumbline.llm import hnsw


class Narrow:
    """Finds everything but one node's partner, which takes a wider beam."""

    def __init__(self, vec, hidden):
        self.vec, self.hidden = vec, hidden

    def find(self, query, ef):
        sims = query @ self.vec.T
        if ef < 2 * hnsw.EF_SEARCH:
            for a in self.hidden:
                others = [b for b in self.hidden if b != a]
                sims[np.ix_((query == self.vec[a]).all(1), others)] = -1
        ids = np.argsort(-sims, axis=1, kind="stable")[:, :ef]
        return ids, np.take_along_axis(sims, ids, 1)


def test_own_nodes_prove_nothing():
    rng = np.random.default_rng(8)
    v = rng.normal(size=(3000, 48)).astype(np.float32)
    a = int(np.sort(np.random.default_rng(3).choice(3000, hnsw.AUDIT, replace=False))[0])
    b = (a + 1) % 3000
    v[b] = v[a] + rng.normal(scale=0.01, size=48)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    graph = Narrow(v, (a, b))
    before = hnsw.partners(graph, v, hnsw.COSINE)
    assert (a, b) not in set(zip(*(x.tolist() for x in before)))
    q, j = hnsw.partners(graph, v, hnsw.COSINE, own=True)
    assert {(a, b), (b, a)} <= set(zip(q.tolist(), j.tolist()))
