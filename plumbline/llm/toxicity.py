"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters the network as its own embedding next to a max-pooled embedding
of its character n-grams, so spellings built on a toxic stem score like it.
The network reads windows of ``WINDOW`` words that overlap by half; every
window of every text is scored, and a document's score is its worst window's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import docs_type
from .textkit import Words, mix64, slices

WINDOW, STRIDE = 32, 16
HIDDEN, DIM = 8, 8
NGRAMS = (4, 5)
PREFIXES = (5, 6, 7, 8)  #: lengths of the n-grams that stand at a word's begin, told apart from those inside
SAMPLE_PER_CLASS = 3072  #: bound of the labelled sample the model is fitted on, in rows of each class; the texts are whole
MAX_WORDS, MAX_NGRAMS = 8192, 16384  #: features kept, by how far their class shares differ
_AT_BEGIN = np.uint64(0x5851F42D4C957F2D)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """1 + place of each key in a sorted table, 0 where it isn't there."""
    if not len(table):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at + 1, 0)


class Vocabulary:
    """Distinct words of a column and their character n-grams, as hashes."""

    def __init__(self, words: Words):
        self.hash, first, self.inverse = np.unique(words.hash, return_index=True, return_inverse=True)
        start, size = words.start[first], words.end[first] - words.start[first]
        #: (owner, n-gram) by kind; the kinds share no key
        self.pieces: list[tuple[np.ndarray, np.ndarray]] = []
        for n in NGRAMS:
            count = np.maximum(size - n + 1, 0)
            who = np.repeat(np.arange(len(size), dtype=np.int32), count)
            at = start[who] + np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)
            self.pieces.append((who, words.spans(at, at + n)))
        for n in PREFIXES:
            who = np.flatnonzero(size >= n).astype(np.int32)
            self.pieces.append((who, mix64(words.spans(start[who], start[who] + n) + _AT_BEGIN)))


def windows(count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, row) of all overlapping windows of rows with ``count`` words each."""
    n = np.where(count > 0, np.maximum(0, -(-(count - WINDOW) // STRIDE)) + 1, 0)
    row = np.repeat(np.arange(len(count)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    base = np.cumsum(count) - count
    start = base[row] + k * STRIDE
    size = np.minimum(WINDOW, base[row] + count[row] - start)
    return start, size, row


class Features:
    """What fitting needs of a column of texts, gathered slice by slice, so that memory follows the words and not the bytes.

    ``word``: each word's place among the distinct ones; ``count``: words of
    each row; ``hash``: the distinct words; ``pairs``: the distinct words of
    each row, as place times rows plus row, sorted; ``pieces``: the words'
    n-grams as in :class:`Vocabulary`.
    """

    def __init__(self, texts: pa.Array):
        places, counts, pairs, self.hash = [], [], [], np.zeros(0, np.uint64)
        base = 0
        pieces: list[list[tuple[np.ndarray, np.ndarray]]] = []
        for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), 0):
            words = Words(part.column(0))
            vocab = Vocabulary(words)
            at = _lookup(np.sort(self.hash), vocab.hash)
            new = np.flatnonzero(at == 0)
            place = np.full(len(vocab.hash), -1, np.int64)
            place[new] = len(self.hash) + np.arange(len(new))
            if len(self.hash):
                old = np.flatnonzero(at)
                place[old] = np.argsort(self.hash, kind="stable")[at[old] - 1]
            fresh = np.zeros(len(vocab.hash), bool)
            fresh[new] = True
            pieces.append([(place[owner[fresh[owner]]].astype(np.int32), gram[fresh[owner]]) for owner, gram in vocab.pieces])
            self.hash = np.concatenate([self.hash, vocab.hash[new]])
            places.append(place[vocab.inverse].astype(np.int32)), counts.append(words.count)
            pairs.append(np.unique(place[vocab.inverse] * np.int64(len(texts)) + words.doc + base))
            base += words.rows
        self.word = np.concatenate([*places, np.zeros(0, np.int32)])
        self.count = np.concatenate([*counts, np.zeros(0, np.int64)])
        self.doc = np.repeat(np.arange(len(self.count), dtype=np.int32), self.count)
        self.pairs = np.concatenate([*pairs, np.zeros(0, np.int64)])
        self.pairs.sort()
        self.pieces = [tuple(np.concatenate(x) for x in zip(*kind)) for kind in zip(*pieces)]


class Model:
    """The network's parameters, with forward and backward passes."""

    def __init__(self, words: np.ndarray, grams: np.ndarray, word_odds: np.ndarray, gram_odds: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        normal = lambda *s: rng.normal(0, 0.15, s).astype(np.float32)
        self.words, self.grams, self.threshold = words, grams, 0.5
        self.p = {"Ew": normal(len(words) + 1, DIM), "Ec": normal(len(grams) + 1, DIM), "W": normal(2 * DIM, 6 * HIDDEN),
                  "b": np.zeros(6 * HIDDEN, np.float32), "U": normal(2, HIDDEN, 3 * HIDDEN), "v": normal(2 * HIDDEN),
                  "o": normal(2 * HIDDEN), "c": np.full(1, -2, np.float32)}
        self.p["Ew"][0] = self.p["Ec"][0] = 0
        self.p["Ew"][1:, 0] = word_odds
        self.p["Ec"][1:, 0] = gram_odds
        # The first unit of either direction starts out following the odds, so few labels are enough to start from.
        for d in (0, 1):
            at = d * 3 * HIDDEN
            self.p["W"][[0, DIM], at + 2 * HIDDEN] = 0.5, 0.25
            self.p["b"][at] = -2
            self.p["v"][d * HIDDEN] = self.p["o"][d * HIDDEN] = 2

    def state(self) -> dict:
        """Plain arrays, which travel without this module."""
        return {"words": self.words, "grams": self.grams, "threshold": self.threshold, "p": self.p}

    @classmethod
    def of(cls, state: dict | None) -> Model | None:
        if state is None:
            return None
        out = cls.__new__(cls)
        out.__dict__.update(state)
        return out

    def known(self, vocab: Vocabulary | Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ids, and the known n-grams as (owner, id) sorted by owner."""
        owners, grams = [], []
        for owner, gram in vocab.pieces:
            at = _lookup(self.grams, gram)
            has = np.flatnonzero(at)
            owners.append(owner[has]), grams.append(at[has])
        owner, gram = np.concatenate(owners), np.concatenate(grams)
        order = np.argsort(owner, kind="stable")
        return _lookup(self.words, vocab.hash), owner[order], gram[order]

    def inputs(self, wid, owner, gram):
        """Input vectors of distinct words, and what the backward pass needs."""
        x = np.zeros((len(wid), 2 * DIM), np.float32)
        x[:, :DIM] = self.p["Ew"][wid]
        rows = first = None
        if len(owner):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            rows = owner[first]
            x[rows, DIM:] = np.maximum.reduceat(self.p["Ec"][gram], first, axis=0)
        return x

    def forward(self, pre: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows from (windows, WINDOW, 6 * HIDDEN) preactivations."""
        n, h3 = pre.shape[0], 3 * HIDDEN
        h = np.zeros((2, n, HIDDEN), np.float32)
        out = np.empty((WINDOW, n, 2 * HIDDEN), np.float32)
        tape = []
        for s in range(WINDOW):
            t = (s, WINDOW - 1 - s)
            x = np.stack([pre[:, t[0], :h3], pre[:, t[1], h3:]])
            m = np.stack([mask[:, t[0]], mask[:, t[1]]])[:, :, None]
            g = h @ self.p["U"]
            zr = _sigmoid(x[..., :2 * HIDDEN] + g[..., :2 * HIDDEN])
            z, r, gn = zr[..., :HIDDEN], zr[..., HIDDEN:], g[..., 2 * HIDDEN:]
            c = np.tanh(x[..., 2 * HIDDEN:] + r * gn)
            new = h + m * (1 - z) * (c - h)
            if keep:
                tape.append((h, z, r, gn, c, m))
            h = new
            out[t[0], :, :HIDDEN] = h[0]
            out[t[1], :, HIDDEN:] = h[1]
        score = out @ self.p["v"] + (mask.T - 1) * 30
        score = np.exp(score - score.max(0))
        alpha = score / score.sum(0)
        pooled = (alpha[:, :, None] * out).sum(0)
        logit = pooled @ self.p["o"] + self.p["c"][0]
        return (logit, pooled, alpha, out, tape) if keep else logit

    def backward(self, dlogit, pooled, alpha, out, tape):
        """Gradients of v, o, c, U and of the preactivations."""
        n, h3 = len(dlogit), 3 * HIDDEN
        g = {"o": pooled.T @ dlogit, "c": dlogit.sum(keepdims=True)}
        dpool = dlogit[:, None] * self.p["o"]
        da = (out * dpool).sum(2)
        ds = alpha * (da - (alpha * da).sum(0))
        g["v"] = np.einsum("tnh,tn->h", out, ds)
        dout = alpha[:, :, None] * dpool + ds[:, :, None] * self.p["v"]
        dpre = np.zeros((n, WINDOW, 2 * h3), np.float32)
        dU = np.zeros_like(self.p["U"])
        dh = np.zeros((2, n, HIDDEN), np.float32)
        UT = self.p["U"].transpose(0, 2, 1)
        for s in reversed(range(WINDOW)):
            t = (s, WINDOW - 1 - s)
            hp, z, r, gn, c, m = tape[s]
            dh = dh + np.stack([dout[t[0], :, :HIDDEN], dout[t[1], :, HIDDEN:]])
            d = m * dh
            dc = d * (1 - z) * (1 - c * c)
            dz = d * (hp - c) * z * (1 - z)
            dr = dc * gn * r * (1 - r)
            dg = np.concatenate([dz, dr, dc * r], axis=2)
            dU += hp.transpose(0, 2, 1) @ dg
            dx = np.concatenate([dz, dr, dc], axis=2)
            dpre[:, t[0], :h3] = dx[0]
            dpre[:, t[1], h3:] = dx[1]
            dh = dh - d * (1 - z) + dg @ UT
        g["U"] = dU
        return g, dpre

    def gather(self, x: np.ndarray, inverse: np.ndarray, start: np.ndarray, size: np.ndarray):
        """Preactivations (windows, WINDOW, ...), mask and word places of the given windows."""
        place = start[:, None] + np.arange(WINDOW)
        mask = (np.arange(WINDOW) < size[:, None])
        word = inverse[np.where(mask, place, start[:, None])]
        return word, mask.astype(np.float32)

    def scores(self, words: Words, block: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, size, row, probability) of every window."""
        start, size, row = windows(words.count)
        if not len(start):
            return start, size, row, np.zeros(0, np.float32)
        vocab = Vocabulary(words)
        pre = self.inputs(*self.known(vocab)) @ self.p["W"] + self.p["b"]
        prob = np.empty(len(start), np.float32)
        for at in range(0, len(start), block):
            word, mask = self.gather(pre, vocab.inverse, start[at:at + block], size[at:at + block])
            prob[at:at + block] = _sigmoid(self.forward(pre[word], mask))
        return start, size, row, prob

    def documents(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(score, number of windows) of each row; 0 without a word."""
        _, _, row, prob = self.scores(words)
        best = np.zeros(words.rows, np.float32)
        np.maximum.at(best, row, prob)
        return best, np.bincount(row, minlength=words.rows)


def _odds(keys: np.ndarray, row: np.ndarray, label: np.ndarray, most: int, least_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features that best tell the classes apart: sorted keys, their shrunken log-odds, and how far the classes differ."""
    order = np.lexsort((row, keys))
    k, r = keys[order], row[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])] if len(k) else np.zeros(0, bool)
    k, r = k[new], r[new]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    total = np.diff(np.r_[first, len(k)])
    pos = np.add.reduceat(label[r].astype(np.int64), first) if len(k) else total
    P, N = max(1, label.sum()), max(1, (1 - label).sum())
    a, b = pos / P, (total - pos) / N
    z = (a - b) / np.sqrt(total / (P + N) * (1 / P + 1 / N) + 1e-12)
    best = np.flatnonzero(total >= least_rows)
    best = np.sort(best[np.argsort(-np.abs(z[best]), kind="stable")[:most]])
    odds = np.log((a[best] * P + 3) / (P + 3)) - np.log((b[best] * N + 3) / (N + 3)) + np.log((N + 3) / (N + 6)) * 0
    return k[first][best], np.clip(odds, -4, 4).astype(np.float32), np.abs(z[best])


def _cut(toxic: np.ndarray, clean: np.ndarray, false_cost: float) -> float:
    """The best threshold for held-out scores, in the middle of the best gap between them; 0.5 if a class is missing."""
    if not len(toxic) or not len(clean):
        return 0.5
    edges = np.unique(np.concatenate([[0.0], toxic, clean, [1.0]]))
    middle = (edges[1:] + edges[:-1]) / 2
    gain = (len(toxic) - np.searchsorted(np.sort(toxic), middle)) / len(toxic) - false_cost * (len(clean) - np.searchsorted(np.sort(clean), middle)) / len(clean)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(middle[best[np.argmax((edges[1:] - edges[:-1])[best])]])


def train(texts: pa.Array, label: np.ndarray, *, epochs: int | None = None, batch: int | None = None, rate: float = 0.01, seed: int = 7,
          false_cost: float = 4) -> Model | None:
    """Fit the network on whole labelled texts (multiple-instance learning over their windows).

    In every epoch a toxic text contributes its worst windows as the model
    sees them so far, a clean text its worst one and a random one.  A fifth
    of the texts is held out; the threshold is the one that makes the share of
    held-out toxic texts caught, less ``false_cost`` times the share of clean
    ones flagged, largest.  None if a class is missing.
    """
    label = np.asarray(label).astype(np.int64)
    if not len(label) or label.min() == label.max():
        return None
    batch = batch or int(min(256, max(16, len(label) // 8)))  # few labels: smaller steps, more of them
    epochs = epochs or int(min(16, max(5, 3000 // len(label))))
    rng = np.random.default_rng(seed)
    found = Features(texts)
    held = rng.random(len(label)) < (0.2 if len(label) >= 50 else 0)
    least = 3 if len(label) < 2000 else 5
    seen, seen_row = np.divmod(found.pairs, np.int64(len(label)))  # (distinct word, row), to hand n-grams their rows
    seen, seen_row, found.pairs = seen[~held[seen_row]].astype(np.int32), seen_row[~held[seen_row]].astype(np.int32), None
    wk, wo, _ = _odds(found.hash[seen], seen_row, label, MAX_WORDS, least)
    at = np.searchsorted(seen, np.arange(len(found.hash) + 1))
    best = []
    for owner_, gram_ in found.pieces:
        for part in range(16):  # by their first bits, so that few are laid out at a time
            mine = (gram_ >> np.uint64(60)) == part
            owner, gram = owner_[mine], gram_[mine]
            n = np.diff(at)[owner]
            take = np.repeat(at[:-1][owner], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            best.append(_odds(np.repeat(gram, n), seen_row[take], label, MAX_NGRAMS, least))
    gk, go, gz = (np.concatenate(x) for x in zip(*best))
    top = np.argsort(-gz, kind="stable")[:MAX_NGRAMS]
    top = top[np.argsort(gk[top])]
    gk, go = gk[top], go[top]
    del seen, seen_row, at, best, gz
    model = Model(wk, gk, wo, go, seed)
    wid, owner, gram = model.known(found)
    found.pieces = None
    inverse = found.word
    bounds = np.searchsorted(owner, np.arange(len(wid) + 1))
    start, size, row = windows(found.count)
    x = model.inputs(wid, owner, gram)
    heat = (x[:, 0] + x[:, DIM])[inverse]
    prob = np.zeros(len(start), np.float32)
    for at in range(0, len(start), 1 << 15):
        place = np.minimum(start[at:at + (1 << 15), None] + np.arange(WINDOW), len(heat) - 1)
        prob[at:at + (1 << 15)] = np.where(np.arange(WINDOW) < size[at:at + (1 << 15), None], heat[place], -9).max(1)
    del heat
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    step = 0
    use = ~held[row] & (size > 0)
    for epoch in range(epochs):
        by = np.lexsort((-prob, row))
        by = by[use[by]]
        first = np.r_[True, row[by][1:] != row[by][:-1]] if len(by) else np.zeros(0, bool)
        second = np.r_[False, first[:-1]] & ~first if len(by) else first
        top, next_ = by[first], by[second]
        bar = 0.5 if epoch else 1.0
        spare = np.flatnonzero(use & (label[row] == 0))
        spare = rng.choice(spare, min(len(spare), len(top)), replace=False) if len(spare) else spare
        chosen = np.unique(np.concatenate([top, next_[(label[row[next_]] == 0) | (prob[next_] > bar)], spare]))
        chosen = rng.permutation(chosen)
        for b in range(0, len(chosen), batch):
            c = chosen[b:b + batch]
            word, mask = model.gather(x, inverse, start[c], size[c])
            u, inv = np.unique(word, return_inverse=True)
            inv = inv.reshape(word.shape)
            cnt = np.diff(bounds)[u]
            pick = np.repeat(bounds[:-1][u], cnt) + np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt)
            own, gr = np.repeat(np.arange(len(u)), cnt), gram[pick]
            xu = model.inputs(wid[u], own, gr)
            pre = xu @ model.p["W"] + model.p["b"]
            logit, *rest = model.forward(pre[inv], mask, keep=True)
            y = label[row[c]]
            weight = np.where(y == 1, 1.0, 1.0) / len(c)
            g, dpre = model.backward(((_sigmoid(logit) - y) * weight).astype(np.float32), *rest)
            flat = dpre.reshape(-1, dpre.shape[2])
            du = np.zeros_like(pre)
            np.add.at(du, inv.ravel(), flat)
            g["W"], g["b"] = xu.T @ du, du.sum(0)
            dx = du @ model.p["W"].T
            g["Ew"] = np.zeros_like(model.p["Ew"])
            np.add.at(g["Ew"], wid[u], dx[:, :DIM])
            g["Ec"] = np.zeros_like(model.p["Ec"])
            if len(gr):
                best = model.p["Ec"][gr] == xu[own, DIM:]
                np.add.at(g["Ec"], gr, best * dx[own, DIM:])
            g["Ew"][0] = g["Ec"][0] = 0
            step += 1
            for k, v in model.p.items():
                m1, m2 = moments[k]
                m1 += 0.1 * (g[k] - m1)
                m2 += 0.01 * (g[k] * g[k] - m2)
                v -= (rate * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
        x = model.inputs(wid, owner, gram)
        pre = x @ model.p["W"] + model.p["b"]
        for at in range(0, len(start), 4096):
            word, mask = model.gather(pre, inverse, start[at:at + 4096], size[at:at + 4096])
            prob[at:at + 4096] = _sigmoid(model.forward(pre[word], mask))
    best = np.zeros(len(label))
    np.maximum.at(best, row, prob)
    judged = held if held.any() else np.ones(len(label), bool)
    model.threshold = _cut(best[judged & (label == 1)], best[judged & (label == 0)], false_cost)
    model.held_out = {"toxic": best[held & (label == 1)].tolist(), "clean": best[held & (label == 0)].tolist()}
    return model


def sample(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
           per_class: int = SAMPLE_PER_CLASS) -> pa.Table:
    """At most ``per_class`` labelled texts of each class, whole, in an order fixed by a hash of the id.

    A document labelled more than once counts as toxic if any label says so;
    null ids, labels and texts are left out, and so are labels without a
    document.  Rows that repeat an id and a text count once.  Only the sample's ids (bounded) are broadcast.
    """
    known = (labels.where(labels[doc_id].isNotNull() & labels[label].isNotNull())
             .groupBy(labels[doc_id].alias("__id")).agg((F.max(labels[label]) > 0).cast("int").alias("__y")))
    pick = None
    for y in (0, 1):
        some = known.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(per_class)
        pick = some if pick is None else pick.union(some)
    rows = docs.where(docs[text].isNotNull()).select(docs[doc_id].alias("__id"), docs[text].alias("__text"))
    return rows.join(F.broadcast(pick), "__id").distinct().toArrow().sort_by([("__id", "ascending"), ("__text", "ascending")])


def fit(docs: DataFrame, labels: DataFrame, **kw) -> Model | None:
    """:func:`train` on :func:`sample`."""
    got = sample(docs, labels, **kw)
    return train(got.column("__text").combine_chunks(), got.column("__y").to_numpy())


def score(spark: SparkSession, docs: DataFrame, model: Model | None, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``toxicity`` (worst window, 0 to 1), ``n_windows`` and ``is_toxic`` of every document.

    Null and empty texts, and texts without a word, have no window and score
    0.  Without a model (no labels, or labels of one class only) nothing is
    known to be toxic: all score 0.  Very long texts have all their windows
    scored.  Repeated rows and null ids pass through, ids of any type; ties
    cannot arise; an empty table gives an empty result; further columns are
    ignored, whatever their names.  A narrow map: nothing is shuffled; the
    model (a few MB at most, by MAX_WORDS and MAX_NGRAMS) goes to the workers
    once, as plain arrays.
    """
    shared = spark.sparkContext.broadcast(None if model is None else model.state())
    schema = pa.schema([("doc_id", docs_type(docs, doc_id)), ("toxicity", pa.float64()), ("n_windows", pa.int64()), ("is_toxic", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.of(shared.value)
        for batch in batches:
            for part in slices(batch, 1):
                best, n = _scores(own, part.column(1))
                flag = best >= own.threshold if own else np.zeros(len(best), bool)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(best.astype(np.float64)), pa.array(n.astype(np.int64)), pa.array(flag)], schema=schema)

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(
        run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, toxicity double, n_windows bigint, is_toxic boolean")


def _scores(model: Model | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    words = Words(texts)
    if model is None:
        return np.zeros(words.rows), np.bincount(windows(words.count)[2], minlength=words.rows)
    return model.documents(words)


def drop_toxic(spark: SparkSession, docs: DataFrame, model: Model | None, *, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose score reaches the model's threshold; all columns pass through, whatever their names.

    Rows with a null, empty or wordless text score 0 and stay; without a model
    all rows stay.  Repeated rows share their fate; ids are not looked at; very
    long texts are judged by all their windows; an empty table stays empty.
    """
    shared = spark.sparkContext.broadcast(None if model is None else model.state())
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.of(shared.value)
        for batch in batches:
            for part in slices(batch, place):
                if own is None:
                    yield part
                else:
                    best, _ = _scores(own, part.column(place))
                    yield part.filter(pa.array(best < own.threshold))

    return docs.mapInArrow(run, docs.schema)
