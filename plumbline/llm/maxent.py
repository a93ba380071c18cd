"""Language-model scores from a hashed maximum-entropy model with a class-factored softmax.

Words are hashed to buckets, and

    P(word | history) = P(class | history) * P(word | class, history).

Classes hold buckets that keep company in documents: the leading directions of
the buckets' co-occurrence, found by a few rounds of averaging over documents
and back, are clustered.  Each factor's softmax is taken by a tree of two-way
ones: the upper nodes choose the class, those below a class part its words in
order of frequency into halves of near-equal corpus mass.  A frequent word is
a few decisions away, a rare one up to some forty, about ten on average; no
decision needs a sum over the vocabulary, and the probabilities of all buckets
sum to one.

Every decision has hashed features: the word before (bigram) and the two words
before (trigram), in the first SKIP_LEVELS levels, which choose the class, also
the words two and three back alone (skips), each joined with the decision's
node and hashed to a slot of a table of weights, and a bias of its own.  The table has a part for each level of the tree, and texts
are worked on level by level, so that the part in use stays in a core's cache.

Training is synchronous and sees every document once: in each round all tasks
add up, over the round's share of the documents, what the slots saw
(observed) and what the common weights foretold (expected);
their difference is the gradient of the log likelihood.  The sums are
combined in a shuffle and one step is taken: along the gradient, scaled in
each slot by its own counts.  So neither the number of tasks nor the order of
rows has a say in the result.

The number of buckets and of slots follows the size of the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import docs_type
from .shelf import Shelf
from .textkit import Words, mix64, slices

ROUNDS = 2
CLASSES, DIRECTIONS, TURNS = 16, 4, 2  #: classes, directions of co-occurrence they are found in, rounds of averaging
SEEDS = 256  #: most frequent buckets, from which the first centres are taken
RATE, PRIOR = 0.4, 0.6  #: length of a step; counts that each slot has beforehand for either side
BUCKET_SHARE, SLOT_SHARE, SLOT_POWER = 32, 16, 0.6  #: buckets for the square root of the corpus' bytes; slots for their power 0.6
SKIP_LEVELS = 6
LIMIT = 16.0  #: log odds are kept within this, so a word's probability never underflows
LEVELS = 16  #: parts of the table; deeper levels share the last one
SLICE, CHUNK = 1 << 18, 1 << 13  #: bytes of text worked on together, words in one step
PIECE = 1 << 14  #: numbers that travel together
TASK_BYTES = 64  #: a task reads about this many bytes of text for each slot, so that what it sends is a small share of what it reads
ROWS = 1 << 16  #: buckets that the driver clusters at a time
BIG = 1 << 26  #: decisions that a slot counts before its part of the table is sent on
_OFFSETS = tuple(np.uint64(x) for x in (0x1B873593A5A5A5A5, 0x85EBCA6BC2B2AE35, 0x27D4EB2F165667C5, 0x9E3779B185EBCA87))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_UNIT = 1 << 12  #: directions are kept as whole numbers of this part


class _Kept(dict):
    """Kept by each worker for itself: it is empty again wherever it is sent."""

    def __reduce__(self):
        return _Kept, ()


@dataclass
class Model:
    """``rank``: place of each bucket by falling frequency.  Node k of the tree parts the ranks below ``split[k]`` from those at or above it;
    ``low[k]`` and ``high[k]`` are the nodes that follow, -1 where one rank is left.  ``bias`` is a node's own log odds, ``slots`` the common table."""

    rank: np.ndarray
    split: np.ndarray
    low: np.ndarray
    high: np.ndarray
    bias: np.ndarray
    slots: np.ndarray
    _walk: np.ndarray | None = field(default=None, init=False, repr=False)

    def walk(self) -> np.ndarray:
        """The nodes after each node (low, high) side by side."""
        if self._walk is None:
            self._walk = np.stack([self.low, self.high], 1).ravel()
        return self._walk

    def state(self) -> dict[str, np.ndarray]:
        """Plain arrays, which travel without this module."""
        return {k: v for k, v in self.__dict__.items() if k != "_walk"}


def grow_tree(counts: np.ndarray, of: np.ndarray | None = None) -> Model:
    """The tree over buckets of the given counts (one is added to each) and classes, with biases from the counts and ``slots`` still empty."""
    counts = counts.astype(np.float64) + 1
    of = np.zeros(len(counts), np.int64) if of is None else of
    order = np.lexsort((np.arange(len(counts)), -counts, of))
    rank = np.empty(len(counts), np.int32)
    rank[order] = np.arange(len(counts), dtype=np.int32)
    mass = np.r_[0.0, np.cumsum(counts[order])]
    edges = np.flatnonzero(np.diff(of[order])) + 1  # where the classes end
    n = max(1, len(counts) - 1)
    split, low, high, bias = np.zeros(n, np.int32), np.full(n, -1, np.int32), np.full(n, -1, np.int32), np.zeros(n, np.float32)
    if len(counts) < 2:
        return Model(rank, split, low, high, bias, np.zeros(0, np.float32))
    a, b, first, made = np.array([0]), np.array([len(counts)]), 0, 1  # the intervals of one level; their nodes are numbered in turn
    while len(a):
        half = (mass[a] + mass[b]) / 2
        middle = np.searchsorted(mass, half)
        middle -= (mass[middle] - half) > (half - mass[np.maximum(middle - 1, 0)])  # the nearer place
        middle = np.clip(middle, a + 1, b - 1)
        if len(edges):  # an interval of several classes is parted between two of them
            away = np.where((edges > a[:, None]) & (edges < b[:, None]), np.abs(mass[edges] - half[:, None]), np.inf)
            best = away.argmin(1)
            inside = np.isfinite(away[np.arange(len(a)), best])
            middle = np.where(inside, edges[best], middle)
            if not inside.any():
                edges = edges[:0]
        me = first + np.arange(len(a))
        split[me] = middle
        bias[me] = np.log((mass[b] - mass[middle]) / (mass[middle] - mass[a]))
        keep = np.stack([middle - a > 1, b - middle > 1], 1)
        number = made + np.cumsum(keep.ravel()).reshape(-1, 2) - 1
        low[me], high[me] = np.where(keep[:, 0], number[:, 0], -1), np.where(keep[:, 1], number[:, 1], -1)
        a, b = np.stack([a, middle], 1).ravel()[keep.ravel()], np.stack([middle, b], 1).ravel()[keep.ravel()]
        first, made = made, made + int(keep.sum())
    return Model(rank, split, low, high, bias, np.zeros(0, np.float32))


def start_directions(buckets: int) -> np.ndarray:
    """(buckets, DIRECTIONS) integers: random signs."""
    return np.where(np.random.default_rng(5).random((buckets, DIRECTIONS)) < 0.5, -_UNIT, _UNIT).astype(np.int32)


def company(table: np.ndarray, words: Words, total: np.ndarray) -> None:
    """Add to ``total`` (DIRECTIONS, buckets), for each word of some texts, the mean of its text's words; whole numbers, so the order of sums has no say."""
    bucket = _buckets(words, len(table))
    if not len(bucket):
        return
    has = np.flatnonzero(words.count)
    first = (np.cumsum(words.count) - words.count)[has]
    mean = np.add.reduceat(table[bucket].astype(np.int64), first, axis=0) // words.count[has][:, None]
    mean = np.repeat(mean, words.count[has], axis=0)
    for d in range(DIRECTIONS):
        np.add.at(total[d], bucket, mean[:, d])


def next_directions(total: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The directions after a round of averaging: centred, made independent and of one length, all weighed by frequency."""
    weight = counts / max(1, counts.sum())
    parts = [slice(at, at + ROWS) for at in range(0, len(counts), ROWS)]

    def mean(at: slice) -> np.ndarray:
        return total[:, at].T / np.maximum(1, counts[at])[:, None]

    centre = sum(weight[at] @ mean(at) for at in parts)

    def centred(at: slice) -> np.ndarray:
        return (mean(at) - centre) * (counts[at] > 0)[:, None]

    value, axis = np.linalg.eigh(sum((x * weight[at][:, None]).T @ x for at in parts for x in [centred(at)]))
    turn = axis / np.sqrt(np.maximum(value, 1e-9))
    out = np.empty((len(counts), len(total)), np.int32)
    for at in parts:
        out[at] = np.clip(np.rint(centred(at) @ turn * _UNIT), -64 * _UNIT, 64 * _UNIT)
    return out


def cluster(points: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Classes of buckets by weighted k-means, started from points far apart; buckets that never occur are in class 0."""
    parts = [slice(at, at + ROWS) for at in range(0, len(counts), ROWS)]
    centres = points[[int(counts.argmax())]] / _UNIT
    often = np.lexsort((np.arange(len(counts)), -counts))[:SEEDS]
    seeds = points[often] / _UNIT
    for _ in range(CLASSES - 1):
        far = ((seeds[:, None] - centres) ** 2).sum(2).min(1)
        if far.max() <= 0:
            break
        centres = np.concatenate([centres, seeds[[int(far.argmax())]]])
    of = np.zeros(len(counts), np.int64)
    for _ in range(8):
        mass, moved = np.zeros(len(centres)), np.zeros(centres.shape)
        for at in parts:
            x = points[at] / _UNIT
            of[at] = ((centres ** 2).sum(1) - 2 * x @ centres.T).argmin(1)
            mass += np.bincount(of[at], counts[at], len(centres))
            moved += np.stack([np.bincount(of[at], counts[at] * x[:, d], len(centres)) for d in range(x.shape[1])], 1)
        centres = np.where(mass[:, None] > 0, moved / np.maximum(mass, 1e-9)[:, None], centres)
    return np.where(counts > 0, of, 0)


def _buckets(words: Words, buckets: int) -> np.ndarray:
    return (((words.hash >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def encode(words: Words, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each word and the (words, 4) hashes of its history features; before a text's begin stands nothing (hash 0)."""
    h = words.hash
    n = len(h)
    base = np.cumsum(words.count) - words.count
    place = np.arange(n) - base[words.doc]
    back = []
    for k in (1, 2, 3):
        b = np.zeros(n, np.uint64)
        b[k:] = h[:-k] if k < n else h[:0]
        b[place < k] = 0
        back.append(b)
    p1, p2, p3 = back
    mixed = (p1 + _OFFSETS[0], (p1 ^ (p2 * _STEP)) + _OFFSETS[1], p2 + _OFFSETS[2], p3 + _OFFSETS[3])
    out = np.empty((n, 4), np.uint64)
    for j, x in enumerate(mixed):
        out[:, j] = mix64(x)
    return _buckets(words, buckets), out


def decisions(model: Model, bucket: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Level by level down the tree, in chunks: (level, words under way, their node, their side, the (words, 4 or 2) slots)."""
    rank = model.rank[bucket]
    at = np.arange(len(rank)) if len(model.rank) > 1 else np.zeros(0, np.int64)
    node = np.zeros(len(at), np.int32)
    part = len(model.slots) // LEVELS
    size, half, level = np.uint64(part), np.uint64(32), 0
    few, after = np.ascontiguousarray(hashes[:, :2]), model.walk()
    while len(at):
        base = min(level, LEVELS - 1) * part
        next_at, next_node, whole = [], [], len(at) == len(rank)
        for c in range(0, len(at), CHUNK):
            a, n = at[c:c + CHUNK], node[c:c + CHUNK]
            pick = slice(c, c + CHUNK) if whole else a
            up = rank[pick] >= model.split[n]
            x = (hashes if level < SKIP_LEVELS else few)[pick] ^ ((n.astype(np.uint64) + np.uint64(1)) * _STEP)[:, None]
            x *= np.uint64(0xD6E8FEB86659FD93)
            x >>= half
            x *= size
            x >>= half
            slot = x.view(np.int64)
            slot += base
            yield level, pick, n, up, slot
            n = after[2 * n + up]
            go = n >= 0
            done = not go.all()
            next_at.append(a[go] if done else a), next_node.append(n[go] if done else n)
        at, node, level = np.concatenate(next_at), np.concatenate(next_node), level + 1


def _chance(model: Model, node: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """Log odds of the upper side."""
    got = model.slots[slot]
    x = model.bias[node]
    for j in range(got.shape[1]):
        x += got[:, j]
    return np.clip(x, -LIMIT, LIMIT, out=x)


class Tally:
    """What slots see, a complex number each: its real part is what was ``expected``, its imaginary part ``BIG`` times the ``upper`` sides taken and the decisions ``seen``.

    One look-up adds all three, and nothing passes over the table from one text to the next.  ``left`` bounds what a slot of each part may still see;
    a part with a slot that nears ``BIG`` is taken out to ``full``, (place, sums) each.
    """

    def __init__(self, size: int):
        self.part = size // LEVELS
        self.sums = [np.zeros(self.part, np.complex128) for _ in range(LEVELS)]  # by part, so that a part can be let go
        self.left = [BIG - 1] * LEVELS
        self.full: list[tuple[int, np.ndarray]] = []

    def add(self, level: int, slot: np.ndarray, p: np.ndarray, up: np.ndarray) -> None:
        k = min(level, LEVELS - 1)
        if self.left[k] < slot.size:
            self._relieve(k)
        self.left[k] -= slot.size
        seen = np.empty(len(p), np.complex128)
        seen.real, seen.imag = p, up * float(BIG) + 1
        for at in np.ascontiguousarray(slot.T) - k * self.part:
            np.add.at(self.sums[k], at, seen)

    def _relieve(self, k: int) -> None:
        """See how much the slots of a part did see, and take it out if a slot is half full."""
        most = int(np.mod(self.sums[k].imag, BIG).max())
        if most >= BIG // 2:
            self.full.append((k * self.part, self.sums[k]))
            self.sums[k], most = np.zeros(self.part, np.complex128), 0
        self.left[k] = BIG - 1 - most

    def all(self) -> Iterator[tuple[int, np.ndarray]]:
        """All sums, (place, ``apart``) each; a place may come more than once."""
        for at, sums in [*self.full, *((k * self.part, x) for k, x in enumerate(self.sums))]:
            yield at, apart(sums)


def apart(sums: np.ndarray) -> np.ndarray:
    """(3, slots): ``seen``, ``upper`` and ``expected`` of a tally's sums."""
    upper = np.floor(sums.imag / BIG)
    return np.stack([sums.imag - upper * BIG, upper, sums.real])


def tally(model: Model, words: Words, to: Tally) -> None:
    """Add what the slots see in some texts."""
    bucket, hashes = encode(words, len(model.rank))
    for level, _, node, up, slot in decisions(model, bucket, hashes):
        to.add(level, slot, 1 / (1 + np.exp(-_chance(model, node, slot))), up)


def gather(model: Model, words: Words, sums: dict[str, np.ndarray]) -> None:
    """Add to ``seen``, ``upper`` and ``expected`` what all slots see in some texts."""
    to = Tally(len(model.slots))
    tally(model, words, to)
    for at, got in to.all():
        for k, x in zip(("seen", "upper", "expected"), got):
            sums[k][at:at + len(x)] += x


def _step(seen: np.ndarray, upper: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """One step of slots along observed less expected counts, on the log scale of either side."""
    lower, unexpected = seen - upper, np.maximum(0, seen - expected)
    step = np.log((upper + PRIOR) / (np.maximum(0, expected) + PRIOR)) - np.log((lower + PRIOR) / (unexpected + PRIOR))
    return (RATE * step).astype(np.float32)


def sizes(n_bytes: int) -> tuple[int, int]:
    """(buckets, slots) for a corpus of so many bytes."""
    return max(256, round(BUCKET_SHARE * n_bytes ** 0.5)), LEVELS * max(256, round(SLOT_SHARE / LEVELS * n_bytes ** SLOT_POWER))


def task_count(n_bytes: int, size: int, cores: int) -> int:
    """Tasks for a pass over a corpus: a whole number for each core, so that none waits for others' last tasks."""
    return cores * max(1, -(-n_bytes // (TASK_BYTES * size * cores)))


def train(spark: SparkSession, docs: DataFrame, *, text: str = "text", rounds: int = ROUNDS, shape: tuple[int, int] | None = None, tasks: int | None = None) -> Model:
    """Fit the model on all words of all documents, each text in one of ``rounds`` rounds (by a hash of it).

    Null, empty and wordless texts add nothing; repeated rows count as often as
    they occur; a very long text is one text; without any word every bucket is
    about as likely as another.  ``shape`` (buckets, slots) replaces what follows from the
    corpus' size, and ``tasks`` the number of tasks.  Columns other than the text are ignored.

    Work: ``TURNS`` passes count the buckets and find their company, then the
    rounds fit; all read the texts where they lie.  What a task sends grows with the table, so tasks read
    about TASK_BYTES a slot; it is combined by piece in the shuffle, where each slot's step is taken too.  A
    task holds 16 bytes a slot for its sums, the
    driver the table (4 bytes a slot), of which a round sends it the steps (4 more); it broadcasts 4 bytes a
    slot and 20 a bucket.  All follow the corpus' size by powers below one.
    """
    shelf = Shelf(spark)
    rows = docs.where(docs[text].isNotNull()).select(docs[text].alias("text"))
    n_bytes = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets, size = shape or sizes(n_bytes)

    tasks = tasks or task_count(n_bytes, size, spark.sparkContext.defaultParallelism)

    built: dict[int, Model] = _Kept()

    fields = "kind string, at bigint, raw binary"

    def record(kind: str, at: int, x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([at]), pa.array([x.tobytes()], pa.binary())], names=["kind", "at", "raw"])

    def total(rows: DataFrame, out: dict[str, np.ndarray], send: Callable[[Iterator[Words]], Iterator[pa.RecordBatch]], finish: Callable[[Iterator[bytes]], np.ndarray]) -> None:
        """Add to ``out`` sums over the texts of ``rows``: ``send`` gives a task's sums by piece, ``finish`` what becomes of all tasks' sums of a piece."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from send(words for batch in batches for part in slices(batch, 0, SLICE) for words in [Words(part.column(0))] if len(words.hash))

        def merge(table: pa.Table) -> pa.Table:
            got = finish(x.as_buffer() for x in table.column("raw"))
            return pa.table({"kind": table.column("kind")[:1], "at": table.column("at")[:1], "raw": pa.array([got.tobytes()], pa.binary())})

        merged = shelf.put(rows.coalesce(tasks).mapInArrow(run, fields).groupBy("kind", "at").applyInArrow(merge, fields))
        for k, at, raw in merged.toLocalIterator():  # the driver holds a few pieces at a time
            x = np.frombuffer(raw, out[k].dtype)
            out[k][at:at + len(x)] += x
        shelf.drop(merged)

    points, counts = start_directions(buckets), None
    for _ in range(TURNS):
        shared = spark.sparkContext.broadcast(points)
        names = [f"d{d}" for d in range(DIRECTIONS)]

        wanted = names if counts is not None else [*names, "counts"]

        def look(texts: Iterator[Words]) -> Iterator[pa.RecordBatch]:
            sums = {k: np.zeros(buckets, np.int64) for k in wanted}
            for words in texts:
                company(shared.value, words, [sums[d] for d in names])
                if "counts" in sums:
                    np.add.at(sums["counts"], _buckets(words, buckets), 1)
            for k, v in sums.items():
                for at in range(0, buckets, PIECE):
                    if v[at:at + PIECE].any():
                        yield record(k, at, v[at:at + PIECE])

        found = np.zeros((len(wanted), buckets), np.int64)
        total(rows, dict(zip(wanted, found)), look, lambda raw: sum(np.frombuffer(x, np.int64) for x in raw))
        counts = found[DIRECTIONS].copy() if counts is None else counts
        points = next_directions(found[:DIRECTIONS], counts)
        shared.unpersist()
        found = shared = None
    of = cluster(points, counts)
    points = None
    model = grow_tree(counts, of)
    of = counts = None

    def own(shared) -> Model:
        """The broadcast model, put together once in a task."""
        if id(shared.value) not in built:
            built.clear()
            built[id(shared.value)] = Model(**shared.value)
        return built[id(shared.value)]

    model.slots = np.zeros(size, np.float32)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(model.state())

        def fit(texts: Iterator[Words]) -> Iterator[pa.RecordBatch]:
            to = Tally(size)

            def pieces(first: int, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
                for at in range(-(first % PIECE), len(sums), PIECE):  # pieces of the table, whatever part of it comes
                    got = np.zeros((3, min(PIECE, size - first - at)), np.float32)
                    here = slice(max(0, at), min(len(sums), at + PIECE))
                    got[:, here.start - at:here.stop - at] = apart(sums[here])
                    if got.any():
                        yield record("slots", first + at, got)

            for words in texts:
                tally(own(shared), words, to)
                while to.full:
                    yield from pieces(*to.full.pop())
            built.clear()  # what is sent needs no model
            words = None
            for k in range(LEVELS):
                yield from pieces(k * to.part, to.sums[k])
                to.sums[k] = None

        def step(raw: Iterator[bytes]) -> np.ndarray:
            return _step(*sum(np.frombuffer(x, np.float32).astype(np.float64) for x in raw).reshape(3, -1))

        total(rows.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == k), {"slots": model.slots}, fit, step)
        shared.unpersist()
    return model


def log_probs(model: Model, words: Words) -> np.ndarray:
    """Log probability (base e) of every word, in sparse batches: a few slots of the table are gathered a decision."""
    bucket, hashes = encode(words, len(model.rank))
    out = np.ones(len(bucket))
    for _, at, node, up, slot in decisions(model, bucket, hashes):
        x = _chance(model, node, slot)
        out[at] *= 1 / (1 + np.exp(np.where(up, -x, x)))
    return np.log(out)


def score(spark: SparkSession, docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``log_prob`` (base e, summed over the words) and ``perplexity`` of every document.

    Null and empty texts, and texts without a word, have no words, a
    ``log_prob`` of 0 and a null perplexity; very long texts are scored whole.
    Rows, repeated or with a null id, pass one by one; ids of any type pass
    through; further columns are ignored, whatever their names; an empty table
    gives an empty result.  A narrow map: the model is broadcast as arrays.
    """
    shared = spark.sparkContext.broadcast(model.state())
    schema = pa.schema([("doc_id", docs_type(docs, doc_id)), ("n_words", pa.int64()), ("log_prob", pa.float64()), ("perplexity", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**shared.value)
        for batch in batches:
            for part in slices(batch, 1, SLICE):
                words = Words(part.column(1))
                lp = np.bincount(words.doc, log_probs(own, words), minlength=words.rows)
                n = words.count.astype(np.int64)
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    ppl = np.exp(-lp / n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(lp), pa.array(ppl, mask=n == 0)], schema=schema)

    return docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")).mapInArrow(
        run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, n_words bigint, log_prob double, perplexity double")
