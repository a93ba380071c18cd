"""SimHash near-deduplication by a binary trie self-join.

Each document becomes a 128-bit SimHash of its distinct words.  Two codes
within ``budget`` differing bits are near copies.  The pairs are found by
walking a binary trie against itself: a pair of nodes goes on to its pairs of
children with the bits that differ so far added up, and stops as soon as the
sum exceeds the error budget.

A budget that is large against the trie's upper levels prunes nothing there,
so the code is cut into ``m`` segments and the walk is done ``m`` times, each
time with another segment first.  If two codes differ in ``budget`` bits or
fewer, some segment has at most ``budget // m`` of them, so the walk that
starts with that segment may use the small budget for the first
``128 / m`` levels and the full one below.  This loses no pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .components import connected_components
from .shelf import Shelf, fresh
from .textkit import Words, mix64, slices

BITS = 128
BUDGET = 26  #: differing bits of a near copy: half the pairs at 0.7 Jaccard similarity of the word sets, nine in ten at 0.8
#: Codes of one trie tile, of which a task holds two (24 bytes a code): TILE_SHARE times the square root of the number of codes, within these bounds.
TILE_SHARE, TILE_CODES = 256, (1 << 15, 1 << 23)
LEAF = 32  #: a node with at most this many codes is compared outright
_SEEDS = (np.uint64(0x51A7E0F2C39B1D01), np.uint64(0xA3C59AC2F0E1B7D3))


def simhash(words: Words) -> np.ndarray:
    """(rows, 2) uint64: the SimHash of each row's set of distinct words."""
    # The row number takes the top 20 bits of a sort key; 44 bits of the hash remain.
    key = (words.doc.astype(np.uint64) << np.uint64(44)) | (words.hash >> np.uint64(20))
    key.sort()
    if len(key):
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        key = key[new]
    code = key << np.uint64(20)
    two = np.empty((len(key), 2), dtype=np.uint64)
    for i, seed in enumerate(_SEEDS):
        two[:, i] = mix64(code ^ seed)
    bounds = np.searchsorted(key >> np.uint64(44), np.arange(words.rows + 1, dtype=np.uint64))
    out = np.zeros((words.rows, BITS), dtype=bool)
    for i in range(words.rows):
        a, b = bounds[i], bounds[i + 1]
        if b > a:
            ones = np.zeros(BITS, dtype=np.uint32)
            for at in range(a, b, 1 << 16):  # bounds the unpacked bits of a very long text
                ones += np.unpackbits(two[at:min(b, at + (1 << 16))].view(np.uint8), axis=1).sum(0, dtype=np.uint32)
            out[i] = 2 * ones > b - a
    return np.packbits(out, axis=1).view(">u8").astype(np.uint64)


def codes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``hi``, ``lo`` (the code as two bigints) of every document that has a word and an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                for at in range(0, part.num_rows, 1 << 19):
                    some = part.slice(at, 1 << 19)
                    words = Words(some.column(1))
                    has = np.flatnonzero(words.count)
                    two = simhash(words)[has].view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0).take(pa.array(has)), pa.array(two[:, 0]), pa.array(two[:, 1])], names=["doc_id", "hi", "lo"])

    rows = docs.where(docs[doc_id].isNotNull() & docs[text].isNotNull()).select(
        docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, hi bigint, lo bigint")


def plan_segments(n: int, budget: int, bits: int = BITS) -> int:
    """Number of segments (walks) with the least estimated work for ``n`` codes; any number gives the same pairs."""

    def work(m: int) -> float:
        width, small = bits // m, budget // m
        if small >= width:
            return math.inf
        share = lambda d: sum(math.comb(d, i) for i in range(min(small, d) + 1)) / 2.0 ** d
        depth = min(width, max(1, math.ceil(math.log2(max(2.0, n / LEAF)))))
        nodes = sum(4.0 ** d * share(d) / 2 for d in range(1, depth + 1))
        return m * (nodes * 4 + n * n / 2.0 * share(depth) + n * 20.0)

    return min(range(1, budget + 2), key=work)


def rotate(hi: np.ndarray, lo: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotate 128-bit codes left."""
    by %= BITS
    if by >= 64:
        hi, lo, by = lo, hi, by - 64
    if by:
        a, b = np.uint64(by), np.uint64(64 - by)
        hi, lo = (hi << a) | (lo >> b), (lo << a) | (hi >> b)
    return hi, lo


def trie_pairs(hi1, lo1, hi2, lo2, *, width: int, small: int, budget: int, same: bool, block: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of two sorted code arrays within the budgets, in bounded blocks.

    ``width`` leading bits may hold at most ``small`` differences, all bits at
    most ``budget``.  With ``same`` both arrays are one and each unordered pair
    comes once.  A trie node is a range of a sorted array; a child is the part
    of the range below or above the middle of its prefix, so no tree is stored.
    """

    def bit(hi, lo, at, level):
        word = hi[at] if level < 64 else lo[at]
        return (word >> np.uint64(63 - level % 64)) & np.uint64(1)

    if not len(hi1) or not len(hi2):
        return
    stack = [(0, np.array([0]), np.array([len(hi1)]), np.array([0]), np.array([len(hi2)]), np.zeros(1, np.int16))]
    while stack:
        level, a0, a1, b0, b1, diff = stack.pop()
        if len(a0) > block:  # depth first over halves keeps the stack small
            h = len(a0) // 2
            stack += [(level, a0[h:], a1[h:], b0[h:], b1[h:], diff[h:]), (level, a0[:h], a1[:h], b0[:h], b1[:h], diff[:h])]
            continue
        leaf = ((a1 - a0 <= LEAF) & (b1 - b0 <= LEAF)) if level < BITS else np.ones(len(a0), dtype=bool)
        if leaf.any():
            yield from _compare(hi1, lo1, hi2, lo2, a0[leaf], a1[leaf], b0[leaf], b1[leaf], width, small, budget, same, 1 << 16)
            go = ~leaf
            a0, a1, b0, b1, diff = a0[go], a1[go], b0[go], b1[go], diff[go]
        if not len(a0):
            continue
        am, bm = _middle(hi1, lo1, a0, a1, level, bit), _middle(hi2, lo2, b0, b1, level, bit)
        limit = small if level < width else budget
        parts = []
        for (p0, p1, q0, q1, add) in ((a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1)):
            ok = (p1 > p0) & (q1 > q0) & (diff + add <= limit)
            if same:
                ok &= p0 <= q0  # the mirrored pair of nodes is walked instead
            if ok.any():
                parts.append((p0[ok], p1[ok], q0[ok], q1[ok], diff[ok] + np.int16(add)))
        if parts:
            stack.append((level + 1, *(np.concatenate(x) for x in zip(*parts))))


def _middle(hi, lo, a0, a1, level, bit):
    """Where the bit at ``level`` turns to 1 in each range (binary search in all ranges together)."""
    low, high = a0.copy(), a1.copy()
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) >> 1
        one = np.zeros(len(low), dtype=bool)
        one[open_] = bit(hi, lo, mid[open_], level).astype(bool)
        high = np.where(open_ & one, mid, high)
        low = np.where(open_ & ~one, mid + 1, low)


def _compare(hi1, lo1, hi2, lo2, a0, a1, b0, b1, width, small, budget, same, block):
    """All pairs of codes of the given pairs of ranges that keep to the budgets.

    Pairs of ranges of one shape are compared together: their codes are
    gathered once and broadcast against each other.
    """
    na, nb = a1 - a0, b1 - b0
    wide = int(nb.max()) + 1
    shape = na * wide + nb
    order = np.argsort(shape, kind="stable")
    ends = np.r_[np.flatnonzero(np.diff(shape[order])) + 1, len(order)]
    begin = 0
    for end in ends:
        p, q = divmod(int(shape[order[begin]]), wide)
        if p * q > block:  # codes equal but for their last bits, in ranges too large for one step
            for k in order[begin:end]:
                step = max(1, block // q)
                for at in range(int(a0[k]), int(a1[k]), step):
                    yield from _grid(hi1, lo1, hi2, lo2, np.arange(at, min(at + step, int(a1[k])))[None], np.arange(b0[k], b1[k])[None], width, small, budget, same)
        else:
            step = max(1, block // (p * q))
            for at in range(begin, end, step):
                k = order[at:min(at + step, end)]
                yield from _grid(hi1, lo1, hi2, lo2, a0[k, None] + np.arange(p), b0[k, None] + np.arange(q), width, small, budget, same)
        begin = end


def _grid(hi1, lo1, hi2, lo2, i, j, width, small, budget, same):
    """Pairs of each row of ``i`` with the same row of ``j`` that keep to the budgets."""
    x = hi1[i][:, :, None] ^ hi2[j][:, None]
    count = np.bitwise_count(x)
    k, r, c = np.nonzero(count <= budget)  # most pairs differ too much in their first half
    if not len(k):
        return
    i, j, x = i[k, r], j[k, c], x[k, r, c]
    y = lo1[i] ^ lo2[j]
    head = np.bitwise_count(x >> np.uint64(64 - width)) if width <= 64 else np.bitwise_count(x).astype(np.int16) + np.bitwise_count(y >> np.uint64(128 - width))
    ok = (np.bitwise_count(x).astype(np.int16) + np.bitwise_count(y) <= budget) & (head <= small)
    if same:
        ok &= i < j
    if ok.any():
        yield i[ok], j[ok]


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union the given pairs into ``label`` (each node's label is a node of its set, the least in the end)."""
    while True:
        la, lb = label[a], label[b]
        ne = la != lb
        if not ne.any():
            return label
        a, b, la, lb = a[ne], b[ne], la[ne], lb[ne]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt


def near_groups(spark: SparkSession, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", budget: int = BUDGET,
                tile_codes: int | None = None, segments: int | None = None) -> DataFrame:
    """All members of all near-duplicate groups: ``doc_id``, ``keep_id``, ``copies``, ``kept``.

    Two documents are linked if their codes differ in ``budget`` bits or
    fewer (every such pair is found); a group is a connected component, and
    its smallest id stays.  Documents without a partner have no row, nor have
    documents without a word (null, empty, signs only) or without an id.
    Rows that repeat an id count as one document with all their texts.  Ids
    are integers of any width; others raise.  Very long texts are read whole.
    Ties cannot arise; an empty table gives an empty result; further columns
    are ignored, whatever their names.

    Texts are read once, in a narrow map, and never shuffled: 24 bytes a
    document go on.  Equal codes collapse to one before the join.  Codes are
    cut into tiles by the first bits of each walk; only pairs of tiles whose
    prefixes keep to the walk's small budget meet, each in one task, and a
    task returns a spanning forest of its pairs, never the pairs themselves,
    so a group of thousands of copies costs thousands of rows.
    """
    shelf = Shelf(spark)
    coded = shelf.put(codes(docs, doc_id=doc_id, text=text))
    one = shelf.put(coded.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep")))
    n = one.count()
    m = segments or plan_segments(n, budget)
    width, small = BITS // m, budget // m
    tile_codes = tile_codes or min(TILE_CODES[1], max(TILE_CODES[0], int(TILE_SHARE * n ** 0.5)))
    level = max(0, math.ceil(math.log2(max(1.0, n / tile_codes)))) if n else 0
    level = min(level, width, 20)
    near = _join_tiles(one, m, width, small, budget, level)
    # Documents with one code, and rows that share an id, are linked as well.
    alike = coded.join(one, ["hi", "lo"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    parts = shelf.put(connected_components(spark, near.union(alike), shelf))
    size = parts.groupBy("component").agg(F.count(F.lit(1)).alias("copies"))
    return parts.join(size, "component").select(
        F.col("node").alias("doc_id"), F.col("component").alias("keep_id"), "copies", (F.col("node") == F.col("component")).alias("kept"))


def _join_tiles(one: DataFrame, m: int, width: int, small: int, budget: int, level: int) -> DataFrame:
    """Edges (``a``, ``b``) of a spanning forest for each pair of tiles of each walk."""
    word = "shiftrightunsigned({0}, {1})"

    def prefix(by: int) -> str:
        """The first ``level`` bits of the code rotated left by ``by``, as SQL."""
        if not level:
            return "0L"
        first, second, at = ("hi", "lo", by) if by < 64 else ("lo", "hi", by - 64)
        if not at:
            return word.format(first, 64 - level)
        whole = f"(shiftleft({first}, {at}) | {word.format(second, 64 - at)})"
        return word.format(whole, 64 - level)

    walks = F.array(*[F.struct(F.lit(i).alias("walk"), F.expr(f"cast({prefix(i * width)} as bigint)").alias("tile")) for i in range(m)])
    rows = one.select("hi", "lo", "rep", F.explode(walks).alias("w")).select("hi", "lo", "rep", "w.walk", "w.tile")
    if level:
        # All masks within the small budget: the tiles that a tile must meet.
        masks = [x for x in range(1 << level) if x.bit_count() <= small]
        rows = rows.withColumn("mask", F.explode(F.lit(masks).cast("array<bigint>")))
    else:
        rows = rows.withColumn("mask", F.lit(0).cast("bigint"))
    other = F.col("tile").bitwiseXOR(F.col("mask"))
    rows = rows.select("walk", F.least("tile", other).alias("p"), F.greatest("tile", other).alias("q"), "tile", "hi", "lo", "rep")

    def run(table: pa.Table) -> pa.Table:
        walk, p, q = (table.column(c)[0].as_py() for c in ("walk", "p", "q"))
        tile = table.column("tile").to_numpy()
        hi, lo = (table.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
        rep = table.column("rep").to_numpy()
        hi, lo = rotate(hi, lo, walk * width)
        order = np.lexsort((lo, hi, tile != p))
        hi, lo, rep = hi[order], lo[order], rep[order]
        cut = int((tile == p).sum())
        same = p == q
        label = np.arange(len(rep))
        a, b = (slice(0, len(rep)),) * 2 if same else (slice(0, cut), slice(cut, len(rep)))
        waiting, held = [], 0
        for i, j in trie_pairs(hi[a], lo[a], hi[b], lo[b], width=width, small=small, budget=budget, same=same):
            waiting.append((i, j if same else j + cut))
            held += len(i)
            if held > 1 << 21:
                label = merge_labels(label, *(np.concatenate(x) for x in zip(*waiting)))
                waiting, held = [], 0
        if waiting:
            label = merge_labels(label, *(np.concatenate(x) for x in zip(*waiting)))
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"a": rep[moved], "b": rep[label[moved]]})

    return rows.groupBy("walk", "p", "q").applyInArrow(run, "a bigint, b bigint")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` without the rows of near-duplicate groups whose id is not the group's smallest.

    All columns pass through, whatever their names; documents that
    :func:`near_groups` leaves out (null, empty and wordless texts, rows
    without an id, singles) stay.  Rows that repeat an id share its fate; an
    empty table stays empty.
    """
    shelf = Shelf(spark)
    (gone,) = fresh(docs, "gone")
    lost = shelf.put(near_groups(spark, docs, doc_id=doc_id, text=text, **kw).where("not kept").select(F.col("doc_id").alias(gone)))
    return docs.join(shelf.small(lost), docs[doc_id].cast("bigint") == F.col(gone), "left_anti")
