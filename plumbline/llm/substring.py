"""Substring deduplication by content-defined chunks.

A gear rolling hash over the last ``GEAR_WINDOW`` bytes decides where a text
may be cut; a place is a cut if no other candidate lies within ``MIN_GAP``
bytes before it.  Both rules look at nearby bytes only, so an insertion moves
no cut beyond its neighbourhood.  A chunk runs from one cut to the first cut
at least ``MIN_CHUNK`` bytes on; chunks that begin at neighbouring cuts
overlap, so a repeated passage is found whatever surrounds it.  Chunks are
deduplicated by a 128-bit digest, and the repeated chunks of a document are
joined to passages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .shelf import Shelf, fresh
from .textkit import mix64, slices, utf8

GEAR_WINDOW = 16
GATE_BITS = 0xE400  #: bits of the gear hash that are 0 at a candidate: one place in sixteen
MIN_GAP = 12
MIN_CHUNK = 64
MAX_CHUNK = 1024  #: a stretch without cuts is cut this far on
HOT_KEYS = 1 << 15  #: a half digest is frequent if it has more than this part of all chunks; there can't be more such halves, so they may be broadcast
LEAST_HOT = 1 << 12  #: nor is one that has fewer chunks than this
_GEAR = np.random.default_rng(0x6EA2).integers(0, 1 << 32, 256, dtype=np.uint32)
_POLY = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted cut places of all texts laid end to end; a text's begin and end are cuts."""
    n = len(raw)
    gear = _GEAR[raw].astype(np.uint16)  # bit k of the hash depends on the last k + 1 bytes, so 16 bits hold the window
    step = 1
    while step < GEAR_WINDOW:  # doubling: the hash over 2k bytes from two over k
        gear[step:] += gear[:-step] << np.uint16(step)
        step *= 2
    at = np.flatnonzero((gear & np.uint16(GATE_BITS)) == 0) + 1
    ends = offsets[1:]
    if len(at):
        row = np.searchsorted(ends, at, side="left")
        begin = offsets[row]
        ok = (at - begin >= GEAR_WINDOW) & (at < ends[row])  # the window lies within the text
        at, begin = at[ok], begin[ok]
    if len(at):
        near = np.r_[False, at[1:] - at[:-1] < MIN_GAP]
        at = at[~near | (np.r_[-1, at[:-1]] < begin)]
    every = np.unique(np.concatenate([at, offsets]))
    gap = np.diff(every)
    long = np.flatnonzero(gap > MAX_CHUNK)
    if len(long):
        more = (gap[long] - 1) // MAX_CHUNK
        k = np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1
        every = np.sort(np.concatenate([every, np.repeat(every[long], more) + k * MAX_CHUNK]))
    return every


class _Powers(dict):
    def __reduce__(self):
        return _Powers, ()


_KEPT = _Powers()


def _sums(raw: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash and the inverse powers that bring spans to one place."""
    n = len(raw)
    if len(_KEPT.get(base, ((),))[0]) < n + 1:
        size = 1 << max(20, n.bit_length())
        up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _KEPT[base] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    up, down = _KEPT[base]
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_MIX[base][raw] * up[:n], out=total[1:])
    return total, down


_MIX = {b: np.random.default_rng(b % 1009).integers(1, 1 << 63, 256, dtype=np.uint64) for b in _POLY}


def chunks(col: pa.Array) -> tuple[np.ndarray, ...]:
    """(row, start, size, digest 1, digest 2) of the chunks of a column; start is a byte place in the row's text."""
    raw, offsets = utf8(col)
    every = cuts(raw, offsets)
    row = np.searchsorted(offsets, every, side="right") - 1
    stop = offsets[np.minimum(row + 1, len(offsets) - 1)]
    to = np.searchsorted(every, every + MIN_CHUNK, side="left")
    end = every[np.minimum(to, len(every) - 1)] if len(every) else every
    ok = (to < len(every)) & (end <= stop) & (every < stop)
    # A text shorter than a chunk is one chunk, unless it is shorter than the gap between cuts.
    whole = (every == offsets[np.minimum(row, len(offsets) - 1)]) & ~ok & (stop - every >= MIN_CHUNK // 2) & (every < stop)
    end = np.where(whole, stop, end)
    pick = np.flatnonzero(ok | whole)
    a, b, row = every[pick], end[pick], row[pick]
    size = (b - a).astype(np.uint64)
    digests = []
    for base in _POLY:
        total, down = _sums(raw, base)
        digests.append(mix64((total[b] - total[a]) * down[a] + size).view(np.int64))
    return row, a - offsets[row], b - a, *digests


def chunk_table(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``start``, ``size``, ``d1``, ``d2``: one row a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                row, start, size, d1, d2 = chunks(part.column(1))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(d1), pa.array(d2)],
                    names=["doc_id", "start", "size", "d1", "d2"])

    rows = docs.where(docs[doc_id].isNotNull() & docs[text].isNotNull()).select(docs[doc_id].cast("bigint").alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, start int, size int, d1 bigint, d2 bigint")


def repeated_passages(spark: SparkSession, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every passage that the corpus holds more than once: ``doc_id``, ``start``, ``end``, ``keep_id``, ``copies``, ``kept``.

    ``start`` and ``end`` are byte places in the UTF-8 text.  ``keep_id`` is the
    smallest id that holds the passage; ``copies`` is the number of places of
    its most frequent chunk; ``kept`` holds where the passage stands first
    (in the smallest id, at its first place) and would stay.  Neighbouring
    repeated chunks with one ``keep_id`` form one passage.

    A passage that spans a chunk between two cuts, about ``MIN_CHUNK`` bytes
    and some gaps, is found; shorter repeats are not looked for.  Null and
    empty texts, and rows without an id, have no passages; a repeated row
    repeats all its chunks (its two copies share an id, and neither stands
    first by itself, so both are kept).  Ids are integers of any width; others
    raise.  Very long texts are cut whole.  Ties cannot arise; an empty table
    gives an empty result; further columns are ignored, whatever their names.

    Work: texts are read once in a narrow map; 32 bytes a chunk go on.  Half
    digests are counted with map-side combining; the chunks are then moved
    once, to the repeated halves, and everything up to the passages happens
    where they are, in streams: a frequent digest is never held in memory.
    The most frequent halves (fewer than HOT_KEYS) are not moved at all: their
    chunks meet them where they lie, and are combined within tasks.
    """
    shelf = Shelf(spark)
    table = shelf.put(chunk_table(docs, doc_id=doc_id, text=text))
    # Half a digest picks the rows that may repeat; only these are told apart by the whole one.
    halves = shelf.put(table.groupBy("d1").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    least = max(LEAST_HOT, table.count() // HOT_KEYS)
    hot = shelf.put(halves.where(F.col("n") > least).select("d1"))
    one = F.min(F.struct("doc_id", "start", "size")).alias("first")

    def firsts(rows: DataFrame) -> DataFrame:
        return rows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("copies"), one).where("copies > 1").select(
            F.col("d1").alias("f1"), F.col("d2").alias("f2"), "copies", F.col("first.doc_id").alias("keep_id"), F.col("first.start").alias("keep_start"))

    def hits_of(rows: DataFrame, first: DataFrame) -> DataFrame:
        # The second half is compared by a difference, which leaves the first one the only key of the join and spares a shuffle.
        return rows.join(first, (F.col("d1") == F.col("f1")) & (F.col("d2").bitwiseXOR(F.col("f2")) == 0)).select(
            "doc_id", "start", (F.col("start") + F.col("size")).alias("end"), "copies", "keep_id",
            ((F.col("doc_id") == F.col("keep_id")) & (F.col("start") == F.col("keep_start"))).alias("kept"))

    # All of it is partitioned by the first half, and both uses of the rows read the same columns, so they share one exchange.
    rows = table.join(F.broadcast(hot), "d1", "left_anti").join(halves.where(F.col("n") <= least).select("d1").hint("shuffle_hash"), "d1")
    hits = hits_of(rows, firsts(rows).hint("shuffle_hash"))
    if not hot.isEmpty():
        often = table.join(F.broadcast(hot), "d1", "left_semi")
        first = shelf.put(firsts(often))  # about a row for each frequent half
        hits = hits.unionByName(hits_of(often, shelf.small(first)))
    by = Window.partitionBy("doc_id", "keep_id", "kept")
    before = by.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    marked = hits.withColumn("new", F.coalesce((F.col("start") > F.max("end").over(before)).cast("int"), F.lit(1)))
    marked = marked.withColumn("passage", F.sum("new").over(by.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "keep_id", "kept", "passage").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.max("copies").alias("copies")).select(
        "doc_id", "start", "end", "keep_id", "copies", "kept")


def drop_passages(spark: SparkSession, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least: int = 4 * MIN_CHUNK) -> DataFrame:
    """``docs`` with every repeated passage of ``least`` bytes or more taken out of the texts that do not keep it.

    Whole UTF-8 characters are taken: one that a passage only touches stays.
    All columns and rows pass through, whatever their names; a text that is one
    passage becomes empty.  Null and empty texts and rows without an id stay as
    they are, and so do repeated rows, which keep their passages in common
    with themselves; a very long text is one row; an empty table stays empty.

    Work: passages are few against texts; they are gathered by document, and
    each text travels once to its own.
    """
    shelf = Shelf(spark)
    (ident, cut) = fresh(docs, "ident", "cut")
    spans = repeated_passages(spark, docs, doc_id=doc_id, text=text).where(~F.col("kept") & (F.col("end") - F.col("start") >= least) & (F.col("doc_id") != F.col("keep_id")))
    cuts_ = shelf.put(spans.groupBy(F.col("doc_id").alias(ident)).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cut)))
    joined = docs.join(cuts_.hint("shuffle_hash"), docs[doc_id] == F.col(ident), "left").select(*[F.col(f"`{c}`") for c in docs.columns], F.col(cut))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for t, spans in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                if t is not None and spans:
                    raw, out, at = t.encode(), [], 0
                    for x in spans:
                        a, b = max(at, x["start"]), x["end"]
                        while a < b and a < len(raw) and raw[a] & 0xC0 == 0x80:
                            a += 1
                        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
                            b -= 1
                        if b > a:
                            out.append(raw[at:a])
                            at = b
                    t = b"".join([*out, raw[at:]]).decode()
                new.append(t)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns[place] = pa.array(new, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return joined.mapInArrow(run, docs.schema)
