"""Exact deduplication by distributed MSD radix partitioning.

Documents are split by successive digits of their bytes: the first
``FIRST_BYTES`` bytes, then a digit that reaches ``GROWTH`` times as far, and
so on.  A group with one member drops out, a group whose members end inside
the digit is a group of equal documents, and only the others are split again.
Groups are told apart by the bytes themselves; no digest stands for a text.

Work, the same at every size: digits are counted with map-side combining, so
a text with a million copies is one row a task, and then each row travels once
to the count of its digit, by a join that may be split where a group is large.
Texts that occur once end there.  What is left is split by its next digit
alone, within its group, and sends only the bytes from there on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .shelf import Shelf, fresh

FIRST_BYTES = 256  #: width of the first digit
GROWTH = 8  #: each digit reaches this many times further into the text


def _ended(raw: Column, depth: int) -> Column:
    return F.octet_length(raw) <= depth


def _groups(rows: DataFrame, keys: list[Column], raw: Column, width: int, uid: Column | None = None) -> DataFrame:
    """Groups of two or more rows alike in ``keys`` and the first ``width`` bytes; those that end there apart: ``key0``, ..., ``digit``, ``over``, ``n``, ``gid``."""
    names = [f"key{i}" for i in range(len(keys))]
    digits = rows.select(*[k.alias(n) for k, n in zip(keys, names)], F.substring(raw, 1, width).alias("digit"), _ended(raw, width).alias("over"), (F.lit(0) if uid is None else uid).alias("uid"))
    return digits.groupBy(*names, "digit", "over").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("gid")).where("n > 1")


def _levels(shelf: Shelf, rows: DataFrame, first: int, growth: int) -> DataFrame | None:
    """(``uid``, ``gid``) of all members of groups of equal texts; ``gid`` is one for a group.

    ``rows``: ``uid``, a number of its own for each row, and ``raw``, the text
    where it stands in a group of its first digit (there ``gid`` and ``over``).
    """
    found, active, depth = [rows.where("over").select("uid", "gid")], rows.where("not over").select("uid", "gid", F.substring("raw", first + 1, 1 << 30).alias("raw")), first
    while not active.isEmpty():
        width, depth = depth * growth - depth, depth * growth
        groups = _groups(active, [F.col("gid")], F.col("raw"), width, F.col("uid")).select(F.col("key0").alias("old"), "digit", "over", F.col("gid").alias("new"))
        same = (F.col("gid") == F.col("old")) & (F.substring("raw", 1, width) == F.col("digit")) & (_ended(F.col("raw"), width) == F.col("over"))
        level = shelf.put(active.join(groups.hint("shuffle_hash"), same).select(
            "uid", F.col("new").alias("gid"), "over", F.when(~F.col("over"), F.substring("raw", width + 1, 1 << 30)).alias("raw")))
        found.append(level.where("over").select("uid", "gid"))
        active = level.where("not over").select("uid", "gid", "raw")
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def _start(shelf: Shelf, rows: DataFrame, raw: Column, names: list[str], first: int, how: str) -> DataFrame:
    """``rows`` joined with the groups of their first digit, written down, with ``names``: a row number, the group, whether the group's texts end there."""
    uid, gid, over, digit, end = names
    groups = _groups(rows, [], raw, first).select(F.col("digit").alias(digit), F.col("over").alias(end))
    joined = rows.join(groups.hint("shuffle_hash"), (F.substring(raw, 1, first) == F.col(digit)) & (_ended(raw, first) == F.col(end)), how)
    # The first digit names its group here; from the next on, the least row number does.
    return shelf.put(joined.select(*[F.col(f"`{c}`") for c in rows.columns], F.monotonically_increasing_id().alias(uid), F.col(digit).alias(gid), F.col(end).alias(over)))


def _numbered(shelf: Shelf, rows: DataFrame) -> DataFrame:
    """Members of groups of the first digit with a number in its place: ``uid``, ``gid``, ``over``, ``raw``."""
    least = rows.groupBy("digit", "over").agg(F.min("uid").alias("gid")).select(F.col("digit").alias("d"), F.col("over").alias("o"), "gid")
    return shelf.put(rows.join(least.hint("shuffle_hash"), (F.col("digit") == F.col("d")) & (F.col("over") == F.col("o"))).select(
        "uid", "gid", "over", F.when(~F.col("over"), F.col("raw")).alias("raw")))


def exact_groups(spark: SparkSession, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", first: int = FIRST_BYTES,
                 growth: int = GROWTH) -> DataFrame:
    """All members of all groups of byte-identical texts: ``doc_id``, ``keep_id`` (smallest id of the group), ``copies``, ``kept``.

    Documents whose text occurs once have no row.  Empty texts equal each
    other; null texts equal nothing.  Very long texts are compared to their
    last byte.  Repeated rows are members of their own (``kept`` then holds on
    each row of the smallest id).  Ids are of any type that has an order.  Null
    ids: members with a null ``doc_id``; ``keep_id`` is null only if all ids
    are.  An empty table gives an empty result; further columns are ignored,
    whatever their names.
    """
    shelf = Shelf(spark)
    whole = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("raw"))
    some = _start(shelf, whole, F.col("raw"), ["uid", "digit", "over", "d", "o"], first, "inner")
    members = _levels(shelf, _numbered(shelf, some), first, growth)
    members = shelf.put(some.select("uid", "doc_id").join(members.hint("shuffle_hash"), "uid").select("doc_id", "gid"))
    size = members.groupBy("gid").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("keep_id"))
    return members.join(size.hint("shuffle_hash"), "gid").select("doc_id", "keep_id", "copies", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"))


def exact_groups_sql() -> str:
    """DuckDB SQL for :func:`exact_groups` over ``documents``."""
    return """
SELECT doc_id, keep_id, copies, doc_id IS NOT DISTINCT FROM keep_id AS kept FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id, count(*) OVER (PARTITION BY text) AS copies
  FROM documents WHERE text IS NOT NULL) WHERE copies > 1"""


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", first: int = FIRST_BYTES,
                          growth: int = GROWTH) -> DataFrame:
    """``docs`` with one row for each distinct text: the one with the smallest id (ties: smallest other columns as strings, then any one of equal rows).

    All columns pass through under their own names, whatever they are.  Rows
    with a null text all stay; empty texts count as equal; very long texts are
    compared to their last byte; a null id stays only if the whole group has
    no other; ids are of any type that has an order; an empty table stays
    empty.  Rows are told apart by a number given when they are written
    down, so no digest stands for a row either.
    """
    shelf = Shelf(spark)
    names = fresh(docs, "uid", "digit", "over", "d", "o")
    uid, digit, over = names[:3]
    every = _start(shelf, docs, F.col(f"`{text}`").cast("binary"), names, first, "left")
    some = every.where(F.col(digit).isNotNull())
    inner = _numbered(shelf, some.select(F.col(uid).alias("uid"), F.col(digit).alias("digit"), F.col(over).alias("over"), F.col(f"`{text}`").cast("binary").alias("raw")))
    members = _levels(shelf, inner, first, growth)
    others = F.array(*[F.col(f"`{c}`").cast("string") for c in docs.columns if c not in (doc_id, text)]) if len(docs.columns) > 2 else F.array(F.lit(None).cast("string"))
    order = F.struct(F.col(f"`{doc_id}`").isNull().alias("a"), F.col(f"`{doc_id}`").alias("b"), F.transform(others, lambda x: F.struct(x.isNull().alias("a"), x.alias("b"))).alias("c"), F.col(uid).alias("d"))
    ranked = some.select(F.col(uid).alias("uid"), order.alias("place")).join(members.hint("shuffle_hash"), "uid")
    kept = ranked.groupBy("gid").agg(F.min("place").alias("best")).select(F.col("best.d").alias("kept"))
    lost = shelf.put(members.join(kept.hint("shuffle_hash"), F.col("uid") == F.col("kept"), "left_anti").select(F.col("uid").alias("lost")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    left = some.join(lost.hint("shuffle_hash"), F.col(uid) == F.col("lost"), "left_anti").select(*columns)
    return every.where(F.col(digit).isNull()).select(*columns).unionByName(left)
