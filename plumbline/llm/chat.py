"""Chat formatting with Spark expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def format_chats(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 start: str = "<|", mid: str = "|>\n", end: str = "<|end|>\n", joint: str = "\n", escape: str | None = None) -> DataFrame:
    """One formatted string per conversation: ``conv_id``, ``n_turns``, ``n_messages``, ``chat``.

    The turns of a conversation are gathered as structs and sorted by turn
    number (ties: by role, then text; null numbers first).  Adjacent turns of
    one role merge into one message, their texts joined by ``joint``; each
    message prints as ``start role mid text end``.  A null role counts as
    ``unknown``; turns whose text is null are dropped; an empty text stays.  A
    conversation without any remaining turn has no row.  Repeated rows are
    turns like any other; a null id is a conversation of its own; ids of any
    type; very long texts are kept whole; an empty table gives an empty
    result; further columns are ignored, whatever their names.

    Marks inside a text print as they are, so a text that holds ``end`` and
    ``start`` looks like a turn of its own; with ``escape`` every ``start``
    inside a text or role is replaced by it.

    One shuffle by conversation, with map-side gathering; sorting, merging and
    printing are array expressions, so no Python worker starts.
    """
    safe = lambda c: c if escape is None else F.replace(c, F.lit(start), F.lit(escape))
    rows = turns.where(F.col(text).isNotNull()).select(
        F.col(conv_id).alias("conv_id"),
        F.struct(F.col(turn).alias("t"), safe(F.coalesce(F.col(role), F.lit("unknown"))).alias("r"), safe(F.col(text)).alias("x")).alias("turn"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    # Places where the role changes, then one slice of the sorted turns from each place to the next: linear in the turns.
    places = F.filter(F.sequence(F.lit(1), F.size("turns")),
                      lambda i: (i == 1) | (F.get("turns", i - 1)["r"] != F.get("turns", i - 2)["r"]))
    runs = F.transform("places", lambda at, k: F.slice(
        F.col("turns"), at, F.coalesce(F.get("places", k + 1), F.size("turns") + 1) - at))
    printed = F.transform("runs", lambda run: F.concat(
        F.lit(start), F.get(run, F.lit(0))["r"], F.lit(mid), F.array_join(F.transform(run, lambda t: t["x"]), joint), F.lit(end)))
    return (chats.withColumn("places", places).withColumn("runs", runs)
            .select("conv_id", F.size("turns").alias("n_turns"), F.size("runs").alias("n_messages"), F.array_join(printed, "").alias("chat")))


def format_chats_sql() -> str:
    """DuckDB SQL for :func:`format_chats` over ``conversations`` with its default parameters."""
    return """
WITH t AS (
  SELECT conv_id, coalesce(role,'unknown') AS r, text AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role,'unknown'), text) AS k
  FROM conversations WHERE text IS NOT NULL),
e AS (SELECT *, CASE WHEN lag(r) OVER w = r THEN 0 ELSE 1 END AS first FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY k)),
m AS (SELECT *, sum(first) OVER (PARTITION BY conv_id ORDER BY k) AS g FROM e),
p AS (SELECT conv_id, g, count(*) AS n, '<|' || any_value(r) || '|>' || chr(10) || string_agg(x, chr(10) ORDER BY k) || '<|end|>' || chr(10) AS s
      FROM m GROUP BY conv_id, g)
SELECT conv_id, sum(n)::INTEGER AS n_turns, count(*)::INTEGER AS n_messages, string_agg(s, '' ORDER BY g) AS chat FROM p GROUP BY conv_id"""
