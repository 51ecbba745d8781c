"""Chat formatting: collapse cumulative snapshots, then render what is left.

A logged conversation is dropped if its turns are the beginning of a longer
logged one, or all the turns of one with a smaller id.  A rolling hash names every
beginning: each turn adds (by exclusive or) two 64-bit hashes of its place and its
SHA-256 digest, a running window that keeps no list.  An anti-join against the proper
beginnings leaves the maximal conversations.

Only digests are shuffled to find them: equal conversations become one row
before the join, and equal beginnings are merged before the shuffle, so a common
first turn or conversation costs one row per task.  The text then moves once, to
be put together by conversation.  DataFrame functions only.

Cases: a null role or text counts as empty; null turns come first; rows of one
turn are ordered by their digest, and rows that repeat in full count once; a row
without a conversation id is a conversation of its own, of one turn, so any number
of them is spread over tasks; a conversation of any number of turns is sorted and
rolled on disk if need be, and its chat is one value; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from umbra.sources.scratch import written


def _digest() -> Column:
    return F.sha2(F.concat("role", F.lit("\x1f"), "text"), 256)


def _turns(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    empty = F.lit("")
    return conversations.select(
        F.col(id_col).alias("id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), empty).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), empty).alias("text"),
    )


def _marks(place: Column, digest: Column) -> list[Column]:
    return [F.xxhash64(F.lit(k), place, digest) for k in (1, 2)]


def maximal_conversations(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(id, n_turns, d)`` of the conversations that are no beginning of another one; ``d`` is the digest of a turn."""
    turns = _turns(conversations, id_col, turn_col, role_col, text_col).select("id", "turn", _digest().alias("d"))
    # dealt by conversation at once, for the distinct rows and for the windows
    said = turns.filter("id is not null").repartition("id").distinct()
    in_order = Window.partitionBy("id").orderBy(F.asc_nulls_first("turn"), "d")
    said = said.withColumns({"k": F.row_number().over(in_order), "last": F.lead("d").over(in_order).isNull()})
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = [F.bit_xor(m).over(so_far).alias(name) for name, m in zip(("p", "q"), _marks(F.col("k"), F.col("d")))]
    rolled = written(said.select("id", "k", "last", "d", *rolled), "prefixes")
    one = F.lit(1)
    alone = turns.filter("id is null").select("id", one.alias("k"), F.lit(True).alias("last"), "d", *(m.alias(n) for n, m in zip(("p", "q"), _marks(one, F.col("d")))))
    distinct = rolled.unionAll(alone).filter("last").groupBy("p", "q").agg(F.min("id").alias("id"), F.max("k").alias("n_turns"), F.min("d").alias("d"))
    begun = rolled.filter("not last").select("p", "q").distinct()
    return distinct.join(begun, ["p", "q"], "left_anti").select("id", "n_turns", "d")


def format_chats(
    conversations: DataFrame,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    opening: str = "<|{role}|>\n",
    closing: str = "<|end|>\n",
) -> DataFrame:
    """``id_col``, ``n_turns``, ``chat``: one row for each maximal conversation, rendered turn by turn."""
    kept = maximal_conversations(conversations, id_col, turn_col, role_col, text_col)
    turns = _turns(conversations, id_col, turn_col, role_col, text_col)
    before, after = opening.split("{role}")
    kept = written(kept, "kept")
    rows = turns.join(kept.filter("id is not null").select("id", "n_turns"), "id").select("id", "n_turns", F.struct("turn", _digest().alias("d"), "role", "text").alias("t"))
    chats = rows.groupBy("id", "n_turns").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    alone = turns.filter("id is null").select("id", F.struct(F.lit(None).cast("long").alias("turn"), _digest().alias("d"), "role", "text").alias("t"))
    alone = alone.join(kept.filter("id is null").select("n_turns", F.col("d").alias("kept_d")), F.col("t.d") == F.col("kept_d"))
    chats = chats.unionAll(alone.select("id", "n_turns", F.array("t").alias("ts")).distinct())
    said = F.transform("ts", lambda t: F.concat(F.lit(before), t["role"], F.lit(after), t["text"], F.lit(closing)))
    return chats.select(F.col("id").alias(id_col), "n_turns", F.array_join(said, "").alias("chat"))
