"""Chat formatting of maximal conversations (DataFrame functions only).

Logs keep a conversation again after each turn, so many logged conversations are prefixes of longer ones. A rolling
hash of the turns so far names every prefix; conversations whose whole hash is a proper prefix of another one are
removed by an anti-join, equal conversations leave the smallest id, and what remains is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import write_table

#: Turns in a chunk: the most that one window or one rendered part holds of a conversation.
CHUNK = 256


def _turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, chunk, ha, hb, role, text): one row per distinct turn; nulls as empty, turns without number last."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).where("conv_id is not null")
    chunk = F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit((1 << 62)))
    return rows.select("conv_id", F.coalesce("turn", F.lit((1 << 62))).alias("turn"), chunk.alias("chunk"),
                       F.xxhash64("role", "text").alias("ha"), F.xxhash64("text", F.lit("|"), "role").alias("hb"), "role", "text")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b): the 128-bit hash of every conversation's first ``pos`` turns.

    A turn's hash contains its position, so the exclusive or over a prefix is an order-aware rolling hash that adds
    up chunk by chunk: windows see a chunk's turns or a conversation's chunks, never a whole long conversation.
    """
    own = Window.partitionBy("conv_id", "chunk").orderBy("turn", "ha", "hb")
    ranked = turns.withColumn("r", F.row_number().over(own))
    sizes = ranked.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "chunk", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    placed = ranked.join(starts, ["conv_id", "chunk"]).withColumn("pos", F.col("start") + F.col("r"))
    placed = placed.select("conv_id", "chunk", "pos", F.xxhash64("pos", "ha", "hb").alias("pa"), F.xxhash64("hb", F.lit("p"), "pos", "ha").alias("pb"))
    sums = placed.groupBy("conv_id", "chunk").agg(F.bit_xor("pa").alias("ca"), F.bit_xor("pb").alias("cb"))
    before = sums.select("conv_id", "chunk", F.coalesce(F.bit_xor("ca").over(ahead), F.lit(0)).alias("ca"), F.coalesce(F.bit_xor("cb").over(ahead), F.lit(0)).alias("cb"))
    upto = Window.partitionBy("conv_id", "chunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("conv_id", "chunk", "pos", F.bit_xor("pa").over(upto).alias("a"), F.bit_xor("pb").over(upto).alias("b"))
    return local.join(before, ["conv_id", "chunk"]).select("conv_id", "pos", F.col("a").bitwiseXOR(F.col("ca")).alias("a"), F.col("b").bitwiseXOR(F.col("cb")).alias("b"))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies): conversations that are no proper prefix of another; of equal ones the smallest id.

    Prefixes and whole conversations are made distinct before they meet, so a very common opening is one row.
    """
    turns = _turns(conversations).select("conv_id", "turn", "chunk", "ha", "hb").distinct()
    prefixes, _ = write_table(prefix_hashes(turns), "chat-prefixes")
    ends = prefixes.groupBy("conv_id").agg(F.max(F.struct("pos", "a", "b")).alias("e")).select("conv_id", "e.pos", "e.a", "e.b")
    whole = ends.groupBy("pos", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    proper = prefixes.join(ends.select("conv_id", F.col("pos").alias("n")), "conv_id").where("pos < n").select("pos", "a", "b").distinct()
    return whole.join(proper, ["pos", "a", "b"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "n_copies")


def chatml(role: Column, text: Column) -> Column:
    """One turn between ChatML markers."""
    return F.concat(F.lit("<|im_start|>"), role, F.lit("\n"), text, F.lit("<|im_end|>\n"))


def format_chats(conversations: DataFrame, line=chatml) -> DataFrame:
    """Render maximal conversations of ``conversations`` (conv_id, turn, role, text).

    A conversation is its distinct rows in the order of turn (null last; equal turn numbers by a hash of role and
    text); null roles and texts count as empty, rows without conv_id belong to no conversation. One that is a proper
    prefix of another is left out; of equal ones the smallest conv_id stays.

    Returns conv_id, part, n_turns, n_copies, text. ``text`` joins the rendered turns; a conversation with turn
    numbers beyond 255 comes in parts of 256 turn numbers, counted from 0, to be joined in order. Other columns are
    not read. An empty table gives an empty result.
    """
    kept, _ = write_table(maximal(conversations), "chat-maximal")
    turns = _turns(conversations).join(kept.select("conv_id"), "conv_id", "left_semi")
    lines = turns.groupBy("conv_id", "chunk").agg(F.collect_set(F.struct("turn", "ha", "hb", line(F.col("role"), F.col("text")).alias("line"))).alias("lines"))
    text = F.array_join(F.transform(F.array_sort("lines"), lambda x: x["line"]), "")
    parts, _ = write_table(lines.select("conv_id", "chunk", text.alias("text")), "chat-parts")
    numbered = parts.select("conv_id", "chunk", (F.row_number().over(Window.partitionBy("conv_id").orderBy("chunk")) - 1).alias("part"))
    return parts.join(numbered, ["conv_id", "chunk"]).join(kept, "conv_id").select("conv_id", "part", "n_turns", "n_copies", "text")
