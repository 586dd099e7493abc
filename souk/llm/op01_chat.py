"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations.

A service that logs a conversation after every turn leaves snapshots, each a prefix of the next. Turns are numbered within
their conversation, each turn's role, text and number are hashed, and the hashes so far are folded into a rolling prefix
hash. A conversation whose whole hash is a proper prefix hash of some conversation, or the whole hash of one with a smaller
id, goes by an anti-join; the maximal conversations are rendered.

Conversations are worked on in blocks of turns: ranks, hashes and text are built within a block and joined over the blocks,
so the turns of one very long conversation are spread over tasks. What is compared is 128 bits of hashes and the length.

Defined results: turns are ordered by turn (null first), then role, then text; rows that repeat whole are one turn; a null role or text
is an empty one, different from a null in no way; markers of the template inside a role or text are escaped; a null conv_id
is a conversation of its own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souk.llm.common import materialize

#: Turn numbers are worked on in blocks of this many.
BLOCK = 128
START, END = "<|im_start|>", "<|im_end|>"


def escape(value: Column) -> Column:
    """One backslash more wherever only backslashes, or nothing, stand between < and |im_: no text holds a marker, and taking one away gives it back."""
    return F.regexp_replace(value, r"<(\\*)\|im_", r"<$1\\|im_")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), escape(role), F.lit("\n"), escape(text), F.lit(END), F.lit("\n"))


def _numbered(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, block, rank, at, role, text): at counts the turns of a conversation from 1."""
    turns = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).distinct()
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))).cast("long"))
    ranked = turns.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long"))
    ranked = materialize(ranked, "chat-turns")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = ranked.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "start")
    return ranked.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))).withColumn("at", F.col("start") + F.col("rank")).select("conv_id", "block", "rank", "at", "role", "text")


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, block, at, h1, h2, role, text): rolling hashes of each conversation's first `at` turns."""
    hashed = turns.withColumn("t1", F.xxhash64("at", "role", "text")).withColumn("t2", F.xxhash64(F.lit("second"), "text", "at", "role"))
    inside = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = hashed.groupBy("conv_id", "block").agg(F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
    totals = totals.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.coalesce(F.bit_xor("x1").over(before), F.lit(0)).alias("b1"), F.coalesce(F.bit_xor("x2").over(before), F.lit(0)).alias("b2"))
    rolled = hashed.withColumn("p1", F.bit_xor("t1").over(inside)).withColumn("p2", F.bit_xor("t2").over(inside))
    joined = rolled.join(totals, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    return joined.select("conv_id", "block", "at", F.col("p1").bitwiseXOR(F.col("b1")).alias("h1"), F.col("p2").bitwiseXOR(F.col("b2")).alias("h2"), "role", "text")


def maximal(rolled: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that prefix no longer one and equal none with a smaller id."""
    last = rolled.groupBy("conv_id").agg(F.max_by(F.struct("at", "h1", "h2"), "at").alias("z")).select("conv_id", "z.*")
    proper = rolled.alias("r").join(last.select(F.col("conv_id").alias("lc"), F.col("at").alias("la")).alias("l"), F.col("r.conv_id").eqNullSafe(F.col("l.lc"))).where("at < la").select(F.col("at").alias("pat"), F.col("h1").alias("ph1"), F.col("h2").alias("ph2")).distinct()
    single = last.groupBy("at", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    return single.join(proper, (F.col("at") == F.col("pat")) & (F.col("h1") == F.col("ph1")) & (F.col("h2") == F.col("ph2")), "left_anti").select("conv_id", F.col("at").alias("n_turns"))


def format_chats(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_chars, chat) of the maximal conversations, rendered."""
    rolled = materialize(prefixes(_numbered(conversations, id_col, turn_col, role_col, text_col)), "chat-prefixes")
    kept = maximal(rolled).select(F.col("conv_id").alias("k"), "n_turns")
    turns = rolled.join(kept, F.col("conv_id").eqNullSafe(F.col("k")))
    in_order = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["piece"]), "")
    blocks = turns.groupBy("conv_id", "n_turns", "block").agg(in_order(F.collect_list(F.struct("at", render_turn(F.col("role"), F.col("text")).alias("piece")))).alias("piece"))
    whole = blocks.groupBy("conv_id", "n_turns").agg(in_order(F.collect_list(F.struct("block", "piece"))).alias("chat"))
    return whole.select("conv_id", "n_turns", F.length("chat").cast("long").alias("n_chars"), "chat")


#: The same in DuckDB SQL, comparing lists of turns.
SQL = r"""
WITH chats AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {conversations}) GROUP BY conv_id),
single AS (SELECT min(conv_id) AS conv_id, turns FROM chats GROUP BY turns),
prefixed AS (
  SELECT DISTINCT a.conv_id FROM single a JOIN single b ON a.turns[1] = b.turns[1] AND len(a.turns) < len(b.turns) AND b.turns[1:len(a.turns)] = a.turns),
kept AS (SELECT * FROM single s WHERE NOT EXISTS (SELECT 1 FROM prefixed p WHERE p.conv_id IS NOT DISTINCT FROM s.conv_id)),
rendered AS (
  SELECT conv_id, len(turns)::BIGINT AS n_turns,
    list_aggregate(list_transform(turns, lambda x: '<|im_start|>' || regexp_replace(x.r, '<(\\*)\|im_', '<\1\\|im_', 'g') || chr(10) || regexp_replace(x.t, '<(\\*)\|im_', '<\1\\|im_', 'g') || '<|im_end|>' || chr(10)), 'string_agg', '') AS chat FROM kept)
SELECT conv_id, n_turns, length(chat)::BIGINT AS n_chars, chat FROM rendered
"""


def oracle(conversations: str = "conversations") -> str:
    return SQL.replace("{conversations}", conversations)
