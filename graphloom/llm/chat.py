"""Chat formatting: collapse of cumulative snapshots, then rendering; DataFrame operations alone.

A chat log often stores a conversation again after each turn. Prefix k of a conversation is hashed as the XOR of
128-bit hashes of (position, role, text) of its first k turns, one running window for all k. A conversation is
dropped if its whole hash is a proper prefix of another, or equals that of one with a smaller id (anti-joins on
(length, hash); the prefix side is first reduced to distinct values, with partial aggregation). What remains is
rendered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BEGIN, END = "<|im_start|>", "<|im_end|>"


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """Ids of the conversations that no longer conversation starts with, and that no equal one with a smaller id repeats.

    Turns are in order of (turn, role, text), nulls first; null role or text differs from an empty one. A null
    conv_id is one conversation. An empty table gives no rows.
    """
    t = turns.select("conv_id", "turn", "role", "text")
    order = W.partitionBy("conv_id").orderBy(*(F.col(c).asc_nulls_first() for c in ("turn", "role", "text")))
    numbered = t.withColumn("k", F.row_number().over(order))
    fields = ["k", F.col("role").isNull(), "role", F.col("text").isNull(), "text"]
    hashed = numbered.select("conv_id", "k", F.xxhash64(*fields).alias("a"), F.xxhash64(F.lit(1), *reversed(fields)).alias("b"))
    run = W.partitionBy("conv_id").orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    prefixes = hashed.select("conv_id", "k", F.bit_xor("a").over(run).alias("a"), F.bit_xor("b").over(run).alias("b"), F.lead("k").over(W.partitionBy("conv_id").orderBy("k")).isNull().alias("whole"))
    proper = prefixes.where(~F.col("whole")).select("k", "a", "b").distinct()
    whole = prefixes.where("whole").groupBy("k", "a", "b").agg(F.min(F.struct(F.col("conv_id").isNotNull().alias("some"), "conv_id")).alias("c"))
    return whole.join(proper, ["k", "a", "b"], "left_anti").select(F.col("c.conv_id").alias("conv_id"), F.col("k").cast("long").alias("n_turns"))


def render_chats(turns: DataFrame) -> DataFrame:
    """One row per maximal conversation: conv_id, n_turns, n_chars, chat (the rendered text). Null role or text is rendered as empty."""
    kept = maximal_conversations(turns)
    t = turns.select("conv_id", "turn", "role", "text")
    mine = t.join(kept.withColumnRenamed("conv_id", "kept_id"), t["conv_id"].eqNullSafe(F.col("kept_id")))
    line = F.concat(F.lit(BEGIN), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END), F.lit("\n"))
    item = F.struct(F.coalesce("turn", F.lit(-(1 << 62))).alias("t"), F.col("role").alias("r"), F.col("text").alias("x"), line.alias("line"))
    chats = mine.groupBy("conv_id", "n_turns").agg(F.sort_array(F.collect_list(item)).alias("items"))
    chat = F.array_join(F.transform("items", lambda x: x["line"]), "")
    return chats.select("conv_id", "n_turns", chat.alias("chat")).withColumn("n_chars", F.length("chat").cast("long"))


#: Same rows, with the text of each prefix in place of a hash.
SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k, role, text FROM conversations),
p AS (SELECT conv_id, k, list(coalesce('r' || role, '') || chr(1) || coalesce('t' || text, '')) OVER (PARTITION BY conv_id ORDER BY k) AS turns, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
w AS (SELECT turns, n, min(conv_id) AS conv_id FROM p WHERE k = n GROUP BY ALL),
kept AS (SELECT conv_id, n FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.turns = w.turns))
SELECT t.conv_id, max(kept.n)::BIGINT AS n_turns, string_agg('{BEGIN}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{END}' || chr(10), '' ORDER BY k) AS chat, length(chat)::BIGINT AS n_chars
FROM t JOIN kept USING (conv_id) GROUP BY t.conv_id
"""
