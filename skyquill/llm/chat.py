"""Chat formatting after cumulative-snapshot collapse.

A logged conversation is the set of its distinct (turn, role, text) rows in that order. Its rolling prefix hash after
each row is the xor of the hashes of all rows so far; a row's hash covers its turn number, so order counts. Two
independent 64-bit hashes and the number of rows stand for a prefix. A conversation that equals a proper prefix of another
goes (anti-join of the whole hashes against all prefix hashes); of equal conversations the one with the smallest id
stays. The maximal ones are rendered.

Running xors are taken within blocks of ``BLOCK`` turn numbers and then across blocks, so a conversation with very many turns
is spread over tasks; equal conversations and equal prefixes meet as partial aggregates. Only hashes are shuffled for all this; texts
are shuffled once, those of the maximal conversations. A conversation is rendered as one row, ``part`` 0, if its turn numbers are under
``PART``; a longer one in parts of ``PART`` turn numbers, which joined in their order are its whole text, so no task has to hold an unbounded one.

Defined cases: a null conversation id is one conversation; null turns come first; a null role or text is rendered as
``unknown`` or empty; repeated rows count once; further columns are ignored; empty tables give empty results. ``<|`` in a
text becomes ``< |``, so that no text can forge a marker.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyquill.llm.common import table

BLOCK = 64
PART = 1024


def _rows(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    df = df.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    key = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))
    return df.select(key.alias("_k"), "*")


def _block(size: int):
    return F.coalesce(F.floor(F.col("turn") / size), F.lit(-(2**62))).cast("long")


def maximal(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """_k, conv_id, n_rows and n_same (equal conversations) of the conversations that stay."""
    rows = _rows(df, conv, turn, role, text)
    # nulls and field borders are told apart by what is put before each value
    mark = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    parts = [mark("turn"), mark("role"), mark("text")]
    rows = rows.select("_k", "conv_id", _block(BLOCK).alias("_b"), F.coalesce("turn", F.lit(-(2**62))).alias("_t"), F.xxhash64(*parts).alias("_x"), F.xxhash64(F.lit("second"), *parts).alias("_y")).distinct()
    blocks = rows.groupBy("_k", "conv_id", "_b").agg(F.count(F.lit(1)).alias("_n"), F.expr("bit_xor(_x)").alias("_bx"), F.expr("bit_xor(_y)").alias("_by"))
    before = W.partitionBy("_k").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.select(
        "_k", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"),
        F.coalesce(F.expr("bit_xor(_bx)").over(before), F.lit(0)).alias("_x0"), F.coalesce(F.expr("bit_xor(_by)").over(before), F.lit(0)).alias("_y0"),
    )
    whole = blocks.groupBy("_k", "conv_id").agg(F.sum("_n").alias("_n"), F.expr("bit_xor(_bx)").alias("_x"), F.expr("bit_xor(_by)").alias("_y"))
    inside = W.partitionBy("_k", "_b").orderBy("_t", "_x", "_y").rowsBetween(W.unboundedPreceding, 0)
    running = rows.select("_k", "_b", F.count(F.lit(1)).over(inside).alias("_r"), F.expr("bit_xor(_x)").over(inside).alias("_rx"), F.expr("bit_xor(_y)").over(inside).alias("_ry"))
    prefixes = running.join(offsets, ["_k", "_b"]).join(whole.select("_k", F.col("_n").alias("_total")), "_k").select(
        (F.col("_n0") + F.col("_r")).alias("_n"), F.col("_x0").bitwiseXOR(F.col("_rx")).alias("_x"), F.col("_y0").bitwiseXOR(F.col("_ry")).alias("_y"), "_total"
    )
    proper = prefixes.filter("_n < _total").groupBy("_n", "_x", "_y").agg(F.max("_total").alias("_longest"))
    same = whole.groupBy("_n", "_x", "_y").agg(F.min(F.struct("conv_id", "_k")).alias("_first"), F.count(F.lit(1)).alias("n_same"))
    kept = same.join(proper, ["_n", "_x", "_y"], "left_anti")
    return kept.select(F.col("_first._k").alias("_k"), F.col("_first.conv_id").alias("conv_id"), F.col("_n").alias("n_rows"), "n_same")


def render(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, part, n_rows (of the conversation), n_same, n_turns (of the part), text of the maximal conversations."""
    kept = maximal(df, conv, turn, role, text).select("_k", "n_rows", "n_same")
    rows = _rows(df, conv, turn, role, text).withColumn("_b", _block(PART)).join(kept, "_k")
    out = rows.groupBy("_k", "conv_id", "_b", "n_rows", "n_same").agg(F.array_sort(F.collect_set(F.struct("turn", "role", "text"))).alias("_l"))
    clean = lambda x: F.replace(F.coalesce(x, F.lit("")), F.lit("<|"), F.lit("< |"))
    line = lambda r: F.concat(F.lit("<|"), F.coalesce(r["role"], F.lit("unknown")), F.lit("|>\n"), clean(r["text"]), F.lit("<|end|>\n"))
    return out.select("conv_id", F.col("_b").alias("part"), "n_rows", "n_same", F.size("_l").cast("long").alias("n_turns"), F.array_join(F.transform("_l", line), "").alias("text"))


def op10_chat_snapshot_collapse(spark, sf_dir: str) -> DataFrame:
    return render(table(spark, sf_dir, "conversations"))


ORACLE = f"""
WITH r AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
c AS (SELECT conv_id, count(*) AS n_rows, list({{'a': turn, 'b': role, 'c': text}} ORDER BY turn, role, text) AS l FROM r GROUP BY conv_id),
g AS (SELECT l, any_value(n_rows) AS n_rows, min(conv_id) AS conv_id, count(*) AS n_same FROM c GROUP BY l),
k AS (SELECT * FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE b.n_rows > a.n_rows AND b.l[1] = a.l[1] AND b.l[1:a.n_rows] = a.l))
SELECT conv_id, CAST(floor(turn / {PART}.0) AS BIGINT) AS part, n_rows, n_same, count(*) AS n_turns,
       string_agg('<|' || role || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10), '' ORDER BY turn, role, text) AS text
FROM r JOIN k USING (conv_id) GROUP BY ALL
"""
