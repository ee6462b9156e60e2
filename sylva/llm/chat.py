"""Operator 6, chat formatting of preferences: common prompt once, then two masked completions.

A pair is a chosen and a rejected conversation. Its prompt is their longest common prefix of turns (equal role and
text), rendered once; what follows in each is its completion. A turn is rendered as ``<|role|>\\n`` + text + ``<|end|>\\n``.
Masks are [start, end) code points of a completion that are learned from: the text and end mark of each assistant turn.

Defined results: turns go by (turn, role, text), nulls first; a null role or text is as empty; rows without conv_id or
turn belong to no conversation and are left out; repeated turns are turns of their own, repeated pairs are one pair. A pair lacking one side is left
out; equal conversations have two empty completions. Other columns are not read. An empty table gives an empty result.
A pair is one training example and must fit in a row, as any example must.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table

END = "<|end|>\n"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(END))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _masks(turns: Column, role: str) -> Column:
    def step(acc: Column, t: Column) -> Column:
        body = acc["at"] + F.length(t["role"]) + 5
        end = acc["at"] + F.length(_rendered(t))
        return F.struct(end.alias("at"), F.when(t["role"] == role, F.concat(acc["out"], F.array(F.struct(body.alias("start"), end.alias("end"))))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("out")), step, lambda acc: acc["out"])


def preferences(turns: DataFrame, pairs: DataFrame, role: str = "assistant") -> DataFrame:
    """One row for each (pair_id, chosen_id, rejected_id) of pairs, formatted from turns (conv_id, turn, role, text).

    Two shuffles: sides meet their turns by conv_id, and a pair's turns by pair_id.
    """
    side = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("chosen_id").alias("conv_id")), F.struct(F.lit(1).alias("side"), F.col("rejected_id").alias("conv_id")))).alias("s")
    sides = pairs.select("pair_id", "chosen_id", "rejected_id").distinct().select("pair_id", "chosen_id", "rejected_id", side).select("pair_id", "chosen_id", "rejected_id", "s.side", "s.conv_id")
    rows = turns.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    met = sides.join(rows, "conv_id").groupBy("pair_id", "chosen_id", "rejected_id").agg(F.array_sort(F.collect_list(F.struct("side", "turn", "role", "text"))).alias("all"))
    plain = lambda k: F.transform(F.filter("all", lambda t: t["side"] == k), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    met = met.select("pair_id", "chosen_id", "rejected_id", plain(0).alias("chosen"), plain(1).alias("rejected")).where((F.size("chosen") > 0) & (F.size("rejected") > 0))
    differs = F.array_position(F.zip_with("chosen", "rejected", lambda x, y: ~F.coalesce(x == y, F.lit(False))), True).cast("int")
    n = F.when(differs > 0, differs - 1).otherwise(F.size("chosen"))
    met = met.withColumn("prompt_turns", n)
    rest = lambda k: F.slice(k, F.col("prompt_turns") + 1, F.size(k))
    met = met.withColumns({"prompt": _text(F.slice("chosen", F.lit(1), F.col("prompt_turns"))), "chosen": rest("chosen"), "rejected": rest("rejected")})
    return met.select("pair_id", "chosen_id", "rejected_id", "prompt_turns", "prompt", *[x for k in ("chosen", "rejected") for x in (_text(F.col(k)).alias(f"{k}_completion"), _masks(F.col(k), role).alias(f"{k}_masks"))])


def neighbours(turns: DataFrame) -> DataFrame:
    """Pairs for a table without preferences: conversations 2k (chosen) and 2k + 1 (rejected)."""
    ids = turns.select("conv_id").where("conv_id is not null").distinct()
    pair = F.floor(F.col("conv_id") / 2).cast("long")
    out = ids.groupBy(pair.alias("pair_id")).agg(F.min("conv_id").alias("chosen_id"), F.max("conv_id").alias("rejected_id"))
    return out.where("chosen_id < rejected_id")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    out = preferences(turns, neighbours(turns))
    written = lambda k: F.array_join(F.transform(f"{k}_masks", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string"))), ",")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("pair_id", "chosen_id", "rejected_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), sha(F.col("prompt")).alias("prompt_sha256"), *[x for k in ("chosen", "rejected") for x in (sha(F.col(f"{k}_completion")).alias(f"{k}_sha256"), written(k).alias(f"{k}_masks"))])


OP6_SQL = r"""
WITH t AS (SELECT conv_id, conv_id // 2 AS pair_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS k,
  coalesce(role, '') AS role, '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS x FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
p AS (SELECT pair_id, min(conv_id) AS chosen_id, max(conv_id) AS rejected_id FROM t GROUP BY pair_id HAVING min(conv_id) < max(conv_id)),
n AS (SELECT p.*, (SELECT count(*) FROM t WHERE conv_id = chosen_id) AS nc, (SELECT count(*) FROM t WHERE conv_id = rejected_id) AS nr FROM p),
d AS (SELECT n.pair_id, n.chosen_id, n.rejected_id, coalesce(min(c.k) - 1, min(least(nc, nr))) AS prompt_turns FROM n
  LEFT JOIN (SELECT a.pair_id, a.k FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.conv_id < b.conv_id AND a.k = b.k WHERE a.x <> b.x OR a.role <> b.role) c USING (pair_id)
  GROUP BY n.pair_id, n.chosen_id, n.rejected_id),
m AS (SELECT d.pair_id, t.conv_id, t.k, t.role, t.x, t.k > prompt_turns AS after,
  coalesce(sum(CASE WHEN t.k > prompt_turns THEN length(t.x) ELSE 0 END) OVER (PARTITION BY t.conv_id ORDER BY t.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM d JOIN t USING (pair_id)),
s AS (SELECT pair_id, conv_id, coalesce(string_agg(x, '' ORDER BY k) FILTER (NOT after), '') AS prompt, coalesce(string_agg(x, '' ORDER BY k) FILTER (after), '') AS completion,
  coalesce(string_agg(CAST(pos + length(role) + 5 AS BIGINT) || ':' || CAST(pos + length(x) AS BIGINT), ',' ORDER BY k) FILTER (after AND role = 'assistant'), '') AS masks FROM m GROUP BY pair_id, conv_id)
SELECT d.pair_id, chosen_id, rejected_id, CAST(prompt_turns AS BIGINT) AS prompt_turns, sha256(c.prompt) AS prompt_sha256,
  sha256(c.completion) AS chosen_sha256, c.masks AS chosen_masks, sha256(r.completion) AS rejected_sha256, r.masks AS rejected_masks
FROM d JOIN s c ON c.conv_id = chosen_id JOIN s r ON r.conv_id = rejected_id
"""
