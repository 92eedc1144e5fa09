"""Preference formatting with DataFrame functions only.

A pair names a chosen and a rejected conversation. Their longest common prefix of turns is
rendered once as the prompt; the turns after it are rendered as two completions, each with
the spans of characters that training scores (assistant text and its end mark).

A turn's place is its number; rows of one conversation with the same number stand together,
ordered by role and text, and belong to the prefix if both sides have the same ones. The
prefix is found without gathering a conversation: +1 and -1 are summed for each (pair, turn,
role, text), and the smallest turn with a sum other than zero ends it. Conversations are
gathered only to render them, one row a pair.

Cases: null role or text is empty; null turns come first, as one place; rows of null
conversation and pairs with a null or missing side give nothing; a pair of equal conversations
has two empty completions; of conversations that differ at once, an empty prompt; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Marks of the public ChatML layout.
START, END = "<|im_start|>", "<|im_end|>"
SCORED_ROLE = "assistant"
_FIRST = -(1 << 63)


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END + "\n"))), "")


def _spans(turns: Column) -> Column:
    """``start:end`` (code points, end exclusive) of what is scored, comma-joined."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state, t):
        first = state["at"] + len(START) + F.char_length(t["role"]) + 1
        last = first + F.char_length(t["text"]) + len(END)
        span = F.concat_ws(":", first.cast("string"), last.cast("string"))
        return F.struct((last + 1).alias("at"), F.when(t["role"] == SCORED_ROLE, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    return F.aggregate(turns, zero, step, lambda s: F.array_join(s["out"], ","))


def format_preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` and ``pairs(pair_id, chosen_id, rejected_id)`` to
    pair_id, chosen_id, rejected_id, n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask.
    """
    rows = turns.where("conv_id is not null").select(
        "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(_FIRST)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sides = pairs.where("chosen_id is not null and rejected_id is not null").select(
        "pair_id", "chosen_id", "rejected_id",
        F.explode(F.array(F.struct(F.col("chosen_id").alias("conv_id"), F.lit(1).alias("sign")), F.struct(F.col("rejected_id").alias("conv_id"), F.lit(-1).alias("sign")))).alias("side"))
    sides = sides.select("pair_id", "chosen_id", "rejected_id", "side.conv_id", "side.sign")
    dealt = rows.join(sides, "conv_id")
    uneven = dealt.groupBy("pair_id", "turn", "role", "text").agg(F.sum("sign").alias("s")).where("s != 0")
    ends = uneven.groupBy("pair_id").agg(F.min("turn").alias("first"))
    marked = dealt.join(ends, "pair_id", "left").withColumn("shared", F.col("first").isNull() | (F.col("turn") < F.col("first")))
    turn = F.struct("turn", "role", "text")

    def gather(condition: Column) -> Column:
        return F.sort_array(F.collect_list(F.when(condition, turn)))

    chosen, shared = F.col("sign") == 1, F.col("shared")
    gathered = marked.groupBy("pair_id", "chosen_id", "rejected_id").agg(
        gather(chosen & shared).alias("p"), gather(chosen & ~shared).alias("c"), gather(~chosen & ~shared).alias("r"),
        F.max(F.when(chosen, 1)).alias("has_chosen"), F.max(F.when(~chosen, 1)).alias("has_rejected"))
    p, c, r = F.col("p"), F.col("c"), F.col("r")
    return gathered.where("has_chosen = 1 and has_rejected = 1").select(
        "pair_id", "chosen_id", "rejected_id", F.size(p).cast("long").alias("n_prefix"), _rendered(p).alias("prompt"), _rendered(c).alias("chosen"),
        _rendered(r).alias("rejected"), _spans(c).alias("chosen_mask"), _spans(r).alias("rejected_mask"))


def with_other_answers(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preference data from a table of independent conversations: (turns, pairs) for ``format_preferences``.

    Conversation c is the chosen side 2c of pair c; the rejected side 2c + 1 is c with the last answer of
    conversation c + 1 in place of its own last one, so both share what comes before. An answer is the greatest
    text of the scored role in the last turn that has one; conversations without one, and those that none
    follows, make no pair.
    """
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(_FIRST)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    answers = rows.where(F.col("role") == SCORED_ROLE).groupBy("conv_id").agg(F.max(F.struct("turn", "text")).alias("answer"))
    own = answers.select("conv_id", F.col("answer.turn").alias("last"))
    following = answers.select((F.col("conv_id") - 1).alias("conv_id"), F.col("answer.text").alias("other"))
    both = own.join(following, "conv_id")
    dealt = rows.join(both, "conv_id")
    replaced = F.when((F.col("turn") == F.col("last")) & (F.col("role") == SCORED_ROLE), F.col("other")).otherwise(F.col("text"))
    sides = F.explode(F.array(F.struct((2 * F.col("conv_id")).alias("conv_id"), F.col("text").alias("text")), F.struct((2 * F.col("conv_id") + 1).alias("conv_id"), replaced.alias("text")))).alias("side")
    out = dealt.select("turn", "role", sides).select("side.conv_id", "turn", "role", "side.text")
    return out, both.select(F.col("conv_id").alias("pair_id"), (2 * F.col("conv_id")).alias("chosen_id"), (2 * F.col("conv_id") + 1).alias("rejected_id"))


ORACLE = """
WITH r AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, coalesce(CAST(turn AS BIGINT), -9223372036854775808) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC) AS place FROM r WHERE role = 'assistant') WHERE place = 1),
b AS (SELECT l.conv_id AS pair_id, l.turn AS last, n.text AS other FROM l JOIN l n ON n.conv_id = l.conv_id + 1),
d AS (SELECT pair_id, turn, role, text, true AS is_chosen FROM r JOIN b ON r.conv_id = b.pair_id
  UNION ALL SELECT pair_id, turn, role, CASE WHEN turn = last AND role = 'assistant' THEN other ELSE text END, false FROM r JOIN b ON r.conv_id = b.pair_id),
u AS (SELECT pair_id, turn FROM d GROUP BY pair_id, turn, role, text HAVING sum(CASE WHEN is_chosen THEN 1 ELSE -1 END) <> 0),
f AS (SELECT pair_id, min(turn) AS first FROM u GROUP BY 1),
m AS (SELECT d.*, first IS NULL OR turn < first AS shared, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS part,
             13 + length(role) AS head, length(text) + 10 AS body FROM d LEFT JOIN f USING (pair_id)),
o AS (SELECT *, sum(head + body + 1) OVER (PARTITION BY pair_id, is_chosen, shared ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) - body - 1 AS a FROM m)
SELECT pair_id, 2 * pair_id AS chosen_id, 2 * pair_id + 1 AS rejected_id, CAST(count(*) FILTER (shared AND is_chosen) AS BIGINT) AS n_prefix,
  coalesce(string_agg(part, '' ORDER BY turn, role, text) FILTER (shared AND is_chosen), '') AS prompt,
  coalesce(string_agg(part, '' ORDER BY turn, role, text) FILTER (NOT shared AND is_chosen), '') AS chosen,
  coalesce(string_agg(part, '' ORDER BY turn, role, text) FILTER (NOT shared AND NOT is_chosen), '') AS rejected,
  coalesce(string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a + body AS BIGINT) AS VARCHAR), ',' ORDER BY turn, role, text) FILTER (NOT shared AND is_chosen AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a + body AS BIGINT) AS VARCHAR), ',' ORDER BY turn, role, text) FILTER (NOT shared AND NOT is_chosen AND role = 'assistant'), '') AS rejected_mask
FROM o GROUP BY pair_id
"""
