"""Conversation operators (P11, P28): turns -> rendered chat, multi-turn preference pairs.

A rendered conversation is one output record, so its turns are gathered per conversation
(bounded by the conversation's own length); ordering is by an explicit turn key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vulnsift.functions import formats as fm


def render_chats(turns: DataFrame, key: str = "conv_id", add_generation_prompt: bool = False) -> DataFrame:
    """Fallback chat template over turn rows; unknown roles dropped."""
    r = turns.select(key, "turn", fm.chat_turn(F.col("role"), F.col("text")).alias("piece")).where(F.col("piece").isNotNull())
    g = r.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("turn", "piece"))).alias("parts"))
    body = F.array_join(F.transform("parts", lambda p: p["piece"]), "")
    if add_generation_prompt:
        body = F.concat(body, F.lit("<|assistant|>\n"))
    return g.select(key, body.alias("rendered"), F.size("parts").alias("n_turns"))


def multi_turn_preferences(turns: DataFrame, answers: DataFrame, key: str = "conv_id") -> DataFrame:
    """One context and two answers to its last user turn. `answers` (key, turn, answer_id, text, score) are
    candidate assistant turns; chosen has the best score, rejected the worst (ties to the smaller answer_id), pairs with equal
    scores are dropped. The context is every turn before `turn`, so it holds neither answer."""
    best = F.max_by(F.struct("text", "score"), F.struct(F.col("score"), -F.col("answer_id")))
    worst = F.min_by(F.struct("text", "score"), F.struct(F.col("score"), F.col("answer_id")))
    pairs = answers.groupBy(key, "turn").agg(best.alias("best"), worst.alias("worst")).where("best.score > worst.score")
    ctx = turns.join(pairs.select(key, F.col("turn").alias("answer_turn")), key).where("turn < answer_turn")
    rendered = render_chats(ctx.select(key, "turn", "role", "text"), key).select(key, F.col("rendered").alias("context"))
    return pairs.join(rendered, key).select(key, F.col("turn").alias("answer_turn"), "context", F.col("best.text").alias("chosen"),
                                              F.col("worst.text").alias("rejected"))
