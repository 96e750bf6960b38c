"""Conversation-level operators: chat rendering (TX-1) and scoring bundles
(SC-13..16).

A conversation is rendered by formatting every message row on its own
(row-local, with ``lag``/``lead`` over the conversation for the tool-run
rule) and joining the pieces in turn order per conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rlframe.functions import transcript as TR

# Fixed value that must match the reference template: the system message
# used when a conversation does not start with one.
DEFAULT_SYSTEM = "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."

# Data sources scored by the multi-hop QA scorer.
QA_SOURCES = ("hotpotqa/hotpot_qa", "bdsaglam/musique", "xanhho/2WikiMultihopQA")


def render_chat(msgs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                content: str = "content", add_generation_prompt: bool = False,
                default_system: str = DEFAULT_SYSTEM) -> DataFrame:
    """(conv, transcript) -- the chat template without a tool list."""
    w = Window.partitionBy(conv).orderBy(turn)
    r, c = F.col(role), F.col(content)
    d = msgs.select(conv, turn, role, content,
                    F.lag(role).over(w).alias("_prev"), F.lead(role).over(w).alias("_next"),
                    (F.row_number().over(w) == 1).alias("_first"))
    plain = (r == "user") | ((r == "system") & ~F.col("_first")) | (r == "assistant")
    tool_head = F.when(F.col("_prev").isNull() | (F.col("_prev") != "tool"), F.lit(TR.IM_START + "user"))\
        .otherwise(F.lit(""))
    tool_tail = F.when(F.col("_next").isNull() | (F.col("_next") != "tool"), F.lit(TR.IM_END + "\n"))\
        .otherwise(F.lit(""))
    piece = (F.when(plain, F.concat(F.lit(TR.IM_START), r, F.lit("\n"), c, F.lit(TR.IM_END + "\n")))
              .when(r == "tool", F.concat(tool_head, F.lit("\n" + TR.RESP_OPEN + "\n"), c,
                                          F.lit("\n" + TR.RESP_CLOSE), tool_tail))
              .otherwise(F.lit("")))
    d = d.select(conv, turn, role, content, piece.alias("_piece"))
    agg = d.groupBy(conv).agg(
        F.min_by(F.struct(F.col(role).alias("r"), F.col(content).alias("c")), F.col(turn)).alias("_h"),
        F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.col("_piece").alias("p")))).alias("_ps"))
    header = F.when(F.col("_h.r") == "system",
                    F.concat(F.lit(TR.IM_START + "system\n"), F.col("_h.c"), F.lit(TR.IM_END + "\n"))) \
        .otherwise(F.lit(TR.IM_START + "system\n" + default_system + TR.IM_END + "\n"))
    body = F.array_join(F.transform("_ps", lambda x: x["p"]), "")
    gen = F.lit(TR.IM_START + "assistant\n" if add_generation_prompt else "")
    return agg.select(conv, F.concat(header, body, gen).alias("transcript"))


def transcript_scores(df: DataFrame, key: str = "conv_id", transcript: str = "transcript",
                      golds: str = "golds") -> DataFrame:
    """Five-score QA bundle columns: score, em, sm, f1, format (SC-12..15).

    em/sm/f1 use the answer of the last assistant block; answer_score
    (the F1 inside the combined reward) also needs a non-empty answer tag.
    Answer-vs-gold statistics run as the token join of
    :func:`rlframe.operators.scoring.pair_scores`, so long answers cost
    O(tokens), not O(tokens^2).
    """
    from rlframe.operators.scoring import pair_scores

    d = (df.withColumn("_blocks", TR.assistant_blocks(transcript))
           .withColumn("_last", F.try_element_at(F.col("_blocks"), F.lit(-1)))
           .withColumn("_ans", TR.extract_answer("_last"))
           .withColumn("format", TR.format_score_from_blocks(F.col("_blocks"), F.col(transcript))))
    preds = d.where(F.col("_ans").isNotNull()).select(key, F.col("_ans").alias("pred"))
    gl = df.select(key, F.posexplode(golds).alias("gold_idx", "gold"))
    ps = pair_scores(preds, gl, [key], ["gold_idx"], [key], with_tfidf=False)
    best = ps.groupBy(key).agg(F.max("em").alias("_em"), F.max("sm_reward").alias("_sm"),
                               F.max("f1_reward").alias("_f1"))
    d = d.join(best, key, "left")
    t = F.col(transcript)
    nul = t.isNull() | F.col(golds).isNull()
    no_ans = nul | F.col("_ans").isNull()
    answer_score = F.when(F.size("_blocks") == 0, F.lit(0.0)) \
        .when(F.col("_ans").isNull() | (F.col("_ans") == ""), F.lit(0.0)) \
        .otherwise(F.coalesce(F.col("_f1"), F.lit(0.0)))
    d = d.withColumns({
        "answer_score": answer_score,
        "em": F.when(no_ans, F.lit(0.0)).otherwise(F.coalesce(F.col("_em"), F.lit(0.0))),
        "sm": F.when(no_ans, F.lit(0.0)).otherwise(F.coalesce(F.col("_sm"), F.lit(0.0))),
        "f1": F.when(no_ans, F.lit(0.0)).otherwise(F.coalesce(F.col("_f1"), F.lit(0.0))),
    })
    d = d.withColumn("score", F.when(nul, F.lit(0.0))
                     .otherwise(TR.combined_reward(F.col("format"), F.col("answer_score"), t)))
    return d.drop("_blocks", "_last", "_ans", "_em", "_sm", "_f1")


def score_bundle(df: DataFrame, key: str = "conv_id", source: str = "data_source",
                 transcript: str = "transcript", golds: str = "golds",
                 on_unknown: str = "null") -> DataFrame:
    """SC-16: route by data source. QA sources get the five scores; other
    sources are either NULL-scored with ``routed = false`` (``on_unknown=
    'null'``) or fail the job (``'error'``) as the reference raises."""
    d = transcript_scores(df, key, transcript, golds)
    known = F.col(source).isin(*QA_SOURCES)
    cols = ["score", "em", "sm", "f1", "format"]
    if on_unknown == "error":
        guard = F.when(~known, F.raise_error(F.concat(F.lit("no scorer for data source "), F.col(source))))
        d = d.withColumn("score", F.coalesce(guard.cast("double"), F.col("score")))
    else:
        d = d.withColumns({c: F.when(known, F.col(c)) for c in cols})
    return d.withColumn("routed", known)
