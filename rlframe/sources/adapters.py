"""Adapters: the driver's generic tables -> the engine's table shapes.

Each adapter exists twice: as a DataFrame builder (used by our queries)
and as a SQL view body (used by the DuckDB oracle). Both must define the
same rows; tests compare them.

Samples and tokens are numbered inside their key with
:func:`rlframe.operators.batch.rank_within` (a global range sort plus per-key
offsets), so even a key holding a large share of the table is never
numbered by a single task. Real rollout/token tables already carry
``sample_idx``/``pos``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rlframe.sources.tables import table


# ---------------------------------------------------------------- rollouts
def rollouts(spark: SparkSession, sf_dir: str, numbered: bool = True) -> DataFrame:
    """rollout_row from lineitem: one row per sampled response.

    Without ``numbered`` there is no sample_idx, and no sort for it."""
    from rlframe.operators.batch import rank_within
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_discount", "l_quantity", "l_linestatus")
    if numbered:
        li = rank_within(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "_sidx")
    out = li if numbered else li.withColumn("_sidx", F.lit(None).cast("int"))
    out = out.select(
        F.col("l_returnflag").alias("data_source"),
        F.col("l_orderkey").alias("uid"),
        F.col("_sidx").alias("sample_idx"),
        F.concat(F.lit("p"), F.col("l_orderkey").cast("string")).alias("prompt"),
        F.col("l_discount").alias("score"),
        F.when(F.col("l_quantity") > 25, 1.0).otherwise(0.0).alias("acc"),
        F.col("l_linestatus").alias("pred"),
        (F.col("l_linenumber") * 10).cast("int").alias("prompt_len"),
        F.col("l_quantity").cast("int").alias("response_len"),
        (F.pmod(F.col("l_partkey"), F.lit(4)) + 1).cast("int").alias("turns"),
    )
    return out if numbered else out.drop("sample_idx")


ROLLOUTS_SQL = """
SELECT l_returnflag AS data_source,
       l_orderkey AS uid,
       CAST(row_number() OVER (PARTITION BY l_orderkey
            ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INTEGER) AS sample_idx,
       'p' || CAST(l_orderkey AS VARCHAR) AS prompt,
       l_discount AS score,
       CAST(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS acc,
       l_linestatus AS pred,
       CAST(l_linenumber * 10 AS INTEGER) AS prompt_len,
       CAST(l_quantity AS INTEGER) AS response_len,
       CAST(l_partkey % 4 + 1 AS INTEGER) AS turns
FROM lineitem
"""


# ------------------------------------------------------------------ tokens
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """token_row from events: one sequence per user, one token per event."""
    from rlframe.operators.batch import rank_within
    source = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", "event_type")
    ev = rank_within(source, ["user_id"], ["ts", "event_id"], "_pos")
    return ev.select(
        F.col("user_id").alias("uid"),
        F.pmod(F.col("user_id"), F.lit(16)).alias("grp"),
        F.col("_pos").alias("pos"),
        (F.col("value") / 100.0).alias("reward"),
        ((F.pmod(F.col("event_id"), F.lit(53)) + 1) / 100.0).alias("value"),
        (-((F.pmod(F.col("event_id"), F.lit(97)) + 1) / 100.0)).alias("old_logp"),
        (-F.col("value") / 100.0).alias("logp"),
        (-((F.pmod(F.col("event_id"), F.lit(89)) + 1) / 100.0)).alias("ref_logp"),
        (F.col("event_type") != "error").cast("int").alias("mask"),
    )


TOKENS_SQL = """
SELECT user_id AS uid,
       user_id % 16 AS grp,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS pos,
       value / 100.0 AS reward,
       (event_id % 53 + 1) / 100.0 AS value,
       -((event_id % 97 + 1) / 100.0) AS old_logp,
       -value / 100.0 AS logp,
       -((event_id % 89 + 1) / 100.0) AS ref_logp,
       CAST(event_type <> 'error' AS INTEGER) AS mask
FROM events
"""


# ---------------------------------------------------------------- messages
def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """message_row from conversations."""
    cv = table(spark, sf_dir, "conversations")
    return cv.select(
        "conv_id",
        F.col("turn").cast("int").alias("turn"),
        "role",
        F.col("text").alias("content"),
    )


MESSAGES_SQL = """
SELECT conv_id, CAST(turn AS INTEGER) AS turn, role, text AS content FROM conversations
"""


def sql_with(**views: str) -> str:
    """``WITH name AS (body), ...`` prefix for oracle SQL."""
    return "WITH " + ",\n".join(f"{k} AS ({v})" for k, v in views.items()) + "\n"


# ------------------------------------------------------------- predictions
def prediction_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(predictions, golds) from documents.

    predictions: one per document ``(data_id, dataset, pred)`` with the
    whole text as the predicted answer. golds: per dataset (= source) the
    whole texts of its three lowest ``doc_id`` as ``(dataset, gold_idx, gold)``,
    shared by every prediction of that dataset. The three lowest ids come
    from three partial ``min`` aggregates, so a huge source never lands in
    one task.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    ids = docs.select("doc_id", "source")
    found = []
    rest = ids
    for i in range(3):
        m = rest.groupBy("source").agg(F.min("doc_id").alias("gold_doc"))
        found.append(m.select("source", F.lit(i).alias("gold_idx"), "gold_doc"))
        if i < 2:
            rest = rest.join(m, "source").where(F.col("doc_id") > F.col("gold_doc")).drop("gold_doc")
    gold_ids = found[0].unionByName(found[1]).unionByName(found[2])
    golds = gold_ids.join(docs.select(F.col("doc_id").alias("gold_doc"), F.col("text").alias("gold")),
                          "gold_doc").select(F.col("source").alias("dataset"), "gold_idx", "gold")
    preds = docs.select(F.col("doc_id").alias("data_id"), F.col("source").alias("dataset"),
                        F.col("text").alias("pred"))
    return preds, golds


PREDS_SQL = "SELECT doc_id AS data_id, source AS dataset, text AS pred FROM documents"
GOLDS_SQL = """
SELECT source AS dataset, CAST(rk - 1 AS INTEGER) AS gold_idx, text AS gold
FROM (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rk FROM documents)
WHERE rk <= 3
"""


# ------------------------------------------------------------- transcripts
def wrapped_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with assistant turns rewritten into the agent's tag format.

    Non-final assistant turns become ``<think>text</think>`` + a call block
    (a JSON call on even turns, plain text on odd ones); the final one
    becomes think + answer. ``conv_id % 5`` selects broken variants so every
    format-score branch is hit: 0 = missing ``</think>`` in calls,
    1 = answer without think, 2 = no answer, 3 = blank answer. The answer is
    the first user message when ``conv_id % 4 = 0`` (so it matches a gold),
    else the assistant's own text. Per-conversation facts come from a
    grouped aggregate joined back on ``conv_id``.
    """
    m = messages(spark, sf_dir)
    facts = m.groupBy("conv_id").agg(
        F.max(F.when(F.col("role") == "assistant", F.col("turn"))).alias("last_asst"),
        F.min_by(F.when(F.col("role") == "user", F.col("content")),
                 F.when(F.col("role") == "user", F.col("turn"))).alias("first_user"))
    d = m.join(facts, "conv_id")
    k = F.pmod(F.col("conv_id"), F.lit(5))
    c = F.col("content")
    call = F.concat(
        F.lit("\n<interaction_prompt>"),
        F.when(F.pmod(F.col("turn"), F.lit(2)) == 0,
               F.concat(F.lit('{"name": "prompt", "arguments": {"prompt": "c'), F.col("conv_id").cast("string"),
                        F.lit("t"), F.col("turn").cast("string"), F.lit('"}}')))
         .otherwise(F.concat(F.lit("plain request "), F.col("turn").cast("string"))),
        F.lit("</interaction_prompt>"))
    mid = F.concat(F.lit("<think>"), c, F.when(k == 0, F.lit("")).otherwise(F.lit("</think>")), call)
    ans = F.when(F.pmod(F.col("conv_id"), F.lit(4)) == 0, F.coalesce(F.col("first_user"), F.lit(""))).otherwise(c)
    final = (F.when(k == 1, F.concat(F.lit("<answer>"), ans, F.lit("</answer>")))
              .when(k == 2, F.concat(F.lit("<think>"), c, F.lit("</think>")))
              .when(k == 3, F.concat(F.lit("<think>"), c, F.lit("</think>\n<answer> </answer>")))
              .otherwise(F.concat(F.lit("<think>"), c, F.lit("</think>\n<answer>"), ans, F.lit("</answer>"))))
    content = (F.when(F.col("role") != "assistant", c)
                .when(F.col("turn") < F.col("last_asst"), mid)
                .otherwise(final))
    return d.select("conv_id", "turn", "role", content.alias("content"), "first_user")


# Fixed value list used to spread conversations over scorer routes.
TRANSCRIPT_SOURCES = ("hotpotqa/hotpot_qa", "bdsaglam/musique", "xanhho/2WikiMultihopQA", "openai/gsm8k")


def conv_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, data_source, golds) per conversation."""
    m = messages(spark, sf_dir)
    f = m.groupBy("conv_id").agg(
        F.min_by(F.when(F.col("role") == "user", F.col("content")),
                 F.when(F.col("role") == "user", F.col("turn"))).alias("first_user"))
    src = F.element_at(F.array(*[F.lit(s) for s in TRANSCRIPT_SOURCES]),
                       (F.pmod(F.col("conv_id"), F.lit(len(TRANSCRIPT_SOURCES))) + 1).cast("int"))
    golds = F.array(F.coalesce(F.col("first_user"), F.lit("")),
                    F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    return f.select("conv_id", src.alias("data_source"), golds.alias("golds"))


WRAPPED_SQL = """
SELECT m.conv_id, m.turn, m.role, f.first_user,
  CASE WHEN m.role <> 'assistant' THEN m.content
       WHEN m.turn < f.last_asst THEN
         '<think>' || m.content || CASE WHEN m.conv_id % 5 = 0 THEN '' ELSE '</think>' END ||
         chr(10) || '<interaction_prompt>' ||
         CASE WHEN m.turn % 2 = 0 THEN '{"name": "prompt", "arguments": {"prompt": "c' || CAST(m.conv_id AS VARCHAR)
                   || 't' || CAST(m.turn AS VARCHAR) || '"}}'
              ELSE 'plain request ' || CAST(m.turn AS VARCHAR) END || '</interaction_prompt>'
       ELSE CASE m.conv_id % 5
              WHEN 1 THEN '<answer>' || CASE WHEN m.conv_id % 4 = 0 THEN coalesce(f.first_user, '') ELSE m.content END || '</answer>'
              WHEN 2 THEN '<think>' || m.content || '</think>'
              WHEN 3 THEN '<think>' || m.content || '</think>' || chr(10) || '<answer> </answer>'
              ELSE '<think>' || m.content || '</think>' || chr(10) || '<answer>'
                   || CASE WHEN m.conv_id % 4 = 0 THEN coalesce(f.first_user, '') ELSE m.content END || '</answer>'
            END
  END AS content
FROM messages m JOIN (
  SELECT conv_id, max(CASE WHEN role = 'assistant' THEN turn END) AS last_asst,
         arg_min(content, turn) FILTER (WHERE role = 'user') AS first_user
  FROM messages GROUP BY conv_id) f USING (conv_id)
"""

RENDER_SQL = """
SELECT conv_id,
  CASE WHEN arg_min(role, turn) = 'system'
       THEN '<|im_start|>system' || chr(10) || arg_min(content, turn) || '<|im_end|>' || chr(10)
       ELSE '<|im_start|>system' || chr(10) || 'You are Qwen, created by Alibaba Cloud. You are a helpful assistant.<|im_end|>' || chr(10)
  END || coalesce(string_agg(piece, '' ORDER BY turn), '') AS transcript
FROM (
  SELECT conv_id, turn, role, content,
    CASE WHEN role = 'user' OR (role = 'system' AND rn > 1) OR role = 'assistant'
           THEN '<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10)
         WHEN role = 'tool'
           THEN CASE WHEN prev IS NULL OR prev <> 'tool' THEN '<|im_start|>user' ELSE '' END
                || chr(10) || '<interaction_response>' || chr(10) || content || chr(10) || '</interaction_response>'
                || CASE WHEN nxt IS NULL OR nxt <> 'tool' THEN '<|im_end|>' || chr(10) ELSE '' END
         ELSE '' END AS piece
  FROM (SELECT *, lag(role) OVER w AS prev, lead(role) OVER w AS nxt, row_number() OVER w AS rn
        FROM wrapped WINDOW w AS (PARTITION BY conv_id ORDER BY turn)))
GROUP BY conv_id
"""

CONV_FACTS_SQL = """
SELECT conv_id,
  ['hotpotqa/hotpot_qa', 'bdsaglam/musique', 'xanhho/2WikiMultihopQA', 'openai/gsm8k'][conv_id % 4 + 1] AS data_source,
  [coalesce(arg_min(content, turn) FILTER (WHERE role = 'user'), ''), 'c' || CAST(conv_id AS VARCHAR)] AS golds
FROM messages GROUP BY conv_id
"""
