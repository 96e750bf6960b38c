"""Turn-loop and transcript-utility queries over logged conversation turns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rlframe.functions import transcript as TR
from rlframe.operators import transcripts as TO
from rlframe.operators import turns as T
from rlframe.plans.registry import query
from rlframe.sources import adapters as AD

MAX_TURNS, MAX_TOKENS, MAX_CONTEXT = 3, 256, 1024


def logged_turns(spark, sf_dir):
    """(conv_id, k, response, tool_response, prompt_chars): assistant turns
    in order, the following user message as the tool response, and the
    first user message's length as the starting prompt."""
    m = AD.wrapped_messages(spark, sf_dir)
    w = Window.partitionBy("conv_id").orderBy("turn")
    m = m.withColumn("_next", F.lead("content").over(w)).withColumn("_nrole", F.lead("role").over(w))
    a = m.where(F.col("role") == "assistant")
    a = a.withColumn("k", (F.row_number().over(w) - 1).cast("int"))
    return a.select("conv_id", "k", F.col("content").alias("response"),
                    F.when(F.col("_nrole") == "user", F.col("_next")).alias("tool_response"),
                    F.length(F.coalesce(F.col("first_user"), F.lit(""))).alias("prompt_chars"))


_LT = AD.sql_with(messages=AD.MESSAGES_SQL, wrapped=AD.WRAPPED_SQL) + """
, msgs AS (SELECT *, lead(content) OVER w AS nxt, lead(role) OVER w AS nrole
           FROM wrapped WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
, lt AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, content AS response,
                CASE WHEN nrole = 'user' THEN nxt END AS tool_response,
                length(coalesce(first_user, '')) AS prompt_chars
         FROM msgs WHERE role = 'assistant')
, bd AS (SELECT *, regexp_extract(response, '(?s)<interaction_prompt>(.*?)</interaction_prompt>', 1) AS body,
                regexp_matches(response, '(?s)<interaction_prompt>(.*?)</interaction_prompt>') AS has_block FROM lt)
, wr AS (SELECT *, CASE WHEN NOT has_block OR json_valid(trim(body)) THEN response
                   ELSE replace(response, '<interaction_prompt>' || body || '</interaction_prompt>',
                        '<interaction_prompt>' || chr(10) || '{"name": "prompt", "arguments": {"prompt": ' || to_json(trim(body))
                        || '}}' || chr(10) || '</interaction_prompt>') END AS wrapped_resp FROM bd)
, pc AS (SELECT *, CASE WHEN contains(wrapped_resp, '<interaction_prompt>') AND contains(wrapped_resp, '</interaction_prompt>')
                        THEN split_part(wrapped_resp, '</interaction_prompt>', 1) || '</interaction_prompt>'
                        ELSE wrapped_resp END || '<|im_end|>' AS processed FROM wr)
"""


@query("turn_loop_cut", _LT + f"""
, t AS (SELECT * FROM pc WHERE k < {MAX_TURNS})
, g AS (SELECT *, prompt_chars + coalesce(sum(length(processed) + coalesce(length(tool_response), 0)) OVER
                  (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t)
, f AS (SELECT *, floor(before / 4) + {MAX_TOKENS} > {MAX_CONTEXT} AS exceeded,
               regexp_matches(processed, '(?s)<interaction_prompt>(.*?)</interaction_prompt>') AS cont FROM g)
, s AS (SELECT *, exceeded OR NOT cont AS stop,
               CASE WHEN exceeded THEN 'Maximum context length exceeded'
                    WHEN regexp_matches(processed, '(?s)<answer>(.*?)</answer>')
                      THEN regexp_replace(regexp_extract(processed, '(?s)<answer>(.*?)</answer>', 1), '^\\s+|\\s+$', '', 'g')
                    ELSE '' END AS ans FROM f)
, r AS (SELECT conv_id, count(*) AS n, min(k) FILTER (WHERE stop) AS sk,
               arg_min(ans, k) FILTER (WHERE stop) AS sa, arg_min(exceeded, k) FILTER (WHERE stop) AS sx FROM s GROUP BY conv_id)
SELECT conv_id, coalesce(sa, 'Maximum turns reached without final answer') AS final_answer,
       CAST(coalesce(sk + 1, n) AS INTEGER) AS turns_used,
       CASE WHEN sx THEN 'context' WHEN sk IS NOT NULL THEN 'answer' ELSE 'max_turns' END AS stop_reason
FROM r
""")
def turn_loop_cut(spark, sf_dir):
    lt = logged_turns(spark, sf_dir)
    return T.run_turns(lt, "conv_id", "k", "response", "tool_response", "prompt_chars",
                       MAX_TURNS, MAX_TOKENS, MAX_CONTEXT)


@query("process_calls", _LT + """
SELECT conv_id, CAST(k AS INTEGER) AS k, processed, contains(wrapped_resp, '<interaction_prompt>') AS has_call FROM pc
""")
def process_calls(spark, sf_dir):
    lt = logged_turns(spark, sf_dir)
    p = lt.select("conv_id", "k", T.process_call("response").alias("p"))
    return p.select("conv_id", "k", F.col("p.processed").alias("processed"), F.col("p.has_call").alias("has_call"))


@query("history_prefix", _LT + """
, hp AS (SELECT conv_id, k, tool_response, coalesce(list_filter(list_transform(
                regexp_extract_all(response, '(?s)<interaction_prompt>(.*?)</interaction_prompt>', 1),
                lambda b: CASE WHEN json_valid(b) THEN json_extract_string(b, '$.arguments.prompt') END),
                lambda p: p IS NOT NULL)[1], '') AS call_prompt FROM lt)
SELECT conv_id, CAST(k AS INTEGER) AS k, call_prompt,
       CAST(2 * coalesce(sum(CAST(call_prompt <> '' AS INTEGER)) OVER w, 0) AS BIGINT) AS n_history,
       CAST(2 + 2 * coalesce(sum(CAST(call_prompt <> '' AS INTEGER)) OVER w, 0) AS BIGINT) AS n_request,
       coalesce(json_extract_string(CASE WHEN regexp_matches(tool_response, '(?s)<interaction_response>(.*?)</interaction_response>')
                  THEN trim(regexp_extract(tool_response, '(?s)<interaction_response>(.*?)</interaction_response>', 1)) END, '$.results[0]'),
                CASE WHEN json_valid(tool_response) THEN json_extract_string(tool_response, '$.results[0]') END, '') AS tool_result
FROM hp WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def history_prefix(spark, sf_dir):
    lt = logged_turns(spark, sf_dir)
    h = T.history(lt, "conv_id", "k", "response", "tool_response")
    return h.select("conv_id", "k", "call_prompt", F.col("n_history").cast("bigint"),
                    F.col("n_request").cast("bigint"), "tool_result")


@query("tool_response_format", """
SELECT conv_id, turn, '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) ||
       array_to_string(list_transform(string_split(text, chr(10)), lambda r: '<interaction_response>' || chr(10) ||
           CASE WHEN length(r) > 100 THEN substr(r, 1, 100) || '...' ELSE r END || chr(10) || '</interaction_response>'), chr(10))
       || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || '<think>' || chr(10) AS formatted
FROM conversations WHERE role = 'user'
""")
def tool_response_format(spark, sf_dir):
    m = AD.messages(spark, sf_dir).where(F.col("role") == "user")
    return m.select("conv_id", F.col("turn").cast("bigint").alias("turn"),
                    TR.format_tool_responses(F.split("content", "\n", -1), 100).alias("formatted"))


@query("cut_at_pad", AD.sql_with(messages=AD.MESSAGES_SQL, wrapped=AD.WRAPPED_SQL, tr=AD.RENDER_SQL) + """
, p AS (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN transcript || '<|endoftext|><|endoftext|>junk' ELSE transcript END AS t FROM tr)
, c AS (SELECT conv_id, split_part(t, '<|endoftext|>', 1) AS cut FROM p)
SELECT conv_id, CASE WHEN ends_with(cut, '<|im_end|>') THEN cut ELSE cut || '<|im_end|>' END AS cleaned FROM c
""")
def cut_at_pad(spark, sf_dir):
    t = TO.render_chat(AD.wrapped_messages(spark, sf_dir))
    p = t.select("conv_id", F.when(F.pmod("conv_id", F.lit(2)) == 0,
                                   F.concat("transcript", F.lit("<|endoftext|><|endoftext|>junk")))
                 .otherwise(F.col("transcript")).alias("t"))
    return p.select("conv_id", TR.cut_at(F.col("t"), "<|endoftext|>", "<|im_end|>").alias("cleaned"))


# two blocks, the second with every line of the text; odd documents leave it
# open, every third has no block at all. The rule is folded over the lines.
@query("fenced_code", r"""
WITH RECURSIVE src AS (
  SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text
    WHEN doc_id % 2 = 0 THEN concat('Here:', chr(10), '```python', chr(10), 'x = ', doc_id, chr(10), '```', chr(10), 'then', chr(10), '```python', chr(10), text, chr(10), '```', chr(10), 'done')
    ELSE concat('```python', chr(10), 'y', chr(10), '```', chr(10), '```python', chr(10), text) END AS t
  FROM documents),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM src),
mk AS (SELECT *, CASE WHEN starts_with(l, '```python') OR ends_with(l, '```python') THEN 1 WHEN starts_with(l, '```') THEN 0 END AS m FROM ln),
st AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), 0) AS on_ FROM mk),
r AS (SELECT doc_id, string_agg(CASE WHEN m = 1 THEN chr(10) || '# ========' || chr(10) WHEN m IS NULL AND on_ = 1 THEN l || chr(10) ELSE '' END, '' ORDER BY i) AS code,
        max(m) AS any_, arg_max(on_, i) AS open_ FROM st GROUP BY doc_id)
SELECT doc_id, CASE WHEN any_ = 1 AND open_ = 0 THEN code END AS code FROM r
""")
def fenced_code(spark, sf_dir):
    from rlframe.sources.tables import table
    d = table(spark, sf_dir, "documents")
    two = F.concat(F.lit("Here:\n```python\nx = "), F.col("doc_id").cast("string"), F.lit("\n```\nthen\n```python\n"),
                   F.col("text"), F.lit("\n```\ndone"))
    left_open = F.concat(F.lit("```python\ny\n```\n```python\n"), F.col("text"))
    src = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.col("text")).when(F.pmod("doc_id", F.lit(2)) == 0, two).otherwise(left_open)
    return d.select("doc_id", src.alias("t")).select("doc_id", T.fenced_code("t").alias("code"))
