"""Tool-call, routing, span, placement, log-metric and balancing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rlframe.functions import transcript as TR
from rlframe.operators import metrics as ME
from rlframe.operators import tools as TL
from rlframe.plans import q_turns as QT
from rlframe.plans.registry import R6, query, r6
from rlframe.sources import adapters as AD
from rlframe.sources.tables import table


@query("call_status", QT._LT + """
, c AS (SELECT conv_id, k, unnest(regexp_extract_all(response, '(?s)<interaction_prompt>(.*?)</interaction_prompt>', 1)) AS body,
               generate_subscripts(regexp_extract_all(response, '(?s)<interaction_prompt>(.*?)</interaction_prompt>', 1), 1) - 1 AS call_idx
        FROM lt)
SELECT conv_id, CAST(k AS INTEGER) AS k, CAST(call_idx AS INTEGER) AS call_idx,
       CASE WHEN NOT json_valid(body) THEN 'Error: JSONDecodeError'
            WHEN NOT list_contains(json_keys(body), 'name') THEN 'Error: No tool name'
            WHEN NOT list_contains(json_keys(body), 'arguments') THEN 'Error: No tool arguments'
            WHEN json_extract_string(body, '$.name') <> 'prompt' THEN 'Error: ToolNotFoundError'
            WHEN NOT list_contains(json_keys(json_extract(body, '$.arguments')), 'prompt') THEN 'Error: Invalid tool arguments'
            ELSE 'ok' END AS status
FROM c
""")
def call_status(spark, sf_dir):
    lt = QT.logged_turns(spark, sf_dir)
    calls = lt.select("conv_id", "k", F.posexplode(TR.call_bodies("response")).alias("call_idx", "body"))
    registry = spark.createDataFrame([("prompt", ["prompt"])], "tool_name string, required array<string>")
    st = TL.call_status(calls, "body", registry)
    return st.select("conv_id", "k", F.col("call_idx").cast("int"), "status")


@query("code_blocks", """
SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_blocks,
       CASE WHEN doc_id % 3 = 0 THEN CAST(length(chr(10) || '# ========' || chr(10) || text || chr(10)) AS BIGINT)
            ELSE CAST(0 AS BIGINT) END AS code_len
FROM documents
""")
def code_blocks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.pmod("doc_id", F.lit(3))
    src = (F.when(k == 0, F.concat(F.lit("<code>\n"), F.col("text"), F.lit("\n</code>")))
            .when(k == 1, F.concat(F.lit("<code>\n"), F.col("text"))).otherwise(F.col("text")))
    b = d.select("doc_id", TL.code_blocks(src).alias("b"))
    return b.select("doc_id", F.size("b").cast("bigint").alias("n_blocks"),
                    F.coalesce(F.length(F.try_element_at("b", F.lit(1))), F.lit(0)).cast("bigint").alias("code_len"))


_SOURCES = ["openai/gsm8k", "lighteval/MATH", "aime2024", "hiyouga/geometry3k", "codeforces"]


@query("routed_score", f"""
WITH s AS (SELECT o_orderkey, o_orderkey % 5 AS k, CAST(o_orderkey % 97 AS VARCHAR) AS v,
                  o_custkey % 2 = 0 AS right_gt FROM orders)
SELECT o_orderkey, {_SOURCES!r}[k + 1] AS data_source,
       round(CAST(CASE k WHEN 0 THEN CASE WHEN right_gt THEN 1.0 ELSE 0.0 END
              WHEN 1 THEN CASE WHEN right_gt THEN 1.0 ELSE 0.0 END
              WHEN 2 THEN CASE WHEN right_gt THEN 1.0 ELSE -1.0 END
              WHEN 3 THEN CASE WHEN right_gt THEN 1.0 ELSE 0.1 END
              ELSE NULL END AS DOUBLE), 6) AS score
FROM s
""")
def routed_score(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.pmod("o_orderkey", F.lit(5))
    v = F.pmod("o_orderkey", F.lit(97)).cast("string")
    gt = F.when(F.pmod("o_custkey", F.lit(2)) == 0, v).otherwise(F.concat(v, F.lit("1")))
    src = F.element_at(F.array(*[F.lit(x) for x in _SOURCES]), (k + 1).cast("int"))
    sol = (F.when(k == 0, F.concat(F.lit("so #### "), v))
            .when(k == 1, F.concat(F.lit("thus \\boxed{"), v, F.lit("}")))
            .when(k == 2, F.concat(F.lit("work\nAnswer: "), v))
            .when(k == 3, F.concat(F.lit("<think>t</think> so \\boxed{"), v, F.lit("}")))
            .otherwise(F.lit("def f(): pass")))
    d = o.select("o_orderkey", src.alias("data_source"), sol.alias("solution"), gt.alias("gt"))
    return d.select("o_orderkey", "data_source", r6(TL.routed_score("data_source", "solution", "gt")).alias("score"))


@query("loss_mask_spans", AD.sql_with(messages=AD.MESSAGES_SQL) + """
, r AS (SELECT conv_id, turn, role, length('<|im_start|>' || role || chr(10) || content || '<|im_end|>' || chr(10)) AS len FROM messages)
, c AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM r)
SELECT conv_id, turn, CAST(start AS BIGINT) AS start, CAST(start + len AS BIGINT) AS "end" FROM c WHERE role = 'assistant'
""")
def loss_mask_spans(spark, sf_dir):
    m = AD.messages(spark, sf_dir)
    rendered = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), F.col("content"), F.lit("<|im_end|>\n"))
    sp = TL.loss_mask_spans(m.withColumn("rendered", rendered), "conv_id", "turn", "role", "rendered")
    return sp.select("conv_id", F.col("turn").cast("int"), F.col("start").cast("bigint"), F.col("end").cast("bigint"))


@query("process_reward_placement", AD.sql_with(messages=AD.MESSAGES_SQL, wrapped=AD.WRAPPED_SQL) + """
, resp AS (SELECT conv_id, string_agg(content, '' ORDER BY turn) AS t FROM wrapped WHERE role = 'assistant' GROUP BY conv_id)
, pcs AS (SELECT conv_id, floor(length(t) / 4) AS vl, p, i FROM resp,
                 unnest(string_split(t, '</interaction_prompt>')) WITH ORDINALITY AS u(p, i))
, np AS (SELECT conv_id, count(*) AS n FROM pcs GROUP BY conv_id)
, e AS (SELECT pcs.conv_id, vl, i - 1 AS call_idx,
               sum(length(p) + 21) OVER (PARTITION BY pcs.conv_id ORDER BY i) AS endc
        FROM pcs JOIN np USING (conv_id) WHERE i < np.n)
, rw AS (SELECT conv_id, call_idx, ((conv_id % 3) - 1) * 0.1 * (call_idx + 1) AS reward FROM e)
, pl AS (SELECT e.conv_id, CAST(floor(endc / 4) - 1 AS BIGINT) AS pos, rw.reward FROM e JOIN rw USING (conv_id, call_idx)
         WHERE floor(endc / 4) - 1 < vl)
, rc AS (SELECT *, sum(reward) OVER (PARTITION BY conv_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS c FROM pl)
SELECT conv_id, pos, round(CAST(reward / ((SELECT max(abs(c)) FROM rc) + 1e-6) AS DOUBLE) + 4.656612873077393e-10, 6) + 0.0 AS reward FROM rc
""")
def process_reward_placement(spark, sf_dir):
    m = AD.wrapped_messages(spark, sf_dir).where(F.col("role") == "assistant")
    resp = m.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("turn", "content"))), lambda x: x["content"]), "").alias("t"))
    resp = resp.withColumn("vl", F.floor(F.length("t") / 4))
    n_calls = resp.select("conv_id", (F.size(F.split("t", "</interaction_prompt>", -1)) - 1).alias("n"))
    rewards = n_calls.where("n > 0").select("conv_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("call_idx")) \
        .withColumn("reward", (F.pmod("conv_id", F.lit(3)) - 1) * 0.1 * (F.col("call_idx") + 1))
    out = TL.place_process_rewards(resp, "conv_id", "t", "vl", rewards)
    return out.select("conv_id", F.col("pos").cast("bigint"), r6("reward").alias("reward"))


_LOG = """
WITH m AS (SELECT CAST(dayofyear(ts) AS BIGINT) AS step, avg(value) / 100.0 AS rmean, max(value) / 100.0 AS smax,
                  avg(length(props)) AS rlen FROM events GROUP BY 1)
, l AS (SELECT step, 'step:' || step || ' - critic/rewards/mean:' || printf('%.3f', rmean) || ' - critic/score/max:' ||
               printf('%.3f', smax) || ' - response_length/mean:' || printf('%.3f', rlen) AS line FROM m)
"""


def _log_long(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = e.groupBy(F.dayofyear("ts").cast("bigint").alias("step")).agg(
        (F.avg("value") / 100.0).alias("critic/rewards/mean"), (F.max("value") / 100.0).alias("critic/score/max"),
        F.avg(F.length("props")).alias("response_length/mean"))
    names = ["critic/rewards/mean", "critic/score/max", "response_length/mean"]
    st = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value"))
                             for i, n in enumerate(names)]))
    return m.select("step", st.alias("s")).select("step", "s.*")


@query("metric_lines", _LOG + "SELECT step, line FROM l")
def metric_lines(spark, sf_dir):
    return ME.metrics_line(_log_long(spark, sf_dir))


@query("metric_log_best", _LOG + f"""
SELECT {R6("max(CAST(regexp_extract(line, 'critic/rewards/mean:([^ ]+)', 1) AS DOUBLE))")} AS best FROM l
""")
def metric_log_best(spark, sf_dir):
    lines = ME.metrics_line(_log_long(spark, sf_dir)).select(F.col("line").alias("value"))
    return ME.best_from_log(lines).select(r6("best").alias("best"))


@query("greedy_assign", """
WITH RECURSIVE items AS (
  SELECT CAST(floor(l_orderkey / 100) AS BIGINT) AS shard, CAST(l_quantity AS INTEGER) AS len,
         row_number() OVER (PARTITION BY floor(l_orderkey / 100)
                            ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS i
  FROM lineitem)
, r AS (
  SELECT shard, CAST(0 AS BIGINT) AS i, [0, 0, 0, 0] AS loads, CAST(NULL AS INTEGER) AS bucket, CAST(NULL AS INTEGER) AS len
  FROM (SELECT DISTINCT shard FROM items)
  UNION ALL
  SELECT r.shard, r.i + 1,
         list_transform(range(4), lambda b: r.loads[b + 1] +
             CASE WHEN b = list_position(r.loads, list_min(r.loads)) - 1 THEN it.len ELSE 0 END),
         CAST(list_position(r.loads, list_min(r.loads)) - 1 AS INTEGER), it.len
  FROM r JOIN items it ON it.shard = r.shard AND it.i = r.i + 1)
SELECT shard, bucket, count(*) AS n, CAST(sum(len) AS BIGINT) AS total FROM r WHERE bucket IS NOT NULL GROUP BY ALL
""")
def greedy_assign(spark, sf_dir):
    """Arrival-order least-loaded assignment, sequential per shard. A shard
    is 100 consecutive orders -- a fixed-size batch, so a pandas group stays
    the same size however large the table grows."""
    li = table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 100).cast("bigint").alias("shard"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").cast("int").alias("len"))
    a = TL.greedy_assign(li, "shard", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "len", 4)
    return a.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("len").cast("bigint").alias("total"))


def _schema_json(conv_id, k):
    name = F.concat(F.lit('"tool_'), conv_id.cast("string"), F.lit('"'))
    props = '{"q": {"type": "string"}, "n": {"type": "integer"}}'
    return (F.when(k == 0, F.concat(F.lit('{"name": '), name, F.lit(', "description": "d", "parameters": {"type": "object", "properties": '), F.lit(props), F.lit(', "required": ["q"]}}')))
             .when(k == 1, F.concat(F.lit('{"name": '), name, F.lit(', "parameters": {"type": "object", "properties": '), F.lit(props), F.lit(', "required": ["q"]}}')))
             .when(k == 2, F.concat(F.lit('{"name": " ", "description": "d", "parameters": {"type": "object", "properties": '), F.lit(props), F.lit(', "required": []}}')))
             .when(k == 3, F.concat(F.lit('{"name": '), name, F.lit(', "description": "d", "parameters": {"type": "object", "properties": '), F.lit(props), F.lit(', "required": ["q", "z"]}}')))
             .when(k == 4, F.concat(F.lit('{"name": '), name, F.lit(', "description": "d", "parameters": {"type": "array", "properties": '), F.lit(props), F.lit(', "required": ["n"]}}')))
             .otherwise(F.lit("not json")))


@query("tool_schema_valid", """
SELECT conv_id, conv_id % 6 = 0 AS valid FROM (SELECT DISTINCT conv_id FROM conversations)
""")
def tool_schema_valid(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    k = F.pmod("conv_id", F.lit(6))
    return c.select("conv_id", TL.tool_schema_valid(_schema_json(F.col("conv_id"), k)).alias("valid"))
