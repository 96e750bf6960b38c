"""Remaining builders, scorers and metric helpers as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rlframe.functions import mathans as M
from rlframe.operators import batch as B
from rlframe.operators import losses as L
from rlframe.operators import metrics as ME
from rlframe.operators import prepare as P
from rlframe.plans import q_prepare as QP
from rlframe.plans.registry import R6, query, r6
from rlframe.sources import adapters as AD
from rlframe.sources.tables import table

SYS = "You are a math expert."


@query("tool_rows", f"""
SELECT o_orderkey, CAST(2 AS BIGINT) AS n_messages, 'system' AS first_role, '{SYS}' AS system,
       true AS need_tools_kwargs,
       '{{"create_kwargs":{{"ground_truth":"' || CAST(o_orderkey * 7 + o_custkey AS VARCHAR) || '"}}}}' AS tools_kwargs
FROM orders WHERE o_orderkey % 3 <> 0
""")
def tool_rows(spark, sf_dir):
    num = P.numeric_rows(QP._num_raw(spark, sf_dir), "question", "answer", "o_orderkey", "train",
                         "openai/gsm8k", QP.NUM_INSTR, on_missing="drop", keep=("o_orderkey",))
    t = P.tool_rows(num.drop("o_orderkey").withColumn("o_orderkey", F.col("extra_info.index")), SYS)
    return t.select(F.col("extra_info.index").alias("o_orderkey"), F.size("prompt").cast("bigint").alias("n_messages"),
                    F.col("prompt")[0]["role"].alias("first_role"), F.col("prompt")[0]["content"].alias("system"),
                    F.col("extra_info.need_tools_kwargs").alias("need_tools_kwargs"),
                    F.col("extra_info.tools_kwargs")["calc_gsm8k_reward"].alias("tools_kwargs"))


@query("boxed_rows", """
SELECT o_orderkey, 'lighteval/MATH' AS data_source,
       'Order ' || CAST(o_orderkey AS VARCHAR) || '? Box it.' AS content,
       CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST(o_orderkey % 89 AS VARCHAR) END AS ground_truth
FROM orders
""")
def boxed_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    sol = F.when(F.pmod("o_orderkey", F.lit(4)) == 3, F.lit("no final box"))\
        .otherwise(F.concat(F.lit("We see \\boxed{1} then \\boxed{"), F.pmod("o_orderkey", F.lit(89)).cast("string"),
                            F.lit("}.")))
    src = o.select("o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit("?")).alias("problem"),
                   sol.alias("solution"))
    r = P.boxed_rows(src, "problem", "solution", "lighteval/MATH", "Box it.", "test", "o_orderkey", keep=("o_orderkey",))
    return r.select("o_orderkey", "data_source", F.col("prompt")[0]["content"].alias("content"),
                    F.col("reward_model.ground_truth").alias("ground_truth"))


@query("code_rows", """
WITH c AS (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS d, o_custkey % 3 AS k FROM orders)
SELECT o_orderkey, CAST(1 + k AS BIGINT) AS n_tests FROM c
WHERE d >= '1995-01-01T00:00:00' AND d < '1996-00-00T00:00:00'
""")
def code_rows(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    k = F.pmod("o_custkey", F.lit(3))
    pub = F.concat(F.lit('[{"input": "'), F.col("o_orderkey").cast("string"), F.lit('", "output": "1"}]'))
    priv = F.when(k == 0, F.lit("[]")).when(k == 1, F.lit('[{"input": "x", "output": "y"}]'))\
        .otherwise(F.lit('[{"input": "x", "output": "y"}, {"input": "z", "output": "w"}]'))
    src = o.select("o_orderkey", pub.alias("pub"), priv.alias("priv"),
                   F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("contest_date"))
    r = P.code_rows(src, "pub", "priv", "contest_date", "1995-01-01T00:00:00", "1996-00-00T00:00:00")
    return r.select("o_orderkey", F.size(F.from_json("tests", "inputs array<string>, outputs array<string>")["inputs"])
                    .cast("bigint").alias("n_tests"))


@query("seeded_order", """
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':5:0'), o_orderkey) - 1 AS BIGINT) AS "order"
FROM orders
""")
def seeded_order(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    return P.seeded_order(o, ["o_orderkey"], 5).select("o_orderkey", F.col("order").cast("bigint"))


@query("timing_metrics", AD.sql_with(tokens=AD.TOKENS_SQL) + f"""
, t AS (SELECT event_type AS name, sum(value) / 1000.0 AS seconds FROM events GROUP BY 1)
, n AS (SELECT sum(CASE WHEN mask = 0 THEN 1 ELSE 0 END) AS np, sum(mask) AS nr FROM tokens)
SELECT name, {R6('seconds')} AS seconds,
       {R6("seconds * 1000 / CASE WHEN name = 'gen' THEN nr ELSE np + nr END")} AS per_token_ms
FROM t, n
""")
def timing_metrics(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    t = ev.groupBy(F.col("event_type").alias("name")).agg((F.sum("value") / 1000.0).alias("seconds"))
    tk = AD.tokens(spark, sf_dir)
    n = tk.agg(F.sum(F.lit(1) - F.col("mask")).alias("n_prompt"), F.sum("mask").alias("n_response"))
    m = ME.timing_metrics(t, n)
    return m.select("name", r6("seconds").alias("seconds"), r6("per_token_ms").alias("per_token_ms"))


@query("reduce_metrics", f"""
SELECT event_type AS metric, {R6('avg(value)')} AS value FROM events GROUP BY 1
""")
def reduce_metrics(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), "value")
    return ev.groupBy("metric").agg(r6(F.avg("value")).alias("value"))


@query("entropy_agg", f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS l FROM embeddings)
, z AS (SELECT vec_id, label, l, list_max(l) AS mx FROM e)
, h AS (SELECT label % 2 AS m, list_max(l) + ln(list_sum(list_transform(l, lambda x: exp(x - mx))))
          - list_sum(list_transform(l, lambda x: exp(x - mx) / list_sum(list_transform(l, lambda y: exp(y - mx))) * x)) AS ent FROM z)
SELECT {R6('sum(ent * m) / (sum(m) + 1e-8)')} AS entropy FROM h
""")
def entropy_agg(spark, sf_dir):
    from rlframe.operators.aggregates import masked_mean
    e = table(spark, sf_dir, "embeddings")
    d = e.select(L.entropy_from_logits(F.transform("embedding", lambda x: x.cast("double"))).alias("ent"),
                 F.pmod("label", F.lit(2)).alias("m"))
    return d.agg(r6(masked_mean("ent", "m")).alias("entropy"))


@query("pad_edge", """
WITH oi AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders)
, n AS (SELECT count(*) AS n FROM orders)
SELECT o_orderkey, CAST(idx AS BIGINT) AS idx, false AS is_pad FROM oi
UNION ALL
SELECT oi.o_orderkey, CAST(n.n + r AS BIGINT), true FROM oi, n, (SELECT unnest([0, 1, 2]) AS r) WHERE oi.idx = n.n - 1
""")
def pad_edge(spark, sf_dir):
    o = B.with_global_index(table(spark, sf_dir, "orders").select("o_orderkey"), [F.col("o_orderkey")])
    return B.pad_edge(o, 3, o.count()).select("o_orderkey", "idx", "is_pad")


def _sol(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    v = F.pmod("o_orderkey", F.lit(53)).cast("string")
    k = F.pmod("o_orderkey", F.lit(3))
    return o.select("o_orderkey", v.alias("gt"), k.alias("k"))


@query("retool_score", """
SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN 1.0 ELSE -1.0 END AS DOUBLE) AS score FROM orders
""")
def retool_score(spark, sf_dir):
    d = _sol(spark, sf_dir)
    block = (F.when(F.col("k") == 0, F.concat(F.lit("<answer>so \\boxed{"), F.col("gt"), F.lit("}</answer>")))
              .when(F.col("k") == 1, F.concat(F.lit("<answer>"), F.col("gt"), F.lit("</answer>")))
              .otherwise(F.concat(F.lit("\\boxed{"), F.col("gt"), F.lit("}"))))
    t = F.concat(F.lit("<|im_start|>assistant\n"), block, F.lit("<|im_end|>\n"))
    return d.select("o_orderkey", r6(M.boxed_answer_score(t, F.col("gt"))).alias("score"))


@query("geo_score", """
SELECT o_orderkey, CAST(CASE o_orderkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 0.0 END AS DOUBLE) AS score FROM orders
""")
def geo_score(spark, sf_dir):
    d = _sol(spark, sf_dir)
    s = (F.when(F.col("k") == 0, F.concat(F.lit("<think>a</think> so \\boxed{"), F.col("gt"), F.lit("}")))
          .when(F.col("k") == 1, F.concat(F.lit("so \\boxed{"), F.col("gt"), F.lit("}")))
          .otherwise(F.lit("no answer")))
    return d.select("o_orderkey", r6(M.geo_score(s, F.col("gt"))).alias("score"))


@query("strict_box_score", """
SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 1 ELSE -1 END AS score FROM orders
""")
def strict_box_score(spark, sf_dir):
    d = _sol(spark, sf_dir)
    pad = F.repeat(F.lit("x"), 150)
    s = (F.when(F.col("k") == 0, F.concat(pad, F.lit(" \\boxed{"), F.col("gt"), F.lit("}")))
          .when(F.col("k") == 1, F.concat(F.lit("\\boxed{"), F.col("gt"), F.lit("}"), pad))
          .otherwise(F.concat(pad, F.lit(" \\boxed{"), F.col("gt"), F.lit("0}"))))
    return d.select("o_orderkey", M.strict_box_score(s, F.col("gt")).alias("score"))
