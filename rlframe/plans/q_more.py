"""Embedding cosine, competition-answer grading and message-mask queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rlframe.functions import arrays as A
from rlframe.functions import mathans as M
from rlframe.functions import text as T
from rlframe.plans.registry import R6, query, r6
from rlframe.sources import adapters as AD
from rlframe.sources.tables import table


@query("embedding_cosine", f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT a.vec_id, {R6('list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) / (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x))))')} AS cosine
FROM e a JOIN e b ON b.vec_id = a.vec_id + 1
""")
def embedding_cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(nxt, "vec_id").select("vec_id", r6(T.cosine("v", "w")).alias("cosine"))


@query("algebra_grade", """
SELECT o_orderkey, o_orderkey % 6 IN (0, 1, 2, 5) AS correct FROM orders
""")
def algebra_grade(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = (F.pmod("o_orderkey", F.lit(9)) + 1).cast("string")
    b = (F.pmod("o_custkey", F.lit(7)) + 2).cast("string")
    v = F.pmod("o_orderkey", F.lit(89)).cast("string")
    k = F.pmod("o_orderkey", F.lit(6))
    given = (F.when(k == 0, F.concat(F.lit("\\text{"), v, F.lit("}")))
              .when(k == 1, F.concat(v, F.lit(" meters")))
              .when(k == 2, F.concat(F.lit("("), a, F.lit(", "), b, F.lit(")")))
              .when(k == 3, F.concat(a, F.lit("/"), b))
              .when(k == 4, F.concat(v, F.lit(".5")))
              .otherwise(F.concat(a, F.lit(" "), F.lit("1/"), b)))
    gt = (F.when(k == 2, F.concat(F.lit("("), a, F.lit(","), b, F.lit(")")))
           .when(k == 3, F.concat(a, F.lit("/"), (b.cast("int") + 1).cast("string")))
           .when(k == 5, F.concat(a, F.lit("+1/"), b))
           .otherwise(v))
    return o.select("o_orderkey", M.tuple_grade(given, gt).alias("correct"))


@query("match_answer", """
SELECT o_orderkey,
  CASE o_orderkey % 4 WHEN 3 THEN false ELSE true END AS matched,
  CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey % 97 AS VARCHAR) || '.'
                      WHEN 1 THEN CAST(o_orderkey % 97 AS VARCHAR) || ' done'
                      WHEN 2 THEN CAST(o_orderkey % 97 AS VARCHAR)
                      ELSE 'no digits here' END AS answer
FROM orders
""")
def match_answer(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    v = F.pmod("o_orderkey", F.lit(97)).cast("string")
    k = F.pmod("o_orderkey", F.lit(4))
    resp = (F.when(k == 0, F.concat(F.lit("Thus the answer is "), v, F.lit(".")))
             .when(k == 1, F.concat(F.lit("We get x = "), v, F.lit(" done")))
             .when(k == 2, F.concat(F.lit("Result \\boxed{"), v, F.lit("} ok")))
             .otherwise(F.lit("no digits here")))
    m = o.select("o_orderkey", M.match_answer(resp).alias("m"))
    return m.select("o_orderkey", F.col("m.matched").alias("matched"), F.col("m.answer").alias("answer"))


@query("message_masks", AD.sql_with(messages=AD.MESSAGES_SQL) + """
, l AS (SELECT conv_id, turn, role, length('<|im_start|>' || role || chr(10)) // 4 AS p,
               len(string_split(content, ' ')) AS b, 2 AS s FROM messages)
, c AS (SELECT *, coalesce(sum(p + b + s) OVER (PARTITION BY conv_id ORDER BY turn
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM l)
SELECT conv_id, CAST(least(sum(p + b + s), 512) AS BIGINT) AS n_tokens,
       CAST(sum(CASE WHEN role = 'assistant' THEN greatest(least(st + p + b + s, 512) - least(st + p, 512), 0) ELSE 0 END) AS BIGINT) AS n_loss
FROM c GROUP BY conv_id
""")
def message_masks(spark, sf_dir):
    m = AD.messages(spark, sf_dir)
    g = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(
        "turn", "role", F.floor(F.length(F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"))) / 4).alias("p"),
        F.size(F.split("content", " ", -1)).alias("b")))).alias("ms"))
    mask = A.message_masks(F.transform("ms", lambda x: x["role"]), F.transform("ms", lambda x: x["p"]),
                           F.transform("ms", lambda x: x["b"]), F.transform("ms", lambda x: F.lit(2)), 512)
    d = g.select("conv_id", mask.alias("mask"))
    return d.select("conv_id", F.size("mask").cast("bigint").alias("n_tokens"),
                    F.aggregate("mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_loss"))


_RO = AD.sql_with(rollouts=AD.ROLLOUTS_SQL)


@query("advantage_by_name", _RO + f"""
, st AS (SELECT uid, count(*) AS n, avg(score) AS m FROM rollouts GROUP BY uid)
SELECT r.uid, CAST(r.sample_idx AS BIGINT) AS sample_idx,
       {R6('CASE WHEN st.n > 1 THEN r.score * st.n / (st.n - 1) - st.m * st.n / (st.n - 1) ELSE r.score END')} AS advantage
FROM rollouts r JOIN st USING (uid)
""")
def advantage_by_name(spark, sf_dir):
    from rlframe.operators.advantage import advantage
    adv = advantage(AD.rollouts(spark, sf_dir), "rloo")
    return adv.select("uid", F.col("sample_idx").cast("bigint"), r6("advantage").alias("advantage"))


@query("reexpand_results", """
WITH a AS (SELECT conv_id, count(*) AS n_asst FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT c.conv_id, coalesce(a.n_asst, 0) AS n_asst, a.conv_id IS NOT NULL AS active
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN a USING (conv_id)
""")
def reexpand_results(spark, sf_dir):
    from rlframe.operators.turns import reexpand
    m = AD.messages(spark, sf_dir)
    active = m.where(F.col("role") == "assistant").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_asst")) \
        .withColumn("active", F.lit(True))
    keys = m.select("conv_id").distinct()
    return reexpand(active, keys, ["conv_id"], {"n_asst": 0, "active": False}).select("conv_id", "n_asst", "active")


@query("nested_select", AD.sql_with(messages=AD.MESSAGES_SQL) + """
SELECT conv_id, arg_min(content, turn) AS first_content, arg_min(role, turn) AS first_role FROM messages GROUP BY conv_id
""")
def nested_select(spark, sf_dir):
    from rlframe.operators.prepare import conversation_table, nested_select as ns
    t = conversation_table(AD.messages(spark, sf_dir)).withColumn("rec", F.struct(F.struct(
        F.col("messages")[0].alias("first")).alias("meta")))
    return t.select("conv_id", ns("rec", ["meta", "first", "content"]).alias("first_content"),
                    ns("rec", ["meta", "first", "role"]).alias("first_role"))


@query("cut_after_call", AD.sql_with(messages=AD.MESSAGES_SQL, wrapped=AD.WRAPPED_SQL) + """
SELECT conv_id, turn, CASE WHEN contains(content, '</interaction_prompt>')
                           THEN split_part(content, '</interaction_prompt>', 1) || '</interaction_prompt>' ELSE content END AS cut
FROM wrapped WHERE role = 'assistant'
""")
def cut_after_call(spark, sf_dir):
    m = AD.wrapped_messages(spark, sf_dir).where(F.col("role") == "assistant")
    return m.select("conv_id", "turn", A.cut_after_first_block("content", "</interaction_prompt>").alias("cut"))
