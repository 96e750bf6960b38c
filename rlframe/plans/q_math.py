"""Math and rule-based scorer queries (MS-*, SC-18..21, SC-28)."""

from __future__ import annotations

from pyspark.sql import functions as F

from rlframe.functions import mathans as M
from rlframe.plans.registry import R6, query, r6
from rlframe.sources import adapters as AD
from rlframe.sources.tables import table


def _num_responses(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    val = F.col("o_orderkey") * 7 + F.col("o_custkey")
    k = F.pmod("o_orderkey", F.lit(3))
    resp = (F.when(k == 0, F.concat(F.lit("Total "), F.col("o_orderpriority"), F.lit(" is #### "),
                                    F.format_number(val, 0)))
             .when(k == 1, F.concat(F.lit("Total "), F.col("o_orderpriority"), F.lit(" is "), val.cast("string"),
                                    F.lit(" dollars.")))
             .otherwise(F.lit("no idea")))
    return o.select("o_orderkey", resp.alias("response"), val.cast("string").alias("gt"))


_NUM = """
WITH r AS (SELECT o_orderkey, CAST(o_orderkey * 7 + o_custkey AS VARCHAR) AS gt,
  CASE o_orderkey % 3 WHEN 0 THEN 'Total ' || o_orderpriority || ' is #### ' || format('{:,}', o_orderkey * 7 + o_custkey)
                      WHEN 1 THEN 'Total ' || o_orderpriority || ' is ' || CAST(o_orderkey * 7 + o_custkey AS VARCHAR) || ' dollars.'
                      ELSE 'no idea' END AS response FROM orders)
"""


@query("numeric_strict", _NUM + f"""
, a AS (SELECT o_orderkey, gt, CASE WHEN regexp_matches(response, '#### (\\-?[0-9\\.\\,]+)')
        THEN replace(replace(regexp_extract(response, '#### (\\-?[0-9\\.\\,]+)', 1), ',', ''), '$', '') END AS answer FROM r)
SELECT o_orderkey, answer, {R6("CASE WHEN answer IS NULL THEN 0.0 WHEN answer = gt THEN 1.0 ELSE 0.0 END")} AS score FROM a
""")
def numeric_strict(spark, sf_dir):
    d = _num_responses(spark, sf_dir)
    return d.select("o_orderkey", M.numeric_answer("response", "strict").alias("answer"),
                    r6(M.numeric_score("response", "gt", "strict")).alias("score"))


@query("numeric_flexible", _NUM + f"""
, c AS (SELECT o_orderkey, gt, regexp_extract_all(response, '(\\-?[0-9\\.\\,]+)', 1) AS cands FROM r)
, a AS (SELECT o_orderkey, gt, CASE WHEN len(cands) = 0 THEN NULL
              WHEN len(list_filter(cands, lambda x: x NOT IN ('', '.'))) > 0
                THEN list_filter(cands, lambda x: x NOT IN ('', '.'))[-1]
              ELSE cands[1] END AS answer FROM c)
SELECT o_orderkey, answer, {R6("CASE WHEN answer IS NULL THEN 0.0 WHEN answer = gt THEN 1.0 ELSE 0.0 END")} AS score FROM a
""")
def numeric_flexible(spark, sf_dir):
    d = _num_responses(spark, sf_dir)
    return d.select("o_orderkey", M.numeric_answer("response", "flexible").alias("answer"),
                    r6(M.numeric_score("response", "gt", "flexible")).alias("score"))


def _boxed_src(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = (F.pmod("o_orderkey", F.lit(9)) + 1).cast("string")
    b = (F.pmod("o_custkey", F.lit(7)) + 2).cast("string")
    k = F.pmod("o_orderkey", F.lit(4))
    x = (F.when(k == 0, F.concat(F.lit("\\frac{"), a, F.lit("}{"), b, F.lit("}")))
          .when(k == 1, a).when(k == 2, F.concat(F.lit("x^{"), a, F.lit("}"))))
    sol = F.when(k == 3, F.concat(F.lit("first \\boxed{1} then oops \\boxed{"), a)) \
        .otherwise(F.concat(F.lit("We get \\boxed{"), x, F.lit("} finally")))
    return o.select("o_orderkey", sol.alias("solution"))


@query("boxed_extract", """
SELECT o_orderkey,
  CASE o_orderkey % 4 WHEN 0 THEN '\\frac{' || CAST(o_orderkey % 9 + 1 AS VARCHAR) || '}{' || CAST(o_custkey % 7 + 2 AS VARCHAR) || '}'
                      WHEN 1 THEN CAST(o_orderkey % 9 + 1 AS VARCHAR)
                      WHEN 2 THEN 'x^{' || CAST(o_orderkey % 9 + 1 AS VARCHAR) || '}'
                      ELSE NULL END AS boxed
FROM orders
""")
def boxed_extract(spark, sf_dir):
    d = _boxed_src(spark, sf_dir)
    return d.select("o_orderkey", M.remove_boxed(M.last_boxed("solution")).alias("boxed"))


def _latex_pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = (F.pmod("o_orderkey", F.lit(9)) + 1).cast("string")
    b = (F.pmod("o_custkey", F.lit(7)) + 2).cast("string")
    gold = F.concat(F.lit("\\frac{"), a, F.lit("}{"), b, F.lit("}"))
    k = F.pmod("o_orderkey", F.lit(5))
    ans = (F.when(k == 0, F.concat(a, F.lit("/"), b))
            .when(k == 1, F.concat(F.lit("\\dfrac"), a, b))
            .when(k == 2, F.concat(F.lit("x = "), a, F.lit("/"), b))
            .when(k == 3, F.concat(a, F.lit("/"), (b.cast("int") + 1).cast("string")))
            .otherwise(F.concat(F.lit("\\left("), a, F.lit("\\right)"))))
    return o.select("o_orderkey", ans.alias("answer"), gold.alias("gold"))


@query("latex_equal", """
SELECT o_orderkey, o_orderkey % 5 IN (0, 1, 2) AS equiv FROM orders
""")
def latex_equal(spark, sf_dir):
    d = _latex_pairs(spark, sf_dir)
    return d.select("o_orderkey", M.is_equiv("answer", "gold").alias("equiv"))


def _sql_norm_final(x: str) -> str:
    e = f"string_split({x}, '=')[-1]"
    for a, b in M.SUBSTITUTIONS:
        e = f"replace({e}, {_q(a)}, {_q(b)})"
    for a in M.REMOVED_EXPRESSIONS:
        e = f"replace({e}, {_q(a)}, '')"
    for pat, rep in ((r"(.*?)(\$)(.*?)(\$)(.*)", r"$\3$"), (r"(\\text\{)(.*?)(\})", r"\2"),
                     (r"(\\textbf\{)(.*?)(\})", r"\2"), (r"(\\overline\{)(.*?)(\})", r"\2"),
                     (r"(\\boxed\{)(.*)(\})", r"\2"), (r"(frac)([^{])(.)", r"frac{\2}{\3}"),
                     (r"(sqrt)([^{])", r"sqrt{\2}")):
        e = f"regexp_replace({e}, {_q(pat)}, {_q(rep)}, 'g')"
    e = f"replace({e}, '$', '')"
    e = f"CASE WHEN regexp_matches(replace({e}, ',', ''), '^[0-9]+$') THEN replace({e}, ',', '') ELSE {e} END"
    return f"regexp_replace({e}, '^\\s+|\\s+$', '', 'g')"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _final_src(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    v = (F.pmod("o_orderkey", F.lit(50)) * 3).cast("string")
    k = F.pmod("o_orderkey", F.lit(4))
    ans = (F.when(k == 0, F.concat(F.lit("$"), v, F.lit("$")))
            .when(k == 1, F.concat(F.lit("x = \\boxed{"), v, F.lit("} dollars")))
            .when(k == 2, F.concat(F.lit("\\text{"), v, F.lit("} units")))
            .otherwise(F.concat(v, F.lit("1"))))
    sol = F.concat(F.lit("Work for order "), F.col("o_orderkey").cast("string"), F.lit(".\nAnswer: "), ans)
    return o.select("o_orderkey", sol.alias("solution"), v.alias("gold"))


@query("final_answer_match", f"""
WITH s AS (SELECT o_orderkey, CAST((o_orderkey % 50) * 3 AS VARCHAR) AS gold,
  'Work for order ' || CAST(o_orderkey AS VARCHAR) || '.' || chr(10) || 'Answer: ' ||
  CASE o_orderkey % 4 WHEN 0 THEN '$' || CAST((o_orderkey % 50) * 3 AS VARCHAR) || '$'
                      WHEN 1 THEN 'x = \\boxed{{' || CAST((o_orderkey % 50) * 3 AS VARCHAR) || '}} dollars'
                      WHEN 2 THEN '\\text{{' || CAST((o_orderkey % 50) * 3 AS VARCHAR) || '}} units'
                      ELSE CAST((o_orderkey % 50) * 3 AS VARCHAR) || '1' END AS solution FROM orders)
, m AS (SELECT o_orderkey, gold, regexp_extract_all(right(solution, 300), '(?i)Answer\\s*:\\s*([^\\n]+)', 1) AS ms FROM s)
, p AS (SELECT o_orderkey, gold, {_sql_norm_final("coalesce(ms[-1], '[INVALID]')")} AS pred FROM m)
SELECT o_orderkey, pred, CAST(CASE WHEN pred = {_sql_norm_final('gold')} THEN 1.0 ELSE -1.0 END AS DOUBLE) AS score FROM p
""")
def final_answer_match(spark, sf_dir):
    d = _final_src(spark, sf_dir)
    r = d.select("o_orderkey", M.final_answer_score("solution", "gold").alias("r"))
    return r.select("o_orderkey", F.col("r.pred").alias("pred"), F.col("r.score").alias("score"))


@query("tolerant_numeric_equal", """
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_orderkey * 1000 + l_linenumber AS v FROM lineitem)
, p AS (SELECT *, CAST(v AS VARCHAR) AS a,
          CASE (l_partkey + l_suppkey) % 4 WHEN 0 THEN CAST(v AS VARCHAR) WHEN 1 THEN CAST(v * 100 AS VARCHAR)
               WHEN 2 THEN CAST(v + v // 1000 + 1 AS VARCHAR) ELSE CAST(v AS VARCHAR) || ',000' END AS b FROM v)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       coalesce(abs(CAST(a AS DOUBLE) - CAST(replace(b, ',', '') AS DOUBLE)) <= 1e-4 * greatest(abs(CAST(a AS DOUBLE)), abs(CAST(replace(b, ',', '') AS DOUBLE)))
             OR abs(CAST(a AS DOUBLE) - CAST(replace(b, ',', '') AS DOUBLE) / 100) <= 1e-4 * greatest(abs(CAST(a AS DOUBLE)), abs(CAST(replace(b, ',', '') AS DOUBLE) / 100))
             OR abs(CAST(a AS DOUBLE) - CAST(replace(b, ',', '') AS DOUBLE) * 100) <= 1e-4 * greatest(abs(CAST(a AS DOUBLE)), abs(CAST(replace(b, ',', '') AS DOUBLE) * 100)), false) AS close
FROM p
""")
def tolerant_numeric_equal(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    v = F.col("l_orderkey") * 1000 + F.col("l_linenumber")
    k = F.pmod(F.col("l_partkey") + F.col("l_suppkey"), F.lit(4))
    b = (F.when(k == 0, v.cast("string")).when(k == 1, (v * 100).cast("string"))
          .when(k == 2, (v + F.floor(v / 1000) + 1).cast("string"))
          .otherwise(F.concat(v.cast("string"), F.lit(",000"))))
    d = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", v.cast("string").alias("a"), b.alias("b"))
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", M.numeric_close("a", "b").alias("close"))


@query("mc_score", """
WITH s AS (SELECT item_id, ['A', 'B', 'C', 'D'][item_id % 4 + 1] AS gold,
  text || chr(10) || CASE item_id % 3 WHEN 0 THEN 'Answer: ' || ['A', 'B', 'C', 'D'][item_id % 4 + 1]
                                      WHEN 1 THEN 'answer:$' || ['A', 'B', 'C', 'D'][(item_id + 1) % 4 + 1] || '$'
                                      ELSE 'no choice' END AS solution FROM benchmark)
SELECT item_id, CAST(CASE WHEN regexp_extract(solution, '(?i)Answer[ \\t]*:[ \\t]*\\$?([A-D])\\$?', 1) = gold THEN 1.0 ELSE 0.0 END AS DOUBLE) AS score
FROM s
""")
def mc_score(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    letters = F.array(*[F.lit(x) for x in "ABCD"])
    gold = F.element_at(letters, (F.pmod("item_id", F.lit(4)) + 1).cast("int"))
    other = F.element_at(letters, (F.pmod(F.col("item_id") + 1, F.lit(4)) + 1).cast("int"))
    k = F.pmod("item_id", F.lit(3))
    sol = F.concat(F.col("text"), F.lit("\n"), F.when(k == 0, F.concat(F.lit("Answer: "), gold))
                   .when(k == 1, F.concat(F.lit("answer:$"), other, F.lit("$"))).otherwise(F.lit("no choice")))
    return b.select("item_id", M.mc_score(sol, gold).alias("score"))


@query("overlong_penalty", AD.sql_with(rollouts=AD.ROLLOUTS_SQL) + f"""
SELECT uid, CAST(sample_idx AS BIGINT) AS sample_idx, {R6('least(-(response_len - 30) / 20.0 * 1.0, 0.0)')} AS overlong_reward,
       {R6('score + least(-(response_len - 30) / 20.0 * 1.0, 0.0)')} AS reward,
       least(-(response_len - 30) / 20.0 * 1.0, 0.0) < 0 AS overlong
FROM rollouts
""")
def overlong_penalty(spark, sf_dir):
    r = AD.rollouts(spark, sf_dir)
    pen = M.overlong_penalty("response_len", 50, 20, 1.0)
    return r.select("uid", F.col("sample_idx").cast("bigint"), r6(pen).alias("overlong_reward"),
                    r6(F.col("score") + pen).alias("reward"), (pen < 0).alias("overlong"))


@query("prefix_reward", f"""
WITH s AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS p, CAST(o_orderkey + o_custkey % 3 * 10 AS VARCHAR) AS g FROM orders)
, m AS (SELECT *, list_transform(range(1, least(length(p), length(g)) + 1), lambda i: substr(p, i, 1) = substr(g, i, 1)) AS eq FROM s)
SELECT o_orderkey, {R6("CAST(CASE WHEN list_position(eq, false) IS NULL THEN len(eq) ELSE list_position(eq, false) - 1 END AS DOUBLE) / (length(g) + 1)")} AS reward FROM m
""")
def prefix_reward(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p = F.col("o_orderkey").cast("string")
    g = (F.col("o_orderkey") + F.pmod("o_custkey", F.lit(3)) * 10).cast("string")
    return o.select("o_orderkey", r6(M.prefix_reward(p, g)).alias("reward"))


@query("resubmit_reward", """
WITH s AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN 1.0 ELSE 0.0 END AS score FROM conversations)
SELECT conv_id, turn, CAST(CASE WHEN score > coalesce(lag(score) OVER (PARTITION BY conv_id ORDER BY turn), 0.0)
                           THEN 0.0 ELSE -0.05 END AS DOUBLE) AS tool_reward FROM s
""")
def resubmit_reward(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    from rlframe.operators.process import resubmit_rewards
    s = c.select("conv_id", "turn", F.when(F.pmod(F.length("text"), F.lit(3)) == 0, 1.0).otherwise(0.0).alias("score"))
    return resubmit_rewards(s, "conv_id", "turn", "score").select("conv_id", "turn", "tool_reward")
