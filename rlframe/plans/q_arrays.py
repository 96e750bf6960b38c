"""Token-array queries: ids are the word lengths of whole document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rlframe.functions import arrays as A
from rlframe.plans.registry import R6, query, r6
from rlframe.sources import adapters as AD
from rlframe.sources.tables import table


def _ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.transform(F.split("text", " ", -1), lambda w: F.length(w).cast("long")).alias("ids"))


_IDS = "WITH d AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS BIGINT)) AS ids FROM documents)\n"


@query("pad_truncate", _IDS + """
SELECT doc_id, CAST(64 AS BIGINT) AS n, CAST(list_sum(ids[1:64]) AS BIGINT) AS total,
       CASE WHEN len(ids) < 64 THEN CAST(0 AS BIGINT) ELSE ids[1] END AS first_id,
       ids[least(len(ids), 64)] AS last_id
FROM d
""")
def pad_truncate(spark, sf_dir):
    p = _ids(spark, sf_dir).select("doc_id", A.pad_to(A.truncate_to("ids", 64, "right"), 64, 0, left=True).alias("p"))
    return p.select("doc_id", F.size("p").cast("bigint").alias("n"),
                    F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
                    F.element_at("p", 1).alias("first_id"), F.element_at("p", -1).alias("last_id"))


@query("response_mask_eos", _IDS + """
SELECT doc_id, CAST(coalesce(list_position(list_transform(ids, lambda x: x IN (1, 2)), true), len(ids)) AS BIGINT) AS mask_sum,
       CAST(len(ids) AS BIGINT) AS n FROM d
""")
def response_mask_eos(spark, sf_dir):
    m = _ids(spark, sf_dir).select("doc_id", "ids", A.response_mask("ids", [1, 2]).alias("m"))
    return m.select("doc_id", F.aggregate("m", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mask_sum"),
                    F.size("ids").cast("bigint").alias("n"))


@query("position_ids", """
WITH u AS (SELECT doc_id, CAST(length(w) > 3 AS INTEGER) AS m, i
           FROM documents, unnest(string_split(text, ' ')) WITH ORDINALITY AS t(w, i))
, c AS (SELECT *, sum(m) OVER (PARTITION BY doc_id ORDER BY i) AS cs FROM u)
SELECT doc_id, CAST(sum((cs - 1) * m) AS BIGINT) AS agent_sum, CAST(max((cs - 1) * m) AS BIGINT) AS agent_max,
       CAST(sum(greatest(cs - 1, 0)) AS BIGINT) AS framework_sum FROM c GROUP BY doc_id
""")
def position_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    m = d.select("doc_id", F.transform(F.split("text", " ", -1), lambda w: (F.length(w) > 3).cast("int")).alias("m"))
    p = m.select("doc_id", A.position_ids("m", "agent").alias("pa"), A.position_ids("m", "framework").alias("pf"))
    s = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return p.select("doc_id", s("pa").alias("agent_sum"), F.array_max("pa").cast("bigint").alias("agent_max"),
                    s("pf").alias("framework_sum"))


@query("sft_sequence", AD.sql_with(messages=AD.MESSAGES_SQL) + """
, f AS (SELECT conv_id, arg_min(content, turn) FILTER (WHERE role = 'user') AS u,
               arg_min(content, turn) FILTER (WHERE role = 'assistant') AS a FROM messages GROUP BY conv_id)
, x AS (SELECT conv_id, list_transform(string_split(u, ' '), lambda w: CAST(length(w) AS BIGINT)) AS p,
               list_append(list_transform(string_split(a, ' '), lambda w: CAST(length(w) AS BIGINT)), CAST(2 AS BIGINT)) AS r
        FROM f WHERE u IS NOT NULL AND a IS NOT NULL)
, y AS (SELECT conv_id, list_concat(p, r) AS ids, len(p) AS lp, len(r) AS lr FROM x)
SELECT conv_id, CAST(list_sum(ids[1:128]) AS BIGINT) AS ids_sum, CAST(least(len(ids), 128) AS BIGINT) AS attn_sum,
       CAST(len(list_filter(range(0, least(len(ids), 128)),
            lambda i: NOT ((lp > 1 AND i < least(lp, 128) - 1) OR i = least(lp + lr, 128) - 1))) AS BIGINT) AS loss_sum
FROM y
""")
def sft_sequence(spark, sf_dir):
    m = AD.messages(spark, sf_dir)
    f = m.groupBy("conv_id").agg(
        F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("turn"))).alias("u"),
        F.min_by(F.when(F.col("role") == "assistant", F.col("content")),
                 F.when(F.col("role") == "assistant", F.col("turn"))).alias("a"))
    f = f.where(F.col("u").isNotNull() & F.col("a").isNotNull())
    tok = lambda c: F.transform(F.split(c, " ", -1), lambda w: F.length(w).cast("long"))
    s = f.select("conv_id", A.sft_sequence(tok("u"), tok("a"), eos=2, pad=0, max_len=128).alias("s"))
    tot = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return s.select("conv_id", tot("s.input_ids").alias("ids_sum"), tot("s.attention_mask").alias("attn_sum"),
                    tot("s.loss_mask").alias("loss_sum"))


@query("logprob_entropy", f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS l, vec_id % len(embedding) AS lab FROM embeddings)
, s AS (SELECT vec_id, l, lab, list_max(l) AS mx FROM e)
, z AS (SELECT vec_id, l, lab, mx, list_sum(list_transform(l, lambda x: exp(x - mx))) AS zz FROM s)
SELECT vec_id, {R6('l[lab + 1] - (mx + ln(zz))')} AS logprob,
       {R6('mx + ln(zz) - list_sum(list_transform(l, lambda x: exp(x - mx) / zz * x))')} AS entropy
FROM z
""")
def logprob_entropy(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    d = e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("l"),
                 F.pmod("vec_id", F.size("embedding")).alias("lab"))
    return d.select("vec_id", r6(A.log_softmax_at("l", "lab")).alias("logprob"), r6(A.entropy("l")).alias("entropy"))
