"""Dataset-builder queries (PR-*) over documents, orders, benchmark, pages,
labels and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from rlframe.operators import prepare as P
from rlframe.operators.batch import rank_within
from rlframe.plans.registry import query
from rlframe.sources import adapters as AD
from rlframe.sources.tables import table

INSTR = "Answer the question."
NUM_INSTR = 'Think step by step and output the final answer after "####".'


def _raw_qa(spark, sf_dir):
    """Raw QA records: new style (golden_answers) for doc_id % 3 = 0, old
    style (answer) for 1, neither for 2."""
    d = table(spark, sf_dir, "documents")
    k = F.pmod("doc_id", F.lit(3))
    return d.select("doc_id", F.col("text").alias("question"),
                    F.when(k == 0, F.array("lang", "source")).alias("golden_answers"),
                    F.when(k == 1, F.col("source")).alias("answer"))


def _qa(spark, sf_dir):
    raw = _raw_qa(spark, sf_dir)
    return P.qa_rows(raw, "question", P.gold_answers("golden_answers", "answer"), "multihop", INSTR,
                     keep=("doc_id",))


def _flat(rows):
    return rows.select("doc_id", "data_source", F.col("prompt")[0]["role"].alias("role"),
                       F.col("prompt")[0]["content"].alias("content"), "ability",
                       F.col("reward_model.style").alias("style"),
                       F.size("reward_model.ground_truth").cast("bigint").alias("n_gold"),
                       F.array_join("reward_model.ground_truth", "|").alias("golds"))


_QA_SQL = f"""
SELECT doc_id, 'multihop' AS data_source, 'user' AS role, 'Question: ' || text || chr(10) || '{INSTR}' AS content,
       'multihop_qa' AS ability, 'rule' AS style,
       CAST(CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS n_gold,
       CASE doc_id % 3 WHEN 0 THEN lang || '|' || source WHEN 1 THEN source ELSE '' END AS golds
FROM documents
"""


@query("qa_rows", _QA_SQL)
def qa_rows(spark, sf_dir):
    return _flat(_qa(spark, sf_dir))


def _num_raw(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    val = F.col("o_orderkey") * 7 + F.col("o_custkey")
    ans = F.when(F.pmod("o_orderkey", F.lit(3)) != 0,
                 F.concat(F.lit("Priority "), F.col("o_orderpriority"), F.lit(" so #### "), F.format_number(val, 0)))\
        .otherwise(F.concat(F.lit("Priority "), F.col("o_orderpriority"), F.lit(" and no marker")))
    return o.select("o_orderkey", F.concat(F.lit("What is order "), F.col("o_orderkey").cast("string"),
                                           F.lit(" worth?")).alias("question"), ans.alias("answer"))


@query("numeric_rows", f"""
SELECT o_orderkey, 'openai/gsm8k' AS data_source,
       'What is order ' || o_orderkey || ' worth?' || ' {NUM_INSTR}' AS content,
       CAST(o_orderkey * 7 + o_custkey AS VARCHAR) AS ground_truth, o_orderkey AS idx,
       'Priority ' || o_orderpriority || ' so #### ' || format('{{:,}}', o_orderkey * 7 + o_custkey) AS answer
FROM orders WHERE o_orderkey % 3 <> 0
""")
def numeric_rows(spark, sf_dir):
    rows = P.numeric_rows(_num_raw(spark, sf_dir), "question", "answer", "o_orderkey", "train",
                          "openai/gsm8k", NUM_INSTR, on_missing="drop", keep=("o_orderkey",))
    return rows.select("o_orderkey", "data_source", F.col("prompt")[0]["content"].alias("content"),
                       F.col("reward_model.ground_truth").alias("ground_truth"),
                       F.col("extra_info.index").alias("idx"), F.col("extra_info.answer").alias("answer"))


def _mc_raw(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", "text", F.concat("text", F.lit(" (1)")).alias("w1"),
                    F.concat("text", F.lit(" (2)")).alias("w2"), F.concat("text", F.lit(" (3)")).alias("w3"))


@query("mc_rows", """
WITH o AS (SELECT item_id, text, t, md5(CAST(item_id AS VARCHAR) || ':11:' || CAST(i AS VARCHAR)) AS h
           FROM (SELECT item_id, text, unnest([text, text || ' (1)', text || ' (2)', text || ' (3)']) AS t,
                        unnest([0, 1, 2, 3]) AS i FROM benchmark))
, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY h) AS k FROM o)
SELECT item_id, 'gpqa' AS data_source,
       any_value(text) || chr(10) || string_agg(['A', 'B', 'C', 'D'][k] || ') ' || t, chr(10) ORDER BY k) AS prompt_text,
       ['A', 'B', 'C', 'D'][min(CASE WHEN t = text THEN k END)] AS gold_letter
FROM r GROUP BY item_id
""")
def mc_rows(spark, sf_dir):
    return P.mc_rows(_mc_raw(spark, sf_dir), "item_id", "text", "text", ["w1", "w2", "w3"], 11, "gpqa")


@query("sentence_completion_rows", """
WITH d AS (SELECT doc_id, source, lang, text, CASE WHEN doc_id % 7 = 0 THEN '' ELSE CAST(doc_id % 4 AS VARCHAR) END AS label
           FROM documents)
, c AS (SELECT doc_id, label, source || ': ' || lang || ' ' || upper(substr(text, 1, 1)) || lower(substr(text, 2)) AS ctx,
               [text, source, lang, text || ' [x]'] AS endings FROM d WHERE length(label) > 0)
, cl AS (SELECT doc_id, label,
                replace(regexp_replace(replace(regexp_replace(ctx, '^\\s+|\\s+$', '', 'g'), ' [title]', '. '),
                                       '\\[.*?\\]', '', 'g'), '  ', ' ') AS prompt,
                list_transform(endings, lambda e: replace(regexp_replace(replace(regexp_replace(e, '^\\s+|\\s+$', '', 'g'),
                               ' [title]', '. '), '\\[.*?\\]', '', 'g'), '  ', ' ')) AS ch FROM c)
SELECT doc_id, 'hellaswag' AS data_source, prompt, CAST(label AS INTEGER) AS ground_truth,
       array_to_string(ch, ' || ') AS choices FROM cl
""")
def sentence_completion_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", "text",
        F.when(F.pmod("doc_id", F.lit(7)) == 0, F.lit("")).otherwise(F.pmod("doc_id", F.lit(4)).cast("string")).alias("label"),
        F.array("text", "source", "lang", F.concat("text", F.lit(" [x]"))).alias("endings"))
    rows = P.sentence_completion_rows(d, "source", "lang", "text", "endings", "label", "hellaswag", "train",
                                      "doc_id", keep=("doc_id",))
    return rows.select("doc_id", "data_source", F.col("prompt")[0]["content"].alias("prompt"),
                       F.col("reward_model.ground_truth").alias("ground_truth"),
                       F.array_join("reward_model.choices", " || ").alias("choices"))


def _pairs(spark, sf_dir):
    """A preference pair for every document of quality 0: the documents of
    quality 1 of its source take turns, by rank of doc_id. Ranks are taken on
    ids; whole texts join at the end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    ids = docs.select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    ranked = rank_within(ids, ["source", "quality"], ["doc_id"], "rk")
    good = ranked.where("quality = 1")
    n = good.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    turn = ranked.where("quality = 0").join(n, "source").select("source", F.col("doc_id").alias("bad_id"), (F.col("rk") % F.col("n")).cast("int").alias("rk"))
    pairs = turn.join(good.select("source", "rk", F.col("doc_id").alias("good_id")), ["source", "rk"])
    text = lambda of, to: docs.select(F.col("doc_id").alias(of), F.col("text").alias(to))
    return pairs.join(text("good_id", "chosen"), "good_id").join(text("bad_id", "rejected"), "bad_id") \
        .select(F.concat_ws(":", "source", F.col("bad_id").cast("string")).alias("prompt"), "chosen", "rejected")


_PAIRS_SQL = """
WITH d AS (SELECT documents.doc_id, source, quality, text,
                  row_number() OVER (PARTITION BY source, quality ORDER BY documents.doc_id) - 1 AS rk FROM documents JOIN labels USING (doc_id))
, n AS (SELECT source, count(*) AS n FROM d WHERE quality = 1 GROUP BY source)
, p AS (SELECT b.source || ':' || b.doc_id AS prompt, g.text AS chosen, b.text AS rejected
        FROM d b JOIN n USING (source) JOIN d g ON g.source = b.source AND g.quality = 1 AND g.rk = b.rk % n.n WHERE b.quality = 0)
"""


@query("pref_to_sft", _PAIRS_SQL + """
SELECT prompt, chosen AS response FROM p UNION ALL SELECT prompt, rejected FROM p
""")
def pref_to_sft(spark, sf_dir):
    return P.pref_to_sft(_pairs(spark, sf_dir))


@query("pref_split", _PAIRS_SQL + """
, r AS (SELECT prompt, row_number() OVER (ORDER BY prompt) - 1 AS i, count(*) OVER () AS n FROM p)
SELECT prompt, CASE WHEN i < CAST(floor(n * 0.75) AS BIGINT) THEN 'train' ELSE 'test' END AS split FROM r
""")
def pref_split(spark, sf_dir):
    return P.pref_split(_pairs(spark, sf_dir), [F.col("prompt")]).select("prompt", "split")


@query("pref_to_rl", _PAIRS_SQL + """
SELECT 'hh_rlhf' AS data_source, prompt AS content, 'alignment' AS ability, 'model' AS style FROM p
""")
def pref_to_rl(spark, sf_dir):
    r = P.pref_to_rl(_pairs(spark, sf_dir).withColumn("i", F.lit(0)), "prompt", "hh_rlhf", "train", "i")
    return r.select("data_source", F.col("prompt")[0]["content"].alias("content"), "ability",
                    F.col("reward_model.style").alias("style"))


@query("multi_source_concat", f"""
WITH a AS (SELECT 'multihop' AS data_source FROM documents
           UNION ALL SELECT 'openai/gsm8k' FROM orders WHERE o_orderkey % 3 <> 0)
SELECT data_source, count(*) AS n FROM a GROUP BY data_source
""")
def multi_source_concat(spark, sf_dir):
    qa = _qa(spark, sf_dir).drop("doc_id")
    num = P.numeric_rows(_num_raw(spark, sf_dir), "question", "answer", "o_orderkey", "train",
                         "openai/gsm8k", NUM_INSTR, on_missing="drop")
    # canonical reward: ground_truth is always a list
    num = num.withColumn("reward_model", F.struct(F.col("reward_model.style").alias("style"),
                                                  F.array(F.col("reward_model.ground_truth")).alias("ground_truth")))
    return P.concat_sources([qa, num]).groupBy("data_source").agg(F.count(F.lit(1)).alias("n"))


@query("overlong_filter", f"""
SELECT doc_id FROM documents
WHERE floor(length('<|im_start|>user' || chr(10) || 'Question: ' || text || chr(10) || '{INSTR}' || '<|im_end|>' || chr(10)) / 4) <= 512
""")
def overlong_filter(spark, sf_dir):
    rows = _qa(spark, sf_dir)
    rendered = F.concat(F.lit("<|im_start|>"), F.col("prompt")[0]["role"], F.lit("\n"),
                        F.col("prompt")[0]["content"], F.lit("<|im_end|>\n"))
    return P.drop_overlong(rows.withColumn("_r", rendered), "_r", 512).select("doc_id")


def _media(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.regexp_replace("html", "<img[^>]*>", "<image>").alias("text"))


@query("media_split", """
WITH m AS (SELECT page_id, regexp_replace(html, '<img[^>]*>', '<image>', 'g') AS text FROM pages)
, s AS (SELECT page_id, string_split_regex(text, '<image>|<video>') AS texts,
               regexp_extract_all(text, '(<image>|<video>)', 1) AS marks FROM m)
SELECT page_id, CAST(len(texts) + len(marks) AS BIGINT) AS n_parts, CAST(len(marks) AS BIGINT) AS n_media,
       CAST(len(list_filter(texts, lambda t: t = '')) AS BIGINT) AS n_empty_text,
       CAST(sum(length(t)) AS BIGINT) AS text_chars
FROM s, unnest(texts) AS u(t) GROUP BY ALL
""")
def media_split(spark, sf_dir):
    m = _media(spark, sf_dir).withColumn("parts", P.media_parts("text"))
    return m.select(
        "page_id", F.size("parts").cast("bigint").alias("n_parts"),
        F.size(F.filter("parts", lambda p: p["type"] != "text")).cast("bigint").alias("n_media"),
        F.size(F.filter("parts", lambda p: (p["type"] == "text") & (p["text"] == ""))).cast("bigint").alias("n_empty_text"),
        F.aggregate("parts", F.lit(0).cast("bigint"),
                    lambda acc, p: acc + F.coalesce(F.length(p["text"]), F.lit(0)).cast("bigint")).alias("text_chars"))


@query("hash_split", """
SELECT doc_id, CASE WHEN CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':3'), 1, 8)) AS BIGINT) % 100 < 80
                    THEN 'train' ELSE 'test' END AS split FROM documents
""")
def hash_split(spark, sf_dir):
    return P.hash_split(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 3)


@query("conversation_table", """
SELECT conv_id, count(*) AS n_messages, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role
FROM conversations GROUP BY conv_id
""")
def conversation_table(spark, sf_dir):
    t = P.conversation_table(AD.messages(spark, sf_dir))
    return t.select("conv_id", F.size("messages").cast("bigint").alias("n_messages"),
                    F.col("messages")[0]["role"].alias("first_role"),
                    F.element_at("messages", -1)["role"].alias("last_role"))
