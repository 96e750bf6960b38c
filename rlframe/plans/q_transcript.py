"""Transcript queries: render, parse, format score, combined reward, bundle."""

from __future__ import annotations

from pyspark.sql import functions as F

from rlframe.functions import transcript as TR
from rlframe.operators import transcripts as TO
from rlframe.plans.registry import R6, query, r6
from rlframe.sources import adapters as AD

_T = AD.sql_with(messages=AD.MESSAGES_SQL, wrapped=AD.WRAPPED_SQL, tr=AD.RENDER_SQL,
                 facts=AD.CONV_FACTS_SQL)

_BLOCKS = "regexp_extract_all(transcript, '(?s)<\\|im_start\\|>assistant\\n(.*?)<\\|im_end\\|>', 1)"


def _strip(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _answer(x):
    return (f"CASE WHEN regexp_matches({x}, '(?s)<answer>(.*?)</answer>') "
            f"THEN {_strip(f'regexp_extract({x}, ' + chr(39) + '(?s)<answer>(.*?)</answer>' + chr(39) + ', 1)')} END")


def _cnt(x, tag):
    return f"((length({x}) - length(replace({x}, '{tag}', ''))) // {len(tag)})"


_GOOD = (f"({_cnt('b', '<think>')} = 1 AND {_cnt('b', '</think>')} = 1 AND "
         f"{_cnt('b', '<interaction_prompt>')} = 1 AND {_cnt('b', '</interaction_prompt>')} = 1 AND "
         "regexp_matches(b, '(?s)^<think>(.*?)</think>(\\s*)<interaction_prompt>(.*?)</interaction_prompt>\\n?\\z'))")

_SC = _T + f"""
, bl AS (SELECT conv_id, transcript, {_BLOCKS} AS blocks FROM tr)
, lb AS (SELECT conv_id, transcript, blocks, len(blocks) AS n,
                CASE WHEN len(blocks) > 0 THEN blocks[len(blocks)] END AS last FROM bl)
, fm AS (SELECT conv_id, n, last, {_answer('last')} AS ans,
                coalesce(list_sum(list_transform(blocks[1:len(blocks) - 1],
                         lambda b: CASE WHEN {_GOOD} THEN 0.4 ELSE 0.0 END)), 0.0) AS mid,
                regexp_matches(last, '(?s)^<think>(.*?)</think>(.*?)<answer>(.*?)</answer>\\n?\\z') AS full_form
         FROM lb)
, fs AS (SELECT conv_id, n, ans,
                CASE WHEN n = 0 THEN 0.0
                     WHEN ans IS NOT NULL AND ans <> '' THEN mid + 0.25 + 0.25 + CASE WHEN full_form THEN 0.1 ELSE 0.0 END
                     ELSE mid END AS format
         FROM fm)
"""

_P = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def _ntoks(x):
    return (f"list_filter(string_split_regex(translate(lower({x}), '{_P}', ''), '\\s+'), "
            "lambda t: t <> '' AND t NOT IN ('a', 'an', 'the'))")


_BUNDLE = _SC + f"""
, g AS (SELECT conv_id, data_source, unnest(golds) AS gold, generate_subscripts(golds, 1) AS gi FROM facts)
, atk AS (SELECT conv_id, {_ntoks('ans')} AS toks FROM fs WHERE ans IS NOT NULL)
, gtk AS (SELECT conv_id, gi, {_ntoks('gold')} AS toks FROM g)
, pc AS (SELECT conv_id, tok, count(*) AS c FROM (SELECT conv_id, unnest(toks) AS tok FROM atk) GROUP BY ALL)
, gc AS (SELECT conv_id, gi, tok, count(*) AS c FROM (SELECT conv_id, gi, unnest(toks) AS tok FROM gtk) GROUP BY ALL)
, cm AS (SELECT pc.conv_id, gc.gi, sum(least(pc.c, gc.c)) AS common FROM pc JOIN gc USING (conv_id, tok) GROUP BY ALL)
, pg AS (SELECT gtk.conv_id, gtk.gi, len(atk.toks) AS n_p, len(gtk.toks) AS n_g,
                array_to_string(atk.toks, ' ') AS sp, array_to_string(gtk.toks, ' ') AS sg,
                coalesce(cm.common, 0) AS common
         FROM gtk JOIN atk USING (conv_id) LEFT JOIN cm USING (conv_id, gi))
, best AS (SELECT conv_id,
                  max(CASE WHEN n_p = 0 OR n_g = 0 OR common = 0 THEN 0.0
                      ELSE 2 * (common / n_p) * (common / n_g) / ((common / n_p) + (common / n_g)) END) AS f1,
                  max(CAST(sp = sg AS DOUBLE)) AS em, max(CAST(contains(sp, sg) AS DOUBLE)) AS sm
           FROM pg GROUP BY conv_id)
, bundle AS (SELECT fs.conv_id, facts.data_source, fs.format,
                    CASE WHEN fs.n = 0 OR fs.ans IS NULL OR fs.ans = '' THEN 0.0 ELSE coalesce(best.f1, 0.0) END AS answer_score,
                    CASE WHEN fs.ans IS NULL THEN 0.0 ELSE coalesce(best.em, 0.0) END AS em,
                    CASE WHEN fs.ans IS NULL THEN 0.0 ELSE coalesce(best.sm, 0.0) END AS sm,
                    CASE WHEN fs.ans IS NULL THEN 0.0 ELSE coalesce(best.f1, 0.0) END AS f1
             FROM fs JOIN facts USING (conv_id) LEFT JOIN best USING (conv_id))
, comb AS (SELECT *, CASE WHEN least(format, 1.0) = 1.0 THEN -1.0 + least(format, 1.0) + answer_score
                          ELSE -1.0 + least(format, 1.0) END AS score FROM bundle)
"""


def _transcripts(spark, sf_dir):
    return TO.render_chat(AD.wrapped_messages(spark, sf_dir))


def _scored(spark, sf_dir):
    t = _transcripts(spark, sf_dir).join(AD.conv_facts(spark, sf_dir), "conv_id")
    return TO.score_bundle(t)


@query("render_chat", _T + "SELECT conv_id, transcript FROM tr")
def render_chat(spark, sf_dir):
    return _transcripts(spark, sf_dir)


@query("assistant_blocks", _T + f"""
SELECT conv_id, CAST(len({_BLOCKS}) AS BIGINT) AS n_blocks,
       CASE WHEN len({_BLOCKS}) > 0 THEN {_BLOCKS}[len({_BLOCKS})] END AS last_block
FROM tr
""")
def assistant_blocks(spark, sf_dir):
    b = TR.assistant_blocks("transcript")
    return _transcripts(spark, sf_dir).select(
        "conv_id", F.size(b).cast("bigint").alias("n_blocks"), F.try_element_at(b, F.lit(-1)).alias("last_block"))


@query("extract_answer", _SC + """
SELECT conv_id, ans AS answer, CAST(coalesce(ans <> '', false) AS BIGINT) AS has_answer FROM fs
""")
def extract_answer(spark, sf_dir):
    t = _transcripts(spark, sf_dir)
    a = TR.last_answer("transcript")
    return t.select("conv_id", a.alias("answer"),
                    F.coalesce(a != "", F.lit(False)).cast("bigint").alias("has_answer"))


_CALLS = "regexp_extract_all(transcript, '(?s)<interaction_prompt>(.*?)</interaction_prompt>', 1)"


@query("extract_calls", _T + f"""
SELECT conv_id, CAST(len({_CALLS}) AS BIGINT) AS n_calls,
       CAST(len(list_filter({_CALLS}, lambda b: json_valid(b))) AS BIGINT) AS n_json,
       coalesce(list_filter(list_transform({_CALLS}, lambda b: CASE WHEN json_valid(b)
                THEN json_extract_string(b, '$.arguments.prompt') END), lambda p: p IS NOT NULL)[1], '') AS call_prompt
FROM tr
""")
def extract_calls(spark, sf_dir):
    t = _transcripts(spark, sf_dir)
    bodies = TR.call_bodies("transcript")
    return t.select("conv_id", F.size(bodies).cast("bigint").alias("n_calls"),
                    F.size(F.filter(bodies, TR.is_json)).cast("bigint").alias("n_json"),
                    TR.call_prompt("transcript").alias("call_prompt"))


@query("format_score", _SC + f"SELECT conv_id, {R6('format')} AS format FROM fs")
def format_score(spark, sf_dir):
    t = _transcripts(spark, sf_dir)
    return t.select("conv_id", r6(TR.format_score("transcript")).alias("format"))


@query("combined_reward", _BUNDLE + f"""
SELECT conv_id, {R6('score')} AS score, {R6('answer_score')} AS answer_score FROM comb
""")
def combined_reward(spark, sf_dir):
    t = _transcripts(spark, sf_dir).join(AD.conv_facts(spark, sf_dir), "conv_id")
    s = TO.transcript_scores(t)
    return s.select("conv_id", r6("score").alias("score"), r6("answer_score").alias("answer_score"))


@query("score_bundle", _BUNDLE + f"""
SELECT conv_id, data_source,
       CASE WHEN data_source IN ('hotpotqa/hotpot_qa', 'bdsaglam/musique', 'xanhho/2WikiMultihopQA')
            THEN {R6('score')} END AS score,
       CASE WHEN data_source IN ('hotpotqa/hotpot_qa', 'bdsaglam/musique', 'xanhho/2WikiMultihopQA')
            THEN {R6('em')} END AS em,
       CASE WHEN data_source IN ('hotpotqa/hotpot_qa', 'bdsaglam/musique', 'xanhho/2WikiMultihopQA')
            THEN {R6('sm')} END AS sm,
       CASE WHEN data_source IN ('hotpotqa/hotpot_qa', 'bdsaglam/musique', 'xanhho/2WikiMultihopQA')
            THEN {R6('f1')} END AS f1,
       CASE WHEN data_source IN ('hotpotqa/hotpot_qa', 'bdsaglam/musique', 'xanhho/2WikiMultihopQA')
            THEN {R6('format')} END AS format
FROM comb
""")
def score_bundle(spark, sf_dir):
    s = _scored(spark, sf_dir)
    return s.select("conv_id", "data_source", *[r6(c).alias(c) for c in ("score", "em", "sm", "f1", "format")])
