"""Tool-call analysis, scorer routing, loss-mask spans, process-reward
placement and arrival-order balancing (TX-10/11, SC-17, AR-8, WN-17, BS-15)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rlframe.functions import mathans as M
from rlframe.functions import transcript as TR
from rlframe.functions.util import prefix_sum


def code_blocks(text: str | Column) -> Column:
    """TX-10: line-based ``<code>`` extraction. A line starting with
    ``<code>`` opens a block (adding a separator line), ``</code>`` closes
    it, fence lines are skipped; an open block at the end or no code at all
    means no call (empty array)."""
    t = F.col(text) if isinstance(text, str) else text
    lines = F.split(t, "\n", -1)
    st = F.aggregate(lines, F.struct(F.lit("").alias("code"), F.lit(False).alias("on")),
                     lambda acc, ln: F.when(ln.startswith("<code>"),
                                            F.struct(F.concat(acc["code"], F.lit("\n# ========\n")).alias("code"),
                                                     F.lit(True).alias("on")))
                     .when(ln.startswith("</code>"), F.struct(acc["code"].alias("code"), F.lit(False).alias("on")))
                     .when(acc["on"] & ~ln.startswith("```"),
                           F.struct(F.concat(acc["code"], ln, F.lit("\n")).alias("code"), acc["on"].alias("on")))
                     .otherwise(acc))
    return F.when(st["on"] | (F.length(st["code"]) == 0), F.array().cast("array<string>")) \
        .otherwise(F.array(st["code"]))


def call_status(calls: DataFrame, body: str, registry: DataFrame) -> DataFrame:
    """TX-11: classify each call body. ``registry`` is ``(tool_name,
    required array<string>)`` -- small by nature (the tool list), so it is
    broadcast. Status: JSONDecodeError / No tool name / No tool arguments /
    ToolNotFoundError / Invalid tool arguments / ok."""
    b = F.col(body)
    keys = F.json_object_keys(b)
    name = F.get_json_object(b, "$.name")
    args = F.get_json_object(b, "$.arguments")
    d = calls.withColumn("_keys", keys).withColumn("_name", name).withColumn("_args", args)
    d = d.join(F.broadcast(registry.select(F.col("tool_name").alias("_name"), F.col("required").alias("_req"))),
               "_name", "left")
    arg_keys = F.json_object_keys(F.col("_args"))
    status = (F.when(F.col("_keys").isNull(), F.lit("Error: JSONDecodeError"))
               .when(~F.array_contains("_keys", "name"), F.lit("Error: No tool name"))
               .when(~F.array_contains("_keys", "arguments"), F.lit("Error: No tool arguments"))
               .when(F.col("_req").isNull(), F.lit("Error: ToolNotFoundError"))
               .when(arg_keys.isNull() | (F.size(F.array_except("_req", F.coalesce(arg_keys, F.array().cast("array<string>")))) > 0),
                     F.lit("Error: Invalid tool arguments"))
               .otherwise(F.lit("ok")))
    return d.withColumn("status", status).drop("_keys", "_args", "_req").withColumnRenamed("_name", "tool_name")


# Data-source names that select each rule-based scorer.
GSM8K_SOURCES = ("openai/gsm8k",)
MATH_SOURCES = ("lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval")
GEO_SOURCES = ("hiyouga/geometry3k",)
MC_SOURCES = ("Idavidrein/gpqa",)


def routed_score(source: str | Column, solution: str | Column, gt: str | Column) -> Column:
    """SC-17: pick the scorer by data source (prefix rule for ``aime*``);
    sources whose scorer needs a symbolic solver or a code sandbox score NULL."""
    s = F.col(source) if isinstance(source, str) else source
    return (F.when(s.isin(*GSM8K_SOURCES), M.numeric_score(solution, gt, "strict"))
             .when(s.isin(*MATH_SOURCES), M.boxed_math_score(solution, gt))
             .when((s == "math_dapo") | s.startswith("aime"), M.final_answer_score(solution, gt)["score"])
             .when(s.isin(*GEO_SOURCES), M.geo_score(solution, gt))
             .when(s.isin(*MC_SOURCES), M.mc_score(solution, gt)))


def loss_mask_spans(msgs: DataFrame, conv: str, turn: str, role: str, rendered: str) -> DataFrame:
    """AR-8: character spans of assistant messages inside the rendered
    conversation, from cumulative rendered lengths (a window over one
    conversation's turns). Returns (conv, turn, start, end) for assistant
    turns; a loss mask is 1 exactly on these spans."""
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    d = msgs.withColumn("_len", F.length(rendered)) \
            .withColumn("start", F.coalesce(F.sum("_len").over(w), F.lit(0)))
    return d.where(F.col(role) == "assistant").select(conv, turn, "start", (F.col("start") + F.col("_len")).alias("end"))


def place_process_rewards(resp: DataFrame, sample: str, text: str, valid_len: str, rewards: DataFrame,
                          end_tag: str = TR.CALL_CLOSE, tok_len=lambda n: F.floor(n / 4)) -> DataFrame:
    """WN-17: the i-th call end in a response gets the sample's i-th tool
    reward (extra calls get none; positions past the valid length are
    dropped), then every reward is divided by (max |reverse cumulative sum|
    over the batch + 1e-6). Token positions come from ``tok_len`` of the text
    prefix (rough chars/4 by default). Output: (sample, pos, reward)."""
    pieces = F.split(F.col(text), "\\Q" + end_tag + "\\E", -1)
    ends = prefix_sum(F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
                                  lambda p: F.length(p) + len(end_tag)))
    d = resp.select(sample, valid_len, F.posexplode(ends).alias("call_idx", "_end"))
    d = d.join(rewards, [sample, "call_idx"])      # unmatched calls carry no reward
    d = d.withColumn("pos", (tok_len(F.col("_end")) - 1).cast("long")).where(F.col("pos") < F.col(valid_len))
    w = Window.partitionBy(sample).orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_rc", F.sum("reward").over(w))
    mx = d.agg(F.max(F.abs("_rc")).alias("_mx")).withColumn("_k", F.lit(1))
    return (d.withColumn("_k", F.lit(1)).join(F.broadcast(mx), "_k")
             .select(sample, "pos", (F.col("reward") / (F.col("_mx") + F.lit(1e-6))).alias("reward")))


def greedy_assign(df: DataFrame, shard: str, order: str | list[str], length: str, k: int,
                  out: str = "bucket") -> DataFrame:
    """BS-15: within each shard, items in arrival order go to the currently
    least-loaded of k buckets (ties: lowest bucket). Sequential by nature,
    so each shard runs as one pandas group; a shard is one batch being
    balanced, bounded by the batch size."""
    import heapq

    by = [order] if isinstance(order, str) else list(order)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by, kind="stable")
        heap = [(0, b) for b in range(k)]
        out_b = []
        for n in pdf[length].tolist():
            load, b = heapq.heappop(heap)
            out_b.append(b)
            heapq.heappush(heap, (load + int(n), b))
        return pdf.assign(**{out: out_b})

    from pyspark.sql.types import IntegerType, StructField, StructType
    schema = StructType(list(df.schema.fields) + [StructField(out, IntegerType())])
    return df.groupBy(shard).applyInPandas(run, schema)


def tool_schema_valid(schema_json: str | Column) -> Column:
    """TX-12: a tool schema is exactly {name, description, parameters} with a
    non-blank string name, a string description, and parameters exactly
    {type: "object", properties: object, required: list} whose required
    names are all properties. (The reference's extra meta-schema validation
    of ``parameters`` needs a JSON-Schema library and is not applied.)"""
    j = F.col(schema_json) if isinstance(schema_json, str) else schema_json
    v = F.try_parse_json(j)

    def kind(path):
        return F.schema_of_variant(F.variant_get(v, path, "variant"))
    keys = F.array_sort(F.json_object_keys(j))
    params = F.get_json_object(j, "$.parameters")
    pkeys = F.array_sort(F.json_object_keys(params))
    props = F.json_object_keys(F.get_json_object(j, "$.parameters.properties"))
    required = F.from_json(F.get_json_object(j, "$.parameters.required"), "array<string>")
    ok = ((keys == F.array(F.lit("description"), F.lit("name"), F.lit("parameters")))
          & (kind("$.name") == "STRING") & (F.length(F.trim(F.variant_get(v, "$.name", "string"))) > 0)
          & (kind("$.description") == "STRING") & kind("$.parameters").startswith("OBJECT")
          & (pkeys == F.array(F.lit("properties"), F.lit("required"), F.lit("type")))
          & (kind("$.parameters.type") == "STRING") & (F.variant_get(v, "$.parameters.type", "string") == "object")
          & kind("$.parameters.properties").startswith("OBJECT") & kind("$.parameters.required").startswith("ARRAY")
          & (F.size(F.array_except(required, props)) == 0))
    return F.coalesce(ok, F.lit(False))
