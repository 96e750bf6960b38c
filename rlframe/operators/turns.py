"""Multi-turn interaction logs as table jobs (TX-5..18).

The reference runs a live loop: generate, parse the tool call, call the
tool, append, repeat. Here the loop's *decisions* run over a logged table
``(sample, turn, response, tool_response)``: every per-turn rule is a row
expression, the running state (prompt growth, history) is a window over the
sample's earlier turns (bounded by the number of turns), and the stop turn
is a grouped ``min``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rlframe.functions.util import let

from rlframe.functions import transcript as TR

EOS = "<|im_end|>"
MAX_TURNS_ANSWER = "Maximum turns reached without final answer"
CONTEXT_ANSWER = "Maximum context length exceeded"


def json_dumps_ascii(s: str | Column) -> Column:
    """A JSON string literal with ASCII-only escapes (\\uXXXX, lower-case hex),
    the default of the reference's JSON writer."""
    x = F.col(s) if isinstance(s, str) else s
    chars = F.split(x, "")
    simple = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}

    def esc(c):
        code = F.ascii(c)
        out = F.when(F.lit(False), c)
        for k, v in simple.items():
            out = out.when(c == k, F.lit(v))
        u16 = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        uesc = F.when(F.length(u16) == 4, F.concat(F.lit("\\u"), u16)).otherwise(
            F.concat(F.lit("\\u"), F.substring(u16, 1, 4), F.lit("\\u"), F.substring(u16, 5, 4)))
        return out.when((code < 32) | (code > 126), uesc).otherwise(c)
    body = F.array_join(F.transform(chars, esc), "")
    return F.concat(F.lit('"'), F.when(x == "", F.lit("")).otherwise(body), F.lit('"'))


def wrap_plain_calls(text: str | Column) -> Column:
    """TX-5: call bodies that are not JSON become
    ``{"name": "prompt", "arguments": {"prompt": <stripped body>}}``."""
    t = F.col(text) if isinstance(text, str) else text
    bodies = TR.call_bodies(t)
    pieces = F.split(t, r"(?s)<interaction_prompt>.*?</interaction_prompt>", -1)
    fixed = F.transform(bodies, lambda b: F.when(TR.is_json(TR.py_strip(b)),
                                                 F.concat(F.lit(TR.CALL_OPEN), b, F.lit(TR.CALL_CLOSE)))
                        .otherwise(F.concat(F.lit(TR.CALL_OPEN + "\n"),
                                            F.lit('{"name": "prompt", "arguments": {"prompt": '),
                                            json_dumps_ascii(TR.py_strip(b)), F.lit("}}"),
                                            F.lit("\n" + TR.CALL_CLOSE))))
    joined = F.concat(F.try_element_at(pieces, F.lit(1)), F.array_join(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(bodies), F.lit(1))),
                    lambda i: F.when(i <= F.size(bodies),
                                     F.concat(F.element_at(fixed, i), F.element_at(pieces, i + 1)))
                    .otherwise(F.lit(""))), ""))
    return F.when(F.size(bodies) == 0, t).otherwise(joined)


def process_call(text: str | Column) -> Column:
    """TX-6: wrap plain calls, cut after the first call end, append EOS;
    struct(processed, has_call)."""
    w = wrap_plain_calls(text)
    has = F.instr(w, TR.CALL_OPEN) > 0
    cut = F.when(F.instr(w, TR.CALL_CLOSE) > 0,
                 F.concat(F.substring_index(w, TR.CALL_CLOSE, 1), F.lit(TR.CALL_CLOSE))).otherwise(w)
    return F.struct(F.concat(F.when(has, cut).otherwise(w), F.lit(EOS)).alias("processed"), has.alias("has_call"))


def first_answer(text: str | Column) -> Column:
    """First ``<answer>`` body, stripped; '' when absent (inference variant)."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(TR.extract_answer(t), F.lit(""))


def tool_result(resp: str | Column) -> Column:
    """TX-8: ``results[0]`` of the first response block's JSON, else of the
    whole text as JSON, else ''."""
    r = F.col(resp) if isinstance(resp, str) else resp
    block = F.when(r.rlike(TR.RESP_RE), TR.py_strip(F.regexp_extract(r, TR.RESP_RE, 1)))
    return F.coalesce(F.get_json_object(block, "$.results[0]"), F.get_json_object(r, "$.results[0]"), F.lit(""))


def run_turns(turns: DataFrame, sample: str, turn: str, response: str, tool_response: str,
              prompt_chars: str, max_turns: int, max_tokens: int, max_context: int) -> DataFrame:
    """TX-16/TX-17: decide, per sample, where the interaction stops and what
    the final answer is.

    A turn stops the sample when its estimated context (grown prompt chars
    // 4) plus ``max_tokens`` exceeds ``max_context`` (answer: the fixed
    context message) or when its processed response has no complete call
    block (answer: its first <answer>, '' if none). Samples that never
    stop within ``max_turns`` get the fixed max-turns answer.
    """
    pc = process_call(response)
    d = turns.where(F.col(turn) < max_turns).withColumn("_pc", pc)
    grow = F.length("_pc.processed") + F.coalesce(F.length(tool_response), F.lit(0))
    w = Window.partitionBy(sample).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_before", F.col(prompt_chars) + F.coalesce(F.sum(grow).over(w), F.lit(0)))
    exceeded = F.floor(F.col("_before") / 4) + F.lit(max_tokens) > F.lit(max_context)
    complete_call = F.size(TR.call_bodies("_pc.processed")) > 0
    d = d.withColumn("_exceeded", exceeded).withColumn("_stop", exceeded | ~complete_call)
    ans = F.when(F.col("_exceeded"), F.lit(CONTEXT_ANSWER)).otherwise(first_answer("_pc.processed"))
    stops = (d.where("_stop")
              .groupBy(sample).agg(F.min_by(F.struct(F.col(turn).alias("t"), ans.alias("a"),
                                                     F.col("_exceeded").alias("x")), F.col(turn)).alias("_s")))
    counts = d.groupBy(sample).agg(F.count(F.lit(1)).alias("_n"))
    out = counts.join(stops, sample, "left")
    return out.select(
        sample,
        F.coalesce(F.col("_s.a"), F.lit(MAX_TURNS_ANSWER)).alias("final_answer"),
        F.coalesce(F.col("_s.t") + 1, F.col("_n")).cast("int").alias("turns_used"),
        F.when(F.col("_s.x"), F.lit("context")).when(F.col("_s.t").isNotNull(), F.lit("answer"))
         .otherwise(F.lit("max_turns")).alias("stop_reason"))


def history(turns: DataFrame, sample: str, turn: str, response: str, tool_response: str) -> DataFrame:
    """TX-13/TX-14: the tool's message history grows by a (user, assistant)
    pair only on turns whose response yields a call prompt; the request for
    a turn is system + earlier valid pairs + the current prompt."""
    prompt = TR.call_prompt(response)
    d = turns.withColumn("_p", prompt).withColumn("_ok", (F.col("_p") != "").cast("int"))
    w = Window.partitionBy(sample).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return d.select(sample, turn, "_p",
                    (2 * F.coalesce(F.sum("_ok").over(w), F.lit(0))).alias("n_history"),
                    (F.lit(2) + 2 * F.coalesce(F.sum("_ok").over(w), F.lit(0))).alias("n_request"),
                    tool_result(tool_response).alias("tool_result")).withColumnRenamed("_p", "call_prompt")


def reexpand(active_results: DataFrame, all_keys: DataFrame, key: list[str], defaults: dict) -> DataFrame:
    """TX-18: put per-active results back at every sample, defaults elsewhere."""
    j = all_keys.join(active_results, key, "left")
    return j.fillna(defaults)


def fenced_code(text: str | Column, fence: str = "```python", separator: str = "# ========") -> Column:
    """TX-22: the lines of all blocks between a ``fence`` line and the next
    closing fence line, each block behind a separator line; NULL without a
    block or when the last one is not closed."""
    t = F.col(text) if isinstance(text, str) else text
    lines = F.split(t, "\n", -1)

    def mark(ln):  # 1 opens, 2 closes, 0 is any other line
        return F.when(ln.startswith(fence) | ln.endswith(fence), 1).when(ln.startswith("```"), 2).otherwise(0)

    def body(x):
        opened = F.exists(x, lambda m: m == 1)
        # whether each line is inside: the last mark up to it opens
        state = F.aggregate(x, F.struct(F.lit(0).alias("on"), F.lit("").alias("flags")), lambda s, m: let(
            F.when(m == 1, 1).when(m == 2, 0).otherwise(s["on"]), lambda on: F.struct(
                on.alias("on"), F.concat(s["flags"], F.when(m == 1, "o").when((m == 0) & (on == 1), "i").otherwise("-")).alias("flags"))))
        return let(state, lambda s: F.when(opened & (s["on"] == 0), s["flags"]))

    def code(flags):
        pieces = F.zip_with(lines, F.split(flags, ""), lambda ln, f: F.when(f == "o", F.lit(f"\n{separator}\n"))
                            .when(f == "i", F.concat(ln, F.lit("\n"))).otherwise(F.lit("")))
        return F.when(flags.isNotNull(), F.array_join(pieces, ""))
    return let(body(F.transform(lines, mark)), code)
