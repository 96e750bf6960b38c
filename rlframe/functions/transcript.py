"""Transcript parsing as Column expressions (TX-2..9, TX-21).

Python's ``re`` semantics are reproduced explicitly: ``(?s)`` for DOTALL,
``(?U)`` for Unicode classes, and ``(?=\\n?\\z)`` for Python's ``$`` (end of
string, or before one final newline).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must match the reference: chat markers and tags.
IM_START = "<|im_start|>"
IM_END = "<|im_end|>"
THINK_OPEN, THINK_CLOSE = "<think>", "</think>"
ANSWER_OPEN, ANSWER_CLOSE = "<answer>", "</answer>"
CALL_OPEN, CALL_CLOSE = "<interaction_prompt>", "</interaction_prompt>"
RESP_OPEN, RESP_CLOSE = "<interaction_response>", "</interaction_response>"

ASSISTANT_BLOCK_RE = r"(?s)<\|im_start\|>assistant\n(.*?)<\|im_end\|>"
ANSWER_RE = r"(?s)<answer>(.*?)</answer>"
CALL_RE = r"(?s)<interaction_prompt>(.*?)</interaction_prompt>"
RESP_RE = r"(?s)<interaction_response>(.*?)</interaction_response>"
PY_END = r"(?=\n?\z)"
INTERMEDIATE_RE = (r"(?sU)^<think>(.*?)</think>(\s*)<interaction_prompt>(.*?)</interaction_prompt>"
                   + PY_END)
THINK_ANSWER_RE = r"(?s)^<think>(.*?)</think>(.*?)<answer>(.*?)</answer>" + PY_END


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(x: str | Column) -> Column:
    """Python ``str.strip()`` (Unicode whitespace at both ends)."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+\z", "")


def count_sub(s: str | Column, sub: str) -> Column:
    """Non-overlapping occurrences of a literal substring."""
    s = _c(s)
    return ((F.length(s) - F.length(F.replace(s, F.lit(sub), F.lit("")))) / F.lit(len(sub))).cast("int")


def assistant_blocks(t: str | Column) -> Column:
    return F.regexp_extract_all(_c(t), F.lit(ASSISTANT_BLOCK_RE), 1)


def extract_answer(s: str | Column) -> Column:
    """First <answer> body, stripped; NULL when there is no answer tag."""
    s = _c(s)
    return F.when(s.rlike(ANSWER_RE), py_strip(F.regexp_extract(s, ANSWER_RE, 1)))


def has_answer(s: str | Column) -> Column:
    a = extract_answer(s)
    return F.coalesce(a.isNotNull() & (a != ""), F.lit(False))


def call_bodies(s: str | Column) -> Column:
    return F.regexp_extract_all(_c(s), F.lit(CALL_RE), 1)


def is_json(x: Column) -> Column:
    """True when the text parses as one JSON value."""
    return F.try_parse_json(x).isNotNull() | (F.trim(x) == "null")


def call_prompt(s: str | Column) -> Column:
    """First call body that is a JSON object whose ``arguments`` object has a
    ``prompt``; '' when none (TX-7)."""
    bodies = call_bodies(s)
    prompts = F.transform(bodies, lambda b: F.get_json_object(b, "$.arguments.prompt"))
    return F.coalesce(F.try_element_at(F.filter(prompts, lambda p: p.isNotNull()), F.lit(1)), F.lit(""))


def format_score(t: str | Column) -> Column:
    """SC-12: +0.4 per well-formed intermediate block, last block +0.25 for a
    non-empty answer, +0.25 non-empty content, +0.1 full think/answer form.
    No blocks -> 0. Additions happen in the reference's order so the double
    result is bit-identical."""
    return format_score_from_blocks(assistant_blocks(t), _c(t))


def format_score_from_blocks(blocks: Column, t: Column) -> Column:
    """:func:`format_score` given the already extracted assistant blocks."""
    n = F.size(blocks)

    def good(b):
        return ((count_sub(b, THINK_OPEN) == 1) & (count_sub(b, THINK_CLOSE) == 1)
                & (count_sub(b, CALL_OPEN) == 1) & (count_sub(b, CALL_CLOSE) == 1)
                & b.rlike(INTERMEDIATE_RE))
    mid = F.aggregate(F.slice(blocks, 1, F.greatest(n - 1, F.lit(0))), F.lit(0.0),
                      lambda acc, b: acc + F.when(good(b), F.lit(0.4)).otherwise(F.lit(0.0)))
    last = F.try_element_at(blocks, F.lit(-1))
    ans = extract_answer(last)
    with_answer = (mid + F.lit(0.25)
                   + F.when(F.length(py_strip(ans)) > 0, F.lit(0.25)).otherwise(F.lit(0.0))
                   + F.when(last.rlike(THINK_ANSWER_RE), F.lit(0.1)).otherwise(F.lit(0.0)))
    score = F.when(n == 0, F.lit(0.0)).when(has_answer(last), with_answer).otherwise(mid)
    return F.when(t.isNull(), F.lit(0.0)).otherwise(score)


def last_answer(t: str | Column) -> Column:
    """Answer of the last assistant block (NULL if none)."""
    return extract_answer(F.try_element_at(assistant_blocks(t), F.lit(-1)))


def combined_reward(fmt: Column, answer_score: Column, t: str | Column) -> Column:
    """SC-15: f = min(format, 1); f == 1 -> -1 + f + answer, else -1 + f."""
    f = F.least(fmt, F.lit(1.0))
    r = F.when(f == 1.0, F.lit(-1.0) + f + answer_score).otherwise(F.lit(-1.0) + f)
    return F.when(_c(t).isNull(), F.lit(0.0)).otherwise(r)


def clip_tool_response(x: Column, max_len: int) -> Column:
    """Clip to ``max_len`` characters and append '...' when longer (TX-9)."""
    return F.when(F.length(x) > max_len, F.concat(F.substring(x, 1, max_len), F.lit("..."))).otherwise(x)


def format_tool_responses(responses: Column, max_len: int) -> Column:
    """TX-9: tool responses as a user turn that hands back to the assistant."""
    parts = F.transform(responses, lambda r: F.concat(F.lit(RESP_OPEN + "\n"), clip_tool_response(r, max_len),
                                                      F.lit("\n" + RESP_CLOSE)))
    return F.concat(F.lit(IM_END + "\n" + IM_START + "user\n"), F.array_join(parts, "\n"),
                    F.lit(IM_END + "\n" + IM_START + "assistant\n" + THINK_OPEN + "\n"))


def cut_at(x: Column, marker: str, append: str | None = None) -> Column:
    """Text up to the first ``marker`` (TX-21); append ``append`` if the
    result does not already end with it."""
    cut = F.substring_index(x, marker, 1)
    if append is None:
        return cut
    return F.when(cut.endswith(F.lit(append)), cut).otherwise(F.concat(cut, F.lit(append)))
