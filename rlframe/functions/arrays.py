"""Token-sequence operators on array columns (AR-1..11, AR-14).

Sequences are ragged ``array<bigint>``; padding exists only where a
downstream consumer needs fixed width. All functions are higher-order
array expressions evaluated in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rlframe.functions.util import let, prefix_sum


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def pad_to(ids: str | Column, n: int, pad: int, left: bool = False) -> Column:
    """AR-1: pad to length ``n`` (no truncation; longer stays longer)."""
    a = _c(ids)
    fill = F.array_repeat(F.lit(pad).cast("long"), F.greatest(F.lit(n) - F.size(a), F.lit(0)))
    return F.concat(fill, a) if left else F.concat(a, fill)


def truncate_to(ids: str | Column, n: int, side: str = "right") -> Column:
    """AR-1: keep the first (``right`` truncation) or last (``left``) n items;
    ``error`` fails the job when longer."""
    a = _c(ids)
    if side == "right":
        return F.slice(a, 1, n)
    if side == "left":
        return F.when(F.size(a) > n, F.slice(a, -n, n)).otherwise(a)
    if side == "error":
        return F.when(F.size(a) > n, F.raise_error(F.lit("sequence longer than max length"))
                      .cast("array<bigint>")).otherwise(a)
    raise ValueError(side)


def attention_mask(ids: str | Column, pad: int) -> Column:
    return F.transform(_c(ids), lambda x: F.when(x == pad, F.lit(0)).otherwise(F.lit(1)))


def strip_left_pad(ids: str | Column, mask: str | Column) -> Column:
    """AR-2: drop left padding: the last sum(mask) items."""
    m = F.aggregate(_c(mask), F.lit(0), lambda acc, x: acc + x)
    return F.when(m == 0, F.array().cast("array<bigint>")).otherwise(F.slice(_c(ids), -m, m))


def move_pads(ids: str | Column, pad: int, left: bool = True) -> Column:
    """AR-3: stable move of pad tokens to one side (width kept)."""
    a = _c(ids)
    keep = F.filter(a, lambda x: x != pad)
    pads = F.filter(a, lambda x: x == pad)
    return F.concat(pads, keep) if left else F.concat(keep, pads)


def position_ids(mask: str | Column, variant: str = "agent") -> Column:
    """AR-4: agent ``(cumsum(mask)-1)*mask``; framework ``max(cumsum-1, 0)``
    (they differ on right padding). Prefix sums by an O(n log n) scan."""
    m = _c(mask)
    if variant == "agent":
        return let(m, lambda mm: F.zip_with(prefix_sum(mm), mm, lambda c, x: (c - 1) * x))
    return F.transform(prefix_sum(m), lambda c: F.greatest(c - 1, F.lit(0)))


def response_mask(ids: str | Column, eos: list[int]) -> Column:
    """AR-5: 1 up to and including the first EOS token, 0 after."""
    a = _c(ids)
    first = F.array_min(F.filter(F.transform(a, lambda x, i: F.when(x.isin(*eos), i)), lambda h: h.isNotNull()))
    return let(F.struct(a.alias("a"), first.alias("f")), lambda s: F.transform(
        s["a"], lambda x, i: F.when(s["f"].isNull() | (i <= s["f"]), F.lit(1)).otherwise(F.lit(0))))


def action_mask(model_lens: str | Column, tool_lens: str | Column, limit: int | Column) -> Column:
    """AR-6: per turn ``m`` ones (model tokens) then ``t`` zeros (tool tokens),
    concatenated over turns and clipped to ``limit``."""
    z = F.arrays_zip(_c(model_lens).alias("m"), _c(tool_lens).alias("t"))
    segs = F.transform(z, lambda s: F.concat(F.array_repeat(F.lit(1), F.coalesce(s["m"], F.lit(0)).cast("int")),
                                            F.array_repeat(F.lit(0), F.coalesce(s["t"], F.lit(0)).cast("int"))))
    lim = limit if isinstance(limit, Column) else F.lit(limit)
    return F.slice(F.flatten(segs), 1, lim)


def sft_sequence(prompt: str | Column, response: str | Column, eos: int, pad: int, max_len: int,
                 truncation: str = "right") -> Column:
    """AR-9: prompt + response + EOS, padded (right) or truncated to
    ``max_len``. The loss mask is the attention mask with the first
    ``prompt_len - 1`` positions zeroed (when prompt_len > 1) and the last
    response position zeroed. Returns struct(input_ids, attention_mask,
    loss_mask)."""
    p, r = _c(prompt), _c(response)
    ids = F.concat(p, F.concat(r, F.array(F.lit(eos).cast("long"))))
    mask = F.transform(ids, lambda x: F.lit(1))
    if truncation == "error":
        ids = F.when(F.size(ids) > max_len, F.raise_error(F.lit("sequence longer than max_length"))
                     .cast("array<bigint>")).otherwise(ids)
    side = "left" if truncation == "left" else "right"
    t_ids = pad_to(truncate_to(ids, max_len, side), max_len, pad)
    t_mask = pad_to(truncate_to(mask, max_len, side), max_len, 0)
    lp = F.size(p)
    total = F.size(p) + F.size(r) + 1
    spec = F.struct(t_mask.alias("m"), lp.alias("lp"), total.alias("tot"))
    loss = let(spec, lambda s: F.transform(s["m"], lambda x, i: F.when(
        ((s["lp"] > 1) & (i < F.least(s["lp"], F.lit(max_len)) - 1))
        | (i == F.least(s["tot"], F.lit(max_len)) - 1), F.lit(0)).otherwise(x)))
    return F.struct(t_ids.alias("input_ids"), t_mask.alias("attention_mask"), loss.alias("loss_mask"))


def pair_ids(chosen: str | Column, rejected: str | Column, pad: int, max_len: int) -> Column:
    """AR-10: [chosen, rejected] each right-padded/truncated to max_len."""
    return F.array(pad_to(F.slice(_c(chosen), 1, max_len), max_len, pad),
                   pad_to(F.slice(_c(rejected), 1, max_len), max_len, pad))


def log_softmax_at(logits: str | Column, label: str | Column) -> Column:
    """AR-11: log p(label) from logits (max-shifted log-sum-exp)."""
    from rlframe.operators.losses import logprob_of_label
    return logprob_of_label(logits, label)


def entropy(logits: str | Column) -> Column:
    from rlframe.operators.losses import entropy_from_logits
    return entropy_from_logits(logits)


def cut_after_first_block(text: str | Column, end_tag: str) -> Column:
    """AR-14 (text form): cut right after the first complete block; else unchanged."""
    t = _c(text)
    return F.when(F.instr(t, end_tag) > 0, F.concat(F.substring_index(t, end_tag, 1), F.lit(end_tag))).otherwise(t)


def message_masks(roles: str | Column, prefix_lens: str | Column, body_lens: str | Column,
                  suffix_lens: str | Column, max_len: int) -> Column:
    """AR-13: build the loss mask of a running multi-turn sequence: each
    message contributes its role prefix (mask 0), body and end marker (mask 1
    for assistant messages, 0 otherwise); the sequence is clipped to
    ``max_len``. Position ids are contiguous (the reference restarts them at
    message joins)."""
    z = F.arrays_zip(_c(roles).alias("r"), _c(prefix_lens).alias("p"), _c(body_lens).alias("b"),
                     _c(suffix_lens).alias("s"))
    segs = F.transform(z, lambda m: F.concat(
        F.array_repeat(F.lit(0), m["p"].cast("int")),
        F.array_repeat(F.when(m["r"] == "assistant", F.lit(1)).otherwise(F.lit(0)),
                       (m["b"] + m["s"]).cast("int"))))
    return F.slice(F.flatten(segs), 1, max_len)
