"""Quality rules over repetition, by suffix arrays of words.

The words of a text are sorted by suffix with prefix doubling; neighbours in
that order give the longest-common-prefix intervals, whose deepest interval
over a position p is the longest substring from p that occurs again. A text
is kept if the union of all repeats of ``min_repeat`` words or more covers a
bounded share of its words and its longest repeat is bounded.

Many texts are sorted in one array (ranks never compare words of different
texts); memory is bounded by ``WORDS_AT_ONCE`` or one longest text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rlframe.llm.shared import WHITE, arrow_batch, offsets, slices, text_bytes, word_codes

BYTES_AT_ONCE = 1_000_000

_KEEP_LEADING = WHITE + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    """Production limits; base limits are the fixed part of the verdict."""

    window: int = 5
    min_words: int = 10
    max_window_percent: int = 20
    min_repeat: int = 8
    max_cover_percent: int = 20
    max_longest: int = 60


SCHEMA = pa.schema([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()),
    ("kept", pa.bool_()), ("cover_words", pa.int64()), ("longest_repeat", pa.int64()),
])


def ranks_by_doubling(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order and, for each h = 1, 2, 4, ..., ranks by the first h words.

    ``ends[i]`` is the end of the text that holds position i. Two positions
    share rank at h iff they lie in one text and their next h words are equal
    and whole; only positions that still share a rank are sorted again."""
    n = len(codes)
    order = np.lexsort((codes, ends))
    key_a, key_b = ends[order], codes[order]
    new = np.ones(n, bool)
    new[1:] = (key_a[1:] != key_a[:-1]) | (key_b[1:] != key_b[:-1])
    starts = np.flatnonzero(new)
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    levels = [rank.astype(np.int32)]
    h = 1
    tied = _tied_slots(new)
    while len(tied):
        pos = order[tied]
        nxt = pos + h
        tail = np.where(nxt < ends[pos], rank[np.minimum(nxt, n - 1)] + 1, 0)
        base = rank[pos]
        by = np.lexsort((tail, base))
        pos, base, tail = pos[by], base[by], tail[by]
        order[tied] = pos  # slots of one rank are consecutive and in order
        first = np.ones(len(pos), bool)
        first[1:] = (base[1:] != base[:-1]) | (tail[1:] != tail[:-1])
        at = np.flatnonzero(first)
        size = np.diff(np.append(at, len(pos)))
        rank[pos] = np.repeat(tied[at], size)
        levels.append(rank.astype(np.int32))
        tied = tied[np.repeat(size, size) > 1]
        h *= 2
    return order, levels


def _tied_slots(new: np.ndarray) -> np.ndarray:
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(new)))
    return np.flatnonzero(np.repeat(size, size) > 1)


def longest_again(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each word position the length of the longest substring that starts
    there and occurs at another place of the same text."""
    n = len(codes)
    longest = np.zeros(n + 1, np.int64)
    if n == 0:
        return longest[:0]
    ends = np.repeat(offsets(counts)[1:], counts)
    order, levels = ranks_by_doubling(codes, ends)
    a, b = order[:-1], order[1:]
    alike = levels[0][a] == levels[0][b]
    a, b = a[alike], b[alike]
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        pa_, pb = a + common, b + common
        inside = (pa_ < ends[a]) & (pb < ends[b])
        same = np.zeros(len(a), bool)
        same[inside] = levels[k][pa_[inside]] == levels[k][pb[inside]]
        common[same] += 1 << k
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest[:n]


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in the union of the spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:n]) > 0


def profile(texts: list[bytes], rules: Rules) -> dict[str, list | np.ndarray]:
    """Columns of ``SCHEMA`` for some texts."""
    docs = [t.split() for t in texts]
    codes, counts = word_codes(docs)
    at = offsets(counts)
    n = len(codes)
    longest = longest_again(codes, counts)

    def words_in(spans: np.ndarray, lengths) -> np.ndarray:
        return np.diff(offsets(covered(spans, lengths, n).astype(np.int64))[at]) if n else np.zeros(len(docs), np.int64)

    again = np.flatnonzero(longest >= rules.window)
    repeat_words = words_in(again, np.int64(rules.window))
    spans = np.flatnonzero(longest >= rules.min_repeat)
    cover = words_in(spans, longest[spans])
    top = np.zeros(len(docs), np.int64)
    np.maximum.at(top, np.repeat(np.arange(len(docs)), counts), longest)
    failed = (counts < rules.min_words) | (100 * repeat_words > rules.max_window_percent * counts)
    good = (100 * cover <= rules.max_cover_percent * counts) & (top <= rules.max_longest)
    dup = []
    for t in texts:
        lines = [x for x in t.split(b"\n") if x.strip(WHITE)]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": counts, "word_chars": [len(t.translate(None, _KEEP_LEADING)) for t in texts],
        "n_symbols": [len(t) - len(t.translate(None, _SYMBOLS)) for t in texts], "n_dup_lines": dup,
        "n_repeat_words": repeat_words, "base_failed": failed, "kept": ~failed & good,
        "cover_words": cover, "longest_repeat": top,
    }


def repetition_profile(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """``docs`` with the columns of ``SCHEMA`` in place of the text column.

    Null and empty texts have no words: all counts 0, base_failed, not kept.
    Columns of the input that clash with result columns are dropped; others
    stay. One row out per row in, whatever repeats; an empty table gives none."""
    keep = [c for c in docs.columns if c != text and c not in SCHEMA.names]
    source = docs.select(*[docs[c] for c in keep], text_bytes(text).alias("_text"))
    out_schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema),
                            "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                            "base_failed boolean, kept boolean, cover_words long, longest_repeat long"])

    def run(batches):
        for batch in batches:
            texts = batch.column("_text").to_pylist()
            for lo, hi in slices([len(t) for t in texts], BYTES_AT_ONCE):
                cols = arrow_batch(SCHEMA, **profile(texts[lo:hi], rules))
                part = batch.slice(lo, hi - lo).select(keep)
                yield pa.RecordBatch.from_arrays([*part.columns, *cols.columns], names=[*keep, *SCHEMA.names])

    return source.mapInArrow(run, out_schema)
