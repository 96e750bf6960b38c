"""Chat formatting by a finite-state machine over roles.

A declarative template gives each role its opening and closing string, its
loss flag and the states it may follow. The machine's state is the role of
the last turn. Turns become segments (text, loss); control strings inside a
text are escaped reversibly, so the formatted text can be read back.

Turns are laid out by ranges of (conv_id, turn), so a conversation of any
length is split over tasks; what the machine needs across a cut is the last
role of the partition before, one row per partition.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rlframe.llm.shared import staged

START = "start"
OTHER = "other"


@dataclass(frozen=True)
class Turn:
    opening: str
    closing: str
    loss: bool
    after: frozenset[str]


@dataclass(frozen=True)
class Template:
    """Turns by role; a role the template lacks is named in its opening."""

    turns: dict[str, Turn] = field(default_factory=lambda: {
        "system": Turn("<<SYS>>\n", "\n<</SYS>>\n", False, frozenset({START})),
        "user": Turn("[INST] ", " [/INST]", False, frozenset({START, "system", "assistant"})),
        "assistant": Turn("<s> ", " </s>\n", True, frozenset({"user"})),
    })
    other: Turn = Turn("<<ROLE ", "<</ROLE>>\n", False, frozenset({START, "system", "user", "assistant", OTHER}))
    name_end: str = ">>"

    @property
    def controls(self) -> list[str]:
        marks = [self.name_end] + [m.strip() for t in (*self.turns.values(), self.other) for m in (t.opening, t.closing)]
        return sorted(set(marks), key=lambda m: (-len(m), m))


class Formatter:
    def __init__(self, template: Template = Template()):
        self.template = template
        marks = "|".join(re.escape(m) for m in template.controls)
        self._escape = re.compile(rf"\\|(?=(?:{marks}))(.)", re.S)
        self._open = [(r, t.opening, t.closing) for r, t in template.turns.items()]

    def escape(self, text: str) -> str:
        r"""A backslash becomes two; the first character of a control string
        gets one behind it, so no control string is left."""
        return self._escape.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def step(self, state: str, role: str) -> tuple[str, bool]:
        """Next state, and whether the role may come in this state."""
        known = self.template.turns.get(role)
        return (role if known else OTHER), state in (known or self.template.other).after

    def segments(self, role: str, text: str) -> list[dict]:
        t = self.template.turns.get(role)
        opening = t.opening if t else self.template.other.opening + quote(role, safe="") + self.template.name_end
        closing = (t or self.template.other).closing
        return [{"text": opening, "loss": False}, {"text": self.escape(text), "loss": bool(t and t.loss)},
                {"text": closing, "loss": False}]

    def read_turn(self, formatted: str) -> tuple[str, str]:
        """Role and text of one formatted turn."""
        for role, opening, closing in self._open:
            if formatted.startswith(opening) and formatted.endswith(closing):
                return role, self.unescape(formatted[len(opening):len(formatted) - len(closing)])
        other = self.template.other
        end = formatted.index(self.template.name_end)
        role = unquote(formatted[len(other.opening):end])
        return role, self.unescape(formatted[end + len(self.template.name_end):len(formatted) - len(other.closing)])


OUTPUT = "conv_id long, place long, turn long, order_ok boolean, segments array<struct<text:string,loss:boolean>>"
_SEGMENTS = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))


def _format(template: Template, carry: dict[int, tuple]):
    def run(batches):
        f = Formatter(template)
        last: tuple | None = None
        for batch in batches:
            at = batch.column("_at").to_pylist()
            conv, place, turn, role, text = (batch.column(c).to_pylist() for c in ("conv_id", "place", "turn", "role", "text"))
            ok, out = [], []
            for a, c, r, t in zip(at, conv, role, text):
                if last is None or last[0] != a:
                    last = (a, *carry.get(a, (None, None, False)))
                state = last[2] if last[3] and last[1] == c else START
                state, good = f.step(state, r)
                last = (a, c, state, True)
                ok.append(good)
                out.append(f.segments(r, t))
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(place, pa.int64()), pa.array(turn, pa.int64()),
                                              pa.array(ok, pa.bool_()), pa.array(out, _SEGMENTS)],
                                             names=["conv_id", "place", "turn", "order_ok", "segments"])
    return run


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per turn: conv_id, place (ascending within a conversation),
    turn, order_ok (the machine allows the turn here), segments.

    Null texts and roles are empty, an unknown role is kept by name; a null
    conv_id is one conversation, a null turn comes first, equal turns follow
    role and text. Every row gives a turn, valid or not; an empty text gives
    an empty segment; an empty table no rows. Other columns are ignored."""
    spark = turns.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    key = ["conv_id", "turn", "role", F.xxhash64("text")]
    laid = staged(rows.repartitionByRange(n, *key).sortWithinPartitions(*key, "text")
                  .withColumn("_at", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "turns")
    f = Formatter(template)
    ends = laid.groupBy("_at").agg(F.max_by(F.struct("conv_id", "role"), "place").alias("end")).orderBy("_at").collect()
    carry = {}
    for before, here in zip(ends[:-1], ends[1:]):
        carry[here["_at"]] = (before.end.conv_id, f.step(START, before.end.role)[0], True)
    return laid.repartition(n, "_at").sortWithinPartitions("_at", "place").mapInArrow(_format(template, carry), OUTPUT)
