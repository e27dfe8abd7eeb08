"""Chat formatting: a finite-state machine over roles and a declarative template.

The template names what stands before and after a turn of each role, and which roles carry loss. Texts are
escaped so that they hold no control string; the escape is undone in reading. Rows of a conversation are sorted by
turn and pass through the machine one by one: nothing but its state is held, so a conversation of any length, or
a third of all rows, takes no more memory; the order of its turns makes it one task's time. Segments come out in order: opening marks, texts and closing marks,
each with its loss flag; their concatenation is the formatted conversation.

Turn order: an optional system turn first, then user and assistant in turn, beginning with the user and ending
with the assistant. Other conversations are formatted all the same and flagged with the first fault.

Defined results: a null text is empty; a null role is the role named by the empty string; a null turn sorts first,
equal turns by role and text; null conv_ids are one conversation; rows with equal values are turns of their own;
columns besides the four are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import partitions


@dataclass(frozen=True)
class Template:
    """Marks before and after a turn's text by role; ``other`` holds the marks of roles not named, with {role} in the first."""

    begin: str = "<s>"
    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("[SYS] ", " [/SYS]\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("[REPLY] ", "</s>")})
    other: tuple[str, str] = ("[ROLE {role}] ", " [/ROLE]")
    loss: frozenset[str] = frozenset({"assistant"})
    escape: str = "\\"

    def controls(self) -> tuple[str, ...]:
        """What must not stand in a text as it is. None but the first character of a control is a first character of any."""
        heads = [self.other[0].split("{role}")[0], self.other[1]]
        return tuple(sorted({x.strip() for x in [self.begin, *heads, *(m for pair in self.marks.values() for m in pair)]}, key=lambda x: (-len(x), x)))


#: From each state, the states that roles lead to. Conversations begin in ``start`` and end well in ``answered``.
ORDER = {"start": {"system": "briefed", "user": "asked"}, "briefed": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}}
SEGMENTS = "conv_id long, turn_no long, part string, role string, text string, loss boolean, fault string"


class Codec:
    """Escaping, writing and reading under a template."""

    def __init__(self, template: Template):
        self.t = template
        e = re.escape(template.escape)
        self.plain = re.compile("|".join([e, *map(re.escape, template.controls()), r"\]"]))
        self.escaped = re.compile(e + "(.)", re.DOTALL)

    def hide(self, text: str) -> str:
        """Every control string and escape gets an escape before it; so does a closing bracket, which ends role names."""
        return self.plain.sub(lambda m: self.t.escape + m[0], text)

    def show(self, text: str) -> str:
        return self.escaped.sub(lambda m: m[1], text)

    def around(self, role: str) -> tuple[str, str]:
        if role in self.t.marks:
            return self.t.marks[role]
        return self.t.other[0].replace("{role}", self.hide(role)), self.t.other[1]

    def read(self, whole: str) -> list[tuple[str, str, tuple[int, int]]]:
        """(role, text, the text's span) of every turn of a formatted conversation; ValueError if it isn't one."""
        if not whole.startswith(self.t.begin):
            raise ValueError("no beginning mark")
        at, out = len(self.t.begin), []
        head = self.t.other[0].split("{role}")
        while at < len(whole):
            role = next((r for r, (a, _) in self.t.marks.items() if whole.startswith(a, at)), None)
            if role is not None:
                at, close = at + len(self.t.marks[role][0]), self.t.marks[role][1]
            elif whole.startswith(head[0], at):
                end = self._find(whole, head[1], at + len(head[0]))
                role, close = self.show(whole[at + len(head[0]) : end]), self.t.other[1]
                at = end + len(head[1])
            else:
                raise ValueError(f"no mark at {at}")
            end = self._find(whole, close, at)
            out.append((role, self.show(whole[at:end]), (at, end)))
            at = end + len(close)
        return out

    def _find(self, whole: str, mark: str, at: int) -> int:
        """Where ``mark`` stands unescaped at or after ``at``."""
        core = mark.strip()
        lead = mark.index(core)
        while True:
            k = whole.find(core, at + lead)
            if k < 0:
                raise ValueError(f"no {core}")
            back = 0
            while k - 1 - back >= at and whole[k - 1 - back] == self.t.escape:
                back += 1
            if back % 2 == 0 and whole.startswith(mark, k - lead):
                return k - lead
            at = k + 1 - lead


def ordered(df: DataFrame, *by: str) -> DataFrame:
    return df.repartition(partitions(df.sparkSession), by[0]).sortWithinPartitions(*by)


def segments(df: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per segment, in order inside a partition: conv_id, turn_no, part (begin, open, text, close), role, text, loss, fault.

    ``fault`` stands on a conversation's last row: null, or the first turn (from 0) that breaks the order.
    """
    codec = Codec(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, n, fault, last, out = object(), "start", 0, None, None, []
        for b in batches:
            for c, r, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                r, t = r or "", t or ""
                if c != now:
                    if last is not None:
                        out.append((*last, fault or (None if state == "answered" else f"{n}: ends {state}")))
                    now, state, n, fault = c, "start", 0, None
                    out.append((c, -1, "begin", None, template.begin, False, None))
                elif last is not None:
                    out.append((*last, None))
                step = ORDER.get(state, {}).get(r)
                if step is None:
                    fault = fault or f"{n}: {r or 'no role'} after {state}"
                    step = {"user": "asked", "assistant": "answered", "system": "briefed"}.get(r, state)
                state = step
                before, after = codec.around(r)
                out.append((c, n, "open", r, before, False, None))
                out.append((c, n, "text", r, codec.hide(t), r in template.loss, None))
                last = (c, n, "close", r, after, False)
                n += 1
                if len(out) >= 4096:
                    yield pack(out)
                    out = []
        if last is not None:
            out.append((*last, fault or (None if state == "answered" else f"{n}: ends {state}")))
        yield pack(out)

    names = ["conv_id", "turn_no", "part", "role", "text", "loss", "fault"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    rows = df.select(F.col(conv).cast("long").alias("c"), F.col(role).cast("string").alias("r"), F.col(text).cast("string").alias("t"), F.col(turn).cast("long").alias("n"))
    return ordered(rows, "c", "n", "r", "t").select("c", "r", "t").mapInArrow(run, SEGMENTS)


def digests(segs: DataFrame, template: Template = Template()) -> DataFrame:
    """Facts of each formatted conversation, read back from its segments as :func:`segments` leaves them.

    The text between two unescaped marks is read under the machine of the reader: marks are recognised as they
    stand in the output, roles and texts are unescaped, and hashes are fed turn by turn.
    """
    codec = Codec(template)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, state = "", [], None

        def fresh(c) -> dict:
            return {"c": c, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "fault": None}

        for b in batches:
            for c, part, text, loss, fault in zip(*(b.column(i).to_pylist() for i in (0, 2, 4, 5, 6)), strict=True):
                if part == "begin":
                    if state is not None:
                        out.append(state)
                    state, held = fresh(c), ""
                    state["size"] += len(text)
                    continue
                held += text
                state["size"] += len(text)
                if loss:
                    shown = codec.show(text)
                    state["chars"] += len(shown)
                    state["loss"].update(shown.encode())
                if part == "close":
                    for role, said, _ in codec.read(template.begin + held):
                        state["n"] += 1
                        state["turns"].update(f"{role}\n{said}\n".encode())
                    held = ""
                    state["fault"] = fault or state["fault"]
                if len(out) >= 2048:
                    yield pack(out)
                    out = []
        if state is not None:
            out.append(state)
        yield pack(out)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "fault"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]

    def pack(found: list[dict]) -> pa.RecordBatch:
        rows = [(x["c"], x["n"], x["turns"].hexdigest(), x["chars"], x["loss"].hexdigest(), x["size"], x["fault"]) for x in found]
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return segs.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, fault string")


def op4_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and one that speaks in control strings, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("x")).select("conv_id", "x.*")
    return digests(segments(rows.unionByName(more))).drop("fault")


#: What op4_chat returns, from the rows alone.
OP4_SQL = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
 h AS (SELECT *, length(regexp_replace(text, '(\\|\[/ROLE\]|\[REPLY\]|\[/INST\]|\[INST\]|\[/SYS\]|\[ROLE|\[SYS\]|</s>|<s>|\])', 'x\1', 'g')) AS hidden,
  CASE role WHEN 'system' THEN 14 WHEN 'user' THEN 15 WHEN 'assistant' THEN 12 ELSE 16 + length(role) END AS marks FROM c)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(hidden + marks))::BIGINT AS formatted_chars FROM h GROUP BY 1"""
