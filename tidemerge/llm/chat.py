"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string. Successive prefixes of a conversation are rendered and consecutive
outputs compared: what is new belongs to the last turn, which locates it without knowing the template; an output that does not
begin with the one before shows a template that rewrites history, and then all turns are located anew in the final output. The text
inside a turn is found by two probes whose texts differ in their first character. The loss mask covers the assistant's texts.

Nothing is assumed of a plain function: every prefix is rendered whole, so a conversation is held whole and costs as many renderings
as it has turns. A ``Template`` may declare that it only appends (what it puts out for a turn depends on no other turn); then the
prefixes are rendered from the last turn on, conversations are streamed and may be of any length, and the declaration is held against
what is rendered. Rows are sorted by conversation and turn within partitions; one conversation is one task's work, because its digests
are sequential.

Defined results: null text, role or both count as empty; ties in turn go by role, then text; repeated rows are turns of their own.
A null conversation id is a conversation. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

Turn = tuple[str, str]
Render = Callable[[list[Turn]], str]

_SIGNS = re.compile(r"[\\#<]")
_ROLE_SIGNS = re.compile(r"[\\#<:\n]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:\\.|[^\\:])*):\n((?:\\.|[^\\<])*)</turn>\n", re.S)
ASSISTANT = "assistant"


def escape(text: str) -> str:
    """A backslash before each backslash, # and <, so that neither ### nor </turn> can stand in a text."""
    return _SIGNS.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def marked_turns(turns: list[Turn]) -> str:
    """The built-in template."""
    return "".join(f"### {_ROLE_SIGNS.sub(r'\\\g<0>', role)}:\n{escape(text)}</turn>\n" for role, text in turns)


def parse(output: str) -> list[Turn]:
    """The turns read back from what marked_turns gave."""
    turns, at = [], 0
    while at < len(output):
        m = _TURN.match(output, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


@dataclass(frozen=True)
class Template:
    """render: turns to output. unescape: from a text as it stands in the output to the text that was given. read: from an output to
    its turns, where there is a reader; without one, texts are read back from where they were located, and roles are those given.
    appends: what render puts out for a turn depends on no other turn."""

    render: Render
    unescape: Callable[[str], str] = str
    read: Callable[[str], list[Turn]] | None = None
    appends: bool = False

    @staticmethod
    def of(given: Render | Template) -> Template:
        return given if isinstance(given, Template) else Template(given)


MARKED = Template(marked_turns, unescape, parse, appends=True)


@dataclass
class Rendered:
    """output: of all turns; spans: of each turn; texts: where each turn's text lies; rewrote: turns at which the template changed
    what it had put out before. After a rewriting a turn's span is that of its text."""

    output: str = ""
    spans: list[tuple[int, int]] = field(default_factory=list)
    texts: list[tuple[int, int]] = field(default_factory=list)
    rewrote: list[int] = field(default_factory=list)


def _shared(a: str, b: str) -> int:
    """Length of the common beginning."""
    if a == b[: len(a)]:
        return len(a)
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def _text_at(turns: list[Turn], k: int, whole: str, render: Render) -> tuple[int, int]:
    """Where the text of turn k lies in whole, the output of turns; an empty span if the output doesn't depend on it."""
    role = turns[k][0]
    a, b = (render([*turns[:k], (role, probe), *turns[k + 1 :]]) for probe in "ab")
    at = _shared(a, b)
    return at, at + (max(0, len(whole) - len(a) + 1) if a != b else 0)


def render_incrementally(turns: list[Turn], template: Render | Template) -> Rendered:
    """Render every prefix of turns and locate each turn in the last output."""
    render, out = Template.of(template).render, Rendered()
    for k in range(len(turns)):
        now = render(turns[: k + 1])
        start = _shared(out.output, now)
        if start < len(out.output):
            out.rewrote.append(k)
        out.output = now
        out.spans.append((start, len(now)))
        if not out.rewrote:
            out.texts.append(_text_at(turns[: k + 1], k, now, render))
    if out.rewrote:
        out.texts = [_text_at(turns, k, out.output, render) for k in range(len(turns))]
        out.spans = out.texts.copy()
    return out


class Conversation:
    """One conversation, fed turn by turn. If the template appends, it is worked off every ``block`` turns, which bounds memory and
    changes no result; else when it ends."""

    def __init__(self, template: Template, block: int):
        self.template, self.block = template, block if template.appends else None
        self.context: list[Turn] = []
        self.held: list[Turn] = []
        self.turns = self.chars = self.loss = self.rewrote = self.unread = 0
        self.read, self.learned = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str) -> None:
        self.held.append((role, text))
        if len(self.held) == self.block:
            self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        skip = len(self.context)
        done = render_incrementally([*self.context, *self.held], self.template)
        begin = done.spans[skip][0] if skip else 0
        if self.template.appends and done.output[begin:] != self.template.render(self.held):
            raise ValueError("the template is declared to append, but what it puts out depends on other turns")
        self.chars += len(done.output) - begin
        self.rewrote += sum(k >= skip for k in done.rewrote)
        located = [self.template.unescape(done.output[s:e]) for s, e in done.texts[skip:]]
        got = self.template.read(done.output[begin:]) if self.template.read else [(role, text) for (role, _), text in zip(self.held, located, strict=True)]
        for (role, text), given, learned in zip(got, self.held, located, strict=True):
            self.turns += 1
            self.unread += (role, text) != given
            self.read.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if role == ASSISTANT:
                self.loss += len(learned)
                self.learned.update(learned.encode("utf-8", "surrogatepass"))
        self.context, self.held = self.held[-1:], []

    def row(self) -> tuple:
        self.flush()
        return self.turns, self.read.hexdigest(), self.loss, self.learned.hexdigest(), self.chars, self.rewrote, self.unread


FOUND = (("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"), ("loss_sha256", "string"), ("formatted_chars", "long"), ("rewritten_turns", "long"), ("unread_turns", "long"))


def formatted(rows: DataFrame, *, template: Render | Template = MARKED, block: int = 16) -> DataFrame:
    """A row for each conv_id of rows (conv_id, turn, role, text): what a reader of the formatted output gets back from it, at how many
    turns the template rewrote history, and how many turns did not come back as they were given."""
    template = Template.of(template)
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    schema = T.StructType([rows.schema["conv_id"]])
    for name, kind in FOUND:
        schema = schema.add(name, kind)
    sorted_rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, out = None, None, []
        kind = None

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(c), kind if i == 0 else pa.string() if i in (2, 4) else pa.int64()) for i, c in enumerate(zip(*found, strict=True))], names=schema.names)

        for batch in batches:
            kind = batch.column("conv_id").type
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if now is None or conv != key:
                    if now is not None:
                        out.append((key, *now.row()))
                    now, key = Conversation(template, block), conv
                now.add(role, text)
            if len(out) >= 1000:
                yield batch_of(out)
                out = []
        if now is not None:
            out.append((key, *now.row()))
        if out:
            yield batch_of(out)

    return sorted_rows.mapInArrow(run, schema)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return formatted(rows.unionByName(extra)).drop("rewritten_turns", "unread_turns")


# Only \, # and < are escaped in texts; a header has 4 + 2 signs, the end of a turn 8.
OP7_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(14 + length(role) + length(regexp_replace(role, '[^\\#<:\n]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g'))) AS bigint) AS formatted_chars
FROM rows GROUP BY conv_id
"""
