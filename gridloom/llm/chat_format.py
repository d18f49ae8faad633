"""Chat formatting with a grammar round trip: rendered text is parsed back and compared with the source turns.

Grammar of a rendered conversation (a turn per line of the grammar, nothing between turns)::

    system turn      [SYS]text[/SYS]
    user turn        [INST]text[/INST]
    assistant turn   <s>text</s>
    any other role   [TURN]role[SEP]text[/TURN]

A control string inside a text or role is escaped by one backslash after its first character; a control string that
already has backslashes there gets one more. So control strings never stand unescaped in a text, and taking one
backslash away gives back every text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAMES = r"(/?(?:s>|INST\]|SYS\]|TURN\]|SEP\]))"
_ESCAPE = re.compile(r"([<\[])(\\*)" + _NAMES)
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _NAMES)
_CONTROL = re.compile(r"</?s>|\[/?(?:INST|SYS|TURN|SEP)\]")
OPEN = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_ROLE_OF = {a: (role, b) for role, (a, b) in OPEN.items()}
#: A conversation that naive templates read back wrongly; the query adds it to the table.
PROBE_ID, PROBE_TEXT = -1, "</s>[INST] ok [/INST]"


class FormatError(ValueError):
    """Rendered text that the grammar can't have made, or that doesn't give back its source."""


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def render_turn(role: str, text: str, escaped: bool = True) -> str:
    put = escape if escaped else str
    if role in OPEN:
        a, b = OPEN[role]
        return f"{a}{put(text)}{b}"
    return f"[TURN]{put(role)}[SEP]{put(text)}[/TURN]"


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end delimit the escaped text in ``rendered``. Deterministic, one pass."""
    turns, at = [], 0
    while at < len(rendered):
        m = _CONTROL.match(rendered, at)
        if not m or m[0] not in _ROLE_OF and m[0] != "[TURN]":
            raise FormatError(f"no turn begins at {at}")
        begin = m.end()
        if m[0] == "[TURN]":
            sep = _CONTROL.search(rendered, begin)
            if not sep or sep[0] != "[SEP]":
                raise FormatError(f"no [SEP] after {begin}")
            role, closing, begin = unescape(rendered[begin : sep.start()]), "[/TURN]", sep.end()
        else:
            role, closing = _ROLE_OF[m[0]]
        end = _CONTROL.search(rendered, begin)
        if not end or end[0] != closing:
            raise FormatError(f"no {closing} after {begin}")
        turns.append((role, unescape(rendered[begin : end.start()]), begin, end.start()))
        at = end.end()
    return turns


def format_turn(role: str, text: str) -> tuple[str, int, int, str, str]:
    """(rendered, start, end, role, text) of a turn, the last four as read back. Escapes only where the plain form doesn't survive the round trip.

    A text with a backslash-escaped control string is escaped too: its plain form would lose the backslash.
    """
    for escaped in (False, True):
        rendered = render_turn(role, text, escaped)
        try:
            back = parse(rendered)
        except FormatError:
            continue
        if len(back) == 1 and back[0][:2] == (role, text):
            return rendered, back[0][2], back[0][3], back[0][0], back[0][1]
    raise FormatError("a turn doesn't survive the round trip")


def format_turns(df: DataFrame) -> DataFrame:
    """A row per row of ``df`` (conv_id, turn, role, text), formatted alone: rendered text, the span of its text there, and what parsing gives back.

    Null text and null role count as empty; repeated rows stay as repeated turns; extra columns are ignored; an empty
    table gives no rows.
    """

    @F.pandas_udf("rendered string, start int, end int, back_role string, back_text string, escaped boolean")
    def fmt(roles: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [format_turn(r, t) for r, t in zip(roles, texts, strict=True)]
        out = pd.DataFrame(rows, columns=["rendered", "start", "end", "back_role", "back_text"])
        return out.assign(escaped=[x[0] != render_turn(r, t, False) for x, r, t in zip(rows, roles, texts, strict=True)])

    rows = df.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.withColumn("f", fmt("role", "text")).select("conv_id", "turn", "role", "text", "f.*")


def _in_order(turns: DataFrame) -> DataFrame:
    """The rows of ``format_turns`` by conversation and (turn, role, text); nulls come first."""
    lean = turns.select("conv_id", "turn", "back_role", "back_text", "escaped")
    return lean.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "back_role", "back_text")


class Reader:
    """Writes a conversation turn by turn and reads it back from what was written: turns, and the text under the loss mask.

    ``add`` takes a turn, puts its rendering at the end of the formatted conversation and parses it there. Every
    turn begins and ends with its own control strings and no text keeps an unescaped one, so the parse of the whole
    is the joined parse of its turns, and nothing that was read has to be kept.
    """

    def __init__(self) -> None:
        self.n = self.at = self.loss = 0
        self.all, self.learn = hashlib.sha256(), hashlib.sha256()

    def add(self, role: str, text: str, escaped: bool) -> tuple[str, int, tuple[int, int] | None]:
        """(rendered, its place, the span under the loss mask) in the formatted conversation."""
        rendered, base = render_turn(role, text, escaped), self.at
        turns = parse(rendered)
        if [t[:2] for t in turns] != [(role, text)]:
            raise FormatError("a turn doesn't survive the round trip")
        span = None
        for back_role, back_text, start, end in turns:
            self.n += 1
            self.all.update(f"{back_role}\n{back_text}\n".encode("utf-8", "surrogatepass"))
            if back_role == "assistant":
                span = (base + start, base + end)
                learn = unescape(rendered[span[0] - base : span[1] - base])
                self.loss += len(learn)
                self.learn.update(learn.encode("utf-8", "surrogatepass"))
        self.at += len(rendered)
        return rendered, base, span

    def digests(self) -> tuple:
        return self.n, self.all.hexdigest(), self.loss, self.learn.hexdigest(), self.at


def _conversations(batch: pa.RecordBatch, now: list) -> Iterator[tuple[int, Reader, tuple[str, str, bool], bool]]:
    """(row, reader, turn, whether it begins a conversation) of each row; ``now`` holds the last key and reader across batches."""
    columns = (batch.column(c).to_pylist() for c in ("conv_id", "back_role", "back_text", "escaped"))
    for k, (conv, *turn) in enumerate(zip(*columns, strict=True)):
        new = not now or now[0] != conv
        if new:
            now[:] = [conv, Reader()]
        yield k, now[1], tuple(turn), new


def format_conversations(df: DataFrame) -> DataFrame:
    """A row per row of ``df``: conv_id, turn, piece (its number), rendered, at (its place) and loss_start, loss_end (null outside the mask).

    The formatted conversation is its pieces joined in order; places and spans count its characters. A conversation's rows are
    ordered by (turn, role, text), a null turn first; all rows with a null conv_id are one conversation. Rows stream,
    so memory doesn't grow with a conversation.
    """
    names = ["conv_id", "turn", "piece", "rendered", "at", "loss_start", "loss_end"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []
        for b in batches:
            rows = []
            for _, reader, turn, _ in _conversations(b, now):
                rendered, at, span = reader.add(*turn)
                rows.append((reader.n - 1, rendered, at, *(span or (None, None))))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("turn"), *columns], names=names)

    return _in_order(format_turns(df)).mapInArrow(write, "conv_id long, turn long, piece long, rendered string, at long, loss_start long, loss_end long")


def conversation_digests(turns: DataFrame) -> DataFrame:
    """A row per conversation of ``format_turns``' rows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    All are read from the formatted conversation: turns by parsing it, the loss text by its mask. A digest over a whole
    conversation is sequential by what it is; turns are formatted before, by rows, and stream through it.
    """
    columns = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []
        for b in batches:
            done, last = [], list(now)
            for _, reader, turn, new in _conversations(b, now):
                if new and last:
                    done.append((last[0], *last[1].digests()))
                reader.add(*turn)
                last = list(now)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names=columns)
        if now:
            row = (now[0], *now[1].digests())
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=columns)

    return _in_order(turns).mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = [(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)]
    probes = spark.createDataFrame(probe, "conv_id long, turn long, role string, text string")
    return conversation_digests(format_turns(table.unionByName(probes)))


#: formatted_chars follows from the grammar: 11 control characters for system, 13 user, 7 assistant, 18 else.
OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]|SYS\]|TURN\]|SEP\]))', '\1\\\2\3', 'g'))
        + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
          ELSE 18 + length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]|SYS\]|TURN\]|SEP\]))', '\1\\\2\3', 'g')) END AS n FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
