r"""Chat formatting of typed content parts, with a loss mask that can be read back.

A turn is written as `<turn>ROLE\nCONTENT</turn>\n`. Inside roles and contents a backslash makes the
next character plain; it is put before backslashes and before whatever could be taken for control:
`<turn>`, `</turn>`, `### `, the start `<|` of a placeholder and, in roles, a line end. So texts come
back exactly, whatever they hold, and an unescaped placeholder `<|KIND:POSITION:TOKENS|>` is always a
part that is no text; its position names the attachment that holds the reference.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandframe.llm.common import bound_batches

OPEN, CLOSE = "<turn>", "</turn>\n"
_CONTROL = re.compile(r"(\\|</?turn>|### |<\|)")
_ROLE_CONTROL = re.compile(r"(\\|</?turn>|### |<\||\n)")
_PLAIN = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<turn>((?:[^\\\n]++|\\.)*+)\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)

_PLACEHOLDER = re.compile(r"((?:[^\\<]++|\\.|<(?!\|))*+)(?:<\|([^:|]+):(\d+):(\d+)\|>)?", re.DOTALL)

#: Tokens that stand for one unit of a part that is no text: an image tile, a second of sound, a page.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 800}


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\1", text)


def escape_role(text: str) -> str:
    return _ROLE_CONTROL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _PLAIN.sub(r"\1", text) if "\\" in text else text


@dataclass
class Attachment:
    position: int
    kind: str
    reference: str | None
    tokens: int


@dataclass
class PartVisitor:
    """Flattens typed parts in order: texts are escaped, others become placeholders that name an attachment and its expanded token count."""

    unit_tokens: dict[str, int] = field(default_factory=lambda: dict(UNIT_TOKENS))
    out: list[str] = field(default_factory=list)
    attachments: list[Attachment] = field(default_factory=list)
    #: Text that is not escaped yet: texts side by side are escaped as one, or they could make up control strings together.
    pending: list[str] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        kind = part.get("type") or "text"
        getattr(self, f"visit_{kind}", self.visit_other)(part, kind)

    def visit_text(self, part: dict, kind: str) -> None:
        self.pending.append(part.get("text") or "")

    def flush(self) -> None:
        self.out.append(escape("".join(self.pending)))
        self.pending.clear()

    def visit_other(self, part: dict, kind: str) -> None:
        units = part.get("units")
        tokens = self.unit_tokens.get(kind, 1) * max(1, 1 if units is None else int(units))
        at = len(self.attachments)
        self.attachments.append(Attachment(at, kind, part.get("reference"), tokens))
        self.flush()
        self.out.append(f"<|{quote(kind, safe='')}:{at}:{tokens}|>")

    visit_image = visit_audio = visit_document = visit_other

    def flat(self, parts: list[dict] | None) -> str:
        for p in parts or []:
            if p is not None:
                self.visit(p)
        self.flush()
        return "".join(self.out)


def format_turn(role: str | None, content: str) -> str:
    """`content` is escaped already."""
    return f"{OPEN}{escape_role(role or '')}\n{content}{CLOSE}"


def read_parts(content: str) -> list[str | Attachment]:
    """The parts of a formatted content: texts, and attachments without their references. Texts that stood side by side come back as one."""
    out: list[str | Attachment] = []
    at = 0
    while at < len(content):
        m = _PLACEHOLDER.match(content, at)
        if m.end() == at:
            raise ValueError(f"no part at {at}")
        if m[1]:
            out.append(unescape(m[1]))
        if m[2] is not None:
            out.append(Attachment(int(m[3]), unquote(m[2]), None, int(m[4])))
        at = m.end()
    return out


def text_of(content: str) -> str:
    """The text parts of a formatted content, joined."""
    return "".join(p for p in read_parts(content) if isinstance(p, str)) if "<|" in content else unescape(content)


def read_turns(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, the text parts, start, end) of each turn; start and end bound the content in the formatted text, from which `read_parts` gives all parts."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        yield unescape(m[1]), text_of(m[2]), m.start(2), m.end(2)
        at = m.end()


FORMAT_SCHEMA = "formatted string, mask_start int, mask_end int, attachments array<struct<position:int,kind:string,reference:string,tokens:int>>, expanded_tokens long"


def format_turns(turns: DataFrame, *, text_col: str = "text", parts_col: str | None = None, role_col: str = "role", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """All columns of `turns` and, in a struct `chat`, the formatted turn, the span of it under the loss mask (null for other roles), the attachments and their expanded tokens.

    `parts_col`: an array of structs (type, text, reference, units); else the text is the one part.
    Null texts and parts are empty; a null role is the empty role. An existing column `chat` is
    replaced, other columns stay; repeated rows give repeated rows, an empty table an empty result.
    """
    bound_batches(turns.sparkSession)
    import pandas as pd

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for roles, contents in batches:
            rows = []
            for role, content in zip(roles, contents):
                visitor = PartVisitor()
                parts = [dict(p) for p in content if p is not None] if parts_col is not None and content is not None else [{"type": "text", "text": content}]
                flat = visitor.flat(parts)
                text = format_turn(role, flat)
                end = len(text) - len(CLOSE)
                masked = role in loss_roles
                rows.append((text, end - len(flat) if masked else None, end if masked else None, [vars(a) for a in visitor.attachments], sum(a.tokens for a in visitor.attachments)))
            out = pd.DataFrame(rows, columns=["formatted", "mask_start", "mask_end", "attachments", "expanded_tokens"])
            yield out.astype({"mask_start": "Int32", "mask_end": "Int32"})

    run.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    return turns.withColumn("chat", F.pandas_udf(run, returnType=FORMAT_SCHEMA)(F.col(role_col), F.col(parts_col or text_col)))


def text_part(text: Column) -> Column:
    """A content of one text part, as `format_turns` takes it in `parts_col`."""
    nothing = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), nothing.cast("string").alias("reference"), nothing.cast("int").alias("units")))


DIGEST_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_conversations(formatted: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role") -> DataFrame:
    """One row per conversation, read back from its formatted turns in order (ties: by role, then formatted text).

    The turns of a conversation are sorted and streamed through running hashes, so a conversation
    of any length needs the memory of one batch, and turns of any length that of the batches' byte
    bound or one turn. A digest is sequential, so one task reads a conversation. Rows without a
    conversation id form one of their own; repeated rows are turns of their own; an empty table gives
    an empty result.
    """
    rows = formatted.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col("chat.formatted").alias("formatted"), F.col("chat.mask_start").alias("mask_start"), F.col("chat.mask_end").alias("mask_end"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        fresh = lambda key: [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        close = lambda s: (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5])
        state = None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if state is None or state[0] != row["conv_id"]:
                    if state is not None:
                        done.append(close(state))
                    state = fresh(row["conv_id"])
                text = row["formatted"]
                state[5] += len(text)
                for role, said, start, end in read_turns(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                    if row["mask_start"] is not None:
                        under = text_of(text[row["mask_start"] : row["mask_end"]])
                        state[3] += len(under)
                        state[4].update(under.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(close(state), types)], names=names)

    return rows.mapInArrow(run, DIGEST_SCHEMA)


def oracle() -> str:
    """DuckDB SQL for the digest of the conversations and conversation -7; only for tables whose texts and roles need few escapes, as it counts them by pattern."""
    esc = r"regexp_replace({}, '(\\|</?turn>|### |<\|)', '\\\1', 'g')"
    return rf"""
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({len(OPEN) + 1 + len(CLOSE)} + length({esc.format('role')}) + length({esc.format('text')}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""
