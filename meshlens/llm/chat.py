"""Chat formatting with typed content parts.

A turn is plain text or a list of parts (text, image, audio, document). A visitor flattens the parts in order: text is
escaped, any other part becomes a placeholder ``<|kind:n|>``; its reference and the tokens it expands to are recorded.
The template wraps user turns in ``[INST] ... [/INST]``, ends assistant turns with ``</s>``, and names other roles.
Control strings in texts get a backslash in front and backslashes are doubled, so the output can be read back exactly.

Defined cases: null text or role is empty; rows of equal turn go by role, then text, nulls first; a conversation without
assistant rows has an empty loss mask; a part of an unknown kind, or none, becomes a placeholder of kind ``unknown`` that
expands to no tokens, and the kind is listed in ``errors``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshlens.llm.shared import ship

CONTROL = re.compile(r"\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
PIECE = re.compile(r"\\(.)|<\|(\w+):(\d+)\|>", re.DOTALL)
#: Opening and closing marks by role; other roles are named in their opening mark.
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "assistant": (" ", " </s>")}
OTHER = ("<|turn|>", "\n", " <|end|>")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


@dataclass
class Attachment:
    kind: str
    reference: str
    tokens: int


@dataclass
class PartVisitor:
    """Flattens parts; tokens of an image are its patches, of audio its frames, of a document a fixed number a page."""

    patch: int = 28
    frames_per_second: float = 25.0
    tokens_per_page: int = 512
    attachments: list[Attachment] = field(default_factory=list)
    errors: list[str] = field(default_factory=list)

    def visit(self, part: dict | None) -> str:
        kind = (part or {}).get("type")
        visitor = getattr(self, f"visit_{kind}", None)
        if visitor is None:
            self.errors.append(f"unknown content part: {kind}")
            return self._placed("unknown", part or {}, 0)
        return visitor(part)

    def _placed(self, kind: str, part: dict, tokens: int) -> str:
        self.attachments.append(Attachment(kind, part.get("ref") or "", tokens))
        return f"<|{kind}:{len(self.attachments) - 1}|>"

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        return self._placed("image", part, math.ceil((part.get("width") or 0) / self.patch) * math.ceil((part.get("height") or 0) / self.patch))

    def visit_audio(self, part: dict) -> str:
        return self._placed("audio", part, math.ceil((part.get("seconds") or 0) * self.frames_per_second))

    def visit_document(self, part: dict) -> str:
        return self._placed("document", part, (part.get("pages") or 0) * self.tokens_per_page)


@dataclass
class Formatted:
    text: str
    spans: list[tuple[int, int]]
    attachments: list[Attachment]
    n_turns: int
    errors: list[str]


def format_turns(turns: list[tuple[str, str | list[dict]]], visitor: PartVisitor | None = None) -> Formatted:
    """One conversation; spans are the code points of the output under the loss mask (the assistants' texts)."""
    visitor = visitor or PartVisitor()
    out, spans, at = ["<s>"], [], 3
    for role, content in turns:
        parts = [{"type": "text", "text": content}] if isinstance(content, str) else content
        body = "".join(map(visitor.visit, parts))
        begin, end = MARKS.get(role) or (f"{OTHER[0]}{quote(role)}{OTHER[1]}", OTHER[2])
        if role == "assistant":
            spans.append((at + len(begin), at + len(begin) + len(body)))
        out += (begin, body, end)
        at += len(begin) + len(body) + len(end)
    return Formatted("".join(out), spans, visitor.attachments, len(turns), visitor.errors)


def read_turns(text: str) -> Iterator[tuple[str, str]]:
    """(role, escaped body) of each turn of a formatted conversation."""
    at = 3
    while at < len(text):
        if text.startswith(OTHER[0], at):
            named = text.index(OTHER[1], at)
            role, begin, end = unquote(text[at + len(OTHER[0]) : named]), named + 1, OTHER[2]
        else:
            role, (mark, end) = next((r, m) for r, m in MARKS.items() if text.startswith(m[0], at))
            begin = at + len(mark)
        close = text.index(end, begin)
        yield role, text[begin:close]
        at = close + len(end)


def read_parts(body: str) -> list[tuple[str, str | int]]:
    """The parts of an escaped body: ("text", text) and (kind, attachment number), in order."""
    parts, held, at = [], [], 0
    for m in PIECE.finditer(body):
        held.append(body[at : m.start()])
        if m[1] is not None:
            held.append(m[1])
        else:
            if "".join(held):
                parts.append(("text", "".join(held)))
            parts.append((m[2], int(m[3])))
            held = []
        at = m.end()
    if last := "".join(held) + body[at:]:
        parts.append(("text", last))
    return parts


SCHEMA = "{id} {kind}, n_turns long, formatted string, loss_spans array<struct<begin:long,stop:long>>, attachments array<struct<kind:string,reference:string,tokens:long>>, expanded_tokens long, errors array<string>"


def _conversations(batches: Iterator[pa.RecordBatch], schema: pa.Schema, with_parts: bool) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by conversation and turn; only the conversation at hand is held."""

    def row(key: object, turns: list) -> dict:
        f = format_turns(turns)
        return {schema.names[0]: key, "n_turns": f.n_turns, "formatted": f.text, "loss_spans": [{"begin": a, "stop": b} for a, b in f.spans], "attachments": [vars(a) for a in f.attachments], "expanded_tokens": sum(a.tokens for a in f.attachments), "errors": f.errors}

    key, turns, out, size = None, [], [], 0
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for i, this in enumerate(columns[0]):
            if turns and this != key:
                out.append(row(key, turns))
                size += len(out[-1]["formatted"])
                turns = []
                if len(out) >= 1000 or size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out, size = [], 0
            key = this
            text = columns[2][i] or ""
            turns.append((columns[1][i] or "", columns[3][i] if with_parts and columns[3][i] is not None else text))
    if turns:
        out.append(row(key, turns))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", parts_col: str | None = None) -> DataFrame:
    """One formatted row a conversation. One shuffle on the conversation; each is put together from sorted rows."""
    ship(rows.sparkSession)
    kind = dict(rows.dtypes)[id_col]
    cut = rows.select(F.col(id_col).alias("_c"), F.col(turn_col).alias("_t"), F.col("role").alias("_r"), F.col("text").alias("_x"), *([F.col(parts_col).alias("_p")] if parts_col else []))
    dealt = cut.repartition("_c").sortWithinPartitions("_c", "_t", "_r", "_x").drop("_t")
    ddl = SCHEMA.format(id=f"`{id_col}`", kind=kind)
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))
    return dealt.mapInArrow(lambda batches: _conversations(batches, schema, parts_col is not None), ddl)


def read_back(key: object, text: str, spans: list[tuple[int, int]]) -> dict:
    """The digests of one formatted conversation, from its output alone."""
    turns, n = hashlib.sha256(), 0
    for role, body in read_turns(text):
        turns.update(f"{role}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
        n += 1
    loss, chars = hashlib.sha256(), 0
    for a, b in spans:
        part = unescape(text[a:b])
        loss.update(part.encode("utf-8", "surrogatepass"))
        chars += len(part)
    return {"conv_id": key, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": len(text)}


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_attachments", pa.int64()), ("expanded_tokens", pa.int64())])
    for batch in batches:
        rows = zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True)
        yield pa.RecordBatch.from_pylist([read_back(k, t, [(s["begin"], s["stop"]) for s in m]) | {"n_attachments": n, "expanded_tokens": e} for k, t, m, n, e in rows], schema=schema)


def digests(formatted: DataFrame) -> DataFrame:
    """What each formatted conversation says when it is read back, its attachments and the tokens that they expand to."""
    counts = (F.size("attachments").cast("long"), "expanded_tokens")
    return formatted.select(F.col("conv_id").cast("long"), "formatted", "loss_spans", *counts).mapInArrow(_digests, DIGESTS)
