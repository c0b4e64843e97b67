"""Chat formatting with typed content parts: a visitor flattens parts to ordered placeholders; control strings are escaped.

A turn is ``<s>role\\n`` body ``</s>``. In roles and texts every backslash is doubled and every control string gets a
backslash behind its first character, so no text holds a control string and the original can be read back. An image, audio
or document part becomes one placeholder ``<|kind:n|>``, n counting the conversation's attachments; its reference and how
many tokens it expands to are recorded beside the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship

BEGIN, END = "<s>", "</s>"
KINDS = ("image", "audio", "document")
CONTROL = re.compile(r"</?s>|\[/?INST\]|<\|(?:" + "|".join(KINDS) + r")[:|]")
_PLACE = re.compile(r"<\|(" + "|".join(KINDS) + r"):(\d+)\|>")
#: Tokens an attachment expands to: per 14 by 14 pixel patch, per 40 ms, per page.
PATCH, FRAME_MS, PAGE_TOKENS = 14, 40, 512


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


@dataclass
class Part:
    """type: text, image, audio or document. Sizes that don't apply are None."""

    type: str
    text: str | None = None
    ref: str | None = None
    width: int | None = None
    height: int | None = None
    ms: int | None = None
    pages: int | None = None


@dataclass
class Attachment:
    n: int
    kind: str
    ref: str
    tokens: int


@dataclass
class Flattener:
    """The visitor: one method a kind of part; pieces in order, attachments beside."""

    attachments: list[Attachment] = field(default_factory=list)

    def visit(self, part: Part) -> str:
        method = getattr(self, f"visit_{part.type}", None)
        if method is None:
            raise ValueError(f"unknown content part: {part.type!r}")
        return method(part)

    def visit_text(self, part: Part) -> str:
        return escape(part.text or "")

    def visit_image(self, part: Part) -> str:
        return self._attach(part, -(-(part.width or 0) // PATCH) * -(-(part.height or 0) // PATCH))

    def visit_audio(self, part: Part) -> str:
        return self._attach(part, -(-(part.ms or 0) // FRAME_MS))

    def visit_document(self, part: Part) -> str:
        return self._attach(part, (part.pages or 0) * PAGE_TOKENS)

    def _attach(self, part: Part, tokens: int) -> str:
        a = Attachment(len(self.attachments), part.type, part.ref or "", max(1, tokens))
        self.attachments.append(a)
        return f"<|{a.kind}:{a.n}|>"


@dataclass
class Formatted:
    text: str
    #: Spans of text that are trained on: the bodies of assistant turns.
    loss: list[tuple[int, int]]
    attachments: list[Attachment]


def format_conversation(turns: list[tuple[str | None, list[Part]]]) -> Formatted:
    flat, out, loss, at = Flattener(), [], [], 0
    for role, parts in turns:
        head = f"{BEGIN}{escape(role or '').replace(chr(10), chr(92) + chr(10))}\n"
        body = "".join(flat.visit(p) for p in parts)
        if role == "assistant":
            loss.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END]
        at += len(head) + len(body) + len(END)
    return Formatted("".join(out), loss, flat.attachments)


_TURN = re.compile(r"<s>((?:[^\\\n]|\\.)*)\n(.*?)</s>", re.DOTALL)


def parse(text: str, attachments: list[Attachment] = []) -> list[tuple[str, list[Part]]]:  # noqa: B006
    """The turns of a formatted text. Neighbouring text parts come back as one; a turn without parts as one empty text."""
    turns, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError(f"not a formatted conversation at {at}")
        parts, pieces = [], _PLACE.split(m[2])
        for k in range(0, len(pieces), 3):
            if pieces[k] or len(pieces) == 1:
                parts.append(Part("text", unescape(pieces[k])))
            if k + 2 < len(pieces):
                n = int(pieces[k + 2])
                parts.append(Part(pieces[k + 1], ref=attachments[n].ref if n < len(attachments) else None))
        turns.append((unescape(m[1]), parts))
        at = m.end()
    if at != len(text):
        raise ValueError(f"not a formatted conversation at {at}")
    return turns


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = ["type", "text", "ref", "width", "height", "ms", "pages"]
    for batch in batches:
        done = []
        for turns in batch.column("turns").to_pylist():
            done.append(format_conversation([(t["role"], [Part(**{k: p[k] for k in fields}) for p in t["parts"] or []]) for t in turns]))
        loss = pa.array([[{"start": a, "stop": b} for a, b in d.loss] for d in done], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))
        kinds = pa.struct([("n", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])
        attached = pa.array([[a.__dict__ for a in d.attachments] for d in done], pa.list_(kinds))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array([d.text for d in done], pa.string()), loss, attached], ["conv_id", "formatted", "loss", "attachments"])


PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,ms:int,pages:int>>"


def format_chats(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, parts (PARTS), or text in place of parts. One row a conversation: conv_id, formatted, loss
    (spans of formatted, in characters), attachments (n, kind, ref, tokens).

    Rows are ordered by turn, then role and content, so ties and repeated rows have one order; each is a turn of its own. A
    null or empty role or text is an empty one; a row without a conv_id is a conversation of its own; a very long text is
    taken whole; other columns are ignored; an empty table gives an empty result. A conversation is one value, so it must
    fit a task; many rows spread by conversation.
    """
    ship(rows.sparkSession)
    if "parts" in rows.columns:
        parts = F.col("parts").cast(PARTS)
    else:
        none = {k: F.lit(None).cast("string" if k == "ref" else "int").alias(k) for k in ("ref", "width", "height", "ms", "pages")}
        parts = F.array(F.struct(F.lit("text").alias("type"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *none.values()))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("alone")
    each = rows.select("conv_id", alone, F.struct(F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), parts.alias("parts")).alias("t"))
    turns = each.groupBy("conv_id", "alone").agg(F.sort_array(F.collect_list("t")).alias("turns")).drop("alone")
    kind = dict(rows.dtypes)["conv_id"]
    return turns.mapInArrow(_run, f"conv_id {kind}, formatted string, loss array<struct<start:int,stop:int>>, attachments array<struct<n:int,kind:string,ref:string,tokens:long>>")


READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[] for _ in range(7)]
        for text, loss, attached in zip(*(batch.column(c).to_pylist() for c in ("formatted", "loss", "attachments"))):
            turns = parse(text, [Attachment(**a) for a in attached])
            placed = [(p.type, p.ref) for _, parts in turns for p in parts if p.type != "text"]
            if placed != [(a["kind"], a["ref"]) for a in attached]:
                raise ValueError("placeholders and attachments differ")
            said = "".join(f"{role}\n{''.join(p.text or '' for p in parts)}\n" for role, parts in turns)
            trained = "".join(unescape(text[s["start"] : s["stop"]]) for s in loss)
            for c, v in zip(cols, (len(turns), hashlib.sha256(said.encode("utf-8", "surrogatepass")).hexdigest(), len(trained), hashlib.sha256(trained.encode("utf-8", "surrogatepass")).hexdigest(), len(text), len(placed), sum(a["tokens"] for a in attached))):
                c.append(v)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["conv_id", *(x.split()[0] for x in READ.split(", "))])


def read_back(formatted: DataFrame) -> DataFrame:
    """Counts and digests of each formatted conversation, read back from its text, loss spans and attachments, whose
    placeholders must be in the text, in order. A turn's text is that of its text parts."""
    kind = dict(formatted.dtypes)["conv_id"]
    return formatted.select("conv_id", "formatted", "loss", "attachments").mapInArrow(_digest, f"conv_id {kind}, {READ}")


#: formatted_chars as an expression over the turns; the digests over the raw texts, which reading back must give again.
ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(role) + length(text) + 8
    + length(role) - length(replace(role, '\', '')) + length(text) - length(replace(text, '\', ''))
    + len(regexp_extract_all(role || chr(10) || text, '</?s>|\[/?INST\]|<\|(?:image|audio|document)[:|]')) AS n FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars,
  0::BIGINT AS n_attachments, 0::BIGINT AS attachment_tokens
FROM e GROUP BY conv_id
"""
