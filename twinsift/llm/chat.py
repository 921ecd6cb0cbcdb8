"""Chat formatting with typed content parts.

A turn's content is a list of typed parts.  A visitor flattens them in order: text is escaped and kept, images,
audio and documents become ordered placeholders, with a reference to the attachment and the number of tokens the
placeholder expands to.  Turns are marked with control strings; the same strings inside a text or role are escaped
reversibly, so that a formatted conversation can be read back exactly.  Neighbouring text parts are escaped as the one
text they make, so a control string that is split over them is escaped too.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_MARK = re.compile(r"<\|(?:image|audio|document|other):\d+\|>")

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Tokens that a placeholder expands to.
IMAGE_TILE, TOKENS_PER_TILE = 28, 1
AUDIO_TOKENS_PER_SECOND = 25
TOKENS_PER_PAGE = 256
MOST_TOKENS = 1 << 53  # of one attachment; what would be more counts as so many
MOST_READY, PIECE = 200, 1 << 20  # rows handed on at a time; code points from which a conversation goes on in a further row


def escape(text: str) -> str:
    """Lengthen every ``<``, backslashes, ``|`` by one backslash: no ``<|`` is left."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def _measure(value: float | str | None, default: float) -> float:
    """A positive, finite measure of an attachment; anything else counts as not given."""
    size = float(value) if value is not None else math.nan
    return size if math.isfinite(size) and size > 0 else default


def _kind(part: dict | None) -> str:
    return (part or {}).get("type") or "text"


@dataclass
class Flattener:
    """Visits the parts of a conversation in order; attachments are numbered through the conversation.

    A null part is an empty text.  A part of a type without a visitor becomes a placeholder ``other`` that expands to no
    tokens; its attachment keeps the type and the reference.
    """

    attachments: list[tuple[int, str, str | None, int]] = field(default_factory=list)
    before: int = 0  # attachments of earlier pieces

    def flatten(self, parts: Iterable[dict | None]) -> str:
        """The parts in order, each run of text parts escaped as a whole."""
        body = []
        for is_text, run in groupby(parts, lambda p: _kind(p) == "text"):
            flat = "".join(self.visit(p or {}) for p in run)
            body.append(escape(flat) if is_text else flat)
        return "".join(body)

    def visit(self, part: dict) -> str:
        return getattr(self, f"visit_{_kind(part)}", self.visit_other)(part)

    def visit_text(self, part: dict) -> str:
        return part.get("text") or ""

    def visit_image(self, part: dict) -> str:
        across, down = (math.ceil(_measure(part.get(side), IMAGE_TILE) / IMAGE_TILE) for side in ("width", "height"))
        return self._attach("image", part, across * down * TOKENS_PER_TILE)

    def visit_audio(self, part: dict) -> str:
        return self._attach("audio", part, math.ceil(min(_measure(part.get("seconds"), 0) * AUDIO_TOKENS_PER_SECOND, MOST_TOKENS)))

    def visit_document(self, part: dict) -> str:
        return self._attach("document", part, int(_measure(part.get("pages"), 1)) * TOKENS_PER_PAGE)

    def visit_other(self, part: dict) -> str:
        return self._attach("other", part, 0)

    def _attach(self, mark: str, part: dict, tokens: int) -> str:
        number = self.before + len(self.attachments)
        self.attachments.append((number, _kind(part), part.get("ref"), min(tokens, MOST_TOKENS)))
        return f"<|{mark}:{number}|>"


def format_turn(role: str | None, parts: Iterable[dict | None], flattener: Flattener) -> tuple[str, int, int]:
    """The turn's text and the span of its content in it."""
    head = f"{START}{escape_role(role or '')}\n"
    body = flattener.flatten(parts)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def text_of(body: str) -> str:
    """The text of a turn's content without its placeholders; what stands between two of them was escaped by itself."""
    return "".join(unescape(s) for s in _MARK.split(body))


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation; placeholders of attachments are left out of the text."""
    return [(unescape_role(r), text_of(b)) for r, b in _TURN.findall(formatted)]


FORMATTED = (
    "conv_id long, piece int, formatted string, n_turns long, loss_starts array<long>, loss_ends array<long>, "
    "attachments array<struct<position:int,kind:string,ref:string,tokens:long>>, expanded_tokens long"
)
_ATTACHMENT = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())])


def format_conversations(turns: DataFrame, piece_chars: int = PIECE) -> DataFrame:
    """One row per conversation from ``conv_id, turn, role`` and ``parts`` (typed) or else ``text``.

    A conversation of over ``piece_chars`` code points comes as several rows, numbered by ``piece`` from 0, cut between
    turns: a task holds one piece and never a whole conversation that may have any share of the rows.
    ``loss_starts/ends`` are the spans, in code points of the piece, of the assistants' contents; attachments are numbered
    through the conversation.  Turns are ordered by turn, equal turns by role and text; null roles and texts are empty;
    repeated rows are turns of their own; rows with a null conv_id form one conversation; a text of any length is kept
    whole; null parts are empty texts, parts of an unknown type placeholders ``other``; an empty table gives an empty result; further columns are ignored.
    """
    typed = "parts" in turns.columns
    content = F.to_json("parts") if typed else F.col("text")
    rows = turns.select(F.col("conv_id").cast("long"), "turn", F.col("role").cast("string"), content.cast("string").alias("content"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "content")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, begun, piece = None, False, 0
        flattener, chunks, spans, at, n = Flattener(), [], [], 0, 0
        ready: list[tuple] = []

        def close() -> None:
            nonlocal chunks, spans, at, n, piece
            found = [dict(zip(("position", "kind", "ref", "tokens"), a)) for a in flattener.attachments]
            ready.append((current, piece, "".join(chunks), n, [s for s, _ in spans], [e for _, e in spans], found, min(sum(a["tokens"] for a in found), 2**63 - 1)))
            flattener.before += len(flattener.attachments)
            flattener.attachments = []
            chunks, spans, at, n, piece = [], [], 0, 0, piece + 1

        def out() -> pa.RecordBatch:
            longs = pa.list_(pa.int64())
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.int64(), longs, longs, pa.list_(_ATTACHMENT), pa.int64()]
            cols = [pa.array(c, k) for c, k in zip(zip(*ready), kinds)]
            ready.clear()
            return pa.record_batch(cols, ["conv_id", "piece", "formatted", "n_turns", "loss_starts", "loss_ends", "attachments", "expanded_tokens"])

        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "content"))):
                if begun and (conv != current or at > piece_chars):
                    close()
                    if conv != current:
                        flattener, piece = Flattener(), 0
                    if len(ready) >= MOST_READY or len(ready[-1][2]) > piece_chars:
                        yield out()
                current, begun = conv, True
                parts = (json.loads(text) if text else []) if typed else [{"type": "text", "text": text}]
                turn, start, end = format_turn(role, parts, flattener)
                if role == "assistant":
                    spans.append((at + start, at + end))
                chunks.append(turn)
                at += len(turn)
                n += 1
        if begun:
            close()
        if ready:
            yield out()

    return rows.mapInArrow(visit, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


@dataclass
class _Digest:
    """What has been read of a conversation, piece after piece."""

    conv: int | None
    turns: int = 0
    loss_chars: int = 0
    chars: int = 0
    said: hashlib._Hash = field(default_factory=hashlib.sha256)
    loss: hashlib._Hash = field(default_factory=hashlib.sha256)

    def add(self, text: str, spans: Iterable[tuple[int, int]]) -> None:
        for role, said in read_back(text):
            self.turns += 1
            self.said.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
        for start, end in spans:
            loss = text_of(text[start:end])
            self.loss_chars += len(loss)
            self.loss.update(loss.encode("utf-8", "surrogatepass"))
        self.chars += len(text)

    def row(self) -> tuple:
        return self.conv, self.turns, self.said.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digest(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say when read back: hashes of the turns and of the text under the mask.

    Takes the rows as ``format_conversations`` gives them: the pieces of a conversation one after another.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: _Digest | None = None
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in DIGEST.split(", ")])

        for batch in batches:
            done = []
            for conv, piece, text, starts, ends in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "formatted", "loss_starts", "loss_ends"))):
                if piece == 0:
                    if own is not None:
                        done.append(own.row())
                    own = _Digest(conv)
                own.add(text, zip(starts, ends))
            if done:
                yield out(done)
        if own is not None:
            yield out([own.row()])

    return formatted.mapInArrow(read, DIGEST)
