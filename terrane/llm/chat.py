"""Chat formatting: typed content parts, one template, reversible escapes and a loss mask.

A message's content is a list of typed parts. A visitor flattens them in order into the text of the turn: texts are escaped, images,
audio and documents become numbered placeholders, with a record of what each refers to and of how many tokens it will take.
A turn is written as `<|im_start|>role`, a line feed, the content, `<|im_end|>` and a line feed; the loss mask covers the content of assistant turns.
Control strings inside texts and roles get a word joiner (U+2060) after their first character, and those that had some get one more, so reading
back removes exactly one.

Defined results: a null text is an empty one, a null role an empty role; turns of equal number are ordered by role, then text, and all stay;
null turn numbers come first; rows without conversation form the conversation null; an empty table gives no conversations; other columns are not read.
Memory: one batch of turns; conversations are hashed as they stream by in order, however long.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"
JOINER = "⁠"
#: Control strings of common chat templates (fixed values) and this one's placeholders, without their first character.
_CONTROL = r"(?:\|(?:im_start|im_end|im_sep|endoftext|(?:image|audio|document):[0-9]+)\|>|/?s>|</?SYS>>)"
_ESCAPE = re.compile(f"(<)({JOINER}*)({_CONTROL})|(\\[)({JOINER}*)(/?INST\\])")
_UNESCAPE = re.compile(f"(<){JOINER}({JOINER}*)({_CONTROL})|(\\[){JOINER}({JOINER}*)(/?INST\\])")


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: f"{m[1] or m[4]}{JOINER}{m[2] if m[1] else m[5]}{m[3] or m[6]}", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: f"{m[1] or m[4]}{m[2] if m[1] else m[5]}{m[3] or m[6]}", text)


@dataclass
class Flattener:
    """Visits the parts of a message in order; `finish` gives the text, the attachments and the token count of the placeholders."""

    patch: int = 28
    audio_rate: float = 25.0
    page_tokens: int = 512
    pieces: list[str] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part.get('type', 'text')}")(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        n = len(self.attachments)
        self.attachments.append({"kind": kind, "number": n, "ref": part.get("ref") or part.get("url") or "", "tokens": tokens})
        self.pieces.append(f"<|{kind}:{n}|>")

    def visit_image(self, part: dict) -> None:
        side = lambda x: max(1, math.ceil((part.get(x) or self.patch) / self.patch))
        self._attach("image", part, side("width") * side("height") + 2)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 0) * self.audio_rate)) + 2)

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, math.ceil(max(1, part.get("pages") or 1)) * self.page_tokens + 2)

    def finish(self) -> tuple[str, list[dict], int]:
        return "".join(self.pieces), self.attachments, sum(a["tokens"] for a in self.attachments)


#: What each type of part may hold besides its type (fixed values): texts, and sizes as numbers.
FIELDS = {"text": ({"text"}, set()), "image": ({"ref", "url"}, {"width", "height"}), "audio": ({"ref", "url"}, {"seconds"}), "document": ({"ref", "url"}, {"pages"})}
LARGEST = 1_000_000


def parts_of(content: str) -> list[dict] | None:
    """The parts of a JSON list; none at all for an empty text, and None for content that is not a list of known parts with texts for texts and sizes from 0 to `LARGEST`."""
    if not content:
        return []
    try:
        parts = json.loads(content)
    except (ValueError, RecursionError):
        return None
    if not isinstance(parts, list):
        return None
    for p in parts:
        texts, sizes = FIELDS.get(p.get("type", "text"), (None, None)) if isinstance(p, dict) and isinstance(p.get("type", "text"), str) else (None, None)
        if texts is None or any(not isinstance(p.get(k) or "", str) for k in texts):
            return None
        if any(isinstance(v, bool) or not isinstance(v, int | float) or not 0 <= v <= LARGEST for k in sizes if (v := p.get(k)) is not None):
            return None
    return parts


def escape_role(role: str) -> str:
    """A role in one line: backslashes are doubled and line feeds written as backslash n."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, parts: list[dict]) -> tuple[str, int, int, list[dict], int]:
    """The turn's text, the code points that the loss covers (start, end), its attachments and their tokens."""
    visitor = Flattener()
    for p in parts:
        visitor.visit(p)
    content, attachments, tokens = visitor.finish()
    head = f"{BEGIN}{escape_role(role)}\n"
    start = len(head)
    return f"{head}{content}{END}\n", start, start + len(content) if role == "assistant" else start, attachments, tokens


def read_turn(segment: str) -> tuple[str, str]:
    """Role and text back from a formatted turn."""
    if not (segment.startswith(BEGIN) and segment.endswith(f"{END}\n")):
        raise ValueError("not a turn")
    body = segment[len(BEGIN) : -len(END) - 1]
    role, _, text = body.partition("\n")
    return unescape_role(role), unescape(text)


_SEGMENTS = "conv_id long, turn long, role string, segment string, loss_start int, loss_end int, attachments array<struct<kind:string,number:int,ref:string,tokens:long>>, expanded_tokens long, malformed boolean"


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text", typed: bool = False) -> DataFrame:
    """A formatted turn for each row. With `typed`, content is a JSON list of parts; else it is one text part, whatever it says. Typed content
    that is no such list (see `parts_of`) is kept as one text part, and its row is marked `malformed`."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("number", pa.int32()), ("ref", pa.string()), ("tokens", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), kind, pa.int64(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 2000):
                b = whole.slice(s, 2000)
                texts = b.column(3).to_pylist()
                parts = [parts_of(t) if typed else [{"text": t}] for t in texts]
                made = [format_turn(r, [{"text": t}] if p is None else p) for r, t, p in zip(b.column(2).to_pylist(), texts, parts, strict=True)]
                columns = [b.column(0), b.column(1), b.column(2), *map(list, zip(*made, strict=True)), [p is None for p in parts]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", "turn", "role", "segment", "loss_start", "loss_end", "attachments", "expanded_tokens", "malformed"])

    read = df.select(df[conv].cast("long").alias("conv_id"), df[turn].cast("long").alias("turn"), F.coalesce(df[role].cast("string"), F.lit("")).alias("role"), F.coalesce(df[content].cast("string"), F.lit("")).alias("text"))
    return read.mapInArrow(run, _SEGMENTS)


def digests(segments: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its formatted turns in order."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, out = None, False, []

        def begin(conv: int | None) -> dict:
            return {"conv": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0, "attached": 0, "tokens": 0}

        def end() -> tuple:
            return now["conv"], now["n"], now["turns"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["size"], now["attached"], now["tokens"]

        def emit() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out.clear()
            return done

        for b in batches:
            for conv, segment, s, e, attached, tokens in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if not open_ or conv != now["conv"]:
                    if open_:
                        out.append(end())
                    now, open_ = begin(conv), True
                role, text = read_turn(segment)
                now["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if e > s:
                    learnt = unescape(segment[s:e])
                    now["chars"] += len(learnt)
                    now["loss"].update(learnt.encode("utf-8", "surrogatepass"))
                now["n"] += 1
                now["size"] += len(segment)
                now["attached"] += attached
                now["tokens"] += tokens
            if len(out) > 5000:
                yield emit()
        if open_:
            out.append(end())
        if out:
            yield emit()

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "segment")
    read = ordered.select("conv_id", "segment", "loss_start", "loss_end", F.size("attachments").alias("n"), "expanded_tokens")
    return read.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long")


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '<\x{2060}*(?:\|(?:im_start|im_end|im_sep|endoftext|(?:image|audio|document):[0-9]+)\|>|/?s>|</?SYS>>)|\[\x{2060}*/?INST\]')) AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(role) + size + 24)::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens
FROM e GROUP BY conv_id
"""
