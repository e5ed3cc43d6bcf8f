"""Chat formatting with typed content parts (operator 9).

A turn's content is a list of parts: text, image, audio or document.  A visitor
takes the parts in order; text is written as it is (control strings escaped),
any other part becomes a placeholder ``<|kind:n|>`` numbered within the turn,
its reference is recorded with the tokens that a model will expand it to.

One turn is written as::

    <|turn|>role[|mask]
    ...content...<|end|>

Escaping: a
backslash is doubled; ``<|``, ``|>``, ``<s>``, ``</s>``, ``[INST]``,
``[/INST]`` get a backslash behind their first character; so no
control string of this or of another common template can come from a text,
and dropping single backslashes gives the text back.  The loss mask covers the
text parts of assistant turns.

A turn is formatted alone, so nothing has to be gathered for that; only the
digest reads the turns of a conversation in order, as a stream that keeps one
running hash, however long a conversation is.  One conversation is one task's
work there, as its hash is one chain; Spark sorts it on disk if need be.

Null text is an empty text, a null role an empty role; turns with the same
number are ordered by role and then text; repeated rows are turns of their
own; rows with a null conv_id make up one conversation without a number.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlens.llm.common import prepare

TURN, END, MASKED = "<|turn|>", "<|end|>", "|mask"
#: Control strings that a text must not bring in.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]")
#: First characters of control strings, which may overlap.
_CONTROL = re.compile(f"(?={'|'.join(map(re.escape, CONTROL))})(.)")
_BACKSLASH = re.compile(r"\\(.)", re.DOTALL)

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    if not any(c in text for c in CONTROL):
        return text
    return _CONTROL.sub(r"\1\\", text)


def unescape(text: str) -> str:
    """A doubled backslash is one; a single one was put in and goes."""
    if "\\" not in text:
        return text
    return _BACKSLASH.sub(lambda m: "\\" if m[1] == "\\" else m[1], text)


#: What a role's control characters are written as, behind a backslash.
_ROLE = {"\\": "\\", "\n": "n", "|": "p", "<": "l", "[": "b"}
_ROLE_BACK = {v: k for k, v in _ROLE.items()}


def escape_role(role: str) -> str:
    """A role on one line, without the characters that begin or end a mark."""
    return re.sub(r"[\\\n|<\[]", lambda m: "\\" + _ROLE[m[0]], role)


def unescape_role(text: str) -> str:
    return _BACKSLASH.sub(lambda m: _ROLE_BACK.get(m[1], m[1]), text)


@dataclass
class Formatted:
    """Text of a turn, spans of the loss mask in it, and its attachments."""

    text: str = ""
    loss: list[tuple[int, int]] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)


@dataclass(frozen=True)
class Expansion:
    """Tokens that a model takes in place of a placeholder."""

    patch: int = 14
    audio_per_second: float = 25.0
    document_page: int = 512

    def image(self, part) -> int:
        w, h = part.get("width") or self.patch, part.get("height") or self.patch
        return -(-w // self.patch) * -(-h // self.patch)

    def audio(self, part) -> int:
        return max(1, round((part.get("seconds") or 0) * self.audio_per_second))

    def document(self, part) -> int:
        return self.document_page * max(1, part.get("pages") or 1)


class Visitor:
    """Flattens the parts of one turn in order."""

    def __init__(self, expansion: Expansion | None = None):
        self.expansion = expansion or Expansion()

    def turn(self, role: str | None, parts: list[dict]) -> Formatted:
        role = role or ""
        loss = role == "assistant"
        self.out = Formatted(f"{TURN}{escape_role(role)}{MASKED if loss else ''}\n")
        pieces, at, self.seen = [self.out.text], len(self.out.text), {}
        for part in parts:
            kind = part.get("kind") or "text"
            visit = getattr(self, f"visit_{kind}", self.visit_other)
            s = visit(part)
            if loss and kind == "text" and s:
                self.out.loss.append((at, at + len(s)))
            pieces.append(s)
            at += len(s)
        self.out.text = "".join([*pieces, END])
        return self.out

    def visit_text(self, part) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part) -> str:
        return self._placeholder("image", part, self.expansion.image(part))

    def visit_audio(self, part) -> str:
        return self._placeholder("audio", part, self.expansion.audio(part))

    def visit_document(self, part) -> str:
        return self._placeholder("document", part, self.expansion.document(part))

    def visit_other(self, part) -> str:
        return self._placeholder("other", part, 1)

    def _placeholder(self, kind: str, part, tokens: int) -> str:
        n = self.seen[kind] = self.seen.get(kind, 0) + 1
        self.out.attachments.append({"kind": kind, "number": n, "ref": part.get("ref"), "tokens": tokens})
        return f"<|{kind}:{n}|>"


_TURN_HEAD = re.compile(r"<\|turn\|>([^\n|]*)(\|mask)?\n", re.DOTALL)
_PLACE = re.compile(r"<\|(image|audio|document|other):([0-9]+)\|>")


def read_turn(text: str, loss: list[tuple[int, int]]) -> tuple[str, list[dict], str]:
    """Role, parts and the unescaped text under the mask, from a formatted turn."""
    m = _TURN_HEAD.match(text)
    if not m or not text.endswith(END):
        raise ValueError("not a formatted turn")
    parts, at, end = [], m.end(), len(text) - len(END)
    for p in _PLACE.finditer(text, at, end):
        if p.start() > at:
            parts.append({"kind": "text", "text": unescape(text[at:p.start()])})
        parts.append({"kind": p[1], "number": int(p[2])})
        at = p.end()
    if at < end or not parts:
        parts.append({"kind": "text", "text": unescape(text[at:end])})
    return unescape_role(m[1]), parts, "".join(unescape(text[a:b]) for a, b in loss)


_FORMATTED = ("role string, plain string, formatted string, loss array<struct<start:long,end:long>>, "
              "attachments array<struct<kind:string,number:int,ref:string,tokens:long>>, expanded_tokens long")


def _format(expansion: Expansion):
    def run(batches):
        loss_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        att_type = pa.list_(pa.struct([("kind", pa.string()), ("number", pa.int32()), ("ref", pa.string()),
                                       ("tokens", pa.int64())]))
        visitor = Visitor(expansion)
        for b in batches:
            text, loss, att, tokens, roles, plain = [], [], [], [], [], []
            for role, parts in zip(b.column("role").to_pylist(), b.column("parts").to_pylist(), strict=True):
                f = visitor.turn(role, [p for p in parts or [] if p])
                text.append(f.text)
                roles.append(role or "")
                plain.append("".join(p.get("text") or "" for p in parts or [] if p))
                loss.append([{"start": x, "end": y} for x, y in f.loss])
                att.append(f.attachments)
                tokens.append(sum(a["tokens"] for a in f.attachments))
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("turn"), pa.array(roles, pa.string()), pa.array(plain, pa.string()), pa.array(text, pa.string()), pa.array(loss, loss_type),
                 pa.array(att, att_type), pa.array(tokens, pa.int64())],
                ["conv_id", "turn", "role", "plain", "formatted", "loss", "attachments", "expanded_tokens"])
    return run


def as_parts(turns: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows with a text become rows with one text part."""
    part = F.struct(F.lit("text").alias("kind"), F.col(text_col).cast("string").alias("text"),
                    F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("width"),
                    F.lit(None).cast("int").alias("height"), F.lit(None).cast("double").alias("seconds"),
                    F.lit(None).cast("int").alias("pages"))
    return turns.select("conv_id", "turn", "role", F.array(part).alias("parts"))


def format_turns(turns: DataFrame, expansion: Expansion | None = None) -> DataFrame:
    """One formatted row for each of ``(conv_id, turn, role, parts)``:
    ``role`` and ``plain`` text (for the order of turns with one number),
    ``formatted``, the spans of the loss mask, attachments and their tokens."""
    prepare(turns.sparkSession)
    src = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.col("role").cast("string").alias("role"), F.col("parts").cast(f"array<{PART}>").alias("parts"))
    return src.mapInArrow(_format(expansion or Expansion()), f"conv_id long, turn long, {_FORMATTED}")


def assemble(formatted: DataFrame) -> DataFrame:
    """Whole conversations: ``(conv_id, n_turns, formatted)``."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "plain", "formatted")))
    return (formatted.groupBy("conv_id").agg(turns.alias("t"))
            .select("conv_id", F.size("t").cast("long").alias("n_turns"),
                    F.array_join(F.col("t.formatted"), "").alias("formatted")))


def _digest(batches):
    now: list | None = None

    def row(x):
        conv, n, turns, loss_n, loss, chars = x
        return pa.RecordBatch.from_arrays(
            [pa.array([conv], pa.int64()), pa.array([n], pa.int64()), pa.array([turns.hexdigest()]),
             pa.array([loss_n], pa.int64()), pa.array([loss.hexdigest()]), pa.array([chars], pa.int64())],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for b in batches:
        done = []
        for conv, text, loss in zip(b.column("conv_id").to_pylist(), b.column("formatted").to_pylist(),
                                    b.column("loss").to_pylist(), strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    done.append(row(now))
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, parts, learnt = read_turn(text, [(s["start"], s["end"]) for s in loss])
            own = "".join(p.get("text", "") for p in parts)
            now[1] += 1
            now[2].update(f"{role}\n{own}\n".encode("utf-8", "surrogatepass"))
            now[3] += len(learnt)
            now[4].update(learnt.encode("utf-8", "surrogatepass"))
            now[5] += len(text)
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
    if now is not None:
        yield row(now)


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the formatted turns of each conversation."""
    own = formatted.select("conv_id", "turn", "role", "plain", "formatted", "loss")
    return (own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "plain", "formatted")
            .mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                 "loss_sha256 string, formatted_chars long"))


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts look like another template's control strings."""
    text = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)],
                                 "conv_id long, turn long, role string, text string")
