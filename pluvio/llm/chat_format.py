"""Chat formatting checked by a round trip through a grammar (operator 4).

    conversation := turn*
    turn         := "<<SYS>>" body "<</SYS>>"            role system
                  | "[INST]" body "[/INST]"              role user
                  | "<s>" body "</s>"                    role assistant, the loss mask
                  | "<|role|>" name "<|text|>" body "<|/role|>"   any other role, also null

A body is text in which no control string stands; the parser reads the rendered text from the
left without looking back, so there is one way to read it. Turns are first rendered as they
are. The text is parsed, and the recovered turns are compared with the source. Where they
differ, the conflicting content is escaped (one backslash after the first character of each
control string, and of each one that has backslashes there already), and this repeats until
they are identical. Escaped or not, the parser undoes a backslash at such a place, so that
texts with backslashes of their own are conflicts too.

Conversations are dealt out by their id and read in the order of their turns as a stream; a
conversation of any length is formatted and digested turn by turn and never held whole.

Defined results: a null text is empty; turns come by number, null first, ties by role, then
text; repeated rows are repeated turns; a null role is another role with the name ``\\N`` (a role
so named is escaped); a null conv_id is a conversation; extra columns play no part; an empty
table gives an empty one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAMES = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<|role|>", "<|text|>", "<|/role|>")
CONTROL = (*[x for pair in FRAMES.values() for x in pair], *OTHER)
_PLAIN = re.compile("|".join(map(re.escape, CONTROL)))
#: A control string with any number of backslashes after its first character.
_LIKE = re.compile("|".join(re.escape(c[0]) + r"(\\*)" + re.escape(c[1:]) for c in CONTROL))
_ESCAPED = re.compile("|".join(re.escape(c[0]) + r"(?:\\)+" + re.escape(c[1:]) for c in CONTROL))
_OPENING = {FRAMES[r][0]: r for r in FRAMES}
NULL_ROLE = "\\N"

Turn = tuple[str | None, str]


def escape(text: str) -> str:
    return _LIKE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def _role_name(role: str | None) -> str:
    """``\\N`` for null; a real name that is one or more backslashes and N gets one more."""
    if role is None:
        return NULL_ROLE
    return "\\" + role if re.fullmatch(r"\\+N", role) else role


def _read_role(name: str) -> str | None:
    if name == NULL_ROLE:
        return None
    return name[1:] if re.fullmatch(r"\\\\+N", name) else name


def frame(role: str | None, body: str, name: str | None = None) -> str:
    """One turn around ``body`` (and ``name``, of another role), both as they shall stand."""
    if role in FRAMES:
        opening, closing = FRAMES[role]
        return opening + body + closing
    return OTHER[0] + (_role_name(role) if name is None else name) + OTHER[1] + body + OTHER[2]


def parse(rendered: str) -> list[Turn] | None:
    """The turns of a rendered text; None if it isn't one."""
    turns: list[Turn] = []
    at = 0
    while at < len(rendered):
        opening = _PLAIN.match(rendered, at)
        if not opening or opening[0] not in (*_OPENING, OTHER[0]):
            return None
        role, want = _OPENING.get(opening[0]), OTHER[1]
        start = opening.end()
        if opening[0] in _OPENING:
            want = FRAMES[role][1]  # type: ignore[index]
        else:
            close = _PLAIN.search(rendered, start)
            if not close or close[0] != OTHER[1]:
                return None
            role = _read_role(unescape(rendered[start : close.start()]))
            if role in FRAMES:
                return None
            start, want = close.end(), OTHER[2]
        close = _PLAIN.search(rendered, start)
        if not close or close[0] != want:
            return None
        turns.append((role, unescape(rendered[start : close.start()])))
        at = close.end()
    return turns


def render(turns: list[Turn]) -> list[str]:
    """Each turn as it stands in the output. Their concatenation parses back to ``turns``."""
    parts = [frame(role, text) for role, text in turns]
    back = parse("".join(parts))
    if back == turns:
        return parts
    for i, (role, text) in enumerate(turns):  # each turn whose own text doesn't come back is a conflict
        if parse(parts[i]) != [(role, text)]:
            parts[i] = frame(role, escape(text), escape(_role_name(role)))
    if parse("".join(parts)) != turns:
        raise ValueError("a conversation doesn't come back from its format")
    return parts


def _in_order(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of whole conversations together and in order, in parts."""
    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    narrow = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", text)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return narrow.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int | None], list[Turn], list[str]]]:
    for batch in batches:
        ids = batch.column("conv_id").to_pylist()
        turns = list(zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True))
        yield ids, turns, render(turns)


def format_turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, formatted, loss_start, loss_length: the output of each turn, in order
    within its conversation; joined, a conversation's outputs are its formatted text. The loss
    span is in code points of ``formatted``, null where the turn isn't an assistant's."""
    schema = rows.select(F.col("conv_id").cast("long"), "turn", "role").schema.add("formatted", "string").add("loss_start", "integer").add("loss_length", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opening, closing = FRAMES["assistant"]
        for batch in batches:
            ((_, turns, parts),) = _rendered(iter([batch]))
            mine = [role == "assistant" for role, _ in turns]
            start = pa.array([len(opening) if m else None for m in mine], pa.int32())
            length = pa.array([len(p) - len(opening) - len(closing) if m else None for m, p in zip(mine, parts, strict=True)], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array(parts, pa.string()), start, length], names=schema.names)

    return _in_order(rows).mapInArrow(run, schema)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Digest:
    """What is read back from one conversation's output, as its turns pass."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.n, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, output: str) -> None:
        self.chars += len(output)
        turns = parse(output)
        if turns is None:
            raise ValueError("a part of the output isn't one of turns")
        for role, text in turns:
            self.n += 1
            self.turns.update(f"{role or ''}\n{text}\n".encode())
            if role == "assistant":
                self.loss_chars += len(text)
                self.loss.update(text.encode())

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


def digests(rows: DataFrame) -> DataFrame:
    """Per conversation the DIGEST columns, read back from the formatted output."""
    schema = pa.schema([(c, pa.string() if "sha" in c else pa.int64()) for c in (f.split()[0] for f in DIGEST.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Digest | None = None
        for ids, _, parts in _rendered(batches):
            done = []
            for conv_id, part in zip(ids, parts, strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Digest(conv_id)
                now.take(part)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=schema)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], schema=schema)

    return _in_order(rows).mapInArrow(run, DIGEST)
