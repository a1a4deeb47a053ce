"""Chat formatting with a grammar round trip: render, parse again, escape what came back otherwise, until nothing does.

Grammar of formatted text, one rule a role; a space parts text from marks, and marks hold no space:

    user       [INST] TEXT [/INST]
    assistant  <s> TEXT </s>
    system     <<SYS>> TEXT <</SYS>>
    other      [ROLE] NAME [TEXT] TEXT [/ROLE]

A control string after no backslash is a mark; after n > 0 backslashes it is text, and stands for n - 1 of them. The
parser knows one state at a time (outside, or in a turn that one mark closes), so a string has one parse or none. A text
is rendered as it is and parsed; where the turns read back are not the source's, each control string in the conflict
gets one more backslash, and the result is parsed again.

Edge cases: null and empty texts are empty; a null role is the role with the empty name; turns are ordered by turn (nulls
last), then role and piece; repeated rows are turns of their own; a null conv_id is one conversation. Other columns are left out.

Scale. Turns are rendered and verified where they are read, so a text that a third of all conversations share meets
nowhere. Only finished pieces are then dealt by conversation and sorted; a task strings them together as they pass. A conversation
longer than PART characters is several rows (part 0, 1, ...), cut between turns, and its digests are updated turn by turn, so memory
holds a part and not a conversation. One conversation stays one ordered stream, since its digest is one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>"), "system": ("<<SYS>> ", " <</SYS>>")}
OTHER = ("[ROLE] ", " [TEXT] ", " [/ROLE]")
CONTROL = r"</?s>|\[/?INST\]|<</?SYS>>|\[/?ROLE\]|\[TEXT\]"
ANY, ESCAPED, MARK = re.compile(CONTROL), re.compile(rf"\\({CONTROL})"), re.compile(rf"(?<!\\)(?:{CONTROL})")
OPENS = {opened.strip(): role for role, (opened, _) in TURN.items()} | {"[ROLE]": None}
PART = 1_000_000
PIECES = "conv_id long, turn long, role string, piece string, loss_start long, loss_end long, rounds int"
PARTS = "conv_id long, part int, formatted string, loss_starts array<long>, loss_ends array<long>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class Conflict(ValueError):
    """Formatted text that the grammar does not derive."""


def escape(text: str) -> str:
    return ANY.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> str:
    """One turn; role and text must be escaped where they need it."""
    if role in TURN:
        opened, closed = TURN[role]
        return opened + text + closed
    return OTHER[0] + role + OTHER[1] + text + OTHER[2]


def body_start(role: str) -> int:
    """Where the text starts in a rendered turn."""
    return len(TURN[role][0]) if role in TURN else len(OTHER[0]) + len(role) + len(OTHER[1])


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn, start and end of the text as it stands; raises Conflict."""
    marks = MARK.finditer(formatted)
    at = 0

    def body(wanted: str, start: int) -> int:
        """End of the text that the wanted mark closes, which must be the next one."""
        nonlocal at
        m = next(marks, None)
        if m is None or m[0] != wanted or m.start() - 1 < start or formatted[m.start() - 1] != " ":
            raise Conflict(f"no {wanted} where it must be, after {start}")
        at = m.end()
        return m.start() - 1

    for m in marks:
        if m.start() != at or m[0] not in OPENS or formatted[m.end() : m.end() + 1] != " ":
            raise Conflict(f"{m[0]} at {m.start()}")
        role, start = OPENS[m[0]], m.end() + 1
        if role is None:
            end = body("[TEXT]", start)
            role = unescape(formatted[start:end])
            if role in TURN or formatted[at : at + 1] != " ":
                raise Conflict(f"role {role} at {start}")
            start = at + 1
            end = body("[/ROLE]", start)
        else:
            end = body(TURN[role][1].strip(), start)
        yield role, unescape(formatted[start:end]), start, end
    if at != len(formatted):
        raise Conflict(f"text outside turns at {at}")


def settle(role: str, text: str) -> tuple[str, int, int, int]:
    """(piece, start and end of its text, rounds): escaped until the piece parses to this turn alone.

    The first rendering has the source's own strings. A rendering that does not come back gets its control strings
    escaped, which the grammar always reads back; a second failure is an error of the grammar and raises.
    """
    name, body = role, text
    for rounds in (1, 2):
        piece = render(name, body)
        try:
            turns = list(parse(piece))
        except Conflict:
            turns = []
        if [t[:2] for t in turns] == [(role, text)]:
            return piece, turns[0][2], turns[0][3], rounds
        name, body = (role if role in TURN else escape(role)), escape(text)
    raise Conflict(f"turn of role {role!r} does not come back")


def _settle_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        conv, turn, roles, texts = (batch.column(i) for i in range(4))
        done = [settle(r, t) for r, t in zip(roles.to_pylist(), texts.to_pylist())]
        piece, start, end, rounds = zip(*done) if done else ((),) * 4
        yield pa.RecordBatch.from_arrays(
            [conv, turn, roles, pa.array(piece, pa.string()), pa.array(start, pa.int64()), pa.array(end, pa.int64()), pa.array(rounds, pa.int32())],
            names=["conv_id", "turn", "role", "piece", "loss_start", "loss_end", "rounds"],
        )


def format_turns(df: DataFrame) -> DataFrame:
    """One row per turn of df (conv_id, turn, role, text): its verified piece, where its text stands in it (code points), rounds of rendering."""
    rows = df.select(
        df["conv_id"].cast("long").alias("conv_id"),
        df["turn"].cast("long").alias("turn"),
        F.coalesce(df["role"].cast("string"), F.lit("")).alias("role"),
        F.coalesce(df["text"].cast("string"), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(_settle_rows, PIECES)


def _join_pieces(batches: Iterable[pa.RecordBatch], part_chars: int) -> Iterator[pa.RecordBatch]:
    """Parts of conversations from pieces in order; a part ends before the piece that would make it longer than part_chars."""
    conv, part, size, pieces, starts, ends = None, -1, 0, [], [], []

    def flush() -> Iterator[pa.RecordBatch]:
        if pieces:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "part": part, "formatted": "".join(pieces), "loss_starts": starts, "loss_ends": ends}], _PARTS)

    for batch in batches:
        for key, role, piece, start, end in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "piece", "loss_start", "loss_end"))):
            if part < 0 or key != conv or size + len(piece) > part_chars:
                yield from flush()
                part = part + 1 if part >= 0 and key == conv else 0
                conv, size, pieces, starts, ends = key, 0, [], [], []
            if role == "assistant":
                starts.append(size + start)
                ends.append(size + end)
            pieces.append(piece)
            size += len(piece)
    yield from flush()


_PARTS = pa.schema([
    ("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("loss_starts", pa.list_(pa.int64())), ("loss_ends", pa.list_(pa.int64())),
])
_DIGEST = pa.schema([(x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in DIGEST.split(", ")])


def format_conversations(df: DataFrame, part_chars: int = PART) -> DataFrame:
    """Formatted conversations, one row per conversation of up to part_chars characters, more for a longer one: conv_id, part, formatted,
    and the loss mask as starts and ends (code points in this part) of the assistant's texts."""
    pieces = format_turns(df).repartition("conv_id")
    order = [F.asc_nulls_last("conv_id"), F.asc_nulls_last("turn"), "role", "piece"]
    return pieces.sortWithinPartitions(*order).mapInArrow(lambda batches: _join_pieces(batches, part_chars), PARTS)


def _digest_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, row = None, None

    def flush() -> Iterator[pa.RecordBatch]:
        if row is not None:
            conv, turns, loss = held
            yield pa.RecordBatch.from_pylist([row | {"conv_id": conv, "turns_sha256": turns.hexdigest(), "loss_sha256": loss.hexdigest()}], _DIGEST)

    for batch in batches:
        for conv, part, formatted, starts, ends in zip(*(c.to_pylist() for c in batch.columns)):
            if part == 0:
                yield from flush()
                held, row = (conv, hashlib.sha256(), hashlib.sha256()), dict.fromkeys(("n_turns", "loss_chars", "formatted_chars"), 0)
            _, turns, loss = held
            for role, text, _, _ in parse(formatted):
                turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                row["n_turns"] += 1
            for start, end in zip(starts, ends):
                text = unescape(formatted[start:end])
                loss.update(text.encode("utf-8", "surrogatepass"))
                row["loss_chars"] += len(text)
            row["formatted_chars"] += len(formatted)
    yield from flush()


def digest(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from what format_conversations returned: turns parsed from the text, the loss from its mask.

    Parts of a conversation follow each other in the rows of format_conversations; take its result as it is, or sort what was
    written by conv_id and part within partitions of conv_id.
    """
    return formatted.select("conv_id", "part", "formatted", "loss_starts", "loss_ends").mapInArrow(_digest_rows, DIGEST)
