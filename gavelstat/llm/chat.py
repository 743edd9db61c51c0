"""Conversations as training texts, with the spans a model is to learn, and back.

Turns are sorted within Spark partitions and streamed through a compiled template, one conversation after the
other.  ``formatted`` returns whole texts, so there a task holds the text of one conversation; ``digests`` reads
every turn back as it comes and holds one turn at a time.

Defined results: a null text or role is empty.  Turns go by turn, nulls first; rows of one turn by role, then
text; repeated rows are turns of their own.  Rows with a null conv_id form one conversation.  An empty table
gives no rows.  Other columns than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gavelstat.llm.frames import schema_of
from gavelstat.llm.template import Piece, compile_template, joined

#: Strings that structure the output.  All start with < or [ and hold neither again.
CONTROL = ["<s>", "</s>", "<|text|>", "[INST]", "[/INST]"]
TEMPLATE = (
    "{% for m in messages %}<s>{{ m.role | escape }}<|text|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ '[INST] ' ~ '' }}{{ m.text | escape }} [/INST]{% endif %}</s>\n{% endfor %}"
)
_END = "</s>\n"  # no escaped value holds it
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_TURN = re.compile(r"<s>(.*?)<\|text\|>(?:\[INST\] (.*?) \[/INST\]|(.*?))</s>\n", re.S)


def escape(text: str) -> str:
    """Double the backslashes, then put one behind the first character of every control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted conversation."""
    turns, end = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != end:
            raise ValueError(f"not a turn at {end}")
        end = m.end()
        turns.append((unescape(m[1]), unescape(m[3] if m[2] is None else m[2])))
    if end != len(formatted):
        raise ValueError(f"not a turn at {end}")
    return turns


def streamed(rows: DataFrame, each: Callable[[int | None, Iterator[Piece]], dict], ddl: str,
             template: str = TEMPLATE) -> DataFrame:
    """``each`` gets a conversation's id and the pieces of its text, in order as they are made, and returns a row."""
    arrow = to_arrow_schema(schema_of(ddl))

    def run(batches: Iterable[pa.RecordBatch]):
        compiled = compile_template(template, {"escape": escape})
        turns = (t for b in batches for t in zip(*(b.column(i).to_pylist() for i in range(3))))
        turn = next(turns, None)
        done = []
        while turn is not None:
            conv_id = turn[0]

            def messages():
                nonlocal turn
                while turn is not None and turn[0] == conv_id:
                    yield {"role": turn[1], "text": turn[2]}
                    turn = next(turns, None)

            rest = messages()
            done.append(each(conv_id, compiled.pieces(messages=rest)))
            for _ in rest:  # turns that the template did not ask for
                pass
            if len(done) == 1000:
                yield pa.RecordBatch.from_pylist(done, schema=arrow)
                done = []
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=arrow)

    known = rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    )
    ordered = known.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(run, schema_of(ddl))


def conversations(rows: DataFrame, each: Callable[[int | None, str, list[tuple[int, int]]], dict], ddl: str,
                  template: str = TEMPLATE) -> DataFrame:
    """``each`` gets a conversation's id, whole text and marked spans and returns a row."""
    return streamed(rows, lambda conv_id, pieces: each(conv_id, *joined(pieces)), ddl, template)


def formatted(rows: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans (start and end in code points)."""
    return conversations(
        rows,
        lambda conv_id, text, spans: {
            "conv_id": conv_id, "formatted": text, "loss_spans": [{"start": a, "end": b} for a, b in spans]
        },
        "conv_id bigint, formatted string, loss_spans array<struct<start:bigint,end:bigint>>",
    )


def _digests(conv_id: int | None, pieces: Iterable[Piece]) -> dict:
    """Reads every turn back when its last piece has come and then lets go of it."""
    turns_sha, loss_sha = hashlib.sha256(), hashlib.sha256()
    n_turns = loss_chars = formatted_chars = 0
    held: list[str] = []
    for text, marked in pieces:
        held.append(text)
        formatted_chars += len(text)
        if marked:
            loss = unescape(text)
            loss_chars += len(loss)
            loss_sha.update(loss.encode())
        if text.endswith(_END):
            for role, said in read_back("".join(held)):
                n_turns += 1
                turns_sha.update(f"{role}\n{said}\n".encode())
            held = []
    if held:
        raise ValueError(f"no turn ends after turn {n_turns}")
    return {
        "conv_id": conv_id,
        "n_turns": n_turns,
        "turns_sha256": turns_sha.hexdigest(),
        "loss_chars": loss_chars,
        "loss_sha256": loss_sha.hexdigest(),
        "formatted_chars": formatted_chars,
    }


def digests(rows: DataFrame) -> DataFrame:
    """What can be read back from the formatted text of every conversation."""
    ddl = (
        "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint"
    )
    return streamed(rows, _digests, ddl)
