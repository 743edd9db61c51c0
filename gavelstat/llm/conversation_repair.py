"""Conversations whose turns break the order of roles, repaired at least cost.

1. ``light`` turns rows into small ones: initial of the role, digest, fault.  Equal rows of a turn become one with a
   count before anything is shuffled; the first turn of a text comes from an aggregation, not a window, so that a
   text said a million times is no hot group.
2. Light rows are sorted by range over all conversations, so that a large conversation lies in several tasks.  Each
   task repairs its stretch from every stack it may be entered with (``glr``), one only where the conversation
   starts there.
3. Stretches of a conversation are joined in order, keeping the least (cost, audit) per stack.
4. The script of edits and the rows meet in one stream per conversation: a digest over a conversation's text is
   sequential, so one task reads it, but holds its script and a batch of rows only.

Defined results: rows go by turn, nulls first; rows of one turn by role, then md5 of the text.  A null role or text
is one space; an empty or unknown role fits nowhere in the grammar.  Rows with a null conv_id form one conversation.
Equal rows are duplicates of the first.  Texts of any length are read whole.  An empty table gives no rows.  Other
columns than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from gavelstat.llm.frames import LEAST, bound_batches, schema_of
from gavelstat.llm.glr import Repair
from gavelstat.workspace import materialize

#: A system turn may lead; then user and assistant take turns.  A conversation may be empty.
ROLES = (
    ("talk", ()),
    ("talk", ("turns",)),
    ("talk", ("s", "turns")),
    ("turns", ("u", "a")),
    ("turns", ("turns", "u", "a")),
)
NAMES = {"u": "user", "a": "assistant"}
#: White space between words, as SQL's trim takes it.
_SPACE = " \t\n\x0b\x0c\r"
_ORDER = ["conv", "turn", "role", "digest"]


@lru_cache(maxsize=1)
def repairer() -> Repair:
    return Repair(ROLES, "".join(NAMES))


def _plain(rows: DataFrame) -> DataFrame:
    """conv, turn, role and text; nulls replaced, but for turn."""
    return rows.select(
        F.coalesce(F.col("conv_id").cast("bigint"), F.lit(LEAST)).alias("conv"),
        F.col("turn").cast("bigint").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")],
    )


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that crc32 of "conv_id:turn" (nulls: one space) chooses."""
    part = [F.coalesce(F.col(c).cast("bigint").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.pmod(F.crc32(F.concat_ws(":", *part)), F.lit(20))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    hurt = rows.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("__copies"),
    )
    copied = hurt.select("*", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), "__copies"))).alias("__copy"))
    return copied.filter(F.col("__copies") > 0).drop("__copies", "__copy")


def light(plain: DataFrame) -> DataFrame:
    """conv, turn, role, digest, n (equal rows), first (whether no earlier turn says the same), blank, truncated."""
    end = F.rtrim(F.col("text"), F.lit(_SPACE))
    small = plain.select(
        "conv", "turn", "role", F.md5("text").alias("digest"), (F.length(end) == 0).alias("blank"),
        (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
    )
    counted = small.groupBy(*_ORDER, "blank", "truncated").agg(F.count("*").alias("n"))
    first = counted.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("at"))  # nulls are least
    same_turn = F.col("at.turn").eqNullSafe(F.col("turn"))
    return counted.join(first, ["conv", "role", "digest"]).select(
        *_ORDER, "n", same_turn.alias("first"), "blank", "truncated"
    )


# ---- stretches ----

STRETCH = (
    "conv bigint, part int, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "least_turn bigint, most_turn bigint, turns bigint, first_initial string, last_initial string, "
    "paths array<struct<enter:int,leave:int,cost:bigint,script:string>>"
)


def _initial(role: str) -> str:
    return role[0] if role and role[0] in "sua" else "-"


def _stretch(conv: int, part: int, rows: Iterable[tuple], from_start: bool) -> dict:
    """Counts and repairs of consecutive rows of one conversation."""
    out = dict.fromkeys(("n", "blank", "duplicate", "truncated", "illegal", "turns"), 0)
    out |= {"conv": conv, "part": part, "least_turn": None, "most_turn": None, "first_initial": None}
    symbols, before = [], None
    for _, turn, role, _, n, first, blank, truncated in rows:
        initial = _initial(role)
        if turn is not None and turn != out["most_turn"]:
            out["least_turn"] = turn if out["least_turn"] is None else out["least_turn"]
            out["most_turn"], out["turns"] = turn, out["turns"] + 1
        if before is None:
            out["first_initial"] = initial
        else:
            out["illegal"] += before + initial not in ("su", "ua", "au")
        out["illegal"] += n - 1  # equal rows side by side
        out["n"] += n
        fresh = int(first and not blank)
        out["blank"] += n if blank else 0
        out["duplicate"] += 0 if blank else n - fresh
        out["truncated"] += truncated and fresh
        symbols += [(initial, False, truncated)] * fresh + [(initial, True, False)] * (n - fresh)
        before = initial
    repair = repairer()
    out["last_initial"] = before
    out["paths"] = [
        {"enter": repair.number[cell], "leave": repair.number[leave], "cost": cost, "script": script}
        for cell in ([repair.start] if from_start else repair.cells)
        for leave, cost, script in repair.paths(symbols, cell)
    ]
    return out


def _tuples(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _rows_out(found: Iterable[dict], schema: pa.Schema, most: int = 1000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in found:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def stretches(small: DataFrame) -> DataFrame:
    """What each task makes of its part of every conversation, in the order of ``part``."""
    ordered = small.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER)
    schema = schema_of(STRETCH)
    arrow = to_arrow_schema(schema)

    def run(batches):
        part = TaskContext.get().partitionId()
        groups = enumerate(groupby(_tuples(batches), key=lambda r: r[0]))
        # only the first conversation of a task can have begun in another one
        yield from _rows_out((_stretch(conv, part, rows, at > 0) for at, (conv, rows) in groups), arrow)

    return ordered.select(*_ORDER, "n", "first", "blank", "truncated").mapInArrow(run, schema)


SCRIPT = (
    "conv bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, script string"
)


def _joined(conv: int, parts: Iterable[dict]) -> dict:
    repair = repairer()
    alive = {repair.number[repair.start]: (0, "", "")}  # cost, audit, script
    total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    least = most = before = None
    turns = 0
    for part in parts:
        for name in total:
            total[name] += part[name]
        if before is not None:
            total["illegal"] += before + part["first_initial"] not in ("su", "ua", "au")
        before = part["last_initial"]
        if part["turns"]:
            turns += part["turns"] - (part["least_turn"] == most)
            least, most = part["least_turn"] if least is None else least, part["most_turn"]
        new: dict[int, tuple[int, str, str]] = {}
        for path in part["paths"]:
            if path["enter"] in alive:
                cost, audit, script = alive[path["enter"]]
                value = (cost + path["cost"], audit + repair.audit(path["script"]), script + path["script"])
                new[path["leave"]] = min(new.get(path["leave"], value), value)
        alive = new
    cost, script = repair.finish((repair.cells[i], c, s) for i, (c, _, s) in alive.items())
    gaps = most - least + 1 - turns if turns else 0
    return {"conv": conv, "gaps": gaps, "cost": cost, "script": script} | total


def scripts(rows: DataFrame) -> DataFrame:
    """Counts of faults, cost and script of edits of every conversation that has rows."""
    small = materialize(light(_plain(rows)), "turns")
    schema = schema_of(SCRIPT)
    arrow = to_arrow_schema(schema)
    names = [f.name for f in schema_of(STRETCH)]

    def run(batches):
        rows = (dict(zip(names, r)) for r in _tuples(batches))
        yield from _rows_out((_joined(c, g) for c, g in groupby(rows, key=lambda r: r["conv"])), arrow)

    found = stretches(small)
    return found.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(run, schema)


# ---- repaired turns ----


def _replayed(rows: Iterable[tuple[str, str]], script: str) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of every turn that stays or comes in."""
    rows = iter(rows)
    for edit in script:
        if edit in NAMES:
            yield edit, NAMES[edit], ""
            continue
        role, text = next(rows)
        if edit != "D":
            yield edit, NAMES.get(edit.lower(), role) if edit != "K" else role, text


def _replay(rows: DataFrame, found: DataFrame, each: Callable[[int, Iterator], Iterable[dict]], ddl: str) -> DataFrame:
    """``each`` gets a conversation and its repaired turns as a stream and makes rows of them."""
    bound_batches(rows.sparkSession)
    schema = schema_of(ddl)
    arrow = to_arrow_schema(schema)
    said = _plain(rows).select("conv", F.lit(1).alias("kind"), "turn", "role", F.md5("text").alias("digest"), "text")
    lead = found.select(
        "conv", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"),
        F.lit("").alias("digest"), F.col("script").alias("text"),
    )
    keys = ["conv", "kind", "turn", "role", "digest"]
    stream = lead.unionByName(said).repartition("conv").sortWithinPartitions(*keys).select("conv", "role", "text")

    def run(batches):
        def made():
            for conv, turns in groupby(_tuples(batches), key=lambda r: r[0]):
                script = next(turns)[2]
                yield from each(conv, _replayed(((role, text) for _, role, text in turns), script))

        yield from _rows_out(made(), arrow, 256)

    return stream.mapInArrow(run, schema)


def _conv_id(column: str = "conv") -> Column:
    return F.when(F.col(column) != LEAST, F.col(column)).alias("conv_id")


def repaired(rows: DataFrame) -> DataFrame:
    """conv_id, place, role, text and edit of every turn after the repair."""

    def each(conv, turns):
        for place, (edit, role, text) in enumerate(turns):
            yield {"conv": conv, "place": place, "role": role, "text": text, "edit": edit}

    ddl = "conv bigint, place bigint, role string, text string, edit string"
    return _replay(rows, scripts(rows), each, ddl).select(_conv_id(), "place", "role", "text", "edit")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv and repaired_sha256."""

    def each(conv, turns):
        sha = hashlib.sha256()
        for place, (_, role, text) in enumerate(turns):
            sha.update(f"{chr(10) * (place > 0)}{role}:{text}".encode())
        yield {"conv": conv, "repaired_sha256": sha.hexdigest()}

    return _replay(rows, found, each, "conv bigint, repaired_sha256 string")


def summary(rows: DataFrame, original: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of the repair for every conv_id of ``original``, rows or not."""
    found = materialize(scripts(rows), "scripts")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    letters = "".join(NAMES)
    audit = F.translate("script", letters + letters.upper(), "II" + "RR")
    every = _plain_ids(original).join(found, "conv", "left").join(digests(rows, found), "conv", "left")
    return every.select(
        _conv_id(), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
        F.coalesce(audit, F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def _plain_ids(rows: DataFrame) -> DataFrame:
    return rows.select(F.coalesce(F.col("conv_id").cast("bigint"), F.lit(LEAST)).alias("conv")).distinct()
