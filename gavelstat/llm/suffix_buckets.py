"""Removal of repeated byte strings by bucket-pointer refinement over sampled suffixes.

1. Every window of LENGTH bytes falls into the bucket of its rarest-looking gram of GRAM bytes; runs of windows
   with one bucket form a chain (``windows``).  Buckets with one chain in the corpus are finished.
2. Chains are sorted by bucket, then refined by the identifiers of later offsets: the name of a string of 2h
   bytes is made from those at offsets 0 and h, recursively, up to the name of the whole chain.  Of equal
   chains all but the earliest are repeats throughout.
3. Chains that differ within one bucket are refined down to single windows.  A bucket of ordinary size is
   finished inside one task; the windows of a large one are grouped by their own names, so that no task holds
   a large bucket.
4. Repeated windows come back to their documents, whose covered bytes are removed.

Copies inside an input batch are settled before the shuffle, so that a large group of copies sends one row per
batch and chain.  Names are 64 bits within a bucket of 64 bits.

Defined results: a null text is empty; texts shorter than LENGTH bytes stay whole.  "Earlier" goes by doc_id,
nulls first; rows that share a doc_id go by a hash of their text, and equal rows count as one and get equal
results.  An empty table gives no rows.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelstat.llm.frames import LEAST, fewer, keyed_texts, map_batches, steps
from gavelstat.llm.windows import BYTE_NAMES, Windows, covered, names, pack, runs, signed, unpack
from gavelstat.workspace import materialize

LENGTH, GRAM = 100, 24
WINDOWS = Windows(LENGTH, GRAM, LENGTH)
#: Chains in a bucket from which its windows are grouped by their names across tasks.
LARGE_BUCKET = 4096
#: Rows that a task looks at together when it finishes buckets, and chains that it settles together.
TOGETHER, TOGETHER_CHAINS = 20_000, 1 << 20
CHAIN_DDL = "bucket bigint, path bigint, doc bigint, mark bigint, at bigint"


def byte_symbols(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Names of the bytes of all texts, and the texts' sizes."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return BYTE_NAMES[raw[offsets[0] : offsets[-1]]], np.diff(offsets).astype(np.int64)


# ---- chains ----


def chains(source: DataFrame) -> DataFrame:
    """bucket, path, doc, mark, at of every chain.

    The last bit of a path tells chains that may repeat themselves.  Path 0 marks a chain known to repeat an
    earlier one of its batch.
    """

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        parts: list[tuple] = []

        def settled():
            return dict(zip(("bucket", "path", "doc", "mark", "at"), settle(*map(np.concatenate, zip(*parts)))))

        for step in steps(batch, "text"):
            symbols, sizes = byte_symbols(step.column(2))
            docs, marks = (step.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for c in WINDOWS.chains(symbols, sizes):
                path = signed(c.path) & ~3 | 2 | c.periodic
                parts.append((signed(c.bucket), path, docs[c.doc], marks[c.doc], pack(c.start, c.count)))
            if sum(len(p[0]) for p in parts) > TOGETHER_CHAINS:
                yield settled()
                parts = []
        if parts:
            yield settled()

    return map_batches(source, run, CHAIN_DDL)


def settle(bucket, path, doc, mark, at):
    """Of equal chains all but the earliest lose their path and get a bucket at random, to spread them."""
    order = np.lexsort((at, mark, doc, path, bucket))
    bucket, path, doc, mark, at = (x[order] for x in (bucket, path, doc, mark, at))
    lead = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (path[1:] != path[:-1])))
    first = np.flatnonzero(lead)[np.cumsum(lead) - 1]
    repeat = _differs(first, doc, mark, at)
    bucket[repeat] = (doc[repeat] * 0x9E3779B1 + mark[repeat] + at[repeat]) * 0x85EBCA77
    path[repeat] = 0
    return bucket, path, doc, mark, at


def _differs(first: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """Which rows are at another place than the row at index ``first``."""
    return np.logical_or.reduce([x != x[first] for x in place])


def judge_chains(ordered: DataFrame) -> DataFrame:
    """From chains sorted by bucket, path, doc, mark and at: repeats (bucket null) and chains still to be refined.

    A stream: of a bucket that goes on only its first chain waits, until another path turns up.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # bucket, path and place of the first chain equal to the last row's; whether that one was sent to
        # refinement, and whether its bucket has shown several paths
        last, sent, many = None, False, False
        for batch in batches:
            rows = [batch.column(i).to_numpy() for i in range(5)]
            if not len(rows[0]):
                continue
            settled = rows[1] == 0
            yield _rows(None, *(x[settled] for x in rows[2:]))
            rows = [x[~settled] for x in rows]
            if last is not None:  # the leader takes part again, as the first row
                rows = [np.concatenate(([a], x)) for a, x in zip(last, rows)]
            bucket, path, *place = rows
            if not len(bucket):
                continue
            new_bucket = np.concatenate(([True], bucket[1:] != bucket[:-1]))
            new_path = new_bucket | np.concatenate(([True], path[1:] != path[:-1]))
            lead = np.flatnonzero(new_path)
            first = lead[np.cumsum(new_path) - 1]
            repeat = _differs(first, *place)
            yield _rows(None, *(x[repeat] for x in place))
            number = np.cumsum(new_bucket) - 1
            several = np.bincount(number[lead]) > 1
            several[0] |= many
            refine = several[number[lead]] | (path[lead] & 1 == 1)
            refine[0] &= not sent
            yield _rows(bucket[lead[refine]], *(x[lead[refine]] for x in place))
            sent, many = bool(refine[-1]) or (sent and len(lead) == 1), bool(several[-1])
            last = tuple(x[lead[-1]] for x in rows)

    return ordered.mapInArrow(run, "bucket bigint, doc bigint, mark bigint, at bigint")


def _rows(bucket, *place) -> pa.RecordBatch:
    first = pa.nulls(len(place[0]), pa.int64()) if bucket is None else pa.array(bucket, pa.int64())
    return pa.RecordBatch.from_arrays([first, *(pa.array(x, pa.int64()) for x in place)], ["bucket", "doc", "mark", "at"])


# ---- windows of differing chains ----


def chain_bodies(wanted: DataFrame, source: DataFrame) -> DataFrame:
    """What decides about chains: (team, known, doc, mark, at, body).

    Chains of one bucket are a team, with their bytes.  The windows of a chain of a large bucket go on by
    themselves, each in the team of its own name; those known to repeat one of their batch need no team.
    """
    columns = ("team", "known", "doc", "mark", "at", "body")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for step in steps(batch, "text"):
            small: list[tuple] = []
            large: list[tuple] = []
            for doc, mark, text, rows in zip(*(step.column(i).to_pylist() for i in range(4))):
                raw = text.encode()
                start, count = unpack(np.asarray([r["at"] for r in rows], np.int64))
                for r, a, n in zip(rows, start.tolist(), count.tolist()):
                    body = raw[a : a + n - 1 + LENGTH]
                    if r["large"]:
                        name = names(BYTE_NAMES[np.frombuffer(body, np.uint8)], LENGTH)[0]
                        large.append((signed(name), np.full(n, doc), np.full(n, mark), pack(a + np.arange(n), 1)))
                    else:
                        small.append((r["bucket"], False, doc, mark, r["at"], body))
            if small:
                yield dict(zip(columns, zip(*small)))
            if large:
                name, *place = map(np.concatenate, zip(*large))
                team, path, *place = settle(name, np.ones_like(name), *place)
                yield dict(zip(columns, (team, path == 0, *place, pa.nulls(len(team), pa.binary()))))

    rows = F.collect_list(F.struct("at", "bucket", "large")).alias("rows")
    per_doc = wanted.groupBy("doc", "mark").agg(rows)
    joined = source.join(per_doc, ["doc", "mark"]).select("doc", "mark", "text", "rows")
    return map_batches(joined, run, "team bigint, known boolean, doc bigint, mark bigint, at bigint, body binary")


def finish_teams(bodies: DataFrame) -> DataFrame:
    """Repeated windows: doc, mark and at of every run of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch.column(i).to_pylist() for i in range(6)))
            if len(held) >= TOGETHER:
                cut_at = next((i for i in range(len(held) - 1, 0, -1) if held[i][0] != held[i - 1][0]), 0)
                yield _finish(held[:cut_at])
                held = held[cut_at:]
        yield _finish(held)

    dealt = bodies.repartition("team").sortWithinPartitions("team", "doc", "mark", "at")
    return dealt.mapInArrow(run, "doc bigint, mark bigint, at bigint")


def _finish(rows: list[tuple]) -> pa.RecordBatch:
    """Rows of whole teams, sorted by team, doc, mark and at."""
    found = [tuple(place) for _, known, *place, _ in rows if known]
    rows = [r for r in rows if not r[1]]
    # a window by itself repeats the first of its team; rows of equal documents count as one
    first: dict[int, tuple[int, int, int]] = {}
    for team, _, *place, body in rows:
        if body is None and first.setdefault(team, tuple(place)) != tuple(place):
            found.append(tuple(place))
    places = [np.asarray(found, np.int64).reshape(-1, 3)]
    rows = [r for r in rows if r[5] is not None]
    rows = [r for r, before in zip(rows, [None, *rows]) if before is None or r[2:5] != before[2:5]]
    if rows:
        places.append(_repeated_windows(rows))
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in np.concatenate(places).T], ["doc", "mark", "at"])


def _repeated_windows(rows: list[tuple]) -> np.ndarray:
    doc, mark, at = (np.asarray([r[i] for r in rows], np.int64) for i in (2, 3, 4))
    start, count = unpack(at)
    symbols = BYTE_NAMES[np.frombuffer(b"".join(r[5] for r in rows), np.uint8)]
    row = np.repeat(np.arange(len(rows)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    body = np.cumsum(count + LENGTH - 1) - (count + LENGTH - 1)
    name = names(symbols, LENGTH)[0][body[row] + nth]
    # rows are in the order of documents, so the first index of a name is its earliest window
    _, first, inverse = np.unique(name, return_index=True, return_inverse=True)
    repeat = np.flatnonzero(first[inverse] != np.arange(len(name)))
    begin, size = runs(repeat + row[repeat])  # the gap ends a run with its row
    begin = repeat[begin]
    owner = row[begin]
    return np.stack([doc[owner], mark[owner], pack(start[owner] + nth[begin], size)], axis=1)


# ---- removal ----


def repeats(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places of repeated windows that whole chains show, and chains to be refined with their buckets."""
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = chains(source).repartition(parts, "bucket").sortWithinPartitions("bucket", "path", "doc", "mark", "at")
    judged = materialize(judge_chains(ordered), "chains")
    open_ = judged.filter(F.col("bucket").isNotNull())
    large = open_.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > LARGE_BUCKET)
    open_ = open_.join(large, "bucket", "left").withColumn("large", F.col("n").isNotNull())
    return judged.filter(F.col("bucket").isNull()).select("doc", "mark", "at"), open_


def remove(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and ``kept``, the remaining bytes."""
    source = keyed_texts(docs)
    whole, open_ = repeats(source)
    dealt = source.repartition("doc", "mark")  # one exchange for both joins with the texts
    places = whole.unionByName(finish_teams(chain_bodies(open_, dealt)))
    per_doc = places.groupBy("doc", "mark").agg(F.collect_list("at").alias("places"))
    joined = fewer(dealt.join(per_doc, ["doc", "mark"], "left").select("doc", "text", "places"))
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for step in steps(batch, "text"):
            rows = [cut(t.encode(), p) for t, p in zip(step.column(1).to_pylist(), step.column(2).to_pylist())]
            ids = [None if d == LEAST else d for d in step.column(0).to_pylist()]
            yield {"doc_id": ids} | dict(zip(columns, zip(*rows)))

    ddl = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return map_batches(joined, run, ddl + ", kept binary" * keep_text)


def cut(raw: bytes, places: list[int] | None) -> tuple[int, int, int, str, bytes]:
    """Sizes, digest and bytes of a text without the windows at ``places``."""
    removed = spans = 0
    kept = raw
    if places:
        start, count = unpack(np.asarray(places, np.int64))
        gone = covered(len(raw), start, start + count - 1 + LENGTH)
        removed = int(gone.sum())
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    return len(raw), removed, spans, hashlib.sha256(kept).hexdigest(), kept
