"""Removal of word sequences that an earlier document has, on a compacted de Bruijn graph.

Edges are the k-mers of WORDS consecutive words, named by hashes; nodes are what neighbouring k-mers share.

1. k-mers of a document that have one minimizer, the least name of MINIMIZER words, form a chain: a path without
   branches inside, cut where the minimizer changes (``windows``).  Paths are counted by an aggregation.
2. Paths found in several documents are the repeated part of the graph.  A link leads from a path to the one that
   follows it in a document.  Where all occurrences of two paths are linked, nothing branches off between them;
   joins of links and counts find these places, and such paths are compacted into one unitig along their first
   document.
3. Each traversal of a unitig is a span with the coordinates of its source.  Spans are verified: words there
   and at the source must have equal independent hashes.
4. Paths that differ but share a minimizer are where the graph branches; there k-mers are compared one by one.
   A minimizer with very many paths is not gathered in a task: its k-mers go by their own names.
5. Verified spans and repeated k-mers come back to their documents, whose covered words are removed.

Defined results: a null text has no words; texts below WORDS words stay whole.  "Earlier" is a smaller doc_id,
nulls first; rows that share a doc_id are not earlier than each other, and repeated rows get equal results.
An empty table gives no rows.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gavelstat.llm.frames import LEAST, fewer, keyed_texts, map_batches, small, steps
from gavelstat.llm.windows import Windows, covered, names, pack, runs, signed
from gavelstat.workspace import materialize

WORDS, MINIMIZER = 50, 8
WINDOWS = Windows(WORDS, MINIMIZER, WORDS)
#: Paths of one minimizer from which its k-mers go by their own names.
LARGE_BUCKET = 4096
#: Tasks that the spans of one unitig are spread over.
SALTS = 8
#: Rows that a task compares together.
TOGETHER = 20_000


def word_names(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


# ---- the graph ----


def chains(source: DataFrame) -> DataFrame:
    """bucket (minimizer), path, doc, mark and at of every chain."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for step in steps(batch, "text"):
            words = [t.encode().split() for t in step.column(2).to_pylist()]
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            docs, marks = (step.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for c in WINDOWS.chains(np.concatenate([word_names(w) for w in words]), sizes):
                yield {
                    "bucket": signed(c.bucket), "path": signed(c.path), "doc": docs[c.doc],
                    "mark": marks[c.doc], "at": pack(c.start, c.count),
                }

    return map_batches(source, run, "bucket bigint, path bigint, doc bigint, mark bigint, at bigint")


def occurrences(found: DataFrame) -> DataFrame:
    """Chains whose path or minimizer is in several documents, with what is known of the path.

    ``n``: occurrences, ``first_doc``, ``repeated``: in several documents, ``branches``: other paths have the
    minimizer.
    """
    paths = found.groupBy("bucket", "path").agg(
        F.count("*").alias("n"), F.min("doc").alias("first_doc"), F.max("doc").alias("last_doc")
    )
    buckets = paths.groupBy("bucket").agg(
        F.min("first_doc").alias("low"), F.max("last_doc").alias("high"), (F.count("*") > 1).alias("branches")
    )
    shared = paths.join(buckets.filter("low < high"), "bucket")
    shared = shared.select("path", "n", "first_doc", (F.col("first_doc") < F.col("last_doc")).alias("repeated"), "branches")
    shared = small(shared.filter("repeated or branches"), "paths")
    return found.join(shared, "path")


def _start():
    return F.shiftright("at", 7)


def _count():
    return F.col("at").bitwiseAND(127)


def unitigs(occurring: DataFrame) -> DataFrame:
    """Compacted paths: head (path), source_doc, source_mark, source_start and kmers (their number)."""
    rows = occurring.filter("repeated").select(
        "path", "doc", "mark", _start().alias("start"), _count().alias("kmers"), "n", "first_doc"
    )
    along = Window.partitionBy("doc", "mark").orderBy("start")
    follow = rows.select(
        "path", "n", (F.col("start") + F.col("kmers") == F.lead("start").over(along)).alias("adjacent"),
        F.lead("path").over(along).alias("next"), F.lead("n").over(along).alias("next_n"),
    ).filter("adjacent")
    links = follow.groupBy("path", "next", "n", "next_n").agg(F.count("*").alias("linked"))
    whole = links.filter("linked = n and linked = next_n").select("path", F.lit(True).alias("goes_on"))
    source = rows.filter("doc = first_doc").join(whole, "path", "left")
    source = source.withColumn("head", ~F.coalesce(F.lag("goes_on").over(along), F.lit(False)))
    so_far = along.rowsBetween(Window.unboundedPreceding, 0)
    head_start = F.last(F.when(F.col("head"), F.col("start")), ignorenulls=True).over(so_far)
    source = source.withColumn("head_start", head_start)
    joined = source.groupBy("doc", "mark", "head_start").agg(
        F.max(F.when(F.col("head"), F.col("path"))).alias("head"), F.sum("kmers").alias("kmers")
    )
    return joined.groupBy("head").agg(
        F.min(F.struct(
            F.col("doc").alias("source_doc"), F.col("mark").alias("source_mark"),
            F.col("head_start").alias("source_start"), "kmers"
        )).alias("u")
    ).select("head", "u.*")


# ---- verification ----


def wanted(occurring: DataFrame) -> DataFrame:
    """What has to be read again: doc, mark, team, start, kmers, and the kind of comparison.

    ``span``: the words of a unitig's source and traversals; ``few`` and ``many``: k-mers where paths branch.
    """
    compact = small(unitigs(occurring), "unitigs")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    team = F.xxhash64("head", "salt").alias("team")
    sources = compact.select("*", salt).select(
        F.col("source_doc").alias("doc"), F.col("source_mark").alias("mark"), team,
        F.col("source_start").alias("start"), "kmers", F.lit("span").alias("kind"),
    )
    spans = occurring.filter("repeated and doc > first_doc").join(compact, F.col("path") == F.col("head"))
    spans = spans.withColumn("salt", F.pmod(F.hash("doc", "mark", "at"), F.lit(SALTS)))
    spans = spans.select("doc", "mark", team, _start().alias("start"), "kmers", F.lit("span").alias("kind"))
    # later occurrences of a path repeat it throughout; only those of its first document can branch
    open_ = occurring.filter("branches and doc = first_doc")
    large = open_.groupBy("bucket").agg(F.count("*").alias("paths")).filter(F.col("paths") > LARGE_BUCKET)
    open_ = open_.join(large, "bucket", "left").select(
        "doc", "mark", F.col("bucket").alias("team"), _start().alias("start"), _count().alias("kmers"),
        F.when(F.col("paths").isNull(), "few").otherwise("many").alias("kind"),
    )
    return sources.unionByName(spans).unionByName(open_)


READ_DDL = "team bigint, known boolean, doc bigint, mark bigint, start bigint, kmers bigint, check bigint, kmer_names binary"


def read_again(asked: DataFrame, source: DataFrame) -> DataFrame:
    """Hashes of the words of spans, names of the k-mers where paths branch."""
    row = F.struct("team", "start", "kmers", "kind")
    per_doc = asked.groupBy("doc", "mark").agg(F.collect_list(row).alias("asked"))
    joined = source.join(per_doc, ["doc", "mark"]).select("doc", "mark", "text", "asked")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for step in steps(batch, "text"):
            out: list[tuple] = []
            for doc, mark, text, rows in zip(*(step.column(i).to_pylist() for i in range(4))):
                words = text.encode().split()
                symbols = word_names(words) if any(r["kind"] != "span" for r in rows) else None
                for r in rows:
                    team, start, n = r["team"], r["start"], r["kmers"]
                    if r["kind"] == "span":
                        check = xxhash.xxh64_intdigest(b" ".join(words[start : start + n - 1 + WORDS])) >> 1
                        out.append((team, False, doc, mark, start, n, check, None))
                        continue
                    found = names(symbols[start : start + n - 1 + WORDS], WORDS)[0]
                    if r["kind"] == "few":
                        out.append((team, False, doc, mark, start, n, None, found.tobytes()))
                    else:
                        out += [(t, False, doc, mark, start + i, 1, 0, None) for i, t in enumerate(signed(found).tolist())]
            if out:
                yield dict(zip((c.split(" ")[0] for c in READ_DDL.split(", ")), zip(*_ahead(out))))

    return map_batches(joined, run, READ_DDL)


def _ahead(rows: list[tuple]) -> list[tuple]:
    """Of single k-mers all but those of the least document are known to repeat it, and leave their team."""
    least: dict[int, int] = {}
    for team, _, doc, _, _, _, check, _ in rows:
        if check == 0:
            least[team] = min(doc, least.get(team, doc))
    return [
        (hash(r[2:5]), True, *r[2:]) if r[6] == 0 and r[2] > least[r[0]] else r
        for r in rows
    ]


def compare(read: DataFrame) -> DataFrame:
    """Spans and k-mers that an earlier document has: doc, mark, start, kmers."""
    arrow = pa.schema([(c, pa.int64()) for c in ("doc", "mark", "start", "kmers")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(batch.column(i).to_pylist() for i in range(8)))
            if len(held) >= TOGETHER:
                cut = next((i for i in range(len(held) - 1, 0, -1) if held[i][0] != held[i - 1][0]), 0)
                yield from finished(held[:cut])
                held = held[cut:]
        yield from finished(held)

    def finished(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        found = np.concatenate([_repeated_spans(rows), _repeated_kmers(rows)])
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found.T], schema=arrow)

    ordered = read.repartition("team").sortWithinPartitions("team", "doc", "mark", "start")
    return ordered.mapInArrow(run, "doc bigint, mark bigint, start bigint, kmers bigint")


def _repeated_spans(rows: list[tuple]) -> np.ndarray:
    """Rows whose words hash as those of the team's first document, the source."""
    source: dict[int, tuple[int, int]] = {}
    out = []
    for team, known, doc, mark, start, kmers, check, _ in rows:
        if check is not None:
            first, expected = source.setdefault(team, (doc, check))
            if known or doc > first and check == expected:
                out.append((doc, mark, start, kmers))
    return np.asarray(out, np.int64).reshape(-1, 4)


def _repeated_kmers(rows: list[tuple]) -> np.ndarray:
    """Runs of k-mers that a smaller document of the minimizer has."""
    rows = [r for r in rows if r[7] is not None]
    if not rows:
        return np.zeros((0, 4), np.int64)
    doc, mark, start, count = (np.asarray([r[i] for r in rows], np.int64) for i in (2, 3, 4, 5))
    name = np.frombuffer(b"".join(r[7] for r in rows), np.uint64)
    row = np.repeat(np.arange(len(rows)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    _, first, inverse = np.unique(name, return_index=True, return_inverse=True)
    repeat = np.flatnonzero(doc[row] > doc[row[first]][inverse])
    begin, size = runs(repeat + row[repeat])  # the gap ends a run with its row
    begin = repeat[begin]
    owner = row[begin]
    return np.stack([doc[owner], mark[owner], start[owner] + nth[begin], size], axis=1)


# ---- removal ----


def remove(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document, and ``kept``, the remaining words."""
    source = keyed_texts(docs)
    occurring = materialize(occurrences(materialize(chains(source), "chains")), "occurrences")
    dealt = source.repartition("doc", "mark")  # one exchange for both joins with the texts
    places = compare(read_again(wanted(occurring), dealt))
    per_doc = places.groupBy("doc", "mark").agg(F.collect_list(F.struct("start", "kmers")).alias("places"))
    joined = fewer(dealt.join(per_doc, ["doc", "mark"], "left").select("doc", "text", "places"))
    columns = ["n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for step in steps(batch, "text"):
            rows = [cut(t, p) for t, p in zip(step.column(1).to_pylist(), step.column(2).to_pylist())]
            ids = [None if d == LEAST else d for d in step.column(0).to_pylist()]
            yield {"doc_id": ids} | dict(zip(columns, zip(*rows)))

    ddl = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    return map_batches(joined, run, ddl + ", kept string" * keep_text)


def cut(text: str, places: list[dict] | None) -> tuple[int, int, str, str]:
    """Sizes, digest and text of what the k-mers at ``places`` leave."""
    words = text.encode().split()
    kept = words
    if places:
        start, kmers = (np.asarray([p[k] for p in places], np.int64) for k in ("start", "kmers"))
        gone = covered(len(words), start, start + kmers - 1 + WORDS).tolist()
        kept = [w for w, g in zip(words, gone) if not g]
    joined = b" ".join(kept)
    return len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()
