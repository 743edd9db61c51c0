"""Near duplicates: DartMinHash signatures, banded joining, exact checks.

1. A text is the multiset of its shingles of SHINGLE words.  ``darts`` gives its signature of BANDS x ROWS
   coordinates; a band is a hash of ROWS of them.  At a similarity of 0.8 two texts share no band with a
   probability below 10^-7.
2. Texts with the same words in the same order are copies: one of them goes on.
3. Texts that share a band are linked to the least of them.  The links' components, fields, hold every pair that
   shares a band.  Buckets are only aggregated and joined with one row each, whatever their size.
4. A field's texts are dealt into blocks of at most BLOCK.  The first block is compared with all, which joins
   what is alike around it.  What then still has another class than most of its field is compared, block by
   block, with everything.  So every pair of a field is compared exactly or already in one class, and no task
   holds more than two blocks.
5. Classes are the components of the pairs whose weighted Jaccard similarity is at least SIMILARITY.

Defined results: a null text is empty.  A text of fewer than SHINGLE words is one shingle; texts without words
are copies of each other.  The class is the least doc_id in it, nulls first; of rows with equal doc_ids in a class
one at most is kept.  An empty table gives no rows.  Other columns than doc_id and text are ignored by
``classes`` and carried along by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelstat.llm.components import components
from gavelstat.llm.darts import signatures
from gavelstat.llm.frames import LEAST, bound_batches, map_batches, small, steps
from gavelstat.llm.windows import combine, names, signed
from gavelstat.workspace import materialize

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 4
BLOCK = 512


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Names of the distinct shingles, and how often each occurs."""
    words = (text or "").encode().split()
    symbols = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if not words:
        return symbols, np.zeros(0)
    found, count = np.unique(names(symbols, min(SHINGLE, len(words)))[0], return_counts=True)
    return found, count.astype(float)


def identified(docs: DataFrame) -> DataFrame:
    """doc (doc_id, never null), node (a hash that stands for the text) and text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(_key().alias("doc"), F.xxhash64(text).alias("node"), text.alias("text"))


def _key():
    return F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LEAST))


def sketch(docs: DataFrame) -> DataFrame:
    """doc, node and bands of every document; no bands without words."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        for step in steps(batch, "text"):
            sets = [shingles(t) for t in step.column(2).to_pylist()]
            owner = np.repeat(np.arange(len(sets)), [len(found) for found, _ in sets])
            elements, counts = (np.concatenate(x) for x in zip(*sets))
            found = signatures(owner, elements, counts, len(sets), BANDS * ROWS).reshape(len(sets), BANDS, ROWS)
            bands = combine(combine(found[..., 0], found[..., 1], 400), combine(found[..., 2], found[..., 3], 401), 402)
            bands = signed(combine(bands, np.arange(1, BANDS + 1, dtype=np.uint64), 403))
            yield {
                "doc": step.column(0), "node": step.column(1),
                "bands": [b if len(s) else b[:0] for b, (s, _) in zip(bands, sets)],
            }

    return map_batches(identified(docs), run, "doc bigint, node bigint, bands array<bigint>")


def fields(sketched: DataFrame) -> DataFrame:
    """node and field: components of texts that share a band."""
    rows = sketched.select("node", F.explode("bands").alias("band"))
    meeting = rows.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most"))
    meeting = meeting.filter("least < most").select("band", "least")
    met = rows.join(meeting, "band").filter("node <> least")
    return components(met.select(F.col("node").alias("a"), F.col("least").alias("b"))).withColumnRenamed("label", "field")


# ---- exact comparison of blocks ----


def similar(a: list, b: list, similarity: float) -> Iterator[tuple[int, int]]:
    """Pairs of one text of ``a`` and one of ``b``, rows of node and text, enough of them to join all that are alike."""
    sets = [shingles(r["text"]) for r in a]
    element, count = (np.concatenate(x) for x in zip(*sets))
    owner = np.repeat(np.arange(len(a)), [len(s) for s, _ in sets])
    order = np.argsort(element, kind="stable")
    element, count, owner = element[order], count[order], owner[order]
    weight = np.asarray([c.sum() for _, c in sets])
    parent: dict[int, int] = {}

    def root(node: int) -> int:
        while parent.setdefault(node, node) != node:
            parent[node] = node = parent[parent[node]]
        return node

    for row in b:
        found, times = shingles(row["text"])
        low, high = np.searchsorted(element, found, "left"), np.searchsorted(element, found, "right")
        n = high - low
        place = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
        shared = np.bincount(owner[place], np.minimum(count[place], np.repeat(times, n)), len(a))
        alike = (shared > 0) & (shared * (1 + similarity) >= similarity * (weight + times.sum()) - 1e-9)
        for i in np.flatnonzero(alike).tolist():
            x, y = root(a[i]["node"]), root(row["node"])
            if x != y:
                parent[x] = y
                yield a[i]["node"], row["node"]


_BLOCK_ROWS = "array<struct<node:bigint,text:string>>"


def _compare(pairs: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) among pairs of blocks, columns left and right."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):  # two blocks at a time
                found = list(similar(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), similarity))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"]
                )

    bound_batches(pairs.sparkSession)
    return pairs.select("left", "right").mapInArrow(run, "a bigint, b bigint")


def _blocks(members: DataFrame, *by: str) -> DataFrame:
    return members.groupBy(*by, "block").agg(F.collect_list(F.struct("node", "text")).alias("rows"))


def _deal(size: str):
    """Number of a node's block, of about BLOCK out of ``size`` nodes."""
    return F.pmod(F.hash("node"), F.ceil(F.col(size) / BLOCK).cast("int")).alias("block")


def links(members: DataFrame, similarity: float) -> DataFrame:
    """Links enough to join the classes of fields; ``members``: node, field, size (of the field) and text."""
    blocks = _blocks(members.select("field", "node", "text", _deal("size")), "field")
    around = blocks.filter("block = 0").select("field", F.col("rows").alias("left"))
    near = small(_compare(blocks.select("field", F.col("rows").alias("right")).join(around, "field"), similarity), "links")
    wide = members.filter(F.col("size") > BLOCK)
    if wide.isEmpty():
        return near
    # what most of a field belongs to is in one class already; the rest meets everything
    labels = components(near)
    wide = wide.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = wide.groupBy("field", "label").agg(F.count("*").alias("n"))
    most = counts.groupBy("field").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    wide = wide.join(most, "field").withColumn("main", F.col("label") == F.col("main"))
    sizes = wide.groupBy("field").agg(
        F.count_if("main").alias("n_main"), F.count_if(~F.col("main")).alias("n_rest")
    ).filter("n_rest > 0")
    wide = wide.join(sizes, "field").withColumn("part", F.when(F.col("main"), F.col("n_main")).otherwise(F.col("n_rest")))
    blocks = small(_blocks(wide.select("field", "main", "node", "text", _deal("part")), "field", "main"), "blocks")
    rest = blocks.filter("not main").select("field", F.col("block").alias("i"), F.col("rows").alias("left"))
    right = blocks.select("field", "main", "block", F.col("rows").alias("right"))
    pairs = right.join(rest, "field").filter("main or i <= block")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return near.unionByName(_compare(pairs.repartition(parts, "field", "i", "main", "block"), similarity))


# ---- classes ----


def _joined(docs: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Distinct rows (node, doc) with how often each occurs and its class's label, and a row per class."""
    sketched = materialize(sketch(docs), "sketches")
    rows = sketched.groupBy("node", "doc").agg(F.count("*").alias("alike"))
    near = small(fields(sketched), "fields")
    sizes = near.groupBy("field").agg(F.count("*").alias("size"))
    one = sketched.groupBy("node").agg(F.min("doc").alias("doc")).join(near.join(sizes, "field"), "node")
    members = identified(docs).join(one, ["node", "doc"]).dropDuplicates(["node", "doc"]).drop("doc")
    labels = components(links(small(members, "members"), similarity))
    rows = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = small(rows, "rows")
    first = F.min(F.struct("doc", "node")).alias("first")
    groups = rows.groupBy("label").agg(first, F.sum("alike").alias("class_size"))
    groups = groups.select(
        "label", F.col("first.doc").alias("class_doc"), F.col("first.node").alias("class_node"), "class_size"
    )
    return rows, small(groups, "classes")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (least doc_id of the class), class_size (rows) and kept."""
    rows, groups = _joined(docs, similarity)
    out = rows.join(groups, "label")
    out = out.select("*", F.posexplode(F.sequence(F.lit(1).cast("bigint"), F.col("alike"))).alias("copy", "nth"))
    first = (F.col("doc") == F.col("class_doc")) & (F.col("node") == F.col("class_node")) & (F.col("copy") == 0)
    return out.select(_id("doc").alias("doc_id"), _id("class_doc").alias("class_id"), "class_size", first.alias("kept"))


def _id(column: str):
    return F.when(F.col(column) != LEAST, F.col(column))


def keep_first(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows, all columns, that stand for their class: of each one row with the least doc_id."""
    _, groups = _joined(docs, similarity)
    keys = ["_near_node", "_near_doc", "_near_row"]
    marked = docs.withColumns(
        dict(zip(keys, (F.xxhash64(F.coalesce("text", F.lit(""))), _key(), F.xxhash64(*docs.columns))))
    )
    best = marked.select(*keys).groupBy(*keys[:2]).agg(F.min(keys[2]).alias(keys[2]))
    best = best.join(groups.select(F.col("class_node").alias(keys[0]), F.col("class_doc").alias(keys[1])), keys[:2])
    return marked.join(best, keys, "left_semi").dropDuplicates(keys).drop(*keys)
