"""Mixing sources to target weights, by a splitting tree over exact block quotas.

A source is the sequence of its documents in the order of a hash, read as often as its target asks for.  The
words it gives are tiled with blocks of equal length, whose number is the source's exact quota.  A tree halves
the output shards; at each node the quotas are split by multivariate hypergeometric draws, so that every
shard gets the number of blocks of each source that a uniform shuffle of all blocks would give it.  A keyed
permutation of a source's block numbers then deals disjoint blocks to the shards, and within a shard pieces
are ordered by a hash.  Only sizes per source and the tree, sources x shards numbers, are on the driver.

Places in a source are running sums over hash buckets: no task holds a whole source, however large.

Defined results: a null text has no words; rows with the same doc_id are documents of their own, equal rows are
interchangeable; a null source is a source, the last; sources without words get nothing.  An empty table gives
no rows.  Other columns than doc_id, text and source are ignored by ``plan`` and carried along by ``mixture``.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gavelstat.llm.frames import gathered, small

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, the share of all words that the mix has, and the most copies.
WEIGHTS = (3, 1, 2)
SHARE, COPIES = 1.5, 2
BLOCK_WORDS = 4096
SHARDS = 16
SEED = 11
#: Blocks beyond which their length doubles; numpy draws from fewer than 10^9.
MOST_BLOCKS = 1 << 28
#: Hash buckets that a source's running sums go through.
BUCKETS = 1 << 12


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def targets(sizes: list[int], weights: list[int], share: float = SHARE, copies: int = COPIES) -> list[float]:
    """Words per source: by weight, none above ``copies`` times its size, the excess dealt out again by weight."""
    total = share * sum(sizes)
    # sources fill up in the order of size over weight; the first that stays below its limit ends it
    order = sorted(range(len(sizes)), key=lambda i: copies * sizes[i] / weights[i])
    left, weight = total, sum(weights)
    out = [0.0] * len(sizes)
    full = 0
    for k, i in enumerate(order):
        level = (total - full) / weight
        if level * weights[i] < copies * sizes[i]:
            for j in order[k:]:
                out[j] = level * weights[j]
            break
        out[i] = float(copies * sizes[i])
        full += copies * sizes[i]
        weight -= weights[i]
    return out


def split_tree(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks of each source in each shard, (sources, shards); sums over shards equal the quotas."""
    out = np.zeros((len(quotas), shards), np.int64)

    def split(counts: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[:, low] = counts
            return
        middle, total = (low + high) // 2, int(counts.sum())
        room = total * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left, rest = np.zeros_like(counts), total
        for i, n in enumerate(counts.tolist()):  # one colour after the other, given those before
            rest -= n
            left[i] = rng.hypergeometric(n, rest, room) if room and n else 0
            room -= int(left[i])
        split(left, low, middle)
        split(counts - left, middle, high)

    split(np.asarray(quotas, np.int64), 0, shards)
    return out


def permutation(blocks: int, key: str, seed: int = SEED) -> tuple[int, int]:
    """Factor and shift of a keyed permutation i -> (factor * i + shift) mod blocks."""
    digest = hashlib.md5(f"{seed}:{key}".encode()).digest()
    factor = int.from_bytes(digest[:6], "big") % max(blocks, 1) or 1
    while math.gcd(factor, max(blocks, 1)) != 1:
        factor += 1
    return factor, int.from_bytes(digest[6:12], "big") % max(blocks, 1)


def source_table(totals: list[tuple[str | None, int]], weights=WEIGHTS, share: float = SHARE, copies: int = COPIES,
                 block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> list[tuple]:
    """Per source: name, size, target, quota in words, block length, permutation, last block numbers of the shards."""
    totals = sorted(totals, key=lambda t: (t[0] is None, (t[0] or "").encode("utf-8", "surrogatepass")))
    sizes = [n for _, n in totals]
    goals = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, copies)
    words = [min(int(goal), copies * size) for goal, size in zip(goals, sizes)]
    while sum(words) // block_words > MOST_BLOCKS:
        block_words *= 2
    blocks = [-(-w // block_words) for w in words]
    dealt = split_tree(blocks, shards, seed).cumsum(axis=1).tolist()
    return [
        (name, size, goal, w, block_words, *permutation(b, f"{name is None}:{name}", seed), b, bounds)
        for (name, size), goal, w, b, bounds in zip(totals, goals, words, blocks, dealt)
    ]


TABLE = (
    "_source string, source_size bigint, target double, quota bigint, block_words bigint, factor bigint, "
    "shift bigint, blocks bigint, bounds array<bigint>"
)


def plan(docs: DataFrame, seed: int = SEED, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, key and ``pieces``.

    A piece is an array entry (shard, place, copy, from_word, words): some of the document's words in one block.
    ``key`` tells documents apart that share a doc_id; columns named in ``keep`` come along.
    """
    spark = docs.sparkSession
    body = F.coalesce("text", F.lit(""))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(body)))
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"), *keep)
    sized = gathered(sized.withColumn("bucket", F.conv(F.substring("key", 1, 3), 16, 10).cast("int")), "sized")
    buckets = small(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    # a row per source; their number does not follow that of documents
    totals = [tuple(r) for r in buckets.groupBy("source").agg(F.sum("words")).collect()]
    rows = source_table(totals, seed=seed, **options)
    sources = spark.createDataFrame(rows, TABLE)
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.select(
        F.col("source").alias("_source"), F.col("bucket").alias("_bucket"),
        F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"),
    )
    buckets = buckets.join(
        sources.withColumnRenamed("_source", "_name"), F.col("_source").eqNullSafe(F.col("_name"))
    ).drop("_name")
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size")
    upto = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0))
    placed = sized.withColumn("upto", upto).join(
        buckets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket"))
    )
    start = F.col("offset") + F.col("upto") - F.col("size")
    return placed.withColumn("start", start).select(
        "doc_id", "source", "size", "source_size", "target", "key", *keep, _pieces(seed).alias("pieces")
    )


def _pieces(seed: int) -> Column:
    quota, block, size = F.col("quota"), F.col("block_words"), F.col("size")
    none = F.array().cast("array<struct<shard:int,place:bigint,copy:int,from_word:bigint,words:bigint>>")

    def of_copy(copy: Column) -> Column:
        low = copy * F.col("source_size") + F.col("start")
        high = F.least(low + size, quota)

        def of_block(b: Column) -> Column:
            first, last = F.greatest(low, b * block), F.least(high, (b + 1) * block)
            number = F.pmod(F.col("factor") * b + F.col("shift"), F.col("blocks"))
            return F.struct(
                F.size(F.filter("bounds", lambda x: x <= number)).alias("shard"),
                F.xxhash64(F.lit(seed), F.col("key"), copy, b).alias("place"),
                copy.cast("int").alias("copy"),
                (first - low).alias("from_word"),
                (last - first).alias("words"),
            )

        some = (size > 0) & (low < high)
        numbers = F.sequence(_div(low, block), _div(high - 1, block))
        return F.when(some, F.transform(numbers, of_block)).otherwise(none)

    last = _div(F.greatest(quota - 1, F.lit(0)), F.greatest(F.col("source_size"), F.lit(1)))
    copies = F.sequence(F.lit(0).cast("bigint"), last)
    return F.flatten(F.transform(copies, of_copy))


def _div(a: Column, b: Column) -> Column:
    """Whole-number quotient; a double would lose digits above 2^53."""
    return F.call_function("div", a, b)


def taken(planned: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target and the words that the mix takes of each document."""
    words = F.aggregate("pieces", F.lit(0).cast("bigint"), lambda s, p: s + p["words"])
    return planned.select("doc_id", "size", "source_size", "target", words.alias("taken"))


def shards(planned: DataFrame) -> DataFrame:
    """The pieces of the output shards; ``place`` is their order within the shard."""
    return planned.select("doc_id", "key", F.inline("pieces"))


def mixture(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The rows of the mix, all columns of ``docs``: one for each time that a document is taken.

    The one document of a source that the quota cuts keeps the words it gives, joined by spaces; its ``n_chars``,
    where there is one, is counted again.
    """
    mark, part, times = "_mix_row", "_mix_words", "_mix_times"
    marked = docs.withColumn(mark, F.xxhash64(*docs.columns))
    planned = plan(marked, seed, keep=(mark,), **options)
    each = F.transform(
        F.array_distinct(F.col("pieces.copy")),
        lambda c: F.aggregate(
            F.filter("pieces", lambda p: p["copy"] == c), F.lit(0).cast("bigint"), lambda s, p: s + p["words"]
        ),
    )
    # rows equal in every column are interchangeable, so that counts of draws are enough
    draws = planned.select(mark, F.col("size").alias("_mix_size"), F.explode(each).alias(part))
    draws = draws.groupBy(mark, "_mix_size", part).agg(F.count("*").alias(times))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col(part).cast("int")), " ")
    text = F.when(F.col(part) < F.col("_mix_size"), cut).otherwise(F.col("text"))
    columns = {"text": text}
    if "n_chars" in docs.columns:
        counted = F.length(cut).cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col(part) < F.col("_mix_size"), counted).otherwise(F.col("n_chars"))
    rows = marked.dropDuplicates([mark]).join(draws, mark).withColumns(columns)
    return rows.withColumn(times, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times)))).select(*docs.columns)
