"""Exact dedup against a dictionary, over several batches."""

import hashlib
import random
from collections import Counter

import pytest

from gavelstat.llm.digest_index import LOWER, UPPER, DigestIndex, temporary_index

TO_LOWER = str.maketrans(UPPER, LOWER)


def norm(text):
    return (text or "").translate(TO_LOWER)


def corpus():
    rng = random.Random(3)
    texts = ["", None, "Hello", "hELLO", "É", "é", "İ", "K", "k", "Straße", "x" * 100_000, "X" * 100_000, " a"]
    rows = [(i, rng.choice(texts)) for i in range(80)]
    return rows + [(5, "Hello"), (99, "unique"), (99, "unique"), (None, "alone"), (None, "Hello")]


@pytest.mark.parametrize("steps", [1, 2, 5])
def test_one_batch(spark, steps):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS digest", "'x' AS kept", "2 AS keep_id")
    got = temporary_index(spark).add(docs.repartition(5), steps=steps).collect()
    groups = {}
    for d, t in rows:
        groups.setdefault(norm(t), []).append(d)
    expected = Counter(
        (d, max((x for x in groups[norm(t)] if x is not None), default=None), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest())
        for d, t in rows
    )
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    kept = [(r.text_sha256, r.doc_id) for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in got if r.kept)


def test_later_batches_meet_the_index(spark):
    index = temporary_index(spark)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    assert [r.kept for r in index.add(frame([(1, "a"), (2, "b")])).collect()] == [True, True]
    second = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in index.add(frame([(9, "A"), (3, "c"), (4, "C")])).collect()}
    assert second == {9: (1, 1, False), 3: (4, 2, False), 4: (4, 2, True)}
    assert index.add(frame([])).count() == 0
    assert {(r.keep_id) for r in index.entries().collect()} == {1, 2, 4}
    plan = index._unseen(frame([(1, "x")]).selectExpr("text AS digest"), "new")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def outcome(df):
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize("steps", [1, 3])
def test_a_batch_that_is_run_again(spark, steps):
    """Same id, same rows: same result, same index; an append that was lost in part is completed."""
    docs = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    index = temporary_index(spark)
    index.add(spark.createDataFrame([(1000, "hello")], "doc_id bigint, text string"), "first")
    once = outcome(index.add(docs, "second", steps))
    stored = outcome(index.entries())
    assert outcome(index.add(docs, "second", steps)) == once and outcome(index.entries()) == stored
    assert sum(n for r, n in once.items() if r[3]) == len({norm(t) for _, t in corpus()} - {"hello"})
    part = temporary_index(spark)
    part._append(index.entries().filter("batch LIKE 'first%' OR keep_id % 2 = 0"))
    assert outcome(part.add(docs, "second", steps)) == once and outcome(part.entries()) == stored
    assert not any(r[3] for r in outcome(index.add(docs, "third", steps)))
    kept = temporary_index(spark)
    assert outcome(kept.keep_new(docs, "a")) == outcome(kept.keep_new(docs, "a"))
    assert kept.keep_new(docs, "b").count() == 0


def test_compaction(spark):
    docs = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    index = temporary_index(spark)
    for n in range(3):
        index.add(docs.filter(f"pmod(doc_id, 3) = {n}"), str(n))
    stored = outcome(index.entries())
    index.compact()
    assert outcome(index.entries()) == stored
    assert len(index.entries().inputFiles()) <= index.buckets
    assert not any(r[3] for r in outcome(index.add(docs.filter("doc_id IS NOT NULL"), "again")))
    # a compaction that ended before the new table got its name
    spark.sql(f"ALTER TABLE {index.name} RENAME TO {index._merged}")
    assert outcome(DigestIndex(spark, index.name, index.path).entries()) == stored


def test_rows_that_stay(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, i % 2) for i, r in enumerate(rows)], "doc_id bigint, text string, _exact int")
    index = temporary_index(spark)
    got = index.keep_new(docs).collect()
    best = {}
    for d, t in rows:
        key = norm(t)
        if key not in best or best[key] is None or d is not None and d > best[key]:
            best[key] = d
    assert Counter((norm(r.text), r.doc_id) for r in got) == Counter(best.items())
    assert index.keep_new(docs).count() == 0
    assert temporary_index(spark).keep_new(docs.limit(0)).columns == docs.columns


@pytest.mark.parametrize("n", [4, 7])
def test_buckets(spark, n):
    index = temporary_index(spark)
    assert index.buckets == int(spark.conf.get("spark.sql.shuffle.partitions")) and n
