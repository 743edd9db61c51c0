"""Byte string removal against a dictionary of all windows."""

import hashlib
import random

import pytest
import xxhash

from gavelstat.llm import suffix_buckets as sb


def brute(rows):
    """By (doc_id, row): sizes and digest; None ids come first."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = {}, []
    for i in order:
        raw = (rows[i][1] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - sb.LENGTH + 1):
            window = raw[p : p + sb.LENGTH]
            if seen.setdefault(window, (i, p)) != (i, p):
                gone[p : p + sb.LENGTH] = b"\1" * sb.LENGTH
        spans = sum(1 for p, g in enumerate(gone) if g and not (p and gone[p - 1]))
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((rows[i][0], len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def words(rng, n, size=60):
    return " ".join(rng.choice(["ab", "the", "of", "stone", "é", "river", "x"]) + str(rng.randint(0, size)) for _ in range(n))


def corpus():
    rng = random.Random(2)
    passage, line = words(rng, 80, 9999), words(rng, 14, 9999)
    rows = [(i, words(rng, rng.randint(0, 120), 9999)) for i in range(40)]
    rows += [(100 + i, f"{words(rng, 9, 999)} {line} {words(rng, 9, 999)}") for i in range(30)]
    rows += [(200 + i, f"{words(rng, 5, 999)}\n{passage}\n{words(rng, rng.randint(0, 30), 999)}") for i in range(12)]
    rows += [(300 + i, passage) for i in range(5)]
    rows += [(400, "a" * 700), (401, "ab" * 300), (402, "a" * 150), (403, None), (404, ""), (405, "x" * 99), (406, "x" * 100)]
    rows += [(407, passage + " and " + passage), (None, passage[:200] + "z" * 120), (408, words(rng, 3000, 40))]
    near = passage.split(" ")
    for i in range(15):
        copy = list(near)
        copy[rng.randrange(len(copy))] = "edited"
        rows.append((500 + i, " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("large", [sb.LARGE_BUCKET, 2])
def test_removal_equals_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(sb, "LARGE_BUCKET", large)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS bucket", "'x' AS mark", "2 AS at")
    got = sb.remove(docs.repartition(5), keep_text=False)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_repeated_rows_share_a_result_and_shared_ids_are_ordered(spark):
    text = words(random.Random(1), 60, 9999)
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (3, text + "!"), (3, "short")], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.n_bytes, r.n_removed) for r in sb.remove(docs, keep_text=False).collect())
    n = len(text.encode())
    assert got == [(1, n, 0), (1, n, 0), (2, n, n), (3, 5, 0), (3, n + 1, n)]
    assert sb.remove(docs.limit(0)).count() == 0


def test_blocks_of_a_long_text_give_the_same(spark, monkeypatch):
    rng = random.Random(4)
    part = words(rng, 400, 9999)
    rows = [(1, part + words(rng, 300, 9999)), (2, words(rng, 37, 9999) + part + part)]
    monkeypatch.setattr("gavelstat.llm.windows.BLOCK", 501)
    symbols = [sb.byte_symbols(__import__("pyarrow").array([t])) for _, t in rows]
    for s, sizes in symbols:
        chains = list(sb.WINDOWS.chains(s, sizes))
        assert sum(int(c.count.sum()) for c in chains) == len(s) - sb.LENGTH + 1


def test_open_buckets_across_batches(spark):
    rng = random.Random(8)
    rows = sorted({(rng.randint(1, 40), rng.randint(1, 3), rng.randint(1, 3), rng.randint(1, 2), rng.randint(1, 9)) for _ in range(600)})
    docs = spark.createDataFrame(rows, sb.CHAIN_DDL).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {tuple(r) for r in sb.judge_chains(docs.sortWithinPartitions("bucket", "path", "doc", "mark", "at")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    first, paths = {}, {}
    for b, p, *place in rows:
        first.setdefault((b, p), place)
        paths.setdefault(b, set()).add(p)
    expected = {(None, *place) for b, p, *place in rows if first[b, p] != place}
    expected |= {(b, *first[b, p]) for b, p in first if len(paths[b]) > 1 or p % 2}
    assert got == expected


@pytest.mark.parametrize("doc_id", [None, 5])
def test_many_texts_of_one_doc_id(spark, doc_id):
    """More different texts of one doc_id than a short mark can tell apart; they go by the hash of their texts."""
    rng = random.Random(3)
    passage = words(rng, 40, 9999)[:160]
    texts = {f"{words(rng, rng.randint(0, 4), 99999)}{passage if i % 3 else ''}{'w' * rng.randint(0, 60)}{i}" for i in range(15_000)}
    rows = [(doc_id, t) for t in sorted(texts, key=lambda t: signed_hash(t))]
    rows += [(1, rows[1][1])] if doc_id else []
    got = sb.remove(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), keep_text=False).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def signed_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h
