"""Word sequence removal against a dictionary of all windows."""

import hashlib
import random

import pytest

from gavelstat.llm import debruijn as db
from gavelstat.llm.frames import keyed_texts


def brute(rows):
    first = {}
    key = lambda d: (d is not None, d or 0)
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, words in split:
        for p in range(len(words) - db.WORDS + 1):
            w = tuple(words[p : p + db.WORDS])
            first[w] = min(first.get(w, key(d)), key(d))
    out = []
    for d, words in split:
        gone = [False] * len(words)
        for p in range(len(words) - db.WORDS + 1):
            if first[tuple(words[p : p + db.WORDS])] < key(d):
                gone[p : p + db.WORDS] = [True] * db.WORDS
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((d, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, line, other = make(260), make(12), make(90)
    rows = [(i, make(rng.randint(0, 200))) for i in range(30)]
    rows += [(100 + i, make(40) + line + make(40)) for i in range(20)]
    rows += [(200 + i, make(rng.randint(0, 30)) + passage + make(rng.randint(0, 30))) for i in range(8)]
    rows += [(300 + i, passage[rng.randint(0, 100) : rng.randint(150, 260)]) for i in range(8)]
    rows += [(400, passage), (401, passage), (402, other + passage + other), (403, other + other), (404, ["a"] * 400)]
    rows += [(405, ["a"] * 120), (406, ["a", "b"] * 200), (407, passage[:49]), (408, passage[:50])]
    rows += [(409, passage + passage), (410, make(2500))]
    for i in range(15):
        copy = list(passage)
        copy[rng.randrange(len(copy))] = f"edit{i}"
        rows.append((500 + i, copy))
    rows = [(d, rng.choice([" ", "\n", "  "]).join(w)) for d, w in rows]
    rows += [(None, " ".join(passage[:80])), (600, None), (601, ""), (602, " \t"), (200, " ".join(make(60)))]
    rows.append(rows[40])
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("large", [db.LARGE_BUCKET, 2])
def test_removal_equals_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(db, "LARGE_BUCKET", large)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS path", "'x' AS mark", "2 AS at")
    got = db.remove(docs.repartition(5), keep_text=False).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_a_shared_stretch_is_one_unitig(spark):
    rng = random.Random(1)
    make = lambda n: [f"v{rng.randint(0, 10**6)}" for _ in range(n)]
    passage = make(400)
    rows = [(i, " ".join(make(20) + passage + make(20))) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = db.unitigs(db.occurrences(db.chains(keyed_texts(docs))).cache()).collect()
    # chains that reach into a document's own words differ; what is common is compacted
    assert len(found) == 1 and found[0].source_doc == 0
    assert 400 - db.WORDS + 1 - 2 * db.WORDS < found[0].kmers <= 400 - db.WORDS + 1


def test_empty_table(spark):
    assert db.remove(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def many_of_one_id(n):
    """More different texts of one doc_id than a short mark can tell apart; each has an own part and a shared one."""
    rng = random.Random(n)
    passage = " ".join(f"p{i}" for i in range(60))
    return [f"{' '.join(f'a{rng.randrange(10**6)}' for _ in range(rng.randrange(4)))} {passage if i % 3 else ''} u{i}" for i in range(n)]


@pytest.mark.parametrize("doc_id", [None, 5])
def test_many_texts_of_one_doc_id(spark, doc_id):
    rows = [(doc_id, t) for t in many_of_one_id(15_000)]
    rows += [(1, rows[1][1])] if doc_id else []
    got = db.remove(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), keep_text=False).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
